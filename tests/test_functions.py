"""Scalar functions on the cases whose results are known."""

from datetime import date, datetime

from pyspark.sql import functions as F

from kairograph.functions import text as X
from kairograph.functions import time as T
from kairograph.functions import vectors as V

NY = "America/New_York"


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_titles_and_words(spark):
    assert value(spark, X.normalize_title(F.lit("GEO 12 — Field Report (draft) due"))) == "geo 12 field report due"
    assert value(spark, X.identifying_words(F.lit("Class meeting with Adele, adele"))) == ["adele"]
    people = F.array(F.lit("livia"), F.lit("okoro"))
    assert value(spark, X.query_words(F.lit("tell me where Livia has that dentist checkup"), people)) == ["dentist", "checkup"]
    assert value(spark, X.first_name(F.lit("Ana"))) == ""


def test_names_and_mentions(spark):
    assert value(spark, X.person_names(F.lit("J. Okoro Adele"), F.array(F.lit("jo")))) == ["J. Okoro Adele", "jo", "Okoro", "Adele"]
    assert value(spark, X.mentions(F.lit("ask Okoro."), F.lit("okoro")))
    assert not value(spark, X.mentions(F.lit("ask Okorog"), F.lit("okoro")))


def test_segments(spark):
    assert value(spark, X.segments(F.lit("one sentence alone here."), 3)) == []
    assert value(spark, X.segments(F.lit("first sentence here. second sentence here.\nthird line is here"), 2)) == ["first sentence here. second sentence here.", "third line is here"]


def test_local_time_over_a_clock_change(spark):
    at = lambda d: value(spark, T.local_instant(F.lit(d).cast("date"), F.lit("10:20"), NY))
    assert at("2026-10-27") == datetime(2026, 10, 27, 14, 20)
    assert at("2026-11-03") == datetime(2026, 11, 3, 15, 20)
    assert value(spark, T.day_start(F.lit("2026-11-01").cast("date"), NY)) == datetime(2026, 11, 1, 4, 0)
    stamp = F.lit("2026-11-03 03:30:00").cast("timestamp")
    assert value(spark, T.local_date(stamp, NY)) == date(2026, 11, 2)
    assert value(spark, T.local_time(stamp, NY)) == "22:30"


def test_ttl_is_whole_days(spark):
    assert value(spark, T.expires_at(F.lit("2026-01-15 12:00:00").cast("timestamp"), F.lit(31))) == datetime(2026, 2, 15, 12)


def test_cosine_edges(spark):
    vec = lambda *xs: F.array(*[F.lit(float(x)) for x in xs])
    assert value(spark, V.cosine(vec(1, 0), vec(1, 0))) == 1.0
    assert value(spark, V.cosine(vec(0, 0), vec(1, 0))) == 0.0
    assert value(spark, V.cosine(vec(1), vec(1, 0))) == 0.0

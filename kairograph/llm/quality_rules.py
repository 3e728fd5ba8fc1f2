"""Quality rules: statistics of each text and cross-document line frequency.  DataFrame functions only.

A line is normalised (lower case, each stretch of white space and digits as one space) and hashed.  For each host the
distinct documents (id and text) that hold a line are counted.  A line in at least LEAST_DOCUMENTS of them and in more
than MOST_SHARE of the host's documents, or in more than MOST_DOCUMENTS whatever the host's size, is above the limit:
equal shares are treated alike at hosts of all sizes, and the ceiling holds in a host of millions.  clean() gives the
texts without such lines.  A document that loses more than MOST_REMOVED of the characters of its lines is depleted and
rejected.  Each text's lines are hashed once and kept as (hash, length, place); the few lines above the limit meet them
in SALTS parts, so that the commonest line of a host is not one task's work.

Null texts have no words and fail.  Null hosts are one host.  Repeated rows get equal answers.  Lines count for whole
texts, very long ones too; only the named columns are read, and inner names lie in structs of their own, so other columns
may have any name.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kairograph.llm.common import fresh, stored, table

BLANK = r"[\x20\x09-\x0D]+"
LEAST_DOCUMENTS, MOST_SHARE, MOST_DOCUMENTS, MOST_REMOVED = 5, 0.05, 10_000, 0.5
SALTS = 8
LEAST_WORDS = 50
KEYS = ["id_key", "text_key", "host_key"]


def _id_key():
    return F.coalesce(F.col("id").cast("string"), F.lit("")).alias("id_key")


def _wordy(text):
    """The lines with a word."""
    return F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))


def _line_chars(text):
    return F.aggregate(F.transform(_wordy(F.coalesce(text, F.lit(""))), F.length), F.lit(0).cast("long"), lambda a, n: a + n)


def _lines(docs: DataFrame) -> DataFrame:
    """text_key, host, and lines: (hash of the normalised line, length, place) of each line with a word."""
    text = F.coalesce("text", F.lit(""))
    placed = F.transform(F.split(text, "\n"), lambda line, i: F.struct(line.alias("t"), i.alias("i")))
    lines = F.filter(placed, lambda line: line["t"].rlike(r"[^\x20\x09-\x0D]"))
    hashed = F.transform(lines, lambda line: F.struct(F.xxhash64(F.lower(F.trim(F.regexp_replace(line["t"], r"[\x20\x09-\x0D0-9]+", " ")))).alias("h"), F.length(line["t"]).alias("n"), line["i"].alias("i")))
    return docs.select(_id_key(), F.xxhash64(text, F.lit(1)).alias("text_key"), F.coalesce("host", F.lit("")).alias("host"), hashed.alias("lines"))


def lines_of(docs: DataFrame) -> DataFrame:
    """(id_key, text_key, host, lines), stored; docs has columns id, host, text."""
    return stored(_lines(docs), "lines")


def frequent_lines(lined: DataFrame, least: int = LEAST_DOCUMENTS, share: float = MOST_SHARE, most: int = MOST_DOCUMENTS) -> DataFrame:
    """(host, h): the lines above the limit.  lined: of lines_of()."""
    docs = lined.select("host", "id_key", "text_key", F.array_distinct(F.col("lines.h")).alias("h")).groupBy("host", "id_key", "text_key").agg(F.any_value("h").alias("h"))
    sizes = docs.groupBy("host").agg(F.count("*").alias("documents"))
    counts = docs.select("host", F.explode("h").alias("h")).groupBy("host", "h").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return counts.join(sizes, "host").where((F.col("n") > share * F.col("documents")) | (F.col("n") > most)).select("host", "h")


def statistics(docs: DataFrame) -> DataFrame:
    """The base statistics of each row; docs has columns id, host, text."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        "id",
        text.alias("text"),
        F.xxhash64(text, F.lit(1)).alias("text_key"),
        F.coalesce("host", F.lit("")).alias("host_key"),
        F.array_remove(F.split(text, BLANK), "").alias("words"),
        (F.length(text) - F.length(F.regexp_replace(text, "[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        _wordy(text).alias("wordy"),
    )
    windows = F.when(
        F.size("words") >= 3,
        F.transform(F.sequence(F.lit(0), F.size("words") - 3), lambda i: F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2))),
    )
    rows = rows.select(
        "id",
        "text",
        "text_key",
        "host_key",
        F.aggregate(F.transform("wordy", F.length), F.lit(0).cast("long"), lambda a, n: a + n).alias("line_chars"),
        "n_symbols",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.size("wordy") - F.size(F.array_distinct("wordy"))).cast("long").alias("n_dup_lines"),
        windows.alias("windows"),
    )
    # only where a window is found twice are the windows put in order, equal ones side by side
    ordered = F.when(F.size(F.array_distinct("windows")) < F.size("windows"), F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    rows = rows.withColumn("ordered", ordered)
    again = F.filter("ordered", lambda w, k: ((k > 0) & (F.get("ordered", F.greatest(k - 1, F.lit(0)))["h"] == w["h"])) | F.coalesce(F.get("ordered", k + 1)["h"] == w["h"], F.lit(False)))
    covered = F.size(F.array_distinct(F.flatten(F.transform(again, lambda w: F.array(w["i"], w["i"] + 1, w["i"] + 2)))))
    rows = rows.withColumn("n_repeat_words", F.when(F.col("ordered").isNull(), F.lit(0)).otherwise(covered).cast("long"))
    return rows.drop("windows", "ordered").withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def _gone(rows: DataFrame) -> DataFrame:
    """id_key, text_key, host_key, gone and removed: the places and the characters of the lines above the limit, where there are any."""
    lined = lines_of(rows)
    above = stored(frequent_lines(lined), "frequent-lines").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salt = F.pmod(F.xxhash64("id_key", "text_key"), F.lit(SALTS)).cast("int").alias("salt")
    lines = lined.select("id_key", "text_key", "host", salt, F.explode("lines").alias("line")).select("id_key", "text_key", "host", "salt", F.col("line.h").alias("h"), F.struct("line.i", "line.n").alias("line"))
    # a set, since repeated rows bring the same lines
    hit = lines.join(above, ["host", "h", "salt"]).groupBy("id_key", "text_key", F.col("host").alias("host_key")).agg(F.collect_set("line").alias("lines"))
    return hit.select("id_key", "text_key", "host_key", F.col("lines.i").alias("gone"), F.aggregate("lines", F.lit(0).cast("long"), lambda a, line: a + line["n"]).alias("removed"))


def _depleted():
    return F.coalesce(F.col("removed") > MOST_REMOVED * F.col("line_chars"), F.lit(False))


def _cleaned(text):
    """The text without the lines at the places in gone; the other lines stay as they are and in order."""
    return F.when(F.col("gone").isNull(), text).otherwise(F.array_join(F.filter(F.split(text, "\n"), lambda line, i: ~F.array_contains("gone", i)), "\n"))


def clean(docs: DataFrame, id_column: str = "doc_id", host_column: str = "source", text_column: str = "text") -> DataFrame:
    """The rows and columns with texts without the lines above the limit, and removed_chars and depleted.  A null text stays
    null."""
    text, host = F.col(f"`{text_column}`"), F.col(f"`{host_column}`")
    rows = fresh(docs, id_column, host_column, text_column).toDF("id", "host", "text")
    own = [F.coalesce(F.col(f"`{id_column}`").cast("string"), F.lit("")).alias("id_key"), F.xxhash64(F.coalesce(text, F.lit("")), F.lit(1)).alias("text_key"), F.coalesce(host, F.lit("")).alias("host_key")]
    found = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *own, _line_chars(text).alias("line_chars")).join(_gone(rows), KEYS, "left")
    texts = _cleaned(F.col("row").getField(text_column)).alias(text_column)
    columns = [texts if c == text_column else F.col("row").getField(c).alias(c) for c in docs.columns]
    return found.select(*columns, F.coalesce("removed", F.lit(0)).alias("removed_chars"), _depleted().alias("depleted"))


def judge(docs: DataFrame, id_column: str = "doc_id", host_column: str = "source", text_column: str = "text") -> DataFrame:
    """Per row: the id column, the base statistics, kept, the number and characters of the removed lines, and the text that is
    left (a null text as empty)."""
    rows = fresh(docs, id_column, host_column, text_column).toDF("id", "host", "text")
    found = statistics(rows).withColumn("id_key", _id_key()).join(_gone(rows), KEYS, "left")
    kept = ~F.col("base_failed") & ~_depleted()
    base = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    lines = F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long")
    return found.select(F.col("id").alias(id_column), *base, kept.alias("kept"), lines.alias("n_removed_lines"), F.coalesce("removed", F.lit(0)).cast("long").alias("removed_chars"), _cleaned(F.col("text")).alias("cleaned"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = judge(table(spark, sf_dir, "documents"))
    return found.withColumn("cleaned_sha256", F.sha2(F.col("cleaned").cast("binary"), 256)).drop("cleaned")


OP8_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS wordy,
             length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols FROM t),
v AS (SELECT doc_id, unnest(words) AS word, unnest(range(len(words))) AS i FROM w),
v3 AS (SELECT doc_id, i, word, lead(word) OVER x AS second, lead(word, 2) OVER x AS third FROM v WINDOW x AS (PARTITION BY doc_id ORDER BY i)),
g2 AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, word, second, third) AS n FROM v3 WHERE third IS NOT NULL),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM g2, (SELECT unnest([0, 1, 2]) AS k) WHERE n > 1 GROUP BY doc_id),
l AS (SELECT doc_id, host, text, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS place FROM t),
l2 AS (SELECT doc_id, host, text, place, length(line) AS n, lower(trim(regexp_replace(line, '[\x20\x09-\x0D0-9]+', ' ', 'g'))) AS h
       FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
f AS (SELECT host, h, count(DISTINCT (doc_id, text)) AS n FROM l2 GROUP BY host, h HAVING count(DISTINCT (doc_id, text)) >= 5),
s AS (SELECT host, count(DISTINCT (doc_id, text)) AS documents FROM t GROUP BY host),
a AS (SELECT host, h FROM f JOIN s USING (host) WHERE n > 0.05 * documents OR n > 10000),
d AS (SELECT doc_id, sum(n) AS line_chars, sum(CASE WHEN a.h IS NOT NULL THEN n ELSE 0 END) AS removed, list(place) FILTER (a.h IS NOT NULL) AS gone
      FROM l2 LEFT JOIN a ON a.host = l2.host AND a.h = l2.h GROUP BY doc_id),
c AS (SELECT l.doc_id, sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (gone IS NULL OR NOT list_contains(gone, place)), '')) AS cleaned_sha256
      FROM l LEFT JOIN d ON d.doc_id = l.doc_id GROUP BY l.doc_id),
b AS (SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
             CAST(n_symbols AS BIGINT) AS n_symbols, CAST(len(wordy) - len(list_distinct(wordy)) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, coalesce(removed > 0.5 * line_chars, false) AS depleted,
             CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed_lines, CAST(coalesce(removed, 0) AS BIGINT) AS removed_chars, cleaned_sha256
      FROM w LEFT JOIN r ON r.doc_id = w.doc_id LEFT JOIN d ON d.doc_id = w.doc_id LEFT JOIN c ON c.doc_id = w.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT depleted AS kept,
       n_removed_lines, removed_chars, cleaned_sha256
FROM b
"""

QUERIES = {"op8_quality_rules": op8_quality_rules}
ORACLE_SQL = {"op8_quality_rules": OP8_SQL}

"""Text functions as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kairograph.config import GENERIC_QUERY_WORDS, GENERIC_TITLE_WORDS, MIN_SEGMENT_CHARS


def normalize_title(title: Column) -> Column:
    """Lower case, asides in parentheses dropped, everything but a-z and 0-9 as single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(title), r"\([^)]*\)", " "), "[^a-z0-9]+", " "))


def identifying_words(title: Column) -> Column:
    """Distinct words of the normalised title of four letters or more that are not generic."""
    return naming_words(normalize_title(title))


def naming_words(normalized: Column) -> Column:
    """identifying_words() of a title that is normalised already."""
    return F.array_distinct(F.filter(F.split(normalized, " "), lambda w: (F.length(w) >= 4) & ~w.isin(*GENERIC_TITLE_WORDS)))


def query_words(query: Column, person_words: Column) -> Column:
    """Distinct words of four letters or more that can name a plan or task, in order."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(query), F.lit(r"(\p{L}{4,})"), F.lit(1)))
    return F.filter(words, lambda w: ~w.isin(*GENERIC_QUERY_WORDS) & ~F.array_contains(person_words, w))


def person_names(title: Column, aliases: Column) -> Column:
    """The title, the aliases and each capitalised word of the title, as a person may be written."""
    words = F.transform(F.split(title, r"\s+"), lambda w: F.regexp_replace(w, r"[^\p{L}'-]", ""))
    words = F.filter(words, lambda w: (F.length(w) >= 3) & w.rlike(r"^\p{Lu}"))
    return F.filter(F.concat(F.array(title), F.coalesce(aliases, F.array().cast("array<string>")), words), lambda n: F.length(n) >= 2)


def mentions(text: Column, name: Column) -> Column:
    """Whether the name stands in the text as a whole word or phrase, in either case."""
    quoted = F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}])\Q"), name, F.lit(r"\E(?![\p{L}\p{N}])"))
    return F.rlike(text, quoted)


def segments(text: Column, limit: int) -> Column:
    """Lines and sentences of at least MIN_SEGMENT_CHARS; none if there is one only; neighbours merged beyond limit."""
    parts = F.filter(F.transform(F.split(text, r"\n+|(?<=[.!?;])\s+"), F.trim), lambda p: F.length(p) >= MIN_SEGMENT_CHARS)
    size = F.ceil(F.size(parts) / limit).cast("int")
    merged = F.transform(F.sequence(F.lit(1), F.size(parts), size), lambda i: F.array_join(F.slice(parts, i, size), " "))
    return F.when(F.size(parts) <= 1, F.array().cast("array<string>")).when(F.size(parts) <= limit, parts).otherwise(merged)


def normalize_quote(text: Column) -> Column:
    """Lower case, curly quotes and dashes made plain, white space folded."""
    return F.trim(F.regexp_replace(F.translate(F.lower(text), "‘’“”–—", "''\"\"--"), r"\s+", " "))


def embedding_text(title: Column, body: Column) -> Column:
    return F.when(F.coalesce(body, F.lit("")) == "", title).otherwise(F.concat(title, F.lit("\n"), body))


def history_text(old: Column, new: Column) -> Column:
    return F.concat(F.coalesce(old, F.lit("")), F.lit(" → "), F.coalesce(new, F.lit("")))


def first_name(title: Column) -> Column:
    """The first word of three characters or more if a space follows, else empty."""
    return F.regexp_extract(title, r"^(\S{3,})\s", 1)

"""A quality classifier: regularised quadratic discriminant analysis of document statistics.

Each text becomes a short vector of statistics (length, words, characters of several kinds, repetition), transformed so
that one normal density a class describes it.  For each class the mean and the covariance of all its labelled documents
are summed over the cluster; the covariance is shrunk towards the pooled variances, more so the fewer documents there are.
A score is the logistic of the difference of the classes' log densities (Mahalanobis distances through Cholesky factors
that are computed once) and the classes' log shares.

Labels are 1 and 0; other values and nulls are left out.  A document with the same label twice counts once, one with both
labels counts in both classes.  If a class has no document, every score is the share of the label 1 (a half without any).
Null texts count as empty; empty texts have a vector too and get a score like any other.  Repeated rows get equal scores.
Very long texts need memory in proportion to themselves.  Only the named columns are read, so others may have any name.
An empty table gives an empty result.
"""

from __future__ import annotations

import math
import operator
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kairograph.llm.common import bytes_of, fresh, map_steps, stored, table

#: Scores from here on are predicted as label 1.
THRESHOLD = 0.3
#: The share of the pooled variances in a class covariance is (dimension + STRENGTH) / (documents + dimension + STRENGTH).
STRENGTH = 20.0
#: Added to each variance, so that a statistic without any spread does not decide alone.
LEAST_VARIANCE = 1e-3


def _kinds() -> np.ndarray:
    """A column for each kind of byte: letters, capitals, digits, symbols, commas and stops, strong marks, other bytes of
    longer characters, white space."""
    byte = np.arange(256)
    of = lambda chars: np.isin(byte, list(chars))
    capitals = (byte >= 65) & (byte <= 90)
    return np.stack(
        [(byte >= 97) & (byte <= 122) | capitals, capitals, (byte >= 48) & (byte <= 57), of(b"#*$%&|<>@^~=+_\\/"), of(b".,;:"), of(b"!?"), byte >= 128, of(b" \t\n\x0b\x0c\r")],
        axis=1,
    ).astype(np.float64)


KINDS = _kinds()
STATISTICS = (
    "words", "bytes_a_word", "letters", "capitals", "digits", "symbols", "stops", "strong_marks", "wide", "space", "distinct_words", "commonest_word", "same_as_before", "short_words", "symbol_words",
    "repeated_lines", "words_a_line", "packed_size",
)


def _share(part: float, whole: float) -> float:
    """A share as half a turn of the circle: equal spread at all sizes."""
    return math.asin(math.sqrt(min(1.0, part / whole))) if whole > 0 else 0.0


def statistics(text: bytes) -> list[float]:
    """The transformed statistics of a text in UTF-8."""
    words, lines = text.split(), [x for x in text.split(b"\n") if x.strip()]
    n, size = len(words), len(text)
    letters, capitals, digits, symbols, stops, strong, wide, space = np.bincount(np.frombuffer(text, np.uint8), minlength=256) @ KINDS
    common = Counter(words)
    ends = sum(w[-1] in b"#*$%&|<>" for w in words)
    return [
        math.log1p(n),
        math.log1p((size - space) / max(n, 1)),
        _share(letters + wide, size),
        _share(capitals, letters),
        _share(digits, size),
        _share(symbols, size),
        _share(stops, n),
        _share(strong, n),
        _share(wide, size),
        _share(space, size),
        math.log1p(len(common)) / math.log1p(n) if n else 0.0,
        _share(max(common.values(), default=0), n) if n >= 2 else 0.0,
        _share(sum(map(operator.eq, words, words[1:])), n),
        _share(sum(len(w) <= 3 for w in words), n),
        _share(ends, n),
        _share(len(lines) - len(set(lines)), len(lines)),
        math.log1p(n / max(len(lines), 1)),
        math.log((len(zlib.compress(text, 1)) + 1) / (size + 1)) if size else 0.0,
    ]


def statistics_of(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: the id column and x, the statistics of its text."""
    width = len(STATISTICS)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        flat = np.array([statistics(t) for t in bytes_of(batch)]).reshape(-1)
        x = pa.ListArray.from_arrays(np.arange(0, len(flat) + 1, width, dtype=np.int32), flat)
        return pa.record_batch([batch.column(id_column), x], ["id", "x"])

    rows = fresh(docs, id_column, text_column).withColumnRenamed(text_column, "text")
    return map_steps(rows, work, f"id {rows.schema[id_column].dataType.simpleString()}, x array<double>").withColumnRenamed("id", id_column)


class QuadraticDiscriminant:
    """Two normal densities.  moments: for each label 0 and 1 the number of vectors, their sum and the sum of their outer
    products."""

    def __init__(self, moments: dict[int, tuple[float, np.ndarray, np.ndarray]], strength: float = STRENGTH):
        counts = {k: moments[k][0] if k in moments else 0 for k in (0, 1)}
        total = sum(counts.values())
        self.share = counts[1] / total if total else 0.5
        self.classes = []
        if not min(counts.values()):
            return
        means = {k: moments[k][1] / n for k, n in counts.items()}
        spread = {k: moments[k][2] / n - np.outer(means[k], means[k]) for k, n in counts.items()}
        pooled = np.diag(sum(np.diag(spread[k]) * counts[k] for k in (0, 1)) / total + LEAST_VARIANCE)
        for k in (0, 1):
            own = (len(pooled) + strength) / (counts[k] + len(pooled) + strength)
            factor = np.linalg.cholesky((1 - own) * spread[k] + own * pooled + LEAST_VARIANCE * np.eye(len(pooled)))
            offset = math.log(counts[k] / total) - np.log(np.diag(factor)).sum()
            self.classes.append((means[k], np.linalg.inv(factor), offset))

    def score(self, x: np.ndarray) -> np.ndarray:
        """The probability of label 1 for each row of x."""
        if not self.classes:
            return np.full(len(x), self.share)
        low, high = (offset - 0.5 * np.square((x - mean) @ inverse.T).sum(axis=1) for mean, inverse, offset in self.classes)
        return 1 / (1 + np.exp(np.clip(low - high, -700, 700)))


def fit(rows: DataFrame, strength: float = STRENGTH) -> QuadraticDiscriminant:
    """The classifier of the rows (label 0 or 1, x).  All rows count; a task sends its sums only."""
    width = len(STATISTICS)
    size = 1 + width + width * width

    def sums(batches):
        total = {0: np.zeros(size), 1: np.zeros(size)}
        for batch in batches:
            labels = batch.column("label").to_numpy(zero_copy_only=False)
            x = np.array(batch.column("x").flatten()).reshape(-1, width)
            for k, t in total.items():
                own = x[labels == k]
                t += np.concatenate([[len(own)], own.sum(axis=0), (own.T @ own).reshape(-1)])
        for k, t in total.items():
            if t[0]:
                yield pa.record_batch([pa.array([k] * size, pa.int32()), pa.array(range(size), pa.int32()), pa.array(t)], ["label", "at", "v"])

    found = rows.select("label", "x").mapInArrow(sums, "label int, at int, v double").groupBy("label", "at").agg(F.sum("v").alias("v"))
    flat: dict[int, np.ndarray] = {}
    for r in found.collect():  # two labels, size numbers each
        flat.setdefault(r.label, np.zeros(size))[r["at"]] = r.v
    return QuadraticDiscriminant({k: (t[0], t[1 : 1 + width], t[1 + width :].reshape(width, width)) for k, t in flat.items()}, strength)


def labelled(vectors: DataFrame, labels: DataFrame, training: Column, label_column: str = "quality", id_column: str = "doc_id") -> DataFrame:
    """(label, x) of the vectors that training (a condition on the id) takes and that have a label."""
    known = labels.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{label_column}`").cast("int").alias("label")).where("label in (0, 1)").distinct()
    return vectors.where(training).withColumnRenamed(id_column, "id").join(known, "id").select("label", "x")


def scored(vectors: DataFrame, model: QuadraticDiscriminant, threshold: float = THRESHOLD, id_column: str = "doc_id") -> DataFrame:
    """Per row: the id column, score and predicted."""
    shared, width = vectors.sparkSession.sparkContext.broadcast(model), len(STATISTICS)

    def run(batches):
        for batch in batches:
            score = shared.value.score(np.array(batch.column("x").flatten()).reshape(-1, width))
            yield pa.record_batch([batch.column(0), pa.array(score), pa.array((score >= threshold).astype(np.int32))], ["id", "score", "predicted"])

    kind = vectors.schema[id_column].dataType.simpleString()
    return vectors.select(id_column, "x").mapInArrow(run, f"id {kind}, score double, predicted int").withColumnRenamed("id", id_column)


def held_out(id_column: str = "doc_id") -> Column:
    """Whether the remainder of the CRC-32 of the id's text by 5 is 0; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(f"`{id_column}`").cast("string"), F.lit("")).cast("binary")) % 5 == 0


def op13_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = stored(statistics_of(table(spark, sf_dir, "documents")), "statistics")
    model = fit(labelled(vectors, table(spark, sf_dir, "labels"), ~held_out()))
    return scored(vectors, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")


QUERIES = {"op13_quality_classifier": op13_quality_classifier}
ORACLE_SQL: dict[str, str] = {}

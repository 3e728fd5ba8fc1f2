"""Language identification with language-bitmask n-gram filters.

A bit-sliced Bloom filter is an array of bitmasks, one bit for each language: an n-gram's languages are the AND of the
masks at its hashed places, so one look-up returns all languages that contain it.  A language's filter holds the n-grams
that occur in at least LEAST_SHARE of its training documents.  For a text, the bits of all its n-grams are counted for
each language, each count is corrected for the filter's false positives at that language's fill, and the largest decides.

Training takes at most about sample_per_language documents of each label (chosen by hash; the bound is a parameter);
prediction reads the text alone.  A text that is null or has no letter gives `und` with score 0; so does any text if
nothing was learned.  Ties go to the first label in order.  The score is the corrected share of the text's n-grams that
the language holds.  Repeated rows get equal answers; whole texts are read, whatever their length; only the named columns
are read, so others may have any name.  An empty table gives an empty result.  Labels are languages: their filters are
held by every task, so their number must be small.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kairograph.llm.common import fresh, map_steps, table, texts_of

SIZES = (3, 4)
SAMPLE_PER_LANGUAGE = 600
LEAST_SHARE = 0.03
HASHES = 3
SLOTS_PER_GRAM = 16
UNKNOWN = "und"
#: Odd multipliers of a multiplicative hash.
MIX, MIX_MORE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


@functools.cache
def letters() -> np.ndarray:
    """Each code point as itself if it is a letter, else as a space."""
    found = np.full(0x110000, 32, np.uint32)
    for c in range(0x110000):
        if chr(c).isalpha():
            found[c] = c
    return found


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-grams of the texts' letters, and the index of each one's text."""
    low = [f" {t.lower()} " for t in texts]
    codes = letters()[np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)]
    owner = np.repeat(np.arange(len(low), dtype=np.int32), [len(t) for t in low])
    space = codes == 32
    wide = codes.astype(np.uint64)
    hashed, owners = [], []
    for n in SIZES:
        if len(codes) < n:
            continue
        h = np.full(len(codes) - n + 1, n, np.uint64)
        for k in range(n):
            h = (h ^ wide[k : len(codes) - n + 1 + k]) * MIX
            h ^= h >> np.uint64(29)
        inside = owner[: len(owner) - n + 1] == owner[n - 1 :]
        for k in range(1, n - 1):
            inside &= ~space[k : len(codes) - n + 1 + k]
        hashed.append(h[inside])
        owners.append(owner[: len(owner) - n + 1][inside])
    if not hashed:
        return np.zeros(0, np.uint64), np.zeros(0, np.int32)
    return np.concatenate(hashed), np.concatenate(owners)


class LanguageFilters:
    """Bit-sliced Bloom filters of the languages' n-grams; masks has a 64-bit word for each 64 languages."""

    def __init__(self, languages: list[str], of_language: list[np.ndarray]):
        self.languages = languages
        total = max(1, sum(map(len, of_language)))
        self.slots = 1 << max(10, (SLOTS_PER_GRAM * total - 1).bit_length())
        self.masks = np.zeros((-(-max(1, len(languages)) // 64), self.slots), np.uint64)
        for i, g in enumerate(of_language):
            for at in self.places(g):
                self.masks[i // 64, at] |= np.uint64(1 << i % 64)
        fill = [np.count_nonzero(self.masks[i // 64] >> np.uint64(i % 64) & np.uint64(1)) / self.slots for i in range(len(languages))]
        self.false_rate = np.array(fill) ** HASHES

    def places(self, g: np.ndarray) -> list[np.ndarray]:
        step = (g * MIX_MORE) >> np.uint64(20) | np.uint64(1)
        return [((g + np.uint64(k) * step) & np.uint64(self.slots - 1)).astype(np.int64) for k in range(HASHES)]

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        if not self.languages or not texts:
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        g, owner = grams(texts)
        places = self.places(g)
        total = np.bincount(owner, minlength=len(texts))
        hits = np.zeros((len(self.languages), len(texts)))
        for word in range(len(self.masks)):
            held = self.masks[word][places[0]]
            for at in places[1:]:
                held &= self.masks[word][at]
            for i in range(64 * word, min(64 * word + 64, len(self.languages))):
                hits[i] = np.bincount(owner, weights=(held >> np.uint64(i % 64) & np.uint64(1)).astype(np.float64), minlength=len(texts))
        rate = self.false_rate[:, None]
        share = np.clip((hits / np.maximum(total, 1) - rate) / np.maximum(1 - rate, 1e-9), 0, 1)
        best = share.argmax(axis=0)
        known = total > 0
        for i, t in enumerate(texts):
            known[i] = known[i] and any(map(str.isalpha, t))
        return [self.languages[b] if k else UNKNOWN for b, k in zip(best, known)], np.where(known, share[best, np.arange(len(texts))], 0.0).tolist()


def held_out(id_column: str = "doc_id") -> Column:
    """Whether the remainder of the CRC-32 of the id's text by 3 is 1; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(f"`{id_column}`").cast("string"), F.lit("")).cast("binary")) % 3 == 1


def learn(docs: DataFrame, training: Column, sample_per_language: int = SAMPLE_PER_LANGUAGE, text_column: str = "text", label_column: str = "lang", id_column: str = "doc_id") -> LanguageFilters:
    """Fits the filters on about sample_per_language of the training rows of each label."""
    rows = docs.where(training & F.col(f"`{label_column}`").isNotNull() & F.col(f"`{text_column}`").isNotNull())
    counts = {r[0]: r[1] for r in rows.groupBy(F.col(f"`{label_column}`").cast("string").alias("label")).count().collect()}
    if not counts:
        return LanguageFilters([], [])
    grain = 1 << 20
    share = F.create_map(*[x for label, n in counts.items() for x in (F.lit(label), F.lit(min(grain, -(-sample_per_language * grain // n))))])
    label = F.col(f"`{label_column}`").cast("string")
    sample = rows.where(F.pmod(F.xxhash64(f"`{id_column}`", f"`{text_column}`"), F.lit(grain)) < share[label]).select(label.alias("label"), F.col(f"`{text_column}`").alias("text"))

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        labels = batch.column("label").to_pylist()
        g, owner = grams(texts_of(batch))
        order = np.argsort(owner, kind="stable")
        bounds = np.searchsorted(owner[order], np.arange(len(labels) + 1))
        own: dict[str, list[np.ndarray]] = {}
        for i, k in enumerate(labels):  # each n-gram once for each document
            own.setdefault(k, []).append(np.unique(g[order[bounds[i] : bounds[i + 1]]]))
        counted = [(k, *np.unique(np.concatenate(parts), return_counts=True)) for k, parts in own.items()]
        names = [k for k, x, _ in counted for _ in range(len(x))]
        return pa.record_batch([pa.array(names, pa.string()), pa.array(np.concatenate([x for _, x, _ in counted]).view(np.int64)), pa.array(np.concatenate([n for *_, n in counted]).astype(np.int64))], ["label", "gram", "n"])

    sizes = {r[0]: r[1] for r in sample.groupBy("label").count().collect()}
    least = F.create_map(*[x for k, n in sizes.items() for x in (F.lit(k), F.lit(max(1.0, LEAST_SHARE * n)))]) if sizes else F.lit(None)
    common = map_steps(sample, count, "label string, gram long, n long").groupBy("label", "gram").agg(F.sum("n").alias("n"))
    found: dict[str, list[int]] = {k: [] for k in sizes}
    if sizes:
        for r in common.where(F.col("n") >= least[F.col("label")]).collect():  # bounded: LEAST_SHARE of a bounded sample
            found[r.label].append(r.gram)
    languages = sorted(found)
    return LanguageFilters(languages, [np.array(sorted(found[k]), np.int64).view(np.uint64) for k in languages])


def predict(docs: DataFrame, filters: LanguageFilters, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: the id column, lang_pred and score."""
    shared = docs.sparkSession.sparkContext.broadcast(filters)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        lang, score = shared.value.predict(texts_of(batch))
        return pa.record_batch([batch.column(id_column), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["id", "lang_pred", "score"])

    rows = fresh(docs, id_column, text_column).withColumnRenamed(text_column, "text")
    return map_steps(rows, work, f"id {rows.schema[id_column].dataType.simpleString()}, lang_pred string, score double").withColumnRenamed("id", id_column)


def keep_recognised(docs: DataFrame, filters: LanguageFilters, least_score: float, text_column: str = "text") -> DataFrame:
    """The rows, with all their columns, whose text is recognised with at least that score."""
    shared = docs.sparkSession.sparkContext.broadcast(filters)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        at = batch.schema.get_field_index(text_column)
        lang, score = shared.value.predict(["" if t is None else t for t in batch.column(at).to_pylist()])
        return batch.filter(pa.array([k != UNKNOWN and s >= least_score for k, s in zip(lang, score)], pa.bool_()))

    return map_steps(docs, work, docs.schema, text_column)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = predict(docs, learn(docs, ~held_out()))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


QUERIES = {"op1_language_id": op1_language_id}
ORACLE_SQL: dict[str, str] = {}

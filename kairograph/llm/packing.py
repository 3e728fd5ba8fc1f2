"""Lexical retrieval packing: a sharded BM25 inverted index groups documents into training windows.

Documents are dealt to shards by the pivot document they score best with, and then by id, by range, so that documents on
like matters lie together and no key makes a shard large.  The pivots are drawn from a sample of documents of bounded
size and put in an order in which like ones are neighbours; they only decide where a document is indexed.  A shard's
documents have one index, with document frequencies over all documents; documents of other shards are not found.  The
first unused document is the seed of a window; all its terms retrieve unused neighbours by BM25, which fill the window in
order of score.  A document that does not fit is cut and its rest is the next window's seed, so windows are full.  What
is left at a shard's end is cut into sequences whose lengths are powers of two, so no sequence needs padding.

Null texts count as empty and make a piece of the end id alone.  Null ids are kept as they are.  Repeated rows are packed
each for itself.  Very long texts span windows.  An empty table gives an empty result.  Only named columns are read, so
others may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kairograph.llm.common import fresh, map_steps, stored, table, take_turn
from kairograph.llm.word_codec import OWNER, codec

WINDOW = 4096
END_ID = 2
#: Tokens put in order at a time when an index is built, and of a shard, which has one index.
INDEX_TOKENS, SHARD_TOKENS = 1_000_000, 8_000_000
K1, B = 1.2, 0.75
#: Neighbours put in order at a time; all come in turn.
AT_ONCE = 64
#: A term that more than one in so many documents have keeps its weights as a row of them all.
DENSE = 8
IDS = 1 << 16
#: Documents sampled for the pivots (about so many), and pivots.
SAMPLE, PIVOTS = 1024, 64
#: Text bytes encoded at a time.
ENCODE_BYTES = 4 << 20


def bm25(tf: np.ndarray, size, idf: np.ndarray, mean: float) -> np.ndarray:
    return (idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / mean))).astype(np.float32)


def inverse_frequency(frequency: np.ndarray, n: int, end_id: int) -> np.ndarray:
    weights = np.log1p((n - frequency + 0.5) / (frequency + 0.5)).astype(np.float32)
    weights[end_id] = 0  # the mark of the end is no term
    return weights


def pivot_weights(sampled: list[np.ndarray], end_id: int = END_ID) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(term, pivot, weight): BM25 weights of the first PIVOTS documents over the norm of each, like pivots side by side."""
    if not sampled:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)
    frequency = np.bincount(np.concatenate([np.unique(x) for x in sampled]), minlength=IDS)
    idf, mean = inverse_frequency(frequency, len(sampled), end_id), float(np.mean([len(x) for x in sampled]))
    counted = [np.unique(x, return_counts=True) for x in sampled[:PIVOTS]]
    weights = [bm25(tf, len(x), idf[terms], mean) for x, (terms, tf) in zip(sampled, counted)]
    own = np.sqrt([max(float(w.sum()), 1e-9) for w in weights])
    full = np.zeros((IDS, len(weights)), np.float32)
    for j, ((terms, _), w) in enumerate(zip(counted, weights)):
        full[terms, j] = w / own[j]
    like = np.array([full[terms].sum(axis=0) for terms, _ in counted]) / own[:, None]
    like = like + like.T + 1e-6
    scale = 1 / np.sqrt(like.sum(axis=1))
    place = np.linalg.eigh(scale[:, None] * like * scale)[1][:, -min(2, len(own))]  # the second vector puts them on a line
    full = full[:, np.argsort(place, kind="stable")]
    terms, pivots = np.nonzero(full)
    return terms, pivots, full[terms, pivots]


def pivots(rows: DataFrame, tokenizer_path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """pivot_weights() of about SAMPLE distinct texts chosen by hash; rows has id and text."""
    n = rows.count()
    grain = 1 << 40
    share = F.lit(grain if n <= SAMPLE else SAMPLE * grain // n)
    some = rows.where(F.col("text").isNotNull() & (F.pmod(F.xxhash64("id", "text"), F.lit(grain)) < share)).select("text").distinct()

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = codec(tokenizer_path).encode_all(batch.column("text"))
        return pa.record_batch([pa.array(found, pa.binary())], ["ids"])

    found = map_steps(some, work, "ids binary", owner=OWNER).orderBy(F.xxhash64("ids"), "ids").limit(2 * SAMPLE).collect()
    return pivot_weights([np.frombuffer(r.ids, "<u2") for r in found])


def tokenised(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, ids, n, near): little-endian 16-bit ids with the end id last, their number, and the pivot of most score."""
    end = np.array([end_id], "<u2").tobytes()
    rows = fresh(docs, id_column, text_column).toDF("id", "text")
    terms, columns, weights = pivots(rows, tokenizer_path)
    shared = docs.sparkSession.sparkContext.broadcast((terms, columns, weights, int(columns.max(initial=0)) + 1))
    held: list[np.ndarray] = []

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not held:
            terms, columns, weights, n = shared.value
            full = np.zeros((IDS, n), np.float32)
            full[terms, columns] = weights
            held.extend([full, full.any(axis=1)])
        full, known = held
        ids = [x + end for x in codec(tokenizer_path).encode_all(batch.column("text"))]
        terms = [np.unique(np.frombuffer(x, "<u2")) for x in ids]
        near = [int(full[t[known[t]]].sum(axis=0).argmax()) for t in terms]
        return pa.record_batch([batch.column("id"), pa.array(ids, pa.binary()), pa.array([len(x) // 2 for x in ids], pa.int64()), pa.array(near, pa.int32())], ["id", "ids", "n", "near"])

    return map_steps(rows, work, f"id {rows.schema['id'].dataType.simpleString()}, ids binary, n long, near int", owner=OWNER, size=ENCODE_BYTES)


def document_frequencies(tokens: DataFrame) -> tuple[np.ndarray, int, int]:
    """Documents of each id, documents and tokens over all rows; what is collected is bounded by the vocabulary."""

    def count(batches):
        take_turn()
        seen, rows, total = np.zeros(IDS, np.int64), 0, 0

        def add(held: list[np.ndarray]) -> None:
            owner = np.repeat(np.arange(len(held), dtype=np.uint32), [len(x) for x in held])
            pairs = np.sort(owner << np.uint32(16) | np.concatenate(held))
            first = np.r_[True, pairs[1:] != pairs[:-1]]
            seen[:] += np.bincount(pairs[first] & np.uint32(0xFFFF), minlength=IDS)

        for batch in batches:
            held, size = [], 0
            for x in batch.column("ids"):
                held.append(np.frombuffer(x.as_buffer(), "<u2"))
                size += len(held[-1])
                rows, total = rows + 1, total + len(held[-1])
                if size >= INDEX_TOKENS or len(held) == IDS:
                    add(held)
                    held, size = [], 0
            if held:
                add(held)
        at = np.flatnonzero(seen)
        yield pa.record_batch([pa.array(np.r_[at, -1, -2]), pa.array(np.r_[seen[at], rows, total])], ["term", "n"])

    found = {r.term: r.n for r in tokens.select("ids").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    frequency = np.zeros(IDS, np.int64)
    for term, n in found.items():
        if term >= 0:
            frequency[term] = n
    return frequency, found.get(-1, 0), found.get(-2, 0)


class Index:
    """BM25 over a bounded set of documents, with the weights of terms over the corpus."""

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, mean: float):
        sizes = np.array([len(d) for d in docs], np.int64)
        ends, parts, at = np.cumsum(sizes), [], 0
        while at < len(docs):
            stop = max(at + 1, int(np.searchsorted(ends, ends[at] - sizes[at] + INDEX_TOKENS, "right")))
            key = np.concatenate(docs[at:stop]).astype(np.int64) << 32 | np.repeat(np.arange(at, stop), sizes[at:stop])
            key.sort()
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            tf = np.diff(np.r_[first, len(key)]).astype(np.float32)
            key = key[first]
            doc, term = (key & 0xFFFFFFFF).astype(np.int32), (key >> 32).astype(np.uint16)
            parts.append((doc, term, bm25(tf, sizes[doc], idf[term], mean)))
            at = stop
        doc, term, weight = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(term, kind="stable")
        self.doc, self.weight = doc[order], weight[order]
        self.bounds = np.r_[0, np.cumsum(np.bincount(term, minlength=IDS))]
        self.often = DENSE * np.diff(self.bounds) > len(docs)
        self.dense = {int(t): np.zeros(len(docs), np.float32) for t in np.flatnonzero(self.often)}
        for t, row in self.dense.items():
            row[self.doc[self.bounds[t] : self.bounds[t + 1]]] = self.weight[self.bounds[t] : self.bounds[t + 1]]
        self.docs = docs

    def neighbours(self, seed: int, used: np.ndarray) -> Iterator[int]:
        """The unused documents that share a term with the seed, best first by all its terms, ties by position."""
        terms = np.unique(self.docs[seed])
        rare = terms[~self.often[terms]]
        slices = [slice(x, y) for x, y in zip(self.bounds[rare].tolist(), self.bounds[rare.astype(np.int64) + 1].tolist())]
        if slices:
            total = np.bincount(np.concatenate([self.doc[s] for s in slices]), np.concatenate([self.weight[s] for s in slices]), len(self.docs)).astype(np.float32)
        else:
            total = np.zeros(len(self.docs), np.float32)
        for t in terms[self.often[terms]].tolist():
            total += self.dense[t]
        total[used] = 0
        left = np.flatnonzero(total)
        score = total[left]
        while len(left):
            best = score >= (np.partition(score, -AT_ONCE)[-AT_ONCE] if len(left) > AT_ONCE else 0)
            yield from left[best][np.argsort(-score[best], kind="stable")].tolist()
            left, score = left[~best], score[~best]


class Packer:
    """Fills windows; pieces come out as (row, start, ids, doc_tokens, sequence, offset)."""

    def __init__(self, first: int, window: int):
        self.sequence, self.window, self.open, self.filled, self.out = first, window, [], 0, []

    def add(self, row, ids: np.ndarray) -> bool:
        """Adds a document, window after window; True if its end lies in a window begun by it."""
        start, crossed = 0, False
        while start < len(ids):
            n = min(len(ids) - start, self.window - self.filled)
            self.open.append((row, start, ids[start : start + n], len(ids)))
            start, self.filled = start + n, self.filled + n
            if self.filled == self.window:
                self.close()
                crossed = True
        return crossed

    def close(self) -> None:
        offset = 0
        for row, start, ids, total in self.open:
            self.out.append((row, start, ids, total, self.sequence, offset))
            offset += len(ids)
        self.sequence, self.open, self.filled = self.sequence + 1, [], 0

    def finish(self) -> None:
        """Cuts what is left into sequences of falling powers of two."""
        rest, left, size = self.open, self.filled, self.window
        self.open, self.filled = [], 0
        rest = rest[::-1]
        while left:
            while size > left:
                size //= 2
            room = size
            while room:
                row, start, ids, total = rest.pop()
                self.open.append((row, start, ids[:room], total))
                if len(ids) > room:
                    rest.append((row, start + room, ids[room:], total))
                room -= min(room, len(ids))
            left -= size
            self.close()


def pack_documents(packer: Packer, names: list, docs: list[np.ndarray], idf: np.ndarray, mean: float) -> None:
    index, used, at = Index(docs, idf, mean), np.zeros(len(docs), bool), 0
    seed = None
    while True:
        if seed is None:
            while at < len(docs) and used[at]:
                at += 1
            if at == len(docs):
                return
            seed = at
            used[seed] = True
            crossed = packer.add(names[seed], docs[seed])
            if packer.filled == 0:
                seed = None
                continue
        queue, seed = index.neighbours(seed, used), None
        for k in queue:
            used[k] = True
            if packer.add(names[k], docs[k]):
                seed = k if packer.filled else None
                break


def pack(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, end_id: int = END_ID, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per piece: the id column, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset."""
    if window & (window - 1):
        raise ValueError("the window must be a power of two")
    tokens = stored(tokenised(docs, tokenizer_path, end_id, id_column, text_column), "tokens")
    frequency, n, total = document_frequencies(tokens)
    idf = docs.sparkSession.sparkContext.broadcast(inverse_frequency(frequency, n, end_id))
    mean = max(total / max(n, 1), 1.0)
    shards = max(1, -(-total // SHARD_TOKENS))

    def fill(batches):
        take_turn()
        packer = Packer(TaskContext.get().partitionId() << 40, window)
        names, held = [], []

        def ready():
            out, packer.out = packer.out, []
            for k in range(0, len(out), 2000):
                part = out[k : k + 2000]
                cols = list(zip(*part))
                yield pa.record_batch(
                    [
                        pa.array(cols[0], batch_type),
                        pa.array(cols[1], pa.int64()),
                        pa.array([len(x) for x in cols[2]], pa.int64()),
                        pa.array([x.astype("<u4").tobytes() for x in cols[2]], pa.binary()),
                        *[pa.array(c, pa.int64()) for c in cols[3:]],
                    ],
                    ["id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
                )

        batch_type = None
        for batch in batches:
            batch_type = batch.schema.field("id").type
            for name, ids in zip(batch.column("id").to_pylist(), batch.column("ids").to_pylist()):
                names.append(name)
                held.append(np.frombuffer(ids, "<u2"))
        if held:
            pack_documents(packer, names, held, idf.value, mean)
        packer.finish()
        if packer.out:
            yield from ready()

    kind = tokens.schema["id"].dataType.simpleString()
    dealt = tokens.select("id", "ids", "near").repartitionByRange(shards, "near", "id", F.crc32("ids")).sortWithinPartitions("near", "id", F.crc32("ids"))
    pieces = dealt.mapInArrow(fill, f"id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
    return pieces.withColumnRenamed("id", id_column)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    pieces = pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


QUERIES = {"op10_packing": op10_packing}
ORACLE_SQL: dict[str, str] = {}

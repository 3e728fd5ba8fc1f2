"""Alignment of two tokenizers by the bytes that their tokens cover.

The tokens of both are nodes; tokens that share a byte are joined by union-find, whose components are the smallest groups
of tokens that cover the same bytes.  Each token of A in a group is linked with each of B there.  How many documents hold an
id pair linked is counted over the cluster, and each document then gets its links' counts back.

A task turns its texts into chunks of some CHUNK_BYTES: a row for each document, with its distinct id pairs and how often
each is linked, and a row for the chunk with its distinct pairs and their number of documents.  Only the chunks' rows are
counted over the cluster; a frequent pair has at most one row a chunk.  The counts go back to the chunks that asked for them.
What is broadcast is the highest count of each A id, so no more rows than that vocabulary has.

Null and empty texts have no tokens, nor have texts whose tokens do not spell the space and the text: all zero, no digest.
Repeated rows and ids are answered row by row, and each row counts as a document.  Ties for an id's highest count all count.
Very long texts need memory in proportion to themselves and their distinct linked pairs (8 bytes each, in one row of 2 GB).
Only the named columns are read.  An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kairograph.llm.common import fresh, steps, stored, table, take_turn, texts_of
from kairograph.llm.components import local_labels

#: Bytes of text of a chunk; a longer single text is a chunk of its own.
CHUNK_BYTES = 16 << 20
#: Groups of more links are counted by their distinct ids.
WIDE_LINKS = 1 << 12
SPACE = "▁"


@dataclass(frozen=True)
class Tokenizers:
    """Files: byte-level ranks with their split pattern (A), and a piece model that puts a space before a text (B)."""

    ranks_path: str
    pattern: str
    pieces_path: str


class Aligner:
    def __init__(self, files: Tokenizers):
        import sentencepiece
        import tiktoken

        with open(files.ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.a = tiktoken.Encoding("a", pat_str=files.pattern, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=files.pieces_path)
        self.a_bytes = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.a_bytes[i] = token
        self.b_bytes = [self._piece(i) for i in range(self.b.get_piece_size())]
        if max(len(self.a_bytes), len(self.b_bytes)) > 1 << 16:
            raise ValueError("ids must fit 16 bits")
        self.a_size, self.b_size = (np.array([len(t) for t in own], np.int64) for own in (self.a_bytes, self.b_bytes))
        #: Decimal ids with what may follow them: `,` or `|` for A, then `,` or `;` for B.
        self.words = [b"%d%s" % (i, mark) for n, marks in ((len(self.a_bytes), (b",", b"|")), (len(self.b_bytes), (b",", b";"))) for i in range(n) for mark in marks]

    def _piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace(SPACE, " ").encode()

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """The ids of A and B of each text; none where either does not spell the space and the text."""
        none = np.zeros(0, np.int64)
        all_a, all_b = [none] * len(texts), [none] * len(texts)
        for i, (text, b) in enumerate(zip(texts, self.b.encode(texts, num_threads=1))):
            if not text:
                continue
            a = self.a.encode_ordinary(" " + text)
            whole = b" " + text.encode()
            if b"".join(map(self.a_bytes.__getitem__, a)) == whole and b"".join(map(self.b_bytes.__getitem__, b)) == whole:
                all_a[i], all_b[i] = np.array(a, np.int64), np.array(b, np.int64)
        return all_a, all_b

    def align(self, texts: list[str]) -> Aligned:
        all_a, all_b = self.encode(texts)
        n_a, n_b = np.array([len(x) for x in all_a]), np.array([len(x) for x in all_b])
        a, b = np.concatenate(all_a), np.concatenate(all_b)  # one row of texts at least
        group_a, group_b = groups(np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b]))
        return Aligned(n_a, n_b, a, b, group_a, group_b)


def groups(end_a: np.ndarray, end_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The group of each token of A and of B, numbered in order; ends: where each token ends in the same bytes.

    Tokens are nodes (A's first), tokens that share a byte are linked, and components are found by union-find."""
    if not len(end_a):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    begin_a, begin_b = np.concatenate([[0], end_a[:-1]]), np.concatenate([[0], end_b[:-1]])
    first = np.searchsorted(end_b, begin_a, "right")
    n = np.searchsorted(begin_b, end_a, "left") - first
    links_a = np.repeat(np.arange(len(end_a)), n)
    links_b = np.arange(len(links_a)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
    label = local_labels(len(end_a) + len(end_b), links_a, len(end_a) + links_b)
    opens = label[: len(end_a)] == np.arange(len(end_a))  # a component's smallest node is its first token of A
    number = np.cumsum(opens) - 1
    return number[label[: len(end_a)]], number[label[len(end_a) :]]


class Aligned:
    """Aligned texts: n_a and n_b of each, the ids of all texts one after another, and the group of each token."""

    def __init__(self, n_a, n_b, a, b, group_a, group_b):
        self.n_a, self.n_b, self.a, self.b, self.group_a, self.group_b = n_a, n_b, a, b, group_a, group_b
        self.texts = len(n_a)
        owner = np.repeat(np.arange(self.texts), n_a)
        count = int(group_a[-1]) + 1 if len(group_a) else 0
        self.p, self.q = np.bincount(group_a, minlength=count), np.bincount(group_b, minlength=count)
        self.begin_a, self.begin_b = np.cumsum(self.p) - self.p, np.cumsum(self.q) - self.q
        self.owner = owner[self.begin_a]  # of each group
        self.n_groups = np.bincount(self.owner, minlength=self.texts)
        self.n_links = np.zeros(self.texts, np.int64)
        np.add.at(self.n_links, self.owner, self.p * self.q)

    def digests(self, words: list[bytes], vocabulary_a: int) -> list[str]:
        """The SHA-256 of each text's groups; words: see Aligner."""
        n = len(self.a) + len(self.b)
        picked = np.zeros(n, np.int64)
        last_a = np.arange(len(self.a)) == (self.begin_a + self.p - 1)[self.group_a]
        last_b = np.arange(len(self.b)) == (self.begin_b + self.q - 1)[self.group_b]
        picked[np.arange(len(self.a)) + self.begin_b[self.group_a]] = 2 * self.a + last_a
        picked[np.arange(len(self.b)) + (self.begin_a + self.p)[self.group_b]] = 2 * vocabulary_a + 2 * self.b + last_b
        said = list(map(words.__getitem__, picked.tolist()))
        cuts = np.concatenate([[0], np.cumsum(self.n_a + self.n_b)]).tolist()
        return [hashlib.sha256(b"".join(said[x:y])[:-1]).hexdigest() if y > x else "" for x, y in zip(cuts, cuts[1:])]

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, pair, times): the distinct id pairs of each text, a pair as A's id in the upper 16 bits and B's below."""
        small = self.p * self.q <= WIDE_LINKS
        take = small[self.group_a]
        group, a = self.group_a[take], self.a[take]
        n = self.q[group]
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.begin_b[group], n)
        keys = [np.repeat(self.owner[group] << 32 | a << 16, n) | self.b[at]]
        times = [np.ones(len(keys[0]), np.int64)]
        for g in np.flatnonzero(~small).tolist():
            ids_a, n_a = np.unique(self.a[self.begin_a[g] : self.begin_a[g] + self.p[g]], return_counts=True)
            ids_b, n_b = np.unique(self.b[self.begin_b[g] : self.begin_b[g] + self.q[g]], return_counts=True)
            keys.append(((self.owner[g] << 32) | (ids_a[:, None] << 16) | ids_b[None, :]).ravel())
            times.append((n_a[:, None] * n_b[None, :]).ravel())
        key, counts = (np.concatenate(x) for x in (keys, times))
        order = np.argsort(key, kind="stable")
        key, counts = key[order], counts[order]
        opens = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        return key[opens] >> 32, key[opens] & 0xFFFFFFFF, np.add.reduceat(counts, opens) if len(key) else counts


@functools.lru_cache(2)
def aligner(files: Tokenizers) -> Aligner:
    return Aligner(files)


NUMBERS = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
PACKED = "chunk long, pairs binary, times binary"


def _packed(values: np.ndarray, cuts: np.ndarray, kind: str) -> list[bytes]:
    data = values.astype(kind).tobytes()
    width = np.dtype(kind).itemsize
    return [data[width * x : width * y] for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist())]


def aligned(docs: DataFrame, files: Tokenizers, id_column: str = "doc_id", text_column: str = "text", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Per document: id, its numbers, its chunk, and its distinct linked id pairs (pairs) with their times, as arrays of
    unsigned 32-bit pairs and unsigned 64-bit times.  Per chunk a row without numbers: its distinct pairs, and in how many of
    its documents each is linked."""
    rows = fresh(docs, id_column, text_column).toDF("id", "text")
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches):
        take_turn()
        own = aligner(files)
        task, number, size = TaskContext.get().partitionId(), 0, 0
        held: list[tuple[np.ndarray, np.ndarray]] = []
        names = ["id", *(x.split()[0] for x in f"{NUMBERS}, {PACKED}".split(", "))]
        id_type = None

        def chunk_row():
            nonlocal held, number, size
            pairs, n = _merged(held)
            cut = np.array([0, len(pairs)])
            out = [pa.nulls(1, id_type), *[pa.nulls(1, pa.int64())] * 4, pa.nulls(1, pa.string()), pa.array([task << 24 | number]), pa.array(_packed(pairs, cut, "<u4"), pa.binary()), pa.array(_packed(n, cut, "<u8"), pa.binary())]
            held, number, size = [], number + 1, 0
            return pa.record_batch(out, names)

        for part in steps(batches, "text"):
            id_type = part.column("id").type
            texts = texts_of(part)
            found = own.align(texts)
            owner, pairs, times = found.pairs()
            cuts = np.searchsorted(owner, np.arange(len(texts) + 1))
            numbers = [found.n_a, found.n_b, found.n_groups, found.n_links]
            yield pa.record_batch(
                [
                    part.column("id"),
                    *[pa.array(x.astype(np.int64)) for x in numbers],
                    pa.array(found.digests(own.words, len(own.a_bytes)), pa.string()),
                    pa.array([task << 24 | number] * len(texts)),
                    pa.array(_packed(pairs, cuts, "<u4"), pa.binary()),
                    pa.array(_packed(times, cuts, "<u8"), pa.binary()),
                ],
                names,
            )
            held.append(np.unique(pairs, return_counts=True))
            if sum(len(p) for p, _ in held[1:]) > len(held[0][0]):
                held = [_merged(held)]
            size += sum(map(len, texts))
            if size >= chunk_bytes:
                yield chunk_row()
        if held:
            yield chunk_row()

    return rows.mapInArrow(run, f"id {kind}, {NUMBERS}, {PACKED}")


def _merged(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Counts of pairs, summed."""
    pairs, where = np.unique(np.concatenate([p for p, _ in held]), return_inverse=True)
    return pairs, np.bincount(where, weights=np.concatenate([n for _, n in held]), minlength=len(pairs)).astype(np.int64)


def unpacked(rows: DataFrame) -> DataFrame:
    """(chunk, pair, n) of the chunks' rows."""

    def run(batches):
        for batch in batches:
            for chunk, pairs, n in zip(*(batch.column(c).to_pylist() for c in ("chunk", "pairs", "times"))):
                keys = np.frombuffer(pairs, "<u4").astype(np.int64)
                yield pa.record_batch([pa.array(np.full(len(keys), chunk)), pa.array(keys), pa.array(np.frombuffer(n, "<u8").astype(np.int64))], ["chunk", "pair", "n"])

    return rows.select("chunk", "pairs", "times").mapInArrow(run, "chunk long, pair long, n long")


def counted(parts: DataFrame) -> DataFrame:
    """(chunk, pair, n) with n over all chunks: a pair has at most a row a chunk, and stays where it was shuffled to."""
    return parts.withColumn("n", F.sum("n").over(Window.partitionBy("pair")))


def pair_counts(counts: DataFrame) -> DataFrame:
    """(a, b, n): how many documents hold each id pair linked."""
    return counts.groupBy("pair").agg(F.max("n").alias("n")).select(F.shiftright("pair", 16).alias("a"), F.col("pair").bitwiseAND(0xFFFF).alias("b"), "n")


def with_counts(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """The documents' id and numbers with n_best and count_sum.  counts: see counted()."""
    a = F.shiftright("pair", 16)
    most = counts.groupBy(a.alias("a")).agg(F.max("n").alias("most"))  # bounded by A's vocabulary
    asked = counts.withColumn("a", a).join(F.broadcast(most), "a").select("chunk", "pair", "n", (F.col("n") == F.col("most")).alias("best"))
    docs = rows.where("groups_sha256 is not null")
    kind = rows.schema["id"].dataType.simpleString()

    def run(mine: pa.Table, known: pa.Table) -> pa.Table:
        numbers = mine.select(["id", *(x.split()[0] for x in NUMBERS.split(", "))])
        pairs, times = (_joined(mine.column(c), kind) for c, kind in (("pairs", "<u4"), ("times", "<u8")))
        order = np.argsort(known.column("pair").to_numpy())
        keys, n, best = (known.column(c).to_numpy()[order] for c in ("pair", "n", "best"))
        at = np.searchsorted(keys, pairs) if len(pairs) else np.zeros(0, np.int64)
        sizes = np.array([len(x) // 4 for x in mine.column("pairs").to_pylist()], np.int64)
        cuts = np.concatenate([[0], np.cumsum(sizes)])
        for name, value in (("n_best", best[at] * times), ("count_sum", n[at] * times)):
            running = np.concatenate([[0], np.cumsum(value.astype(np.int64))])
            numbers = numbers.append_column(name, pa.array(running[cuts[1:]] - running[cuts[:-1]]))
        return numbers

    return docs.groupBy("chunk").cogroup(asked.groupBy("chunk")).applyInArrow(run, f"id {kind}, {NUMBERS}, n_best long, count_sum long")


def _joined(column: pa.ChunkedArray, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).astype(np.int64)


def op11_cross_tokenizer(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    files = Tokenizers(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, public_tokenizers.path("piece_bpe_32k.model"))
    rows = stored(aligned(table(spark, sf_dir, "documents"), files), "aligned")
    counts = stored(counted(unpacked(rows.where("groups_sha256 is null"))), "pairs")
    found = with_counts(rows, counts).withColumnRenamed("id", "doc_id")
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


QUERIES = {"op11_cross_tokenizer": op11_cross_tokenizer}
ORACLE_SQL: dict[str, str] = {}

"""Token counts of flat, unindexed token files by a separator scan.

A flat file is a sequence of little-endian 16-bit ids in which each document ends with the separator id; there is no
index.  Files are read in byte ranges of Spark's choice, so a file may be of any size.  Spark's reader cuts each range at
the two bytes of the separator wherever they stand; only those at an even offset of the file are separators, and a range
does not know its own offset.  So the cuts of a range are searched with vectorised comparisons for either parity, and an
exclusive prefix scan over the parts of a file's ranges (bytes, separators and last separator before each) fixes the
parity, the number and the start of the first document that ends in each part, and is joined to the parts; nothing of it
passes through the driver.  Documents that run across parts or ranges are stitched so.

Null texts count as empty: one token, the separator.  Tokens after a file's last separator are a document without an end,
reported with ended = false.  Repeated rows are counted each for itself.  Of the input only the named columns are read.
An empty table or folder gives an empty result.  A document may be as long as one row of Spark may be (2 GB).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kairograph.llm.common import fresh, scratch_path, shared_dir, steps, table, take_turn, texts_of
from kairograph.llm.sentencepiece_codec import OWNER, codec

#: The writer's folders: tokens, and the id of each document by its place in the token file of the same number.
TOKENS, IDS = "kind=tokens", "kind=ids"
PART = r"part-(\d+)"


def _mark(separator: int) -> str:
    """The separator's bytes as characters of ISO-8859-1."""
    low, high = separator.to_bytes(2, "little")
    if low == high:
        raise ValueError("a separator of two equal bytes cannot be told from its neighbours' bytes")
    return chr(low) + chr(high)


def write_flat(docs: DataFrame, model_path: str, path: str, id_column: str = "doc_id", text_column: str = "text") -> None:
    """Writes the texts' ids, each document closed by the model's end id, as one flat file of each task, and beside it
    the documents' ids as lines `ordinal:hexadecimal id`, both from the same pass over the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_turn(OWNER)
        own, n = codec(model_path), 0
        for part in steps(batches):
            flat = [np.array(own.encode(t)[0].split()[:-1], "<u2").tobytes() for t in texts_of(part)]
            names = [b"%d" % (n + i) if x is None else b"%d:%s" % (n + i, x.encode().hex().encode()) for i, x in enumerate(part.column("id").to_pylist())]
            order = pa.array([*range(n, n + len(flat))] * 2, pa.int64())
            kinds = pa.array(["tokens"] * len(flat) + ["ids"] * len(flat))
            yield pa.record_batch([kinds, order, pa.array(flat + names, pa.binary())], ["kind", "ordinal", "value"])
            n += len(flat)

    rows = fresh(docs, id_column, text_column).toDF("id", "text").select(F.col("id").cast("string"), "text")
    both = rows.mapInArrow(run, "kind string, ordinal long, value binary").sortWithinPartitions("kind", "ordinal")
    # a text writer puts its bytes and line separators one after another as they are; the separator id closes each row
    writer = both.select("kind", F.col("value").cast("string").alias("value")).write.partitionBy("kind").option("maxRecordsPerFile", 0)
    writer.option("encoding", "ISO-8859-1").option("lineSep", _mark(codec(model_path).end_id)).text(path)


def cuts(sizes: np.ndarray, offset: int) -> tuple[np.ndarray, int]:
    """Of pieces cut at the separator's bytes: the ends (relative, separator included) that are at an even place if the
    range starts at offset, and the range's bytes.  Each piece's bytes are followed by the separator's two."""
    ends = np.cumsum(sizes + 2)
    return ends[(ends + offset) % 2 == 0], int(ends[-1]) if len(ends) else 0


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple[str, int, int], np.ndarray]]:
    """(file, begin, size of the file) and the sizes of the pieces of each range that a batch holds a part of."""
    names, begins = batch.column("file").dictionary_encode(), batch.column("begin").to_numpy()
    which, whole, sizes = names.indices.to_numpy(), batch.column("bytes").to_numpy(), batch.column("size").to_numpy()
    first = np.flatnonzero(np.r_[True, (begins[1:] != begins[:-1]) | (which[1:] != which[:-1])]) if len(begins) else begins
    for at, stop in zip(first, [*first[1:], len(begins)]):
        yield (names.dictionary[int(which[at])].as_py(), int(begins[at]), int(whole[at])), sizes[at:stop]


def _pieces(spark: SparkSession, path: str, separator: int) -> DataFrame:
    """(file, begin, bytes, size): the pieces between the separator's bytes in file order within each range."""
    lines = spark.read.option("encoding", "ISO-8859-1").option("lineSep", _mark(separator)).option("pathGlobFilter", "part-*").text(path)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("begin"), F.col("_metadata.file_size").alias("bytes"), F.octet_length("value").cast("long").alias("size"))


def count_tokens(spark: SparkSession, path: str, separator: int) -> DataFrame:
    """Per document of the files under path: file, ordinal, start, n_tokens (separator included), ended.

    Files are read once.  What is kept of each part of a range (a batch of pieces at most) are its pieces' sizes, in a
    checkpoint, so that the scan's places are those of the same ranges however the result is read later."""

    def measure(batches):
        take_turn()
        key, k = None, 0
        for batch in batches:
            rows = []
            for found, sizes in _runs(batch):
                key, k = found, k + 1 if found == key else 0
                row = [*found, k, sizes.astype("<u4").tobytes()]
                for parity in (0, 1):
                    ends, total = cuts(sizes, parity)
                    row += [len(ends), int(ends[-1]) if len(ends) else None]
                rows.append([*row, total])
            kinds = (pa.string(), *[pa.int64()] * 3, pa.binary(), *[pa.int64()] * 5)
            yield pa.record_batch([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], ["file", "begin", "bytes", "k", "sizes", "n0", "last0", "n1", "last1", "total"])

    measured = _pieces(spark, path, separator).mapInArrow(measure, "file string, begin long, bytes long, k long, sizes binary, n0 long, last0 long, n1 long, last1 long, total long")
    shared_dir(spark)  # the folder of checkpoints is set
    parts = measured.checkpoint()
    before = Window.partitionBy("file").orderBy("begin", "k").rowsBetween(Window.unboundedPreceding, -1)
    placed = parts.drop("sizes", "bytes").withColumn("offset", F.coalesce(F.sum("total").over(before), F.lit(0)))
    odd = F.col("offset") % 2 == 1
    placed = placed.withColumn("n", F.when(odd, F.col("n1")).otherwise(F.col("n0"))).withColumn("last", F.col("offset") + F.when(odd, F.col("last1")).otherwise(F.col("last0")))
    placed = placed.select("file", "begin", "k", "offset", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ordinal"), F.coalesce(F.max("last").over(before), F.lit(0)).alias("open"))

    def answer(batches):
        take_turn()
        for batch in batches:
            for r in batch.to_pylist():
                whole, offset, opened = r["bytes"], r["offset"], r["open"]
                ends, total = cuts(np.frombuffer(r["sizes"], "<u4").astype(np.int64), offset)
                ends = ends + offset
                ended = np.ones(len(ends), bool)
                if offset + total == whole + 2:  # the file's last piece has no separator
                    if len(ends) and ends[-1] == whole + 2:
                        ends, ended = ends[:-1], ended[:-1]
                    if max(opened, int(ends[-1]) if len(ends) else 0) < whole:
                        ends, ended = np.r_[ends, whole], np.r_[ended, False]
                if len(ends):
                    starts = np.r_[opened, ends[:-1]]
                    columns = [pa.array([r["file"]] * len(ends), pa.string()), pa.array(np.arange(len(ends)) + r["ordinal"]), pa.array(starts // 2), pa.array((ends - starts) // 2), pa.array(ended)]
                    yield pa.record_batch(columns, ["file", "ordinal", "start", "n_tokens", "ended"])

    found = parts.select("file", "begin", "k", "bytes", "sizes").join(placed, ["file", "begin", "k"])
    return found.mapInArrow(answer, "file string, ordinal long, start long, n_tokens long, ended boolean")


def written_ids(spark: SparkSession, path: str, separator: int, kind: str) -> DataFrame:
    """(part, ordinal, id) of the documents that write_flat() wrote."""
    lines = spark.read.option("encoding", "ISO-8859-1").option("lineSep", _mark(separator)).text(f"{path}/{IDS}")
    cut = F.split("value", ":")
    named = F.unhex(F.get(cut, F.lit(1))).cast("string").cast(kind)
    return lines.select(F.regexp_extract("_metadata.file_path", PART, 1).cast("int").alias("part"), cut[0].cast("long").alias("ordinal"), named.alias("id"))


def count_documents(docs: DataFrame, model_path: str, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Writes the documents as flat token files and counts them again from the bytes.  Per document: the id column,
    part (the number of its file), ordinal, start, n_tokens, ended."""
    spark, separator = docs.sparkSession, codec(model_path).end_id
    write_flat(docs, model_path, path, id_column, text_column)
    kind = docs.schema[id_column].dataType.simpleString()
    schema = f"{TOKENS} {IDS}".split()
    if not all(_exists(spark, f"{path}/{k}") for k in schema):
        return spark.createDataFrame([], f"id {kind}, part int, ordinal long, start long, n_tokens long, ended boolean").withColumnRenamed("id", id_column)
    found = count_tokens(spark, f"{path}/{TOKENS}", separator).withColumn("part", F.regexp_extract("file", PART, 1).cast("int"))
    named = written_ids(spark, path, separator, kind)
    return found.join(named, ["part", "ordinal"]).select(F.col("id").alias(id_column), "part", "ordinal", "start", "n_tokens", "ended")


def _exists(spark: SparkSession, path: str) -> bool:
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()).exists(found)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    return count_documents(docs, public_tokenizers.path("piece_bpe_32k.model"), scratch_path(spark, "flat-tokens"))


QUERIES = {"op9_token_counts": op9_token_counts}
ORACLE_SQL: dict[str, str] = {}

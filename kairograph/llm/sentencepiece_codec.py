"""SentencePiece encoding and decoding, exact, by backtracking.

The model's pieces hold the space mark only as a leading run and never a line end (both are checked when a model is
loaded), so no merge crosses the start of such a run or a line end and a text falls into independent chunks.  Each
chunk is encoded by BacktrackingBPE and remembered in a memo of bounded size; characters outside the vocabulary become
their byte pieces.  Models with an identity normaliser and a dummy prefix are supported.

Null texts count as empty: no piece, only the end id.  Repeated rows, ties and extra columns: each row is answered for
itself from its text alone, and only the columns named are read.  Very long texts need memory in proportion to
themselves only.  An empty table gives an empty result.
"""

from __future__ import annotations

import functools
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kairograph.llm.backtracking_bpe import BacktrackingBPE
from kairograph.llm.common import TwoGenerations, fresh, hold, map_steps, table, texts_of

SPACE = "▁"
OWNER = "pieces"
CHUNK = re.compile(f"{SPACE}+[^{SPACE}\n]*|\n[^{SPACE}\n]*")


class PieceCodec:
    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.end_id = model.eos_id()
        n = model.get_piece_size()
        plain = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.pieces = {model.id_to_piece(i): i for i in plain}
        if any(SPACE in p.lstrip(SPACE) or "\n" in p for p in self.pieces):
            raise ValueError("a piece spans a space or a line end; chunks would not be independent")
        self.byte_ids = {int(model.id_to_piece(i)[3:5], 16): i for i in range(n) if model.is_byte(i)}
        self.text_of = {i: p.replace(SPACE, " ").encode() for p, i in self.pieces.items()} | {i: bytes([b]) for b, i in self.byte_ids.items()}
        strings, rank = {i: p for p, i in self.pieces.items()}, {i: -model.get_score(i) for i in plain}

        def merged(a: int, b: int):
            new = self.pieces.get(strings[a] + strings[b])
            return None if new is None else (rank[new], new)

        self.bpe = BacktrackingBPE(self.pieces, merged)
        known = "".join(re.escape(p) for p in self.pieces if len(p) == 1)
        self.runs = re.compile(f"[{known}]+|[^{known}]")
        self.memo = TwoGenerations(self._chunk)

    def chunk_ids(self, chunk: str) -> list[int]:
        ids: list[int] = []
        for run in self.runs.findall(chunk):
            if run[0] in self.pieces:
                ids += self.bpe.encode(run)
            else:
                ids += [self.byte_ids[b] for b in run.encode()]
        return ids

    def decode(self, ids: list[int]) -> str:
        """The library's decode: byte pieces joined as UTF-8, the dummy prefix dropped, control ids silent."""
        text = b"".join(self.text_of.get(i, b"") for i in ids).decode("utf-8", "replace")
        return text[1:] if ids and self.text_of.get(ids[0], b"").startswith(b" ") else text

    def _chunk(self, key: str) -> tuple[bytes, bytes]:
        """Decimal ids and decoded text of a chunk; a key not starting with a line end lacks its first space mark."""
        ids = self.chunk_ids(key if key[:1] == "\n" else SPACE + key)
        return " ".join(map(str, ids)).encode(), b"".join(map(self.text_of.__getitem__, ids))

    @staticmethod
    def keys(text: str) -> list[str]:
        if not text:
            return []
        if text[0] != " " and "  " not in text and " \n" not in text and SPACE not in text:
            return text.replace("\n", " \n").split(" ")
        chunks = CHUNK.findall(SPACE + text.replace(" ", SPACE))
        return [c if c[0] == "\n" else c[1:] for c in chunks]

    def encode(self, text: str) -> tuple[bytes, bytes]:
        """Decimal ids joined by one space, the end id last, and the text that they decode to."""
        parts = list(map(self.memo.__getitem__, self.keys(text)))
        ids = b" ".join([p[0] for p in parts] + [b"%d" % self.end_id])
        return ids, b"".join([p[1] for p in parts])[1:]


@functools.lru_cache(2)
def _codec(path: str) -> PieceCodec:
    return PieceCodec(path)


def codec(path: str) -> PieceCodec:
    """The codec of a file; in a worker its memo lasts until another operator takes its turn."""
    own = _codec(path)
    hold(OWNER, own.memo.release)
    return own


def encode_and_decode(docs: DataFrame, model_path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: the id column, ids (decimal ids joined by one space, end id last), n_tokens and decoded text."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = codec(model_path)
        found = [own.encode(t) for t in texts_of(batch)]
        return pa.record_batch(
            [
                batch.column(id_column),
                pa.array([f[0] for f in found], pa.binary()).cast(pa.string()),
                pa.array([f[0].count(b" ") + 1 for f in found], pa.int64()),
                pa.array([f[1] for f in found], pa.binary()).cast(pa.string()),
            ],
            ["id", "ids", "n_tokens", "decoded"],
        )

    rows = fresh(docs, id_column, text_column).withColumnRenamed(text_column, "text")
    kind = rows.schema[id_column].dataType.simpleString()
    return map_steps(rows, work, f"id {kind}, ids string, n_tokens long, decoded string", owner=OWNER).withColumnRenamed("id", id_column)


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    found = encode_and_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return found.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES = {"op5_sentencepiece": op5_sentencepiece}
ORACLE_SQL: dict[str, str] = {}

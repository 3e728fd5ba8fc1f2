"""Alignment against the libraries' own offsets, boundary by boundary, and the query against plain counting."""

import bisect
import hashlib
import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")

from kairograph.llm import cross_tokenizer as CT  # noqa: E402

SF = "/root/testdata/sf0.01"
FILES = CT.Tokenizers(P.path("byte_bpe_50k.tiktoken"), P.PATTERN, P.path("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def library():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    marks = {chr(x): x for x in shown} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in shown)}
    entry = lambda i: bytes(marks[c] for c in a.id_to_token(i))

    def piece(i):
        own = b.id_to_piece(i)
        return bytes([int(own[3:5], 16)]) if b.is_byte(i) else own.replace("▁", " ").encode()

    return a, b, entry, piece


def groups(text, library):
    """[(A ids, B ids)] of a text, by the offsets where tokens of both end."""
    a, b, entry, piece = library
    ids = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    spelled = [[entry(i) for i in ids[0]], [piece(i) for i in ids[1]]]
    if not text or any(b"".join(s) != (" " + text).encode() for s in spelled):
        return []
    ends = [np.cumsum([len(x) for x in s]).tolist() for s in spelled]
    both = sorted(set(ends[0]) & set(ends[1]))
    out = [([], []) for _ in both]
    for side in (0, 1):
        for i, end in zip(ids[side], ends[side]):
            out[bisect.bisect_left(both, end)][side].append(i)
    return out


def plain(rows, library):
    """(doc_id, numbers ...) of each row."""
    each = [groups(t or "", library) for _, t in rows]
    count = Counter()
    for found in each:
        count.update({(x, y) for xs, ys in found for x in xs for y in ys})
    most = defaultdict(int)
    for (x, _), n in count.items():
        most[x] = max(most[x], n)
    out = []
    for (doc_id, _), found in zip(rows, each):
        links = [(x, y) for xs, ys in found for x in xs for y in ys]
        said = ";".join(",".join(map(str, xs)) + "|" + ",".join(map(str, ys)) for xs, ys in found)
        out.append(
            (doc_id, sum(len(x) for x, _ in found), sum(len(y) for _, y in found), len(found), len(links), sum(count[k] == most[k[0]] for k in links), sum(count[k] for k in links), hashlib.sha256(said.encode()).hexdigest() if found else "")
        )
    return sorted(out, key=str)


def test_ids_are_the_library_s(library):
    """All characters, one by one and in runs."""
    own, (a, _, entry, piece) = CT.Aligner(FILES), library
    rng = random.Random(1)
    chars = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(chars[i : i + 97]) for i in range(0, len(chars), 97)]
    texts += ["".join(rng.choice("aZ é1 '\n\t<|endoftext|>▁ß中😀-_s") for _ in range(rng.randint(1, 60))) for _ in range(3000)]
    for text, found in zip(texts, a.encode_batch([" " + t for t in texts], add_special_tokens=False)):
        assert own.a.encode_ordinary(" " + text) == found.ids, text
    assert [own.a_bytes[i] for i in range(50256)] == [entry(i) for i in range(50256)]
    assert own.b_bytes == [piece(i) for i in range(32000)]


def test_components_are_the_smallest_groups():
    rng = np.random.default_rng(2)
    for _ in range(300):
        n = int(rng.integers(1, 40))
        end_a, end_b = (np.unique(np.append(rng.integers(1, n + 1, rng.integers(0, 30)), n)) for _ in range(2))
        both = np.intersect1d(end_a, end_b)
        found = CT.groups(end_a, end_b)
        assert found[0].tolist() == np.searchsorted(both, end_a).tolist()
        assert found[1].tolist() == np.searchsorted(both, end_b).tolist()


def test_wide_groups(monkeypatch):
    own = CT.Aligner(FILES)
    texts = ["Some words, and wörds 中文 here! " * 9, "", "a", "ééé ééé"]
    want = [x.tolist() for x in own.align(texts).pairs()]
    monkeypatch.setattr(CT, "WIDE_LINKS", 0)
    assert [x.tolist() for x in own.align(texts).pairs()] == want


def answered(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_query(spark, library):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    assert answered(CT.op11_cross_tokenizer(spark, SF)) == plain(rows, library)


DDL = "doc_id long, text string, chunk int, ID string"


def test_odd_texts(spark, library, tmp_path):
    texts = [None, "", " ", "\n", "▁ mark", "<|endoftext|> <s></s> <0x41>", "😀😀é", "ﷺ中文 text", "\x00a­", "word " * 30_000, "=" * 5000, "ab" * 3000, "same text", "same text"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "no id"), (0, "an id again"), (0, "an id again")]
    spark.createDataFrame([(*r, 1, "x") for r in rows], DDL).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    want = plain(rows, library)
    assert answered(CT.op11_cross_tokenizer(spark, str(tmp_path))) == want
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    parts = CT.aligned(docs, FILES, chunk_bytes=1).cache()
    few = CT.with_counts(parts, CT.counted(CT.unpacked(parts.where("groups_sha256 is null"))))
    assert answered(few.select("id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")) == want
    pairs = {(r.a, r.b): r.n for r in CT.pair_counts(CT.counted(CT.unpacked(parts.where("groups_sha256 is null")))).collect()}
    own = Counter(k for _, t in rows for k in {(x, y) for xs, ys in groups(t or "", library) for x in xs for y in ys})
    assert pairs == own


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], DDL).write.parquet(f"{tmp_path}/documents.parquet")
    assert CT.op11_cross_tokenizer(spark, str(tmp_path)).collect() == []

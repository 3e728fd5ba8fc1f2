"""The operators on small tables with nulls, empty and repeated rows, and on an empty table."""

import hashlib

import pytest
from pyspark.sql import functions as F

P = pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from kairograph.llm import content_chunks, language_id, packing, quality_rules, secret_scan, sentencepiece_codec, sharding, simhash_dedup, suffix_dedup, token_counts  # noqa: E402

WORDS = [f"word{i}x{i * 7919 % 101}" for i in range(400)]
PASSAGE = " ".join(WORDS[100:180])
TEXTS = [
    " ".join(WORDS[:90]), " ".join(WORDS[:90]), " ".join(WORDS[:89]) + " other", "front matter here " + PASSAGE + " first tail of it", "another start " + PASSAGE + " second end", None, "", "!!! 123", "short text",
    "key: token = 24be64439e3e49cf46b2d7c90f3602a3 end", " ".join(WORDS[200:380]),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i % 2 else "fr", "src0", None if t is None else len(t), "extra") for i, t in enumerate(TEXTS)] + [(None, "null id text here", None, None, 5, "extra"), (10, TEXTS[10], "fr", "src0", 9, "extra")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, fingerprint string")


@pytest.fixture(scope="module")
def empty(spark, docs):
    return spark.createDataFrame([], docs.schema)


def brute_removed(texts, length):
    seen: dict = {}
    for t in texts:
        for i in range(len(t) - length + 1):
            seen[t[i : i + length]] = seen.get(t[i : i + length], 0) + 1
    out = []
    for t in texts:
        mask = [False] * len(t)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                mask[i : i + length] = [True] * length
        out.append(mask)
    return out


@pytest.mark.parametrize("wide", [1000, 0])
def test_suffix_dedup(docs, empty, wide, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "WIDE", wide)
    rows = [r.text or "" for r in docs.orderBy("doc_id").collect()]
    texts = [t.encode() for t in rows]
    want = sorted((len(t), sum(m), hashlib.sha256(bytes(b for b, x in zip(t, m) if not x)).hexdigest()) for t, m in zip(texts, brute_removed(texts, 400)))
    got = sorted((r.n_bytes, r.n_removed, r.kept_sha256) for r in suffix_dedup.dedup(docs).collect())
    assert got == want and any(n for _, n, _ in want)
    for r in suffix_dedup.dedup(docs).join(docs.select("doc_id", F.col("text").alias("was")).distinct(), "doc_id").collect():
        was = (r.was or "").encode()
        assert r.text == b"".join(suffix_dedup.kept_parts(was, [(s.lo, s.hi) for s in r.spans])).decode("utf-8", "ignore")
    if wide:
        assert suffix_dedup.dedup(empty).count() == 0
        assert suffix_dedup.without_repeats(docs).columns == docs.columns


def test_near_duplicates(docs, empty):
    found = {r.doc_id: (r.fp, r.component_id) for r in simhash_dedup.near_duplicates(docs).collect()}
    for i, (fp, component) in found.items():
        reach, grown = {fp}, True
        while grown:
            more = {f for f, _ in found.values() if any(((f ^ g) & (1 << 64) - 1).bit_count() <= 2 for g in reach)}
            grown = bool(more - reach)
            reach |= more
        assert component == min((k for k, (f, _) in found.items() if f in reach and k is not None), default=None)
    kept = simhash_dedup.keep_one(docs)
    assert kept.columns == docs.columns and kept.where("doc_id = 10").count() == 1 and kept.where("doc_id = 1").count() == 0
    assert simhash_dedup.near_duplicates(empty).count() == simhash_dedup.keep_one(empty).count() == 0


def test_language_id(docs, empty):
    filters = language_id.learn(docs, ~language_id.held_out())
    found = {r.doc_id: (r.lang_pred, r.score) for r in language_id.predict(docs, filters).collect()}
    assert found[5] == found[6] == found[7] == ("und", 0.0)
    assert all(0 <= s <= 1 for _, s in found.values()) and len(found) == 12
    kept = language_id.keep_recognised(docs, filters, 0.0)
    assert kept.columns == docs.columns and kept.count() == docs.count() - 3
    assert language_id.predict(empty, language_id.learn(empty, F.lit(True))).count() == 0


def test_quality_rules(docs, empty):
    found = {r.doc_id: r for r in quality_rules.judge(docs).collect()}
    assert found[5].n_words == 0 and found[5].base_failed and not found[5].kept
    assert found[0].n_words == 90 and found[0].n_repeat_words == 0 and found[0].kept
    assert quality_rules.judge(empty).count() == 0


def test_repeated_windows_and_lines(spark):
    text = "a b c d a b c x\nsame line\nsame line\n \n \n#$"
    row = quality_rules.judge(spark.createDataFrame([(1, "h", text)], "doc_id long, source string, text string")).first()
    assert (row.n_words, row.n_dup_lines, row.n_symbols, row.n_repeat_words) == (13, 1, 2, 6)


def test_frequent_lines_go(spark):
    shared = "this line stands in every text of the host and is long enough to matter here"
    rows = [(i, "h", f"{shared}\nown {''.join(chr(97 + int(c)) for c in str(i))}") for i in range(40)] + [(99, "h", " ".join(WORDS[:60]))]
    frame = spark.createDataFrame(rows, "doc_id long, source string, text string")
    assert quality_rules.frequent_lines(quality_rules.lines_of(frame.toDF("id", "host", "text"))).count() == 1
    kept = {r.doc_id: r.kept for r in quality_rules.judge(frame).collect()}
    assert kept[99] and not kept[0]


def test_tokens_chunks_secrets_shards(docs, empty, spark, tmp_path):
    import sentencepiece

    model = P.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=model)
    for r in sentencepiece_codec.encode_and_decode(docs, model).join(docs.select("doc_id", "text"), "doc_id").collect():
        assert [int(x) for x in r.ids.split()] == library.encode(r.text or "", add_eos=True)
    whole = sorted((r.doc_id if r.doc_id is not None else -1, len(library.encode(r.text or "", add_eos=True))) for r in docs.collect())
    for k, conf in enumerate(({}, {"spark.sql.files.maxRecordsPerFile": "3"}, {"spark.sql.files.maxPartitionBytes": "37", "spark.sql.files.openCostInBytes": "1"})):
        for name, value in conf.items():
            spark.conf.set(name, value)
        counted = token_counts.count_documents(docs, model, f"file://{tmp_path}/flat{k}").collect()
        for name in conf:
            spark.conf.unset(name)
        assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_tokens) for r in counted) == whole and all(r.ended for r in counted)
    assert token_counts.count_documents(empty, model, f"file://{tmp_path}/flat-empty").count() == 0
    near = content_chunks.compare_with_next(docs).collect()
    assert len(near) == docs.count() and all(0 <= r.near_next <= 1 for r in near)
    by_id = {r.doc_id: r for r in near}
    assert by_id[0].fingerprint == by_id[1].fingerprint and by_id[0].near_next == 1.0
    half = len(TEXTS[3]) // 2
    assert by_id[3].edited_sha256 == hashlib.sha256((TEXTS[3][: len(TEXTS[3]) - half] + TEXTS[4][:half]).encode()).hexdigest()
    spans = {r.doc_id: r.spans for r in secret_scan.scan(docs).collect()}
    assert [s.kind for s in spans[9]] == ["assign", "hex"] and spans[5] == []
    assert "24be" not in secret_scan.mask(docs).where("doc_id = 9").first().text
    placed = sharding.place(docs, "doc_id").collect()
    table = sharding.lookup_table(sharding.SHARDS)
    assert len(placed) == docs.count() and all(sharding.SHARDS[table[r.slot]] == r.shard for r in placed)
    for f in (lambda e: sentencepiece_codec.encode_and_decode(e, model), content_chunks.compare_with_next, secret_scan.scan, lambda e: sharding.place(e, "doc_id"), lambda e: packing.pack(e, P.path("word_bpe_49k.json"))):
        assert f(empty).count() == 0


def test_separators_across_ranges(spark, tmp_path):
    """Flat files read in ranges of a few bytes, so that documents and separators lie across ranges."""
    import numpy as np

    rng = np.random.default_rng(8)
    want = []
    for k, n in enumerate((0, 1, 400, 999)):
        ids = rng.choice(np.array([2, 2, 5, 512, 514, 0x0200, 0x0202, 0x0002, 7], "<u2"), n)
        (tmp_path / f"part-{k:05d}").write_bytes(ids.tobytes())
        begun = 0
        for i, x in enumerate(ids.tolist()):
            if x == 2:
                want.append((k, begun, i + 1 - begun, True))
                begun = i + 1
        if begun < n:
            want.append((k, begun, n - begun, False))
    for size in ("1m", "64", "7", "2"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        found = token_counts.count_tokens(spark, f"file://{tmp_path}", 2).collect()
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
        assert sorted((int(r.file[-5:]), r.start, r.n_tokens, r.ended) for r in found) == sorted(want)
        for k in (2, 3):
            assert sorted(r.ordinal for r in found if int(r.file[-5:]) == k) == list(range(sum(w[0] == k for w in want)))


def test_counts_read_under_other_settings(spark, tmp_path):
    """A result that is read after the size of ranges has changed, and from batches of few pieces, is the same."""
    ids = [5, 2, 2, 7, 512, 2, 9, 9] * 50
    (tmp_path / "part-00000").write_bytes(b"".join(x.to_bytes(2, "little") for x in ids))
    want, begun = [], 0
    for i, x in enumerate(ids):
        if x == 2:
            want.append((len(want), begun, i + 1 - begun, True))
            begun = i + 1
    want.append((len(want), begun, len(ids) - begun, False))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    found = token_counts.count_tokens(spark, f"file://{tmp_path}", 2)
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted((r.ordinal, r.start, r.n_tokens, r.ended) for r in found.collect()) == want


def test_packing_covers_every_id_once(docs):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    pieces = packing.pack(docs, path, window=64).collect()
    assert sum(r.length for r in pieces) == sum(len(library.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in docs.collect())
    lengths: dict = {}
    for r in sorted(pieces, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == lengths.get(r.sequence_id, 0)
        lengths[r.sequence_id] = r.offset + r.length
    assert all(n & (n - 1) == 0 and n <= 64 for n in lengths.values())


def test_pipeline_stages(docs, spark, tmp_path):
    docs.drop("fingerprint").write.parquet(f"{tmp_path}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "simhash_dedup", "suffix_dedup", "secret_scan", "packing"]
    frame = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        frame = stage(spark, frame, str(tmp_path))
        assert frame.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert corpus_pipeline.run(spark, str(tmp_path)).where("length < 1").count() == 0


def test_pipeline_drops_near_copies_by_similarity(spark, monkeypatch):
    import random

    from kairograph.llm import near_copies

    rnd = random.Random(11)
    texts = []
    for _ in range(12):
        base = [f"w{rnd.randrange(5000)}" for _ in range(rnd.choice([60, 200, 400]))]
        texts.append(base)
        for changes in (0, 1, 2, 4, 6, 9, 14):
            copy = list(base)
            for at in rnd.sample(range(len(copy)), changes):
                copy[at] = f"other{rnd.randrange(5000)}"
            texts.append(copy)
    texts = [" ".join(t) for t in texts] + [None, "", "two words"]
    sets = [set(zip(*[(t or "").split()[k:] for k in range(5)])) or {(t or "")} for t in texts]
    first = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                first = [first[j] if x == first[i] else x for x in first] if first[j] < first[i] else [first[i] if x == first[j] else x for x in first]
    frame = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    want = {i for i, x in enumerate(first) if i == x}
    assert len(want) < len(texts) - 12
    for part in (512, 3):
        monkeypatch.setattr(near_copies, "PART", part)
        assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, frame, "").collect()} == want
    assert corpus_pipeline.near_duplicates(spark, frame.limit(0), "").count() == 0


def test_packing_finds_neighbours_in_the_whole_shard(spark):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)

    def words(ids, n):
        found = [w.removesuffix("</w>") for w in map(library.id_to_token, ids) if w.endswith("</w>")]
        return [w for w in found if w.isascii() and w.isalpha() and len(library.encode(w, add_special_tokens=False).ids) == 1][:n]

    shared, filler, last = words(range(5000, 9000), 20), words(range(12000, 20000), 200), words(range(40000, 49000), 1)
    rows = [(i, " " + " ".join(filler * 20)) for i in range(300)] + [(1000, " " + " ".join(shared)), (1001, " " + " ".join(shared + last))]
    pieces = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), path).collect()
    assert sum(r.length for r in pieces) > packing.INDEX_TOKENS and sum(r.length for r in pieces) < packing.SHARD_TOKENS
    ordered = [r.doc_id for r in sorted(pieces, key=lambda r: (r.sequence_id, r.offset))]
    places = [i for i, d in enumerate(ordered) if d >= 1000]
    assert places == list(range(places[0], places[-1] + 1))  # side by side, whatever lies around them


def test_clean_removes_frequent_lines(spark):
    shared = "all rights reserved 2020"
    letters = lambda i: "".join(chr(97 + int(c)) for c in str(i))
    texts = [f"own {letters(i)}\n{shared}{i}\n\n  other {letters(i)}{letters(i)} {'word ' * 20}\n{shared}" for i in range(40)] + [f"{shared}\nx", None, "alone\n\n"]
    rows = [(i, "h", t, "keep") for i, t in enumerate(texts)]
    frame = spark.createDataFrame([*rows, rows[0], (0, "elsewhere", texts[0], "keep")], "doc_id long, source string, text string, removed string")
    found = quality_rules.clean(frame).collect()
    assert len(found) == len(rows) + 2 and {r.removed for r in found} == {"keep"}
    for r in found:
        lines = (texts[r.doc_id] or "").split("\n")
        gone = [line for line in lines if line.startswith("all rights")] if r.source == "h" else []
        assert r.text == (None if texts[r.doc_id] is None else "\n".join(line for line in lines if line not in gone))
        assert r.removed_chars == sum(map(len, gone))
        assert r.depleted == (r.doc_id == 40)
    judged = [(r.doc_id, r.removed_chars) for r in quality_rules.judge(frame).collect()]
    assert sorted(judged) == sorted((r.doc_id, r.removed_chars) for r in found)


def test_removed_lines_and_the_text_that_is_left(spark):
    """A line that many documents of a host share goes from the result; one of few stays, and so does all else."""
    name = lambda i: "".join(chr(97 + int(c)) for c in str(i))  # noqa: E731  (digits count as white space)
    own = lambda i: "\n".join([f"first words number {name(i)} of this text", "Read  MORE here 12", "", f"last {name(i)} words"])
    rows = [(i, "hot", own(i)) for i in range(40)] + [(100 + i, "cold", own(i)) for i in range(4)]
    found = {r.doc_id: r for r in quality_rules.judge(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()}
    assert found[7].n_removed_lines == 1 and found[7].removed_chars == len("Read  MORE here 12")
    assert found[7].cleaned == "first words number h of this text\n\nlast h words"
    assert found[101].n_removed_lines == 0 and found[101].cleaned == own(1)

"""Operators against definitions written out plainly, and measured recall."""

import hashlib
import math
import random
import re

import numpy as np
import pytest
import xxhash

P = pytest.importorskip("public_tokenizers")

from kairograph.llm import content_chunks, language_id, near_copies, packing, secret_scan, word_codec  # noqa: E402

DATA = "/root/testdata/sf0.01"


def base_spans(text):
    """The contract's three patterns, one by one."""
    found = []
    kinds = (
        ("assign", r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
        ("access", r"(AKIA[A-Z0-9]+)", 1, 18),
        ("hex", r"([0-9a-f]+)", 1, 16),
    )
    for kind, pattern, group, least in kinds:
        found += [(kind, m.start(), m.end()) for m in re.finditer(pattern, text) if len(m[group]) >= least]
    return sorted(found, key=lambda s: (s[1], [k[0] for k in kinds].index(s[0])))


def test_base_patterns_of_secrets():
    rnd = random.Random(31)
    parts = ["token", "Token", "API_KEY", "apikey", "passwd", "secret", "password", " ", "  ", "=", ":", '"', "'", "AKIA", "abcdef0123456789", "0123456789abcdef01", "ABCDEFGHIJ123456", "Zz9", "_", ".", "-", "/", "é", "\n", "AKIAKIA"]
    for _ in range(4000):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randint(1, 14)))
        assert [s for s in secret_scan.spans(text) if s[0] != "random"] == base_spans(text), text


def test_battery_by_definition():
    rnd = random.Random(4)
    for size, n in ((16, 40), (62, 64), (64, 200)):
        values = [rnd.randrange(size) for _ in range(n)]
        counts = [values.count(v) for v in range(size)]
        want = sum((c - n / size) ** 2 / (n / size) for c in counts)
        chi, p = secret_scan.battery(values, size)
        assert math.isclose(chi, want, rel_tol=1e-9) and p >= secret_scan.RANDOM_LEVEL
    up_and_down = [0, 61] * 40  # even, but it changes side each time
    climbing = sorted(rnd.randrange(62) for _ in range(80))  # even, but neighbours are alike
    few = [5] * 60 + [rnd.randrange(62) for _ in range(4)]  # uneven
    for values in (up_and_down, climbing, few):
        assert secret_scan.battery(values, 62)[1] < secret_scan.RANDOM_LEVEL


def test_recall_of_planted_keys_and_false_alarms():
    """Keys of letters and digits among words; words, paths, dates and numbers alone."""
    rnd = random.Random(77)
    word = lambda: "".join(rnd.choice("aeioubcdlmnrst") for _ in range(rnd.randint(2, 9)))
    found, clean = {}, 0
    for n, least in ((20, 0.8), (24, 0.9), (32, 0.97), (48, 0.97), (64, 0.97)):
        hits = 0
        for _ in range(200):
            key = "".join(rnd.choice(secret_scan.ALPHABETS[5]) for _ in range(n))
            text = " ".join([word() for _ in range(40)] + [key] + [word() for _ in range(40)])
            hits += any(text[a:b] == key for k, a, b in secret_scan.spans(text))
        found[n] = hits / 200
        assert found[n] >= least, found
    for _ in range(400):
        odd = [f"{word()}_{word()}_{rnd.randint(1900, 2030)}_{word()}", f"path/{word()}/{word()}{rnd.randint(1, 99)}/{word()}-{word()}", f"{rnd.randint(10**20, 10**21)}", f"{word()}{word()}{word()}{word()}20"]
        clean += any(k == "random" for k, _, _ in secret_scan.spans(" ".join([word() for _ in range(60)] + odd)))
    print("recall of planted keys by length", found, "texts with a false alarm", clean, "of 400")
    assert clean <= 8, clean


def plain_chunks(text: bytes) -> dict:
    """The normalised gear chunks of one text, byte by byte."""
    out, start = {}, 0
    while start < len(text):
        end = None
        for at in range(start + 1, len(text) + 1):
            n = at - start
            h = sum(int(content_chunks.GEAR[text[at - 1 - k]]) << k for k in range(min(at, 32))) & 0xFFFFFFFF
            mask = int(content_chunks.STRICT) if n <= content_chunks.NORMAL else int(content_chunks.LOOSE)
            if n >= content_chunks.LEAST and h & mask == 0 and (n <= content_chunks.NORMAL or n > content_chunks.NORMAL) or n == content_chunks.GREATEST:
                end = at
                break
        end = end or len(text)
        out[xxhash.xxh64_hexdigest(text[start:end])] = end - start
        start = end
    return out


def test_chunk_boundaries_by_definition():
    rnd = random.Random(12)
    for n in (0, 1, 31, 32, 33, 200, 3000):
        text = bytes(rnd.choice(b"abcdefgh \n") for _ in range(n))
        assert content_chunks.chunk_sets([text])[0] == plain_chunks(text)
    a, b = content_chunks.chunk_sets([b"x" * 700 + b"abc" * 300, b"abc" * 300])
    assert content_chunks.containment(a, b) == sum(n for d, n in a.items() if d in b) / sum(a.values())


def test_language_filters_against_plain_sets():
    """Shares of n-grams by sets instead of filters: the filters' corrected shares are close and decide alike."""
    import pyarrow.parquet as pq

    rows = pq.read_table(f"{DATA}/documents.parquet", columns=["doc_id", "text", "lang"]).to_pylist()
    languages = sorted({r["lang"] for r in rows if r["lang"]})
    held: dict = {k: {} for k in languages}
    sizes = dict.fromkeys(languages, 0)
    for r in rows[:600]:
        if r["lang"] and r["text"]:
            sizes[r["lang"]] += 1
            for g in set(language_id.grams([r["text"]])[0].tolist()):
                held[r["lang"]][g] = held[r["lang"]].get(g, 0) + 1
    common = {k: {g for g, n in held[k].items() if n >= max(1.0, language_id.LEAST_SHARE * sizes[k])} for k in languages}
    filters = language_id.LanguageFilters(languages, [np.array(sorted(common[k]), np.uint64) for k in languages])
    texts = [r["text"] for r in rows[600:] if r["text"] and any(map(str.isalpha, r["text"]))]
    lang, score = filters.predict(texts)
    same = 0
    for t, found, s in zip(texts, lang, score):
        g = language_id.grams([t])[0].tolist()
        share = {k: sum(x in common[k] for x in g) / len(g) for k in languages}
        best = max(share.values())
        same += share[found] == best
        assert abs(s - share[found]) < 0.05
    assert same >= 0.98 * len(texts)


def test_near_copies_forest_finds_what_all_pairs_find():
    rnd = random.Random(2)
    base = [[rnd.randrange(1 << 60) for _ in range(rnd.choice([20, 80, 300]))] for _ in range(40)]
    sets = []
    for b in base:
        for drop in (0.0, 0.05, 0.1, 0.3):
            sets.append(np.unique(np.array([x if rnd.random() >= drop / 2 else rnd.randrange(1 << 60) for x in b], np.uint64)))

    def components(pairs):
        label = list(range(len(sets)))
        for i, j in pairs:
            a, b = label[i], label[j]
            label = [a if x == b else x for x in label]
        return {frozenset(i for i, x in enumerate(label) if x == k) for k in set(label)}

    every = [(i, j) for i in range(len(sets)) for j in range(i) if near_copies.similarity(sets[i], sets[j]) >= 0.8]
    found = near_copies.forest(sets, 0.8)
    assert components(found) == components(every) and len(found) < len(every)


def test_neighbour_recall_of_shards():
    """Of the ten best neighbours over all documents of sf0.01, how many lie in the seed's shard if there are eight; a deal by
    chance gives 0.125.  README says what this means."""
    import pyarrow.parquet as pq

    text = pq.read_table(f"{DATA}/documents.parquet", columns=["text"]).column("text").combine_chunks()
    docs = [np.frombuffer(x + b"\x02\x00", "<u2") for x in word_codec.codec(P.path("word_bpe_49k.json")).encode_all(text)]
    total = sum(map(len, docs))
    terms, columns, weights = packing.pivot_weights([d[:-1] for d in {d.tobytes(): d for d in docs}.values()])
    full = np.zeros((packing.IDS, columns.max() + 1), np.float32)
    full[terms, columns] = weights
    near = np.array([full[np.unique(d)].sum(axis=0).argmax() for d in docs])
    shards = 8
    rank = np.empty(len(docs), int)
    rank[np.lexsort((np.arange(len(docs)), near))] = np.arange(len(docs)) * shards // len(docs)
    frequency = np.bincount(np.concatenate([np.unique(d) for d in docs]), minlength=packing.IDS)
    index = packing.Index(docs, packing.inverse_frequency(frequency, len(docs), packing.END_ID), total / len(docs))
    share = []
    for seed in range(0, len(docs), 20):
        used = np.zeros(len(docs), bool)
        used[seed] = True
        best = [k for _, k in zip(range(10), index.neighbours(seed, used))]
        share += [rank[k] == rank[seed] for k in best]
    print("share of the ten best neighbours in the seed's shard of eight", np.mean(share))
    assert np.mean(share) >= 0.3


def test_packed_ids_are_the_library_s(spark):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    texts = ["One two, three!", None, "", "a" * 9000, "日本 mixed <|endoftext|> text", "word " * 300]
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)]
    pieces = packing.pack(spark.createDataFrame(rows, "doc_id long, text string, near string, n int"), path, window=64).collect()
    for i, t in enumerate(texts):
        own = sorted((r.start, r.ids, r.doc_tokens) for r in pieces if r.doc_id == i)
        ids = np.frombuffer(b"".join(x for _, x, _ in own), "<u4").tolist()
        assert ids == [*library.encode(t or "", add_special_tokens=False).ids, 2] and {n for *_, n in own} == {len(ids)}


def test_shards_keep_whole_rows_under_any_name(spark, tmp_path):
    from kairograph.llm import sharding

    rows = [(f"k{i % 5}" if i % 3 else None, i, f"text {i}", "there") for i in range(60)]
    frame = spark.createDataFrame(rows, "slot string, shard int, text string, `a.b` string")
    table = sharding.lookup_table(sharding.SHARDS)
    want = lambda k: int(hashlib.md5((k or "").encode()).hexdigest()[:15], 16) % sharding.SLOTS
    for r in sharding.place(frame, "slot").collect():
        assert r["slot_"] == want(r["slot"]) and r["shard"] == sharding.SHARDS[table[want(r["slot"])]]
    laid = sharding.write_shards(frame, "slot", f"file://{tmp_path}/shards")
    assert laid.columns == ["slot", "shard", "text", "a.b", "slot_", "shard_"]
    got = laid.collect()
    assert sorted((r["slot"] or "", r["shard"], r["text"], r["a.b"]) for r in got) == sorted((k or "", i, t, x) for k, i, t, x in rows)
    assert all(r["shard_"] == sharding.SHARDS[table[want(r["slot"])]] for r in got)
    assert sharding.write_shards(frame.limit(0), "slot", f"file://{tmp_path}/none").count() == 0


def test_ids_that_are_no_integers_are_refused(spark):
    with pytest.raises(TypeError):
        content_chunks.compare_with_next(spark.createDataFrame([("a", "t")], "doc_id string, text string"))

"""Exact ids of a word-end BPE vocabulary file (lower case, white space dropped) with a memo over words.

White space never reaches the merges, so words are encoded one by one and remembered.  Words of plain Latin letters,
digits and ASCII marks are cut as the file's split pattern says and go straight to the merges of the tokenizers library;
any other word, and any text that may hold a special token's string, goes through the library whole.
"""

from __future__ import annotations

import functools
import json
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from kairograph.llm.common import TwoGenerations, hold

OWNER = "words"
#: Words of each generation of the memo; about 150 bytes each.
MEMO_WORDS = 500_000
#: Stands for the vocabulary's word end in strings here.
END = ""
LETTER = "a-zÀ-ÖØ-öø-įı-ɏ"
SAFE = re.compile(f"[!-~{LETTER}]+")
#: The file's split pattern for words of SAFE in lower case.
PARTS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTER}]+|[0-9]|[^{LETTER}0-9]+")


def byte_marks() -> dict[int, str]:
    """The character of each byte in byte-level vocabularies: itself where it prints, else the next from 256 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(prints)]
    return {b: chr(b) for b in prints} | {b: chr(256 + i) for i, b in enumerate(rest)}


def _bytes_of(words: pa.Array) -> list[bytes]:
    """The strings of an array without nulls as UTF-8 bytes."""
    _, ends, flat = words.buffers()
    cuts = np.frombuffer(ends, np.int32)[words.offset : words.offset + len(words) + 1].tolist()
    data = flat.to_pybytes() if flat else b""
    return [data[a:b] for a, b in zip(cuts, cuts[1:])]


class WordCodec:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        if max(model["model"]["vocab"].values()) > 0xFFFF:
            raise ValueError("ids must fit 16 bits")
        self.specials = tuple({t["content"][:2].encode() for t in model["added_tokens"]})
        self.merges = self.library.model.tokenize
        self.marks = byte_marks()
        self.pairs = [i.to_bytes(2, "little") for i in range(1 << 16)]
        self.single = TwoGenerations(self._part, 1000)
        self.memo = TwoGenerations(self._word, MEMO_WORDS)

    def release(self) -> None:
        self.memo.release()

    def _part(self, part: str) -> bytes:
        mapped = part if part.isascii() else part.encode().decode("latin-1").translate(self.marks)
        return b"".join([self.pairs[t.id] for t in self.merges(mapped)])

    def _word(self, word: bytes) -> bytes:
        """word: ASCII letters in lower case."""
        text = word.decode()
        if word.isalpha():
            return self._part(text)
        if text.isascii() and text.isprintable():
            parts = PARTS.findall(text)
        elif SAFE.fullmatch(low := text.lower()):
            parts = PARTS.findall(low)
        else:
            return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u2").tobytes()
        return b"".join([self.single[p] if len(p) == 1 else self._part(p) for p in parts])

    def _words(self, words: list[bytes]) -> list[bytes]:
        """The ids of distinct words."""
        out = list(map(self.memo.get, words))
        for i, known in enumerate(out):
            if known is None:
                out[i] = self.memo[words[i]]
        return out

    def encode(self, text: bytes) -> bytes:
        """The ids as little-endian unsigned 16-bit numbers."""
        for mark in self.specials:
            if mark in text:
                return np.array(self.library.encode(text.decode(), add_special_tokens=False).ids, "<u2").tobytes()
        return b"".join(map(self.memo.__getitem__, text.lower().split()))


    def encode_all(self, texts: pa.Array) -> list[bytes]:
        """encode() of each text (nulls as empty), each distinct word looked up once."""
        texts = texts.cast(pa.string()).fill_null("")
        words = pc.ascii_split_whitespace(pc.ascii_lower(texts))
        found = words.flatten().dictionary_encode()
        ids = pa.array(self._words(_bytes_of(found.dictionary)), pa.large_binary()).take(found.indices)
        flat, ends = ids.buffers()[2], np.frombuffer(ids.buffers()[1], np.int64)[: len(ids) + 1]
        data = memoryview(flat) if flat else memoryview(b"")
        cuts = ends[words.offsets.to_numpy()].tolist()
        out = [bytes(data[a:b]) for a, b in zip(cuts, cuts[1:])]
        special = functools.reduce(pc.or_, [pc.match_substring(texts, mark.decode()) for mark in self.specials], pa.array([False] * len(texts)))
        for i in np.flatnonzero(special.to_numpy(zero_copy_only=False)).tolist():
            out[i] = self.encode(texts[i].as_py().encode())
        return out


@functools.lru_cache(2)
def _codec(path: str) -> WordCodec:
    return WordCodec(path)


def codec(path: str) -> WordCodec:
    """The codec of a file; in a worker its memos last until another operator takes its turn."""
    own = _codec(path)
    hold(OWNER, own.release)
    return own

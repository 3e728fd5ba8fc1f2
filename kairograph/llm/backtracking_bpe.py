"""Exact byte-pair encoding by backtracking over longest matches.

A token sequence is the one that merging gives if and only if each token re-encodes to itself and each pair of
neighbours is compatible: merging their joined text again gives the same two tokens.  So the encoder takes the longest
token at a position (found for all positions in one Aho-Corasick pass), falls back to the next shorter token that is
a prefix of it when the pair is incompatible, and steps back when nothing fits.  A bitfield holds the positions from
which no rest was found, so that no position is tried in vain twice and the work is linear in the text.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable

import ahocorasick

#: Pairs of tokens whose compatibility is remembered; beyond it the memo starts afresh.
PAIR_MEMO = 2_000_000


class BacktrackingBPE:
    """tokens: string of each id that merging can make.  merged(a, b): (rank, id) of the merge of two neighbours or None.

    end: a mark that, at the end of a string, belongs to the symbol before it.
    """

    def __init__(self, tokens: dict[str, int], merged: Callable[[int, int], tuple[float, int] | None], end: str = ""):
        self.ids, self.merged, self.end = tokens, merged, end
        self.strings = {i: s for s, i in tokens.items()}
        own = {s: i for s, i in tokens.items() if self.merge(s) == [i]}
        self.length = {i: len(s) for s, i in own.items()}
        self.shorter: dict[int, int] = {}
        self.automaton = ahocorasick.Automaton()
        for s, i in own.items():
            self.automaton.add_word(s, (i, len(s) - 1))
            for n in range(len(s) - 1, 0, -1):
                if s[:n] in own:
                    self.shorter[i] = own[s[:n]]
                    break
        self.automaton.make_automaton()
        self.pairs: dict[int, bool] = {}

    def symbols(self, text: str) -> list[int] | None:
        """The ids of the single symbols, None if one is unknown."""
        parts = list(text)
        if self.end and len(parts) > 1 and parts[-1] == self.end:
            parts[-2:] = [parts[-2] + self.end]
        found = [self.ids.get(p) for p in parts]
        return None if None in found else found

    def merge(self, text: str) -> list[int] | None:
        """The encoding by its definition: the merge of lowest rank first, the leftmost of equals."""
        ids = self.symbols(text)
        if ids is None:
            return None
        after, before, alive = [*range(1, len(ids)), -1], [-1, *range(len(ids) - 1)], [True] * len(ids)
        queue: list = []

        def offer(i: int) -> None:
            if i >= 0 and after[i] >= 0 and (m := self.merged(ids[i], ids[after[i]])):
                heapq.heappush(queue, (m[0], i, ids[i], ids[after[i]], m[1]))

        for i in range(len(ids) - 1):
            offer(i)
        while queue:
            _, i, a, b, new = heapq.heappop(queue)
            j = after[i]
            if not alive[i] or ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], alive[j], after[i] = new, False, after[j]
            if after[i] >= 0:
                before[after[i]] = i
            offer(before[i])
            offer(i)
        return [t for t, a in zip(ids, alive) if a]

    def compatible(self, a: int, b: int) -> bool:
        """Whether the joined text of two tokens merges into the same two tokens again."""
        if len(self.pairs) >= PAIR_MEMO:
            self.pairs.clear()
        known = self.pairs[a << 32 | b] = self.merge(self.strings[a] + self.strings[b]) == [a, b]
        return known

    def encode(self, text: str) -> list[int]:
        """The ids of a text whose symbols are all known."""
        longest = self.automaton_longest(text)
        shorter, length, known = self.shorter, self.length, self.pairs.get
        out: list[int] = []
        position, size, last = 0, len(text), -1
        failed: bytearray | None = None  # a bit for each position, made at the first failure
        token = longest[0]
        while position < size:
            while token >= 0:
                end = position + length[token]
                if failed is None or not failed[end >> 3] >> (end & 7) & 1:
                    if last < 0:
                        break
                    fits = known(last << 32 | token)
                    if fits or fits is None and self.compatible(last, token):
                        break
                token = shorter.get(token, -1)
            if token >= 0:
                out.append(token)
                last, position = token, end
                token = longest[position]
            else:
                if not out:
                    raise ValueError("a text has symbols that no token covers")
                if failed is None:
                    failed = bytearray((size >> 3) + 1)
                failed[position >> 3] |= 1 << (position & 7)
                token = out.pop()
                position -= length[token]
                last = out[-1] if out else -1
        return out

    def automaton_longest(self, text: str) -> list[int]:
        """The longest token that starts at each position, -1 where none does; one more entry for the end."""
        longest = [-1] * (len(text) + 1)
        for end, (token, behind) in self.automaton.iter(text):
            longest[end - behind] = token  # ends come in ascending order, so the longest stays
        return longest

"""Burrows-Wheeler transforms of sets of strings: building, merging and repeated intervals.

A shard is the transform of its strings with ordered terminators.  Two shards are merged by refining the interleave of
their rows: rows start in blocks of equal first symbols; a round looks up, for the rows of each block that still mixes
both shards, the block of the suffix DEPTH symbols on, which splits the block, so the depth grows by doubling.  Blocks of
one shard's rows alone are settled and skipped.  The order within a shard is never sorted again.  A block that still
mixes both shards at the depth asked for is an interval of rows with that common prefix.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Symbols of the first key, 9 bits each.
FIRST = 7


@dataclass
class Shard:
    """bwt: symbol before each row's suffix, bytes plus one, 0 before a string's start.  starts: the string of each row
    whose symbol is 0, in row order.  repeated: rows whose prefix of the depth asked for occurs in another place too."""

    bwt: np.ndarray
    starts: np.ndarray
    repeated: np.ndarray

    def inverted(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(place of each row, row of each place, terminator's place for each place, string of each place); places are
        those of the strings one after another, each followed by its terminator."""
        n, strings = len(self.bwt), len(self.starts)
        after = np.argsort(self.bwt, kind="stable").astype(np.int32)  # row of the suffix that is one symbol shorter
        row = np.empty(strings, np.int32)
        row[self.starts] = np.flatnonzero(self.bwt == 0)
        walked, alive = [], np.arange(strings, dtype=np.int32)
        place_of_step = []
        step = 0
        sizes = np.zeros(strings, np.int64)
        while len(alive):
            walked.append((alive, row))
            sizes[alive] += 1
            going = row >= strings
            alive, row = alive[going], after[row[going]]
            step += 1
        begin = np.r_[0, np.cumsum(sizes)[:-1]]
        row_at = np.empty(n, np.int32)
        for k, (who, rows) in enumerate(walked):
            row_at[begin[who] + k] = rows
        place = np.empty(n, np.int32)
        place[row_at] = np.arange(n, dtype=np.int32)
        owner = np.repeat(np.arange(strings, dtype=np.int32), sizes)
        return place, row_at, (begin + sizes - 1).astype(np.int32)[owner], owner


def _first_keys(text: np.ndarray) -> np.ndarray:
    """The first symbols of each place as a number, zeros after a terminator; terminators are negative, in order."""
    n = len(text)
    key, open_ = np.zeros(n, np.int64), np.ones(n, bool)
    for k in range(FIRST):
        symbol = np.zeros(n, np.int64)
        symbol[: max(0, n - k)] = text[k:]
        key = key << 9 | np.where(open_, symbol, 0)
        open_ &= symbol > 0
    ends = np.flatnonzero(text == 0)
    key[ends] = np.arange(len(ends)) - len(ends)
    return key


def _depths(depth: int, longest: int) -> list[tuple[int, int]]:
    """(offset, depth reached) of the rounds: doubling to the depth asked for, then on until terminators tell all apart.

    A first key does not tell terminators apart, so suffixes are apart for sure when the offsets add up to their length.
    """
    out, at = [], FIRST
    while at < depth:
        step = min(at, depth - at)
        at += step
        out.append((step, at))
    while sum(step for step, _ in out) < longest:
        out.append((at, 2 * at))
        at *= 2
    return out


def build(strings: list[bytes], weights: np.ndarray, depth: int) -> Shard:
    """The transform of one shard, its suffixes sorted by prefix doubling; weights: in how many places a string is."""
    sizes = np.array([len(s) + 1 for s in strings], np.int64)
    text = (np.frombuffer(b"\0".join([*strings, b""]), np.uint8)).astype(np.uint16) + 1
    ends = np.cumsum(sizes) - 1
    text[ends] = 0
    n = len(text)
    owner = np.repeat(np.arange(len(strings), dtype=np.int32), sizes)
    last = ends[owner]
    key = _first_keys(text)
    order = np.argsort(key)
    ranked = key[order]
    begins = np.r_[True, ranked[1:] != ranked[:-1]]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(begins, np.arange(n), 0))
    repeated_place = weights[owner] > 1
    del key, ranked
    alone = begins & np.r_[begins[1:], True]
    slots = np.flatnonzero(~alone)
    if depth == FIRST and len(slots):
        at = order[slots]
        first = np.flatnonzero(begins[slots])
        repeated_place[at] |= np.repeat(np.add.reduceat(weights[owner[at]], first), np.diff(np.r_[first, len(at)])) > 1
    for step, reached in _depths(depth, int(sizes.max())):
        if not len(slots):
            break
        at = order[slots]
        both = rank[at] * n + rank[np.minimum(at + step, last[at])]
        sort = np.argsort(both)
        at, both = at[sort], both[sort]
        order[slots] = at
        begins = np.r_[True, both[1:] != both[:-1]]
        first = np.flatnonzero(begins)
        rank[at] = slots[np.maximum.accumulate(np.where(begins, np.arange(len(at)), 0))]
        alone = begins & np.r_[begins[1:], True]
        if reached == depth:
            many = np.repeat(np.add.reduceat(weights[owner[at]], first), np.diff(np.r_[first, len(at)])) > 1
            repeated_place[at[many & ~alone]] = True
        slots = slots[~alone]
    repeated_place &= np.arange(n) + depth <= last
    before = np.zeros(n, np.uint16)
    before[1:] = text[:-1]
    bwt = before[order]
    return Shard(bwt, owner[order[bwt == 0]], repeated_place[order])


def merge(a: Shard, b: Shard, depth: int) -> Shard:
    """The transform of both shards' strings, a's before b's."""
    n_a, n = len(a.bwt), len(a.bwt) + len(b.bwt)
    parts, longest = [], 0
    for s in (a, b):
        place, row_at, last, owner = s.inverted()
        longest = max(longest, int(np.bincount(owner).max()))
        text = np.sort(s.bwt, kind="stable")[row_at]
        parts.append([place, row_at, last, _first_keys(text)[place]])
    strings = len(a.starts), len(b.starts)
    parts[0][3][: strings[0]] -= strings[1]  # a's terminators before b's
    of_b = np.r_[np.zeros(n_a, bool), np.ones(n - n_a, bool)]
    keys = np.concatenate([parts[0].pop(), parts[1].pop()])  # each array of all rows is given back as soon as it is used up
    order = np.argsort(keys, kind="stable")  # two sorted runs, a's rows first among equals
    keys = keys[order]
    block = np.empty(n, np.int64)
    repeated = np.r_[a.repeated, b.repeated]

    def settle(rows: np.ndarray, ranked: np.ndarray, slots: np.ndarray) -> np.ndarray:
        """Names the blocks of rows in their order by their first slot; which rows are in a block of both shards."""
        begins = np.r_[True, ranked[1:] != ranked[:-1]]
        first = np.flatnonzero(begins)
        sizes = np.diff(np.r_[first, len(rows)])
        block[rows] = np.repeat(slots[first], sizes)
        ones = np.add.reduceat(of_b[rows].astype(np.int64), first)
        return np.repeat((ones > 0) & (ones < sizes), sizes)

    def whole_prefix(rows: np.ndarray) -> np.ndarray:
        """Which rows have the depth before their terminator; shorter ones may still share a block at that point."""
        out = np.empty(len(rows), bool)
        for side, (place, _, last) in enumerate(parts):
            mine = of_b[rows] == bool(side)
            at = place[rows[mine] - side * n_a]
            out[mine] = at + depth <= last[at]
        return out | repeated[rows]

    slots = np.arange(n)
    mixed = settle(order, keys, slots)
    slots, rows = slots[mixed], order[mixed]
    del keys, order, mixed
    if depth == FIRST:
        repeated[rows] = whole_prefix(rows)
    for step, reached in _depths(depth, longest):
        if not len(rows):
            break
        ahead = np.empty(len(rows), np.int64)
        for side, (place, row_at, last) in enumerate(parts):
            mine = of_b[rows] == bool(side)
            at = place[rows[mine] - side * n_a]
            ahead[mine] = block[row_at[np.minimum(at + step, last[at])] + side * n_a]
        both = block[rows] * n + ahead
        sort = np.argsort(both, kind="stable")  # rows ascend within a block, and keep doing so
        rows, both = rows[sort], both[sort]
        mixed = settle(rows, both, slots)
        slots, rows = slots[mixed], rows[mixed]
        if reached == depth:
            repeated[rows] = whole_prefix(rows)
    final = np.empty(n, np.int64)
    for side, (lo, hi) in enumerate(((0, n_a), (n_a, n))):
        own = block[lo:hi]
        first = np.maximum.accumulate(np.where(np.r_[True, own[1:] != own[:-1]], np.arange(hi - lo), 0))
        other = own - first
        final[lo:hi] = np.arange(hi - lo) + other
    bwt, again = np.empty(n, np.uint16), np.empty(n, bool)
    bwt[final], again[final] = np.r_[a.bwt, b.bwt], repeated
    zero = np.r_[final[:n_a][a.bwt == 0], final[n_a:][b.bwt == 0]]
    return Shard(bwt, np.r_[a.starts, b.starts + strings[0]][np.argsort(zero)], again)


def repeated_ranges(strings: list[bytes], weights: np.ndarray, depth: int, shard_bytes: int) -> list[list[tuple[int, int]]]:
    """For each string the ranges [from, to) of starts whose substring of length depth occurs in another place too."""
    shards, at = [], 0
    while at < len(strings):
        end, size = at, 0
        while end < len(strings) and (end == at or size + len(strings[end]) <= shard_bytes):
            size += len(strings[end])
            end += 1
        shards.append(build(strings[at:end], weights[at:end], depth))
        at = end
    while len(shards) > 1:
        shards = [merge(shards[i], shards[i + 1], depth) if i + 1 < len(shards) else shards[i] for i in range(0, len(shards), 2)]
    whole = shards[0]
    place, row_at, last, owner = whole.inverted()
    hit = whole.repeated[row_at]
    edge = np.diff(np.r_[False, hit, False].astype(np.int8))  # a terminator is never a hit, so runs stay in a string
    begin = np.r_[0, np.flatnonzero(np.diff(owner)) + 1]
    out: list[list[tuple[int, int]]] = [[] for _ in strings]
    for x, y in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()):
        o = int(owner[x])
        out[o].append((x - int(begin[o]), y - int(begin[o])))
    return out

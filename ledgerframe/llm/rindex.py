"""A run-length index: run-compressed Burrows-Wheeler transform with sampled run ends.

The index of a collection of byte strings keeps, per run of equal symbols of the
transform, its symbol, where it starts, the rank base that maps its rows back
one symbol, and the text positions at its first and last row. Matching
statistics of patterns are streamed from their ends: while the run's symbol is
the pattern's, the row is mapped back; otherwise the row jumps to the nearest
run of that symbol above or below, whichever sample shares the longer prefix
with what has matched so far. All patterns advance together in numpy.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Text symbols are bytes plus one (UTF-8 has no byte above 0xF4); 0 ends a string.
END = 0


def _words(text: np.ndarray, room: np.ndarray) -> np.ndarray:
    """The next eight symbols at each position as one number, zeros beyond the string's end."""
    padded = np.concatenate([text, np.zeros(8, dtype=np.uint8)])
    out = np.zeros(len(text), dtype=np.uint64)
    for k in range(8):
        symbol = padded[k : k + len(text)].astype(np.uint64)
        symbol[room < k] = 0
        out |= symbol << np.uint64(56 - 8 * k)
    return out


def suffix_array(text: np.ndarray, room: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Order of all suffixes; a string's end is smaller than any symbol, and ends order by place."""
    n = len(text)
    order = np.argsort(words, kind="stable")
    sorted_words = words[order]
    new = np.ones(n, dtype=bool)
    new[1:] = sorted_words[1:] != sorted_words[:-1]
    new |= room[order] < 8  # the end is within reach: equal strings stand in order of place
    head = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n, dtype=np.int64)
    rank[order] = head
    depth = 8
    while True:
        last = np.append(new[1:], True)
        slots = np.flatnonzero(~(new & last))
        if not len(slots):
            return order
        at = order[slots]
        keys = (rank[at] << np.int64(32)) | rank[at + depth]
        by = np.argsort(keys, kind="stable")
        at, keys = at[by], keys[by]
        order[slots] = at
        fresh = np.ones(len(at), dtype=bool)
        fresh[1:] = keys[1:] != keys[:-1]
        fresh |= room[at] < 2 * depth
        new[slots] |= fresh
        new[slots] = fresh | (rank[at] == slots)
        head = np.maximum.accumulate(np.where(fresh, slots, 0))
        rank[at] = head
        depth *= 2


def common_prefix(words: np.ndarray, room: np.ndarray, p: np.ndarray, q: np.ndarray, most: int) -> np.ndarray:
    """Length of the longest common prefix of the suffixes at p and q, up to ``most``, not over an end."""
    out = np.zeros(len(p), dtype=np.int64)
    live = np.arange(len(p))
    top = len(words) - 1
    for step in range(0, most, 8):
        differ = words[np.minimum(p[live] + step, top)] ^ words[np.minimum(q[live] + step, top)]
        same = np.zeros(len(live), dtype=np.int64)
        for k in range(8):
            same += differ < np.uint64(1 << (56 - 8 * k))
        out[live] = step + same
        live = live[(differ == 0) & (room[p[live]] > step + 8) & (room[q[live]] > step + 8)]
        if not len(live):
            break
    return np.minimum(np.minimum(out, most), np.minimum(room[p], room[q]))


@dataclass
class RunIndex:
    words: np.ndarray
    room: np.ndarray
    starts: np.ndarray  # first row of each run
    symbols: np.ndarray  # its symbol
    back: np.ndarray  # row - starts + back is the row one symbol earlier
    first: np.ndarray  # text position at the first row of each run
    last: np.ndarray  # and at the last
    by_symbol: np.ndarray  # symbol * runs + run, sorted
    order: np.ndarray

    @classmethod
    def build(cls, strings: list[bytes]) -> RunIndex:
        sizes = np.array([len(s) + 1 for s in strings], dtype=np.int64)
        ends = np.cumsum(sizes)
        text = np.frombuffer(b"\xff".join(strings) + b"\xff", dtype=np.uint8) + np.uint8(1)  # 0xFF + 1 wraps to the end symbol
        room = np.repeat(ends - 1, sizes) - np.arange(len(text))
        words = _words(text, room)
        order = suffix_array(text, room, words)
        bwt = text[order - 1]
        breaks = np.ones(len(bwt), dtype=bool)
        breaks[1:] = bwt[1:] != bwt[:-1]
        starts = np.flatnonzero(breaks)
        symbols = bwt[starts].astype(np.int64)
        lengths = np.diff(np.append(starts, len(bwt)))
        by = np.argsort(symbols, kind="stable")
        back = np.empty(len(starts), dtype=np.int64)
        back[by] = np.cumsum(lengths[by]) - lengths[by]  # rows by symbol, then by place: where each run's rows go
        return cls(words, room, starts, symbols, back, order[starts], order[starts + lengths - 1], symbols[by] * len(starts) + by, order)

    def stream(self, patterns: list[bytes], most: int) -> list[np.ndarray]:
        """Per pattern and position the row of a suffix that shares ``most`` symbols with
        the pattern from there on, or -1 where the matching statistic is smaller."""
        size = np.array([len(p) for p in patterns], dtype=np.int64)
        by = np.argsort(-size, kind="stable")
        data = np.frombuffer(b"".join(patterns), dtype=np.uint8)
        tail = np.cumsum(size)[by]
        size_by = size[by]
        row = np.zeros(len(patterns), dtype=np.int64)
        place = np.full(len(patterns), self.order[0], dtype=np.int64)
        matched = np.zeros(len(patterns), dtype=np.int64)
        out = np.full(len(data), -1, dtype=np.int64)
        runs = len(self.starts)
        for step in range(1, int(size_by[0]) + 1 if len(patterns) else 1):
            live = int(np.searchsorted(-size_by, -step, "right"))
            j, p, length = row[:live], place[:live], matched[:live]
            at = tail[:live] - step
            c = data[at].astype(np.int64) + 1
            run = np.searchsorted(self.starts, j, "right") - 1
            off = np.flatnonzero(self.symbols[run] != c)
            if len(off):
                key = c[off] * runs + run[off]
                nxt = np.searchsorted(self.by_symbol, key)
                up = self.by_symbol[np.maximum(nxt - 1, 0)]
                down = self.by_symbol[np.minimum(nxt, runs - 1)]
                has_up, has_down = (nxt > 0) & (up // runs == c[off]), (nxt < runs) & (down // runs == c[off])
                up, down = up % runs, down % runs
                l_up = np.where(has_up, common_prefix(self.words, self.room, p[off], self.last[up], most), -1)
                l_down = np.where(has_down, common_prefix(self.words, self.room, p[off], self.first[down], most), -1)
                to_up = l_up >= l_down
                best = np.maximum(l_up, l_down)
                run[off] = np.where(to_up, up, down)
                ends = np.append(self.starts[1:], len(self.order)) - 1 if runs else self.starts
                j[off] = np.where(to_up, ends[up], self.starts[down])
                p[off] = np.where(to_up, self.last[up], self.first[down])
                length[off] = np.minimum(length[off], best)
            lost = length < 0
            j[:] = j - self.starts[run] + self.back[run]
            p[:] = p - 1
            length[:] = np.minimum(length + 1, most)
            if lost.any():
                j[lost], p[lost], length[lost] = 0, self.order[0], 0
            hit = length >= most
            out[at[hit]] = j[hit]
        return np.split(out, np.cumsum(size)[:-1]) if len(patterns) else []

    def intervals(self, depth: int) -> np.ndarray:
        """Per row the number of its group of suffixes that share ``depth`` symbols; -1 for shorter suffixes."""
        at = self.order
        whole = self.room[at] >= depth
        new = np.ones(len(at), dtype=bool)
        p, q = at[1:], at[:-1]
        both = whole[1:] & whole[:-1]
        idx = np.flatnonzero(both)
        new[1:][idx] = common_prefix(self.words, self.room, p[idx], q[idx], depth) < depth
        return np.where(whole, np.cumsum(new) - 1, -1)

"""FM-index over the word ids of one shard of texts.

The shard's pieces are laid end to end as word ids, with symbol 0 after each
piece. Rows are suffixes in the order of their first words; the column of words
in front of the rows is the Burrows-Wheeler transform. All intervals of one
depth are extended at once: a stable sort of that column is the last-to-first
mapping of every row, and the rows of an interval that share the word in front
become the interval of a phrase one word longer (extension to the left). The
new order refines the old one, so the interval of a phrase also splits into the
intervals of the phrases that go on after it (extension to the right).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from .common import byte_values, offsets

#: Bytes that end a piece, and the other bytes between words.
ENDS, GAPS = b".,;:!?\n\x0b\x0c\r", b" \t"

_KIND = np.zeros(256, dtype=np.uint8)
_KIND[list(GAPS)] = 1
_KIND[list(ENDS)] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The lower-cased words of the texts in order, and for each the number of its piece (rising, not gapless)."""
    raw = _LOWER[byte_values(texts)]
    kind = _KIND[raw]
    at = offsets(texts)
    at = at - at[0]
    inside = np.zeros(len(raw) + 2, dtype=bool)
    inside[1:-1] = kind == 0
    opens = inside[1:-1] & ~inside[:-2]
    closes = inside[1:-1] & ~inside[2:]
    edge = at[(at > 0) & (at < len(raw))]
    opens[edge] = inside[1:-1][edge]
    closes[edge - 1] = inside[1:-1][edge - 1]
    first = np.flatnonzero(opens)
    lengths = np.flatnonzero(closes) + 1 - first
    piece = np.cumsum(kind == 2, dtype=np.int32)[first] + np.searchsorted(at, first, "right")
    ends = np.concatenate([[0], np.cumsum(lengths)])
    words = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(raw[inside[1:-1]]))
    return words, piece


@dataclass
class Level:
    """All phrases of one length: an interval each, in suffix order."""

    #: Occurrences of each phrase: the width of its interval.
    count: np.ndarray
    #: Word ids of each phrase, a column per word.
    words: list[np.ndarray]
    #: The phrase without its first word and without its last, as numbers of the level before.
    rest: np.ndarray
    stem: np.ndarray


def _sorted_rows(keys: np.ndarray) -> np.ndarray:
    """Row numbers in stable order of the keys."""
    packed = (keys.astype(np.int64) << 32) | np.arange(len(keys))
    packed.sort()
    return packed.astype(np.int32)  # the low half


def levels(ids: np.ndarray, piece: np.ndarray, depth: int) -> list[Level]:
    """The phrases of 1 to ``depth`` words of pieces of word ids (from 0), by interval extension."""
    n = len(ids)
    if not n:
        none = np.zeros(0, dtype=np.int64)
        return [Level(none, [none] * (d + 1), none, none) for d in range(depth)]
    shift = np.concatenate([[0], np.cumsum(piece[1:] != piece[:-1])])
    text = np.zeros(n + int(shift[-1]) + 2, dtype=np.int32)
    text[np.arange(n) + shift + 1] = ids + 1
    at = _sorted_rows(text)
    at = at[np.count_nonzero(text == 0) :]  # rows of suffixes that begin with a word
    label = text[at] - 1  # ids are gapless: the number of the row's interval
    count = np.bincount(label)
    one = np.arange(len(count))
    found = [Level(count, [one], one, one)]
    where = np.zeros(len(text), dtype=np.int32)
    for _ in range(1, depth):
        where[at] = label
        front = text[at - 1]  # the transform's column
        live = np.flatnonzero(front).astype(np.int32)
        rows = live[_sorted_rows(front[live])]  # the inverse of the last-to-first mapping
        front, rest, at = front[rows] - 1, label[rows], at[rows] - 1
        new = np.ones(len(rows), dtype=bool)
        new[1:] = (front[1:] != front[:-1]) | (rest[1:] != rest[:-1])
        heads = np.flatnonzero(new)
        label = np.cumsum(new, dtype=np.int32) - 1
        before = found[-1].words
        found.append(
            Level(np.diff(np.append(heads, len(rows))), [front[heads], *(w[rest[heads]] for w in before)], rest[heads], where[at[heads]])
        )
    return found

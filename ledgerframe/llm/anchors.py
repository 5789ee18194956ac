"""Content anchors: dealing windows of a sequence out so that equal windows meet.

Every window of ``length`` symbols is keyed by the smallest hash among its
``gram``-symbol pieces. Equal windows have equal keys wherever they occur, and
neighbouring windows mostly share theirs, so a sequence falls into runs of
windows with one key, about ``2 / (length - gram + 2)`` runs a symbol.
"""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def gram_hashes(symbols: np.ndarray, gram: int) -> np.ndarray:
    """Polynomial hashes of all pieces of ``gram`` symbols, mixed."""
    whole, size = None, 0
    power, step = symbols, 1  # hashes of pieces of ``step`` symbols
    left = gram
    while left:
        if left & 1:
            if whole is None:
                whole, size = power, step
            else:
                n = len(symbols) - size - step + 1
                if n <= 0:
                    return np.zeros(0, dtype=np.uint64)
                whole, size = whole[:n] * np.uint64(pow(_BASE, step, 1 << 64)) + power[size : size + n], size + step
        left >>= 1
        if left:
            if len(power) <= step:
                return np.zeros(0, dtype=np.uint64)
            power = power[:-step] * np.uint64(pow(_BASE, step, 1 << 64)) + power[step:]
            step *= 2
    whole = (whole ^ (whole >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return whole ^ (whole >> np.uint64(32))


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    if len(values) < width:
        return values[:0]
    found, step = values, 1
    while step * 2 <= width:
        found = np.minimum(found[:-step], found[step:])
        step *= 2
    rest = width - step
    return np.minimum(found[:-rest], found[rest:]) if rest else found


def anchored_runs(symbols: np.ndarray, bounds: np.ndarray, gram: int, length: int, longest: int = 1 << 62) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(sequence, first window, windows, anchor) of the runs in sequences laid end to end.

    ``bounds`` has where each sequence starts and the end of all. Runs of more
    than ``longest`` windows are cut, counted from their start.
    """
    keys = sliding_min(gram_hashes(symbols, gram), length - gram + 1)
    none = np.zeros(0, dtype=np.int64)
    if not len(keys):
        return none, none, none, none.astype(np.uint64)
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[: len(keys)]
    inside = np.arange(len(keys)) + length <= bounds[1:][owner]
    breaks = np.ones(len(keys), dtype=bool)
    breaks[1:] = (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1]) | (inside[1:] != inside[:-1])
    starts = np.flatnonzero(breaks)
    counts = np.diff(np.append(starts, len(keys)))
    real = inside[starts]
    starts, counts = starts[real], counts[real]
    if len(counts) and counts.max() > longest:
        pieces = -(-counts // longest)
        which = np.repeat(np.arange(len(starts)), pieces)
        nth = np.arange(len(which)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        starts, counts = starts[which] + nth * longest, np.minimum(longest, counts[which] - nth * longest)
    return owner[starts], starts, counts, _spread(keys[starts])


def _spread(keys: np.ndarray) -> np.ndarray:
    """Smallest hashes crowd near zero; this one-to-one mix spreads them over all numbers."""
    keys = (keys ^ (keys >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    keys = (keys ^ (keys >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return keys ^ (keys >> np.uint64(33))

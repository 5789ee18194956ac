"""Exact substring deduplication with a run-length index.

A byte goes if it lies under a string of ``LENGTH`` bytes that also starts in a
document with a smaller id. All strings of ``LENGTH`` bytes are judged on the
input.

Documents are dealt to blocks of about ``BLOCK_BYTES`` by hash. Content anchors
(see ``anchors``) cut each document into runs of windows with one key, so equal
strings have equal keys, and the bytes under a run are its context. Then:

1. every block sends its distinct keys, as packed arrays, to key buckets, and
   learns which of them occur in other documents too;
2. it sends the distinct contexts of those keys, each with the smallest id that
   holds it there, to context buckets;
3. a bucket collapses equal contexts to the smallest id. Within a key, the
   context with the smallest id is original throughout; the later ones are
   patterns. The contexts of keys with patterns become a run-length index
   (``rindex``), the patterns' matching statistics are streamed over it, and
   every window whose group of suffixes starts in a smaller document is marked;
4. the marks return to the blocks, which cut the bytes out.

What a bucket gets from a block is distinct there, so a text with millions of
copies counts once a block. A key with more than ``HOT_DOCUMENTS`` documents
sends its windows one by one, keyed by their own hashes, so a common string
with ever different surroundings is spread over all buckets.

Edge cases: null text counts as empty; a null id is larger than any other, so
such rows lose what rows with ids hold and never the reverse; rows that share an
id never remove from each other; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import anchored_runs
from .rindex import RunIndex

LENGTH, GRAM = 50, 24
BLOCK_BYTES = 4 << 20
BUCKET_BYTES = 8 << 20
#: Bytes looked at together, and windows in one context at most.
CHUNK, LONGEST = 1 << 20, 512
HOT_DOCUMENTS = 20_000
NO_ID = (1 << 63) - 1

_SYMBOLS = np.random.default_rng(20).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOW48 = np.uint64((1 << 48) - 1)


def _bucket_bits(total: int, size: int) -> int:
    return min(32, max(4, math.ceil(math.log2(max(1, total / size)))))


def _keyed(anchor: np.ndarray, bits: int) -> np.ndarray:
    """The anchor without the bits that neither its bucket nor its 48-bit form holds."""
    return anchor >> np.uint64(max(0, 16 - bits))


def _pack48(keys: np.ndarray) -> bytes:
    return np.ascontiguousarray((keys & _LOW48).view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _unpack48(blob: bytes, bucket: int, bits: int) -> np.ndarray:
    low = np.zeros((len(blob) // 6, 8), dtype=np.uint8)
    low[:, :6] = np.frombuffer(blob, dtype=np.uint8).reshape(-1, 6)
    return low.reshape(-1).view(np.uint64) | np.uint64(bucket << (64 - bits - max(0, 16 - bits)))


def _planes(counts: np.ndarray) -> bytes:
    """Two-byte numbers as their low bytes, then their high bytes, which compress to almost nothing."""
    return np.ascontiguousarray(counts.view(np.uint8).reshape(-1, 2).T).tobytes()


def _from_planes(blob: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(blob, dtype=np.uint8).reshape(2, -1).T).view("<u2").ravel()


class Block:
    """A block's documents, by id and text whatever order the shuffle gave, and the runs of their windows."""

    def __init__(self, table: pa.Table):
        ids, texts = table.column("doc_id").to_pylist(), table.column("text").to_pylist()
        keys = [NO_ID if i is None else i for i in ids]
        order = sorted(range(len(keys)), key=lambda i: (keys[i], texts[i]))
        self.own_ids = [ids[i] for i in order]
        self.ids = np.array([keys[i] for i in order], dtype=np.int64)
        texts = [texts[i] for i in order]
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        self.bounds = np.concatenate(([0], np.cumsum(sizes)))
        self.data = b"".join(texts)
        found = []
        raw = np.frombuffer(self.data, dtype=np.uint8)
        for begin, stop, at, lows in self._chunks():
            owner, starts, counts, keys = anchored_runs(_SYMBOLS[raw[begin:stop]], lows - begin, GRAM, LENGTH, LONGEST)
            found.append((owner + at, starts + begin, counts, keys))
        self.owner, self.starts, self.counts, self.anchors = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)

    def _chunks(self):
        """Pieces of the data of about a chunk, at ends of documents; a longer document in overlapping pieces."""
        n, doc = len(self.bounds) - 1, 0
        while doc < n:
            begin = self.bounds[doc]
            last = max(doc + 1, int(np.searchsorted(self.bounds, begin + CHUNK, "right")) - 1)
            if last == doc + 1:
                end = self.bounds[last]
                for at in range(int(begin), max(int(begin) + 1, int(end) - LENGTH + 1), CHUNK):
                    stop = min(int(end), at + CHUNK + LENGTH - 1)
                    yield at, stop, doc, np.array([at, stop])
            else:
                yield int(begin), int(self.bounds[last]), doc, self.bounds[doc : last + 1]
            doc = last

    def shared(self, answers: pa.Table, bits: int) -> Contexts:
        parts = [(_unpack48(k, b, bits), np.frombuffer(h, dtype=np.uint8)) for k, h, b in zip(*(answers.column(x).to_pylist() for x in ("keys", "extra", "bucket")), strict=True)]
        keys = np.concatenate([k for k, _ in parts]) if parts else np.zeros(0, np.uint64)
        hot = np.concatenate([h for _, h in parts]) if parts else np.zeros(0, np.uint8)
        order = np.argsort(keys)
        keys, hot = keys[order], hot[order]
        own = _keyed(self.anchors, bits)
        at = np.minimum(np.searchsorted(keys, own), max(0, len(keys) - 1))
        runs = np.flatnonzero(keys[at] == own) if len(keys) else np.zeros(0, np.int64)
        is_hot = hot[at[runs]] > 0 if len(keys) else np.zeros(0, bool)
        cool = runs[~is_hot]
        warm = runs[is_hot]
        n = self.counts[warm]
        singles = np.repeat(self.starts[warm], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return Contexts(
            self, np.concatenate([self.owner[cool], np.repeat(self.owner[warm], n)]), np.concatenate([self.starts[cool], singles]),
            np.concatenate([self.counts[cool], np.ones(len(singles), np.int64)]), np.concatenate([self.anchors[cool], np.zeros(len(singles), np.uint64)]), len(cool),
        )


class Contexts:
    """The distinct contexts of a block's shared keys, and which runs have which."""

    def __init__(self, block: Block, owner, starts, counts, anchors, cool: int):
        self.owner, self.starts, self.counts = owner, starts, counts
        data = block.data
        number: dict[bytes, int] = {}
        self.which = np.array([number.setdefault(data[a : a + n + LENGTH - 1], len(number)) for a, n in zip(starts.tolist(), counts.tolist(), strict=True)], dtype=np.int64)
        self.strings = list(number)
        first = np.full(len(number), -1, dtype=np.int64)
        first[self.which[::-1]] = np.arange(len(starts))[::-1]
        self.keys = anchors[first]
        for c in np.flatnonzero(first >= cool).tolist():
            self.keys[c] = xxhash.xxh64_intdigest(self.strings[c])
        self.lowest = np.full(len(number), NO_ID, dtype=np.int64)
        np.minimum.at(self.lowest, self.which, block.ids[owner])

    def by_bucket(self, bits: int) -> list[tuple[int, np.ndarray]]:
        bucket = self.keys >> np.uint64(64 - bits)
        order = np.argsort(bucket, kind="stable")
        cuts = np.flatnonzero(np.diff(bucket[order])) + 1
        return [(int(bucket[x[0]]), x) for x in np.split(order, cuts) if len(x)]


MESSAGE = "block int, bucket long, keys binary, extra binary"


def _table(rows: list[tuple[int, int, bytes, bytes]]) -> pa.Table:
    schema = pa.schema([("block", pa.int32()), ("bucket", pa.int64()), ("keys", pa.binary()), ("extra", pa.binary())])
    return pa.table([list(x) for x in zip(*rows, strict=True)] if rows else [[], [], [], []], schema=schema)


def _send_keys(documents: pa.Table, bits: int) -> pa.Table:
    """Step 1: a block's distinct keys, with the number of its documents that hold each (beyond 65,535 it makes no difference)."""
    block = Block(documents)
    if not len(block.anchors):
        return _table([])
    order = np.lexsort((block.owner, block.anchors))
    anchors, owner = block.anchors[order], block.owner[order]
    new_key = np.append(True, anchors[1:] != anchors[:-1])
    new_pair = new_key | np.append(True, owner[1:] != owner[:-1])
    heads = np.flatnonzero(new_key)
    held = np.minimum(np.add.reduceat(new_pair.astype(np.int64), heads), 65_535).astype("<u2")
    keys = anchors[heads]
    bucket = keys >> np.uint64(64 - bits)
    cuts = np.concatenate(([0], np.flatnonzero(np.diff(bucket)) + 1, [len(keys)]))
    number = documents.column("block")[0].as_py()
    keyed = _keyed(keys, bits)
    return _table([(number, int(bucket[a]), _pack48(keyed[a:b]), _planes(held[a:b])) for a, b in zip(cuts[:-1], cuts[1:], strict=True)])


def _answer_keys(messages: pa.Table, bits: int) -> pa.Table:
    """A key bucket tells each block which of its keys two or more documents hold, and which of those very many."""
    bucket = messages.column("bucket")[0].as_py()
    blocks = messages.column("block").to_numpy()
    packed = messages.column("keys").to_pylist()
    parts = [_unpack48(x, bucket, bits) for x in packed]
    keys = np.concatenate(parts)
    held = np.concatenate([_from_planes(x) for x in messages.column("extra").to_pylist()])
    order = np.argsort(keys)
    heads = np.flatnonzero(np.append(True, keys[order][1:] != keys[order][:-1]))
    total = np.empty(len(keys), dtype=np.int64)
    total[order] = np.repeat(np.add.reduceat(held[order].astype(np.int64), heads), np.diff(np.append(heads, len(keys))))
    rows, at = [], 0
    for number, part in zip(blocks.tolist(), parts, strict=True):
        own = total[at : at + len(part)]
        at += len(part)
        shared = own >= 2
        if shared.any():
            rows.append((number, bucket, _pack48(part[shared]), (own[shared] > HOT_DOCUMENTS).astype(np.uint8).tobytes()))
    return _table(rows)


def _send_contexts(documents: pa.Table, answers: pa.Table, bits: int) -> pa.Table:
    """Step 2: the distinct contexts of shared keys, each with the smallest id in the block."""
    if not documents.num_rows or not answers.num_rows:
        return _table([])
    contexts = Block(documents).shared(answers, bits)
    number = documents.column("block")[0].as_py()
    squeeze = zstandard.ZstdCompressor(level=1)
    rows = []
    for bucket, own in contexts.by_bucket(bits):
        strings = [contexts.strings[c] for c in own.tolist()]
        head = np.concatenate([contexts.keys[own].view(np.int64), contexts.lowest[own], np.array([len(s) for s in strings], dtype=np.int64)])
        rows.append((number, bucket, squeeze.compress(head.tobytes()), squeeze.compress(b"".join(strings))))
    return _table(rows)


def mark_windows(keys: np.ndarray, lowest: np.ndarray, strings: list[bytes]) -> list[np.ndarray | None]:
    """Per distinct context the smallest id that holds each of its windows; None where that is the context's own id."""
    order = np.lexsort((lowest, keys))
    new = np.append(True, keys[order][1:] != keys[order][:-1])
    alone = new & np.append(new[1:], True)
    chosen = order[~alone]
    out: list[np.ndarray | None] = [None] * len(strings)
    if not len(chosen):
        return out
    held = [strings[c] for c in chosen.tolist()]
    index = RunIndex.build(held)
    groups = index.intervals(LENGTH)
    sizes = np.array([len(s) + 1 for s in held])
    owner = np.repeat(np.arange(len(held)), sizes)[index.order]
    whole = groups >= 0
    smallest = np.full(int(groups.max()) + 1, NO_ID, dtype=np.int64)
    np.minimum.at(smallest, groups[whole], lowest[chosen][owner[whole]])
    patterns = np.flatnonzero(~new[~alone])
    rows = index.stream([held[p] for p in patterns.tolist()], LENGTH)
    for p, row in zip(patterns.tolist(), rows, strict=True):
        row = row[: len(held[p]) - LENGTH + 1]
        out[chosen[p]] = np.where(row >= 0, smallest[groups[row]], NO_ID)
    return out


def _answer_contexts(messages: pa.Table) -> pa.Table:
    """Step 3: per block the windows of its contexts that start in a document smaller than any of its own."""
    bucket = messages.column("bucket")[0].as_py()
    expand = zstandard.ZstdDecompressor()
    number: dict[bytes, int] = {}
    entries = []
    for block, head, data in zip(*(messages.column(x).to_pylist() for x in ("block", "keys", "extra")), strict=True):
        keys, own, sizes = np.frombuffer(expand.decompress(head), dtype=np.int64).reshape(3, -1)
        data, ends = expand.decompress(data), np.cumsum(sizes)
        which = np.array([number.setdefault(data[b - n : b], len(number)) for b, n in zip(ends.tolist(), sizes.tolist(), strict=True)], dtype=np.int64)
        entries.append((block, keys, own, which))
    keys = np.zeros(len(number), dtype=np.int64)
    lowest = np.full(len(number), NO_ID, dtype=np.int64)
    for _, own_keys, own, which in entries:
        keys[which] = own_keys
        np.minimum.at(lowest, which, own)
    strings = list(number)
    marks = mark_windows(keys, lowest, strings)
    rows = []
    for block, _, own, which in entries:
        full, part = own > lowest[which], []
        for e in np.flatnonzero(~full).tolist():
            mark = marks[which[e]]
            if mark is not None:
                gone = np.concatenate(([0], (mark < own[e]).astype(np.int8), [0]))
                edges = np.flatnonzero(np.diff(gone))
                part += [(e, a, b) for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)]
        if full.any() or part:
            rows.append((block, bucket, np.packbits(full).tobytes(), np.array(part, dtype=np.int32).tobytes()))
    return _table(rows)


def _cut_out(documents: pa.Table, answers: pa.Table, bits: int) -> pa.Table:
    """Step 4: the bytes that stay of each document, and how many and in how many runs went."""
    out = {"doc_id": [], "n_bytes": [], "n_removed": [], "n_spans": [], "kept": []}
    if documents.num_rows:
        block = Block(documents)
        about = answers.column("about").to_numpy(zero_copy_only=False)
        contexts = block.shared(answers.filter(pa.array(about == 0)), bits)
        marked = {b: (k, x) for b, k, x in zip(*(answers.filter(pa.array(about == 1)).column(c).to_pylist() for c in ("bucket", "keys", "extra")), strict=True)}
        full = np.zeros(len(contexts.strings), dtype=bool)
        parts = []
        for bucket, own in contexts.by_bucket(bits):
            if bucket in marked:
                bitmap, ranges = marked[bucket]
                full[own] = np.unpackbits(np.frombuffer(bitmap, dtype=np.uint8), count=len(own)).astype(bool)
                ranges = np.frombuffer(ranges, dtype=np.int32).reshape(-1, 3).astype(np.int64)
                parts.append(np.column_stack([own[ranges[:, 0]], ranges[:, 1:]]))
        cover = np.zeros(len(block.data) + 1, dtype=np.int32)
        gone = full[contexts.which] | (block.ids[contexts.owner] > contexts.lowest[contexts.which])
        np.add.at(cover, contexts.starts[gone], 1)
        np.add.at(cover, contexts.starts[gone] + contexts.counts[gone] + LENGTH - 1, -1)
        if parts:
            ranges = np.concatenate(parts)
            ranges = ranges[np.argsort(ranges[:, 0], kind="stable")]
            low, high = np.searchsorted(ranges[:, 0], contexts.which, "left"), np.searchsorted(ranges[:, 0], contexts.which, "right")
            n = np.where(gone, 0, high - low)
            of = np.repeat(np.arange(len(n)), n)
            at = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + low[of]
            np.add.at(cover, contexts.starts[of] + ranges[at, 1], 1)
            np.add.at(cover, contexts.starts[of] + ranges[at, 2] + LENGTH - 1, -1)
        removed = np.cumsum(cover[:-1]) > 0
        data = np.frombuffer(block.data, dtype=np.uint8)
        for doc_id, a, b in zip(block.own_ids, block.bounds[:-1].tolist(), block.bounds[1:].tolist(), strict=True):
            here = removed[a:b]
            out["doc_id"].append(doc_id)
            out["n_bytes"].append(b - a)
            out["n_removed"].append(int(here.sum()))
            out["n_spans"].append(int(np.count_nonzero(np.diff(here.astype(np.int8), prepend=0) == 1)))
            out["kept"].append(data[a:b][~here].tobytes())
    return pa.table(out, schema=pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())]))


def remove_repeats(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """Rows of (doc_id, n_bytes, n_removed, n_spans, kept): kept is what stays of the text's bytes."""
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    whole = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    total = whole.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-total // BLOCK_BYTES))
    bits = _bucket_bits(total, BUCKET_BYTES)
    dealt = whole.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int"))
    by_block = dealt.groupBy("block")
    shared = by_block.applyInArrow(lambda t: _send_keys(t, bits), MESSAGE).groupBy("bucket").applyInArrow(lambda t: _answer_keys(t, bits), MESSAGE)
    contexts = by_block.cogroup(shared.groupBy("block")).applyInArrow(lambda d, a: _send_contexts(d, a, bits), MESSAGE)
    marks = contexts.groupBy("bucket").applyInArrow(_answer_contexts, MESSAGE)
    answers = shared.withColumn("about", F.lit(0)).unionByName(marks.withColumn("about", F.lit(1)))
    return by_block.cogroup(answers.groupBy("block")).applyInArrow(lambda d, a: _cut_out(d, a, bits), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


"""Quality classifier: supervised subword embeddings.

A word is the average of learned vectors for its own hash and for the hashes of
its character n-grams (with word ends marked). A word bigram has the vector of
its hash, and a word that repeats its predecessor the vector of one reserved
bucket, whatever the word. A document is the average over its words plus the
average over its bigrams; a softmax layer over that gives the class. Embeddings and output
layer are trained by stochastic gradient descent in numpy, in one task, on a bounded sample
of labelled rows (``SAMPLE_ROWS``, the lowest hashes of their ids).

Because the output layer is linear in the average, scoring needs one number per
distinct word: its vector times the difference of the output rows. Each Arrow
batch hashes its distinct words only and averages their numbers per document.
The model that tasks receive has a fixed size: one float per hash bucket.

Edge cases: null text counts as empty, and a text without words is scored by the
bias alone; texts and words of any length are scored whole, though texts of more
than ``SAMPLE_TEXT_BYTES`` are not learned from; with no labelled rows, or labels of one kind, every score is the
share of label 1 (0.5 without any); null ids are scored, in fold 0; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_lengths, byte_slices, byte_values
from .decision_list import split_words

#: Bounds of the training sample: labelled rows, and bytes of a text that is learned from. Scoring has no bound.
SAMPLE_ROWS, SAMPLE_TEXT_BYTES = 2_500, 1 << 16
BUCKETS = 1 << 18
DIM = 12
MIN_N, MAX_N = 2, 4
#: Bytes of words looked at together; a longer word is looked at in overlapping pieces.
PIECE = 1 << 20
EPOCHS, BATCH, RATE = 7, 64, 0.1
FOLDS, HELD_FOLD = 3, 1

_MULTIPLIER = np.uint64(0x100000001B3)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(33))


def _powers(n: int, base: np.uint64) -> np.ndarray:
    """base^0 to base^(n-1), modulo 2^64."""
    return np.cumprod(np.concatenate(([np.uint64(1)], np.full(max(0, n - 1), base, dtype=np.uint64))), dtype=np.uint64)


def word_hashes(words: pa.Array) -> np.ndarray:
    """Polynomial hash of every whole word, of any length."""
    lengths, data = byte_lengths(words), byte_values(words)
    out = np.zeros(len(words), dtype=np.uint64)
    ends = np.cumsum(lengths)
    low = _powers(1 << 16, _MULTIPLIER)
    high = _powers((int(lengths.max(initial=0)) >> 16) + 1, (low[-1:] * _MULTIPLIER)[0])
    for start in range(0, len(data), PIECE):
        at = np.arange(start, min(len(data), start + PIECE))
        owner = np.searchsorted(ends, at, "right")
        left = ends[owner] - 1 - at
        worth = (data[at].astype(np.uint64) + np.uint64(1)) * low[left & 0xFFFF] * high[left >> 16]
        heads = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        out[owner[heads]] += np.add.reduceat(worth, heads)
    return _mix(out)


def word_features(words: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(buckets, words) of the features of each word, piece by piece: its own hash and all its character n-grams."""
    hashes = word_hashes(words)
    yield (hashes % np.uint64(BUCKETS)).astype(np.int64), np.arange(len(words))
    lengths, data = byte_lengths(words), byte_values(words)
    ends = np.cumsum(lengths + 2)
    starts = ends - lengths - 2
    marked = np.empty(int(ends[-1]) if len(ends) else 0, dtype=np.uint8)
    marked[starts], marked[ends - 1] = ord("<"), ord(">")
    inner = np.ones(len(marked), dtype=bool)
    inner[starts] = inner[ends - 1] = False
    marked[inner] = data
    for begin in range(0, len(marked), PIECE):
        at = np.arange(begin, min(len(marked), begin + PIECE))
        owner = np.searchsorted(ends, at, "right")
        left = ends[owner] - at
        for size in range(MIN_N, MAX_N + 1):
            inside = np.flatnonzero(left >= size)
            h = np.full(len(inside), np.uint64(size * 0x9E3779B1), dtype=np.uint64)
            for k in range(size):
                h = h * _MULTIPLIER + marked[at[inside] + k].astype(np.uint64) + np.uint64(1)
            yield (_mix(h) % np.uint64(BUCKETS)).astype(np.int64), owner[inside]


def bigram_buckets(codes: np.ndarray, owner: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the word bigrams inside texts, and the text of each; bucket 0 is a repeated word."""
    inside = np.flatnonzero(owner[1:] == owner[:-1])
    a, b = codes[inside], codes[inside + 1]
    mixed = _mix(hashes[a] * np.uint64(0x9E3779B97F4A7C15) + hashes[b])
    return np.where(a == b, 0, 1 + (mixed % np.uint64(BUCKETS - 1)).astype(np.int64)), owner[inside]


def _bags(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per text the buckets of all its words with weights: (text, bucket, weight), weights adding up per word, averaged."""
    words, owner = split_words(texts)
    coded = words.dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    kinds = max(1, len(coded.dictionary))
    pairs, times = np.unique(owner * kinds + codes, return_counts=True)
    doc, word = pairs // kinds, pairs % kinds
    buckets, of = (np.concatenate(x) for x in zip(*word_features(coded.dictionary), strict=True))
    pair, pair_doc = bigram_buckets(codes, owner, word_hashes(coded.dictionary))
    n_pairs = np.maximum(np.bincount(pair_doc, minlength=len(texts)), 1)
    order = np.argsort(of, kind="stable")
    buckets, of = buckets[order], of[order]
    sizes = np.bincount(of, minlength=kinds)
    first = np.cumsum(sizes) - sizes
    n = sizes[word]
    rows = np.repeat(np.arange(len(pairs)), n)
    at = np.arange(len(rows)) - np.repeat(np.cumsum(n) - n, n) + first[word][rows]
    total = np.maximum(np.bincount(owner, minlength=len(texts)), 1)
    weight = times[rows] / sizes[word[rows]] / total[doc[rows]]
    return np.concatenate([doc[rows], pair_doc]), np.concatenate([buckets[at], pair]), np.concatenate([weight, 1 / n_pairs[pair_doc]]).astype(np.float32)


@dataclass(frozen=True)
class Model:
    #: Per bucket, what one feature adds to the logit of label 1; and the bias of the logit.
    weights: np.ndarray
    bias: float

    def scores(self, texts: pa.Array) -> np.ndarray:
        words, owner = split_words(texts)
        coded = words.dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False)
        kinds = len(coded.dictionary)
        total, times = np.zeros(kinds), np.zeros(kinds)
        for buckets, of in word_features(coded.dictionary):
            total += np.bincount(of, self.weights[buckets], minlength=kinds)
            times += np.bincount(of, minlength=kinds)
        per_word, hashes = total / np.maximum(times, 1), word_hashes(coded.dictionary)
        n = np.bincount(owner, minlength=len(texts))
        pair, pair_doc = bigram_buckets(codes, owner, hashes)
        pairs = np.bincount(pair_doc, self.weights[pair], minlength=len(texts)) / np.maximum(np.bincount(pair_doc, minlength=len(texts)), 1)
        logit = np.bincount(owner, per_word[codes], minlength=len(texts)) / np.maximum(n, 1) + pairs + self.bias
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def train(texts: list[str], labels: np.ndarray, seed: int = 13) -> Model:
    """Stochastic gradient descent on the softmax loss, by mini-batches of whole documents."""
    share = float(labels.mean()) if len(labels) else 0.5
    if not len(labels) or share in (0.0, 1.0):
        bounded = min(max(share, 1e-6), 1 - 1e-6)
        return Model(np.zeros(BUCKETS), float(np.log(bounded / (1 - bounded))))
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    output = rng.normal(0, 0.1, (2, DIM)).astype(np.float32)
    bias = np.zeros(2, dtype=np.float32)
    heat = np.full(BUCKETS, 1e-8, dtype=np.float32)  # squared gradients so far: frequent features take smaller steps
    chunks = []
    order = rng.permutation(len(texts))
    for start in range(0, len(texts), BATCH):
        rows = order[start : start + BATCH]
        doc, bucket, weight = _bags(pa.array([texts[r] for r in rows], pa.large_string()))
        used, local = np.unique(bucket, return_inverse=True)
        cells, which = np.unique(doc * len(used) + local, return_inverse=True)
        chunks.append((labels[rows], used.astype(np.int32), (cells // len(used)).astype(np.int16), (cells % len(used)).astype(np.int32), np.bincount(which, weight).astype(np.float32)))
    steps = EPOCHS * len(chunks)
    for step in range(steps):
        y, used, doc, local, weight = chunks[int(rng.integers(len(chunks)))] if step >= len(chunks) else chunks[step]
        rate = np.float32(RATE * (1 - step / steps))
        bag = np.zeros((len(y), len(used)), dtype=np.float32)
        bag[doc, local] = weight
        mean = bag @ vectors[used]
        logits = mean @ output.T + bias
        p = np.exp(logits - logits.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(len(y)), y] -= 1
        toward = p @ output
        output -= rate * (p.T @ mean) / len(y)
        bias -= rate * p.mean(axis=0)
        slope = bag.T @ toward
        heat[used] += np.square(slope).mean(axis=1)
        vectors[used] -= rate * slope / np.sqrt(heat[used])[:, None]
    delta = output[1] - output[0]
    return Model((vectors @ delta).astype(np.float64), float(bias[1] - bias[0]))


def fold(doc_id) -> F.Column:
    """crc32 of the id as text, modulo three; 0 for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS, F.lit(0))


def fit(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", label_col="quality", sample_rows: int = SAMPLE_ROWS) -> Model:
    """Learns from at most ``sample_rows`` labelled rows outside the held-out fold, none longer than ``SAMPLE_TEXT_BYTES``.

    The sample is learned from in a task, so the driver receives the model only.
    """
    chosen = (
        labels.where(F.col(label_col).isin(0, 1) & (fold(F.col(id_col)) != HELD_FOLD))
        .select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_label"))
        .orderBy(F.xxhash64("_id"), "_id", "_label").limit(sample_rows)
    )
    rows = (
        docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
        .where(F.octet_length("_text") <= SAMPLE_TEXT_BYTES).join(F.broadcast(chosen), "_id").orderBy(F.xxhash64("_id"), "_id", "_label", F.xxhash64("_text")).limit(sample_rows)
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, marks = [], []
        for batch in batches:
            texts += batch.column("_text").to_pylist()
            marks += batch.column("_label").to_pylist()
        model = train(texts, np.array(marks, dtype=np.int64))
        yield pa.RecordBatch.from_pydict({"weights": [model.weights.tobytes()], "bias": [model.bias]})

    # The sorted sample is one partition; a plan without rows may have none.
    made = rows.mapInArrow(run, "weights binary, bias double").collect()
    return Model(np.frombuffer(made[0].weights), made[0].bias) if made else train([], np.zeros(0, dtype=np.int64))


def score(docs: DataFrame, model: Model, id_col="doc_id", text_col="text", keep: tuple[str, ...] = (), with_text: bool = False) -> DataFrame:
    """Rows of (doc_id, score) and the columns in ``keep``, scored from the text alone; ``with_text`` adds it as ``_text``, empty if null."""
    slim = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"), *keep)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema if with_text or f.name != "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop in byte_slices(batch.column("_text")):
                part = batch.slice(start, stop - start)
                found = model.scores(part.column("_text"))
                rest = [x for x in part.schema.names if with_text or x != "_text"]
                yield pa.RecordBatch.from_arrays([*(part.column(x) for x in rest), pa.array(found)], [*rest, "score"])

    return slim.mapInArrow(run, f"{schema}, score double")

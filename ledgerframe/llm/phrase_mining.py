"""Phrase collocations from an FM-index per shard.

Every task cuts its texts into shards of one language each and about
``SHARD_BYTES``, indexes a shard's word ids (``word_index``) and enumerates its
phrases of up to ``max_words`` words by interval extension, with their counts.
A shard sends each bucket of phrase hashes one packed block; the blocks of a
bucket are summed, which gives exact counts over all shards. Phrases below
``min_count`` leave there: no part of a candidate is among them, since a part
occurs at least as often as the whole. Scores, longer phrases and ranks are
joins and windows over what is left.

A candidate is cut after each of its words in turn; the lowest score
``floor(1000000 a a / (l r))`` counts, ties to the earliest cut. A candidate
that lies inside a longer one with at least ``cover`` per cent of its count is
dropped. Arithmetic is in decimals of 38 digits.

Edge cases: a null language is ``und``; null, empty and blank texts have no
words; a text of any length is a shard of its own if need be; repeated rows
count each time; ties are ordered by count and then by phrase, which are unique
in a language; an empty table gives an empty result. Only the two named columns
are read, so other columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import byte_lengths, byte_slices, cut
from .word_index import levels, words_of

MIN_COUNT, MAX_WORDS, COVER, TOP = 10, 3, 50, 2000
#: Bytes of text in a shard, and bytes of all texts for each bucket of phrases.
SHARD_BYTES, BUCKET_BYTES = 6 << 20, 8 << 20

_BLOCK = pa.schema([("phrase", pa.large_string()), ("words", pa.int8()), ("count", pa.int64())])


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (a * np.uint64(0x9E3779B97F4A7C15)) ^ (b + (a >> np.uint64(29)))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(31))


def shard_blocks(texts: pa.Array, buckets: int, max_words: int) -> Iterator[tuple[int, bytes]]:
    """Pairs of bucket and packed block: the shard's phrases of that bucket with their counts."""
    words, piece = words_of(texts)
    coded = words.dictionary_encode()
    names = coded.dictionary
    hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in names.to_pylist()), dtype=np.uint64, count=len(names))
    parts = []
    for size, level in enumerate(levels(coded.indices.to_numpy(), piece, max_words), 1):
        if not len(level.count):
            continue
        key = hashes[level.words[0]]
        for more in level.words[1:]:
            key = _mixed(key, hashes[more])
        bucket = (key % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        columns = [names.take(pa.array(w[order])) for w in level.words]
        phrase = columns[0] if size == 1 else pc.binary_join_element_wise(*columns, pa.scalar(" ", pa.large_string()))
        block = pa.RecordBatch.from_arrays([phrase, pa.array(np.full(len(order), size, dtype=np.int8)), pa.array(level.count[order])], schema=_BLOCK)
        parts.append((block, np.searchsorted(bucket[order], np.arange(buckets + 1))))
    for b in range(buckets):
        some = [block.slice(at[b], at[b + 1] - at[b]) for block, at in parts if at[b + 1] > at[b]]
        if some:
            yield b, packed(some)


def packed(batches: list[pa.RecordBatch]) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, _BLOCK, options=pa.ipc.IpcWriteOptions(compression="zstd", use_threads=False)) as out:
        for batch in batches:
            out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def phrase_counts(docs: DataFrame, text_col="text", lang_col="lang", max_words: int = MAX_WORDS, min_count: int = MIN_COUNT) -> DataFrame:
    """Rows of (lang, words, phrase, f) for phrases that occur ``min_count`` times or more.

    Rows with 0 words carry no phrase: their counts sum to the language's words.
    """
    slim = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    size = slim.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, -(-size // BUCKET_BYTES))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[str, list[pa.Array]] = {}
        held: dict[str, int] = {}

        def send(lang: str) -> Iterator[pa.RecordBatch]:
            texts = pa.concat_arrays(waiting.pop(lang))
            del held[lang]
            for start, stop in byte_slices(texts, SHARD_BYTES):
                found = list(shard_blocks(texts.slice(start, stop - start), buckets, max_words))
                if found:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(found)), pa.array([b for b, _ in found], pa.int32()), pa.array([x for _, x in found], pa.binary())], ["lang", "bucket", "block"]
                    )
                pa.default_memory_pool().release_unused()

        for batch in batches:
            batch = batch.take(pc.sort_indices(batch.column("lang")))
            runs = pc.run_end_encode(batch.column("lang"))
            start = 0
            for lang, stop in zip(runs.values.to_pylist(), runs.run_ends.to_pylist(), strict=True):
                texts = batch.column("text").slice(start, stop - start).cast(pa.large_string())
                start = stop
                waiting.setdefault(lang, []).append(texts)
                held[lang] = held.get(lang, 0) + int(byte_lengths(texts).sum())
            while sum(held.values()) >= 2 * SHARD_BYTES:
                yield from send(max(held, key=held.get))
        for lang in sorted(waiting):
            yield from send(lang)

    def add_up(key: tuple, blocks: pa.Table) -> pa.Table:
        rows = pa.concat_tables(pa.ipc.open_stream(x.as_buffer()).read_all() for x in blocks.column("block"))
        n = pc.sum(rows.filter(pc.equal(rows["words"], 1))["count"]).as_py() or 0
        rows = rows.group_by(["phrase", "words"], use_threads=False).aggregate([("count", "sum")])
        rows = rows.filter(pc.greater_equal(rows["count_sum"], min_count))
        phrases = rows["phrase"].combine_chunks().cast(pa.string())
        return pa.table(
            {
                "lang": pa.array([key[0].as_py()] * (len(rows) + 1), pa.string()),
                "words": pa.concat_arrays([pa.array([0], pa.int32()), rows["words"].combine_chunks().cast(pa.int32())]),
                "phrase": pa.concat_arrays([pa.nulls(1, pa.string()), phrases]),
                "f": pa.concat_arrays([pa.array([n], pa.int64()), rows["count_sum"].combine_chunks()]),
            }
        )

    blocks = slim.mapInArrow(index, "lang string, bucket int, block binary")
    return blocks.groupBy("lang", "bucket").applyInArrow(add_up, "lang string, words int, phrase string, f long")


def _between(first, size) -> F.Column:
    """The phrase of ``size`` words from word ``first`` on (from 1) of the column ``w``."""
    return F.array_join(F.slice("w", first, size), " ")


def score_phrases(counts: DataFrame, min_count: int = MIN_COUNT, cover: int = COVER) -> DataFrame:
    """Candidates that stay: (lang, phrase, a, l, r, score, n_left, n_right).

    ``n_left`` and ``n_right`` count the candidates one word longer that go on in front and behind.
    """
    known = counts.where((F.col("words") > 0) & (F.col("f") >= min_count)).select("lang", "words", "phrase", "f")
    long = known.where("words > 1").withColumnRenamed("f", "a").withColumn("w", F.split("phrase", " "))
    cuts = long.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1))).select(
        "lang", "phrase", "a", "k", _between(F.lit(1), F.col("k")).alias("left"), _between(F.col("k") + 1, F.col("words") - F.col("k")).alias("right")
    )
    part = lambda name, f: known.select("lang", F.col("phrase").alias(name), F.col("f").alias(f))
    best = (
        cuts.join(part("left", "l"), ["lang", "left"]).join(part("right", "r"), ["lang", "right"])
        .withColumn("score", F.expr("(1000000 * cast(a as decimal(16,0)) * cast(a as decimal(16,0))) div (cast(l as decimal(18,0)) * cast(r as decimal(18,0)))"))
        .groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("best"))
    )
    spans = F.flatten(
        F.transform(
            F.sequence(F.lit(2), F.col("words") - 1),
            lambda size: F.transform(
                F.sequence(F.lit(1), F.col("words") - size + 1),
                lambda at: F.struct(
                    _between(at, size).alias("phrase"), ((at > 1) & (size == F.col("words") - 1)).alias("front"), ((at == 1) & (size == F.col("words") - 1)).alias("behind")
                ),
            ),
        )
    )
    longer = (
        long.where("words > 2").select("lang", "a", F.explode(spans).alias("s"))
        .groupBy("lang", F.col("s.phrase").alias("phrase")).agg(F.max("a").alias("most"), F.count_if("s.front").alias("n_left"), F.count_if("s.behind").alias("n_right"))
    )
    return (
        best.join(longer, ["lang", "phrase"], "left").where(F.col("most").isNull() | (100 * F.col("most") < cover * F.col("best.a")))
        .select("lang", "phrase", "best.a", "best.l", "best.r", "best.score", F.coalesce("n_left", F.lit(0)).alias("n_left"), F.coalesce("n_right", F.lit(0)).alias("n_right"))
    )


def top_phrases(scored: DataFrame, top: int = TOP) -> DataFrame:
    """The first ``top`` candidates of each language, with their ``rank``.

    Counts of coarse steps of the score tell from which step on a language needs
    its rows; the others leave before any language meets in one place.
    """
    bits = F.length(F.bin("score")) - 1
    step = scored.withColumn("_bits", bits).withColumn("step", F.col("_bits") * 32 + F.expr("shiftright(score, greatest(_bits - 4, 0))")).drop("_bits")
    falling = Window.partitionBy("lang").orderBy(F.desc("step"))
    lowest = (
        step.groupBy("lang", "step").agg(F.count("*").alias("rows")).withColumn("so_far", F.sum("rows").over(falling))
        .where(F.col("so_far") >= top).groupBy("lang").agg(F.max("step").alias("lowest"))
    )
    near = step.join(lowest, "lang", "left").where(F.col("lowest").isNull() | (F.col("step") >= F.col("lowest")))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).drop("step", "lowest")


def mine_phrases(docs: DataFrame, text_col="text", lang_col="lang", max_words: int = MAX_WORDS, min_count: int = MIN_COUNT, cover: int = COVER, top: int = TOP) -> DataFrame:
    """Rows of (lang, rank, phrase, a, l, r, n, score, n_left, n_right)."""
    counts = cut(phrase_counts(docs, text_col, lang_col, max_words, min_count))
    total = counts.where("words = 0").groupBy("lang").agg(F.sum("f").alias("n"))
    best = top_phrases(cut(score_phrases(counts, min_count, cover)), top)
    return best.join(total, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"), "n_left", "n_right"
    )

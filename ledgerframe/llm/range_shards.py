"""Sharding by sampled splitters, with shards of near-equal bytes (law ``bytes``).

Records are keyed by (hash of the text, id), so equal texts are neighbours. A
size-weighted sample of keys gives quantile splitters; records are range-
partitioned by them; ranges that turn out overfull get splitters of their own
from a denser sample. Exact sizes of the ranges then fix where each range
starts on the byte line, and running sums within ranges place every record:
a shard is one 24th of the byte line. The sample therefore only balances the
work; the shards are exact and the same on every run.

A group of equal texts stays in one shard while it is smaller than 1/50 of a
shard; a larger one is cut where the byte line says so.

The sample is bounded: about ``ranges * per_range`` keys reach the driver,
however large the table, and at most 4,096 ranges are made.

Edge cases: a null text has no bytes (size 8) and the CRC of the empty string;
null ids sort first; repeated rows are separate records; an empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

SHARDS = 24
RECORD_OVERHEAD = 8
PER_RANGE = 24
MIN_RANGES, MAX_RANGES = 256, 4096
ROWS_PER_RANGE = 250_000
#: A range is overfull beyond this many times the mean.
OVERFULL = 3
#: A group of equal texts below this part of a shard is not cut.
WHOLE_GROUP = 1 / 50
_UNIT = 1 << 40


def _weighted_sample(records: DataFrame, per_byte, salt: int) -> list[tuple[int, int]]:
    """Keys drawn with probability ``size * per_byte``, by hash, so reruns agree."""
    draw = F.pmod(F.xxhash64("h", "doc_id", F.lit(salt)), F.lit(_UNIT)) < F.col("size") * per_byte * _UNIT
    return sorted((r.h, r.k) for r in records.where(draw).select("h", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("k")).collect())


def _quantiles(sample: list[tuple[int, int]], ranges: int) -> set[tuple[int, int]]:
    return {sample[len(sample) * i // ranges] for i in range(1, ranges)} if sample else set()


def _snap(splitters: set[tuple[int, int]]) -> list[tuple[int, int]]:
    """Moves a splitter to the first key of its text, unless several fall on that text."""
    by_text: dict[int, list[int]] = {}
    for h, k in splitters:
        by_text.setdefault(h, []).append(k)
    first = -(1 << 63)
    return sorted({(h, k) for h, ks in by_text.items() for k in ([first] if len(ks) == 1 else [first, *ks])})


def _assign(records: DataFrame, splitters: list[tuple[int, int]]) -> DataFrame:
    """Adds ``rng``: how many splitters are not above the record's key."""
    sh = np.array([h for h, _ in splitters], dtype=np.int64)
    sk = np.array([k for _, k in splitters], dtype=np.int64)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = batch.column("h").to_numpy(zero_copy_only=False)
            k = batch.column("doc_id").fill_null(-(1 << 63)).to_numpy(zero_copy_only=False)
            low, high = np.searchsorted(sh, h, "left"), np.searchsorted(sh, h, "right")
            tied = np.flatnonzero(low < high)
            for at in np.unique(low[tied]):
                rows = tied[low[tied] == at]
                low[rows] += np.searchsorted(sk[at : high[rows[0]]], k[rows], "right")
            yield batch.append_column("rng", pa.array(low.astype(np.int32)))

    return records.mapInArrow(search, "doc_id long, size long, text_crc32 long, h long, rng int")


def shard_by_ranges(docs: DataFrame, id_col="doc_id", text_col="text", shards: int = SHARDS, whole_group: float = WHOLE_GROUP) -> DataFrame:
    """Rows of (doc_id, size, text_crc32, shard, slot): slot counts the shard's records from 0 in key order."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    records = cut(docs.select(
        F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + RECORD_OVERHEAD).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("h"),
    ))
    total, rows = records.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    ranges = min(MAX_RANGES, max(MIN_RANGES, rows // ROWS_PER_RANGE))
    per_byte = ranges * PER_RANGE / max(total, 1)
    splitters = _quantiles(_weighted_sample(records, per_byte, 1), ranges)

    def measured(ranged: DataFrame) -> list:
        return ranged.groupBy("rng").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).orderBy("rng").collect()

    ranged = _assign(records, _snap(splitters))
    filled = measured(ranged)
    mean_bytes, mean_rows = total / ranges, rows / ranges
    overfull = {r.rng: max(r.bytes / mean_bytes, r.n / mean_rows) for r in filled if r.bytes > OVERFULL * mean_bytes or r.n > OVERFULL * mean_rows}
    if overfull:
        dense = _assign(records, _snap(splitters)).where(F.col("rng").isin(*overfull))
        again = dense.withColumn("size", F.lit(float(total / max(rows, 1))))  # by rows: light records overfill too
        splitters |= _quantiles(_weighted_sample(again, per_byte, 2), max(2, round(sum(overfull.values()))))
        ranged = _assign(records, _snap(splitters))
        filled = measured(ranged)

    starts, at, before = [], 0, 0
    for r in filled:
        starts.append((r.rng, at, before))
        at, before = at + r.bytes, before + r.n
    in_range = Window.partitionBy("rng").orderBy("h", "doc_id", "size")
    group = Window.partitionBy("rng", "h")
    share = max(total, 1) / shards
    placed = (
        ranged
        .withColumn("upto", F.sum("size").over(in_range.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        .withColumn("nth", F.row_number().over(in_range))
        .withColumn("g_bytes", F.sum("size").over(group))
        .withColumn("g_start", F.min(F.col("upto") - F.col("size")).over(group))
        .join(F.broadcast(spark.createDataFrame(starts, "rng int, at long, before long")), "rng")
        .withColumn("middle", F.when(F.col("g_bytes") <= share * whole_group, F.col("g_start") + F.col("g_bytes") / 2).otherwise(F.col("upto") - F.col("size") / 2))
        .withColumn("shard", F.least(F.lit(shards - 1), F.floor((F.col("at") + F.col("middle")) / share)).cast("int"))
        .select("doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("nth") - 1).alias("index"))
    )
    placed = cut(placed)
    firsts = placed.groupBy("shard").agg(F.min("index").alias("first"))
    return placed.join(F.broadcast(firsts), "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("index") - F.col("first")).alias("slot"))

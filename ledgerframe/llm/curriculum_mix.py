"""Mixing sources to target weights along a time-varying curriculum.

Every source has a weight schedule over training time t in [0, 1],
``1 + slope * (2t - 1)`` times its share. The integral of the schedule is the
source's cumulative token demand; a document that covers some stretch of the
source's token stream is placed where the demand reaches the middle of the
stretch, i.e. at the inverse of the integral. Documents are then range-sorted
by position.

Shares: sources ordered by code point (null last) weigh 1, 2, 3, repeating, and
share all words; no target exceeds ``max_passes`` times the source, the excess
goes to the others by weight. The token stream of a source is its documents in
the order of the MD5 of their id, repeated; the mix takes the first
``round(target)`` words of it, so whole passes first and then a prefix of the
document order (the one document on the boundary counts in part).

Running totals are two-level: 4,096 hash buckets a source, then rows within a
bucket, so that a source with a third of all rows is spread over 4,096 groups.

Edge cases: null or empty text has size 0 and takes 0 words; a null source is a
source of its own; a null id sorts as the empty string; repeated rows are
separate documents; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, n_words

#: Weights by rank of the source, repeating, and slopes of the schedules, repeating.
WEIGHTS = (1, 2, 3)
SLOPES = (-0.8, 0.0, 0.8)
MAX_PASSES = 3
BUCKET_HEX = 3


def source_targets(sized: DataFrame, weights=WEIGHTS, max_passes: int = MAX_PASSES) -> DataFrame:
    """One row per source: source, rank, source_size, target. ``sized`` has source and size.

    The shares are the water level at which capped sources have given their
    excess to the rest: sources in order of ``cap / weight``, a source is capped
    if its cap is below its share of what the capped ones before it leave.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_cap = Window.orderBy("fill", "rank")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = (
        sized.groupBy("source").agg(F.sum("size").alias("source_size"))
        .withColumn("rank", F.row_number().over(by_name) - 1)
        .withColumn("weight", weight.cast("double"))
        .withColumn("cap", (F.col("source_size") * max_passes).cast("double"))
        .withColumn("fill", F.col("cap") / F.col("weight"))
    )
    everything = Window.partitionBy()
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_cap.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    return (
        ranked
        .withColumn("left", F.sum("source_size").over(everything).cast("double") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("weights", F.sum("weight").over(onward))
        .withColumn("capped", F.col("cap") * F.col("weights") < F.col("left") * F.col("weight"))
        .withColumn("open_left", F.max(F.when(~F.col("capped"), F.struct(-F.col("fill"), -F.col("rank"), "left", "weights"))).over(everything))
        .withColumn("target", F.when(F.col("capped"), F.col("cap")).otherwise(F.col("open_left.left") * F.col("weight") / F.col("open_left.weights")))
        .select("source", "rank", "source_size", "target")
    )


def curriculum_mix(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", weights=WEIGHTS, slopes=SLOPES, max_passes: int = MAX_PASSES) -> DataFrame:
    """Rows of (doc_id, size, source_size, target, taken, positions): positions has one
    training position in [0, 1] for each copy that the mix takes at least in part."""
    sized = cut(docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"),
        F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit(""))).alias("order"),
    ))
    targets = source_targets(sized, weights, max_passes).withColumn("words", F.floor(F.col("target") + 0.5))
    keyed = sized.withColumn("bucket", F.substring("order", 1, BUCKET_HEX))
    earlier = Window.partitionBy("b_source").orderBy("b_bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = (
        keyed.groupBy(F.col("source").alias("b_source"), F.col("bucket").alias("b_bucket")).agg(F.sum("size").alias("b_size"))
        .withColumn("b_start", F.coalesce(F.sum("b_size").over(earlier), F.lit(0)))
        .join(targets.select(F.col("source").alias("t_source"), "rank", "source_size", "target", "words"), F.col("b_source").eqNullSafe(F.col("t_source")))
    )
    upto = Window.partitionBy("source", "bucket").orderBy("order", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = (
        keyed.withColumn("in_bucket", F.sum("size").over(upto))
        .join(buckets, F.col("source").eqNullSafe(F.col("b_source")) & (F.col("bucket") == F.col("b_bucket")))
        .withColumn("start", F.col("b_start") + F.col("in_bucket") - F.col("size"))
        .withColumn("passes", F.when(F.col("source_size") > 0, F.expr("words div source_size")).otherwise(F.lit(0)))
        .withColumn("part", F.greatest(F.lit(0), F.least(F.col("size"), F.col("words") - F.col("passes") * F.col("source_size") - F.col("start"))))
        .withColumn("taken", F.col("passes") * F.col("size") + F.col("part"))
    )
    slope = F.element_at(F.array(*map(F.lit, slopes)), (F.col("rank") % len(slopes) + 1).cast("int"))
    copies = F.when(F.col("size") > 0, F.col("passes") + (F.col("part") > 0).cast("long")).otherwise(F.lit(0))

    def position(copy):
        reached = (copy * F.col("source_size") + F.col("start") + F.col("size") / F.lit(2.0)) / F.col("words")
        reached = F.least(reached, F.lit(1.0))
        root = F.sqrt((1 - slope) * (1 - slope) + 4 * slope * reached)
        return F.when(slope == 0, reached).otherwise((root - (1 - slope)) / (2 * slope))

    positions = F.when(copies > 0, F.transform(F.sequence(F.lit(0).cast("long"), copies - 1), position)).otherwise(F.array().cast("array<double>"))
    return placed.select("doc_id", "size", "source_size", "target", "taken", positions.alias("positions"))


def in_training_order(mixed: DataFrame) -> DataFrame:
    """Range-sorts documents by the position of their first copy; those not taken come last."""
    return mixed.withColumn("position", F.get("positions", F.lit(0))).orderBy(F.col("position").asc_nulls_last(), "doc_id")

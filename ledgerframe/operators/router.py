"""Which strategy a refresh goes through, by the account's provider."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .greedy import reconcile_default, reconcile_delta
from .matching import DELTA_PROVIDER, KEYS, NUMERIC_ID_PROVIDER, PROVIDER_STAGES, Stage, attribute_instructions, match_attributes

COLUMNS = [*KEYS, "strategy", "action", "stored_row", "upstream_row", "date", "fill_type"]


def _stage_plan() -> list[tuple[Stage, list[str]]]:
    """Every (place, stage) of the providers' lists once, in order, with the providers that run it there."""
    plan: dict[tuple[int, str], tuple[Stage, list[str]]] = {}
    for provider, (_, stages) in PROVIDER_STAGES.items():
        for place, stage in enumerate(stages):
            plan.setdefault((place, stage.name), (stage, []))[1].append(provider)
    return [plan[key] for key in sorted(plan)]


def _whole_cents(amount) -> F.Column:
    return (F.col(amount) * 100) % 1 == 0


def reconcile(upstream: DataFrame, stored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(instructions, failures) of all accounts with upstream rows, each by its provider's strategy.

    Upstream rows carry their account's ``provider``. Providers with matcher
    stages share one pass, in which a stage applies to the accounts that have it;
    the delta provider's booked rows become inserts; all others, and accounts
    without a provider, go by the default strategy. Instructions have keys,
    strategy, action, stored_row, upstream_row, date and fill_type. An account
    that fails has no instructions but a row (keys, strategy, outcome), and others
    go on: matching that is not sound (attributes), an amount finer than a cent
    (default).
    """
    provider = F.coalesce(F.col("provider"), F.lit(""))
    staged = provider.isin(*PROVIDER_STAGES)
    strategy = F.when(staged, "attributes").when(provider == DELTA_PROVIDER, "delta").otherwise("default")
    # a strategy that no account has is not planned at all: at most three values
    wanted = {r.strategy for r in upstream.select(strategy.alias("strategy")).distinct().collect()}
    none = F.lit(None).cast("string")
    keys = ", ".join(f"{k} {upstream.schema[k].dataType.simpleString()}" for k in KEYS)
    spark = upstream.sparkSession
    done = [spark.createDataFrame([], f"{keys}, strategy string, action string, stored_row string, upstream_row string, date date, fill_type string")]
    failed = [spark.createDataFrame([], f"{keys}, strategy string, outcome string")]

    if "attributes" in wanted:
        bounded = [name for name, (window, _) in PROVIDER_STAGES.items() if window == "booking_date"]
        stages = [(stage, provider.isin(*names)) for stage, names in _stage_plan()]
        rows = match_attributes(upstream.where(staged), stored, stages, provider.isin(*bounded), provider == NUMERIC_ID_PROVIDER)
        done.append(attribute_instructions(rows).select(
            *KEYS, F.lit("attributes").alias("strategy"), "action", F.when(F.col("action") == "DELETE", F.col("row")).alias("stored_row"),
            F.when(F.col("action") == "INSERT", F.col("row")).alias("upstream_row"), "date", "fill_type",
        ))
        failed.append(rows.where("outcome <> 'OK'").select(*KEYS, F.lit("attributes").alias("strategy"), "outcome").distinct())
    if "delta" in wanted:
        new = upstream.where(provider == DELTA_PROVIDER).withColumn("external_id", F.col("pos").cast("string"))
        done.append(reconcile_delta(new).select(*KEYS, F.lit("delta").alias("strategy"), "action", none.alias("stored_row"), F.col("row").alias("upstream_row"), "date", "fill_type"))
    if "default" in wanted:
        rest = upstream.where(~staged & (provider != DELTA_PROVIDER))
        finer = rest.where(~_whole_cents("amount")).select(*KEYS).distinct()
        default = reconcile_default(rest.join(finer, KEYS, "left_anti"), stored)
        regular = F.when(F.col("action") == "INSERT", "REGULAR")
        done.append(default.select(*KEYS, F.lit("default").alias("strategy"), "action", "stored_row", "upstream_row", "date", regular.alias("fill_type")))
        failed.append(finer.select(*KEYS, F.lit("default").alias("strategy"), F.lit("FATAL_AMOUNT_SCALE").alias("outcome")))
    one = lambda parts: reduce(lambda a, b: a.unionByName(b), parts)
    return one(done).select(*COLUMNS), one(failed)

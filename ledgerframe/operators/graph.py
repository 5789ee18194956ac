"""Connected components of an edge list, and the cuts of lineage between rounds."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_ROUNDS = 60


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage by a reliable checkpoint in the session's shared folder.

    Only a local session may go without one that is set: a folder of one machine
    is of no use to the executors of a cluster.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    return df.checkpoint()


def components(edges: DataFrame, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """Rows of (node, root): the smallest node of each node's component, for nodes of ``edges`` (a, b).

    Every node takes its neighbours' smallest label, then the label of its label,
    until no label changes; a node's edges are never gathered in one place.
    """
    both = cut(
        edges.where("a <> b").select("a", "b").unionByName(edges.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    )
    labels = cut(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("root")).withColumnRenamed("a", "node"))
    for _ in range(max_rounds):
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("root").alias("near"))
        low = labels.join(near, F.col("node") == F.col("a")).select("node", F.col("root").alias("was"), F.least("root", "near").alias("to"))
        jump = labels.select(F.col("node").alias("to"), F.col("root").alias("far"))
        moved = cut(low.join(jump, "to", "left").select("node", "was", F.least("to", "far").alias("root")))
        labels = moved.select("node", "root")
        if moved.where("root <> was").isEmpty():
            return labels
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")

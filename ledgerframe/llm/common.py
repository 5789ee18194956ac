"""Helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import cut

__all__ = ["WORD", "byte_lengths", "byte_slices", "byte_values", "cut", "gathered", "n_words", "offsets", "table"]

#: A word: a longest run of characters other than space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of a gathered cut that one task reads, about; no fewer tasks than cores read it.
GATHERED_ROWS = 4096


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def gathered(df: DataFrame, cut=cut) -> DataFrame:
    """A cut whose small partitions are read together, for short rows.

    Every task that reads a cut into a shuffle leaves files of a block each and a
    record of itself, however few rows it has, and a union has the tasks of all
    its parts. How many tasks read a cut follows its number of rows only.
    """
    seen = Observation()
    found = cut(df.observe(seen, F.count(F.lit(1)).alias("n")))
    cores = df.sparkSession.sparkContext.defaultParallelism
    return found.coalesce(max(2, cores, -(-seen.get["n"] // GATHERED_ROWS)))  # two at least: one alone would make joins run in one task


def n_words(text) -> F.Column:
    """Words in a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def byte_slices(texts: pa.Array, limit: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes each; a longer text gets a range of its own."""
    ends = np.cumsum(byte_lengths(texts))
    start = 0
    while start < len(ends):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, "right")))
        yield start, stop
        start = stop


def byte_lengths(texts: pa.Array) -> np.ndarray:
    return np.diff(np.asarray(offsets(texts), dtype=np.int64))


def offsets(texts: pa.Array) -> np.ndarray:
    """Value offsets of a string array without nulls, relative to the array's own slice."""
    kind = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    raw = texts.buffers()[1]
    if raw is None or not len(texts):
        return np.zeros(len(texts) + 1, dtype=np.int64)
    return np.frombuffer(raw, dtype=kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)


def byte_values(texts: pa.Array) -> np.ndarray:
    """The bytes of all texts of a string array without nulls, end to end."""
    at = offsets(texts)
    raw = texts.buffers()[2]
    if raw is None or at[-1] == at[0]:
        return np.zeros(0, dtype=np.uint8)
    return np.frombuffer(raw, dtype=np.uint8)[at[0] : at[-1]]

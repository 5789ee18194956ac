"""Exact top-k by inner product with vector-approximation files.

Every component of a vector is quantised to one of ``CELLS`` cells of equal
width over the table's value range; one byte a component, in packed blocks of
``BLOCK`` rows, is the approximation file. The work has four steps:

1. The file is scanned for all queries, a block of it against a block of
   queries at a time. The product with the cell middles, plus half a cell times
   the query's absolute sum, bounds a candidate's score. The ``k`` best bounds
   of a query are kept.
2. The exact vectors of those are read; the k-th of their scores is reached by
   the true k-th for certain.
3. The file is scanned again: candidates whose bound is below that score are
   ruled out, whatever their exact vectors hold.
4. The exact vectors of the rest are read, and the k best of them are the answer.

Exact vectors are shuffled by row to the blocks that ask for them, so a vector
that no bound admits is sent to no block. Blocks bound every group, however many
candidates a query is left with.

Edge cases: vectors that are null, empty, or hold a null or non-finite
component, and rows with a null id, take no part; vectors of another length
than the query's are no candidates. A row is known by a number of its own, so
repeats of an id or of a whole row are rows like any other: each asks, each is
a candidate of all others, and an id that asks twice has two lists. A query with
fewer than k candidates returns all; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

SCALE = 64
CELLS = 32
BLOCK, QUERY_BLOCK = 4096, 512
PAIR = "dim int, qb int, cb int, asker long, n long, bound double"
SCORED = "asker long, query_id long, vec_id long, score long"


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    lists = column.combine_chunks()
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def bounds(queries: np.ndarray, cells: np.ndarray, low: int, width: int) -> np.ndarray:
    """Upper bounds of the products of all queries with all candidates, known by their cells."""
    middles = cells * np.float64(width) + (low + (width - 1) / 2)
    weight = np.abs(queries).sum(axis=1, dtype=np.float64)
    slack = weight * ((width - 1) / 2) + 1e-9 * (1 + weight * np.abs(middles).max(initial=1))
    return queries.astype(np.float64) @ middles.T + slack[:, None]


def _packed(rows: DataFrame, block: str, values: str, dtype: str) -> DataFrame:
    """One row for each block: its row numbers, its k-th scores, and its vectors as bytes."""

    def pack(group: pa.Table) -> pa.Table:
        first = group.slice(0, 1)
        return pa.table({
            "dim": first.column("dim"), block: first.column(block), "ns": [group.column("n").to_numpy().astype("<i8").tobytes()],
            "least": [group.column("least").to_numpy().astype("<f8").tobytes()], "values": [_matrix(group.column(values)).astype(dtype).tobytes()],
        })

    return rows.select("dim", block, "n", "least", values).groupBy("dim", block).applyInArrow(pack, f"dim int, {block} int, ns binary, least binary, values binary")


def _admitted(asking: DataFrame, file: DataFrame, blocks: int, low: int, width: int, k: int | None) -> DataFrame:
    """Scans the file: the ``k`` best bounds of a query in each block, or without ``k`` all that reach its least score."""
    pairs = (
        asking.select("dim", "qb", F.col("ns").alias("q_ns"), "least", F.col("values").alias("q_values"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("cb"))
        .join(file.select("dim", "cb", "ns", "values"), ["dim", "cb"])
    )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                raw = {name: batch.column(name)[row].as_py() for name in batch.schema.names}
                askers, ns = np.frombuffer(raw["q_ns"], "<i8"), np.frombuffer(raw["ns"], "<i8")
                queries = np.frombuffer(raw["q_values"], "<i8").reshape(len(askers), -1)
                upper = bounds(queries, np.frombuffer(raw["values"], np.uint8).reshape(len(ns), -1), low, width)
                _, own, itself = np.intersect1d(askers, ns, assume_unique=True, return_indices=True)
                upper[own, itself] = -np.inf
                if k is None:
                    at, of = np.nonzero((upper >= np.frombuffer(raw["least"], "<f8")[:, None]) & (upper > -np.inf))
                else:
                    best = np.argpartition(-upper, k - 1, axis=1)[:, :k] if k < len(ns) else np.broadcast_to(np.arange(len(ns)), upper.shape)
                    at, of = np.repeat(np.arange(len(askers)), best.shape[1]), best.ravel()
                    real = upper[at, of] > -np.inf
                    at, of = at[real], of[real]
                yield pa.RecordBatch.from_pydict({
                    **{name: pa.array(np.full(len(at), raw[name], dtype=np.int32)) for name in ("dim", "qb", "cb")},
                    "asker": pa.array(askers[at]), "n": pa.array(ns[of]), "bound": pa.array(upper[at, of]),
                })

    return pairs.mapInArrow(scan, PAIR)


def exact_scores(admitted: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """Reads the exact vectors of admitted pairs; each query's k best in each block of candidates."""
    place = ["dim", "qb", "cb"]
    wanted = admitted.select(*place, F.explode(F.array("n", "asker")).alias("n")).distinct()
    vectors = wanted.join(rows.select("n", "vec_id", "v"), "n").select(*(F.col(c).alias(f"at_{c}") for c in place), "n", "vec_id", "v")

    def score(pairs: pa.Table, read: pa.Table) -> pa.Table:
        ns = read.column("n").to_numpy()
        order = np.argsort(ns)
        exact, ids = _matrix(read.column("v"))[order], read.column("vec_id").to_numpy()[order]
        asker = pairs.column("asker").to_numpy()
        q, c = (np.searchsorted(ns[order], pairs.column(name).to_numpy()) for name in ("asker", "n"))
        scores = np.empty(len(q), dtype=np.int64)
        for start in range(0, len(q), 1 << 15):
            part = slice(start, start + (1 << 15))
            scores[part] = np.einsum("pd,pd->p", exact[q[part]], exact[c[part]])
        best = np.lexsort((ids[c], -scores, asker))
        nth = np.arange(len(best)) - np.searchsorted(asker[best], asker[best])
        best = best[nth < k]
        return pa.table({"asker": asker[best], "query_id": ids[q[best]], "vec_id": ids[c[best]], "score": scores[best]})

    return admitted.groupBy(*place).cogroup(vectors.groupBy(*(f"at_{c}" for c in place))).applyInArrow(score, SCORED)


def _first(rows: DataFrame, k: int, *order: Column) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("asker").orderBy(*order))).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, is_query, k: int = 20, id_col="vec_id", vector_col="embedding", scale: int = SCALE) -> DataFrame:
    """Rows of (query_id, rank, vec_id, score): each query row's k best among all other rows."""
    x = F.col(vector_col).cast("array<double>")
    usable = F.col(vector_col).isNotNull() & (F.size(x) > 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = cut(
        vectors.where(usable & F.col(id_col).isNotNull())
        .select(F.col(id_col).cast("long").alias("vec_id"), F.transform(x, lambda v: F.floor(v * scale)).alias("v"), is_query.alias("asks"))
        .withColumns({"dim": F.size("v"), "n": F.monotonically_increasing_id()})
    )
    shape = rows.agg(F.count("*"), F.count_if("asks"), F.min(F.array_min("v")), F.max(F.array_max("v"))).first()
    if not shape[1]:
        return rows.select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0).cast("long").alias("score")).limit(0)
    low, width = int(shape[2]), max(1, -(-(int(shape[3]) - int(shape[2]) + 1) // CELLS))
    blocks, query_blocks = -(-shape[0] // BLOCK), -(-shape[1] // QUERY_BLOCK)
    none = F.lit(float("-inf"))

    def dealt(n: int) -> Column:
        return F.pmod(F.xxhash64("n"), F.lit(n)).cast("int")

    cells = F.transform("v", lambda c: F.floor((c - low) / width).cast("tinyint"))
    file = cut(_packed(rows.select("dim", "n", dealt(blocks).alias("cb"), none.alias("least"), cells.alias("cells")), "cb", "cells", "u1"))
    asking = rows.where("asks").select("dim", "n", dealt(query_blocks).alias("qb"), none.alias("least"), "v")

    def scan(queries: DataFrame, best: int | None) -> DataFrame:
        return _admitted(_packed(queries, "qb", "v", "<i8"), file, blocks, low, width, best)

    ahead = cut(_first(scan(asking, k), k, F.col("bound").desc(), F.col("n")).drop("rank"))
    read = exact_scores(ahead, rows, k)
    least = read.groupBy(F.col("asker").alias("n")).agg(F.when(F.count("*") >= k, F.min("score").cast("double")).alias("kth"))
    certain = asking.join(least, "n", "left").select("dim", "n", "qb", F.coalesce("kth", "least").alias("least"), "v")
    left = cut(scan(certain, None).drop("bound"))
    best = _first(exact_scores(left, rows, k), k, F.col("score").desc(), F.col("vec_id"))
    return best.select("query_id", "rank", "vec_id", "score")

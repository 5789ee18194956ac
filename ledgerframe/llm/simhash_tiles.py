"""SimHash near-duplicates by tiled exact comparison.

Every whole text gets a 64-bit fingerprint of its word shingles. Equal
fingerprints collapse to one row each; the distinct ones are dealt to tiles by
the population counts of their two halves (four quarters in large tables):
fingerprints within ``radius`` bits differ by at most ``radius`` in the sum of
those counts too, so all other pairs of tiles are skipped. Large tiles are cut to about ``TILE_ROWS`` rows by hash. Each tile meets itself
and the tiles whose counts are within the radius, as an equi-join of packed
tiles; every pair of tiles is compared in numpy by exclusive-or and bit counts,
and gives a spanning forest of its links, never the pairs themselves. Connected
components then come from alternating large-star and small-star rounds over the
forest edges, with checkpoints between rounds.

A shingle is ``shingle`` words joined by single spaces, after lower-casing A-Z;
a text with fewer words is one shingle; a text without words (null, empty or
only white space) has fingerprint zero and links like any other. Hashes are
XXH64 of the UTF-8 bytes with seed 42; a bit is set if more than half of the
shingles' hashes have it.

Edge cases: repeated rows and ties share a fingerprint and so a component; a
null id counts as larger than any other and its component has the smallest real
id, or null if it has none; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_slices, cut

SHINGLE, RADIUS, SEED = 4, 4, 42
TILE_ROWS = 4096
#: Population counts that share a tile class.
CLASS_WIDTH = 2
#: From so many distinct fingerprints on, tiles go by the counts of four parts instead of two: fewer
#: pairs to compare, but in a small table thousands of tiles of a few rows each.
FINE_ROWS = 1 << 18
#: A key with more than one row in so many is hot: at most so many keys are, whatever the table's size.
HOT_SHARE = 1000
MAX_ROUNDS = 60


def fingerprints(texts: list[str], shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """One 64-bit fingerprint a text."""
    digest = xxhash.xxh64_intdigest
    hashes: list[int] = []
    counts = np.zeros(len(texts), dtype=np.int64)
    for row, text in enumerate(texts):
        words = text.encode().lower().split()  # bytes: ASCII letters and white space only
        if not words:
            continue
        if len(words) < shingle:
            hashes.append(digest(b" ".join(words), seed))
            counts[row] = 1
            continue
        line = b" ".join(words)
        ends = np.cumsum([len(w) + 1 for w in words]) - 1
        starts = [0, *(ends[: len(words) - shingle] + 1).tolist()]
        hashes += [digest(line[a:b], seed) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)]
        counts[row] = len(starts)
    return voted(np.array(hashes, dtype=np.uint64), counts)


def voted(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The fingerprint of each run of ``counts`` hashes: the bits that more than half of them have."""
    out = np.zeros(len(counts), dtype=np.uint64)
    some = np.flatnonzero(counts)
    if len(some):
        at = np.cumsum(counts[some]) - counts[some]
        for bit in range(64):
            ones = np.add.reduceat((hashes >> np.uint64(bit)) & np.uint64(1), at, dtype=np.int64)
            out[some] |= (2 * ones > counts[some]).astype(np.uint64) << np.uint64(bit)
    return out


def with_fingerprint(docs: DataFrame, id_col="doc_id", text_col="text", shingle: int = SHINGLE) -> DataFrame:
    """Rows of (doc_id, fp): the fingerprint as a signed long."""
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop in byte_slices(batch.column("text")):
                part = batch.slice(start, stop - start)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fingerprints(part.column("text").to_pylist(), shingle).view(np.int64))], ["doc_id", "fp"])

    return slim.mapInArrow(run, "doc_id long, fp long")


def forest(a: np.ndarray, b: np.ndarray, radius: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links within ``radius`` bits between two tiles, as pairs of rows of [a, b].

    Links are hooked into the forest strip by strip, so a tile of near copies needs no list of its pairs.
    """
    n = len(a)
    root = np.arange(n if same else n + len(b))
    step = max(1, (1 << 18) // max(1, len(b)))
    for start in range(0, n, step):
        x, y = np.nonzero(np.bitwise_count(a[start : start + step, None] ^ b[None, :]) <= radius)
        x, y = x + start, y if same else y + n
        while True:
            rx, ry = root[x], root[y]
            apart = np.flatnonzero(rx != ry)
            if not len(apart):
                break
            x, y, rx, ry = x[apart], y[apart], rx[apart], ry[apart]
            np.minimum.at(root, np.maximum(rx, ry), np.minimum(rx, ry))
            while (root[root] != root).any():
                root = root[root]
    member = np.flatnonzero(root != np.arange(len(root)))
    return member, root[member]


def _class_of(parts: int) -> F.Column:
    """The population counts of the fingerprint's ``parts`` equal parts, by pairs of counts."""
    bits = 64 // parts
    count = lambda k: F.bit_count(F.shiftrightunsigned("fp", bits * k).bitwiseAND(F.lit((1 << bits) - 1)))
    return F.struct(*(F.floor(count(k) / CLASS_WIDTH).cast("int").alias(f"c{k}") for k in range(parts)))


def _near_classes(radius: int, parts: int) -> list[tuple[int, ...]]:
    """Offsets between classes whose counts may differ by no more than the radius in sum; one of each pair of opposites."""
    reach = (radius + CLASS_WIDTH - 1) // CLASS_WIDTH
    least = lambda d: max(0, (abs(d) - 1) * CLASS_WIDTH + 1)
    return [d for d in product(range(-reach, reach + 1), repeat=parts) if sum(map(least, d)) <= radius and d >= (0,) * parts]


def tile_links(distinct: DataFrame, radius: int = RADIUS, tile_rows: int = TILE_ROWS) -> DataFrame:
    """Forest edges (a, b) between distinct fingerprints (column fp) within ``radius`` bits."""
    parts = 2 if distinct.count() < FINE_ROWS else 4
    classes = distinct.select("fp", _class_of(parts).alias("class"))
    sizes = classes.groupBy("class").agg(F.ceil(F.count("*") / tile_rows).cast("int").alias("cuts"))  # at most 9^4 or 17^2 classes, whatever the table's size
    tiles = cut(
        classes.join(F.broadcast(sizes), "class")
        .groupBy("class", F.pmod(F.xxhash64("fp"), F.col("cuts")).cast("int").alias("cut")).agg(F.sort_array(F.collect_list("fp")).alias("fps"))
    )

    def struct_of(values):
        return F.struct(*(v.cast("int").alias(f"c{k}") for k, v in enumerate(values)))

    offsets = F.array(*(struct_of(map(F.lit, d)) for d in _near_classes(radius, parts)))
    met = sizes.select(F.col("class").alias("b_class"), "cuts")
    asked = (
        tiles.select("class", "cut", F.explode(offsets).alias("d"))
        .withColumn("b_class", struct_of(F.col(f"class.c{k}") + F.col(f"d.c{k}") for k in range(parts)))
        .join(F.broadcast(met), "b_class").withColumn("b_cut", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
        .where((F.col("class") != F.col("b_class")) | (F.col("cut") <= F.col("b_cut")))
        .select("class", "cut", "b_class", "b_cut")
    )
    # By pairs of tiles, in a fixed number of parts: comparing costs more than its bytes tell.
    spread = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = (
        asked.join(tiles.withColumnRenamed("fps", "a"), ["class", "cut"])
        .join(tiles.select(F.col("class").alias("b_class"), F.col("cut").alias("b_cut"), F.col("fps").alias("b")), ["b_class", "b_cut"])
        .repartition(spread, "class", "cut", "b_class", "b_cut")
        .select("a", "b", ((F.col("class") == F.col("b_class")) & (F.col("cut") == F.col("b_cut"))).alias("same"))
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                a, b = (batch.column(x)[row].values.to_numpy().view(np.uint64) for x in ("a", "b"))
                same = batch.column("same")[row].as_py()
                member, root = forest(a, b, radius, same)
                if len(member):
                    both = (a if same else np.concatenate([a, b])).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(both[member]), pa.array(both[root])], ["a", "b"])

    return pairs.mapInArrow(compare, "a long, b long").distinct()


def components(edges: DataFrame, max_rounds: int = MAX_ROUNDS, save=cut) -> DataFrame:
    """Rows of (node, root): the smallest node of each node's component, for nodes with an edge.

    Alternates large-star and small-star until the edges no longer change; ``save`` cuts the lineage between rounds.
    """
    edges = save(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    before = None
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        edges = save(small)
        state = edges.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def looked_up(rows: DataFrame, found: DataFrame, key: str, total: int) -> DataFrame:
    """``rows``, ``total`` of them, with the columns of ``found``, which has one row for each key and the number ``n`` of its rows.

    Rows of hot keys, at most ``HOT_SHARE`` keys, take them from a broadcast; no task gets a hot key's rows.
    """
    hot = F.col("n") * HOT_SHARE > total
    few = found.where(hot).drop("n")
    rest = rows.join(F.broadcast(few.select(key)), key, "left_anti").join(found.where(~hot).drop("n"), key)
    return rows.join(F.broadcast(few), key).unionByName(rest)


def near_duplicates(docs: DataFrame, id_col="doc_id", text_col="text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """Rows of (doc_id, fp, component_id): the smallest id that links reach from the document."""
    marked = cut(with_fingerprint(docs, id_col, text_col, shingle))
    distinct = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")))
    kinds, total = distinct.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    found = components(tile_links(distinct.select("fp"), radius))
    rooted = cut(distinct.join(found, F.col("fp") == F.col("node"), "left").select("fp", "first", "n", F.coalesce("root", "fp").alias("root")))
    lowest = cut(rooted.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("n")))
    named = cut(looked_up(rooted.select("fp", "root", F.col("n").alias("copies")), lowest, "root", kinds).select("fp", "component_id", F.col("copies").alias("n")))
    return looked_up(marked, named, "fp", total).select("doc_id", "fp", "component_id")

"""Groups of documents whose sets of word shingles are similar, exactly.

Two documents are linked if the Jaccard similarity of their sets of
``SHINGLE``-word shingles is 4/5 or more; groups are the connected components.
The first pairs are operator 10's: sets with equal fingerprints, or linked by its
tiles. Similar sets may be many bits apart, so the others come from prefixes:
with all shingles in one global order, sets of that similarity share a shingle
among the first n - ceil(4n/5) + 1 of either. The order puts shingles that a
sample lists as common last; the sample moves work only, never results.

Equal sets collapse to one row each, and prefix shingles held by the same sets to
one list. Every set is first compared with one set of each of its lists; then
those without the label that most sets of a list have (labels are smallest
neighbours, a few steps away) with ``NEXT_CENTRES`` sets that have it; what is
still apart is compared with all sets of the list outside its own label, if they
share enough prefix shingles: what lies behind the prefixes holds too few. Pairs
with one label need no test, so a large group of near copies costs few
comparisons, and no pair that could join two components is left out. Candidates
(already where they meet) whose parity bits differ in more places than similar sets can differ in members
are dropped; every link is confirmed on the whole sets.

Texts are never shuffled: whole sets are made where the texts are read, for
documents that a bit filter of fixed size lets through. What the filter passes in
vain costs work and changes nothing.

A shingle is ``SHINGLE`` words joined by single spaces, after lower-casing A-Z; a
text with fewer words is one shingle; texts without words are equal. Hashes are
XXH64 of the UTF-8 bytes with seed 42.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import byte_slices, cut, gathered
from .simhash_tiles import SEED, components, looked_up, tile_links, voted

SHINGLE = 5
#: Common shingles that the order knows, at most, and the share of the documents they are counted in (one in so many).
COMMON, SAMPLED = 1 << 19, 16
#: Words of 64 parity bits a set, and bits of the filter of documents whose whole sets are wanted.
PARITIES, FILTER_BITS = 16, 1 << 25
#: Sets with a shingle's most frequent label that its sets of other labels are compared with before they meet all.
NEXT_CENTRES = 12


def shingle_hashes(text: str) -> np.ndarray:
    """The hashes of a text's shingles, repeats included."""
    words = text.encode().lower().split()  # bytes: ASCII letters and white space only
    if not words:
        return np.zeros(0, dtype=np.uint64)
    digest, line = xxhash.xxh64_intdigest, b" ".join(words)
    if len(words) <= SHINGLE:
        return np.array([digest(line, SEED)], dtype=np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[: len(words) - SHINGLE] + 1).tolist()]
    return np.array([digest(line[a:b], SEED) for a, b in zip(starts, ends[SHINGLE - 1 :].tolist(), strict=True)], dtype=np.uint64)


def shingle_set(text: str) -> np.ndarray:
    """The distinct hashes of a text's shingles, ascending."""
    return np.unique(shingle_hashes(text))


def _mapped(docs: DataFrame, make, schema: str) -> DataFrame:
    """``make`` applied to slices of the batches, with the hashes of their texts' shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop in byte_slices(batch.column("text")):
                part = batch.slice(start, stop - start)
                yield make(part, [shingle_hashes(t) for t in part.column("text").to_pylist()])

    return docs.mapInArrow(run, schema)


def _lists(values: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate(([0], np.cumsum([len(v) for v in values]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*values, np.zeros(0, dtype=np.uint64)]).view(np.int64)))


def common_shingles(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The commonest shingles of a sample, ascending, and how common each is, as a power of two.

    No more than ``COMMON`` of them, whatever the number of documents: a shingle
    counts from the lowest power on at which that many are left at most.
    """

    def hashes(part: pa.RecordBatch, found: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.unique(h) for h in found]).view(np.int64))], ["shingle"])

    sample = docs.where(F.pmod(F.xxhash64("key"), F.lit(SAMPLED)) == 0).select("text")
    level = F.floor(F.log2("n")).cast("int").alias("level")
    counted = cut(_mapped(sample, hashes, "shingle long").groupBy("shingle").agg(F.count("*").alias("n")).where("n > 1").select("shingle", level))
    left, lowest = COMMON, 64
    for row in counted.groupBy("level").count().orderBy(F.desc("level")).collect():
        left -= row["count"]
        if left < 0:
            break
        lowest = row.level
    found = counted.where(F.col("level") >= lowest).toArrow()
    shingles = found["shingle"].to_numpy().view(np.uint64)
    order = np.argsort(shingles)
    return shingles[order], found["level"].to_numpy()[order].astype(np.uint8)


def _ranks(found: np.ndarray, common: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """How common each shingle is; zero for those that the sample does not list."""
    shingles, levels = common
    if not len(shingles):
        return np.zeros(len(found), dtype=np.uint8)
    at = np.minimum(np.searchsorted(shingles, found), len(shingles) - 1)
    return np.where(shingles[at] == found, levels[at], 0)


def _parities(found: np.ndarray) -> np.ndarray:
    """Bit k is odd if an odd number of members fall to k: two sets differ in as many members as bits, at least."""
    odd = np.bincount((found >> np.uint64(65 - (64 * PARITIES).bit_length())).astype(np.int64), minlength=64 * PARITIES) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _prefixed(docs: DataFrame, common: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """Rows of (key, doc_id, sig, fp, size, prefix, parity): ``sig`` names the set of shingles, ``fp`` is operator 10's fingerprint."""

    def make(part: pa.RecordBatch, found: list[np.ndarray]) -> pa.RecordBatch:
        prints = voted(np.concatenate(found), np.array([len(h) for h in found], dtype=np.int64))
        sets = [np.unique(h) for h in found]
        sigs = np.array([_signature(s) for s in sets], dtype=np.uint64).view(np.int64)
        prefixes = [s[np.lexsort((s, _ranks(s, common)))[: len(s) - -(-4 * len(s) // 5) + 1]] for s in sets]
        made = {"sig": pa.array(sigs), "fp": pa.array(prints.view(np.int64)), "size": pa.array([len(s) for s in sets], pa.int32()), "prefix": _lists(prefixes), "parity": _lists([_parities(s).view(np.uint64) for s in sets])}
        return pa.RecordBatch.from_pydict({"key": part.column("key"), "doc_id": part.column("doc_id"), **made})

    return _mapped(docs, make, "key long, doc_id long, sig long, fp long, size int, prefix array<long>, parity array<long>")


def _alike(a: str, b: str):
    """Whether two sets' sizes allow the similarity."""
    return 5 * F.least(a, b) >= 4 * F.greatest(a, b)


def _odd_apart(a: str, b: str):
    """In how many of their parity bits two sets differ."""
    return sum((F.bit_count(F.get(a, F.lit(k)).bitwiseXOR(F.get(b, F.lit(k)))) for k in range(PARITIES)), F.lit(0))


def _filter_place(key: str):
    return F.pmod(F.xxhash64(F.col(key), F.lit(1)), F.lit(FILTER_BITS))


def _filter_of(keys: DataFrame) -> np.ndarray:
    """Bits at the places of the keys: ``FILTER_BITS`` of them whatever the number of keys."""
    place = _filter_place("key") + 1  # the bitmap functions count from one
    rows = keys.groupBy(F.bitmap_bucket_number(place).alias("nth")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")).collect()
    out = np.zeros(FILTER_BITS // 8, dtype=np.uint8)
    for row in rows:
        size = len(row.bits)
        out[(row.nth - 1) * size : row.nth * size] = np.frombuffer(row.bits, dtype=np.uint8)
    return out


def _pack(found: np.ndarray) -> bytes:
    """The low six bytes of each hash, ascending: enough to tell the members of two sets apart."""
    low = np.sort(found & np.uint64((1 << 48) - 1))
    return np.ascontiguousarray(low.view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _unpack(blob: bytes) -> np.ndarray:
    out = np.zeros((len(blob) // 6, 8), dtype=np.uint8)
    out[:, :6] = np.frombuffer(blob, dtype=np.uint8).reshape(-1, 6)
    return out.reshape(-1).view(np.uint64)


def _signature(found: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(found.tobytes(), SEED)


def _whole_sets(docs: DataFrame, wanted: np.ndarray) -> DataFrame:
    """Rows of (sig, packed) for the documents (key, text) that the filter lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column("place").to_numpy()
            batch = batch.filter(pa.array(wanted[at >> 3] >> (at & 7).astype(np.uint8) & 1 > 0))
            for start, stop in byte_slices(batch.column("text")):
                sets = [shingle_set(t) for t in batch.column("text").slice(start, stop - start).to_pylist()]
                sigs = np.array([_signature(x) for x in sets], dtype=np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(sigs), pa.array([_pack(x) for x in sets], pa.binary())], ["sig", "packed"])

    return docs.select(_filter_place("key").alias("place"), "text").mapInArrow(run, "sig long, packed binary")


def _similar(pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose packed sets ``x`` and ``y`` have the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
                x, y = _unpack(x), _unpack(y)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(5 * both >= 4 * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.mapInArrow(run, "a long, b long")


def _gathered(df: DataFrame) -> DataFrame:
    return gathered(df, cut)


def _labels(links: DataFrame) -> DataFrame:
    """Rows of (node, root) for nodes of links: the smallest node within three steps, and from that on within three more.

    Nodes with one label are of one component; not all of a component need have
    it, which costs comparisons and changes nothing.
    """
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("root"))
    for _ in range(2):
        near = both.join(near.select(F.col("a").alias("b"), "root"), "b").groupBy("a").agg(F.min("root").alias("root"))
    near = _gathered(near)
    return near.join(near.select(F.col("a").alias("root"), F.col("root").alias("far")), "root").select(F.col("a").alias("node"), F.col("far").alias("root"))


def _pair(a: str, b: str):
    return F.least(a, b).alias("a"), F.greatest(a, b).alias("b")


def _near_prints(named: DataFrame) -> DataFrame:
    """Pairs (a, b) of sets by operator 10: a set and the first of its fingerprint, and the first ones of fingerprints that its tiles link."""
    prints = _gathered(named.groupBy("fp").agg(F.min("sig").alias("first"), F.count("*").alias("n")))
    total = prints.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    first_of = lambda c: prints.select(F.col("fp").alias(c), F.col("first").alias(f"{c}_first"))
    linked = tile_links(prints.select("fp")).join(first_of("a"), "a").join(first_of("b"), "b").select(*_pair("a_first", "b_first"))
    return looked_up(named.select("sig", "fp"), prints, "fp", total).where("sig <> first").select(*_pair("sig", "first")).unionByName(linked)


def similar_groups(docs: DataFrame) -> DataFrame:
    """Rows of (key, doc_id, root), one for each row of (key, doc_id, text): rows with one root are of one group."""
    whole = docs.select("key", F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    marked = cut(_prefixed(whole, common_shingles(whole)))
    named = _gathered(marked.groupBy("sig").agg(F.min("key").alias("key"), F.first("size").alias("size"), F.first("parity").alias("parity"), F.min("fp").alias("fp")))
    per_token = Window.partitionBy("token")
    prefixes = lambda rows: rows.join(named.select("sig", "key"), ["sig", "key"], "left_semi").dropDuplicates(["sig", "key"]).select("sig", "size", "prefix")
    postings = prefixes(marked).select("sig", F.posexplode("prefix").alias("pos", "token"))
    held = {"n": F.count("*"), "c_sig": F.min("sig"), "holders": F.bit_xor(F.xxhash64("sig"))}
    # Shingles held by the same sets are one: a pair meets there once, at the earliest place.
    shared = _gathered(
        postings.withColumns({c: v.over(per_token) for c, v in held.items()}).where("n > 1")
        .groupBy(F.xxhash64(*held).alias("token"), "sig", "n", "c_sig").agg(F.min("pos").alias("pos"))
    )

    def confirmed(pairs: DataFrame) -> DataFrame:
        side = lambda c: named.select(F.col("sig").alias(c), F.col("size").alias(f"{c}_size"), F.col("parity").alias(f"{c}_parity"))
        fits = _alike("a_size", "b_size") & (9 * _odd_apart("a_parity", "b_parity") <= F.col("a_size") + F.col("b_size"))
        close = _gathered(pairs.join(side("a"), "a").join(side("b"), "b").where(fits).select("a", "b"))
        members = close.select(F.col("a").alias("sig")).unionByName(close.select(F.col("b").alias("sig"))).distinct()
        wanted = _filter_of(named.select("sig", "key").join(members, "sig", "left_semi"))
        sets = _whole_sets(whole, wanted)  # the filter may pass a set twice: that repeats a link
        of = lambda c, name: sets.select(F.col("sig").alias(c), F.col("packed").alias(name))
        return _similar(close.join(of("b", "y"), "b").join(of("a", "x"), "a"))

    centred = shared.where("sig <> c_sig").select(*_pair("sig", "c_sig"))
    tried = _gathered(_near_prints(named).unionByName(centred).distinct())
    links = _gathered(confirmed(tried))
    facts = shared.where("n > 2").join(named.select("sig", "size", "parity"), "sig").select("token", "pos", "sig", "size", "parity")  # of two, one is the centre

    def placed() -> DataFrame:
        """The sets of a shingle with their label, and the label that most of them have."""
        rooted = facts.join(_labels(links), F.col("sig") == F.col("node"), "left").withColumn("root", F.coalesce("root", "sig")).drop("node")
        counted = rooted.withColumn("most", F.struct(F.count("*").over(Window.partitionBy("token", "root")), "root"))
        return _gathered(counted.withColumn("most", F.max("most").over(Window.partitionBy("token"))["root"]))

    near_sets = _alike("size", "o_size") & (9 * _odd_apart("parity", "o_parity") <= F.col("size") + F.col("o_size"))
    # The first shingle that similar sets share has all that they need to share at or behind it, in either set.
    need = F.ceil(4 * (F.col("size") + F.col("o_size")) / 9)
    early = (F.col("size") - F.col("pos") >= need) & (F.col("o_size") - F.col("o_pos") >= need)

    def met(places: DataFrame, others: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Untried pairs of the sets without the label that most have and those of ``others`` at one shingle, and which of them may be similar."""
        apart = places.where("root <> most").select("token", *(F.col(c).alias(f"o_{c}") for c in ("pos", "sig", "size", "root", "parity")))
        pairs = apart.join(others, "token").where((F.col("root") != F.col("o_root")) & early & near_sets).select(*_pair("sig", "o_sig")).distinct()
        fresh = _gathered(pairs.join(tried, ["a", "b"], "left_anti"))
        asked = prefixes(marked.join(fresh.select(F.col("a").alias("sig")).unionByName(fresh.select(F.col("b").alias("sig"))).distinct(), "sig", "left_semi"))
        of_set = lambda c: asked.select(F.col("sig").alias(c), F.col("size").alias(f"{c}_size"), F.col("prefix").alias(f"{c}_prefix"))
        # In both sets, but not in both prefixes, are no more than lie behind the longer prefix.
        behind = F.expr("(4 * greatest(a_size, b_size) + 4) div 5 - 1")
        enough = 9 * (F.size(F.array_intersect("a_prefix", "b_prefix")) + behind) >= 4 * (F.col("a_size") + F.col("b_size"))
        return fresh, fresh.join(of_set("a"), "a").join(of_set("b"), "b").where(enough).select("a", "b")

    places = placed()
    nth = F.row_number().over(Window.partitionBy("token").orderBy(F.xxhash64("sig", "token")))
    fresh, pairs = met(places, places.where("root = most").withColumn("nth", nth).where(F.col("nth") <= NEXT_CENTRES).drop("nth"))
    links, tried = _gathered(links.unionByName(confirmed(pairs))), tried.unionByName(fresh)
    places = placed()
    links = links.unionByName(confirmed(met(places, places)[1]))
    linked = components(links, save=_gathered)
    return marked.select("key", "doc_id", "sig").join(linked, F.col("sig") == F.col("node"), "left").select("key", "doc_id", F.coalesce("root", "sig").alias("root"))

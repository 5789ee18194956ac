"""Trie of conversation prefixes by collapse of whole sequences.

Conversations are rebuilt first: conversation c begins with the first h turns
of the first conversation of its block of a hundred, h = crc32(c) mod 6, and
goes on with its own turns after its first h. A turn travels as a digest of
role and text and the text's length; the text itself is never shuffled.

Every prefix has a key, a digest of the key before it and the turn, made in a
stream over the sorted turns. Conversations with the same last key are one
sequence, with its number of copies, its smallest member and a digest of its
members' ids. From here on a sequence is one row a prefix, however many copies
it has. Sequences whose key is no other prefix's parent are the leaves (an anti
join); weighted prefixes sum up to nodes. A node's saving belongs to the
sequence of its smallest member, so sums from the end of that sequence, added
up over the sequences of a prefix, are the sums over its subtree.

Edge cases: rows without a conversation id belong to none and are left out; a
null turn comes first, a null role or text is empty; turns that tie go by their
digest, and repeated rows are turns of their own; a conversation without turns
after rebuilding is a member of the root alone; an empty table has no node.
Negative ids are cut towards zero, as SQL's remainder does. One conversation's
turns are sorted and streamed by one task (they may spill, and are never
gathered); so are the digests of a group of copies, in runs of ``RUN`` ids.
Other columns of the table are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

BLOCK, SPREAD = 100, 6
#: Ids of a group of copies that are joined to one text before they are digested.
RUN = 4096
ROOT = hashlib.blake2b(b"", digest_size=16).digest()
NOTHING = hashlib.sha256(b"").hexdigest()


def _turns(rows: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """Rows of (conv_id, pos, turn, chars): a turn's place from 1, digest and length."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    slim = rows.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("at"), F.length(text).cast("long").alias("chars"),
        F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)).alias("turn"),
    )
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("at"), "turn")
    return slim.select("conv_id", F.row_number().over(order).alias("pos"), "turn", "chars")


def rebuilt(rows: DataFrame, conv_col="conv_id", turn_col="turn", role_col="role", text_col="text", block: int = BLOCK, spread: int = SPREAD) -> DataFrame:
    """Rows of (conv_id, pos, turn, chars) of the rebuilt conversations; each has a row of position 0 too, without a turn."""
    turns = _turns(rows, conv_col, turn_col, role_col, text_col)
    taken = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(spread))
    base = F.col("conv_id") - F.col("conv_id") % block
    own = turns.where(F.col("pos") > taken)
    convs = rows.where(F.col(conv_col).isNotNull()).select(F.col(conv_col).cast("long").alias("conv_id")).distinct()
    heads = turns.where((F.col("conv_id") % block == 0) & (F.col("pos") < spread)).select(F.col("conv_id").alias("base"), "pos", "turn", "chars")
    lent = (
        convs.select("conv_id", base.alias("base"), taken.alias("taken")).join(heads, "base")
        .where("pos <= taken").select("conv_id", "pos", "turn", "chars")
    )
    starts = convs.select("conv_id", F.lit(0).alias("pos"), F.lit(None).cast("binary").alias("turn"), F.lit(0).cast("long").alias("chars"))
    return own.unionByName(lent).unionByName(starts)


def prefix_keys(turns: DataFrame) -> DataFrame:
    """Rows of (conv_id, depth, key, parent, chars, ends) from rebuilt turns: every prefix of every conversation."""

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, depth, key, held = None, 0, ROOT, None  # held: the row whose successor is not known yet
        for batch in batches:
            out: list[tuple] = []
            for conv_id, turn, chars in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "chars")), strict=True):
                if held is not None:
                    out.append((*held, conv_id != conv))
                if conv_id != conv:
                    conv, depth, key, parent = conv_id, 0, ROOT, None
                else:
                    depth, parent = depth + 1, key
                    key = hashlib.blake2b(parent + turn, digest_size=16).digest()
                held = (conv_id, depth, key, parent, chars)
            if out:
                yield _batch(out)
        if held is not None:
            yield _batch([(*held, True)])

    kind = pa.schema([("conv_id", pa.int64()), ("depth", pa.int64()), ("key", pa.binary()), ("parent", pa.binary()), ("chars", pa.int64()), ("ends", pa.bool_())])

    def _batch(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), kind, strict=True)], schema=kind)

    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "pos")
    return ordered.mapInArrow(chain, "conv_id long, depth long, key binary, parent binary, chars long, ends boolean")


def end_lists(ends: DataFrame) -> DataFrame:
    """Rows of (key, n, first, ends_sha256) from rows of (conv_id, key): a sequence's copies, smallest member and digest of all members.

    Ids meet in runs of bounded size; the runs of a sequence are digested in order, one at a time.
    """
    size = F.lit(RUN)
    runs = (
        ends.groupBy("key", F.floor(F.col("conv_id") / size).alias("run"))
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"), F.count("*").alias("n"), F.min("conv_id").alias("first"))
    )

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, n, first, sha = None, 0, 0, None
        out: list[tuple] = []
        for batch in batches:
            for k, ids, more, low in zip(*(batch.column(c).to_pylist() for c in ("key", "ids", "n", "first")), strict=True):
                if k != key:
                    if sha is not None:
                        out.append((key, n, first, sha.hexdigest()))
                    key, n, first, sha = k, 0, low, hashlib.sha256()
                sha.update((b"," if n else b"") + ids.encode())
                n += more
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["key", "n", "first", "ends_sha256"])
                out = []
        if sha is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (key, n, first, sha.hexdigest())], ["key", "n", "first", "ends_sha256"])

    return runs.repartition("key").sortWithinPartitions("key", "run").select("key", "ids", "n", "first").mapInArrow(digest, "key binary, n long, first long, ends_sha256 string")


def prefix_trie(rows: DataFrame, conv_col="conv_id", turn_col="turn", role_col="role", text_col="text", block: int = BLOCK, spread: int = SPREAD) -> DataFrame:
    """Rows of (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256), one a node."""
    keys = cut(prefix_keys(rebuilt(rows, conv_col, turn_col, role_col, text_col, block, spread)))
    sequences = cut(end_lists(keys.where("ends").select("conv_id", "key")))
    # one row a prefix of a sequence, whatever the number of its copies
    paths = cut(
        keys.join(sequences.select(F.col("first").alias("conv_id"), "n", F.col("key").alias("last")), "conv_id")
        .select(F.col("conv_id").alias("first"), "n", "depth", "key", "parent", "chars", "ends")
    )
    nodes = cut(
        paths.groupBy("key").agg(F.min("first").alias("conv_id"), F.first("depth").alias("depth"), F.first("parent").alias("parent"), F.first("chars").alias("chars"), F.sum("n").alias("n_convs"))
    )
    children = nodes.where(F.col("parent").isNotNull()).groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("n_children"))
    leaves = sequences.select("key", "first").join(children, "key", "left_anti").select("first", F.lit(1).alias("leaf"))
    owned = nodes.select(F.col("conv_id").alias("first"), "depth", ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"))
    to_end = Window.partitionBy("first").orderBy(F.desc("depth"))
    subtrees = (
        paths.join(owned, ["first", "depth"], "left").join(leaves, "first", "left")
        .select("key", F.sum(F.coalesce("saved", F.lit(0))).over(to_end).alias("saved"), F.coalesce("leaf", F.lit(0)).alias("leaf"))
        .groupBy("key").agg(F.sum("saved").alias("saved_tokens"), F.sum("leaf").alias("n_leaves"))
    )
    above = nodes.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    return (
        nodes.join(subtrees, "key").join(children, "key", "left").join(sequences.select("key", "ends_sha256"), "key", "left").join(above, "parent", "left")
        .select(
            "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), F.col("n_leaves").cast("long").alias("n_leaves"),
            "saved_tokens", F.coalesce("ends_sha256", F.lit(NOTHING)).alias("ends_sha256"),
        )
    )

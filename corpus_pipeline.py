"""A corpus pipeline of five stages, each of one corpus operator.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and
returns the rows that go on. All but the last return the columns of
``documents``. ``run`` applies them to the documents table. A row travels as one
struct beside the columns that a stage works with, so further columns may have
any names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerframe.llm import context_pii, curriculum_mix, piece_codec, shingle_sets, subword_classifier
from ledgerframe.llm.common import table

PIECES = public_tokenizers.path("piece_bpe_32k.model")
#: About the most bytes that a Python task gets at once; a longer row comes whole. An executor holds such
#: batches outside its heap, on the way out and on the way back, for every task that it runs.
BATCH_BYTES = 4 << 20


def in_small_batches(spark: SparkSession) -> None:
    """Sets the session's Arrow batches for the stages that read texts in Python; what they return does not depend on it."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject, unchanged; null and empty texts are scored like others."""
    in_small_batches(spark)
    model = subword_classifier.fit(docs, table(spark, sf_dir, "labels"))
    # The text goes to Python and back once, so it is not in the struct.
    rest = F.struct(*(c for c in docs.columns if c != "text")).alias("rest")
    whole = docs.select("doc_id", "text", F.struct(F.col("text").isNull().alias("none"), rest).alias("_row"))
    good = subword_classifier.score(whole, model, keep=("_row",), with_text=True).where("score >= 0.5")
    text = F.when(~F.col("_row.none"), F.col("_text")).alias("text")
    return good.select(*(text if c == "text" else F.col("_row.rest").getField(c).alias(c) for c in docs.columns))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of every group of near-duplicates: the one with the smallest id.

    Rows are near-duplicates if five-word shingles have a Jaccard similarity of
    0.8 or more, directly or through others. Rows go by id and text, so clashing
    ids lose nothing; a row without an id comes after all ids.
    """
    in_small_batches(spark)
    named = docs.select("doc_id", "text", F.struct("*").alias("_row")).withColumn("_own", F.xxhash64("doc_id", "text"))
    found = shingle_sets.similar_groups(named.select(F.col("_own").alias("key"), "doc_id", "text"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("first")
    stay = found.groupBy("root").agg(first).select(F.col("first.key").alias("_stays"), F.col("first.doc_id").alias("_id"))
    # Dealt by the hash alone, the rows are where their repeats are: texts are shuffled once.
    id_ = F.col("doc_id").cast("long")
    same = (F.col("_own") == F.col("_stays")) & F.when(id_.isNull(), F.col("_id").isNull()).otherwise(F.coalesce(id_ == F.col("_id"), F.lit(False)))
    return named.join(stay, same, "left_semi").dropDuplicates(["doc_id", "_own"]).select("_row.*")


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind in brackets and ``n_chars`` counted anew where it was.

    Null texts stay null; rows equal in id and text are treated alike.
    """
    hidden = context_pii.hide_personal_data(docs.select("doc_id", "text", F.struct("*").alias("_row")))
    counted = F.when(F.col("_hidden"), F.length("text").cast("long")).otherwise(F.col("_row.n_chars"))
    return hidden.select(F.col("_row").withField("text", F.col("text")).withField("n_chars", counted).alias("_row")).select("_row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix in training order, a row for each copy; a document of which a part is taken counts by rounding.

    Rows equal in id, text and source are one document with their copies pooled.
    """
    named = docs.select("text", "source", F.struct("*").alias("_row"), F.xxhash64("doc_id", "text", "source").alias("_key"))
    mixed = curriculum_mix.curriculum_mix(named, id_col="_key")
    copies = F.when(F.col("size") > 0, F.round(F.col("taken") / F.col("size"))).otherwise(0).cast("int")
    places = (
        mixed.select(F.col("doc_id").alias("_key"), F.slice("positions", F.lit(1), copies).alias("_at"))
        .groupBy("_key").agg(F.flatten(F.collect_list("_at")).alias("_at")).where(F.size("_at") > 0)
    )
    taken = named.dropDuplicates(["_key"]).join(places, "_key").withColumn("_at", F.explode("_at"))
    return taken.orderBy("_at", "_key").select("_row.*")


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids with byte spans, and whether decoding gives the text back."""
    in_small_batches(spark)
    whole = docs.select(F.struct("doc_id", "lang", "source", F.xxhash64(F.coalesce("text", F.lit(""))).alias("hash")).alias("row"), "text")
    coded = piece_codec.encode(whole, PIECES, id_col="row")
    return coded.select("doc_id.doc_id", "doc_id.lang", "doc_id.source", F.size("ids").alias("n_tokens"), "ids", "ends", (F.xxhash64("decoded") == F.col("doc_id.hash")).alias("lossless"))


STAGES = [
    ("quality_classifier", keep_good),
    ("simhash_near_dedup", drop_near_copies),
    ("personal_data", hide_personal_data),
    ("source_mix", mix_sources),
    ("piece_encoding", encode_pieces),
]

#: Training and bit-vote fingerprints are beyond SQL; tests compare small runs with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs

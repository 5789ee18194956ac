"""The corpus queries and their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import context_pii, decision_list, oracles, piece_codec, subword_classifier
from .common import table
from .curriculum_mix import curriculum_mix, in_training_order
from .host_boilerplate import main_text
from .phrase_mining import mine_phrases
from .prefix_trie import prefix_trie
from .range_shards import shard_by_ranges
from .simhash_tiles import near_duplicates
from .suffix_dedup import remove_repeats
from .url_rules import judge_urls
from .va_topk import top_k

PIECES = public_tokenizers.path("piece_bpe_32k.model")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op2_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = piece_codec.encode(table(spark, sf_dir, "documents"), PIECES)
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"), F.element_at("ends", -1).cast("long").alias("bytes_spanned"),
        F.sha2(F.array_join(F.col("ends").cast("array<string>"), " ").cast("binary"), 256).alias("span_ends_sha256"),
    )


def op3_host_boilerplate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "boilerplate_words")


def op4_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    ordered = in_training_order(curriculum_mix(table(spark, sf_dir, "documents")))
    return ordered.select("doc_id", "size", "source_size", "target", "taken", F.floor(F.col("position") * 1e9).alias("position_ppb"))


def op5_context_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = context_pii.find_personal_data(table(spark, sf_dir, "documents"))
    counts = (F.size(F.filter("base", context_pii.of_kind(i))).cast("long").alias(f"n_{kind}") for i, kind in enumerate(context_pii.KINDS))
    return found.select("doc_id", *counts, F.sha2(context_pii.written(F.col("base")).cast("binary"), 256).alias("base_sha256"), context_pii.written(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))


def op6_range_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_by_ranges(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op7_subword_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = subword_classifier.fit(docs, table(spark, sf_dir, "labels"))
    held = subword_classifier.fold(F.col("doc_id")) == subword_classifier.HELD_FOLD
    return subword_classifier.score(docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rules = decision_list.learn_rules(docs, table(spark, sf_dir, "labels"))
    return decision_list.apply_rules(docs, rules).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.col("rule").alias("fired_rule"), "kept"
    )


def op8_va_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op10_simhash_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


#: (verdict, host, path) of the rules that the query applies.
URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def op11_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op12_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine_phrases(table(spark, sf_dir, "documents"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_suffix_dedup, op2_piece_codec, op3_host_boilerplate, op4_curriculum_mix, op5_context_pii, op6_range_shards, op7_subword_classifier,
        op8_va_topk, op9_decision_list, op10_simhash_tiles, op11_url_rules, op12_phrase_mining, op13_prefix_trie, pipeline,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op4_curriculum_mix": oracles.CURRICULUM_MIX, "op8_va_topk": oracles.VA_TOPK, "op11_url_rules": oracles.URL_RULES, "op12_phrase_mining": oracles.PHRASES, "op13_prefix_trie": oracles.PREFIX_TRIE}

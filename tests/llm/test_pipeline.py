"""The corpus pipeline on the smallest tables, stage by stage."""

import os
import re

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F

SF_DIR = "/root/testdata/sf0.001"


def test_stages(spark):
    documents = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    awkward = spark.createDataFrame([(None, None, None, None, None), (9001, "", "en", None, 0), (9002, "", "en", "s", 0)], documents.schema)
    docs = documents.unionByName(awkward).withColumn("score", F.lit(7))
    names = docs.columns
    good = corpus_pipeline.keep_good(spark, docs, SF_DIR)
    assert good.columns == names
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").collect()}
    kept = {r.doc_id for r in good.collect()}
    right = [(i in kept) == bool(q) for i, q in labels.items()]
    assert sum(right) / len(right) > 0.9

    unique = corpus_pipeline.drop_near_copies(spark, good, SF_DIR)
    texts = [r.text for r in unique.collect()]
    assert unique.columns == names and len(set(texts) - {None}) == len([t for t in texts if t is not None])

    hidden = corpus_pipeline.hide_personal_data(spark, unique, SF_DIR)
    rows = hidden.collect()
    assert hidden.columns == names and len(rows) == len(texts)
    assert not any(re.search(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9-]+", r.text or "") for r in rows)

    mixed = corpus_pipeline.mix_sources(spark, hidden, SF_DIR)
    copies = mixed.groupBy("doc_id").count().collect()
    assert mixed.columns == names and max(r["count"] for r in copies) <= 3

    coded = corpus_pipeline.encode_pieces(spark, mixed, SF_DIR)
    assert coded.where("NOT lossless OR n_tokens <> size(ids) OR n_tokens <> size(ends)").count() == 0
    assert coded.count() == mixed.count()


def test_columns_with_names_that_stages_use(spark):
    clashes = ("_own", "_hidden", "_chunks", "_key", "_at", "_row", "_cuts", "_id", "root", "key", "score", "position")
    documents = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    long = spark.createDataFrame([(9001, "word and more " * 30_000 + "mail a@b.example.com", "en", "src1", 1)], documents.schema)
    plain = documents.unionByName(long)
    docs = plain.withColumns({c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in clashes})
    for name, stage in corpus_pipeline.STAGES[1:4]:
        got, want = stage(spark, docs, SF_DIR), stage(spark, plain, SF_DIR)
        assert got.columns == docs.columns, name
        rows = got.collect()
        assert all(r[c] == f"{c}{r.doc_id}" for r in rows for c in clashes), name
        assert sorted(map(repr, (tuple(r[c] for c in plain.columns) for r in rows))) == sorted(map(repr, map(tuple, want.collect()))), name


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF_DIR)
    assert docs.count() == 0


def test_classifier_gets_each_text_once_in_small_batches(spark, monkeypatch):
    class Bounded:
        """Says yes to texts that came in a batch of moderate size."""

        def scores(self, texts):
            return np.full(len(texts), float(texts.buffers()[2].size <= 2 * corpus_pipeline.BATCH_BYTES))

    sent = []
    score = corpus_pipeline.subword_classifier.score
    monkeypatch.setattr(corpus_pipeline.subword_classifier, "fit", lambda *a, **b: Bounded())
    monkeypatch.setattr(corpus_pipeline.subword_classifier, "score", lambda docs, *a, **b: (sent.append(docs), score(docs, *a, **b))[1])
    text = F.when(F.col("id") % 7 != 0, F.concat(F.col("id").cast("string"), F.repeat(F.lit(" words"), 1_500)))
    docs = spark.range(0, 3_000, 1, 1).select(F.col("id").alias("doc_id"), text.alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(1).alias("n_chars"))
    good = corpus_pipeline.keep_good(spark, docs, SF_DIR)
    assert good.columns == docs.columns
    assert sorted(map(tuple, good.collect()), key=repr) == sorted(map(tuple, docs.collect()), key=repr)
    assert sent[0].schema.simpleString().count("text:") == 1


def test_classifier_learns_outside_the_driver(spark, monkeypatch):
    classifier = corpus_pipeline.subword_classifier
    monkeypatch.setattr(classifier, "train", lambda texts, labels: classifier.Model(np.full(classifier.BUCKETS, len(texts) / 2), float(os.getpid())))
    docs, labels = (spark.read.parquet(f"{SF_DIR}/{t}.parquet") for t in ("documents", "labels"))
    model = classifier.fit(docs, labels, sample_rows=50)
    assert model.bias != os.getpid() and (model.weights == 25).all() and len(model.weights) == classifier.BUCKETS

"""Metrics of a relevance by label against those of the same relevance listed."""

import random

from pyspark.sql import functions as F

from quillmark.operators import evaluate


def plain(df):
    return sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect())


def test_relevance_by_label_equals_the_listed_one(spark):
    rng = random.Random(4)
    labels = {i: rng.choice([0, 1, 1, 2, None]) for i in range(60)} | {60: 9}
    asked = {i: labels[i] for i in (0, 7, 12, 20, 33, 60)} | {100: 1, 101: 5}
    run = [(q, d, n + 1, 1 / (n + 1)) for q in asked for n, d in enumerate(rng.sample([d for d in labels if d != q], 12))]
    docs = spark.createDataFrame(list(labels.items()), "doc_id long, label int")
    queries = spark.createDataFrame(list(asked.items()), "qid long, label int")
    run = spark.createDataFrame(run, "qid long, doc_id long, rank int, score double")
    listed = queries.join(docs, "label").where("doc_id <> qid").select("qid", "doc_id", F.lit(1.0).alias("gain"))
    short = evaluate.by_label(run, queries, docs)
    for metric in (evaluate.judged, evaluate.at_cuts, evaluate.average_precision, evaluate.ndcg, evaluate.ranking_quality):
        assert plain(metric(run, short).select(*sorted(metric(run, listed).columns))) == plain(metric(run, listed).select(*sorted(metric(run, listed).columns)))
    assert plain(evaluate.ndcg(run, short, raw_gain=True)) == plain(evaluate.ndcg(run, listed, raw_gain=True))
    assert plain(evaluate.overlap_accuracy(run.where("rank <= 5"), short)) == plain(evaluate.overlap_accuracy(run.where("rank <= 5"), listed))
    assert short.found.count() <= run.count() < listed.count() * 2 and short.counts.count() == listed.select("qid").distinct().count()


def test_rows_of_relevance_grow_with_queries(spark):
    """A label that all documents share: the listed relevance has a row for each document and query."""
    docs = spark.range(3_000).select(F.col("id").alias("doc_id"), F.lit(1).alias("label"))
    queries = docs.where("doc_id % 10 = 0").select(F.col("doc_id").alias("qid"), "label")
    run = queries.select("qid", (F.col("qid") + 1).alias("doc_id"), F.lit(1).alias("rank"), F.lit(0.5).alias("score"))
    own = evaluate.by_label(run, queries, docs)
    assert (own.found.count(), own.counts.count(), own.ideal.count()) == (300, 300, 300 * max(evaluate.CUTS))
    assert {r.n_relevant for r in own.counts.collect()} == {2_999}

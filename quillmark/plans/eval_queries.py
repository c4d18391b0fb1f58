"""Evaluation and telemetry on the driver's tables, each with its SQL.

A vector's label is its relevance: a query's relevant documents are the other vectors of its label.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluate, vector
from ..operators.ranking import top_k
from ..session import own_folder
from ..streaming import trace
from .common import SIMS_SQL, final, rank_sql, table, vector_queries, vectors
from .graph_queries import CASES, cases, stored

WIDE = 20


def judged_run(spark: SparkSession, d: str) -> tuple[DataFrame, evaluate.Relevance]:
    """(run, relevance) without the query itself."""
    asked = vector_queries(spark, d)
    run = vector.search(vectors(spark, d), asked.select("qid", "vector"), WIDE + 1).where("doc_id <> qid").drop("rank")
    run = stored(top_k(run, WIDE, "qid"), "run")
    return run, evaluate.by_label(run, asked.select("qid", F.col("qlabel").alias("label")), vectors(spark, d))


def metric_at_k(spark: SparkSession, d: str) -> DataFrame:
    return final(evaluate.at_cuts(*judged_run(spark, d)))


def metric_ap_mrr(spark: SparkSession, d: str) -> DataFrame:
    return final(evaluate.average_precision(*judged_run(spark, d)))


def metric_map(spark: SparkSession, d: str) -> DataFrame:
    return final(evaluate.mean_scores(evaluate.average_precision(*judged_run(spark, d))))


def metric_ndcg(spark: SparkSession, d: str) -> DataFrame:
    return final(evaluate.ndcg(*judged_run(spark, d)))


def metric_ndcg_raw(spark: SparkSession, d: str) -> DataFrame:
    return final(evaluate.ndcg(*judged_run(spark, d), raw_gain=True))


def all_metrics(spark: SparkSession, d: str) -> DataFrame:
    run, qrels = judged_run(spark, d)
    return evaluate.long_form(evaluate.at_cuts(run, qrels), ["precision", "recall", "f1", "hit"]).unionByName(evaluate.long_form(evaluate.average_precision(run, qrels), ["ap", "rr"], None))


def metric_aggregate(spark: SparkSession, d: str) -> DataFrame:
    return final(evaluate.aggregate_metrics(all_metrics(spark, d)))


def by_type(spark: SparkSession, d: str) -> DataFrame:
    kind = vector_queries(spark, d).select("qid", F.when(F.col("qlabel") < 5, "article_to_case").otherwise("consistency").alias("query_type"))
    return evaluate.aggregate_metrics(all_metrics(spark, d).join(kind, "qid"), "query_type")


def metric_overall(spark: SparkSession, d: str) -> DataFrame:
    return final(evaluate.overall(by_type(spark, d), {"consistency": 2.0, "article_to_case": 1.5}).withColumn("rating", evaluate.band(F.col("value"))))


def metric_summary(spark: SparkSession, d: str) -> DataFrame:
    return final(evaluate.summary(evaluate.overall(by_type(spark, d), {"consistency": 2.0, "article_to_case": 1.5})))


def ranking_quality(spark: SparkSession, d: str) -> DataFrame:
    return final(evaluate.ranking_quality(*judged_run(spark, d)))


def overlap_accuracy(spark: SparkSession, d: str) -> DataFrame:
    run, qrels = judged_run(spark, d)
    return final(evaluate.overlap_accuracy(run.where("rank <= 5"), qrels))


def keyword_accuracy(spark: SparkSession, d: str) -> DataFrame:
    own = cases(spark, d).select(F.concat(F.lit("Brand#"), (F.col("case_id") % 25 + 1).cast("string")).alias("crime"), F.col("crimes").alias("keywords"))
    return final(evaluate.keyword_accuracy(own))


def returned(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Per customer the suppliers of the cheaper half (returned) and the orders with all their suppliers (cited)."""
    lines = table(spark, d, "lineitem").join(table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("qid")), "l_orderkey")
    cited = lines.select("qid", F.col("l_orderkey").alias("case_id"), F.col("l_suppkey").alias("article"))
    return lines.where("l_quantity <= 25").select("qid", F.col("l_suppkey").alias("article")).unionByName(lines.where("l_linenumber = 1").select("qid", ((F.col("l_suppkey") + 1) % 100).alias("article"))), cited


def consistency(spark: SparkSession, d: str) -> DataFrame:
    return final(evaluate.consistency(*returned(spark, d)))


def case_coverage(spark: SparkSession, d: str) -> DataFrame:
    return final(evaluate.case_coverage(*returned(spark, d)))


def micro_macro(spark: SparkSession, d: str) -> DataFrame:
    run, qrels = judged_run(spark, d)
    per = evaluate.judged(run, qrels).groupBy("qid").agg(F.sum("rel").alias("hits"), F.count("*").alias("n"))
    return final(evaluate.micro_macro(per.withColumn("kind", F.col("qid") % 200), "hits", "n", "kind"))


def ground_truth_stats(spark: SparkSession, d: str) -> DataFrame:
    return final(evaluate.ground_truth_stats(evaluate.ground_truth(cases(spark, d))))


def hash_sample(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.sampled_queries(table(spark, d, "documents").select("doc_id", evaluate.query_text(F.col("text"), 100).alias("query_text")), "doc_id", 20)


def events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events")


def trace_rollup(spark: SparkSession, d: str) -> DataFrame:
    return final(trace.by_module(events(spark, d)))


def trace_tumbling(spark: SparkSession, d: str) -> DataFrame:
    return final(trace.tumbling(events(spark, d)))


def trace_sliding(spark: SparkSession, d: str) -> DataFrame:
    return final(trace.sliding(events(spark, d)))


def trace_session(spark: SparkSession, d: str) -> DataFrame:
    return final(trace.sessions(events(spark, d)))


def trace_distinct(spark: SparkSession, d: str) -> DataFrame:
    own = events(spark, d)
    return final(trace.by_module(trace.without_repeats(own.unionByName(own))))


def search_stats(spark: SparkSession, d: str) -> DataFrame:
    return final(trace.search_stats(events(spark, d), "user_id"))


def weight_bands(spark: SparkSession, d: str) -> DataFrame:
    return final(trace.weight_bands(events(spark, d).withColumn("weight", F.col("value") % 1.0), "weight", "event_type"))


def streaming_rollup(spark: SparkSession, d: str) -> DataFrame:
    """The tumbling roll-up again, but as a stream over the events' file into a table."""
    own, folder = events(spark, d), own_folder(spark, "rollup")
    stream = spark.readStream.schema(own.schema).option("pathGlobFilter", "events.parquet").parquet(d).withColumn("ts", F.col("ts").cast("timestamp"))
    trace.to_table(trace.tumbling(stream), f"{folder}/table", f"{folder}/checkpoint").awaitTermination()
    plain = {c: F.col(c).cast("timestamp_ntz") for c in ("window_start", "window_end")}
    return final(trace.read_table(spark, f"{folder}/table").withColumns(plain))


JUDGED = f"""WITH {SIMS_SQL}, run AS (SELECT *, {rank_sql()} AS rank, label = qlabel AS rel FROM sims WHERE doc_id <> qid QUALIFY rank <= {WIDE}),
nr AS (SELECT qid, count(*) AS n_relevant FROM sims WHERE doc_id <> qid AND label = qlabel GROUP BY qid),
cut AS (SELECT qid, k, p, coalesce(hits / nullif(n_relevant, 0), 0) AS r, hit, CASE WHEN p + coalesce(hits / nullif(n_relevant, 0), 0) > 0 THEN 2 * p * (hits / n_relevant) / (p + hits / n_relevant) ELSE 0 END AS f1
  FROM (SELECT qid, k, count(*) FILTER (rel) AS hits, count(*) FILTER (rel) / count(*) AS p, max(rel::INT)::BIGINT AS hit FROM run, (SELECT unnest([1, 3, 5, 10]) AS k) WHERE rank <= k GROUP BY ALL) LEFT JOIN nr USING (qid)),
ap AS (SELECT qid, coalesce(sum(part) / any_value(n_relevant), 0) AS ap, coalesce(1 / min(CASE WHEN rel THEN rank END), 0) AS rr FROM (SELECT *, CASE WHEN rel THEN count(*) FILTER (rel) OVER (PARTITION BY qid ORDER BY rank) / rank ELSE 0 END AS part FROM run) LEFT JOIN nr USING (qid) GROUP BY qid),
metrics AS (SELECT qid, 'precision@' || k AS metric, p AS value FROM cut UNION ALL SELECT qid, 'recall@' || k, r FROM cut UNION ALL SELECT qid, 'f1@' || k, f1 FROM cut UNION ALL SELECT qid, 'hit@' || k, hit FROM cut UNION ALL SELECT qid, 'ap', ap FROM ap UNION ALL SELECT qid, 'rr', rr FROM ap)"""
OVERALL = f"""{JUDGED}, types AS (SELECT doc_id AS qid, CASE WHEN label < 5 THEN 1.5 ELSE 2.0 END::DOUBLE AS w FROM v), pt AS (SELECT w, metric, avg(value) AS mean FROM metrics JOIN types USING (qid) GROUP BY ALL),
o AS (SELECT metric, sum(mean * w) / sum(w) AS value FROM pt GROUP BY metric)"""
RETURNED = """WITH l AS (SELECT o_custkey AS qid, l_orderkey AS case_id, l_suppkey AS article, l_quantity, l_linenumber FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
a AS (SELECT DISTINCT qid, article FROM (SELECT qid, article FROM l WHERE l_quantity <= 25 UNION ALL SELECT qid, (article + 1) % 100 FROM l WHERE l_linenumber = 1)),
b AS (SELECT DISTINCT qid, article FROM l)"""
MEASURES = "count(*) AS n, count(*) FILTER (value > 50) AS successes, round(count(*) FILTER (value > 50) / count(*), 6) AS success_rate, round(avg(value), 6) AS avg_value, round(max(value), 6) AS max_value"


def ndcg_sql(gain: str) -> str:
    return f"""{JUDGED}, own AS (SELECT qid, k, sum({gain} / log2(rank + 1)) AS dcg FROM run, (SELECT unnest([1, 3, 5, 10]) AS k) WHERE rank <= k GROUP BY ALL),
ideal AS (SELECT qid, k, sum(1 / log2(i + 1)) AS ideal FROM nr, (SELECT unnest([1, 3, 5, 10]) AS k), (SELECT unnest(range(1, 11)) AS i) WHERE i <= k AND i <= n_relevant GROUP BY ALL)
SELECT qid, k::BIGINT AS k, round(dcg, 6) AS dcg, round(CASE WHEN ideal > 0 THEN dcg / ideal ELSE 0 END, 6) AS ndcg FROM own LEFT JOIN ideal USING (qid, k)"""


SQL = {
    "metric_at_k": f"{JUDGED} SELECT qid, k::BIGINT AS k, round(p, 6) AS precision, round(r, 6) AS recall, round(f1, 6) AS f1, hit FROM cut",
    "metric_ap_mrr": f"{JUDGED} SELECT qid, round(ap, 6) AS ap, round(rr, 6) AS rr FROM ap",
    "metric_map": f"{JUDGED} SELECT round(avg(ap), 6) AS map, round(avg(rr), 6) AS mrr FROM ap",
    "metric_ndcg": ndcg_sql("rel::INT"),
    "metric_ndcg_raw": ndcg_sql("score"),
    "metric_aggregate": f"{JUDGED} SELECT metric, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, round(min(value), 6) AS min, round(max(value), 6) AS max FROM metrics GROUP BY metric",
    "metric_overall": f"{OVERALL} SELECT metric, round(value, 6) AS value, CASE WHEN value >= 0.8 THEN 'excellent' WHEN value >= 0.7 THEN 'good' WHEN value >= 0.6 THEN 'fair' WHEN value >= 0.5 THEN 'weak' ELSE 'poor' END AS rating FROM o",
    "metric_summary": f"{OVERALL} SELECT metric, round(value, 4) AS value, CASE WHEN round(value, 4) >= 0.7 THEN 'strength' WHEN round(value, 4) < 0.5 THEN 'weakness' ELSE 'neutral' END AS verdict FROM o",
    "ranking_quality": f"""{JUDGED}, q AS (SELECT qid, count(*) FILTER (rel) / any_value(n_relevant) AS coverage, min(CASE WHEN rel THEN rank END) AS f FROM run JOIN nr USING (qid) GROUP BY qid),
p AS (SELECT *, CASE WHEN f <= 2 THEN 1 WHEN f <= 4 THEN 0.8 WHEN f = 5 THEN 0.6 ELSE 0 END::DOUBLE AS ranking FROM q) SELECT qid, round(coverage, 6) AS coverage, ranking, round(coverage * ranking, 6) AS quality FROM p""",
    "overlap_accuracy": f"{JUDGED} SELECT count(*) AS queries, round(avg(hit), 6) AS accuracy FROM (SELECT qid, coalesce(max(CASE WHEN rank <= 5 AND rel THEN 1 END), 0) AS hit FROM nr LEFT JOIN run USING (qid) GROUP BY qid)",
    "keyword_accuracy": f"WITH {CASES} SELECT round(avg(list_contains(crimes, 'Brand#' || (case_id % 25 + 1))::INT), 6) AS accuracy FROM cases",
    "consistency": f"""{RETURNED}, s AS (SELECT coalesce(a.qid, b.qid) AS qid, count(a.qid) AS l, count(b.qid) AS r, count(*) FILTER (a.qid IS NOT NULL AND b.qid IS NOT NULL) AS n_both, count(*) AS n FROM a FULL JOIN b ON a.qid = b.qid AND a.article = b.article GROUP BY 1)
SELECT qid, round(CASE WHEN l > 0 THEN n_both / l ELSE 0 END, 6) AS precision, round(CASE WHEN r > 0 THEN n_both / r ELSE 0 END, 6) AS recall, round(n_both / n, 6) AS jaccard FROM s""",
    "case_coverage": f"{RETURNED} SELECT *, round(covered / total, 6) AS rate FROM (SELECT count(*) AS covered FROM (SELECT DISTINCT qid, case_id FROM l JOIN a USING (qid, article))), (SELECT count(*) AS total FROM (SELECT DISTINCT qid, case_id FROM l))",
    "micro_macro": f"{JUDGED}, p AS (SELECT qid, count(*) FILTER (rel) AS hits, count(*) AS n FROM run GROUP BY qid) SELECT qid % 200 AS kind, round(avg(hits / n), 6) AS macro, round(sum(hits) / sum(n), 6) AS micro FROM p GROUP BY 1",
    "ground_truth_stats": f"""WITH {CASES}, p AS (SELECT DISTINCT unnest(articles) AS article, case_id FROM cases), t AS (SELECT article AS top_article, count(*) AS top_cases FROM p GROUP BY article ORDER BY top_cases DESC, article LIMIT 1)
SELECT articles, cases, pairs, round(pairs / articles, 6) AS cases_per_article, round(pairs / cases, 6) AS articles_per_case, top_article, top_cases FROM (SELECT count(DISTINCT article) AS articles, count(DISTINCT case_id) AS cases, count(*) AS pairs FROM p), t""",
    "hash_sample": "SELECT doc_id, substring(coalesce(text, ''), 1, 100) AS query_text FROM documents ORDER BY md5(doc_id::VARCHAR || ':42'), doc_id LIMIT 20",
    "trace_rollup": f"SELECT event_type, {MEASURES} FROM events GROUP BY event_type",
    "trace_tumbling": f"SELECT date_trunc('day', ts) AS window_start, date_trunc('day', ts) + INTERVAL 1 DAY AS window_end, event_type, {MEASURES} FROM events GROUP BY ALL",
    "trace_sliding": "WITH w AS (SELECT unnest([date_trunc('day', ts), date_trunc('day', ts) - INTERVAL 1 DAY]) AS window_start, event_type, value FROM events) SELECT window_start, window_start + INTERVAL 2 DAY AS window_end, event_type, count(*) AS n, round(avg(value), 6) AS avg_value FROM w GROUP BY ALL",
    "trace_session": """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 6 HOUR AS session_end, count(*) AS n, round(sum(value), 6) AS total FROM s GROUP BY user_id, k""",
    "trace_distinct": f"SELECT event_type, {MEASURES} FROM events GROUP BY event_type",
    "search_stats": "SELECT user_id, count(*) AS total, count(*) FILTER (value > 50) AS succeeded, count(*) FILTER (value <= 50) AS failed, round(count(*) FILTER (value > 50) / count(*), 6) AS rate, round(sum(value), 6) AS time_total, round(avg(value), 6) AS time_mean FROM events GROUP BY user_id",
    "weight_bands": "SELECT event_type, count(*) FILTER (value % 1 >= 0.8) AS strong, count(*) FILTER (value % 1 >= 0.6 AND value % 1 < 0.8) AS middle, round(avg(value % 1), 6) AS mean_weight FROM events GROUP BY event_type",
    "streaming_rollup": f"SELECT date_trunc('day', ts) AS window_start, date_trunc('day', ts) + INTERVAL 1 DAY AS window_end, event_type, {MEASURES} FROM events GROUP BY ALL",
}

QUERIES = {
    f.__name__: f
    for f in (
        metric_at_k, metric_ap_mrr, metric_map, metric_ndcg, metric_ndcg_raw, metric_aggregate, metric_overall, metric_summary, ranking_quality,
        overlap_accuracy, keyword_accuracy, consistency, case_coverage, micro_macro, ground_truth_stats, hash_sample, trace_rollup, trace_tumbling,
        trace_sliding, trace_session, trace_distinct, search_stats, weight_bands, streaming_rollup,
    )
}

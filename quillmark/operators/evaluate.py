"""Retrieval metrics over runs (qid, doc_id, rank, score) and relevance (qid, doc_id, gain), for all queries at once.

Where relevance is a label, it is not listed: `by_label` gives what the metrics need of it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CUTS = (1, 3, 5, 10)


@dataclass
class Relevance:
    """Of a relevance: the rows (qid, doc_id, gain) that a run holds, how many there are (qid, n_relevant), and the first places of
    the best order (qid, rank, gain).
    """

    found: DataFrame
    counts: DataFrame
    ideal: DataFrame


def by_label(run: DataFrame, asked: DataFrame, docs: DataFrame, most: int = max(CUTS)) -> Relevance:
    """The relevance, with gain 1, of all documents (doc_id, label) to queries (qid, label) of their label, other than the query itself.

    Only the run's rows and numbers by label are joined: a label's documents by its queries would grow with the square of the table.
    """
    asked = asked.where("label IS NOT NULL").select("qid", "label").distinct()
    docs = docs.where("label IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", "label").distinct()
    found = run.select("qid", "doc_id").where("doc_id <> qid").join(asked, "qid").join(docs, ["doc_id", "label"], "left_semi").select("qid", "doc_id").distinct().withColumn("gain", F.lit(1.0))
    itself = asked.join(docs.select(F.col("doc_id").alias("qid"), "label"), ["qid", "label"], "left_semi").withColumn("itself", F.lit(1))
    many = asked.join(docs.groupBy("label").agg(F.count("*").alias("n")), "label").join(itself, ["qid", "label"], "left")
    counts = many.groupBy("qid").agg(F.sum(F.col("n") - F.coalesce("itself", F.lit(0))).alias("n_relevant")).where("n_relevant > 0")
    ideal = counts.select("qid", F.explode(F.sequence(F.lit(1), F.least("n_relevant", F.lit(most)).cast("int"))).alias("rank"), F.lit(1.0).alias("gain"))
    return Relevance(found, counts, ideal)


def judged(run: DataFrame, qrels: DataFrame | Relevance) -> DataFrame:
    """The run with `rel` (0 or 1) and `gain`."""
    own = qrels.found if isinstance(qrels, Relevance) else qrels.groupBy("qid", "doc_id").agg(F.max("gain").alias("gain"))
    return run.join(own, ["qid", "doc_id"], "left").withColumn("rel", F.when(F.col("gain").isNotNull(), 1).otherwise(0)).fillna({"gain": 0.0})


def relevant_counts(qrels: DataFrame | Relevance) -> DataFrame:
    return qrels.counts if isinstance(qrels, Relevance) else qrels.groupBy("qid").agg(F.countDistinct("doc_id").alias("n_relevant"))


def ideal_order(qrels: DataFrame | Relevance) -> DataFrame:
    """(qid, rank, gain) of the relevant documents, largest gains first."""
    if isinstance(qrels, Relevance):
        return qrels.ideal
    best = qrels.groupBy("qid", "doc_id").agg(F.max("gain").alias("gain"))
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("gain"), "doc_id")))


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def at_cuts(run: DataFrame, qrels: DataFrame | Relevance, cuts: tuple[int, ...] = CUTS) -> DataFrame:
    """(qid, k, precision, recall, f1, hit): precision divides by what was retrieved, recall by distinct relevant ones."""
    rows = judged(run, qrels).select("qid", "rank", "rel", F.explode(F.array(*[F.lit(k) for k in cuts])).alias("k")).where(F.col("rank") <= F.col("k"))
    hits = rows.groupBy("qid", "k").agg(F.sum("rel").alias("hits"), F.count("*").alias("n"), F.max("rel").alias("hit"))
    all_of = hits.join(relevant_counts(qrels), "qid", "left").fillna(0, ["n_relevant"])
    p, r = ratio(F.col("hits"), F.col("n")), ratio(F.col("hits"), F.col("n_relevant"))
    return all_of.select("qid", "k", p.alias("precision"), r.alias("recall"), ratio(2 * p * r, p + r).alias("f1"), F.col("hit").cast("int").alias("hit"))


def average_precision(run: DataFrame, qrels: DataFrame | Relevance) -> DataFrame:
    """(qid, ap, rr): average precision over distinct relevant documents and reciprocal rank, for every judged query."""
    upto = Window.partitionBy("qid").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    rows = judged(run, qrels).withColumn("part", F.col("rel") * F.sum("rel").over(upto) / F.col("rank"))
    per = rows.groupBy("qid").agg(F.sum("part").alias("total"), F.min(F.when(F.col("rel") == 1, F.col("rank"))).alias("first"))
    every = run.select("qid").union(relevant_counts(qrels).select("qid")).distinct()
    out = every.join(per, "qid", "left").join(relevant_counts(qrels), "qid", "left")
    return out.select("qid", F.coalesce(F.col("total") / F.col("n_relevant"), F.lit(0.0)).alias("ap"), F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("rr"))


def mean_scores(per_query: DataFrame) -> DataFrame:
    """(map, mrr) in one row."""
    return per_query.agg(F.avg("ap").alias("map"), F.avg("rr").alias("mrr"))


def ndcg(run: DataFrame, qrels: DataFrame | Relevance, cuts: tuple[int, ...] = CUTS, raw_gain: bool = False) -> DataFrame:
    """(qid, k, dcg, ndcg): gains of relevant documents; with `raw_gain` the scores of all retrieved ones, which may
    exceed the ideal order of the relevant."""
    k_of = F.explode(F.array(*[F.lit(k) for k in cuts])).alias("k")
    gain = F.col("score") if raw_gain else F.col("gain")
    own = judged(run, qrels).select("qid", "rank", gain.alias("g"), k_of).where(F.col("rank") <= F.col("k"))
    dcg = own.groupBy("qid", "k").agg(F.sum(F.col("g") / F.log2(F.col("rank") + 1)).alias("dcg"))
    ideal = ideal_order(qrels).where(F.col("rank") <= max(cuts)).select("qid", "rank", "gain", k_of).where(F.col("rank") <= F.col("k")).groupBy("qid", "k").agg(F.sum(F.col("gain") / F.log2(F.col("rank") + 1)).alias("ideal"))
    return dcg.join(ideal, ["qid", "k"], "left").select("qid", "k", "dcg", F.when(F.col("ideal") > 0, F.col("dcg") / F.col("ideal")).otherwise(0.0).alias("ndcg"))


def long_form(per_query: DataFrame, names: list[str], k: str | None = "k") -> DataFrame:
    """(qid, metric, value) of wide metrics; names carry the cut."""
    label = lambda n: F.concat(F.lit(f"{n}@"), F.col(k).cast("string")) if k else F.lit(n)
    return per_query.select("qid", F.explode(F.array(*[F.struct(label(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names])).alias("m")).select("qid", "m.metric", "m.value")


def aggregate_metrics(metrics: DataFrame, *group: str) -> DataFrame:
    """Mean, population deviation and extremes of each metric over queries."""
    return metrics.groupBy(*group, "metric").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"))


def overall(per_type: DataFrame, weights: dict[str, float], other: float = 1.0) -> DataFrame:
    """(metric, value): means of (query_type, metric, mean), weighted by type."""
    w = F.coalesce(F.create_map(*[F.lit(x) for item in weights.items() for x in item])[F.col("query_type")], F.lit(other))
    return per_type.groupBy("metric").agg((F.sum(F.col("mean") * w) / F.sum(w)).alias("value"))


def overlap_accuracy(returned: DataFrame, truth: DataFrame | Relevance) -> DataFrame:
    """(queries, accuracy): share of queries with a truth that returned at least one of its documents."""
    found = truth.found if isinstance(truth, Relevance) else truth
    hit = found.join(returned.select("qid", "doc_id").distinct(), ["qid", "doc_id"], "left_semi").select("qid").distinct().withColumn("hit", F.lit(1))
    return relevant_counts(truth).select("qid").join(hit, "qid", "left").agg(F.count("*").alias("queries"), F.avg(F.coalesce("hit", F.lit(0)).cast("double")).alias("accuracy"))


def keyword_accuracy(queries: DataFrame) -> DataFrame:
    """Share of queries (crime, keywords array) whose keywords hold the crime."""
    return queries.agg(F.avg(F.array_contains("keywords", F.col("crime")).cast("double")).alias("accuracy"))


def consistency(returned: DataFrame, cited: DataFrame) -> DataFrame:
    """(qid, precision, recall, jaccard) of returned articles against those that the returned cases cite."""
    a = returned.select("qid", "article").distinct().withColumn("l", F.lit(1))
    b = cited.select("qid", "article").distinct().withColumn("r", F.lit(1))
    sides = a.join(b, ["qid", "article"], "full_outer").groupBy("qid").agg(F.count("l").alias("n_l"), F.count("r").alias("n_r"), F.count_if(F.col("l").isNotNull() & F.col("r").isNotNull()).alias("both"), F.count("*").alias("n"))
    return sides.select("qid", ratio(F.col("both"), F.col("n_l")).alias("precision"), ratio(F.col("both"), F.col("n_r")).alias("recall"), ratio(F.col("both"), F.col("n")).alias("jaccard"))


def case_coverage(returned: DataFrame, case_articles: DataFrame) -> DataFrame:
    """(covered, total, rate): returned cases (qid, case_id, article) that cite a returned article of their query."""
    covered = case_articles.join(returned.select("qid", "article").distinct(), ["qid", "article"], "left_semi").select("qid", "case_id").distinct().agg(F.count("*").alias("covered"))
    total = case_articles.select("qid", "case_id").distinct().agg(F.count("*").alias("total"))
    return covered.crossJoin(total).withColumn("rate", ratio(F.col("covered"), F.col("total")))  # two single rows


def micro_macro(per_query: DataFrame, hits: str, n: str, *group: str) -> DataFrame:
    """Mean of ratios and ratio of sums."""
    return per_query.groupBy(*group).agg(F.avg(ratio(F.col(hits), F.col(n))).alias("macro"), ratio(F.sum(hits), F.sum(n)).alias("micro"))


def ranking_quality(run: DataFrame, qrels: DataFrame | Relevance) -> DataFrame:
    """(qid, coverage, ranking, quality): share of relevant found, 1 / 0.8 / 0.6 by the first hit's place, their product."""
    rows = judged(run, qrels).groupBy("qid").agg(F.sum("rel").alias("hits"), F.min(F.when(F.col("rel") == 1, F.col("rank"))).alias("first"))
    own = rows.join(relevant_counts(qrels), "qid")
    place = F.when(F.col("first") <= 2, 1.0).when(F.col("first") <= 4, 0.8).when(F.col("first") == 5, 0.6).otherwise(0.0)
    cover = ratio(F.col("hits"), F.col("n_relevant"))
    return own.select("qid", cover.alias("coverage"), place.alias("ranking"), (cover * place).alias("quality"))


def band(value: Column) -> Column:
    """Rating of an overall score."""
    return F.when(value >= 0.8, "excellent").when(value >= 0.7, "good").when(value >= 0.6, "fair").when(value >= 0.5, "weak").otherwise("poor")


def summary(metrics: DataFrame) -> DataFrame:
    """(metric, value, verdict): strong from 0.7, weak under 0.5."""
    v = F.round("value", 4)
    return metrics.select("metric", v.alias("value"), F.when(v >= 0.7, "strength").when(v < 0.5, "weakness").otherwise("neutral").alias("verdict"))


def ground_truth(cases: DataFrame) -> DataFrame:
    """(article, case_id): cases by article, each pair once."""
    return cases.select(F.explode("articles").alias("article"), "case_id").distinct()


def ground_truth_stats(pairs: DataFrame) -> DataFrame:
    """Articles, cases, mean cases per article and articles per case, and the article with the most cases."""
    per = pairs.groupBy("article").agg(F.count("*").alias("n"))
    top = per.agg(F.max_by("article", F.struct(F.col("n"), -F.col("article"))).alias("top_article"), F.max("n").alias("top_cases"))
    return pairs.agg(F.countDistinct("article").alias("articles"), F.countDistinct("case_id").alias("cases"), F.count("*").alias("pairs")).select("*", (F.col("pairs") / F.col("articles")).alias("cases_per_article"), (F.col("pairs") / F.col("cases")).alias("articles_per_case")).crossJoin(top)


def sampled_queries(rows: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows in the order of a seeded hash: the same on every run."""
    return rows.orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")).cast("binary")), key).limit(n)


def query_text(text: Column, size: int = 200) -> Column:
    return F.substring(F.coalesce(text, F.lit("")), 1, size)


def query_set(rows: DataFrame, kind: str, key: str, text: Column, n: int, seed: int = 42) -> DataFrame:
    """(query_type, query_id, query_text): a seeded sample of rows as queries of a type."""
    return sampled_queries(rows, key, n, seed).select(F.lit(kind).alias("query_type"), F.col(key).cast("string").alias("query_id"), text.alias("query_text"))


def dispatched(queries: DataFrame, searches: dict[str, Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """Runs of all query types, each from the search of its type; a type without a search is an error of the caller."""
    runs = [search(queries.where(F.col("query_type") == kind)).withColumn("query_type", F.lit(kind)) for kind, search in searches.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), runs)


def run_report(queries: DataFrame, run: DataFrame, qrels: DataFrame | Relevance) -> DataFrame:
    """Per type: queries, those with results, results, mean precision over all queries, mean average precision."""
    found = judged(run, qrels).groupBy("qid").agg(F.count("*").alias("n"), F.avg("rel").alias("p"))
    per = queries.select("qid", "query_type").join(found, "qid", "left").join(average_precision(run, qrels).select("qid", "ap"), "qid", "left").fillna(0, ["n", "p", "ap"])
    return per.groupBy("query_type").agg(F.count("*").alias("queries"), F.count_if(F.col("n") > 0).alias("answered"), F.sum("n").alias("results"), F.avg("p").alias("mean_precision"), F.avg("ap").alias("map"))


def verdict(metrics: DataFrame, keys: list[str], precision: str = "precision@5", jaccard: str = "jaccard") -> DataFrame:
    """One row: mean of the key metrics, its rating, whether it passes (0.6), and what to improve."""
    own = lambda name: F.max(F.when(F.col("metric") == name, F.col("value")))
    score = F.avg(F.when(F.col("metric").isin(keys), F.round("value", 4)))
    out = metrics.agg(F.coalesce(score, F.lit(0.0)).alias("overall_score"), own(precision).alias("_p"), own(jaccard).alias("_j"))
    s = F.col("overall_score")
    advice = F.concat_ws("; ", F.when(s < 0.6, "improve the whole"), F.when(F.coalesce("_p", F.lit(0.0)) < 0.5, "raise precision"), F.when(F.coalesce("_j", F.lit(0.0)) < 0.3, "raise consistency"))
    return out.select("overall_score", band(s).alias("rating"), (s >= 0.6).alias("passed"), advice.alias("advice"))

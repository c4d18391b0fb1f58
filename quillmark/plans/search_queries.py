"""Vector, keyword and fused searches on the driver's tables, each with its SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import encode
from ..functions.encode import SYMBOLS
from ..operators import content, entity, fusion, keyword, quality, ranking, stages, vector, vector_index
from ..session import own_folder
from .common import SIMS_SQL, TOKENS, V_SQL, bm_run, bm_top, documents, final, items, keyword_run, rank_sql, sem_top, semantic_run, table, vector_queries, vectors

K, WIDE = 10, 20


def searched(spark: SparkSession, d: str, k: int = K, by_type: bool = False, threshold: float | None = None) -> DataFrame:
    return vector.search(vectors(spark, d), vector_queries(spark, d).select("qid", "vector"), k, by_type, threshold)


def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    return final(searched(spark, d), "qid", "doc_id", "doc_type", "score", "rank")


def vector_index_topk(spark: SparkSession, d: str) -> DataFrame:
    """`vector_topk` from an index that is written and read in the query."""
    folder = own_folder(spark, "vectors")
    vector_index.save_index(vectors(spark, d), folder)
    found = vector_index.search_index(vector_index.load_index(spark, folder, vectors(spark, d)), vector_queries(spark, d).select("qid", "vector"), K)
    return final(found, "qid", "doc_id", "doc_type", "score", "rank")


def projection() -> np.ndarray:
    """A small matrix by rule: what a letter counts for in each of eight places."""
    return np.array([[float((7 * i + 3 * j) % 5 - 2) for j in range(8)] for i in range(len(SYMBOLS))])


def encoded_search(spark: SparkSession, d: str) -> DataFrame:
    """The documents nearest to the benchmark's items, both as the stand-in model's vectors, projected."""
    folder = own_folder(spark, "projection")
    encode.save_projection(spark, projection(), folder)
    matrix = encode.load_projection(spark, folder)
    corpus = encode.encoded(documents(spark, d).select("doc_id", F.lit("A").alias("doc_type"), "text"), F.col("text"), encode.letter_model(), projection=matrix)
    asked = encode.encoded(items(spark, d), F.col("text"), encode.letter_model(), projection=matrix, unit=True)
    return final(vector.search(corpus, asked, K), "qid", "doc_id", "score", "rank")


def vector_topk_by_type(spark: SparkSession, d: str) -> DataFrame:
    first, second = ranking.split_counts(K)
    run = searched(spark, d, max(first, second), by_type=True)
    return final(run.where(F.col("rank") <= F.when(F.col("doc_type") == "A", first).otherwise(second)), "qid", "doc_type", "doc_id", "score", "rank")


def vector_threshold(spark: SparkSession, d: str) -> DataFrame:
    return final(searched(spark, d, 50, threshold=0.3), "qid", "doc_id", "score", "rank")


def vector_paged(spark: SparkSession, d: str) -> DataFrame:
    return final(ranking.page(searched(spark, d, 25).drop("rank"), 10, 10, "qid"), "qid", "doc_id", "score", "rank", "has_more")


def vector_by_id(spark: SparkSession, d: str) -> DataFrame:
    own = vectors(spark, d).select(F.concat_ws("_", F.when(F.col("doc_type") == "A", "article").otherwise("case"), F.col("doc_id").cast("string")).alias("id"), "doc_id", "label")
    return final(content.by_id(own.where(F.col("id").startswith("article")), own.where(F.col("id").startswith("case")), "article_0042").unionByName(content.by_id(own.where(F.col("id").startswith("article")), own.where(F.col("id").startswith("case")), "case_case_000007")), "id", "doc_id", "label")


def vector_align_norm(spark: SparkSession, d: str) -> DataFrame:
    own = vectors(spark, d).withColumn("scaled", vector.rescaled(F.col("vector"), 19.776))
    return final(own.select("doc_id", vector.norm(F.col("scaled")).alias("scaled_norm"), vector.cosine(F.col("vector"), F.col("scaled")).alias("similarity")))


def vector_calibrate(spark: SparkSession, d: str) -> DataFrame:
    scale = vector.calibration(vectors(spark, d), vector_queries(spark, d))
    scaled = vector.calibrated(vector_queries(spark, d).select("qid", "vector"), scale)
    return final(scaled.select("qid", vector.norm(F.col("vector")).alias("norm")).crossJoin(F.broadcast(scale)), "qid", "norm", "corpus_norm", "query_norm", "scale")


def vector_allpairs_stats(spark: SparkSession, d: str) -> DataFrame:
    return final(vector.sample_similarities(vectors(spark, d), F.md5(F.col("doc_id").cast("string").cast("binary")), 50))


def bm25_index_stats(spark: SparkSession, d: str) -> DataFrame:
    return final(keyword.term_weights(keyword.term_counts(documents(spark, d))), "term", "df", "idf")


def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return final(keyword_run(spark, d, K), "qid", "doc_id", "score", "rank")


def bm25_index_topk(spark: SparkSession, d: str) -> DataFrame:
    """`bm25_topk` from an index that is written and read in the query."""
    folder = own_folder(spark, "keywords")
    keyword.save_index(documents(spark, d), folder)
    return final(keyword.search_index(keyword.load_index(spark, folder, documents(spark, d)), items(spark, d), K), "qid", "doc_id", "score", "rank")


def bm25_query_boosted(spark: SparkSession, d: str) -> DataFrame:
    own = items(spark, d).withColumn("text", keyword.boosted("text", keyword.latin_tokens("text")))
    return final(keyword.search(documents(spark, d), own, K), "qid", "doc_id", "score", "rank")


def two_runs(spark: SparkSession, d: str, k: int = WIDE) -> DataFrame:
    own = ["qid", "doc_id", "path", "rank", "score"]
    sem = semantic_run(spark, d, k).withColumn("path", F.lit("semantic")).select(*own)
    return sem.unionByName(keyword_run(spark, d, k).withColumn("path", F.lit("bm25")).select(*own))


def rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    return final(fusion.rrf(two_runs(spark, d)), "qid", "doc_id", "score", "rank")


def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    return final(fusion.hybrid(semantic_run(spark, d, WIDE), keyword_run(spark, d, WIDE), K), "qid", "doc_id", "score", "rank", "similarity", "bm25_score", "search_method")


def weighted_fusion(spark: SparkSession, d: str) -> DataFrame:
    return final(fusion.weighted(two_runs(spark, d)), "qid", "doc_id", "fused", "paths", "consistency")


def fusion_final(spark: SparkSession, d: str) -> DataFrame:
    return final(fusion.final_rank(fusion.weighted(two_runs(spark, d)), K), "qid", "doc_id", "score", "rank")


def path_runs(spark: SparkSession, d: str, k: int = K) -> DataFrame:
    """Three paths with similarities in [0, 1] and texts: vectors, the enhanced query's keywords, and the query with its first
    keywords again.  Both keyword paths are one search.
    """
    texts, asked = documents(spark, d).select("doc_id", "text"), items(spark, d)
    sem = semantic_run(spark, d, k).where("score > 0").select("qid", "doc_id", F.lit("basic_semantic").alias("path"), "score")
    made = entity.clean_generated(entity.query2doc(F.coalesce("text", F.lit("")), F.array().cast("array<struct<crime_name:string,article_number:int>>")))
    ways = {"query2doc": entity.enhanced_query(F.col("text"), made, stages.BETWEEN), "bm25_hybrid": keyword.boosted("text", keyword.latin_tokens("text"))}
    each = asked.select("qid", F.explode(F.create_map(*[x for name, text in ways.items() for x in (F.lit(name), text)])).alias("path", "text"))
    words = keyword.search(texts, each.select(F.struct("qid", "path").alias("qid"), "text"), k)
    most = F.max("score").over(Window.partitionBy("qid"))
    bm = words.select("qid.qid", "doc_id", "qid.path", (F.col("score") / most).alias("score"))
    return sem.unionByName(bm).join(texts, "doc_id", "left")


def enhanced_rrf(spark: SparkSession, d: str) -> DataFrame:
    return final(fusion.enhanced_rrf(path_runs(spark, d)), "qid", "doc_id", "score", "rank", "paths", "sources", "display")


def path_confidence(spark: SparkSession, d: str) -> DataFrame:
    return final(fusion.path_confidence(path_runs(spark, d)), "qid", "path", "hits", "confidence")


def final_confidence(spark: SparkSession, d: str) -> DataFrame:
    runs = path_runs(spark, d)
    top = fusion.enhanced_rrf(runs).join(vectors(spark, d).select("doc_id", "doc_type"), "doc_id", "left")
    results = top.groupBy("qid").agg(F.count_if(F.col("doc_type") == "A").alias("n_a"), F.count_if(F.col("doc_type") == "B").alias("n_b"))
    return final(fusion.final_confidence(fusion.path_confidence(runs), results), "qid", "n_a", "n_b", "paths", "confidence")


def sourced_runs(spark: SparkSession, d: str) -> DataFrame:
    sem = semantic_run(spark, d, WIDE).select("qid", "doc_id", "score", F.lit("original").alias("source"), F.lit(0.5).alias("weight"))
    bm = keyword_run(spark, d, WIDE).select("qid", "doc_id", (F.col("score") / (1 + F.col("score"))).alias("score"), F.lit("related").alias("source"), F.lit(0.3).alias("weight"))
    return sem.unionByName(bm)


def adaptive_boost(spark: SparkSession, d: str) -> DataFrame:
    return final(fusion.adaptive_boost(fusion.accumulate(sourced_runs(spark, d))), "qid", "doc_id", "total", "best", "appearances", "sources", "original", "boosted")


def diversity_rank(spark: SparkSession, d: str) -> DataFrame:
    return final(fusion.diversity_rank(fusion.adaptive_boost(fusion.accumulate(sourced_runs(spark, d))), K), "qid", "doc_id", "boosted", "rank")


def consistency_search(spark: SparkSession, d: str) -> DataFrame:
    """Three of one type and ten of the other for each query, each type with ranks of its own."""
    run = searched(spark, d, 10, by_type=True)
    return final(run.where((F.col("doc_type") == "B") | (F.col("rank") <= 3)), "qid", "doc_type", "doc_id", "score", "rank")


def both_types(spark: SparkSession, d: str) -> DataFrame:
    return searched(spark, d, K, by_type=True).drop("rank")


def merge_simple(spark: SparkSession, d: str) -> DataFrame:
    return final(ranking.top_k(both_types(spark, d), K, "qid"), "qid", "doc_id", "doc_type", "score", "rank")


def merge_interleaved(spark: SparkSession, d: str) -> DataFrame:
    return final(ranking.interleaved(both_types(spark, d), K, "qid"), "qid", "doc_id", "doc_type", "score", "rank")


def merge_balanced(spark: SparkSession, d: str) -> DataFrame:
    return final(ranking.balanced(both_types(spark, d), K, "qid"), "qid", "doc_id", "doc_type", "score", "rank")


def type_then_similarity(spark: SparkSession, d: str) -> DataFrame:
    return final(ranking.type_then_similarity(both_types(spark, d), "qid"), "qid", "doc_id", "doc_type", "score", "rank")


def position_decay(spark: SparkSession, d: str) -> DataFrame:
    run = searched(spark, d)
    return final(run.withColumn("confidence", ranking.position_decay(run, 0.9)).withColumn("level", ranking.similarity_level()), "qid", "doc_id", "rank", "confidence", "level")


def ranking_stats(spark: SparkSession, d: str) -> DataFrame:
    run = searched(spark, d)
    return final(ranking.ranking_stats(run, "qid").join(ranking.is_descending(run, "qid"), "qid"))


def result_metadata(spark: SparkSession, d: str) -> DataFrame:
    return final(content.result_metadata(searched(spark, d), "qid"))


def type_counts(spark: SparkSession, d: str) -> DataFrame:
    return final(content.type_counts(vectors(spark, d)).withColumn("doc_type", F.coalesce("doc_type", F.lit("all"))))


def dq_vector_norms(spark: SparkSession, d: str) -> DataFrame:
    own = vectors(spark, d)
    return final(vector.norm_stats(own, "doc_type").crossJoin(F.broadcast(quality.normalised(own))))


def kmeans_clusters(spark: SparkSession, d: str) -> DataFrame:
    return vector.kmeans(vectors(spark, d))


TOP = f"WITH {SIMS_SQL}, t AS (SELECT *, {rank_sql()} AS rank FROM sims QUALIFY rank <= {K})"
BOTH = f"WITH {SIMS_SQL}, b AS (SELECT *, {rank_sql('qid, doc_type')} AS own FROM sims QUALIFY own <= {K})"
RUNS = f"WITH {sem_top(WIDE)}, {bm_top(WIDE)}, runs AS (SELECT qid, doc_id, 'semantic' AS path, rank, score FROM sem UNION ALL SELECT qid, doc_id, 'bm25', rank, score FROM bm)"
WEIGHTED = f"""{RUNS}, w AS (SELECT *, CASE path WHEN 'semantic' THEN 0.4::DOUBLE ELSE 0.35::DOUBLE END AS w FROM runs),
fused AS (SELECT qid, doc_id, sum(w / (60 + rank) + 0.3 * w * score) AS fused, count(*) AS paths,
  CASE WHEN count(*) = 1 THEN 1.0::DOUBLE ELSE greatest(0, 1 - stddev_pop(rank) / 20) END AS consistency FROM w GROUP BY ALL)"""
WAYS_SQL = f"""SELECT qid, unnest({TOKENS}) AS term FROM (
  SELECT {{'qid': item_id, 'path': 'query2doc'}} AS qid, text || ' [SEP] ' || CASE WHEN length(g) > 200 THEN substring(g, 1, 200) || '...' ELSE g END AS text
    FROM (SELECT *, '关于''' || text || '''的法律条文和相关案例分析。' AS g FROM benchmark)
  UNION ALL SELECT {{'qid': item_id, 'path': 'bm25_hybrid'}}, text || ' ' || array_to_string(({TOKENS})[1:5], ' ') FROM benchmark)"""
PATHS = f"""WITH {sem_top(K)}, {bm_run(WAYS_SQL)}, bm AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc_id) AS rank FROM bmall QUALIFY rank <= {K}),
norm AS (SELECT *, score / max(score) OVER (PARTITION BY qid) AS s FROM bm),
paths AS (SELECT p.*, text FROM (
  SELECT qid, doc_id, 'basic_semantic' AS path, score FROM sem WHERE score > 0 UNION ALL SELECT qid.qid, doc_id, qid.path, s FROM norm) p LEFT JOIN documents USING (doc_id)),
inside AS (SELECT *, row_number() OVER (PARTITION BY qid, path ORDER BY round(score, 9) DESC, doc_id) AS place,
  lower(substring(coalesce(text, ''), 1, 100)) AS snippet, CASE path WHEN 'query2doc' THEN 1 WHEN 'bm25_hybrid' THEN 3 ELSE 4 END AS turn,
  CASE path WHEN 'query2doc' THEN 2.2::DOUBLE WHEN 'bm25_hybrid' THEN 2.0 ELSE 1.8 END AS w FROM paths),
seen AS (SELECT *, row_number() OVER (PARTITION BY qid, snippet ORDER BY turn, place, doc_id) > 1 AS again FROM inside),
scored AS (SELECT qid, doc_id, sum(w / (20 + place) * (1 + 1.5 * score) * CASE WHEN again THEN 0.85 ELSE 1 END) * CASE WHEN count(*) > 1 THEN 1 + 0.3 * (count(*) - 1) ELSE 1 END AS score,
  count(*) AS paths, list_sort(list(DISTINCT path)) AS sources FROM seen GROUP BY ALL),
enhanced AS (SELECT *, {rank_sql()} AS rank FROM scored QUALIFY rank <= 5),
conf AS (SELECT qid, path, count(*) AS hits, avg(score) AS confidence FROM paths GROUP BY ALL)"""
SOURCED = f"""WITH {sem_top(WIDE)}, {bm_top(WIDE)}, runs AS (SELECT qid, doc_id, score, 'original' AS source, 0.5::DOUBLE AS weight FROM sem
  UNION ALL SELECT qid, doc_id, score / (1 + score), 'related', 0.3::DOUBLE FROM bm),
merged AS (SELECT qid, doc_id, sum(score * weight) AS total, max(score) AS best, count(*) AS appearances, list_sort(list(DISTINCT source)) AS sources, bool_or(source = 'original') AS original FROM runs GROUP BY ALL),
counted AS (SELECT *, count(*) OVER (PARTITION BY qid) AS n, max(total) OVER (PARTITION BY qid) AS top FROM merged),
factors AS (SELECT *, CASE WHEN n <= 3 THEN 2.5 WHEN n <= 10 THEN 1.8 WHEN n <= 50 THEN 1.3 ELSE 1.1 END AS f, CASE WHEN n <= 3 THEN 0.01 WHEN n <= 10 THEN 0.05 WHEN n <= 50 THEN 0.1 ELSE 0.2 END AS t FROM counted),
boosted AS (SELECT *, CASE WHEN n <= 10 OR (total >= t AND n <= 50) OR original
  THEN least(total * CASE WHEN total < 0.1 THEN f * 1.5 WHEN total < 0.3 THEN f ELSE least(f, 1.2) END, top * 1.5) ELSE total END AS boosted FROM factors)"""

LETTERS = "[" + ", ".join(f"length(l) - length(replace(l, '{c}', ''))" for c in SYMBOLS) + "]::DOUBLE[]"
PROJECTED = "[" + ", ".join(" + ".join(f"({(7 * i + 3 * j) % 5 - 2}) * e[{i + 1}]" for i in range(len(SYMBOLS))) for j in range(8)) + "]::DOUBLE[]"


def encoded_sql(table: str, key: str) -> str:
    return f"(SELECT id, p, sqrt(list_inner_product(p, p)) AS n FROM (SELECT id, {PROJECTED} AS p FROM (SELECT id, {LETTERS} AS e FROM (SELECT {key} AS id, lower(coalesce(text, '')) AS l FROM {table}))))"


SQL = {
    "encoded_search": f"""WITH q AS {encoded_sql("benchmark", "item_id")}, d AS {encoded_sql("documents", "doc_id")},
s AS (SELECT q.id AS qid, d.id AS doc_id, CASE WHEN q.n * d.n = 0 THEN 0 ELSE list_inner_product(q.p, d.p) / (q.n * d.n) END AS score FROM q CROSS JOIN d)
SELECT qid, doc_id, round(score, 6) AS score, {rank_sql()} AS rank FROM s QUALIFY rank <= {K}""",
    "vector_topk": f"{TOP} SELECT qid, doc_id, doc_type, round(score, 6) AS score, rank FROM t",
    "vector_index_topk": f"{TOP} SELECT qid, doc_id, doc_type, round(score, 6) AS score, rank FROM t",
    "vector_topk_by_type": f"{BOTH} SELECT qid, doc_type, doc_id, round(score, 6) AS score, own AS rank FROM b WHERE own <= 5",
    "consistency_search": f"{BOTH} SELECT qid, doc_type, doc_id, round(score, 6) AS score, own AS rank FROM b WHERE doc_type = 'B' OR own <= 3",
    "vector_threshold": f"WITH {SIMS_SQL} SELECT qid, doc_id, round(score, 6) AS score, {rank_sql()} AS rank FROM sims WHERE score >= 0.3 QUALIFY rank <= 50",
    "vector_paged": f"WITH {SIMS_SQL}, t AS (SELECT *, {rank_sql()} AS rank FROM sims QUALIFY rank <= 25) SELECT qid, doc_id, round(score, 6) AS score, rank, count(*) OVER (PARTITION BY qid) > 20 AS has_more FROM t QUALIFY rank BETWEEN 11 AND 20",
    "vector_by_id": "SELECT CASE WHEN label < 5 THEN 'article_' ELSE 'case_' END || vec_id AS id, vec_id AS doc_id, label::BIGINT AS label FROM embeddings WHERE (vec_id = 42 AND label < 5) OR (vec_id = 7 AND label >= 5)",
    "vector_align_norm": f"WITH {V_SQL} SELECT doc_id, round(CASE WHEN n = 0 THEN 0 ELSE 19.776 END, 6)::DOUBLE AS scaled_norm, CASE WHEN n = 0 THEN 0 ELSE 1 END::DOUBLE AS similarity FROM v",
    "vector_calibrate": f"WITH {V_SQL}, c AS (SELECT avg(n) AS corpus_norm, avg(n) FILTER (doc_id % 100 = 0) AS query_norm FROM v) SELECT doc_id AS qid, round(n * corpus_norm / query_norm, 6) AS norm, round(corpus_norm, 6) AS corpus_norm, round(query_norm, 6) AS query_norm, round(corpus_norm / query_norm, 6) AS scale FROM v, c WHERE doc_id % 100 = 0",
    "vector_allpairs_stats": f"""WITH {V_SQL}, s AS (SELECT * FROM v ORDER BY md5(doc_id::VARCHAR), doc_id LIMIT 50), p AS (SELECT CASE WHEN q.n * d.n = 0 THEN 0 ELSE list_inner_product(q.e, d.e) / (q.n * d.n) END AS x FROM s q JOIN s d ON q.doc_id < d.doc_id)
SELECT count(*) AS pairs, round(avg(x), 6) AS mean_similarity, round(stddev_pop(x), 6) AS std_similarity, round(min(x), 6) AS min_similarity, round(max(x), 6) AS max_similarity FROM p""",
    "bm25_index_stats": f"WITH {bm_run()} SELECT term, df, round(idf, 6) AS idf FROM idf",
    "bm25_topk": f"WITH {bm_top(K)} SELECT qid, doc_id, round(score, 6) AS score, rank FROM bm",
    "bm25_index_topk": f"WITH {bm_top(K)} SELECT qid, doc_id, round(score, 6) AS score, rank FROM bm",
    "bm25_query_boosted": "WITH "
    + bm_run("SELECT qid, unnest(list_concat(l, l[1:5])) AS term FROM (SELECT item_id AS qid, list_filter(string_split_regex(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda x: x <> '') AS l FROM benchmark)")
    + f" SELECT qid, doc_id, round(score, 6) AS score, {rank_sql()} AS rank FROM bmall QUALIFY rank <= {K}",
    "rrf_fusion": f"{RUNS}, f AS (SELECT qid, doc_id, sum(1 / (60 + rank)) AS score FROM runs GROUP BY ALL) SELECT qid, doc_id, round(score, 6) AS score, {rank_sql()} AS rank FROM f",
    "hybrid_search": f"{RUNS}, f AS (SELECT qid, doc_id, sum(1 / (60 + rank)) AS score FROM runs GROUP BY ALL), t AS (SELECT *, {rank_sql()} AS rank FROM f QUALIFY rank <= {K}) SELECT t.qid, t.doc_id, round(t.score, 6) AS score, t.rank, round(sem.score, 6) AS similarity, round(bm.score, 6) AS bm25_score, CASE WHEN sem.score IS NOT NULL THEN 'hybrid' ELSE 'bm25_only' END AS search_method FROM t LEFT JOIN sem ON sem.qid = t.qid AND sem.doc_id = t.doc_id LEFT JOIN bm ON bm.qid = t.qid AND bm.doc_id = t.doc_id",
    "weighted_fusion": f"{WEIGHTED} SELECT qid, doc_id, round(fused, 6) AS fused, paths, round(consistency, 6) AS consistency FROM fused",
    "fusion_final": f"{WEIGHTED}, s AS (SELECT *, fused + 0.1 * paths / 3 + 0.05 * consistency AS score FROM fused) SELECT qid, doc_id, round(score, 6) AS score, {rank_sql()} AS rank FROM s QUALIFY rank <= {K}",
    "enhanced_rrf": f"{PATHS} SELECT qid, doc_id, round(score, 6) AS score, rank, paths, sources, round(least(greatest(score, 0.001) * 100, 100), 6) AS display FROM enhanced",
    "path_confidence": f"{PATHS} SELECT qid, path, hits, round(confidence, 6) AS confidence FROM conf",
    "final_confidence": f"""{PATHS}, r AS (SELECT qid, count(*) FILTER (doc_type = 'A') AS n_a, count(*) FILTER (doc_type = 'B') AS n_b FROM enhanced LEFT JOIN v USING (doc_id) GROUP BY qid),
c AS (SELECT qid, avg(confidence) AS base, count(*) AS paths FROM conf GROUP BY qid)
SELECT qid, n_a, n_b, coalesce(paths, 0) AS paths, round(greatest(least(coalesce(base, 0.3)
  + CASE WHEN n_a >= 3 AND n_b >= 3 THEN 0.15 WHEN n_a >= 2 OR n_b >= 2 THEN 0.1 WHEN n_a >= 1 OR n_b >= 1 THEN 0.05 ELSE 0 END
  + CASE WHEN paths >= 3 THEN 0.1 WHEN paths >= 2 THEN 0.05 ELSE 0 END, 0.95), 0.1), 6) AS confidence FROM r LEFT JOIN c USING (qid)""",
    "adaptive_boost": f"{SOURCED} SELECT qid, doc_id, round(total, 6) AS total, round(best, 6) AS best, appearances, sources, original, round(boosted, 6) AS boosted FROM boosted",
    "diversity_rank": f"{SOURCED} SELECT qid, doc_id, round(boosted, 6) AS boosted, row_number() OVER (PARTITION BY qid ORDER BY round(boosted, 9) DESC, appearances DESC, round(best, 9) DESC, doc_id) AS rank FROM boosted QUALIFY rank <= {K}",
    "merge_simple": f"{BOTH} SELECT qid, doc_id, doc_type, round(score, 6) AS score, {rank_sql()} AS rank FROM b QUALIFY rank <= {K}",
    "merge_interleaved": f"""{BOTH}, l AS (SELECT *, min(CASE WHEN doc_type = 'B' THEN round(score, 9) END) OVER (PARTITION BY qid) AS last FROM b)
SELECT qid, doc_id, doc_type, round(score, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc_type, doc_id) AS rank
FROM l WHERE NOT (doc_type = 'A' AND round(score, 9) < 0 AND (last IS NULL OR round(score, 9) < last)) QUALIFY rank <= {K}""",
    "merge_balanced": f"""{BOTH}, p AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY (own <= 3) DESC, round(score, 9) DESC, doc_id) AS place FROM b QUALIFY place <= {K})
SELECT qid, doc_id, doc_type, round(score, 6) AS score, {rank_sql()} AS rank FROM p""",
    "type_then_similarity": f"{BOTH} SELECT qid, doc_id, doc_type, round(score, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY doc_type, round(score, 9) DESC, doc_id) AS rank FROM b",
    "position_decay": f"{TOP} SELECT qid, doc_id, rank, round(0.9 * greatest(0.3, 1 - 0.1 * (rank - 1)), 3)::DOUBLE AS confidence, CASE WHEN score >= 0.9 THEN 'very_high' WHEN score >= 0.8 THEN 'high' WHEN score >= 0.6 THEN 'medium' ELSE 'low' END AS level FROM t",
    "ranking_stats": f"{TOP} SELECT qid, count(*) AS n, round(avg(score), 6) AS mean_score, round(min(score), 6) AS min_score, round(max(score), 6) AS max_score, round(stddev_pop(score), 6) AS std_score, round(max(score) - min(score), 6) AS range_score, count(*) FILTER (doc_type = 'A') AS n_a, count(*) FILTER (doc_type = 'B') AS n_b, true AS is_descending FROM t GROUP BY qid",
    "result_metadata": f"{TOP} SELECT qid, count(*) AS n, count(*) FILTER (doc_type = 'A') AS n_a, count(*) FILTER (doc_type = 'B') AS n_b, round(min(score), 6) AS min_score, round(max(score), 6) AS max_score, round(avg(score), 6) AS avg_score FROM t GROUP BY qid",
    "type_counts": f"WITH {V_SQL} SELECT coalesce(doc_type, 'all') AS doc_type, count(*) AS n FROM v GROUP BY ROLLUP (doc_type)",
    "dq_vector_norms": f"WITH {V_SQL} SELECT doc_type, count(*) AS n, round(avg(n), 6) AS norm_mean, round(stddev_pop(n), 6) AS norm_std, round(min(n), 6) AS norm_min, round(max(n), 6) AS norm_max, (SELECT bool_and(abs(n - 1) <= 1.1e-5) FROM v) AS is_normalised FROM v GROUP BY doc_type",
}

QUERIES = {
    f.__name__: f
    for f in (
        vector_topk, vector_index_topk, encoded_search, vector_topk_by_type, vector_threshold, vector_paged, vector_by_id, vector_align_norm, vector_calibrate, vector_allpairs_stats,
        bm25_index_stats, bm25_topk, bm25_index_topk, bm25_query_boosted, rrf_fusion, hybrid_search, weighted_fusion, fusion_final, enhanced_rrf, path_confidence,
        final_confidence, adaptive_boost, diversity_rank, merge_simple, merge_interleaved, merge_balanced, type_then_similarity, position_decay,
        ranking_stats, result_metadata, type_counts, dq_vector_norms, kmeans_clusters, consistency_search,
    )
}

"""Evaluation as one run, declared predicates, reports and generated texts on the driver's tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import content, entity, evaluate, graph, quality, vector
from ..operators.ranking import top_k
from ..sources.tables import graph_report
from ..streaming import trace
from .common import COSINE, SIMS_SQL, V_SQL, documents, final, rank_sql, table, vector_queries, vectors
from .eval_queries import OVERALL, by_type
from .graph_queries import CASES, EDGES, cases, dq_status, edges, stored
from .graph_queries import SQL as GRAPH_SQL

KEY_METRICS = ["precision@5", "recall@5", "hit@5", "ap", "rr"]
COLUMNS = {"documents": ["doc_id", "text", "title"], "embeddings": ["vec_id", "embedding", "label", "total_count"], "benchmark": ["item_id", "text"]}


def declared_predicates(spark: SparkSession, d: str) -> DataFrame:
    """Cases by an accusation and by a cited article."""
    own = cases(spark, d)
    crime = content.by_accusation(own, "Brand#11", "crimes").select("case_id", F.lit("accusation").alias("predicate"))
    return crime.unionByName(content.by_cited_article(own, 7, "articles").select("case_id", F.lit("cited_article").alias("predicate")))


def crime_typical(spark: SparkSession, d: str) -> DataFrame:
    own = cases(spark, d)
    return final(graph.crime_summary(own).select("crime", "cases", "avg_months").join(graph.typical_cases(own), "crime", "left"))


def expansion_stats(spark: SparkSession, d: str) -> DataFrame:
    return trace.expansion_stats(table(spark, d, "events"), F.col("value") > 75, F.col("value") / 1000, "event_type")


def vector_cross_stats(spark: SparkSession, d: str) -> DataFrame:
    own = vectors(spark, d)
    return final(vector.cross_similarities(own.where("doc_type = 'A'"), own.where("doc_type = 'B'")))


def eval_verdict(spark: SparkSession, d: str) -> DataFrame:
    return final(evaluate.verdict(evaluate.overall(by_type(spark, d), {"consistency": 2.0, "article_to_case": 1.5}), KEY_METRICS))


def query_sets(spark: SparkSession, d: str) -> DataFrame:
    """The four generators: cited articles, cases that cite, crimes, excerpts of documents."""
    own, docs = cases(spark, d), documents(spark, d)
    articles = own.select(F.explode("articles").alias("article")).groupBy("article").agg(F.count("*").alias("n"))
    crimes = own.select(F.explode("crimes").alias("crime")).distinct()
    sets = [
        evaluate.query_set(articles, "article_to_case", "article", F.concat(F.lit("article "), F.col("article").cast("string")), 10),
        evaluate.query_set(own.where(F.size("articles") > 0), "case_to_article", "case_id", evaluate.query_text(F.array_join("crimes", ", ")), 10),
        evaluate.query_set(crimes, "crime", "crime", F.col("crime"), 10),
        evaluate.query_set(docs, "mixed", "doc_id", evaluate.query_text(F.col("text"), 100), 10),
    ]
    return sets[0].unionByName(sets[1]).unionByName(sets[2]).unionByName(sets[3])


def eval_run(spark: SparkSession, d: str) -> DataFrame:
    """Queries of two types, each sent to its own search, and the report on what they found."""
    own = vectors(spark, d)
    asked = vector_queries(spark, d).withColumn("query_type", F.when(F.col("qlabel") < 5, "article_to_case").otherwise("consistency"))

    def searched(docs: DataFrame, k: int):
        return lambda queries: top_k(vector.search(docs, queries.select("qid", "vector"), k + 1).where("doc_id <> qid").drop("rank"), k, "qid")

    run = stored(evaluate.dispatched(asked, {"article_to_case": searched(own.where("doc_type = 'A'"), 10), "consistency": searched(own, 20)}), "run")
    qrels = evaluate.by_label(run, asked.select("qid", F.col("qlabel").alias("label")), own)
    return final(evaluate.run_report(asked, run, qrels))


def dq_structure(spark: SparkSession, d: str) -> DataFrame:
    return quality.structure(spark, {name: table(spark, d, name) for name in COLUMNS}, COLUMNS)


def dq_advice(spark: SparkSession, d: str) -> DataFrame:
    return quality.advice(dq_status(spark, d).drop("status"))


def health_stats(spark: SparkSession, d: str) -> DataFrame:
    return quality.health({name: table(spark, d, name) for name in ("documents", "embeddings", "benchmark")})


def graph_validate(spark: SparkSession, d: str) -> DataFrame:
    return graph_report(edges(spark, d))


def generated_clean(spark: SparkSession, d: str) -> DataFrame:
    """Every turn cleaned as a generated answer, and put behind its role as an enhanced query."""
    own = table(spark, d, "conversations").withColumn("answer", entity.clean_answer(F.col("text")))
    return own.select("conv_id", "turn", F.length("answer").cast("long").alias("n"), F.md5(entity.enhanced_query(F.col("role"), F.col("answer")).cast("binary")).alias("enhanced_md5"))


def fallback_answers(spark: SparkSession, d: str) -> DataFrame:
    """The answer without a generator for vectors as queries: titles of one type, the number of the other."""
    run = vector.search(vectors(spark, d), vector_queries(spark, d).select("qid", "vector"), 10)
    asked = vector_queries(spark, d).select("qid", F.concat(F.lit("query "), F.col("qid").cast("string")).alias("text"))
    titled = run.where("doc_type = 'A'").select("qid", F.row_number().over(Window.partitionBy("qid").orderBy("rank")).alias("rank"), F.concat(F.lit("item "), F.col("doc_id").cast("string")).alias("title"))
    return entity.fallback_answer(asked, titled, run.where("doc_type = 'B'").select("qid", "rank"))


def display_forms(spark: SparkSession, d: str) -> DataFrame:
    """Values of events as they are shown: percentage, milliseconds, band, time."""
    share = F.col("value") / 100
    return table(spark, d, "events").select("event_id", content.percent(share).alias("percent"), content.milliseconds(share).alias("ms"), content.confidence_band(share).alias("band"), content.iso_time(F.col("ts")).alias("at"))


CLEAN = "regexp_replace({}, '^[ \\t\\r\\n]+|[ \\t\\r\\n]+$', '', 'g')".format
FIRST, FOUND, LISTED, CLOSING = (part.replace("'", "''").replace("%s", "%") for part in entity.FALLBACK)


def answer_sql() -> str:
    """The steps of `entity.clean_answer`, one common table each."""
    steps = [f"c0 AS (SELECT conv_id, turn, role, {CLEAN('coalesce(text, chr(32))')} AS a FROM conversations)"]
    exprs = [CLEAN(f"regexp_replace(a, '^({'|'.join(entity.ANSWER_STARTS)})', '')")]
    exprs += [f"regexp_replace(a, '[ \\t\\r\\n]*{end}$', '')" for end in entity.ANSWER_ENDS]
    exprs += [CLEAN("regexp_replace(a, '(?s)^\"(.*)\"$', '\\1')"), CLEAN("regexp_replace(a, '(?s)^「(.*)」$', '\\1')")]
    cut = "CASE WHEN length(a) > 300 THEN coalesce(nullif(regexp_extract(substring(a, 1, 300), '(?s)^(.*。)', 1), ''), substring(a, 1, 300) || '...') ELSE a END"
    exprs.append(f"CASE WHEN length(a) < 15 THEN '' ELSE {CLEAN(f'''regexp_replace({cut}, '{'|'.join(entity.SMALL_TALK)}', '', 'g')''')} END")
    for i, e in enumerate(exprs):
        steps.append(f"c{i + 1} AS (SELECT conv_id, turn, role, {e} AS a FROM c{i})")
    return f"WITH {', '.join(steps)} SELECT conv_id, turn, length(a) AS n, md5(concat_ws(' ', role, nullif(a, ''))) AS enhanced_md5 FROM c{len(exprs)}"


def set_sql(kind: str, rows: str, key: str, text: str) -> str:
    return f"(SELECT '{kind}' AS query_type, {key}::VARCHAR AS query_id, {text} AS query_text FROM {rows} ORDER BY md5({key}::VARCHAR || ':42'), {key} LIMIT 10)"


ADVICE = "concat_ws('; ', CASE WHEN count_mismatch > 0 THEN 'rebuild the vectors' END, CASE WHEN id_mismatch > 0 THEN 'match the ids' END, CASE WHEN empty > 0 THEN 'fill empty contents' END, CASE WHEN zero > 0 THEN 'encode zero vectors again' END)"
SQL = {
    "declared_predicates": f"WITH {CASES} SELECT case_id, 'accusation' AS predicate FROM cases WHERE list_contains(crimes, 'Brand#11') UNION ALL SELECT case_id, 'cited_article' FROM cases WHERE list_contains(articles, 7)",
    "crime_typical": f"WITH {CASES}, e AS (SELECT case_id, months, unnest(crimes) AS crime FROM cases) SELECT crime, count(*) AS cases, round(avg(months), 6) AS avg_months, list_sort(list(case_id))[1:3] AS typical FROM e GROUP BY crime",
    "expansion_stats": "SELECT event_type, count(*) AS searches, count(*) FILTER (value > 75) AS expanded, round(count(*) FILTER (value > 75) / count(*), 3) AS expansion_rate, round(avg(value / 1000) * 1000, 2) AS avg_ms FROM events GROUP BY event_type",
    "vector_cross_stats": f"""WITH {V_SQL}, a AS (SELECT * FROM v WHERE doc_type = 'A' ORDER BY doc_id LIMIT 10), b AS (SELECT * FROM v WHERE doc_type = 'B' ORDER BY doc_id LIMIT 10), p AS (SELECT {COSINE} AS s FROM a q, b d)
SELECT count(*) AS pairs, round(avg(s), 6) AS mean_similarity, round(stddev_pop(s), 6) AS std_similarity, round(min(s), 6) AS min_similarity, round(max(s), 6) AS max_similarity FROM p""",
    "eval_verdict": f"""{OVERALL}, s AS (SELECT avg(round(value, 4)) AS s FROM o WHERE metric IN ('precision@5', 'recall@5', 'hit@5', 'ap', 'rr')), p AS (SELECT max(value) FILTER (metric = 'precision@5') AS p FROM o)
SELECT round(s, 6) AS overall_score, CASE WHEN s >= 0.8 THEN 'excellent' WHEN s >= 0.7 THEN 'good' WHEN s >= 0.6 THEN 'fair' WHEN s >= 0.5 THEN 'weak' ELSE 'poor' END AS rating, s >= 0.6 AS passed,
concat_ws('; ', CASE WHEN s < 0.6 THEN 'improve the whole' END, CASE WHEN p < 0.5 THEN 'raise precision' END, 'raise consistency') AS advice FROM s, p""",
    "query_sets": f"""WITH {CASES}, a AS (SELECT DISTINCT unnest(articles) AS article FROM cases), c AS (SELECT DISTINCT unnest(crimes) AS crime FROM cases)
{set_sql("article_to_case", "a", "article", "'article ' || article::VARCHAR")} UNION ALL {set_sql("case_to_article", "cases", "case_id", "substring(array_to_string(crimes, ', '), 1, 200)")}
UNION ALL {set_sql("crime", "c", "crime", "crime")} UNION ALL {set_sql("mixed", "documents", "doc_id", "substring(coalesce(text, ''), 1, 100)")}""",
    "eval_run": f"""WITH {SIMS_SQL}, asked AS (SELECT doc_id AS qid, CASE WHEN label < 5 THEN 'article_to_case' ELSE 'consistency' END AS query_type FROM v WHERE doc_id % 100 = 0),
run AS (SELECT *, {rank_sql()} AS rank, label = qlabel AS rel FROM sims WHERE doc_id <> qid AND (qlabel >= 5 OR doc_type = 'A') QUALIFY rank <= CASE WHEN qlabel < 5 THEN 10 ELSE 20 END),
nr AS (SELECT qid, count(*) AS n_relevant FROM sims WHERE doc_id <> qid AND label = qlabel GROUP BY qid),
parts AS (SELECT *, CASE WHEN rel THEN count(*) FILTER (rel) OVER (PARTITION BY qid ORDER BY rank) / rank ELSE 0 END AS part FROM run),
per AS (SELECT qid, count(*) AS n, avg(rel::INT) AS p, coalesce(sum(part) / any_value(n_relevant), 0) AS ap FROM parts LEFT JOIN nr USING (qid) GROUP BY qid)
SELECT query_type, count(*) AS queries, count(*) FILTER (n > 0) AS answered, coalesce(sum(n), 0)::BIGINT AS results, round(avg(coalesce(p, 0)), 6) AS mean_precision, round(avg(coalesce(ap, 0)), 6) AS map FROM asked LEFT JOIN per USING (qid) GROUP BY query_type""",
    "dq_structure": " UNION ALL ".join(f"SELECT '{t}' AS source, '{c}' AS column, '{c}' IN (SELECT column_name FROM (DESCRIBE {t})) AS present" for t, columns in COLUMNS.items() for c in columns),
    "dq_advice": f"SELECT *, CASE WHEN {ADVICE} = '' THEN 'none' ELSE {ADVICE} END AS advice FROM ({GRAPH_SQL['dq_status']})",
    "health_stats": " UNION ALL ".join(f"SELECT '{t}' AS source, count(*) AS n, CASE WHEN count(*) > 0 THEN 'ready' ELSE 'empty' END AS state FROM {t}" for t in ("documents", "embeddings", "benchmark")),
    "graph_validate": f"{EDGES} SELECT count(*) AS edges, '' AS lacking, count(*) > 0 AS success FROM edges",
    "generated_clean": answer_sql(),
    "fallback_answers": f"""WITH {SIMS_SQL}, run AS (SELECT *, {rank_sql()} AS rank FROM sims QUALIFY rank <= 10), asked AS (SELECT DISTINCT qid FROM sims),
a AS (SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY rank) AS r FROM run WHERE doc_type = 'A'),
law AS (SELECT qid, count(*) AS n, string_agg(r || '. item ' || doc_id, chr(10) ORDER BY r) FILTER (r <= 3) AS lines FROM a GROUP BY qid), found AS (SELECT qid, count(*) AS n FROM run WHERE doc_type = 'B' GROUP BY qid)
SELECT qid, replace('{FIRST}', '%', 'query ' || qid) || coalesce(replace('{FOUND}', '%d', law.n::VARCHAR) || lines || chr(10) || chr(10), '') || coalesce(replace('{LISTED}', '%d', found.n::VARCHAR), '') || '{CLOSING}' AS answer
FROM asked LEFT JOIN law USING (qid) LEFT JOIN found USING (qid)""",
    "display_forms": "SELECT event_id, round((value / 100 * 100)::DECIMAL(20, 6), 1)::VARCHAR || '%' AS percent, round(value / 100 * 1000)::BIGINT || 'ms' AS ms, CASE WHEN value / 100 >= 0.9 THEN 'very_high' WHEN value / 100 >= 0.8 THEN 'high' WHEN value / 100 >= 0.7 THEN 'medium' ELSE 'low' END AS band, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS at FROM events",
}

QUERIES = {
    f.__name__: f
    for f in (
        declared_predicates, crime_typical, expansion_stats, vector_cross_stats, eval_verdict, query_sets, eval_run, dq_structure, dq_advice,
        health_stats, graph_validate, generated_clean, fallback_answers, display_forms,
    )
}

"""Relation graph, entities, contents and audits on the driver's tables, each with its SQL.

An order stands for a case: the brands of its parts are the accusations (crimes), its suppliers the cited articles, and
its key modulo 240 the months of the sentence.  Where articles are few to a case, groups of part sizes stand for them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import content, entity, fusion, graph, keyword, quality, ranking
from ..session import own_folder
from ..sources import tables
from .common import TOKENS, documents, final, table, vectors

STOP = "and are for from that the this was with".split()


def cases(spark: SparkSession, d: str, article: str = "l_suppkey") -> DataFrame:
    """(case_id, crimes, articles, months)."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand", (F.col("p_size") % 12).cast("long").alias("p_group"))
    own = lines.join(parts, "l_partkey").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("p_brand")).alias("crimes"), F.array_sort(F.collect_set(article)).alias("articles"))
    return own.select(F.col("l_orderkey").alias("case_id"), "crimes", "articles", (F.col("l_orderkey") % 240).alias("months"))


def edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.co_occurrences(cases(spark, d))


def group_edges(spark: SparkSession, d: str) -> DataFrame:
    """A graph of fewer articles: groups of part sizes instead of suppliers."""
    return graph.co_occurrences(cases(spark, d, "p_group"))


def relations(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(edges, the three first articles of each crime by groups), each written once for all that use them."""
    return stored(edges(spark, d), "edges"), stored(graph.related_articles(group_edges(spark, d), 3), "articles")


def graph_edges(spark: SparkSession, d: str) -> DataFrame:
    return edges(spark, d)


def graph_stats(spark: SparkSession, d: str) -> DataFrame:
    own = edges(spark, d)
    return final(graph.totals(own).crossJoin(graph.degree_stats(own)))


def graph_quality(spark: SparkSession, d: str) -> DataFrame:
    return final(graph.quality(edges(spark, d)))


def graph_top_nodes(spark: SparkSession, d: str) -> DataFrame:
    own = edges(spark, d)
    side = lambda key, by: graph.top_nodes(own, key, 5, by).select(F.lit(key).alias("side"), F.lit(by).alias("by"), F.col(key).cast("string").alias("node"), "degree", "cases")
    return side("crime", "degree").unionByName(side("article", "degree")).unionByName(side("crime", "cases")).unionByName(side("article", "cases"))


def related_articles(spark: SparkSession, d: str) -> DataFrame:
    return final(graph.related_articles(group_edges(spark, d)).withColumn("level", graph.confidence_level(F.col("confidence"))))


def related_crimes(spark: SparkSession, d: str) -> DataFrame:
    return final(graph.related_crimes(edges(spark, d)).withColumn("level", graph.confidence_level(F.col("confidence"))))


def relation_details(spark: SparkSession, d: str) -> DataFrame:
    return final(graph.relation_details(edges(spark, d)))


def star_edges(spark: SparkSession, d: str) -> DataFrame:
    return final(graph.star(graph.related_articles(group_edges(spark, d)), "crime", "article")[1])


def star_nodes(spark: SparkSession, d: str) -> DataFrame:
    return graph.star(graph.related_articles(group_edges(spark, d)), "crime", "article")[0]


def crimes_list(spark: SparkSession, d: str) -> DataFrame:
    return graph.crimes_list(edges(spark, d))


def articles_list(spark: SparkSession, d: str) -> DataFrame:
    return final(graph.articles_list(edges(spark, d)))


def relation_cases(spark: SparkSession, d: str) -> DataFrame:
    own = cases(spark, d).select("case_id", F.col("crimes").alias("accusations"), F.col("articles").alias("relevant_articles"))
    return graph.cases_of_relation(own, "Brand#1", 7, 20).select("case_id")


def graph_export(spark: SparkSession, d: str) -> DataFrame:
    return tables.export_rows(edges(spark, d))


def article_summary(spark: SparkSession, d: str) -> DataFrame:
    return final(graph.article_summary(cases(spark, d)))


def crime_summary(spark: SparkSession, d: str) -> DataFrame:
    return final(graph.crime_summary(cases(spark, d)))


def part_texts(spark: SparkSession, d: str) -> DataFrame:
    """(qid, text): the parts' texts, which name a brand (a crime) and numbers (articles)."""
    return table(spark, d, "part").select(F.col("p_partkey").alias("qid"), F.concat_ws(" ", "p_name", "p_brand", "p_type", F.col("p_size").cast("string")).alias("text"))


def stored(df: DataFrame, name: str) -> DataFrame:
    """A small table that a query uses several times, written once."""
    path = own_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def entities(spark: SparkSession, d: str, asked: DataFrame, own: DataFrame | None = None) -> DataFrame:
    """(qid, crime, article): the graph's crimes that a text contains, and its numbers that are articles of the graph."""
    own = stored(edges(spark, d), "edges") if own is None else own
    crimes = entity.contained(asked, own.select("crime").distinct(), word="crime").select("qid", "crime", F.lit(None).cast("long").alias("article"))
    numbers = asked.select("qid", F.explode(F.array_distinct(F.filter(F.split("text", " "), lambda w: w.rlike("^[0-9]{1,9}$")))).alias("n"))
    articles = numbers.select("qid", F.lit(None).cast("string").alias("crime"), F.col("n").cast("long").alias("article")).join(own.select("article").distinct(), "article", "left_semi")
    return crimes.unionByName(articles)


def related(spark: SparkSession, d: str, asked: DataFrame, k: int = 3, own: DataFrame | None = None, articles: DataFrame | None = None) -> DataFrame:
    """(qid, kind, word, confidence) of what the entities of texts lead to; edges and related articles may be given."""
    own = stored(edges(spark, d), "edges") if own is None else own
    articles = graph.related_articles(group_edges(spark, d), k) if articles is None else articles
    return graph.related_of(stored(entities(spark, d, asked, own), "entities"), articles, graph.related_crimes(own, k), k)


def query_expand(spark: SparkSession, d: str) -> DataFrame:
    own = stored(edges(spark, d), "edges")
    found = stored(entities(spark, d, part_texts(spark, d), own), "entities")
    many = found.groupBy("qid").agg(F.count("*").alias("entities"))
    out = graph.expand(found, graph.related_articles(group_edges(spark, d), 3), graph.related_crimes(own, 3)).join(many, "qid")
    return final(out.withColumn("quality", graph.expansion_quality(F.col("entities"), F.col("relations"), F.col("mean_confidence"))))


def explain_search(spark: SparkSession, d: str) -> DataFrame:
    return graph.explain(entities(spark, d, part_texts(spark, d)), graph.related_articles(group_edges(spark, d), 3))


def asked_parts(spark: SparkSession, d: str) -> DataFrame:
    """The stated query set: texts of the parts whose key is divisible by a hundred."""
    return part_texts(spark, d).where(F.col("qid") % 100 == 0)


def shelf(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, doc_type, text): suppliers as articles, numbered below zero, and parts as cases."""
    articles = table(spark, d, "supplier").select((-1 - F.col("s_suppkey")).alias("doc_id"), F.lit("A").alias("doc_type"), F.concat_ws(" nation ", "s_name", F.col("s_nationkey").cast("string")).alias("text"))
    return articles.unionByName(part_texts(spark, d).select(F.col("qid").alias("doc_id"), F.lit("B").alias("doc_type"), "text"))


def names(spark: SparkSession, d: str) -> DataFrame:
    """(kind, word, text): what articles and crimes are searched by."""
    articles = table(spark, d, "supplier").select(F.lit("article").alias("kind"), F.col("s_suppkey").cast("string").alias("word"), F.col("s_name").alias("text"))
    brands = table(spark, d, "part").select("p_brand").distinct()
    return articles.unionByName(brands.select(F.lit("crime").alias("kind"), F.col("p_brand").alias("word"), F.col("p_brand").alias("text")))


def shelf_search(spark: SparkSession, d: str) -> Callable[[DataFrame, int], DataFrame]:
    docs = shelf(spark, d).select("doc_id", "text")
    counts = stored(keyword.term_counts(docs), "term-counts")

    def search(queries: DataFrame, k: int) -> DataFrame:
        alike = stored(ranking.copies(docs, k, "text"), "copies")
        return ranking.of_copies(alike, queries, k, lambda few, asked: keyword.search(few, asked, k, counts=counts))

    return search


def graph_enhanced_search(spark: SparkSession, d: str) -> DataFrame:
    asked = asked_parts(spark, d)
    out = fusion.graph_enhanced(asked, related(spark, d, asked, 3, *relations(spark, d)), names(spark, d), shelf_search(spark, d), 10)
    return final(out, "qid", "doc_id", "boosted", "appearances", "sources", "rank")


def entity_search(spark: SparkSession, d: str) -> DataFrame:
    """Each crime of the graph as an entity, with its five first articles."""
    own = group_edges(spark, d)
    crimes = own.select("crime").distinct().select(F.col("crime").alias("qid"), F.lit("original").alias("source"), F.col("crime").alias("text"))
    near = graph.related_articles(own, 5).select(F.col("crime").alias("qid"), F.col("article").cast("string").alias("word"))
    others = near.join(names(spark, d).where("kind = 'article'"), "word").select("qid", F.concat(F.lit("article:"), "word").alias("source"), "text")
    return final(fusion.entity_focused(crimes.unionByName(others), shelf_search(spark, d), 10), "qid", "doc_id", "boosted", "appearances", "sources", "rank")


def graph_path(spark: SparkSession, d: str) -> DataFrame:
    contents = table(spark, d, "supplier").select(F.col("s_suppkey").alias("article"), F.concat_ws(" nation ", "s_name", F.col("s_nationkey").cast("string")).alias("content"))
    return final(graph.path_articles(related(spark, d, part_texts(spark, d)), contents))


def vocabulary(spark: SparkSession, d: str) -> DataFrame:
    words = F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda w: F.length(w) >= 6)
    return table(spark, d, "benchmark").select(F.get(words, 0).alias("word")).where("word IS NOT NULL").distinct()


def user_turns(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").where("role = 'user'").select((F.col("conv_id") * 100 + F.col("turn")).alias("qid"), F.lower(F.coalesce("text", F.lit(""))).alias("text"))


def detect_entities(spark: SparkSession, d: str) -> DataFrame:
    return entity.contained(user_turns(spark, d), vocabulary(spark, d)).select("qid", "word")


def keyword_extract(spark: SparkSession, d: str) -> DataFrame:
    return final(entity.latin_keywords(user_turns(spark, d), STOP))


def routing_plan(spark: SparkSession, d: str) -> DataFrame:
    turns = user_turns(spark, d)
    size = F.length("text")
    paths = entity.route(F.array_repeat(F.lit(1), (size % 2).cast("int")), F.when(size % 3 > 0, F.col("text")), F.when(size % 5 > 0, F.col("text")), F.array_repeat(F.lit(1), (size % 7).cast("int")))
    return final(entity.routing_plan(turns.select("qid", paths.alias("paths"))))


def normalise_names(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "supplier")
    raw = F.concat(F.lit(" ["), F.col("s_name"), F.lit("] "))
    return own.select("s_suppkey", graph.normal_crime(raw).alias("name"), graph.article_number(F.col("s_name")).alias("number"), content.canonical_id(F.concat(F.lit("CASE_case_"), F.col("s_name"))).alias("id"))


def severe_flag(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "orders")
    return own.select("o_orderkey", content.severe_punishment(F.col("o_orderstatus") == "F", F.col("o_orderpriority") == "1-URGENT", F.col("o_orderkey") % 240).alias("severe"))


def corpus_lexicon(spark: SparkSession, d: str) -> DataFrame:
    return final(entity.lexicon_of_corpus(documents(spark, d).where("lang = 'en'"), 150, 0.015, STOP, "[^a-z]+"))


def scored_documents(spark: SparkSession, d: str) -> DataFrame:
    """(qid, doc_id, doc_type, score): each document under its source, scored by its length."""
    own = table(spark, d, "documents")
    return own.select(F.col("source").alias("qid"), "doc_id", F.when(F.col("lang") == "en", "A").otherwise("B").alias("doc_type"), (F.col("n_chars") % 1000 / 1000).alias("score"))


def content_join(spark: SparkSession, d: str) -> DataFrame:
    ids = table(spark, d, "labels").select(F.concat(F.lit("case_case_"), F.lpad(F.col("doc_id").cast("string"), 6, "0")).alias("doc_id"), "quality")
    docs = documents(spark, d).select(F.concat(F.lit("case_"), F.col("doc_id").cast("string")).alias("id"), "text")
    return final(content.join_content(ids, docs, doc_id="id").select("doc_id", "quality", F.length("content").alias("size")))


def length_filter(spark: SparkSession, d: str) -> DataFrame:
    rows = scored_documents(spark, d).join(documents(spark, d).select("doc_id", F.col("text").alias("content")), "doc_id")
    return final(content.adaptive_length_filter(rows, 200, 10), "qid", "doc_id", "score")


def preview(spark: SparkSession, d: str) -> DataFrame:
    text = F.translate(F.coalesce("text", F.lit("")), ".", "。")
    return documents(spark, d).select("doc_id", content.content_preview(text, 300).alias("preview"))


def title_normalise(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", content.article_title(F.col("url")).alias("title"), content.document_type(F.col("url")).alias("kind"))


def searchable_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", content.searchable_text(F.col("p_name"), F.col("p_brand"), F.col("p_type"), F.col("p_size").cast("string")).alias("text"), content.embedding_text(F.col("p_name"), F.col("p_type")).alias("embedding_text"))


def result_format(spark: SparkSession, d: str) -> DataFrame:
    own = documents(spark, d)
    articles = content.format_articles(own.where("lang = 'en'").select(F.col("doc_id").alias("article_number"), F.lit(None).cast("string").alias("title"), F.col("source").alias("content"), F.lit(None).cast("double").alias("score"), (F.col("n_chars") % 100 / 80).alias("similarity")))
    other = content.format_cases(own.where("lang <> 'en'").select(F.concat(F.lit("case_case_"), F.col("doc_id").cast("string")).alias("case_id"), F.array("lang").alias("accusations"), F.col("source").alias("fact"), F.lit(None).cast("string").alias("content"), F.lit(None).cast("double").alias("score"), (F.col("n_chars") % 100 / 80).alias("similarity")))
    return final(content.response(articles, other).withColumn("valid", content.is_valid_result()))


def batch_by_ids(spark: SparkSession, d: str) -> DataFrame:
    ids = table(spark, d, "benchmark").select(F.col("item_id").alias("ord"), (F.col("item_id") * 7).alias("doc_id"))
    return content.batch_by_ids(ids, documents(spark, d).select("doc_id", "lang")).select("ord", "doc_id", "lang")


def distinct_in_order(spark: SparkSession, d: str) -> DataFrame:
    return ranking.distinct_in_order(documents(spark, d).select("doc_id", "source", "lang"), "lang", "doc_id", "source").select("source", "lang", "doc_id")


def dq_counts(spark: SparkSession, d: str) -> DataFrame:
    return quality.counts({n: table(spark, d, n) for n in ("documents", "embeddings", "labels")})


def dq_id_reconcile(spark: SparkSession, d: str) -> DataFrame:
    return quality.reconcile(documents(spark, d), table(spark, d, "labels"), "doc_id")


def dq_missing_examples(spark: SparkSession, d: str) -> DataFrame:
    return quality.missing_examples(documents(spark, d), table(spark, d, "labels"), "doc_id")


def dq_vector_validity(spark: SparkSession, d: str) -> DataFrame:
    return final(quality.vector_validity(vectors(spark, d), 64, "doc_type"))


def dq_empty_content(spark: SparkSession, d: str) -> DataFrame:
    return quality.empty_contents(documents(spark, d), ["text", "source"], "lang")


def dq_status(spark: SparkSession, d: str) -> DataFrame:
    docs, labels, vecs = documents(spark, d), table(spark, d, "labels"), vectors(spark, d)
    ids = quality.reconcile(labels, docs, "doc_id").select(F.col("only_left").alias("id_mismatch"))
    empty = docs.agg(F.count_if(F.trim(F.coalesce("text", F.lit(""))) == "").alias("empty"))
    zero = vecs.agg(F.count_if(F.forall("vector", lambda x: x == 0)).alias("zero"), F.count_if(F.size("vector") != 64).alias("count_mismatch"))
    return quality.status(ids.crossJoin(empty).crossJoin(zero))  # single rows


def dq_preload(spark: SparkSession, d: str) -> DataFrame:
    return quality.preload_stats(vectors(spark, d).select("doc_id", "doc_type"), documents(spark, d))


CASES = """cases AS (SELECT l_orderkey AS case_id, list_sort(list(DISTINCT p_brand)) AS crimes, list_sort(list(DISTINCT l_suppkey)) AS articles, l_orderkey % 240 AS months
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey)"""
EDGES = f"""WITH {CASES}, edges AS (SELECT crime, article, count(*) AS case_count FROM (SELECT crime, unnest(articles) AS article FROM (SELECT unnest(crimes) AS crime, articles FROM cases)) GROUP BY ALL)"""
LEVEL = "CASE WHEN confidence >= 0.7 THEN 'high' WHEN confidence >= 0.3 THEN 'mid' WHEN confidence >= 0.1 THEN 'low' ELSE 'very_low' END"


GROUPS = """gcases AS (SELECT l_orderkey AS case_id, list_sort(list(DISTINCT p_brand)) AS crimes, list_sort(list(DISTINCT p_size % 12)) AS articles FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey),
gedges AS (SELECT crime, article::BIGINT AS article, count(*) AS case_count FROM (SELECT crime, unnest(articles) AS article FROM (SELECT unnest(crimes) AS crime, articles FROM gcases)) GROUP BY ALL)"""


def articles_sql(k: int = 10) -> str:
    return f"""{GROUPS}, ra AS (SELECT crime, article, case_count, total::BIGINT AS total, place, CASE WHEN total <= 3 THEN least(raw * 3, 0.95) WHEN total <= 10 THEN least(raw * 2, 0.85) WHEN total <= 20 THEN least(raw * 1.5, 0.75) ELSE raw END AS confidence, total <= 5 AS rare
  FROM (SELECT *, case_count / total AS raw FROM (SELECT *, sum(case_count) OVER (PARTITION BY crime) AS total, row_number() OVER (PARTITION BY crime ORDER BY case_count DESC, article) AS place FROM gedges) WHERE place <= {k})
  WHERE CASE WHEN total <= 5 THEN case_count >= 1 WHEN total <= 20 THEN raw >= 0.02 ELSE raw >= 0.05 AND case_count >= 2 END)"""


def crimes_sql(k: int = 10) -> str:
    return f"""rc AS (SELECT article, crime, case_count, total::BIGINT AS total, place, CASE WHEN case_count = 1 THEN least(raw * 2.5, 0.75) WHEN case_count <= 3 THEN least(raw * 2, 0.70) WHEN case_count <= 10 THEN least(raw * 1.5, 0.65) ELSE raw END AS confidence
  FROM (SELECT *, case_count / total AS raw FROM (SELECT *, sum(case_count) OVER (PARTITION BY article) AS total, row_number() OVER (PARTITION BY article ORDER BY case_count DESC, crime) AS place FROM edges) WHERE place <= {k})
  WHERE CASE WHEN case_count <= 3 THEN true WHEN case_count <= 10 THEN raw >= 0.01 ELSE raw >= 0.025 END)"""


PARTS = "parts AS (SELECT p_partkey AS qid, concat_ws(' ', p_name, p_brand, p_type, p_size) AS text FROM part)"
ENTITIES = f"""{PARTS}, ent AS (SELECT qid, crime, NULL::BIGINT AS article FROM parts JOIN (SELECT DISTINCT crime FROM edges) ON contains(text, crime)
  UNION ALL SELECT qid, NULL, n::BIGINT FROM (SELECT qid, unnest(list_distinct(list_filter(string_split(text, ' '), lambda w: regexp_matches(w, '^[0-9]{{1,9}}$')))) AS n FROM parts) WHERE n::BIGINT IN (SELECT article FROM edges))"""


def related_sql(k: int = 3) -> str:
    """(qid, kind, word, confidence) of what the entities of texts lead to."""
    return f"""{EDGES}, {articles_sql(k)}, {crimes_sql(k)}, {ENTITIES}, rel AS (SELECT qid, kind, word, max(confidence) AS confidence FROM (
  SELECT qid, 'article' AS kind, ra.article::VARCHAR AS word, confidence FROM ent JOIN ra USING (crime) UNION ALL SELECT qid, 'crime', rc.crime, confidence FROM ent JOIN rc USING (article)) GROUP BY ALL)"""


def shelf_sql(parts: str, k: int, sub: int) -> str:
    """The k best of weighted sub-queries `sq` (qid, source, weight, text), as the table `best`."""
    tokens = TOKENS
    return f"""{parts}, shelf AS (SELECT -1 - s_suppkey AS doc_id, s_name || ' nation ' || s_nationkey AS text FROM supplier UNION ALL SELECT qid, text FROM parts),
dl AS (SELECT doc_id, len({tokens}) AS dl FROM shelf), st AS (SELECT count(*) AS n_docs, avg(dl) AS avgdl FROM dl),
tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({tokens}) AS term FROM shelf) GROUP BY ALL),
raw AS (SELECT term, df, ln(n_docs - df + 0.5) - ln(df + 0.5) AS raw FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), st),
idf AS (SELECT term, CASE WHEN raw < 0 THEN (SELECT avg(raw) FROM raw) * 0.25 ELSE raw END AS idf FROM raw),
qt AS (SELECT text AS asked, unnest({tokens}) AS term FROM (SELECT DISTINCT text FROM sq)),
hit AS (SELECT asked, tf.doc_id, sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score FROM qt JOIN tf USING (term) JOIN idf USING (term) JOIN dl ON dl.doc_id = tf.doc_id CROSS JOIN st GROUP BY ALL),
run AS (SELECT *, row_number() OVER (PARTITION BY asked ORDER BY round(score, 9) DESC, doc_id) AS rank FROM hit WHERE score > 0),
merged AS (SELECT qid, doc_id, sum(score / (1 + score) * weight) AS total, max(score / (1 + score)) AS best, count(*) AS appearances, list_sort(list(DISTINCT source)) AS sources, bool_or(source = 'original') AS original
  FROM sq JOIN run ON asked = text WHERE rank <= CASE WHEN source = 'original' THEN {k} ELSE {sub} END GROUP BY ALL),
counted AS (SELECT *, count(*) OVER (PARTITION BY qid) AS n, max(total) OVER (PARTITION BY qid) AS top FROM merged),
factors AS (SELECT *, CASE WHEN n <= 3 THEN 2.5 WHEN n <= 10 THEN 1.8 WHEN n <= 50 THEN 1.3 ELSE 1.1 END AS f, CASE WHEN n <= 3 THEN 0.01 WHEN n <= 10 THEN 0.05 WHEN n <= 50 THEN 0.1 ELSE 0.2 END AS t FROM counted),
boosted AS (SELECT *, CASE WHEN n <= 10 OR (total >= t AND n <= 50) OR original THEN least(total * CASE WHEN total < 0.1 THEN f * 1.5 WHEN total < 0.3 THEN f ELSE least(f, 1.2) END, top * 1.5) ELSE total END AS boosted FROM factors),
best AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(boosted, 9) DESC, appearances DESC, round(best, 9) DESC, doc_id) AS rank FROM boosted QUALIFY rank <= 10)
SELECT qid, doc_id, round(boosted, 6) AS boosted, appearances, sources, rank FROM best"""


SUB_QUERIES = f"""{related_sql()}, sq AS (SELECT qid, 'original' AS source, 0.5::DOUBLE AS weight, text FROM parts WHERE qid % 100 = 0
  UNION ALL SELECT qid, kind || ':' || word, 0.3 * confidence, s_name FROM rel JOIN supplier ON kind = 'article' AND word = s_suppkey::VARCHAR WHERE qid % 100 = 0
  UNION ALL SELECT qid, kind || ':' || word, 0.2 * confidence, word FROM rel WHERE kind = 'crime' AND qid % 100 = 0)"""
ENTITY_QUERIES = f"""{EDGES}, {articles_sql(5)}, {PARTS}, sq AS (SELECT DISTINCT crime AS qid, 'original' AS source, 1.0::DOUBLE AS weight, crime AS text FROM edges
  UNION ALL SELECT crime, 'article:' || article, 0.5, s_name FROM ra JOIN supplier ON article = s_suppkey)"""
TURNS = "turns AS (SELECT conv_id * 100 + turn AS qid, lower(coalesce(text, '')) AS text FROM conversations WHERE role = 'user')"
STOPPED = ", ".join(f"'{w}'" for w in STOP)

SQL = {
    "graph_edges": f"{EDGES} SELECT * FROM edges",
    "graph_stats": f"""{EDGES} SELECT *, round(occurrences / crimes, 6) AS avg_per_crime, round(occurrences / articles, 6) AS avg_per_article FROM (SELECT count(DISTINCT crime) AS crimes, count(DISTINCT article) AS articles, count(*) AS relations, sum(case_count)::BIGINT AS occurrences FROM edges),
(SELECT round(avg(n), 6) AS avg_crime_degree, max(n) AS max_crime_degree FROM (SELECT count(*) AS n FROM edges GROUP BY crime)), (SELECT round(avg(n), 6) AS avg_article_degree, max(n) AS max_article_degree FROM (SELECT count(*) AS n FROM edges GROUP BY article))""",
    "graph_quality": f"""{EDGES} SELECT * FROM (SELECT coalesce(sum(case_count) FILTER (article <= 20), 0)::BIGINT AS general_occurrences, min(article) AS min_article, max(article) AS max_article FROM edges), (SELECT round(avg(n), 6) AS avg_articles, count(*) FILTER (n > 20) AS crowded_crimes FROM (SELECT count(*) AS n FROM edges GROUP BY crime))""",
    "graph_top_nodes": f"""{EDGES}, c AS (SELECT crime, count(*) AS degree, sum(case_count)::BIGINT AS cases FROM edges GROUP BY crime), a AS (SELECT article, count(*) AS degree, sum(case_count)::BIGINT AS cases FROM edges GROUP BY article)
(SELECT 'crime' AS side, 'degree' AS by, crime AS node, degree, cases FROM c ORDER BY degree DESC, crime LIMIT 5) UNION ALL (SELECT 'article', 'degree', article::VARCHAR, degree, cases FROM a ORDER BY degree DESC, article LIMIT 5)
UNION ALL (SELECT 'crime', 'cases', crime, degree, cases FROM c ORDER BY cases DESC, crime LIMIT 5) UNION ALL (SELECT 'article', 'cases', article::VARCHAR, degree, cases FROM a ORDER BY cases DESC, article LIMIT 5)""",
    "related_articles": f"{EDGES}, {articles_sql()} SELECT * REPLACE (round(confidence, 6) AS confidence), {LEVEL} AS level FROM ra",
    "related_crimes": f"{EDGES}, {crimes_sql()} SELECT * REPLACE (round(confidence, 6) AS confidence), {LEVEL} AS level FROM rc",
    "relation_details": f"""{EDGES}, c AS (SELECT *, CASE WHEN case_count <= 3 THEN least(raw * 3, 0.95) WHEN case_count <= 10 THEN least(raw * 2, 0.85) WHEN case_count <= 20 THEN least(raw * 1.5, 0.75) ELSE raw END AS confidence FROM (SELECT *, case_count / sum(case_count) OVER (PARTITION BY crime) AS raw FROM edges))
SELECT crime, article, case_count, round(confidence, 6) AS confidence, {LEVEL} AS level FROM c""",
    "star_edges": f"{EDGES}, {articles_sql()} SELECT crime AS source, article::VARCHAR AS target, case_count AS weight, round(confidence, 6) AS confidence FROM ra WHERE place <= 10",
    "star_nodes": f"{EDGES}, {articles_sql()} SELECT crime AS centre, article::VARCHAR AS node, 'article' AS kind FROM ra UNION ALL SELECT DISTINCT crime, crime, 'crime' FROM ra",
    "crimes_list": f"{EDGES} SELECT crime, sum(case_count)::BIGINT AS cases, list_sort(list(article)) AS articles FROM edges GROUP BY crime",
    "articles_list": f"{EDGES} SELECT article, sum(case_count)::BIGINT AS cases, list_sort(list(crime)) AS crimes, article AS place FROM edges GROUP BY article",
    "relation_cases": f"WITH {CASES} SELECT case_id FROM cases WHERE len(list_filter(crimes, lambda a: contains(a, 'Brand#1') OR contains('Brand#1', a))) > 0 AND list_contains(articles, 7) ORDER BY case_id LIMIT 20",
    "graph_export": f"{EDGES} SELECT crime || '罪' AS Crime, '第' || article || '条' AS Article, case_count AS CaseCount, 'crime_article' AS Type FROM edges",
    "article_summary": f"""WITH {CASES}, e AS (SELECT case_id, months, unnest(articles) AS article FROM cases) SELECT article, count(*) AS cases, min(months) AS min_months, max(months) AS max_months, round(avg(months), 6) AS avg_months, list_sort(list(case_id))[1:3] AS typical FROM e GROUP BY article""",
    "crime_summary": f"""WITH {CASES}, e AS (SELECT case_id, months, articles AS a, unnest(crimes) AS crime FROM cases), c AS (SELECT crime, count(DISTINCT x) AS articles FROM (SELECT crime, unnest(a) AS x FROM e) GROUP BY crime)
SELECT crime, count(*) AS cases, round(avg(months), 6) AS avg_months, count(*) FILTER (months <= 12) AS to_1y, count(*) FILTER (months > 12 AND months <= 36) AS to_3y, count(*) FILTER (months > 36 AND months <= 120) AS to_10y, count(*) FILTER (months > 120) AS over_10y, any_value(c.articles) AS articles FROM e JOIN c USING (crime) GROUP BY crime""",
    "query_expand": f"""{EDGES}, {articles_sql(3)}, {crimes_sql(3)}, {ENTITIES}, n AS (SELECT qid, count(*) AS entities FROM ent GROUP BY qid),
w AS (SELECT qid, ra.article::VARCHAR AS word, confidence FROM ent JOIN ra USING (crime) WHERE place <= 2 UNION ALL SELECT qid, rc.crime, confidence FROM ent JOIN rc USING (article) WHERE place <= 2)
SELECT qid, list_sort(list(DISTINCT word)) AS keywords, count(*) AS relations, round(avg(confidence), 6) AS mean_confidence, entities, round(least(0.3 * entities + 0.2 * count(*) + 0.5 * avg(confidence), 1), 6)::DOUBLE AS quality FROM w JOIN n USING (qid) GROUP BY qid, entities""",
    "graph_enhanced_search": shelf_sql(SUB_QUERIES, 10, 5),
    "entity_search": shelf_sql(ENTITY_QUERIES, 5, 5),
    "graph_path": f"""{related_sql()}, p AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(confidence, 9) DESC, word) AS place FROM rel WHERE kind = 'article' QUALIFY place <= 5)
SELECT qid, 'article_' || word AS id, word AS article, coalesce(s_name || ' nation ' || s_nationkey, '') AS content, round(confidence, 6) AS score, place FROM p LEFT JOIN supplier ON word = s_suppkey::VARCHAR""",
    "explain_search": f"{EDGES}, {articles_sql(3)}, {ENTITIES} SELECT qid, list(crime || ' -> ' || ra.article || ' (' || {LEVEL} || ')' ORDER BY -confidence, crime || ' -> ' || ra.article || ' (' || {LEVEL} || ')') AS steps FROM ent JOIN ra USING (crime) GROUP BY qid",
    "detect_entities": f"WITH {TURNS}, words AS (SELECT DISTINCT list_filter(string_split_regex(lower(text), '[^a-z]+'), lambda w: length(w) >= 6)[1] AS word FROM benchmark) SELECT qid, word FROM turns JOIN words ON contains(text, word)",
    "keyword_extract": f"""WITH {TURNS}, l AS (SELECT qid, list_filter(string_split_regex(text, '[^a-z]+'), lambda w: length(w) >= 2) AS l FROM turns), w AS (SELECT qid, unnest(l) AS keyword, generate_subscripts(l, 1) AS ord FROM l),
f AS (SELECT qid, keyword, min(ord) AS ord, CASE WHEN length(keyword) >= 8 THEN 0.55 ELSE 0.45 END::DOUBLE AS weight FROM w WHERE keyword NOT IN ({STOPPED}) GROUP BY ALL)
SELECT qid, keyword, weight, row_number() OVER (PARTITION BY qid ORDER BY weight DESC, ord) AS place FROM f QUALIFY place <= 8""",
    "routing_plan": f"""WITH {TURNS}, p AS (SELECT qid, list_filter([CASE WHEN length(text) % 2 > 0 THEN 'knowledge_graph' END, CASE WHEN length(text) % 3 > 0 THEN 'query2doc' END, CASE WHEN length(text) % 5 > 0 THEN 'hyde' END, CASE WHEN length(text) % 7 > 0 THEN 'bm25_hybrid' END, 'basic_semantic'], lambda x: x IS NOT NULL) AS paths FROM turns),
e AS (SELECT qid, len(paths) AS n, unnest(paths) AS path, generate_subscripts(paths, 1) AS i FROM p)
SELECT qid, path, round(1.0::DOUBLE / i, 6) AS priority, round(CASE WHEN i = 1 THEN 0.8 ELSE 0.6 - 0.1 * (i - 1) END, 6)::DOUBLE AS expected, greatest(1, n // 2)::BIGINT AS minimum_engines, CASE WHEN n >= 3 THEN 0.9 ELSE 0.7 END::DOUBLE AS confidence FROM e""",
    "normalise_names": "SELECT s_suppkey, s_name AS name, regexp_extract(s_name, '([0-9]+)', 1) AS number, 'case_' || regexp_replace(regexp_extract(s_name, '([0-9]+)', 1), '^0+([0-9])', chr(92) || '1') AS id FROM supplier".replace("chr(92) || '1'", "'\\1'"),
    "severe_flag": "SELECT o_orderkey, coalesce(o_orderstatus = 'F', false) OR coalesce(o_orderpriority = '1-URGENT', false) OR o_orderkey % 240 >= 120 AS severe FROM orders",
    "corpus_lexicon": f"""WITH t AS (SELECT doc_id, unnest(string_split_regex(lower(coalesce(text, '')), '[^a-z]+')) AS word FROM documents WHERE lang = 'en'),
p AS (SELECT word, count(*) AS tf, count(DISTINCT doc_id) AS df FROM t WHERE length(word) BETWEEN 2 AND 8 AND word NOT IN ({STOPPED}) GROUP BY word),
s AS (SELECT word, tf * ln((1 + n) / (1 + df)) AS raw FROM p, (SELECT count(*) AS n FROM documents WHERE lang = 'en') ORDER BY round(tf * ln((1 + n) / (1 + df)), 6) DESC, word LIMIT 150),
w AS (SELECT word, raw / max(raw) OVER () AS weight FROM s)
SELECT word, round(weight, 6) AS weight, CASE WHEN weight > 0.03 THEN 'core' WHEN weight > 0.02 THEN 'common' ELSE 'rest' END AS category FROM w WHERE weight > 0.015""",
    "content_join": "SELECT 'case_case_' || lpad(l.doc_id::VARCHAR, 6, '0') AS doc_id, quality::BIGINT AS quality, length(trim(text, ' '))::BIGINT AS size FROM labels l LEFT JOIN documents d ON d.doc_id = l.doc_id",
    "length_filter": """WITH r AS (SELECT source AS qid, doc_id, n_chars % 1000 / 1000 AS score FROM documents WHERE length(trim(coalesce(text, ''), ' ')) >= 200), p AS (SELECT *, count(*) OVER (PARTITION BY qid) AS n, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc_id) AS place FROM r)
SELECT qid, doc_id, round(score, 6) AS score FROM p WHERE n < 15 OR place <= 20""",
    "preview": """WITH t AS (SELECT doc_id, replace(coalesce(text, ''), '.', '。') AS text FROM documents), h AS (SELECT *, substring(text, 1, 300) AS head, 301 - instr(reverse(substring(text, 1, 300)), '。') AS stop, instr(substring(text, 1, 300), '。') AS found FROM t)
SELECT doc_id, CASE WHEN length(text) <= 300 THEN text WHEN found > 0 AND stop - 1 > 210 THEN substring(head, 1, stop) ELSE head || '...' END AS preview FROM h""",
    "title_normalise": "SELECT page_id, CASE WHEN regexp_matches(url, '[0-9]') THEN '第' || regexp_extract(url, '([0-9]+)', 1) || '条' ELSE url END AS title, CASE WHEN contains(lower(coalesce(url, '')), 'article') OR starts_with(lower(coalesce(url, '')), 'law') THEN 'article' WHEN contains(lower(coalesce(url, '')), 'case') THEN 'case' ELSE 'unknown' END AS kind FROM pages",
    "searchable_text": "SELECT p_partkey, concat_ws(' ', p_name, p_brand, p_type, p_size) AS text, p_name || chr(10) || p_type AS embedding_text FROM part",
    "result_format": """WITH r AS (SELECT *, n_chars % 100 / 80 AS s FROM documents)
SELECT 'article_' || doc_id AS id, 'article' AS type, '第' || doc_id || '条' AS title, source AS content, doc_id AS article_number, round(s, 6) AS similarity, NULL::VARCHAR AS case_id, s BETWEEN 0 AND 1 AS valid FROM r WHERE lang = 'en'
UNION ALL SELECT 'case_' || doc_id, 'case', 'case_' || doc_id || ' - ' || lang, source, NULL, round(s, 6), 'case_case_' || doc_id, s BETWEEN 0 AND 1 FROM r WHERE lang <> 'en'""",
    "batch_by_ids": "SELECT item_id AS ord, doc_id, lang FROM benchmark JOIN documents ON doc_id = item_id * 7",
    "distinct_in_order": "SELECT source, lang, min(doc_id) AS doc_id FROM documents GROUP BY ALL",
    "dq_counts": "SELECT 'documents' AS source, count(*) AS n FROM documents UNION ALL SELECT 'embeddings', count(*) FROM embeddings UNION ALL SELECT 'labels', count(*) FROM labels",
    "dq_id_reconcile": "SELECT count(*) FILTER (l IS NOT NULL AND r IS NOT NULL) AS common, count(*) FILTER (r IS NULL) AS only_left, count(*) FILTER (l IS NULL) AS only_right FROM (SELECT DISTINCT doc_id AS l FROM documents) FULL JOIN (SELECT DISTINCT doc_id AS r FROM labels) ON l = r",
    "dq_missing_examples": "SELECT DISTINCT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) ORDER BY doc_id LIMIT 10",
    "dq_vector_validity": """WITH c AS (SELECT doc_type, x FROM (SELECT CASE WHEN label < 5 THEN 'A' ELSE 'B' END AS doc_type, unnest(embedding::DOUBLE[]) AS x FROM embeddings))
SELECT doc_type, vectors, wrong_length, nan_count, inf_count, zero_vectors, mean_value, std_value, min_value, max_value FROM (SELECT CASE WHEN label < 5 THEN 'A' ELSE 'B' END AS doc_type, count(*) AS vectors, count(*) FILTER (len(embedding) <> 64) AS wrong_length, count(*) FILTER (len(list_filter(embedding, lambda x: x <> 0)) = 0) AS zero_vectors FROM embeddings GROUP BY 1)
JOIN (SELECT doc_type, count(*) FILTER (isnan(x)) AS nan_count, count(*) FILTER (isinf(x)) AS inf_count, round(avg(x), 6) AS mean_value, round(stddev_pop(x), 6) AS std_value, round(min(x), 6) AS min_value, round(max(x), 6) AS max_value FROM c GROUP BY 1) USING (doc_type)""",
    "dq_empty_content": "SELECT lang, count(*) AS n, count(*) FILTER (trim(coalesce(text, ''), ' ') = '') AS empty_text, count(*) FILTER (trim(coalesce(source, ''), ' ') = '') AS empty_source FROM documents GROUP BY lang",
    "dq_status": """SELECT *, CASE WHEN count_mismatch > 0 OR id_mismatch > 0 THEN 'critical' WHEN empty > 0 OR zero > 0 THEN 'warning' ELSE 'healthy' END AS status FROM
(SELECT count(*) AS id_mismatch FROM (SELECT DISTINCT doc_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents))), (SELECT count(*) FILTER (trim(coalesce(text, ''), ' ') = '') AS empty FROM documents),
(SELECT count(*) FILTER (len(list_filter(embedding, lambda x: x <> 0)) = 0) AS zero, count(*) FILTER (len(embedding) <> 64) AS count_mismatch FROM embeddings)""",
    "dq_preload": "SELECT CASE WHEN label < 5 THEN 'A' ELSE 'B' END AS doc_type, count(d.doc_id) AS hits, count(*) FILTER (d.doc_id IS NULL) AS misses FROM embeddings LEFT JOIN (SELECT DISTINCT doc_id FROM documents WHERE trim(coalesce(text, ''), ' ') <> '') d ON d.doc_id = vec_id GROUP BY 1",
}

QUERIES = {
    f.__name__: f
    for f in (
        graph_edges, graph_stats, graph_quality, graph_top_nodes, related_articles, related_crimes, relation_details, star_edges, star_nodes, crimes_list,
        articles_list, relation_cases, graph_export, article_summary, crime_summary, query_expand, explain_search, graph_enhanced_search, entity_search, graph_path, detect_entities, keyword_extract,
        routing_plan, normalise_names, severe_flag, corpus_lexicon, content_join, length_filter, preview, title_normalise, searchable_text, result_format,
        batch_by_ids, distinct_in_order, dq_counts, dq_id_reconcile, dq_missing_examples, dq_vector_validity, dq_empty_content, dq_status, dq_preload,
    )
}

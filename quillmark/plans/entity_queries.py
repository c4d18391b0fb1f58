"""Crimes, articles and keywords in texts, and the cases of many relations, on the driver's tables, each with its SQL.

The tables' texts are Latin, so that texts which name crimes are put together from the columns of parts: a part's size chooses the
crime of the lexicon that it is about, its key the way a question names it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import entity, graph, lexicon
from .common import documents, final, table
from .graph_queries import CASES, STOP, STOPPED, cases

CRIMES = sorted({crime.removesuffix("罪") for _, crime, _, _ in entity.LEXICON})
#: Ways to ask about a crime, by the part's key; the places are for the crime, its first two characters, and the part's size.
WAYS = ["%1$s", "%1$s罪", "请问%1$s案件怎么判刑，依据第%3$s条", "关于%2$s的问题", "他因%1$s罪被诉，情节严重", "a text without any, %3$s", "第 %3$s 条"]


def questions(spark: SparkSession, d: str) -> DataFrame:
    """(qid, text): a question for each part."""
    crime = F.element_at(F.array(*map(F.lit, CRIMES)), 1 + F.col("p_size") % len(CRIMES))
    text = F.lit(None).cast("string")
    for i, way in enumerate(WAYS):
        text = F.when(F.col("p_partkey") % len(WAYS) == i, F.format_string(way, crime, F.substring(crime, 1, 2), F.col("p_size").cast("string"))).otherwise(text)
    return table(spark, d, "part").select(F.col("p_partkey").cast("long").alias("qid"), text.alias("text"))


def relations(spark: SparkSession, d: str) -> DataFrame:
    """(crime, article): the crime of a part's size and that size as its article."""
    crime = F.element_at(F.array(*map(F.lit, CRIMES)), 1 + F.col("p_size") % len(CRIMES))
    return table(spark, d, "part").select(crime.alias("crime"), F.col("p_size").cast("int").alias("article")).distinct()


def detect_crimes(spark: SparkSession, d: str) -> DataFrame:
    return entity.detect_crimes(questions(spark, d), relations(spark, d))


def detect_articles(spark: SparkSession, d: str) -> DataFrame:
    return entity.detect_articles(questions(spark, d), relations(spark, d))


def lexicon_crimes(spark: SparkSession, d: str) -> DataFrame:
    return final(entity.lexicon_crimes(questions(spark, d)))


def weighted_keywords(spark: SparkSession, d: str) -> DataFrame:
    return final(entity.weighted_keywords(questions(spark, d)))


def relation_cases_all(spark: SparkSession, d: str) -> DataFrame:
    """The first cases of each group of brands with each supplier that any of its parts come from."""
    own = cases(spark, d).withColumnsRenamed({"crimes": "accusations", "articles": "relevant_articles"})
    lines = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    pairs = lines.select(F.substring("p_brand", 1, 7).alias("crime"), F.col("l_suppkey").alias("article")).distinct()
    near = entity.near_names(pairs, own.select(F.explode("accusations").alias("accusation")))
    return final(graph.cases_of_relations(own, pairs, near, 20))


#: Answers of a classifier, whole and broken, by a conversation's number; @ is its text.
PAYLOADS = [
    '{"is_criminal_law": true, "confidence": 0.9, "identified_crimes": [{"crime_name": "theft", "relevance": 0.8}, {"relevance": 0.4}, {"crime_name": "fraud", "relevance": "high"}], "query2doc_generated": "@", "hyde_answer": "@", "bm25_keywords": [{"keyword": "house", "weight": 0.7}, "night"]}',
    '{"is_criminal_law": "perhaps", "confidence": "0.7", "identified_crimes": {"crime_name": "theft"}, "query2doc_generated": "@", "bm25_keywords": []}',
    '{"is_criminal_law": false, "confidence": null, "identified_crimes": null, "hyde_answer": "@", "bm25_keywords": [{"weight": 0.2}, {"keyword": "", "weight": 1}]}',
    '{"is_criminal_law": true, "confidence": [0.5], "query2doc_generated": "@"',
    '["@"]',
    '{"answer": {"confidence": 1}, "bm25_keywords": "@"}',
]


def classified(spark: SparkSession, d: str) -> DataFrame:
    """Answers put together from the users' texts, read field by field."""
    safe = F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z0-9 ]", "")
    payload = F.element_at(F.array(*map(F.lit, PAYLOADS)), (1 + F.col("conv_id") % len(PAYLOADS)).cast("int"))
    own = table(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", entity.read_classification(F.replace(payload, F.lit("@"), safe)).alias("a"))
    names = lambda field, part: F.array_join(F.transform(f"a.{field}", lambda x: x[part]), ",")
    return final(own.select("conv_id", "turn", "a.is_criminal_law", "a.confidence", "a.query2doc_generated", "a.hyde_answer", names("identified_crimes", "crime_name").alias("crimes"), F.size(F.filter("a.identified_crimes", lambda c: c["relevance"].isNull())).alias("unsure"), names("bm25_keywords", "keyword").alias("keywords"), F.array_join("a.errors", ",").alias("errors")))


#: Endings that stand for the pattern of words in Latin texts, and steps of the ranking.
ENDINGS, STEPS = "(ing|ed|er|ly)$", 10


def ranked_lexicon(spark: SparkSession, d: str) -> DataFrame:
    """The words of all documents by tf-idf and rank together."""
    words = F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), "[^a-z]+"), lambda w: (F.length(w) >= 2) & ~w.isin(STOP))
    docs = documents(spark, d).select("doc_id", words.alias("words"))
    ranked = lexicon.word_ranks(docs, STEPS)
    return final(lexicon.combined(lexicon.tf_idf(docs), lexicon.by_rank(ranked), ENDINGS, STOP))


def listed(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def way_sql(way: str) -> str:
    return "'" + way.replace("%1$s", "' || c || '").replace("%2$s", "' || substring(c, 1, 2) || '").replace("%3$s", "' || p_size || '") + "'"


ASKED = f"""parts AS (SELECT p_partkey, p_size, {listed(CRIMES)}[1 + p_size % {len(CRIMES)}] AS c FROM part),
asked AS (SELECT p_partkey AS qid, CASE p_partkey % {len(WAYS)} {" ".join(f"WHEN {i} THEN {way_sql(w)}" for i, w in enumerate(WAYS))} END AS text FROM parts)"""
PLAIN = "CASE WHEN length(replace(trim({0}, ' '), '罪', '')) >= 2 THEN replace(trim({0}, ' '), '罪', '') END"
WORD = r"[\p{L}\p{N}_]"
LEXICON = "lexicon AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{w}', '{c}', {x}::DOUBLE, {n}::BIGINT)" for i, (w, c, x, n) in enumerate(entity.LEXICON)) + ") t(ord, word, crime_name, confidence, article_number))"
FOUND = f"{ASKED}, {LEXICON}, found AS (SELECT qid, ord, crime_name, confidence, article_number FROM asked JOIN lexicon ON contains(lower(text), word))"

def steps_sql() -> str:
    """The power iteration, one common table a step."""
    steps = ["r0 AS MATERIALIZED (SELECT DISTINCT a AS word, 1.0::DOUBLE AS rank FROM links)"]
    steps += [f"r{i} AS MATERIALIZED (SELECT b AS word, 0.15 + 0.85 * sum(share * rank) AS rank FROM links JOIN r{i - 1} ON word = a GROUP BY b)" for i in range(1, STEPS + 1)]
    return ", ".join(steps)


FIELDS = {"is_criminal_law": "BOOLEAN", "confidence": "DOUBLE", "query2doc_generated": "VARCHAR", "hyde_answer": "VARCHAR"}
WRONG = [f"CASE WHEN coalesce(json_type(j, '$.{f}'), 'NULL') <> 'NULL' AND (json_type(j, '$.{f}') IN ('ARRAY', 'OBJECT') OR TRY_CAST(json_extract_string(j, '$.{f}') AS {t}) IS NULL) THEN '{f}' END" for f, t in FIELDS.items()]
WRONG += [f"CASE WHEN coalesce(json_type(j, '$.{f}'), 'NULL') NOT IN ('NULL', 'ARRAY') THEN '{f}' END" for f in ("identified_crimes", "bm25_keywords")]

SQL = {
    "classified": f"""WITH p AS (SELECT conv_id, turn, replace({listed(PAYLOADS)}[1 + conv_id % {len(PAYLOADS)}], '@', regexp_replace(coalesce(text, ''), '[^A-Za-z0-9 ]', '', 'g')) AS payload FROM conversations WHERE role = 'user'),
o AS (SELECT conv_id, turn, CASE WHEN json_valid(payload) AND json_type(payload) = 'OBJECT' THEN payload::JSON END AS j FROM p)
SELECT conv_id, turn, coalesce(TRY_CAST(json_extract_string(j, '$.is_criminal_law') AS BOOLEAN), false) AS is_criminal_law,
  coalesce(CASE WHEN json_type(j, '$.confidence') <> 'ARRAY' THEN TRY_CAST(json_extract_string(j, '$.confidence') AS DOUBLE) END, 0.5)::DOUBLE AS confidence,
  coalesce(json_extract_string(j, '$.query2doc_generated'), '') AS query2doc_generated, coalesce(json_extract_string(j, '$.hyde_answer'), '') AS hyde_answer,
  coalesce(array_to_string(list_filter(json_extract_string(j, '$.identified_crimes[*].crime_name'), lambda x: coalesce(x, '') <> ''), ','), '') AS crimes,
  CASE WHEN conv_id % {len(PAYLOADS)} = 0 THEN 1 ELSE 0 END::BIGINT AS unsure,
  coalesce(array_to_string(list_filter(list_transform(CASE WHEN json_type(j, '$.bm25_keywords') = 'ARRAY' THEN json_extract(j, '$.bm25_keywords[*]') END, lambda k: CASE WHEN json_type(k) = 'VARCHAR' THEN json_extract_string(k, '$') ELSE json_extract_string(k, '$.keyword') END), lambda x: coalesce(x, '') <> ''), ','), '') AS keywords,
  CASE WHEN j IS NULL THEN 'payload' ELSE concat_ws(',', {", ".join(WRONG)}) END AS errors
FROM o""",
    "ranked_lexicon": f"""WITH docs AS (SELECT row_number() OVER () AS r, list_filter(string_split_regex(lower(coalesce(text, '')), '[^a-z]+'), lambda w: length(w) >= 2 AND w NOT IN ({STOPPED})) AS l FROM documents),
t AS MATERIALIZED (SELECT r, unnest(l) AS word, generate_subscripts(l, 1) AS p FROM docs),
per AS (SELECT word, count(*) AS tf, count(DISTINCT r) AS df FROM t GROUP BY word),
raws AS (SELECT word, tf * ln((1 + n) / (1 + df)) AS raw FROM per, (SELECT count(*) AS n FROM documents) ORDER BY round(tf * ln((1 + n) / (1 + df)), 6) DESC, word LIMIT 150),
pairs AS (SELECT x.word AS a, y.word AS b FROM t x JOIN t y ON x.r = y.r AND y.p IN (x.p + 1, x.p + 2, x.p + 3, x.p + 4) WHERE x.word <> y.word),
edges AS (SELECT a, b, count(*) AS w FROM (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs) GROUP BY ALL),
links AS MATERIALIZED (SELECT a, b, w / sum(w) OVER (PARTITION BY a) AS share FROM edges), {steps_sql()},
ends AS (SELECT min(rank) / 10 AS low, max(rank) AS high FROM r{STEPS}), tops AS (SELECT word, (rank - low) / (high - low) AS weight FROM r{STEPS}, ends ORDER BY round(rank, 9) DESC, word LIMIT 100),
both_ways AS (SELECT word, raw / max(raw) OVER () * 0.7 AS weight FROM raws UNION ALL SELECT word, weight * 0.3 FROM tops),
own AS (SELECT word, sum(weight) * CASE WHEN regexp_matches(word, '{ENDINGS}') THEN 1.3 ELSE 1.0 END AS weight, regexp_matches(word, '{ENDINGS}') AS follows FROM both_ways GROUP BY word)
SELECT word, round(weight, 6) AS weight, CASE WHEN weight > 0.03 THEN 'high_weight' WHEN weight > 0.02 THEN 'legal_pattern' ELSE 'medium_weight' END AS category
FROM own WHERE length(word) BETWEEN 2 AND 8 AND (follows OR weight > 0.015)""",
    "detect_crimes": f"""WITH {ASKED}, names AS (SELECT DISTINCT c AS crime FROM parts), simple AS (SELECT crime FROM names WHERE NOT regexp_matches(crime, '[\\[\\]、，]')),
words AS (SELECT crime AS word, crime FROM names UNION ALL SELECT crime || '罪', crime FROM names UNION ALL SELECT substring(crime, 1, 2), max(crime) FROM names WHERE length(crime) > 2 GROUP BY 1),
tiers AS (
  SELECT qid, crime, 1 AS tier FROM asked JOIN names ON crime = {PLAIN.format("text")}
  UNION ALL SELECT qid, crime, 2 FROM asked JOIN names ON ends_with(text, '罪') AND crime = substring(text, 1, length(text) - 1)
  UNION ALL SELECT qid, crime, 3 FROM asked JOIN words ON contains(text, word) WHERE crime IN (SELECT crime FROM simple)
  UNION ALL SELECT qid, crime, 3 FROM (SELECT qid, unnest(list_concat(regexp_extract_all(text, '({WORD}+)罪', 1), regexp_extract_all(text, '({WORD}{{2,4}})犯罪', 1))) AS name FROM asked) JOIN simple ON crime = {PLAIN.format("name")}
  UNION ALL SELECT qid, crime, 5 FROM (SELECT qid, crime, row_number() OVER (PARTITION BY qid ORDER BY length(text) / length(crime) DESC, crime) AS n FROM asked JOIN names ON contains(crime, text) AND text <> '') WHERE n = 1
)
SELECT DISTINCT qid, crime FROM tiers QUALIFY tier = min(tier) OVER (PARTITION BY qid)""",
    "detect_articles": f"""WITH {ASKED}, known AS (SELECT DISTINCT p_size::VARCHAR AS article FROM parts)
SELECT qid, article FROM asked JOIN known ON contains(text, article)
UNION SELECT qid, article FROM (SELECT qid, unnest(list_concat(regexp_extract_all(text, '第?\\s*([0-9]+)\\s*条', 1), regexp_extract_all(text, '第([0-9]+)', 1))) AS article FROM asked) WHERE article IN (SELECT article FROM known)""",
    "lexicon_crimes": f"WITH {FOUND} SELECT qid, ord::BIGINT AS ord, crime_name, confidence, article_number FROM found",
    "weighted_keywords": f"""WITH {FOUND}, terms AS (SELECT * FROM (VALUES {", ".join(f"({i}, '{w}', {x}::DOUBLE)" for i, (w, x) in enumerate(entity.TERMS.items()))}) t(ord, word, weight)),
runs AS (SELECT qid, unnest(l) AS keyword, generate_subscripts(l, 1) - 1 AS ord FROM (SELECT qid, regexp_extract_all(text, '([\\x{{4e00}}-\\x{{9fff}}]{{2,}})', 1) AS l FROM asked)),
every AS (
  SELECT qid, 1 AS part, ord * 2 AS ord, '第' || article_number || '条' AS keyword, 0.95::DOUBLE AS weight FROM found UNION ALL SELECT qid, 1, ord * 2 + 1, article_number::VARCHAR, 0.9 FROM found
  UNION ALL SELECT qid, 2, ord * 2, crime_name, 0.85 FROM found UNION ALL SELECT qid, 2, ord * 2 + 1, replace(crime_name, '罪', ''), 0.8 FROM found
  UNION ALL SELECT qid, 3, ord, word, weight FROM asked JOIN terms ON contains(text, word)
  UNION ALL SELECT qid, 4, ord, keyword, CASE WHEN length(keyword) >= 4 THEN 0.55 ELSE 0.45 END FROM runs WHERE NOT EXISTS (SELECT 1 FROM terms WHERE contains(keyword, word))
),
kept AS (SELECT * FROM every WHERE NOT list_contains({listed(entity.COMMON)}, keyword) QUALIFY row_number() OVER (PARTITION BY qid, keyword ORDER BY weight DESC, part, ord) = 1)
SELECT qid, keyword, weight, row_number() OVER (PARTITION BY qid ORDER BY weight DESC, part, ord, keyword) AS place FROM kept QUALIFY place <= 8""",
    "relation_cases_all": f"""WITH {CASES}, pairs AS (SELECT DISTINCT substring(p_brand, 1, 7) AS crime, l_suppkey AS article FROM lineitem JOIN part ON l_partkey = p_partkey),
hits AS (SELECT crime, article, case_id FROM pairs JOIN cases ON list_contains(articles, article) WHERE len(list_filter(crimes, lambda a: contains(a, crime) OR contains(crime, a))) > 0)
SELECT crime, article, case_id, row_number() OVER (PARTITION BY crime, article ORDER BY case_id) AS place FROM hits QUALIFY place <= 20""",
}

QUERIES = {f.__name__: f for f in (detect_crimes, detect_articles, lexicon_crimes, weighted_keywords, relation_cases_all, ranked_lexicon, classified)}

"""The driver's tables in the operators' layouts, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import keyword, vector
from ..operators.ranking import SHOWN
from ..sources.tables import table

TYPE = "CASE WHEN label < 5 THEN 'A' ELSE 'B' END"


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, doc_type, label, vector)."""
    return table(spark, folder, "embeddings").select(F.col("vec_id").alias("doc_id"), F.when(F.col("label") < 5, "A").otherwise("B").alias("doc_type"), "label", F.col("embedding").alias("vector"))


def vector_queries(spark: SparkSession, folder: str) -> DataFrame:
    """(qid, vector): the stated query set, every vector whose id is divisible by a hundred."""
    return vectors(spark, folder).where(F.col("doc_id") % 100 == 0).select(F.col("doc_id").alias("qid"), "vector", F.col("label").alias("qlabel"))


def item_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """(qid, vector): benchmark items stand for queries; by convention an item's vector has its id."""
    items = table(spark, folder, "benchmark").select(F.col("item_id").alias("doc_id"))
    return vectors(spark, folder).join(items, "doc_id").select(F.col("doc_id").alias("qid"), "vector")


def items(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "benchmark").select(F.col("item_id").alias("qid"), "text")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents")


def semantic_run(spark: SparkSession, folder: str, k: int) -> DataFrame:
    return vector.search(vectors(spark, folder), item_vectors(spark, folder), k)


def keyword_run(spark: SparkSession, folder: str, k: int) -> DataFrame:
    return keyword.search(documents(spark, folder), items(spark, folder), k)


def final(df: DataFrame, *columns: str) -> DataFrame:
    """Columns of a result: doubles to six places, whole numbers as long."""
    kinds = dict(df.dtypes)
    out = []
    for c in columns or df.columns:
        out.append(F.round(c, SHOWN).alias(c) if kinds[c] == "double" else F.col(c).cast("long").alias(c) if kinds[c] in ("int", "smallint") else F.col(c))
    return df.select(*out)


TOKENS = "list_filter(string_split_regex(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda x: x <> '')"
COSINE = "CASE WHEN q.n * d.n = 0 THEN 0 ELSE list_inner_product(q.e, d.e) / (q.n * d.n) END"
V_SQL = f"v AS (SELECT vec_id AS doc_id, {TYPE} AS doc_type, label, embedding::DOUBLE[] AS e, sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings)"
SIMS_SQL = f"{V_SQL}, sims AS (SELECT q.doc_id AS qid, q.label AS qlabel, d.doc_id, d.doc_type, d.label, {COSINE} AS score FROM v q JOIN v d ON q.doc_id % 100 = 0)"
BM_SQL = f"""dl AS (SELECT doc_id, len({TOKENS}) AS dl FROM documents),
st AS (SELECT count(*) AS n_docs, avg(dl) AS avgdl FROM dl),
tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({TOKENS}) AS term FROM documents) GROUP BY ALL),
raw AS (SELECT term, df, ln(n_docs - df + 0.5) - ln(df + 0.5) AS raw FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), st),
idf AS (SELECT term, df, CASE WHEN raw < 0 THEN (SELECT avg(raw) FROM raw) * 0.25 ELSE raw END AS idf FROM raw)"""


def bm_run(queries: str = f"SELECT item_id AS qid, unnest({TOKENS}) AS term FROM benchmark") -> str:
    return f"""{BM_SQL}, qt AS ({queries}),
bmall AS (SELECT qid, tf.doc_id, sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score
  FROM qt JOIN tf USING (term) JOIN idf USING (term) JOIN dl ON dl.doc_id = tf.doc_id CROSS JOIN st GROUP BY ALL HAVING sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) > 0)"""


def bm_top(k: int) -> str:
    return f"{bm_run()}, bm AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc_id) AS rank FROM bmall QUALIFY rank <= {k})"


def sem_top(k: int) -> str:
    """Benchmark items as queries of the vectors."""
    return f"""{V_SQL}, sem AS (SELECT q.doc_id AS qid, d.doc_id, d.doc_type, {COSINE} AS score,
  row_number() OVER (PARTITION BY q.doc_id ORDER BY round({COSINE}, 9) DESC, d.doc_id) AS rank
  FROM v q JOIN benchmark b ON b.item_id = q.doc_id CROSS JOIN v d QUALIFY rank <= {k})"""


RANK = "row_number() OVER (PARTITION BY {0} ORDER BY round({1}, 9) DESC, doc_id)"


def rank_sql(group: str = "qid", score: str = "score") -> str:
    return RANK.format(group, score)

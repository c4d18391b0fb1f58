"""Sources and sinks: typed tables, legacy fields, JSON lines, word lists, the vector package, the graph and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import graph
from ..operators.vector import norm_stats
from . import versions

ARTICLE = "article_number int, title string, content string, full_text string, chapter string, section string, related_cases array<string>, crime_types array<string>, document_id string"
CASE = (
    "case_id string, fact string, accusations array<string>, relevant_articles array<int>, "
    "sentence_info struct<imprisonment_months int, fine_amount int, death_penalty boolean, life_imprisonment boolean>, "
    "criminals array<string>, case_summary string, related_articles_docs array<string>"
)
RAW_CASE = "fact string, meta struct<accusation: array<string>, relevant_articles: array<int>, criminals: array<string>, punish_of_money: double, term_of_imprisonment: struct<death_penalty: boolean, life_imprisonment: boolean, imprisonment: int>>"
TRIPLET = "anchor string, positive string, negative string"
GRAPH = "crime string, article int, case_count bigint"

# Other names of the fields in old tables.
ARTICLE_ALIASES = {"article_number": ("article_number", "number", "articleNumber", "article_id", "id"), "content": ("content", "text", "body", "description", "article_text", "law_text", "full_text")}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table; columns and filters of what is built on it reach the scan."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def typed(spark: SparkSession, path: str, schema: str, required: bool = True) -> DataFrame:
    """A Parquet table with a given schema; one that need not exist is empty where it doesn't."""
    if not required and not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def info(spark: SparkSession, path: str) -> dict:
    """Bytes, files and time of change of a stored table; empty without one."""
    if not exists(spark, path):
        return {}
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    summary = fs.getContentSummary(where)
    return {"bytes": summary.getLength(), "files": summary.getFileCount(), "modified_ms": fs.getFileStatus(where).getModificationTime()}


def any_of(df: DataFrame, names: tuple[str, ...], kind: str) -> Column:
    """The first non-null of the columns that are there."""
    there = [F.col(n).cast(kind) for n in names if n in df.columns]
    return F.coalesce(*there) if there else F.lit(None).cast(kind)


def split_list(text: Column) -> Column:
    """A comma-separated text as a list without blanks."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "[,，]"), lambda x: F.trim(x)), lambda x: x != "")


def as_list(df: DataFrame, name: str) -> Column:
    """A list column, from a list or from a comma-separated text."""
    if name not in df.columns:
        return F.array().cast("array<string>")
    if isinstance(df.schema[name].dataType, T.ArrayType):
        return F.coalesce(F.col(name).cast("array<string>"), F.array().cast("array<string>"))
    return split_list(F.col(name).cast("string"))


def as_numbers(df: DataFrame, name: str) -> Column:
    """Whole numbers of a list column; anything else falls out."""
    return F.transform(F.filter(as_list(df, name), lambda x: x.rlike("^[0-9]+$")), lambda x: x.cast("int"))


def normal_articles(df: DataFrame) -> DataFrame:
    """Old article tables in the present form, with default titles and chapters."""
    number = F.regexp_extract(any_of(df, ARTICLE_ALIASES["article_number"], "string"), "([0-9]+)", 1).cast("int")
    return df.select(number.alias("article_number"), F.coalesce(any_of(df, ("title",), "string"), F.concat(F.lit("第"), number.cast("string"), F.lit("条"))).alias("title"), any_of(df, ARTICLE_ALIASES["content"], "string").alias("content"), F.coalesce(any_of(df, ("chapter",), "string"), F.lit("")).alias("chapter"))


def normal_cases(df: DataFrame) -> DataFrame:
    """Old case tables in the present form."""
    return df.select(any_of(df, ("case_id", "id"), "string").alias("case_id"), any_of(df, ("fact", "content", "text"), "string").alias("fact"), as_list(df, "accusations").alias("accusations"), as_numbers(df, "relevant_articles").alias("relevant_articles"), as_list(df, "criminals").alias("criminals"))


def json_cases(spark: SparkSession, path: str) -> DataFrame:
    """Raw cases, one JSON object per line; broken lines are left out."""
    rows = spark.read.schema(RAW_CASE).option("mode", "DROPMALFORMED").json(path)
    return rows.select("fact", F.col("meta.accusation").alias("accusations"), F.col("meta.relevant_articles").alias("relevant_articles"), F.col("meta.criminals").alias("criminals"))


def broken_lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines of a JSON lines file that are not JSON."""
    text = spark.read.text(path).where(F.trim("value") != "")
    return text.where(F.from_json("value", RAW_CASE, {"columnNameOfCorruptRecord": "_bad"}).isNull() | F.get_json_object("value", "$").isNull())


def triplets(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TRIPLET).json(path).where("anchor IS NOT NULL AND positive IS NOT NULL AND negative IS NOT NULL")


def words(spark: SparkSession, path: str, comments: bool = True) -> DataFrame:
    """(word): lines of a word list, trimmed, without blanks and comments."""
    lines = spark.read.text(path).select(F.trim("value").alias("word")).where("word <> ''")
    return lines.where(~F.col("word").startswith("#")) if comments else lines


def csv_texts(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with a header; everything as text, missing as empty."""
    return spark.read.option("header", True).csv(path).na.fill("")


def statute_articles(spark: SparkSession, path: str) -> DataFrame:
    """(number, body): a statute in Markdown, cut at its article headings."""
    whole = spark.read.text(path, wholetext=True)
    parts = whole.select(F.explode(F.split("value", r"(?m)(?=^#*\s*第[0-9]+条)")).alias("part"))
    number = F.regexp_extract("part", r"^#*\s*第([0-9]+)条", 1)
    return parts.where(number != "").select(number.cast("int").alias("number"), F.regexp_replace("part", r"^#*\s*第[0-9]+条\s*|\s+$", "").alias("body"))


def save_vectors(df: DataFrame, path: str) -> DataFrame:
    """Write (doc_id, doc_type, vector), laid out by type, and return the norms' statistics."""
    df.write.mode("overwrite").partitionBy("doc_type").parquet(path)
    return norm_stats(df, "doc_type")


def save_graph(edges: DataFrame, path: str, force: bool = False) -> bool:
    """Publish the edges as the store's new version unless it holds the same rows; whether they were published.

    Readers see the version before until the new one is whole; a write that fails leaves it as it was.
    """
    spark, new = edges.sparkSession, versions.content(edges.select("crime", "article", "case_count"))
    if not force:
        try:
            if versions.current(spark, path).details["content"] == new:
                return False
        except (versions.NoVersion, versions.Damaged):
            pass  # there is nothing to keep
    with versions.draft(spark, path) as draft:
        own = draft.write("edges", edges)
        draft.details.update(content=new, totals=graph.totals(own).first().asDict())
    return True


def load_graph(spark: SparkSession, path: str) -> DataFrame:
    """The published edges; a graph without any is an error."""
    edges = versions.current(spark, path).table("edges")
    if {"crime", "article", "case_count"} - set(edges.columns) or edges.isEmpty():
        raise ValueError(f"no relation graph in {path}")
    return edges


def graph_info(spark: SparkSession, path: str) -> dict:
    """Version, totals and files of the published graph; empty without one."""
    try:
        now = versions.current(spark, path)
    except versions.NoVersion:
        return {}
    own = now.manifest["tables"]["edges"]["files"]
    return {"version": now.manifest["version"], "files": len(own), "bytes": sum(own.values()), **now.details["totals"]}


def rebuild_graph(cases: DataFrame, path: str) -> DataFrame:
    """Extract the relations anew and store them."""
    save_graph(graph.extract_relations(cases), path, force=True)
    return load_graph(cases.sparkSession, path)


def export_rows(edges: DataFrame) -> DataFrame:
    """(Crime, Article, CaseCount, Type): the graph as it is exported."""
    return edges.select(F.concat("crime", F.lit("罪")).alias("Crime"), F.concat(F.lit("第"), F.col("article").cast("string"), F.lit("条")).alias("Article"), F.col("case_count").alias("CaseCount"), F.lit("crime_article").alias("Type"))


def export_graph(edges: DataFrame, path: str, kind: str = "csv") -> None:
    out = export_rows(edges)
    if kind == "csv":
        out.write.mode("overwrite").option("header", True).csv(path)
    elif kind == "json":
        graph.adjacency(edges, "crime", "article").write.mode("overwrite").json(path)
    else:
        raise ValueError(f"unknown kind {kind!r}")


def save_report(rows: DataFrame, path: str) -> None:
    """Metrics or checks as JSON lines."""
    rows.write.mode("overwrite").json(path)


def report_lines(rows: DataFrame) -> DataFrame:
    """(line) of a table, in the order of its columns: numbers with four places, nothing for null."""
    shown = [F.coalesce(F.when(F.col(c).isNotNull(), F.format_string("%.4f", c)) if t in ("double", "float") else F.col(c).cast("string"), F.lit("")) for c, t in rows.dtypes]
    return rows.orderBy(*rows.columns).select(F.concat_ws(" | ", *shown).alias("line"))


def save_text_report(rows: DataFrame, title: str, path: str) -> None:
    """A table of any size as text files, whose names and lines are in order; the title is the first file's first line."""
    spark = rows.sparkSession
    head = spark.createDataFrame([(title,), ("=" * len(title),)], "line string").coalesce(1)
    head.unionByName(report_lines(rows)).write.mode("overwrite").text(path)


def text_report(rows: DataFrame, title: str, most: int = 1_000) -> str:
    """A small table as lines of text; of a larger one the first lines, and how many are left out."""
    lines = [r.line for r in report_lines(rows).limit(most).collect()]
    more = rows.count() - len(lines) if len(lines) == most else 0
    return "\n".join([title, "=" * len(title), *lines, *([f"... and {more} more"] if more else [])])


def save_queries(rows: DataFrame, path: str) -> DataFrame:
    """Generated queries (query_type, query_id, query_text) as Parquet, reread."""
    rows.write.mode("overwrite").partitionBy("query_type").parquet(path)
    return rows.sparkSession.read.parquet(path)


def graph_report(edges: DataFrame) -> DataFrame:
    """One row on a relation graph: whether its columns are there and it has edges, with its numbers."""
    lacking = sorted({"crime", "article", "case_count"} - set(edges.columns))
    own = edges.agg(F.count("*").alias("edges"))
    return own.select("edges", F.lit(", ".join(lacking)).alias("lacking"), ((F.col("edges") > 0) & F.lit(not lacking)).alias("success"))

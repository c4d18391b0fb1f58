"""Audits of vectors, contents and ids: every check is one row (check, value) or a boolean over aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .vector import norm


def missing_columns(df: DataFrame, expected: list[str]) -> list[str]:
    return [c for c in expected if c not in df.columns]


def vector_validity(df: DataFrame, dimension: int, *group: str) -> DataFrame:
    """Numbers of vectors, wrong lengths, not-a-numbers, infinities and zeros, and statistics of all components."""
    v = F.col("vector")
    wide = v.cast("array<double>")
    bad = lambda test: F.sum(F.size(F.filter(wide, test))).cast("long")
    finite = F.filter(wide, lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))
    add = lambda arr: F.aggregate(arr, F.lit(0.0), lambda s, x: s + x)
    total, squares, n = F.sum(add(finite)), F.sum(add(F.transform(finite, lambda x: x * x))), F.sum(F.size(finite))
    return df.groupBy(*group).agg(
        F.count("*").alias("vectors"),
        F.count_if(F.size(v) != dimension).alias("wrong_length"),
        bad(F.isnan).alias("nan_count"),
        bad(lambda x: ~F.isnan(x) & (F.abs(x) == float("inf"))).alias("inf_count"),
        F.count_if(F.forall(v, lambda x: x == 0)).alias("zero_vectors"),
        (total / n).alias("mean_value"),
        F.sqrt(F.greatest(squares / n - (total / n) * (total / n), F.lit(0.0))).alias("std_value"),
        F.min(F.array_min(finite)).alias("min_value"),
        F.max(F.array_max(finite)).alias("max_value"),
    )


def normalised(df: DataFrame, absolute: float = 1e-6, relative: float = 1e-5) -> DataFrame:
    """Whether all norms are 1, in one row."""
    size = norm(F.col("vector"))
    return df.agg(F.coalesce(F.bool_and(F.abs(size - 1) <= absolute + relative), F.lit(True)).alias("is_normalised"))


def counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(source, n): row counts, one row per table."""
    rows = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("source"), "n") for name, df in tables.items()]
    out = rows[0]
    for more in rows[1:]:
        out = out.unionByName(more)
    return out


def reconcile(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Distinct ids in both, only left and only right, in one row."""
    a = left.select(key).distinct().withColumn("l", F.lit(1))
    b = right.select(key).distinct().withColumn("r", F.lit(1))
    both = a.join(b, key, "full_outer")
    return both.agg(F.count_if(F.col("l").isNotNull() & F.col("r").isNotNull()).alias("common"), F.count_if(F.col("r").isNull()).alias("only_left"), F.count_if(F.col("l").isNull()).alias("only_right"))


def missing_examples(left: DataFrame, right: DataFrame, key: str, k: int = 10) -> DataFrame:
    """The first ids of `left` that `right` lacks."""
    return left.select(key).distinct().join(right.select(key), key, "left_anti").orderBy(key).limit(k)


def empty_contents(df: DataFrame, columns: list[str], *group: str) -> DataFrame:
    """Rows and rows with an empty or missing content, for each column."""
    return df.groupBy(*group).agg(F.count("*").alias("n"), *[F.count_if(F.trim(F.coalesce(c, F.lit(""))) == "").alias(f"empty_{c}") for c in columns])


def status(checks: DataFrame) -> DataFrame:
    """critical if counts or ids disagree, warning if contents are empty or vectors zero, else healthy.

    `checks` is one row (count_mismatch, id_mismatch, empty, zero).
    """
    bad, odd = (F.col("count_mismatch") > 0) | (F.col("id_mismatch") > 0), (F.col("empty") > 0) | (F.col("zero") > 0)
    return checks.withColumn("status", F.when(bad, "critical").when(odd, "warning").otherwise("healthy"))


def preload_stats(ids: DataFrame, docs: DataFrame, key: str = "doc_id", kind: str = "doc_type") -> DataFrame:
    """Per type how many ids have a content to load."""
    own = docs.where(F.trim(F.coalesce("text", F.lit(""))) != "").select(key).distinct().withColumn("there", F.lit(1))
    return ids.join(own, key, "left").groupBy(kind).agg(F.count("there").alias("hits"), F.count_if(F.col("there").isNull()).alias("misses"))


def structure(spark: SparkSession, tables: dict[str, DataFrame], expected: dict[str, list[str]]) -> DataFrame:
    """(source, column, present): every expected column of every table, from the schemas alone."""
    rows = [(name, c, c in tables[name].columns) for name, columns in expected.items() for c in columns]
    return spark.createDataFrame(rows, "source string, column string, present boolean")


def advice(checks: DataFrame) -> DataFrame:
    """`status` with what to do about it."""
    what = F.concat_ws("; ", F.when(F.col("count_mismatch") > 0, "rebuild the vectors"), F.when(F.col("id_mismatch") > 0, "match the ids"), F.when(F.col("empty") > 0, "fill empty contents"), F.when(F.col("zero") > 0, "encode zero vectors again"))
    return status(checks).withColumn("advice", F.when(what == "", "none").otherwise(what))


def health(tables: dict[str, DataFrame]) -> DataFrame:
    """(source, n, state): row counts, and whether a table is ready or empty."""
    return counts(tables).withColumn("state", F.when(F.col("n") > 0, "ready").otherwise("empty"))

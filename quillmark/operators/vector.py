"""Exact vector search: cosine top-k of a query set against all rows, norm alignment and vector statistics.

Search multiplies blocks: a task holds a group of queries (a stated query set, in parts if it is large) and emits only its
own k best rows per query, so what is shuffled grows with queries and tasks, not with the table.  A zero vector has similarity
0 with everything.  `vector_index` has the same search over an index that leaves blocks out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import bounded_batches
from .ranking import Best, ranked

#: Queries that a scan is made for at most, and similarities held at once.
QUERY_BLOCK, CELLS = 2_000, 4_000_000
FOUND = "qid long, doc_id long, doc_type string, score double"


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Similarity of two vectors, 0 if one is zero."""
    size = norm(a) * norm(b)
    return F.when(size == 0, F.lit(0.0)).otherwise(dot(a, b) / size)


def has_dimension(a: Column, dimension: int) -> Column:
    return F.coalesce(F.size(a) == dimension, F.lit(False))


def unit(rows: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, size, out=np.zeros_like(rows), where=size > 0)


def matrix(column: pa.Array, dimension: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions of vectors of the right length, their rows)."""
    offsets = column.offsets.to_numpy()
    good = np.flatnonzero((np.diff(offsets) == dimension) & column.is_valid().to_numpy(zero_copy_only=False))
    flat = column.values.to_numpy(zero_copy_only=False).astype(np.float64)
    return good, flat[offsets[:-1][good][:, None] + np.arange(dimension)]


def query_groups(queries: DataFrame, size: int) -> Iterator[dict[int, tuple[np.ndarray, np.ndarray]]]:
    """Queries (qid, vector) in groups of about `size`, each as {length: (ids, vectors)}; one empty group if there are none."""
    asked = queries.where("vector IS NOT NULL AND size(vector) > 0").select("qid", "vector")
    groups = max(1, -(-asked.count() // size))
    for g in range(groups):
        some = asked if groups == 1 else asked.where(F.pmod(F.xxhash64("qid", "vector"), F.lit(groups)) == g)
        found: dict[int, list] = {}
        for r in some.orderBy("qid").collect():
            found.setdefault(len(r.vector), []).append((r.qid, r.vector))
        yield {d: (np.array([q for q, _ in own], np.int64), np.array([v for _, v in own], np.float64)) for d, own in found.items()}


def search(corpus: DataFrame, queries: DataFrame, k: int, by_type: bool = False, threshold: float | None = None) -> DataFrame:
    """(qid, doc_id, doc_type, score, rank): the k most similar rows of `corpus` (doc_id, doc_type, vector) for each of
    `queries` (qid, vector), among vectors of its length; with `by_type`, k of each type.

    Queries travel with the tasks, a bounded number at a time: each such group is one scan of the corpus.
    """
    bounded_batches(corpus.sparkSession)
    rows, out = corpus.select("doc_id", "doc_type", "vector"), None
    for asked in query_groups(queries, QUERY_BLOCK):
        found = rows.mapInArrow(lambda batches, own=asked: best_of_task(batches, own, k, by_type, threshold), FOUND)
        out = found if out is None else out.unionByName(found)
    return ranked(out, *(("qid", "doc_type") if by_type else ("qid",))).where(F.col("rank") <= k)


def best_of_task(batches: Iterator[pa.RecordBatch], asked: dict[int, tuple[np.ndarray, np.ndarray]], k: int, by_type: bool, threshold: float | None) -> Iterator[pa.RecordBatch]:
    """The k best rows of all batches (doc_id, doc_type, vector) of a task for each of some queries {length: (ids, vectors)}."""
    best: dict[tuple[int, str | None], Best] = {}
    units = {d: unit(v) for d, (_, v) in asked.items()}
    for batch in batches:
        for d, (ids, _) in asked.items():
            good, rows = matrix(batch.column("vector"), d)
            docs = batch.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)[good]
            kinds = np.array(batch.column("doc_type").to_pylist(), object)[good]
            rows = unit(rows)
            for kind in sorted(set(kinds), key=str) if by_type else [None]:
                own = np.flatnonzero(kinds == kind) if by_type else np.arange(len(docs))
                own = own[np.argsort(docs[own], kind="stable")]
                if not len(own):
                    continue
                found, step = best.setdefault((d, kind), Best(len(ids), k)), max(1, CELLS // len(own))
                for first in range(0, len(ids), step):
                    scores = units[d][first : first + step] @ rows[own].T
                    found.add(first, scores if threshold is None else np.where(scores >= threshold, scores, -np.inf), docs[own], kinds[own])
    for (d, _), found in best.items():
        query, columns = found.rows()
        if len(query):
            yield pa.RecordBatch.from_arrays([pa.array(asked[d][0][query]), pa.array(columns[1]), pa.array(columns[2], pa.string()), pa.array(columns[0])], ["qid", "doc_id", "doc_type", "score"])


def rescaled(a: Column, target: float | Column) -> Column:
    """The vector at another norm (a zero vector stays); similarity does not change."""
    size = norm(a)
    goal = F.lit(target) if isinstance(target, float) else target
    return F.when(size == 0, a.cast("array<double>")).otherwise(F.transform(a, lambda x: x.cast("double") * (goal / size)))


def calibration(corpus: DataFrame, queries: DataFrame) -> DataFrame:
    """(corpus_norm, query_norm, scale): mean norms and the factor from queries to the corpus, one row."""
    c = corpus.agg(F.avg(norm(F.col("vector"))).alias("corpus_norm"))
    q = queries.agg(F.avg(norm(F.col("vector"))).alias("query_norm"))
    both = c.crossJoin(q)  # two single rows
    return both.withColumn("scale", F.when(F.col("query_norm") > 0, F.col("corpus_norm") / F.col("query_norm")).otherwise(1.0))


def calibrated(queries: DataFrame, scale: DataFrame) -> DataFrame:
    """Queries multiplied by the calibrated factor."""
    return queries.crossJoin(F.broadcast(scale.select("scale"))).withColumn("vector", F.transform("vector", lambda x: x.cast("double") * F.col("scale"))).drop("scale")


def norm_stats(df: DataFrame, *group: str) -> DataFrame:
    """Mean, deviation and extremes of the norms."""
    size = norm(F.col("vector"))
    return df.groupBy(*group).agg(F.count("*").alias("n"), F.avg(size).alias("norm_mean"), F.stddev_pop(size).alias("norm_std"), F.min(size).alias("norm_min"), F.max(size).alias("norm_max"))


def sample_similarities(df: DataFrame, order: Column, size: int) -> DataFrame:
    """Statistics of the similarities inside a small sample, taken in a fixed order."""
    rows = df.orderBy(order, "doc_id").limit(size).select("doc_id", "vector")
    a, b = rows.alias("a"), rows.alias("b")
    pairs = a.join(F.broadcast(b), F.col("a.doc_id") < F.col("b.doc_id")).select(cosine(F.col("a.vector"), F.col("b.vector")).alias("s"))
    return pairs.agg(F.count("*").alias("pairs"), F.avg("s").alias("mean_similarity"), F.stddev_pop("s").alias("std_similarity"), F.min("s").alias("min_similarity"), F.max("s").alias("max_similarity"))


def cross_similarities(left: DataFrame, right: DataFrame, size: int = 10) -> DataFrame:
    """Statistics of the similarities between two small samples, the first ids of each side."""
    few = lambda df, name: df.orderBy("doc_id").limit(size).select(F.lit(0).alias("at"), F.col("vector").alias(name))
    pairs = few(left, "a").join(F.broadcast(few(right, "b")), "at").select(cosine(F.col("a"), F.col("b")).alias("s"))  # size x size rows
    return pairs.agg(F.count("*").alias("pairs"), F.avg("s").alias("mean_similarity"), F.stddev_pop("s").alias("std_similarity"), F.min("s").alias("min_similarity"), F.max("s").alias("max_similarity"))


def kmeans(df: DataFrame, k: int = 10, seed: int = 42) -> DataFrame:
    """(doc_id, cluster) of k-means over the vectors."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = df.select("doc_id", array_to_vector(F.col("vector").cast("array<double>")).alias("features"))
    return KMeans(k=k, seed=seed).fit(rows).transform(rows).select("doc_id", F.col("prediction").alias("cluster"))

"""Vector search over an index against multiplication with all rows."""

import numpy as np
import pyarrow as pa
import pytest

from quillmark.operators import vector, vector_index
from quillmark.sources import versions


def rows(df, by_type=False):
    return sorted((r.qid, r.doc_type if by_type else "", r["rank"], r.doc_id, round(r.score, 8)) for r in df.collect())


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(60, 24))
    return (centres[rng.integers(0, 60, 100_000)] + 0.08 * rng.normal(size=(100_000, 24))).astype(np.float32), centres + 0.05 * rng.normal(size=centres.shape)


def test_index_equals_all_products_and_leaves_blocks_out(spark, tmp_path, clustered):
    own, asked = clustered
    corpus = spark.createDataFrame(pa.table({"doc_id": np.arange(len(own)), "doc_type": pa.array(np.where(np.arange(len(own)) % 3, "A", "B")), "vector": list(own)})).repartition(4)
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(asked)], "qid long, vector array<double>")
    vector_index.save_index(corpus, str(tmp_path / "i"), pivots=64)
    blocks = vector_index.load_index(spark, str(tmp_path / "i"))
    got = vector_index.search_index(blocks, queries, 10)
    unit = own.astype(np.float64) / np.linalg.norm(own.astype(np.float64), axis=1, keepdims=True)
    scores = asked @ unit.T / np.linalg.norm(asked, axis=1, keepdims=True)
    want = [(q, d) for q in range(60) for d in np.lexsort((np.arange(len(own)), -np.round(scores[q], 9)))[:10].tolist()]
    assert sorted((r.qid, r.doc_id) for r in got.collect()) == sorted(want)
    group = {24: vector_index.Asked(np.arange(60), vector.unit(asked))}
    for q in range(60):
        group[24].kth[q, None] = float(np.sort(scores[q])[-10]) - 1e-7
    read = vector_index.reached(blocks.drop("ids", "vectors"), {24: vector_index.Asked(np.arange(1), vector.unit(asked[:1]), {(0, None): group[24].kth[0, None]})}, False, None).count()
    assert read < blocks.count() / 10  # a query's own cells only
    state = vector_index.Search(group, 10, False, None)
    for batch in blocks.toArrow().combine_chunks().to_batches(max_chunksize=64):
        state.add(batch)
    assert state.scored < state.pairs / 10
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


@pytest.mark.parametrize("groups", [1000, 2])
def test_odd_vectors_types_and_thresholds(spark, tmp_path, monkeypatch, groups):
    monkeypatch.setattr(vector, "QUERY_BLOCK", groups)
    monkeypatch.setattr(vector_index, "QUERY_BLOCK", groups)
    rng = np.random.default_rng(6)
    data = [(i, "AB"[i % 2] if i % 7 else None, rng.normal(size=3 if i % 5 else 2).tolist()) for i in range(200)]
    data += [(500 + i, "A", [0.0, 0.0, 0.0]) for i in range(3)] + [(600, "A", None), (601, "B", [])] + [(7, "A", [1.0, 2.0, 3.0])] * 2 + [(-4, "B", [-1.0, -2.0, -3.0])]
    corpus = spark.createDataFrame(data, "doc_id long, doc_type string, vector array<double>").repartition(3)
    asked = [(1, [1.0, 2.0, 3.0]), (2, [0.0, 0.0, 0.0]), (3, [1.0, 0.0]), (4, None), (5, []), (6, [1.0]), (7, [-1.0, 0.5, 0.0])]
    queries = spark.createDataFrame(asked, "qid long, vector array<double>")
    vector_index.save_index(corpus, str(tmp_path / "i"), pivots=8, block=5)
    blocks = vector_index.load_index(spark, str(tmp_path / "i"))
    for k, threshold in ((4, None), (300, None), (10, 0.3)):
        got = vector_index.search_index(blocks, queries, k, threshold=threshold)
        assert rows(got) == rows(vector.search(corpus, queries, k, threshold=threshold))
    typed = corpus.where("doc_type IS NOT NULL")
    vector_index.save_index(typed, str(tmp_path / "t"), pivots=8, block=5)
    got = vector_index.search_index(vector_index.load_index(spark, str(tmp_path / "t")), queries, 3, by_type=True)
    assert rows(got, True) == rows(vector.search(typed, queries, 3, by_type=True), True)
    assert vector_index.search_index(blocks, queries.limit(0), 3).count() == 0


def test_empty_and_stale(spark, tmp_path):
    path, index = str(tmp_path / "v"), str(tmp_path / "i")
    queries = spark.createDataFrame([(1, [1.0, 0.0])], "qid long, vector array<double>")
    spark.createDataFrame([], "doc_id long, doc_type string, vector array<double>").write.parquet(path)
    vector_index.save_index(spark.read.parquet(path), index)
    assert vector_index.search_index(vector_index.load_index(spark, index, spark.read.parquet(path)), queries, 3).count() == 0
    spark.createDataFrame([(1, "A", [1.0, 0.0])], "doc_id long, doc_type string, vector array<double>").write.mode("overwrite").parquet(path)
    with pytest.raises(versions.Stale):
        vector_index.load_index(spark, index, spark.read.parquet(path))

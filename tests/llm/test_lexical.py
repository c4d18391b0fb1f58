import math
import re
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from quillmark.llm import lexical

PATTERN = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return PATTERN.findall((text or "").translate(LOWER))


def brute(docs, queries, k):
    """(item_id, rank, doc_id, score) of every query, rows that repeat included."""
    held = [(i, Counter(t)) for i, t in ((i, terms(x)) for i, x in docs) if t]
    n_docs, n_terms = len(held), sum(c.total() for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in queries:
        scored = []
        for doc, own in held:
            m = 100 - 25 + (25 * own.total() * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * own[t]) // (1000 * own[t] + 12 * m)) for t in terms(text) if t in own)
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        out += [(item, rank, doc, -s) for rank, (s, _, _, doc) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def found(spark, docs, queries, k, **more):
    d = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, rank int, term string").repartition(3)
    q = spark.createDataFrame([(i, t, 1) for i, t in queries], "item_id long, text string, score int")
    index = lexical.build(d, **more)
    out = lexical.search(index, q, k)
    assert out.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted((tuple(r) for r in out.collect()), key=str)


@pytest.mark.parametrize(("k", "size", "at_once"), [(20, 4, 1000), (3, 1, 1000), (5, 64, 3)])
def test_search_equals_brute_force(spark, prose, monkeypatch, k, size, at_once):
    monkeypatch.setattr(lexical, "QUERIES_AT_ONCE", at_once)
    rng = prose.rng
    docs = [(i, prose(rng.choice([0, 1, 3, 30, 90]))) for i in range(150)]
    docs += [(200, None), (201, ""), (202, "... !!"), (203, "日本 river日本 RIVER"), (None, "river stone"), (7, "river stone"), (7, "river stone"), (8, "x1 " * 60_000)]
    docs += [(300 + i, "same copy of seven words in all") for i in range(40)]
    queries = [(i, prose(rng.randrange(1, 9))) for i in range(8)] + [(20, None), (21, ""), (22, "nowhere zzz"), (23, "River, river!"), (24, "日本"), (25, "seven copy seven"), (25, "seven copy seven"), (None, "stone 3.5")]
    assert found(spark, docs, queries, k, block_docs=size) == brute(docs, queries, k)


def test_empty_tables(spark):
    assert found(spark, [], [(1, "a")], 5) == []
    assert found(spark, [(1, "a")], [], 5) == []
    assert found(spark, [(1, None)], [(1, "a")], 5) == []


def test_blocks_below_the_threshold_go_unscored(spark):
    """Documents about a query's rare words lie in few blocks: the others are bounded by their maxima and left out."""
    rows = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.expr("CASE WHEN id % 2 = 0 THEN 'common words ' ELSE 'further ones ' END"), F.expr("CASE WHEN id DIV 40 = 50 THEN concat('rare needle ', id) ELSE concat('other ', id % 97) END")).alias("text"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")  # other tests may have left less; blocks end with batches
    index = lexical.build(rows.coalesce(1), block_docs=40)
    asked = lexical.Asked.of(["common rare needle", "common words"])
    asked.weigh(lexical.frequencies(index, asked), index.docs)
    assert lexical.best_blocks(index, asked, 1)[-1] == 50
    state = lexical.Scan(index, asked, np.ones(2, np.int64), 20)
    for batch in index.blocks.orderBy("block").toArrow().combine_chunks().to_batches(max_chunksize=25):
        state.add(batch)
    assert state.pairs == 200 and len(state.doc[0]) == 20 and state.doc[0].tolist() == list(range(2000, 2040, 2))
    informed = lexical.Scan(index, asked, np.array([int(state.score[0][-1]), 1]), 20)
    for batch in index.blocks.orderBy("block").toArrow().combine_chunks().to_batches(max_chunksize=25):
        informed.add(batch)
    assert informed.scored < state.scored < state.pairs and informed.doc[0].tolist() == state.doc[0].tolist()
    alone = lexical.Scan(index, lexical.Asked.of([]), np.zeros(0, np.int64), 20)
    assert alone.results().num_rows == 0


def test_bounds_are_never_below_a_score(spark, prose):
    docs = [(i, prose(prose.rng.randrange(1, 60))) for i in range(120)]
    index = lexical.build(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), block_docs=8)
    asked = lexical.Asked.of([prose(6) for _ in range(10)])
    asked.weigh(lexical.frequencies(index, asked), index.docs)
    (batch,) = index.blocks.orderBy("block").toArrow().combine_chunks().to_batches()
    lengths, known = asked.known(batch.column("terms"))
    bounds = asked.bounds(batch, lengths, known)
    postings = lexical.Postings(index, batch, lengths, known)
    for q, (own, weights) in enumerate(asked.by_query()):
        for b in range(len(lengths)):
            _, scores = postings.scores(own, weights, np.array([b]))
            assert scores.max(initial=0) <= bounds[b, q]


def test_row_groups_of_blocks_are_bounded(spark, prose, monkeypatch):
    """Spark decodes a row group's rows at once, up to 4,096 of them: many blocks in one would fill the heap."""
    monkeypatch.setattr(lexical, "ROW_GROUP", 30_000)
    docs = [(i, prose(60)) for i in range(640)]
    index = lexical.build(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), block_docs=8)
    (path,) = (f for f in index.blocks.inputFiles())
    meta = pq.ParquetFile(path.removeprefix("file://")).metadata
    groups = [meta.row_group(i) for i in range(meta.num_row_groups)]
    assert meta.num_rows == 80 and len(groups) > 3 and max(g.num_rows for g in groups) < 40
    assert lexical.search(index, spark.createDataFrame([(1, docs[7][1])], "item_id long, text string"), 1).first().doc_id == 7

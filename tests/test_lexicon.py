"""Segmentation, ranks of words, and lexicons against brute force on literal texts."""

import itertools
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillmark.functions.segment import Segmenter, lexicon_matches, segmented
from quillmark.operators import lexicon

WORDS = {"合同": 50, "违约": 30, "责任": 60, "合同违约": 5, "违约责任": 20, "承担": 25, "交通": 30, "交通事故": 40, "事故": 30, "人身": 10, "损害": 20, "赔偿": 30, "损害赔偿": 15, "刑事": 20, "诉讼": 20, "程序": 10, "规定": 30, "刑": 3, "事": 5, "研究": 10, "研究生": 12, "生命": 15, "命": 4, "起源": 8}


def paths(text):
    if not text:
        yield []
    for k in range(1, len(text) + 1):
        if k == 1 or text[:k] in WORDS:
            for rest in paths(text[k:]):
                yield [text[:k], *rest]


@pytest.mark.parametrize("text", ["合同违约责任承担", "交通事故人身损害赔偿", "刑事诉讼程序规定", "研究生命起源", "不在词典里", "责责任任", "", "命"])
def test_the_likeliest_path_of_all(text):
    total = sum(WORDS.values())
    weight = lambda p: sum(math.log(WORDS.get(w, 1)) - math.log(total) for w in p)
    best = max((round(weight(p), 9) for p in paths(text)), default=0)
    got = Segmenter(WORDS).cut(text)
    assert "".join(got) == text and round(weight(got), 9) == best


def test_texts_of_several_kinds(spark):
    own = Segmenter(WORDS)
    assert own.words("合同违约责任 v2.5，ABC 刑") == ["合同", "违约责任", "v2.5", "，", "ABC", "刑"]
    assert own.words(None) == own.words("  ") == [] and Segmenter({}).cut("刑事") == ["刑", "事"]
    rows = spark.createDataFrame([(1, "损害赔偿责任", "own"), (2, None, "own")], "doc_id long, text string, c0 string")
    out = segmented(rows, own, F.col("text"))
    assert out.columns == ["doc_id", "text", "c0", "words"] and {r.doc_id: r.words for r in out.collect()} == {1: ["损害赔偿", "责任"], 2: []}
    weights = F.create_map(F.lit("责任"), F.lit(0.5))
    assert [tuple(x) for x in out.where("doc_id = 1").select(lexicon_matches(F.col("words"), weights).alias("m")).first().m] == [("责任", 0.5)]
    assert len(own.cut("责任" * 20_000)) == 20_000


def graph_of(docs):
    edges = Counter()
    for words in docs:
        for i, j in itertools.combinations(range(len(words)), 2):
            if j - i < lexicon.SPAN and words[i] != words[j]:
                edges[words[i], words[j]] += 1
                edges[words[j], words[i]] += 1
    return edges


def power(edges, steps):
    whole = Counter()
    for (a, _), w in edges.items():
        whole[a] += w
    now = dict.fromkeys(whole, 1.0)
    for _ in range(steps):
        now = {b: 0.15 + 0.85 * sum(w / whole[a] * now[a] for (a, to), w in edges.items() if to == b) for b in now}
    return now


def test_ranks_equal_plain_power_iteration_and_converge(spark):
    rng = random.Random(8)
    docs = [[rng.choice("abcdefghij") + rng.choice(["", "x"]) for _ in range(rng.randrange(0, 30))] for _ in range(30)]
    rows = spark.createDataFrame([(i, d) for i, d in enumerate(docs)] + [(99, None)], "doc_id long, words array<string>").repartition(3)
    edges = lexicon.neighbours(rows)
    want = graph_of(docs)
    assert {(r.a, r.b): r.weight for r in edges.collect()} == want
    for steps in (1, 4):
        got = {r.word: r["rank"] for r in lexicon.ranks(edges, steps).collect()}
        assert got == pytest.approx(power(want, steps))
    settled = {r.word: r["rank"] for r in lexicon.ranks(edges, 200, tolerance=1e-7).collect()}
    assert settled == pytest.approx(power(want, 60), abs=1e-5)
    assert lexicon.ranks(edges.limit(0), 3, tolerance=1e-3).count() == 0


def test_a_lexicon_of_chinese_texts(spark):
    texts = ["合同违约责任承担", "交通事故损害赔偿", "合同违约损害赔偿", "研究生命起源", "刑事诉讼程序规定"]
    rows = segmented(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), Segmenter(WORDS), F.col("text"))
    out = {r.word: r for r in lexicon.combined(lexicon.tf_idf(rows), lexicon.by_rank(lexicon.ranks(lexicon.neighbours(rows)))).collect()}
    assert {"合同", "损害赔偿", "违约责任"} & set(out) and all(2 <= len(w) <= 8 for w in out)
    first = {r.word: r.weight for r in lexicon.tf_idf(rows).collect()}
    second = {r.word: r.weight for r in lexicon.by_rank(lexicon.ranks(lexicon.neighbours(rows))).collect()}
    for w, r in out.items():
        gain = 1.3 if any(p in w for p in ["法", "律", "条", "款", "罪", "权", "责", "诉", "讼", "判", "合同", "协议", "赔偿", "损害", "刑事", "民事", "行政", "商事"]) else 1.0
        assert r.weight == pytest.approx(gain * (0.7 * first.get(w, 0) + 0.3 * second.get(w, 0)))
        assert r.category == ("high_weight" if r.weight > 0.03 else "legal_pattern" if r.weight > 0.02 else "medium_weight")


def test_edges_are_summed_over_batches_of_a_task(spark, monkeypatch):
    """Many small batches send no more rows than one large, and bounds on a task's edges change no sum."""
    docs = spark.range(0, 400, 1, 1).select(F.col("id").alias("doc_id"), F.transform(F.sequence(F.lit(0), F.lit(30)), lambda x: F.concat(F.lit("w"), (x * x + F.col("id") % 5) % 23)).alias("words"))
    want = graph_of([r.words for r in docs.orderBy("doc_id").collect()])
    monkeypatch.setattr(lexicon, "WORDS", 40)
    assert {(r.a, r.b): r.weight for r in lexicon.neighbours(docs).collect()} == want
    assert lexicon.task_edges(docs).count() == len(want)
    monkeypatch.setattr(lexicon, "EDGES", 10)
    assert lexicon.task_edges(docs).count() > len(want)
    assert {(r.a, r.b): r.weight for r in lexicon.neighbours(docs).collect()} == want


@pytest.mark.parametrize("travel", [lexicon.TRAVEL, 5])
def test_ranks_without_edges_equal_those_of_the_edges(spark, monkeypatch, travel):
    """Whatever the blocks and the words that travel at once; the edges are never listed."""
    rng = random.Random(5)
    docs = [[rng.choice("abcdefghij") + rng.choice(["", "x"]) for _ in range(rng.randrange(0, 30))] for _ in range(60)] + [["alone"], ["same", "same"], [], ["ab"], ["ab", "cd"]]
    rows = spark.createDataFrame([(i, d) for i, d in enumerate(docs)] + [(99, None)], "doc_id long, words array<string>").repartition(3)
    want = power(graph_of(docs), 3)
    monkeypatch.setattr(lexicon, "task_edges", None)
    monkeypatch.setattr(lexicon, "BLOCK", 40)
    monkeypatch.setattr(lexicon, "TRAVEL", travel)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {r.word: r["rank"] for r in lexicon.word_ranks(rows, 3).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == pytest.approx(want) and "alone" not in got and "same" not in got
    assert lexicon.word_ranks(rows.limit(0), 2).count() == 0


def test_words_are_counted_over_rows(spark, monkeypatch):
    docs = [["a", "b", "a"], ["a"], None, [], ["b", "c"]]
    rows = spark.createDataFrame([(i // 2, d) for i, d in enumerate(docs)], "doc_id long, words array<string>").coalesce(1)
    monkeypatch.setattr(lexicon, "EDGES", 1)
    assert {(r.word, r.tf, r.df) for r in lexicon.word_counts(rows).collect()} == {("a", 3, 2), ("b", 2, 2), ("c", 1, 1)}

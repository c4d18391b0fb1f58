"""Operators on small literal inputs: known values, brute force and properties."""

import math
import time

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillmark.functions import encode
from quillmark.operators import content, entity, evaluate, fusion, graph, keyword, quality, ranking, vector
from quillmark.sources import tables
from quillmark.streaming import trace


def one(spark, column, **values):
    """The value of a column over one row of literals."""
    return spark.range(1).select(*[F.lit(v).alias(k) if v is not None else F.lit(None).cast("string").alias(k) for k, v in values.items()], F.lit(1).alias("_")).select(column.alias("x")).first().x


# vectors and ranks


def test_search_keeps_ties_in_order_and_zero_vectors_at_zero(spark):
    rows = [(3, "A", [1.0, 0.0]), (1, "A", [2.0, 0.0]), (2, "B", [0.0, 1.0]), (4, "B", [0.0, 0.0]), (5, "A", None), (6, "A", [1.0])]
    corpus = spark.createDataFrame(rows, "doc_id long, doc_type string, vector array<float>")
    asked = spark.createDataFrame([(9, [1.0, 0.0])], "qid long, vector array<float>")
    found = vector.search(corpus, asked, 3).orderBy("rank").collect()
    assert [(r.doc_id, round(r.score, 6)) for r in found] == [(1, 1.0), (3, 1.0), (2, 0.0)]
    by_type = vector.search(corpus, asked, 1, by_type=True).collect()
    assert sorted(r.doc_id for r in by_type) == [1, 2]
    assert vector.search(corpus, asked.limit(0), 3).count() == 0
    assert vector.search(corpus.limit(0), asked, 3).count() == 0


def test_large_query_sets_are_searched_in_blocks(spark, monkeypatch):
    rows = [(i, "AB"[i % 2], [float(i % 7), float(i % 5), 1.0]) for i in range(60)]
    corpus = spark.createDataFrame(rows, "doc_id long, doc_type string, vector array<float>")
    asked = spark.createDataFrame([(i, [float(i), 1.0, 2.0]) for i in range(9)] + [(50, None), (51, [])], "qid long, vector array<float>")
    own = lambda: sorted((r.qid, r.doc_id, r.rank, round(r.score, 9)) for r in vector.search(corpus, asked, 4, by_type=True).collect())
    whole = own()
    monkeypatch.setattr(vector, "QUERY_BLOCK", 2)
    assert own() == whole and len(whole) == 9 * 8


def test_rescaling_keeps_the_cosine(spark):
    row = spark.createDataFrame([([3.0, 4.0], [1.0, 2.0])], "a array<float>, b array<float>")
    scaled = row.withColumn("c", vector.rescaled(F.col("a"), 19.776))
    got = scaled.select(vector.norm(F.col("c")).alias("n"), vector.cosine(F.col("a"), F.col("b")).alias("x"), vector.cosine(F.col("c"), F.col("b")).alias("y")).first()
    assert got.n == pytest.approx(19.776) and got.x == pytest.approx(got.y) == pytest.approx(11 / 5 / math.sqrt(5))


def test_top_k_of_a_large_table_is_one_ordered_cut(spark):
    plan = ranking.top_k(spark.range(100).select(F.col("id").alias("doc_id"), (F.col("id") * 0.5).alias("score")), 5)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan
    grouped = ranking.top_k(spark.range(100).select((F.col("id") % 3).alias("qid"), F.col("id").alias("doc_id"), (F.col("id") * 0.5).alias("score")), 5, "qid")
    assert "WindowGroupLimit" in grouped._jdf.queryExecution().executedPlan().toString()


def two_pointers(rows, k):
    """Merge two sorted lists by similarity, the first type winning ties, an exhausted side counting as 0."""
    a = sorted([r for r in rows if r[1] == "A"], key=lambda r: (-r[2], r[0]))
    b = sorted([r for r in rows if r[1] == "B"], key=lambda r: (-r[2], r[0]))
    out, i, j = [], 0, 0
    while len(out) < k and (i < len(a) or j < len(b)):
        x, y = a[i][2] if i < len(a) else 0, b[j][2] if j < len(b) else 0
        if x >= y and i < len(a):
            out.append(a[i][0])
            i += 1
        elif j < len(b):
            out.append(b[j][0])
            j += 1
        else:
            break
    return out


@pytest.mark.parametrize("scores", [[0.5, 0.2, -0.1, 0.5, 0.1, -0.3], [-0.5, -0.2, -0.1, 0.5, 0.1, 0.3], [0.9, 0.8, 0.7, 0.1, 0.1, 0.1], [-0.1, -0.2, -0.3, -0.1, -0.2, -0.3]])
def test_interleaving_equals_two_pointers(spark, scores):
    rows = [(i, "A" if i < 3 else "B", s) for i, s in enumerate(scores)]
    run = spark.createDataFrame([(1, *r) for r in rows], "qid long, doc_id long, doc_type string, score double")
    got = [r.doc_id for r in ranking.interleaved(run, 6, "qid").orderBy("rank").collect()]
    assert got == two_pointers(rows, 6)


def test_balanced_merge_modes(spark):
    run = spark.createDataFrame([(1, 1, "A", 0.9), (1, 2, "A", 0.8), (1, 3, "B", 0.1)], "qid long, doc_id long, doc_type string, score double")
    assert [r.doc_id for r in ranking.balanced(run, 1, "qid").collect()] == [1]
    assert sorted(r.doc_id for r in ranking.balanced(run, 1, "qid", exact=False).collect()) == [1, 3]
    assert ranking.split_counts(10) == (5, 5) and ranking.split_counts(3) == (2, 1)


# keywords


def okapi(corpus, query, k1=1.5, b=0.75):
    n, avg = len(corpus), sum(map(len, corpus)) / len(corpus)
    terms = {t for d in corpus for t in d}
    raw = {t: math.log(n - sum(t in d for d in corpus) + 0.5) - math.log(sum(t in d for d in corpus) + 0.5) for t in terms}
    floor = 0.25 * sum(raw.values()) / len(raw)
    idf = {t: floor if v < 0 else v for t, v in raw.items()}
    return [sum(idf.get(t, 0) * d.count(t) * (k1 + 1) / (d.count(t) + k1 * (1 - b + b * len(d) / avg)) for t in query) for d in corpus]


def test_bm25_equals_brute_force(spark):
    texts = ["a cat sat", "a dog sat on a cat", "birds", "", "a a a dog", "a cat sat"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    asked = spark.createDataFrame([(1, "cat dog cat"), (2, "a bird"), (3, "none")], "qid long, text string")
    got = {(r.qid, r.doc_id): r.score for r in keyword.search(docs, asked, 10).collect()}
    for qid, text in ((1, "cat dog cat"), (2, "a bird"), (3, "none")):
        for doc, score in enumerate(okapi([t.split() for t in texts], text.split())):
            assert got.get((qid, doc), 0) == pytest.approx(max(score, 0))


# fusion


def test_rrf_is_monotone_and_independent_of_order(spark):
    runs = [(1, 10, "a", 1, 0.9), (1, 11, "a", 2, 0.8), (1, 11, "b", 1, 0.7), (1, 12, "b", 2, 0.6)]
    schema = "qid long, doc_id long, path string, rank int, score double"
    got = {r.doc_id: r.score for r in fusion.rrf(spark.createDataFrame(runs, schema)).collect()}
    assert got == pytest.approx({10: 1 / 61, 11: 1 / 62 + 1 / 61, 12: 1 / 62})
    assert got == pytest.approx({r.doc_id: r.score for r in fusion.rrf(spark.createDataFrame(runs[::-1], schema)).collect()})


def test_enhanced_rrf_punishes_seen_texts(spark):
    runs = spark.createDataFrame([(1, 10, "knowledge_graph", 0.8, "Same"), (1, 10, "basic_semantic", 0.5, "Same"), (1, 11, "basic_semantic", 0.9, "other")], "qid long, doc_id long, path string, score double, text string")
    got = {r.doc_id: r.score for r in fusion.enhanced_rrf(runs).collect()}
    first = 2.5 / 21 * (1 + 1.5 * 0.8) + 1.8 / 22 * (1 + 1.5 * 0.5) * 0.85
    assert got == pytest.approx({10: first * 1.3, 11: 1.8 / 21 * (1 + 1.5 * 0.9)})


@pytest.mark.parametrize(("n", "total", "factor"), [(3, 0.05, 2.5 * 1.5), (3, 0.2, 2.5), (3, 0.5, 1.2), (10, 0.05, 1.8 * 1.5), (50, 0.2, 1.3), (50, 0.05, None), (60, 0.5, None)])
def test_adaptive_boost_branches(spark, n, total, factor):
    rows = [(1, 0, total, total, False)] + [(1, i, 10.0, 10.0, False) for i in range(1, n)]
    merged = spark.createDataFrame(rows, "qid long, doc_id long, total double, best double, original boolean")
    got = fusion.adaptive_boost(merged).where("doc_id = 0").first().boosted
    assert got == pytest.approx(total * (factor or 1))


def test_consistency_of_one_list_is_one(spark):
    runs = spark.createDataFrame([(1, 1, "semantic", 1, 0.5), (1, 1, "bm25", 21, 0.5), (1, 2, "bm25", 1, 0.5)], "qid long, doc_id long, path string, rank int, score double")
    got = {r.doc_id: r.consistency for r in fusion.weighted(runs).collect()}
    assert got == pytest.approx({1: 0.5, 2: 1.0})


# graph


@pytest.mark.parametrize(("crime", "article", "valid"), [("盗窃", 264, True), ("盗窃", 276, True), ("盗窃", 277, False), ("其他", 20, False), ("其他", 21, True), ("其他", 452, False), ("其他", 425, False), ("诈骗", 261, True), ("诈骗", 260, False)])
def test_relation_rules(spark, crime, article, valid):
    pairs = spark.createDataFrame([(crime, article)], "crime string, article int")
    assert graph.valid_relations(pairs).count() == int(valid)


def test_extraction_counts_every_pair(spark):
    rows = [(["盗窃罪", "[抢劫]"], [264, 5]), (["盗窃"], [264]), (["罪"], [264]), (None, [264])]
    got = {(r.crime, r.article): r.case_count for r in graph.extract_relations(spark.createDataFrame(rows, "accusations array<string>, relevant_articles array<int>")).collect()}
    assert got == {("盗窃", 264): 2, ("抢劫", 264): 1}


@pytest.mark.parametrize(("counts", "kept"), [([1], [(0.95, True)]), ([2, 8], [(0.8 * 1, False), (0.4, False)]), ([30, 1], [(30 / 31, False)]), ([19, 1], [(0.75, False), (0.05 * 1.5, False)])])
def test_related_articles_branches(spark, counts, kept):
    edges = spark.createDataFrame([("x", i, n) for i, n in enumerate(counts)], "crime string, article int, case_count long")
    got = graph.related_articles(edges).orderBy("place").collect()
    total, want = sum(counts), []
    for n in sorted(counts, reverse=True):
        raw = n / total
        if total <= 5 or total <= 20 and raw >= 0.02 or total > 20 and raw >= 0.05 and n >= 2:
            want.append(min(raw * 3, 0.95) if total <= 3 else min(raw * 2, 0.85) if total <= 10 else min(raw * 1.5, 0.75) if total <= 20 else raw)
    assert [r.confidence for r in got] == pytest.approx(want) and len(got) == len(kept)


def test_truncation_comes_before_the_filter(spark):
    edges = spark.createDataFrame([("x", i, 2) for i in range(30)], "crime string, article int, case_count long")
    assert graph.related_articles(edges, 10).count() == 0  # each of the ten has 2 of 60 cases


# texts


def test_names_and_numbers(spark):
    assert one(spark, graph.normal_crime(F.col("x")), x=" [走私、贩卖]毒品罪 ") == "[走私、贩卖]毒品"
    assert one(spark, graph.normal_crime(F.col("x")), x="[盗窃罪]") == "盗窃"
    assert one(spark, graph.plain_crime(F.col("x")), x="罪") is None
    assert one(spark, graph.article_number(F.col("x")), x="刑法第264条之2") == "264"
    for raw, want in (("case_case_000001", "case_1"), ("CASE_1", "case_1"), ("law_12_x", "article_12"), ("article_012", "article_12"), ("000", "0"), ("abc", "abc")):
        assert one(spark, content.canonical_id(F.col("x")), x=raw) == want


def test_crime_detection_ladder(spark):
    edges = spark.createDataFrame([("盗窃", 264, 1), ("故意伤害", 234, 1), ("故意杀人", 232, 1), ("走私、贩卖毒品", 347, 1)], "crime string, article int, case_count long")
    texts = ["盗窃罪", "他犯了故意伤害", "有故意的行为", "伤害", "天气", "走私、贩卖毒品的人"]
    asked = spark.createDataFrame(list(enumerate(texts)), "qid long, text string")
    got = {}
    for r in entity.detect_crimes(asked, edges).collect():
        got.setdefault(r.qid, set()).add(r.crime)
    assert got == {0: {"盗窃"}, 1: {"故意伤害", "故意杀人"}, 2: {"故意杀人"}, 3: {"故意伤害"}}
    found = entity.detect_articles(spark.createDataFrame([(1, "第 264 条"), (2, "232条和999条"), (3, "无")], "qid long, text string"), edges)
    assert {(r.qid, r.article) for r in found.collect()} == {(1, "264"), (2, "232")}


def test_weighted_keywords(spark):
    asked = spark.createDataFrame([(1, "盗窃他人财物，情节严重怎么判刑"), (2, "hello")], "qid long, text string")
    rows = entity.weighted_keywords(asked).orderBy("qid", "place").collect()
    got = [(r.keyword, r.weight) for r in rows]
    assert got[:5] == [("第264条", 0.95), ("264", 0.9), ("盗窃罪", 0.85), ("盗窃", 0.8), ("情节严重", 0.7)]
    assert all(r.qid == 1 for r in rows) and len(got) <= 8


def test_defendants_and_sentences(spark):
    def names(given, fact):
        row = spark.createDataFrame([(given, fact)], "n array<string>, f string")
        return row.select(entity.defendants(F.col("n"), F.col("f")).alias("x")).first().x

    assert names(["张三", " "], "被告人李四") == "张三"
    assert names([], "被告人李某甲、王五；犯罪嫌疑人赵六等人在某地") == "李某甲、赵六等人"  # the suffix is only cut at the end
    assert names(None, "nothing") == "暂无"

    def verdict(death, life, months, fine, fact=None):
        row = spark.createDataFrame([(death, life, months, fine, fact)], "d boolean, l boolean, m int, f int, t string")
        return row.select(entity.sentence(*[F.col(c) for c in "dlmft"]).alias("x")).first().x

    assert verdict(True, True, 5, None) == "死刑"
    assert verdict(False, True, 5, 100) == "无期徒刑、罚金100元"
    assert verdict(False, False, 30, 0) == "有期徒刑2年6个月"
    assert verdict(None, None, 24, None) == "有期徒刑2年"
    assert verdict(None, None, None, None, "判处有期徒刑3年，罚金5000元") == "有期徒刑3年、罚金5000元"
    assert verdict(None, None, None, None) == "暂无"


def test_templates_and_cleaning(spark):
    rows = spark.createDataFrame([("偷东西", [("盗窃罪", 264)]), ("别的", [])], "t string, c array<struct<crime_name string, article_number int>>")
    out = rows.select(entity.query2doc(F.col("t"), F.col("c")).alias("q"), entity.hypothetical_answer(F.col("t"), F.col("c")).alias("h")).collect()
    assert "盗窃罪等罪名。相关法条包括第264条。针对'偷东西'" in out[0].q and out[1].q.startswith("关于'别的'")
    assert "依据《刑法》第264条，" in out[0].h and out[1].h.startswith("关于别的")
    assert one(spark, entity.clean_generated(F.col("x")), x='回答："一二三四五六七八九十一"') == "一二三四五六七八九十一"
    assert one(spark, entity.clean_generated(F.col("x")), x="短") == ""
    assert len(one(spark, entity.clean_generated(F.col("x")), x="字" * 300)) == 203


def test_classification_payload(spark):
    good = spark.createDataFrame([('{"is_criminal_law": true, "identified_crimes": [{"crime_name": "x", "relevance": 0.5}, {"relevance": 1}]}',), ("not json",)], "p string")
    got = [r.x for r in good.select(entity.parse_classification(F.col("p")).alias("x")).collect()]
    assert got[0].is_criminal_law and len(got[0].identified_crimes) == 1 and got[0].confidence == 0 and got[1] is None


def test_previews_and_formats(spark):
    assert one(spark, content.content_preview(F.col("x"), 10), x="一二三四五六七八。十十十") == "一二三四五六七八。"
    assert one(spark, content.content_preview(F.col("x"), 10), x="一。三四五六七八九十十十") == "一。三四五六七八九十..."
    assert one(spark, content.content_preview(F.col("x"), 10), x="短") == "短"
    row = spark.createDataFrame([("case_1", ["盗窃"], [264], None, 12, 0, False, None)], "i string, a array<string>, r array<int>, c array<string>, m int, f int, d boolean, l boolean")
    assert row.select(content.case_preview(*[F.col(c) for c in "iarcmfdl"]).alias("x")).first().x == "案例ID: case_1 | 罪名: 盗窃 | 相关法条: 264 | 刑罚: 有期徒刑12个月"
    assert one(spark, content.article_preview(F.col("x"), F.lit(None).cast("string"), F.lit(0)), x="264") == "第264条"
    assert one(spark, content.article_preview(F.lit(None).cast("string"), F.lit(""), F.lit(0)), x="1") == "法律条文"


def test_filters(spark):
    rows = spark.createDataFrame([(1, 1, 0.9, "x" * 30), (1, 2, 0.8, None), (1, 3, 0.7, " short ")], "qid long, doc_id long, score double, content string")
    assert [r.doc_id for r in content.long_enough(rows).collect()] == [1]
    assert content.adaptive_length_filter(rows, 1, 1).count() == 2


# evaluation


def test_known_metric_values(spark):
    run = spark.createDataFrame([(1, d, i + 1, 0.8) for i, d in enumerate((101, 102, 103, 104, 105))], "qid long, doc_id long, rank int, score double")
    truth = spark.createDataFrame([(1, d, 1.0) for d in (102, 106, 107)], "qid long, doc_id long, gain double")
    hit = {r.k: r.hit for r in evaluate.at_cuts(run, truth, (1, 3, 5)).collect()}
    assert hit == {1: 0, 3: 1, 5: 1}
    ap = evaluate.average_precision(run, truth).first()
    assert ap.rr == 0.5 and ap.ap == pytest.approx(0.5 / 3)
    run = spark.createDataFrame([(1, d, i + 1, 0.8) for i, d in enumerate((264, 266, 234, 269, 150))], "qid long, doc_id long, rank int, score double")
    truth = spark.createDataFrame([(1, d, 1.0) for d in (264, 269)], "qid long, doc_id long, gain double")
    assert {r.k: r.hit for r in evaluate.at_cuts(run, truth, (1, 3, 5)).collect()} == {1: 1, 3: 1, 5: 1}
    assert evaluate.average_precision(run, truth).first().rr == 1.0


def test_ground_truth_inversion(spark):
    cases = spark.createDataFrame([("case_001", [264, 269]), ("case_002", [234, 235]), ("case_003", [266])], "case_id string, articles array<int>")
    got = {}
    for r in evaluate.ground_truth(cases).collect():
        got.setdefault(r.article, []).append(r.case_id)
    assert got[264] == ["case_001"] and len(got[266]) == 1


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 9)), min_size=1, max_size=15, unique=True), st.lists(st.tuples(st.integers(0, 2), st.integers(0, 9)), min_size=1, max_size=10, unique=True))
def test_metrics_are_in_range_and_recall_grows(spark, retrieved, relevant):
    ranks, rows = {}, []
    for q, d in retrieved:
        ranks[q] = ranks.get(q, 0) + 1
        rows.append((q, d, ranks[q], 0.5))
    run = spark.createDataFrame(rows, "qid long, doc_id long, rank int, score double")
    truth = spark.createDataFrame([(q, d, 1.0) for q, d in relevant], "qid long, doc_id long, gain double")
    got = evaluate.at_cuts(run, truth).collect()
    assert all(0 <= v <= 1 for r in got for v in (r.precision, r.recall, r.f1, r.hit))
    for q in ranks:
        recalls = [r.recall for r in sorted(got, key=lambda r: r.k) if r.qid == q]
        assert recalls == sorted(recalls)
    assert all(0 <= r.ndcg <= 1 + 1e-9 for r in evaluate.ndcg(run, truth).collect())


# audits, sources, streams


def test_vector_audit(spark):
    rows = [("a", [1.0, float("nan")]), ("a", [0.0, 0.0]), ("a", [float("inf"), 1.0]), ("a", [1.0])]
    got = quality.vector_validity(spark.createDataFrame(rows, "k string, vector array<float>"), 2, "k").first()
    assert (got.vectors, got.wrong_length, got.nan_count, got.inf_count, got.zero_vectors) == (4, 1, 1, 1, 1)


def test_reconciliation_and_status(spark):
    a = spark.createDataFrame([(1,), (2,), (2,)], "doc_id long")
    b = spark.createDataFrame([(2,), (3,)], "doc_id long")
    got = quality.reconcile(a, b, "doc_id").first()
    assert (got.common, got.only_left, got.only_right) == (1, 1, 1)
    for checks, want in (((1, 0, 0, 0), "critical"), ((0, 0, 1, 0), "warning"), ((0, 0, 0, 0), "healthy")):
        assert quality.status(spark.createDataFrame([checks], "count_mismatch int, id_mismatch int, empty int, zero int")).first().status == want


def test_sources(spark, tmp_path):
    lines = tmp_path / "cases.json"
    lines.write_text('{"fact": "f", "meta": {"accusation": ["盗窃"], "relevant_articles": [264]}}\n\nbroken\n', encoding="utf-8")
    got = tables.json_cases(spark, str(lines)).where("fact IS NOT NULL").collect()
    assert len(got) == 1 and got[0].accusations == ["盗窃"] and got[0].relevant_articles == [264]
    words = tmp_path / "words.txt"
    words.write_text("# note\n 盗窃 \n\n诈骗\n", encoding="utf-8")
    assert sorted(r.word for r in tables.words(spark, str(words)).collect()) == ["盗窃", "诈骗"]
    assert tables.words(spark, str(words), comments=False).count() == 3
    law = tmp_path / "law.md"
    law.write_text("# 刑法\n\n第1条 一。\n\n## 第2条 二。\n", encoding="utf-8")
    assert [(r.number, r.body) for r in tables.statute_articles(spark, str(law)).orderBy("number").collect()] == [(1, "一。"), (2, "二。")]
    old = spark.createDataFrame([("第12条", "text body", None)], "id string, body string, title string")
    row = tables.normal_articles(old).first()
    assert (row.article_number, row.content, row.title) == (12, "text body", "第12条")
    cases = spark.createDataFrame([("case_1", "a, b,", "12, x, 13")], "case_id string, accusations string, relevant_articles string")
    row = tables.normal_cases(cases).first()
    assert row.accusations == ["a", "b"] and row.relevant_articles == [12, 13]


def test_graph_store(spark, tmp_path):
    edges = spark.createDataFrame([("盗窃", 264, 3), ("诈骗", 266, 2)], "crime string, article int, case_count long")
    path = str(tmp_path / "graph")
    assert tables.graph_info(spark, path) == {}
    assert tables.save_graph(edges, path) and not tables.save_graph(edges, path) and tables.save_graph(edges, path, force=True)
    assert tables.load_graph(spark, path).count() == 2 and tables.info(spark, path)["bytes"] > 100 and tables.info(spark, path + "-none") == {}
    assert tables.graph_info(spark, path)["occurrences"] == 5
    tables.export_graph(edges, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).columns == ["Crime", "Article", "CaseCount", "Type"]
    tables.export_graph(edges, str(tmp_path / "json"), "json")
    assert spark.read.json(str(tmp_path / "json")).count() == 2
    tables.save_graph(edges.limit(0), str(tmp_path / "empty"))
    with pytest.raises(ValueError):
        tables.load_graph(spark, str(tmp_path / "empty"))


def test_graph_store_is_never_half_written(spark, tmp_path):
    path = str(tmp_path / "graph")
    old = spark.createDataFrame([("盗窃", 264, 3), ("诈骗", 266, 2)], "crime string, article int, case_count long")
    tables.save_graph(old, path)
    reader = tables.load_graph(spark, path)
    swapped = spark.createDataFrame([("盗窃", 266, 3), ("诈骗", 264, 2)], "crime string, article int, case_count long")
    assert graph.fingerprint(old).first()[0] == graph.fingerprint(swapped).first()[0]  # equal totals
    broken = swapped.withColumn("crime", F.when(F.col("article") == 264, F.raise_error(F.lit("half-way")).cast("string")).otherwise(F.col("crime")))
    with pytest.raises(Exception, match="half-way"):
        tables.save_graph(broken, path)
    assert {r.article: r.crime for r in tables.load_graph(spark, path).collect()} == {264: "盗窃", 266: "诈骗"}
    assert tables.save_graph(swapped, path)  # a changed edge is noticed
    assert {r.article: r.crime for r in tables.load_graph(spark, path).collect()} == {264: "诈骗", 266: "盗窃"}
    assert reader.count() == 2  # who has begun to read the old version goes on


def test_reports_leave_nothing_out_unsaid(spark, tmp_path):
    rows = spark.range(2500).select(F.col("id"), (F.col("id") / 8).alias("share"), F.lit(None).cast("string").alias("note"))
    short = tables.text_report(rows, "Title", 3).split("\n")
    assert short == ["Title", "=====", "0 | 0.0000 | ", "1 | 0.1250 | ", "2 | 0.2500 | ", "... and 2497 more"]
    assert len(tables.text_report(rows.limit(3), "Title", 3).split("\n")) == 5
    tables.save_text_report(rows, "Title", str(tmp_path / "report"))
    lines = [line for part in sorted((tmp_path / "report").glob("part-*")) for line in part.read_text().split("\n") if line]
    assert lines[0] == "Title" and len(lines) == 2502 and lines[2:] == [f"{i} | {i / 8:.4f} | " for i in range(2500)]


def test_vector_package(spark, tmp_path):
    rows = spark.createDataFrame([(1, "A", [3.0, 4.0]), (2, "B", [0.0, 1.0])], "doc_id long, doc_type string, vector array<float>")
    got = {r.doc_type: r.norm_mean for r in tables.save_vectors(rows, str(tmp_path / "vectors")).collect()}
    assert got == pytest.approx({"A": 5.0, "B": 1.0})
    plan = spark.read.parquet(str(tmp_path / "vectors")).where("doc_type = 'A'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(doc_type" in plan


def test_encoder_has_a_row_per_text(spark):
    rows = spark.createDataFrame([("a text",), (None,), ("",)], "t string")
    got = [r.v for r in rows.select(encode.encoder(encode.hashing_encoder(16), F.col("t")).alias("v")).collect()]
    assert len(got[0]) == 16 and got[1] is None and got[2] == [0.0] * 16


def test_streams_equal_batches(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = trace.read_stream(spark, str(tmp_path / "in"), events)
    trace.to_table(trace.tumbling(stream), str(tmp_path / "tumbled"), str(tmp_path / "c0")).awaitTermination()
    own = lambda df: sorted(tuple(map(str, r)) for r in df.withColumn("avg_value", F.round("avg_value", 6)).collect())
    assert own(trace.read_table(spark, str(tmp_path / "tumbled"))) == own(trace.tumbling(events))
    seen = []
    trace.to_batches(trace.without_repeats(stream), lambda df, n: seen.append(df.count()), str(tmp_path / "c1")).awaitTermination()
    assert sum(seen) == events.count() and len(seen) == 3


def test_repeats_go_and_late_rows_are_counted(spark, tmp_path):
    rows = [[(k, f"2024-01-01 {k:02d}:00:00") for k in range(20)] + [(3, "2024-01-01 03:00:00")], [(40, "2024-01-02 00:00:00")], [*((k, "2024-01-01 01:30:00") for k in (1, 30, 31)), (40, "2024-01-02 00:00:00")]]
    for n, part in enumerate(rows):
        spark.createDataFrame(part, "event_id long, ts string").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    like = spark.read.parquet(str(tmp_path / "in"))
    stream = trace.read_stream(spark, str(tmp_path / "in"), like)

    def run(late, checkpoint):
        out = []
        query = trace.to_batches(trace.without_repeats(stream, late), lambda df, n: out.extend(r.event_id for r in df.collect()), str(tmp_path / checkpoint))
        query.awaitTermination()
        return sorted(out), trace.late_rows(query)

    every = sorted({k for part in rows for k, _ in part})
    assert run(None, "c0") == (every, 0)
    got, late = run("2 hours", "c1")
    assert got == sorted(set(every) - {30, 31}) and late == 3  # ids 1, 30 and 31 come too late


def test_long_texts_are_indexed_in_near_linear_time(spark):
    docs = spark.createDataFrame([(1, " ".join(f"w{k % 9000}" for k in range(60_000)))], "doc_id long, text string")
    began = time.monotonic()
    assert keyword.term_weights(keyword.term_counts(docs)).count() == 9000
    assert entity.contained(docs, spark.createDataFrame([("w8999 w0",)], "word string")).count() == 1
    assert time.monotonic() - began < 30


def test_contained_equals_plain_search(spark):
    texts = ["", None, "abcabd", "xabc", "ab", "äbcd abc", "b" * 5_000 + "abc"]
    words = ["abc", "abd", "b", "bb", "cd a", "zzz", "äbcd"]
    queries = spark.createDataFrame(list(enumerate(texts)), "qid int, text string")
    for some in (words, ["abc", "abcab"], []):
        got = sorted((r.qid, r.word) for r in entity.contained(queries, spark.createDataFrame([(w,) for w in some], "word string")).collect())
        assert got == sorted((q, w) for q, t in enumerate(texts) for w in some if t and w in t)


def test_content_predicates_and_order(spark):
    articles = spark.createDataFrame([(7, "one", "", "full"), (8, "two", None, None)], "article_number int, chapter string, content string, full_text string")
    assert [r.content for r in content.by_number(articles, 7).collect()] == ["full"]
    assert [r.content for r in content.by_number(articles, 8).collect()] == [""] and content.by_number(articles, 9).count() == 0
    assert [r.article_number for r in content.by_chapter(articles, "tw").collect()] == [8]
    own = spark.createDataFrame([("c1", ["theft"], [264]), ("c2", None, None)], "case_id string, accusations array<string>, relevant_articles array<int>")
    assert [r.case_id for r in content.by_accusation(own, "theft").collect()] == ["c1"] == [r.case_id for r in content.by_cited_article(own, 264).collect()]
    said = spark.createDataFrame([("article", 1, "a"), ("crime", 2, "b"), ("crime", 1, "c")], "type string, priority int, text string")
    assert [r.text for r in content.ordered_suggestions(said).collect()] == ["c", "b", "a"]


def test_content_of_several_spellings_is_the_first(spark):
    docs = spark.createDataFrame([("case_2", "later"), ("CASE_002", " first ")], "doc_id string, text string").repartition(2)
    results = spark.createDataFrame([("case_case_2",), (None,)], "doc_id string")
    assert sorted(str(r.content) for r in content.join_content(results, docs).collect()) == ["None", "first"]


def test_adaptive_length_filter_keeps_queries_without_id(spark):
    rows = [(q, i, 0.5, "x" * 30) for q, n in ((None, 2), (1, 9)) for i in range(n)]
    df = spark.createDataFrame(rows, "qid int, doc_id int, score double, content string")
    kept = content.adaptive_length_filter(df, 20, 2).collect()
    assert sorted((str(r.qid), r.doc_id) for r in kept) == [("1", 0), ("1", 1), ("1", 2), ("1", 3), ("None", 0), ("None", 1)]
    assert content.adaptive_length_filter(df.where("1 = 0"), 20, 2).count() == 0


def test_generated_answers(spark):
    long = "根据刑法的规定处罚。" * 40
    texts = [(0, "答： \"根据法律规定应当承担相应的刑事责任和处罚\" 以上仅供参考。"), (1, "短"), (2, None), (3, long), (4, "法" * 301), (5, "您好，根据法律规定应当承担相应的刑事责任。")]
    got = {r.i: r.a for r in spark.createDataFrame(texts, "i int, t string").select("i", entity.clean_answer(F.col("t")).alias("a")).collect()}
    assert got == {0: "根据法律规定应当承担相应的刑事责任和处罚", 1: "", 2: "", 3: long[:300], 4: "法" * 300 + "...", 5: "，根据法律规定应当承担相应的刑事责任。"}
    judged = spark.createDataFrame([("根据法律规定应当承担相应的责任。",), ("根据法律规定怎么办呢，咋办吧，这是啥意思。",), ("x" * 20,), (None,)], "t string")
    assert [r.g for r in judged.coalesce(1).select(entity.good_answer(F.col("t")).alias("g")).collect()] == [True, False, False, False]
    asked = spark.createDataFrame([(1, "q"), (2, None)], "qid int, text string")
    law = spark.createDataFrame([(1, i, f"t{i}" if i < 3 else None) for i in range(1, 6)], "qid int, rank int, title string")
    found = {r.qid: r.answer for r in entity.fallback_answer(asked, law, law.select("qid", "rank").limit(0)).collect()}
    assert "找到5条相关法条：\n1. t1\n2. t2\n3. 第3条\n\n【建议】" in found[1] and "相关法条】" not in found[2] and "''" in found[2]


def test_query_sets_and_graph_report_are_stored(spark, tmp_path):
    rows = spark.createDataFrame([("crime", "1", "theft"), ("mixed", "2", "text")], "query_type string, query_id string, query_text string")
    assert sorted(map(tuple, tables.save_queries(rows, str(tmp_path / "q")).select(*rows.columns).collect())) == [("crime", "1", "theft"), ("mixed", "2", "text")]
    edges = spark.createDataFrame([("theft", 264)], "crime string, article int")
    assert tuple(tables.graph_report(edges).first()) == (1, "case_count", False)
    assert tuple(tables.graph_report(edges.withColumn("case_count", F.lit(2)).limit(0)).first()) == (0, "", False)


def test_containment_both_ways_joins_equal_values(spark):
    names = ["盗", "盗窃", "入户盗窃", "诈骗", "合同诈骗", "Brand#1", "Brand#12", "x", "", "长" * 50]
    others = ["盗窃", "窃", "诈骗案", "Brand#12", "Brand", "长" * 30, "", "none"]
    left = spark.createDataFrame([(n,) for n in names], "crime string")
    right = spark.createDataFrame([(n,) for n in others] * 2, "accusation string")
    near = entity.near_names(left, right)
    assert {tuple(r) for r in near.collect()} == {(a, b) for a in names for b in others if a and b and (a in b or b in a)}
    cases = spark.createDataFrame([(i, [others[i % 8], "other"], [i % 3, 7]) for i in range(40)] + [(99, None, [7]), (98, ["盗窃"], None)], "case_id long, accusations array<string>, relevant_articles array<int>")
    pairs = spark.createDataFrame([(c, a) for c in names for a in (0, 7)] * 2, "crime string, article int")
    got = graph.cases_of_relations(cases, pairs, near, 3)
    want = {}
    for c in names:
        for a in (0, 7):
            hits = [i for i in range(40) if a in (i % 3, 7) and c and any(x and (c in x or x in c) for x in (others[i % 8], "other"))]
            want.update({(c, a, i): n for n, i in enumerate(hits[:3], 1)})
    assert {(r.crime, r.article, r.case_id): r.place for r in got.collect()} == want
    asked = spark.createDataFrame([(1, "盗窃"), (2, "天气")], "qid long, text string")
    edges = spark.createDataFrame([("入户盗窃", 264, 1)], "crime string, article int, case_count long")
    for df in (got, entity.detect_crimes(asked, edges)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_one_wrong_field_leaves_the_others(spark):
    payloads = [
        '{"is_criminal_law": true, "confidence": "0.8", "identified_crimes": [{"crime_name": "盗窃", "relevance": 1}, {"relevance": 2}, 5, null], "bm25_keywords": ["车", {"keyword": "夜", "weight": 0.4}, {"weight": 1}]}',
        '{"is_criminal_law": {"x": 1}, "confidence": 0.3, "identified_crimes": "盗窃", "hyde_answer": [1], "query2doc_generated": null}',
        '{"confidence": 1', "", None, "[1]", "{}",
    ]
    rows = spark.createDataFrame(list(enumerate(payloads)), "id long, p string").select("id", entity.read_classification(F.col("p")).alias("a"))
    got = {r.id: r.a for r in rows.collect()}
    assert (got[0].is_criminal_law, got[0].confidence, got[0].errors) == (True, 0.8, [])
    assert [tuple(c) for c in got[0].identified_crimes] == [("盗窃", 1.0)] and [tuple(k) for k in got[0].bm25_keywords] == [("车", 1.0), ("夜", 0.4)]
    assert (got[1].is_criminal_law, got[1].confidence, got[1].query2doc_generated) == (False, 0.3, "")
    assert set(got[1].errors) >= {"is_criminal_law", "identified_crimes"} and got[1].identified_crimes == []
    assert all(got[i].errors == ["payload"] and got[i].confidence == 0.5 for i in (2, 3, 4, 5)) and got[6].errors == []


def test_projections_have_the_fields_of_their_kind(spark):
    rows = spark.createDataFrame([("article_264", "article", "盗窃", "文", 264, None, None, None, 0.95, 1), ("article_x", "article", None, None, None, None, None, None, 0.1, 2), ("case_1", "case", None, "事实", None, ["张某"], ["盗窃"], 130, 0.7, 3), ("case_2", "case", None, None, None, None, ["盗窃"], None, None, 4)], "id string, type string, title string, content string, article_number int, criminals array<string>, accusations array<string>, imprisonment_months int, similarity double, rank int")
    got = {r.id: r for r in content.result_projection(rows).collect()}
    assert [got[i].title for i in ("article_264", "article_x", "case_1", "case_2")] == ["第264条 盗窃", "法条 article_x", "张某盗窃案", "案例 case_2"]
    assert (got["case_1"].is_severe_case, got["case_2"].is_severe_case, got["article_264"].is_severe_case) == (True, False, None)
    assert got["article_264"].confidence_level == "very_high" and got["article_264"].accusations is None and got["case_1"].article_number is None
    texts = {r.id: r.searchable_text for r in content.document_projection(rows).collect()}
    assert texts == {"article_264": "盗窃 文", "article_x": "", "case_1": "事实 张某 盗窃", "case_2": "盗窃"}
    raw = {r.id: r for r in content.raw_projection(spark.createDataFrame([("article_12", 0.5), ("case_3", None), ("other", 0.2)], "id string, fusion_score double")).collect()}
    assert (raw["article_12"].title, raw["article_12"].law_name, raw["article_12"].similarity, raw["article_12"].case_id) == ("第12条", "刑法", 0.5, None)
    assert (raw["case_3"].case_id, raw["case_3"].accusations, raw["case_3"].similarity, raw["other"].type, raw["other"].title) == ("case_3", [], 0.0, "unknown", "other")


def test_reasoning_names_what_a_search_goes_by(spark):
    asked = spark.createDataFrame([(1,), (2,), (3,)], "qid long")
    found = spark.createDataFrame([(1, "盗窃", None), (1, None, 266), (2, "无关", None)], "qid long, crime string, article long")
    edges = spark.createDataFrame([("盗窃", 264, 9), ("盗窃", 269, 4), ("诈骗", 266, 5)], "crime string, article long, case_count long")
    got = {r.qid: r for r in graph.reasoning(asked, found, graph.related_articles(edges, 3), graph.related_crimes(edges, 3)).collect()}
    assert got[1].steps == ["检测到罪名'盗窃'，将扩展搜索相关法条: 第264条, 第269条", "检测到法条'266'，将扩展搜索相关罪名: 诈骗罪"] and got[1].strategies == list(graph.STRATEGIES[:2]) and len(got[1].enhancements) == 3
    assert got[2].strategies == got[3].strategies == ["standard_search"] and got[3].enhancements == []


def test_cases_of_a_frequent_accusation_stay_apart(spark, monkeypatch):
    """Few names make no exchange by name, however many cases have them; more names are joined; both find the same."""
    cases = spark.range(0, 400, 1, 4).select(F.col("id").alias("case_id"), F.array(F.lit("theft"), F.concat(F.lit("x"), F.col("id") % 3)).alias("accusations"), F.array(F.col("id") % 5, F.lit(9)).cast("array<int>").alias("relevant_articles"))
    pairs = spark.createDataFrame([("the", 9), ("the", 2), ("x1", 9), ("none", 9)], "crime string, article int")
    near = spark.createDataFrame([("the", "theft"), ("the", "x1"), ("x1", "x1"), ("none", None)], "crime string, accusation string")
    want = {("the", 9, n): n + 1 for n in range(4)} | {("the", 2, 5 * n + 2): n + 1 for n in range(4)} | {("x1", 9, 3 * n + 1): n + 1 for n in range(4)}
    few = graph.cases_of_relations(cases, pairs, near, 4)
    assert "accusation#" not in "".join(x for x in few._jdf.queryExecution().executedPlan().toString().splitlines() if "hashpartitioning" in x or "Join" in x)
    assert {(r.crime, r.article, r.case_id): r.place for r in few.collect()} == want
    assert graph.cases_of_relations(cases, pairs, near.limit(0), 4).count() == 0
    monkeypatch.setattr(graph, "NEAR_ROWS", 0)
    assert {(r.crime, r.article, r.case_id): r.place for r in graph.cases_of_relations(cases, pairs, near, 4).collect()} == want


@pytest.mark.parametrize("k", [1, 3])
def test_copies_are_searched_once_and_found_all_the_same(spark, k):
    """Equal texts are one document to the search and equal queries one query; results are those of all."""
    texts = ["red bolt", "blue bolt", "red ring", "old plate bolt", ""]
    docs = spark.createDataFrame([(n, "A" if n % 7 < 4 else "B", texts[(n * n) % 5]) for n in range(40)], "doc_id long, doc_type string, text string").repartition(3)
    asked = spark.createDataFrame([(1, "red bolt"), (2, "bolt"), (3, "red bolt"), (4, None), (5, "ring ring"), (6, None)], "qid long, text string")
    seen, counts = [], keyword.term_counts(docs)

    def by_words(few, own):
        seen.append((few.count(), own.count()))
        return keyword.search(few, own, k, counts=counts)

    shape = lambda df: {(r.qid, r.doc_id, round(r.score, 9), r["rank"]) for r in df.collect()}
    alike = ranking.copies(docs, k, "text")
    assert shape(ranking.of_copies(alike, asked, k, by_words)) == shape(keyword.search(docs.select("doc_id", "text"), asked, k))
    assert seen == [(docs.select("text").distinct().count(), 4)]

    profile = lambda df, *kept: df.select(*kept, encode.letter_profile(F.col("text")).alias("vector"))
    near = lambda few, own: vector.search(profile(few, "doc_id", "doc_type"), profile(own, "qid"), k, by_type=True)
    typed = ranking.copies(docs, k, "text", "doc_type")
    assert shape(ranking.of_copies(typed, asked, k, near, "doc_type")) == shape(near(docs, asked))

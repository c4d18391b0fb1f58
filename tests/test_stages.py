"""Stages of a search: generators that fail, paths that fail, chains of searches."""

import pytest
from pyspark.sql import functions as F

from quillmark.operators import generate, stages

RUN = "qid long, doc_id long, doc_type string, score double, text string"


class Flaky:
    """A model that times out or fails a number of times before it answers."""

    def __init__(self, times, problem):
        self.left, self.problem = times, problem

    def __call__(self, prompts):
        if self.left:
            self.left -= 1
            raise self.problem
        return [p.upper() for p in prompts]


def test_a_client_retries_timeouts_only_a_bounded_number_of_times():
    twice = generate.Client([generate.Model("flaky", Flaky(2, TimeoutError("slow")))], retries=2)
    assert twice.ask(["a", "b"]) == [("A", "flaky", 3, None), ("B", "flaky", 3, None)]
    thrice = generate.Client([generate.Model("flaky", Flaky(3, TimeoutError("slow"))), generate.Model("sure", lambda ps: [p + "!" for p in ps])], retries=2)
    assert thrice.ask(["a"]) == [("a!", "sure", 4, None)]
    assert thrice.failed == {"flaky"} and thrice.ask(["b"]) == [("b!", "sure", 1, None)]  # it is not called again


def test_a_client_goes_on_to_the_next_model():
    calls = []

    def some(prompts):
        calls.append(list(prompts))
        return [p if len(p) > 1 else None for p in prompts]

    client = generate.Client([generate.Model("broken", Flaky(9, ValueError("no"))), generate.Model("some", some), generate.Model("short", lambda ps: ps[:-1]), generate.Model("never", lambda ps: [""] * len(ps))])
    assert client.ask(["xy", "z", "ab"]) == [("xy", "some", 2, None), (None, None, 4, "never: no answer"), ("ab", "some", 2, None)]
    assert client.failed == {"broken", "short"} and calls == [["xy", "z", "ab"]]
    assert generate.Client([]).ask(["a"]) == [(None, None, 0, "no model")]


def test_generate_keeps_rows_and_columns(spark):
    rows = [(1, "abc", "own"), (2, None, "own"), (3, "", "own"), (4, "x", "own"), (4, "x", "own")]
    df = spark.createDataFrame(rows, "qid long, model string, calls string")
    out = generate.generate(df, F.col("model"), [generate.Model("long", lambda ps: [p * 2 if len(p) > 2 else None for p in ps])], together=2)
    assert out.columns == ["qid", "model", "calls", "generated", "model", "calls", "error"]
    got = sorted(map(tuple, out.toDF("qid", "text", "own", "made", "by", "calls", "error").collect()), key=str)
    assert got == sorted([(1, "abc", "own", "abcabc", "long", 1, None), (2, None, "own", None, None, 0, None), (3, "", "own", None, None, 0, None)] + [(4, "x", "own", None, None, 1, "long: no answer")] * 2, key=str)
    assert generate.generate(df.limit(0), F.col("model"), []).count() == 0


@pytest.fixture
def asked(spark):
    return spark.createDataFrame([(q, p, f"{p} {q}") for q in (1, 2, 3) for p in ("good", "late", "early", "chain", "unknown")], "qid long, path string, text string")


def found(queries, score=0.5):
    return queries.select("qid", (F.col("qid") * 10).alias("doc_id"), F.lit("A").alias("doc_type"), F.lit(score).alias("score"), "text")


def test_a_failing_path_leaves_the_others_as_they_are(spark, asked):
    def early(queries):
        raise RuntimeError("before any job\nwith details")

    def late(queries):  # fails inside a task, on one row, after others are done
        return found(queries).withColumn("score", F.when(F.col("qid") == 3, F.raise_error(F.lit("in a task")).cast("double")).otherwise(0.1))

    runs, trace = stages.fan_out(asked, {"good": [found], "late": [late], "early": [early], "chain": [early, late, lambda q: found(q, 0.9)]})
    assert sorted((r.path, r.qid, r.doc_id, r.score, r.text) for r in runs.collect()) == sorted([("good", q, 10 * q, 0.5, f"good {q}") for q in (1, 2, 3)] + [("chain", q, 10 * q, 0.9, f"chain {q}") for q in (1, 2, 3)])
    alone, _ = stages.fan_out(asked.where("path = 'good'"), {"good": [found]})
    assert sorted(map(str, alone.collect())) == sorted(map(str, runs.where("path = 'good'").collect()))
    told = {(r.path, r.attempt): r for r in trace.collect()}
    assert {k: (r.state, r.queries, r.hits, r.best) for k, r in told.items()} == {
        ("good", 0): ("success", 3, 3, 0.5), ("late", 0): ("error", 3, 0, None), ("early", 0): ("error", 3, 0, None), ("unknown", 0): ("error", 3, 0, None),
        ("chain", 0): ("error", 3, 0, None), ("chain", 1): ("error", 3, 0, None), ("chain", 2): ("fallback", 3, 3, 0.9),
    }
    assert told["early", 0].error == "RuntimeError: before any job" and told["unknown", 0].error == "no search for this path" and all(r.ms >= 0 for r in told.values())
    well = {r.qid: (r.paths, r.answered, r.degraded) for r in stages.health(trace, asked).collect()}
    assert well == {q: (5, 2, False) for q in (1, 2, 3)}
    assert stages.health(trace.where("path <> 'chain'"), asked).first().degraded


def test_a_chain_ends_with_the_plainest_search_or_with_an_error(spark):
    queries = spark.createDataFrame([(1, "x")], "qid long, text string")

    def fails(_):
        raise TimeoutError("gone")

    run, trace = stages.in_order(spark, queries, [("hybrid", fails), ("mixed", found)])
    assert run.first().doc_id == 10 and [(r.search, r.state) for r in trace.orderBy("attempt").collect()] == [("hybrid", "error"), ("mixed", "fallback")]
    run, trace = stages.in_order(spark, queries, [("hybrid", fails), ("mixed", fails)])
    assert run is None and trace.count() == 2
    record = trace.select(stages.error_record(F.col("error")).alias("r")).first().r
    assert (record.success, record.total, record.error) == (False, 0, "TimeoutError: gone")


def test_stages_on_literal_queries(spark):
    own = spark.createDataFrame([(1, "盗窃 车"), (2, "天气"), (3, None), (4, "第264条")], "qid long, text string")
    crimes = spark.createDataFrame([(1, "盗窃", 264)], "qid long, crime_name string, article_number long")
    cited = spark.createDataFrame([(4, 264)], "qid long, article long")
    words = spark.createDataFrame([(1, "车", 2), (1, "盗窃", 1)], "qid long, keyword string, place int")
    told = stages.extracted(own, crimes, cited, words)
    rows = {r.qid: r for r in told.collect()}
    assert {q: r.criminal for q, r in rows.items()} == {1: True, 2: False, 3: False, 4: True} and rows[1].keywords == ["盗窃", "车"] and rows[3].text == ""
    assert rows[1].enhanced.startswith("盗窃 车 [SEP] 根据《中华人民共和国刑法》") and "第264条" in rows[1].answer
    paths = {}
    for r in stages.routed(told).collect():
        paths.setdefault(r.qid, {})[r.path] = r.text
    assert set(paths) == {1, 4} and list(paths[1]) == ["knowledge_graph", "query2doc", "hyde", "bm25_hybrid", "basic_semantic"] and set(paths[4]) == {"query2doc", "hyde", "basic_semantic"}
    assert paths[1]["bm25_hybrid"] == "盗窃 车 盗窃 车"
    empty = spark.createDataFrame([], RUN + ", path string")
    out = {r.qid: r for r in stages.concluded(told, empty, stages.fused(empty), spark.createDataFrame([], "doc_id long, title string")).collect()}
    assert out[2].mode == "general_ai" and out[2].answer == "这是一个通用问题：天气。建议咨询相关专业人士获取准确信息。" and out[1].mode == "criminal_law" and out[1].confidence == pytest.approx(0.3)

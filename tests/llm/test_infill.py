import hashlib
import re

import pyarrow as pa
from pyspark.sql import functions as F

from quillmark.llm import infill


def brute(key, text, salt="1"):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"{salt}:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    x, y = sorted(v % (len(units) + 1) for v in h[:2])
    prefix, middle, suffix = ("".join(u) for u in (units[:x], units[x:y], units[y:]))
    if not text or any(m in text for m in infill.MARKS) or h[2] % 100 >= 90:
        return len(units), "plain", None, None, text
    if h[3] % 100 < 20:
        return len(units), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return len(units), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


ODD = ["", None, "a", "é", "日本語 text", "<P> there", "x<S>", "<M>", "<", "<<P", "P>", "a<P", "S>b<", "\n\t ", "🙂🙂ab🙂", "AbC dEf", "ab\x00cd", "[z]`{A@", "ﬁ", "<Q>", "<P", "M><"]


def check(spark, rows):
    docs = spark.createDataFrame([(k, t, "own", i) for i, (k, t) in enumerate(rows)], "doc_id long, text string, output string, n int")
    made = infill.fill_in_middle(docs, keep=["output", "n", F.col("text").alias("form")])
    assert made.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "output", "n", "form"]
    plain = made.toDF("doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "own", "at", "text")
    got = {r.at: r for r in infill.restore(plain).collect()}
    assert len(got) == len(rows)
    for i, (k, t) in enumerate(rows):
        r = got[i]
        assert (r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == (k, *brute(k, t)), (k, t)
        assert (r.restored, r.own, r.text) == (t or "", "own", t)


def test_examples_equal_brute_force_and_are_undone(spark, prose):
    rows = [(k, t) for k in range(40) for t in (ODD if k < 12 else [prose(prose.rng.randrange(60))])]
    check(spark, [*rows, (None, "no id at all"), (7, "twice"), (7, "twice"), (3, "long é " * 200_000), (-5, "x" * 300_000)])


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert infill.restore(infill.fill_in_middle(docs)).collect() == []


def test_kernel_on_sliced_buffers():
    whole = pa.array(["skipped", "ab1", "", "", "cd é", ""])
    data, offsets = infill.buffers(whole[1:])
    starts, first = infill.boundaries(data, offsets)
    assert bytes(data) == "ab1cd é".encode() and offsets.tolist() == [0, 3, 3, 3, 8, 8]
    assert starts.tolist() == [True, False, True, True, False, True, True, False] and first.sum() == 7


def test_draws_follow_the_id_only(spark):
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("some words, all alike in each row").alias("text"))
    one = {r.doc_id: r.output for r in infill.fill_in_middle(docs).collect()}
    assert one == {r.doc_id: r.output for r in infill.fill_in_middle(docs.repartition(5)).collect()}
    other = {r.doc_id: r.output for r in infill.fill_in_middle(docs, salt="2").collect()}
    assert sum(one[k] != other[k] for k in one) > 1000
    share = infill.fill_in_middle(docs).groupBy("form").count().collect()
    n = {r.form: r["count"] for r in share}
    assert 150 < n["plain"] < 250 and 0.15 < n["spm"] / (n["spm"] + n["psm"]) < 0.25

import re
import time

import numpy as np
import pyarrow as pa
import pytest

from quillmark.llm import passages

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, window):
    docs = [(k, WORD.findall(t or "")) for k, t in rows]
    first = {}
    for k, w in docs:
        for i in range(len(w) - window + 1) if k is not None else ():
            x = tuple(w[i : i + window])
            first[x] = min(first.get(x, k), k)
    out = []
    for k, w in docs:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1) if k is not None else ():
            if first[tuple(w[i : i + window])] < k:
                gone[i : i + window] = [True] * window
        out.append((k, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return sorted(out, key=str)


def check(spark, rows, window):
    docs = spark.createDataFrame([(k, t, "own", 7) for k, t in rows], "doc_id long, text string, h string, n_words int").repartition(3)
    got = passages.remove_repeats(docs, window=window, keep=["h", "n_words"])
    assert got.columns == ["doc_id", "n_words", "n_removed", "kept_text", "h", "n_words"]
    have = got.toDF("doc_id", "n", "gone", "kept", "h", "seven").collect()
    assert all((r.h, r.seven) == ("own", 7) for r in have)
    assert sorted(((r.doc_id, r.n, r.gone, r.kept) for r in have), key=str) == brute(rows, window)
    return sum(r.gone for r in have)


@pytest.mark.parametrize(("window", "shard", "size"), [(50, 30_000, 2_000_000), (7, 40, 300), (4, 200, 5_000)])
def test_removal_equals_brute_force(spark, prose, monkeypatch, window, shard, size):
    monkeypatch.setattr(passages, "SHARD_WORDS", shard)
    monkeypatch.setattr(passages, "PART_BYTES", size)
    rng = prose.rng
    common = [prose(n) for n in (window - 1, window, window + 1, 3 * window, 200)]
    rows = []
    for k in range(60):
        parts = [prose(rng.randrange(40)), rng.choice(common), prose(rng.randrange(30)), rng.choice(common)[rng.randrange(9) :]]
        rows.append((k, rng.choice([" ", "\n", "\t\x0b  "]).join(rng.sample(parts, rng.randrange(1, 5)))))
    long = prose(3000)
    rows += [(100, long), (101, long), (102, long[500:9000]), (99, long + " more"), (103, long.replace("river", "brook", 4))]
    rows += [(104, common[3] + " " + common[3]), (105, "a " * 500), (106, "a " * 300), (107, "b a " * 200), (108, None), (109, ""), (110, " \n "), (None, long), (None, long)]
    rows += [(111, long[:3000]), (111, long[:3000]), (111, long[3000:6000]), (-3, long[4000:5000]), (112, long.replace(" ", " ", 5)), (113, long.upper())]
    assert check(spark, rows, window) > 0


def test_hot_passage_and_empty_tables(spark, prose):
    line = prose(60)
    rows = [(k, f"{prose(8)} {line} {prose(8)}") for k in range(300)]
    assert check(spark, rows, 50) >= 60 * 299
    assert check(spark, [(1, prose(80)), (2, None)], 50) == 0
    assert passages.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_one_word_over_and_over_takes_linear_time(spark):
    took = []
    for n in (20_000, 80_000):
        shard = passages.Shard(np.array([1]), pa.array(["a " * n]), 50)
        begin = time.perf_counter()
        assert shard.repeats(2, shard.number(pa.array(["a"] * n))) == [(0, n)]
        assert shard.repeats(1, shard.number(pa.array(["a"] * n))) == []
        took.append(time.perf_counter() - begin)
    assert took[1] < 16 * took[0] + 1


def test_sliding_least_and_rolling_hashes():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 2**63, 200).astype(np.uint64)
    for size in (1, 2, 5, 31, 200):
        assert passages.sliding_least(x, size).tolist() == [x[i : i + size].min() for i in range(200 - size + 1)]
    both = passages.Rolling(np.concatenate([x, x]), passages.BASES[0])
    a = np.arange(0, 150)
    assert (both.of(a, a + 50) == both.of(a + 200, a + 250)).all() and len(np.unique(both.of(a, a + 50))) == 150

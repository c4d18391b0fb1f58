import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillmark.llm import minhash
from quillmark.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, n):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else {tuple(words)} if words else set()


def brute_force(rows, n, percent):
    sets = {i: shingles(t, n) for i, t in rows}
    top = {i: i for i in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            common = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                x, y = sorted((find(a), find(b)))
                top[y] = x
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def corpus():
    rng = random.Random(2)
    words = [f"w{k}" for k in range(400)] + ["Ä", "A", "a"]
    passage = [rng.choice(words) for _ in range(25)]
    out, n = [], 0
    for group in range(25):
        base = [rng.choice(words) for _ in range(rng.choice((3, 7, 40, 120, 300)))]
        for _ in range(rng.choice((1, 2, 5, 25))):
            own = list(base)
            for _ in range(rng.randrange(0, max(1, len(base) // 12))):
                own[rng.randrange(len(own))] = rng.choice(words)
            if group % 3 == 0:
                own = passage + own
            out.append((n, " ".join(own)))
            n += 1
    return [*out, (n, ""), (n + 1, None), (n + 2, " \n\t"), (n + 3, "One two"), (n + 4, "one\x0btwo"), (n + 5, "one two"), (n + 6, "solo")]


@pytest.mark.parametrize(("words", "percent"), [(3, 85), (5, 80)])
def test_equals_brute_force(spark, words, percent):
    rows = corpus()
    docs = spark.createDataFrame([(*r, "x", 1.5) for r in rows], "doc_id long, text string, kept string, bands double")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_dedup(docs, words=words, percent=percent).collect()}
    assert got == brute_force(rows, words, percent)


def test_strays_of_a_bucket_are_compared(spark):
    """A chain in which only neighbours are similar, next to many copies of its ends."""
    rng = random.Random(4)
    words = [f"c{k}" for k in range(5000)]
    chain = [[rng.choice(words) for _ in range(200)]]
    for _ in range(12):
        own = list(chain[-1])
        for _ in range(4):
            own[rng.randrange(200)] = rng.choice(words)
        chain.append(own)
    rows = [(100 - i, " ".join(c)) for i, c in enumerate(chain)] + [(200 + i, " ".join(chain[0]) + f" tail{i % 3}") for i in range(20)]
    got = {r.doc_id: r.component_id for r in minhash.near_dedup(spark.createDataFrame(rows, "doc_id long, text string"), words=3, percent=85).collect()}
    assert got == {i: v[1] for i, v in brute_force(rows, 3, 85).items()}


def test_null_ids_and_empty_tables(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (2, "A B C D E F"), (2, "other words are here now too")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in minhash.near_dedup(docs).collect()), key=str)
    assert got == [(1, 1, True), (2, 1, False), (2, 2, True), (None, None, True)]
    assert minhash.near_dedup(docs.limit(0)).count() == 0


def by_rows(rows, words, percent):
    """Brute force over rows, not ids: each row's smallest reachable id."""
    numbered = [(k, t) for k, (_, t) in enumerate(rows)]
    top = {k: v[1] for k, v in brute_force(numbered, words, percent).items()}
    least = {}
    for k, (i, _) in enumerate(rows):
        least[top[k]] = min(i, least.get(top[k], i))
    return sorted((i, least[top[k]], i == least[top[k]]) for k, (i, _) in enumerate(rows))


@pytest.mark.parametrize("seed", range(3))
def test_repeated_ids_keep_their_own_links(spark, seed):
    rng = random.Random(seed)
    texts = corpus()
    rows = [(2, texts[0][1]), (2, "z " * 50), (3, texts[0][1]), (4, "z " * 50)] if seed == 0 else [(rng.randrange(40), t) for _, t in texts if t and t.strip()]
    got = minhash.near_dedup(spark.createDataFrame(rows, "doc_id long, text string"), words=3, percent=85).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in got) == by_rows(rows, 3, 85)


def test_keep_one_of_each_component(spark):
    base = " ".join(f"w{k}" for k in range(60))
    near, other = base.replace("w59", "x"), " ".join(f"v{k}" for k in range(60))
    rows = [(2, base, "a"), (2, near, "b"), (2, other, "c"), (5, base, "d"), (None, other, "e"), (None, near, "f"), (None, "lone text", "g"), (7, None, "h"), (7, None, "h"), (None, "lone text", "g2")]
    kept = minhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string, id string")).collect()
    assert len(kept) == 5 and {r.id for r in kept} - {"a", "b", "g", "g2"} == {"c", "h"} and sum(r.id in "ab" for r in kept) == 1 and sum(r.id in ("g", "g2") for r in kept) == 1
    assert minhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string, id string").limit(0)).count() == 0


def test_sketches(spark):
    rng = np.random.default_rng(0)
    signer, n = minhash.Signer(), 400
    rows, truth = [], []
    for k, share in enumerate((0.95, 0.9, 0.85, 0.8, 0.7, 0.5)):
        both = int(2 * n * share / (1 + share))
        pool = rng.integers(0, 2**63, 2 * n, np.uint64)
        a, b = np.unique(pool[:n]), np.unique(np.concatenate([pool[:both], pool[n : 2 * n - both]]))
        _, _, sketch, parity = signer.sign([a, b])
        rows.append((k, n, *[x.tolist() for x in (sketch[0], parity[0], sketch[1], parity[1])]))
        truth.append(both / (2 * n - both))
        assert bin(int.from_bytes((parity[0] ^ parity[1]).tobytes(), "little")).count("1") <= 2 * (n - both)
    table = spark.createDataFrame(rows, "k int, n int, sx array<long>, px array<long>, sy array<long>, py array<long>")
    side = lambda s: minhash.sketched(table.select("k", "n", F.col(f"s{s}").alias("sketch"), F.col(f"p{s}").alias("parity")), s, "k")
    ones = sum(F.bit_count(F.col(f"x_sketch{i}").bitwiseXOR(F.col(f"y_sketch{i}"))) for i in range(8))
    got = side("x").join(side("y"), "k").orderBy("k").select(minhash.estimate(ones).alias("e"), minhash.plausible("x", "y", 85).alias("p")).collect()
    assert [r.e for r in got[:4]] == pytest.approx(truth[:4], abs=0.1)
    plausible = [r.p for r in got]
    assert all(plausible[:3]) and not any(plausible[4:])


def test_shingles_of_long_texts():
    text = " ".join(f"w{k}" for k in range(50_000))
    got = minhash.shingle_sets(pa.array([text, "", "x"]), 3)
    assert [len(s) for s in got] == [49_998, 0, 1]


def test_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(60)] + [(100, 100 + k) for k in range(1, 50)] + [(7, 7), (300, 299), (299, 300)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(61)} | {100 + k: 100 for k in range(50)} | {299: 299, 300: 299}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0

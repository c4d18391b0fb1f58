import numpy as np
import pytest

from quillmark.llm import embed


def test_hadamard_is_a_rotation():
    x = np.random.default_rng(0).normal(size=(5, 16))
    y = embed.hadamard(x)
    assert np.allclose(np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)) and np.allclose(embed.hadamard(y), x)


def test_buckets_are_the_same_whatever_the_batch():
    x = np.random.default_rng(1).normal(size=(50, 48))
    assert (embed.buckets(x) == np.concatenate([embed.buckets(x[:7]), embed.buckets(x[7:])])).all()


def test_recall_at_the_threshold():
    rng = np.random.default_rng(2)
    a = rng.normal(size=(2000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    g = rng.normal(size=a.shape)
    g -= (g * a).sum(1, keepdims=True) * a
    b = 0.98 * a + np.sqrt(1 - 0.98**2) * g / np.linalg.norm(g, axis=1, keepdims=True)
    x, y = embed.buckets(a), embed.buckets(b)
    shared = [len(set(p) & set(q)) > 0 for p, q in zip(x.tolist(), y.tolist(), strict=True)]
    assert np.mean(shared) > 0.999


def brute_force(rows, cosine=0.98):
    good = {}
    for k, (i, v, label) in enumerate(rows):
        if i is not None and label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good[k] = np.array(v, np.float64)
    link = {k: set() for k in range(len(rows))}
    for a in good:
        for b in good:
            if a < b and rows[a][2] == rows[b][2] and len(good[a]) == len(good[b]):
                if good[a] @ good[b] / np.linalg.norm(good[a]) / np.linalg.norm(good[b]) >= cosine:
                    link[a].add(b)
                    link[b].add(a)
    out = []
    for k, (i, _, _) in enumerate(rows):
        seen, todo = {k}, [k]
        while todo:
            new = link[todo.pop()] - seen
            seen |= new
            todo += new
        top = min((rows[x][0] for x in seen if rows[x][0] is not None), default=None)
        out.append((i, len(link[k]), top, i == top))
    return sorted(out, key=str)


def vectors():
    rng = np.random.default_rng(3)
    f = lambda v: np.float32(v).tolist()
    rows, n = [], 0
    for group in range(30):
        base = rng.normal(size=64)
        for _ in range(int(rng.choice([1, 2, 6, 40]))):
            v = base + rng.normal(size=64) * rng.choice([0, 0.05, 0.1, 0.14])
            rows.append((n, f(v), group % 3))
            n += 1
    rows += [(n + k, rows[0][1], rows[0][2]) for k in range(5)]
    n += 5
    odd = [None, [0.0] * 64, [float("nan")] + [1.0] * 63, [float("inf")] + [1.0] * 63, [None] + [1.0] * 63, [], [1.0] * 3, [1.0] * 3, [1.0] * 64, [2.0] * 64]
    rows += [(n + k, v, 0) for k, v in enumerate(odd)] + [(n + 50, [1.0] * 64, None), (n + 51, [1.0] * 64, 1), (None, [1.0] * 64, 0)]
    return rows


@pytest.mark.parametrize("block", [4, 1024])
def test_tables(spark, block, monkeypatch):
    monkeypatch.setattr(embed.cells, "__defaults__", (block,))
    rows = vectors()
    table = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, n_links string")
    got = sorted(((r.vec_id, r.n_links, r.component_id, bool(r.kept) and r.vec_id is not None) for r in embed.near_dedup(table).collect()), key=str)
    want = sorted(((i, n, top, kept and i is not None) for i, n, top, kept in brute_force(rows)), key=str)
    assert got == want
    assert embed.near_dedup(table.limit(0)).count() == 0


def test_repeated_ids_keep_their_own_links(spark):
    """Two rows of id 2 with other vectors, a near copy of each, and a pair of rows that repeat both."""
    x, y = [1.0] * 8 + [0.0] * 8, [0.0] * 8 + [1.0] * 8
    near = lambda v: [a + 0.01 * (k % 2) for k, a in enumerate(v)]
    rows = [(2, x, 0), (2, y, 0), (3, near(x), 0), (4, near(y), 0), (5, y, 1), (5, y, 1)]
    got = embed.near_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in got) == brute_force(rows) == [(2, 1, 2, True), (2, 1, 2, True), (3, 1, 2, False), (4, 1, 2, False), (5, 1, 5, True), (5, 1, 5, True)]

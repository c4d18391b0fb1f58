import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillmark.llm import common, toxicity

PLAIN = "you are a real idiot and a moron they said while the rest of us walk home to the green house by the river " * 30


@pytest.fixture(scope="module")
def cost():
    table = toxicity.symbol_table()
    s = np.array([table[ord(c)] for c in "  " + PLAIN])
    counts = np.zeros((toxicity.SYMBOLS,) * 3)
    np.add.at(counts, (s[:-2], s[1:-1], s[2:]), 1)
    return toxicity.language_model(counts)


@pytest.mark.parametrize(("seen", "plain"), [("1d10t", "idiot"), ("i.d.i.o.t", "idiot"), ("i d i o t", "idiot"), ("idiiiiiot", "idiot"), ("m0r0n", "moron"), ("m-o-r-o-n", "moron"), ("M0OOR0N", "moron"), ("h0use", "house")])
def test_disguises_are_undone(cost, seen, plain):
    assert toxicity.viterbi(seen, cost) == plain


def brute_force(seen, cost):
    """Enumerate all readings of a short piece."""
    best = (float("inf"), "")

    def go(k, a, b, last, spent, out):
        nonlocal best
        if k == len(seen):
            total = spent + float(cost[a, b, 0])
            if total < best[0] - 1e-9:
                best = (total, out)
            return
        c = seen[k]
        options = [(x, toxicity.ALIKE) for x in toxicity.LOOKALIKES.get(c, "")]
        options += [(c, toxicity.SELF)] if c.isalpha() else [(" ", toxicity.APART), ("", toxicity.INSIDE)] if c in toxicity.SEPARATORS else [(" ", toxicity.SIGN)]
        for x, price in options:
            if x == "":
                go(k + 1, a, b, last, spent + price, out)
            elif toxicity.symbol(x) == 0 and b == 0:
                go(k + 1, a, b, "", spent + price, out)
            else:
                s = toxicity.symbol(x)
                go(k + 1, b, s, x.strip(), spent + price + float(cost[a, b, s]), out + x)
        if last and last in [x for x, _ in options]:
            go(k + 1, a, b, last, spent + toxicity.AGAIN, out)

    go(0, 0, 0, "", 0.0, "")
    return best[1].strip()


@pytest.mark.parametrize("seen", ["1d1", "a b", "ttth", "m0r", "r.1", "@@a", "!l|", "5 5e"])
def test_viterbi_equals_brute_force(cost, seen):
    assert toxicity.viterbi(seen, cost) == brute_force(seen, cost)


def test_whole_texts_are_restored_and_others_left_alone(cost):
    restorer = toxicity.Restorer(cost)
    assert restorer.text("You are a m0r0n, and an i d i o t!") == "You are a moron, and an idiot!"
    assert restorer.text("Plain text, 42 times. a$$$ THE!!") == "Plain text, 42 times. a$$$ THE!!"
    found = restorer.words(pa.array(["A M0R0N, here", "", "an i d i o t"]))
    words = {(d, found.vocabulary[w].as_py()) for d, w in zip(found.document.tolist(), found.word.tolist(), strict=True)}
    assert {(0, "moron"), (0, "here"), (2, "idiot")} <= words


@pytest.mark.parametrize(("seen", "plain"), [("idi07", "idiot"), ("1d107", "idiot"), ("idio7", "idiot"), ("IDIO7.", "idiot."), ("id.iot", "idiot"), ("mo-ron", "moron"), ("hou53", "house"), ("idiot!!", "idiot!!"), ("moron$$$", "moron$$$"), ("m0r0n!", "moron")])
def test_signs_at_the_end_are_letters_or_punctuation(cost, seen, plain):
    restorer = toxicity.Restorer(cost)
    assert restorer.text(seen) == plain
    found = restorer.words(pa.array([seen]))
    assert {found.vocabulary[w].as_py() for w in found.word.tolist()} >= {plain.rstrip(toxicity.TRIM)}


def test_trigram_counts_see_every_text(spark):
    docs = spark.createDataFrame([("abc",), ("ABc ab",), (None,), ("",)], "text string")
    counts = toxicity.trigram_counts(docs)
    a, b, c = (toxicity.symbol(x) for x in "abc")
    assert counts[a, b, c] == 2 and counts[0, a, b] == 3 and counts[a, b, 0] == 1


def test_tables(spark):
    rng = np.random.default_rng(0)
    words = "river stone green house walk under light seven home".split()
    rows = []
    for i in range(300):
        own = [str(w) for w in rng.choice(words, 20)]
        bad = i % 5 == 0
        if bad:
            own[7] = ("idiot", "1d10t", "i d i o t", "idiooot")[i % 4]
        rows.append((i, " ".join(own), int(bad)))
    rows += [(1000, None, 1), (1001, "", 0), (None, "a river", None), (1002, "stone " * 30_000 + "idiot", None)]
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows], "doc_id long, text string, score string")
    labelled = spark.createDataFrame([(i, t, y) for i, t, y in rows if i is not None and zlib.crc32(str(i).encode()) % 5], "doc_id long, text string, toxic int")
    model = toxicity.fit(docs, labelled)
    got = {r.doc_id: r for r in toxicity.score(docs, model, ["doc_id", common.held_out(F.col("doc_id")).alias("held_out")]).collect()}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in got if i is not None) and not got[None].held_out
    held = [(got[i].predicted, y) for i, _, y in rows[:300] if got[i].held_out]
    assert sum(p == y for p, y in held) >= 0.97 * len(held)
    assert got[1000].predicted == got[1001].predicted == 0 and got[1002].predicted == 1
    one_class = toxicity.fit(docs, labelled.where("toxic = 0"))
    assert toxicity.score(docs, one_class, ["doc_id"]).where("predicted = 1").count() == 0
    empty = toxicity.fit(docs.limit(0), labelled.limit(0))
    assert toxicity.score(docs.limit(0), empty, ["doc_id"]).count() == 0

from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from quillmark.llm import common, langid

ENGLISH = "the house of the river and the green stone that we walk under with light "
GERMAN = "der fluss und das haus mit dem grünen stein über die straße nicht für uns "
FRENCH = "la maison de la rivière et une pierre verte où nous marchons avec la lumière "


def slow_ngrams(text, orders=3):
    words = "".join(c.lower() if c.isalpha() else " " for c in text).split()
    line = " " + " ".join(words) + " "
    return Counter(line[i : i + n] for n in range(1, orders + 1) for i in range(len(line) - n + 1) if n > 1 or line[i] != " ")


def test_ngrams_equal_a_plain_count():
    text = "Hello, wörld! 42 hello—ÄÖ"
    gram, n = langid.ngrams(langid.letters(text))
    got = Counter()
    for g, k in zip(gram.tolist(), n.tolist(), strict=True):
        for size in (1, 2, 3):
            codes = [(g >> (21 * j)) & (2**21 - 1) for j in range(size)][::-1]
            rest = g >> (21 * size)
            if rest == (1 if size < 3 else 0):
                got["".join(chr(c) if c else " " for c in codes)] += k
                break
    assert got == slow_ngrams(text)


def test_distance_equals_a_plain_sum():
    profiles = {k: langid.ranked(*langid.ngrams(langid.letters(t * 3)), 50) for k, t in (("de", GERMAN), ("en", ENGLISH))}
    own = langid.ranked(*langid.ngrams(langid.letters("the stein and the haus")), 50)
    got = langid.Profiles(profiles, 50).compare(own)
    for k, name in enumerate(("de", "en")):
        places = {g: i for i, g in enumerate(profiles[name].tolist())}
        assert got[k] == sum(abs(places[g] - i) if g in places else 50 for i, g in enumerate(own.tolist()))


def test_ranks_put_smaller_numbers_first_among_equals():
    gram, count = np.arange(5000, dtype=np.uint64), np.tile([3, 1, 3, 2, 1], 1000)
    got = langid.ranked(gram, count, 10)
    assert got.tolist() == sorted(range(5000), key=lambda g: (-count[g], g))[:10]


def test_tables(spark):
    rows = [(i, t, k) for i, (k, t) in enumerate([("en", ENGLISH), ("de", GERMAN), ("fr", FRENCH)] * 40)]
    rows += [(1000, None, "en"), (1001, "", "de"), (1002, "123 !?", None), (None, ENGLISH * 2000, None), (1003, GERMAN, "en")]
    docs = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, lang string, score string")
    fold = common.held_out(F.col("doc_id"))
    profiles = langid.fit(docs.where(~fold))
    got = langid.predict(docs, profiles, ["doc_id", fold.alias("held_out"), F.col("score").alias("lang")]).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.lang == "s" for r in got)
    found = {r.doc_id: r.lang_pred for r in got}
    assert all(found[i] == k for i, _, k in rows[:120])
    assert [found[i] for i in (1000, 1001, 1002, None, 1003)] == ["und", "und", "und", "en", "de"]
    nothing = langid.fit(docs.where("false"))
    assert {r.lang_pred for r in langid.predict(docs, nothing, ["doc_id"]).collect()} == {"und"}
    assert langid.predict(docs.limit(0), profiles, ["doc_id"]).count() == 0


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    fold = common.held_out(F.col("doc_id"))
    got = langid.predict(docs.where(fold), langid.fit(docs.where(~fold)), ["doc_id", "lang"])
    assert got.where("lang = lang_pred").count() >= 0.97 * got.count()

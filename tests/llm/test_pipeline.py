import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillmark.llm import common, queries

from oracle import connect, duck_rows, spark_rows

FOLDER = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    columns, rows = spark_rows(queries.queries()[name](spark, FOLDER))
    assert (columns, rows) == duck_rows(connect(FOLDER), queries.oracle_sql()[name])


def test_names():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 14))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "minhash_dedup", "pii", "packing"]


def test_stages(spark, prose):
    long = prose(60)
    near = " ".join(long.split()[:-1] + ["changed"])
    rows = [(1, long), (2, long.upper().lower()), (3, long), (4, near), (5, "123 456"), (6, None), (7, prose(40) + " mail a.b@c.de now"), (8, prose(30)), (None, prose(20)), (9, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.materialize(stage(spark, docs, ""), name)
        assert docs.columns == COLUMNS
        ids = {r.doc_id for r in docs.collect()}
        if name == "language_id":
            assert ids == {1, 2, 3, 4, 7, 8, None}
        elif name == "exact_dedup":
            assert ids == {2 if long.islower() else 3, 4, 7, 8, None} or ids >= {3, 4, 7, 8, None}
        elif name == "minhash_dedup":
            assert 4 not in ids and {7, 8, None} <= ids
        else:
            row = docs.where("doc_id = 7").first()
            assert "<email>" in row.text and "@" not in row.text and row.n_chars == len(row.text)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, "")
    assert packed.count() == docs.count()


def test_near_copies_keep_one_of_each_group(spark):
    """The minhash stage against brute force on whole sets."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    kept = {r.doc_id for r in corpus_pipeline.minhash_dedup(spark, docs, FOLDER).collect()}
    sets = {}
    for r in docs.collect():
        words = (r.text or "").lower().split()
        sets[r.doc_id] = {tuple(words[k : k + 5]) for k in range(len(words) - 4)} or ({tuple(words)} if words else set())
    ids = sorted(sets)
    alike = lambda a, b: sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    for k, a in enumerate(ids):
        before = [b for b in ids[:k] if alike(a, b)]
        assert (a in kept) or before
    assert not any(alike(a, b) for a in kept for b in kept if a < b)


def test_run_keeps_every_piece(spark):
    packed = corpus_pipeline.run(spark, FOLDER)
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 4096").count() == 0
    assert packed.where("piece = 0").select("doc_id").distinct().count() > 150


def plain_run(spark, docs):
    """The pieces (doc_id, piece, start, length, ids_crc32) that the pipeline must come to, in plain Python but for the field."""
    import zlib

    import numpy as np
    import public_tokenizers
    import pyarrow as pa
    from tokenizers import Tokenizer

    from quillmark.llm import exact, pii

    lower = str.maketrans(exact.UPPER, exact.LOWER)
    rows = {r.doc_id: r.text for r in docs.collect() if r.text and any(c.isalpha() for c in r.text)}
    best = {}
    for i, t in rows.items():
        best[t.translate(lower)] = max(best.get(t.translate(lower), i), i)
    rows = {i: t for i, t in rows.items() if best[t.translate(lower)] == i}
    sets = {}
    for i, t in rows.items():
        words = [w for w in t.translate(lower).replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
        sets[i] = {tuple(words[k : k + 5]) for k in range(len(words) - 4)} or ({tuple(words)} if words else set())
    ids = sorted(rows)
    label = {i: i for i in ids}
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and label[a] != label[b]:
                low, high = sorted((label[a], label[b]))
                label = {i: low if x == high else x for i, x in label.items()}
    kept = docs.where(F.col("doc_id").isin([i for i in ids if label[i] == i]))
    field = pii.fit(kept)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tokenizer.no_truncation()
    tokenizer.no_padding()
    out = []
    for r in kept.collect():
        ((_, spans),) = pii.find(field, pa.array([r.text]))
        clean, at = "", 0
        for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
            clean, at = (clean + r.text[at:a] + f"<{kind}>" if a >= at else clean), max(at, b)
        own = [*tokenizer.encode(clean + r.text[at:], add_special_tokens=False).ids, 1]
        for piece, start in enumerate(range(0, len(own), 4096)):
            part = np.array(own[start : start + 4096], np.uint32)
            out.append((r.doc_id, piece, start, len(part), zlib.crc32(part.tobytes())))
    return sorted(out)


def test_run_comes_to_what_a_plain_run_comes_to(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    packed = corpus_pipeline.run(spark, FOLDER)
    assert sorted(tuple(r) for r in packed.select("doc_id", "piece", "start", "length", "ids_crc32").collect()) == plain_run(spark, docs)
    places = packed.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.sort_array(F.collect_list(F.struct("offset", "length"))).alias("own")).collect()
    for r in places:
        ends = [p.offset + p.length for p in r.own]
        assert r.n <= 4096 and [p.offset for p in r.own] == [0, *ends[:-1]]

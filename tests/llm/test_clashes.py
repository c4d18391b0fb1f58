"""Callers' columns that bear the names operators use inside come back unchanged."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillmark.llm import bpe, chat, embed, exact, infill, langid, lexical, minhash, packing, passages, pii, warc

INNER = """_length _prefix _full _slot _again _keep _size _a _b _id _best _rows _stays _text _hash _key _0 _1 c0 c1 c7 id h k n k1 k2 s
bands sketch parity component component_id first last size label language language_ language_score _language _score best main bucket
node gone own a b lo hi n_shingles form output block docs rank score q row piece start length salt sequence_id record_type""".split()


@pytest.fixture(scope="module")
def docs(spark):
    words = "the river runs under a stone bridge where seven green houses stand in light and no one walks".split()
    texts = [" ".join(words), " ".join(words).upper(), " ".join(words[:-1] + ["runs"]), "mail to a.b@c.de and write about the river", "twice said, twice said", "12 34", None]
    rows = [(i, t, "en", "s", len(t or ""), *[1000 * i + j for j in range(len(INNER))]) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` int" for c in INNER))


def unchanged(out, names=INNER):
    assert not set(names) - set(out.columns)
    rows = out.select("doc_id", *names).collect()
    assert rows and all(r[1 + j] == 1000 * r.doc_id + INNER.index(c) for r in rows for j, c in enumerate(names))
    return {r.doc_id for r in rows}


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES[:-1]])
def test_pipeline_stages(spark, docs, name):
    out = dict(corpus_pipeline.STAGES)[name](spark, docs, "")
    assert out.columns == docs.columns
    left = unchanged(out)
    assert left == {"language_id": {0, 1, 2, 3, 4}, "exact_dedup": {1, 2, 3, 4, 5, 6}, "minhash_dedup": {0, 3, 4, 5, 6} | ({2} & left), "pii": set(range(7))}[name]


def test_exact_dedup_gives_back_all_but_its_own_names(spark, docs):
    out = exact.exact_dedup(docs)
    assert out.columns == [c for c in docs.columns if c != "text"] + ["keep_id", "group_size", "kept"]
    assert unchanged(out) == set(range(7))


def test_examples_and_languages(spark, docs):
    free = [c for c in INNER if c not in ("n", "form", "output", "score", "lang_pred")]
    assert unchanged(infill.restore(infill.fill_in_middle(docs, keep=free)), free) == set(range(7))
    assert unchanged(passages.remove_repeats(docs, window=5, keep=INNER)) == set(range(7))
    assert unchanged(langid.predict(docs, langid.fit(docs), ["doc_id", *free]), free) == set(range(7))
    with pytest.raises(ValueError, match="bears a name"):
        langid.predict(docs, langid.fit(docs), ["doc_id", "score"])


def test_operators_that_give_columns_of_their_own(spark, docs):
    """The others ignore such columns: their results are those of the plain table."""
    import public_tokenizers

    tokens = public_tokenizers.path("word_bpe_49k.json")
    plain = docs.select("doc_id", "text")
    for run in (
        lambda d: minhash.near_dedup(d),
        lambda d: pii.spans_of(d, pii.train([])),
        lambda d: bpe.digests(d, bpe.prepare(spark, d, tokens)),
        lambda d: packing.pack_documents(d, tokens).select("doc_id", "piece", "length", "ids_crc32"),
        lambda d: lexical.search(lexical.build(d), d, 3, "doc_id"),
    ):
        assert sorted(map(str, run(docs).collect())) == sorted(map(str, run(plain).collect()))
    vectors = docs.select(F.col("doc_id").alias("vec_id"), F.array(F.lit(1.0), F.col("doc_id").cast("double")).alias("embedding"), F.lit(1).alias("label"), *[c for c in INNER if c != "label"])
    assert sorted(map(str, embed.near_dedup(vectors).collect())) == sorted(map(str, embed.near_dedup(vectors.select("vec_id", "embedding", "label")).collect()))
    pages = docs.select(F.col("doc_id").alias("page_id"), F.lit("http://x").alias("url"), F.col("text").alias("html"), *INNER)
    assert warc.read_archives(warc.write_archives(warc.plan_records(pages))).count() == 7
    said = docs.select(F.col("doc_id").alias("conv_id"), F.lit(0).cast("long").alias("turn"), F.lit("user").alias("role"), "text", *INNER)
    assert chat.digests(chat.expand(said)).count() == 7

import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillmark.llm import bpe, common

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def encoder(tmp_path_factory):
    file = tmp_path_factory.mktemp("bpe") / "model"
    file.write_bytes(bpe.compile_model(PATH, ["river", "rivers", "giver", "givers", "stone", "the", "über", "a"]))
    return bpe.Encoder(common.map_arrays(str(file)))


def test_automaton_shares_suffixes_and_numbers_entries():
    words = sorted(w.encode() for w in ("tap", "taps", "top", "tops", "stop", "stops"))
    a = bpe.minimal_automaton(words)
    assert len(a["final"]) == 7  # far fewer than the 13 states of a trie
    own = bpe.Encoder.__new__(bpe.Encoder)
    own.a = a
    asked = [*words, b"ta", b"tapsx", b"x"]
    start = np.cumsum([0, *map(len, asked)])[:-1]
    got = own._accept(np.frombuffer(b"".join(asked), np.uint8), start, np.array(list(map(len, asked))))
    assert got.tolist() == [0, 1, 2, 3, 4, 5, -1, -1, -1]
    with pytest.raises(ValueError):
        bpe.minimal_automaton([b"b", b"a"])


def texts():
    rng = random.Random(1)
    letters = [chr(rng.randrange(0x20, 0x3000)) for _ in range(300)] + list(" \t\n'stre<|>abcé́ΣİK\x1c\x1d  ") * 8
    letters += ["<|endoftext|>", "<|startoftext|>", "'s", "'ll"] * 5
    out = ["".join(rng.choice(letters) for _ in range(rng.randrange(0, 120))) for _ in range(1500)]
    return [*out, "", " ", "a" * 3000, "ab" * 300, "é" * 200, "The rivers' stone_giver", "".join(rng.choice("abcdeth") for _ in range(20_000))]


def test_ids_and_decoding_equal_the_library(encoder):
    own = texts()
    ids, offsets = encoder.encode(pa.array(own))
    decoded = encoder.decode(ids, offsets).to_pylist()
    for text, a, b, back in zip(own, offsets, offsets[1:], decoded, strict=False):
        want = LIBRARY.encode(text, add_special_tokens=False).ids
        assert ids[a:b].tolist() == want
        assert back == LIBRARY.decode(want, skip_special_tokens=False)


def test_forgetting_changes_nothing(encoder, monkeypatch):
    own = pa.array(texts()[:200])
    first = encoder.encode(own)
    monkeypatch.setattr(bpe, "MEMO_WORDS", 5)
    second = encoder.encode(own)
    assert all((x == y).all() for x, y in zip(first, second, strict=True))


def test_tables(spark, prose):
    rows = [(1, prose(50)), (2, None), (3, ""), (None, prose(3)), (1, prose(2)), (4, "x" * 200_000)]
    docs = spark.createDataFrame([(i, t, "n", 7) for i, t in rows], "doc_id long, text string, n_tokens string, lang int")
    model = bpe.prepare(spark, docs, PATH)
    got = {(r.doc_id, r.ids_sha256): (r.n_tokens, r.decoded_sha256) for r in bpe.digests(docs, model).collect()}
    assert len(got) == len(rows)
    for i, text in rows:
        ids = LIBRARY.encode(text or "", add_special_tokens=False).ids
        decoded = LIBRARY.decode(ids, skip_special_tokens=False)
        assert got[i, hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()] == (len(ids), hashlib.sha256(decoded.encode()).hexdigest())
    encoded = bpe.encode(docs, model)
    assert {r.text for r in bpe.decode(encoded, model).collect()} == {LIBRARY.decode(LIBRARY.encode(t or "", add_special_tokens=False).ids, skip_special_tokens=False) for _, t in rows}
    empty = docs.limit(0)
    assert bpe.digests(empty, bpe.prepare(spark, empty, PATH)).count() == 0


def test_words_of_all_documents_are_counted(spark, monkeypatch):
    """However many documents there are, and whatever a task holds at once, no document is left out of the counts."""
    monkeypatch.setattr(bpe, "COUNTED", 3)
    docs = spark.range(0, 25_000, 1, 4).select(F.col("id").alias("doc_id"), F.concat(F.lit("The river-bank, "), F.when(F.col("id") % 2 == 0, "Überfluß THE").otherwise(F.lit("x" * 41))).alias("text"))
    docs = docs.unionByName(spark.createDataFrame([(-1, None), (-2, ""), (-3, "needle7needle")], "doc_id long, text string"))
    assert {r.word: r.n for r in bpe.word_counts(docs).collect()} == {"the": 37_500, "river": 25_000, "bank": 25_000, "überfluß": 12_500, "needle": 2}
    assert sorted(bpe.frequent_words(docs, words=4)) == ["bank", "river", "the", "überfluß"]
    assert "needle" in bpe.frequent_words(docs)

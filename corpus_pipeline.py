"""The corpus pipeline: five of the training-data operators, one after the other, each stage written and read again.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept.  All but the last return the
columns of `documents`; the last returns the packed pieces.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.llm import exact, langid, minhash, packing, pii
from quillmark.llm.common import held_out, scratch, unused
from quillmark.llm.queries import TOKENIZER


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any language (no text or no letter) go."""
    profiles = langid.fit(docs.where(~held_out(F.col("doc_id"))))
    names = [unused(name, docs.columns) for name in ("language", "language_score")]
    told = langid.predict(docs, profiles, docs.columns, result=tuple(names))
    return told.where(F.col(names[0]) != langid.UNKNOWN).select(*docs.columns)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (null as empty) exactly one document stays, that with the largest id; a null id comes last."""
    return exact.keep_one(docs)


def minhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near copies (five words, similarity 0.8 or more, and what these connect) the document with the smallest id stays.

    A document with a null id goes if one with an id is near; documents that repeat an id are told apart by all columns.
    """
    return minhash.keep_one(docs, words=5, percent=80)


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; n_chars is the new length."""
    clean = pii.redact(docs, pii.fit(docs))
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces in sequences of at most 4096 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path(TOKENIZER))


STAGES = [("language_id", language_id), ("exact_dedup", exact_dedup), ("minhash_dedup", minhash_dedup), ("pii", redact_pii), ("packing", pack)]

#: SQL can't express the profiles, the field and the packing; the tests compare with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; of all that they write, only the result stays in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with scratch(spark) as result:
        for name, stage in STAGES:
            with scratch(spark) as keep:
                docs = keep(stage(spark, docs, sf_dir), name)
        return result(docs, "pipeline")

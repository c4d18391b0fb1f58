"""Language identification with rank-order profiles.

A profile is a language's most frequent n-grams (one to three characters, words joined by a single blank) in order; a
document's own profile is built alike from its whole text.  The distance is the sum over the document's n-grams of how
far out of place each is in the language's profile, with the profile's length for one that is not there; the nearest
language wins, the first by name among equals.

The score is 1 minus the distance to the winner as a part of the largest possible one.  A null text or one without a
letter is `und` with score 0, and so is every text if nothing could be learned.  Null languages teach nothing; a null id
is never held out.  Rows are independent of each other: repeated rows repeat, further columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: n-grams of a profile, longest n-gram, and the documents of a language that its profile is learned from (about so
#: many, chosen by a hash of id and text; all of a language that has fewer).
PROFILE, ORDERS, DOCUMENTS = 400, 3, 2_000
#: n-grams counted in a task before they are sent on.
HELD_GRAMS = 2_000_000
UNKNOWN = "und"


def _letters() -> np.ndarray:
    """For each code point its lower-case letter, or 0."""
    table = np.zeros(0x110000, np.uint32)
    for code in range(0x110000):
        c = chr(code)
        if c.isalpha():
            low = c.lower()
            table[code] = ord(low) if len(low) == 1 else code
    return table


_TABLE: list[np.ndarray] = []


def letters(text: str) -> np.ndarray:
    """The text's letters in lower case, words apart by one 0, with a 0 at both ends; empty without a letter."""
    if not _TABLE:
        _TABLE.append(_letters())
    code = _TABLE[0][np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)]
    letter = code != 0
    if not letter.any():
        return np.zeros(0, np.uint64)
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    code = code[keep]
    return np.concatenate([np.zeros(int(code[0] != 0), np.uint64), code.astype(np.uint64), np.zeros(int(code[-1] != 0), np.uint64)])


def ngrams(code: np.ndarray, orders: int = ORDERS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams as numbers (21 bits a character and a leading one) and their counts."""
    found = []
    for n in range(1, orders + 1):
        if len(code) < n:
            break
        gram = np.ones(len(code) - n + 1, np.uint64) if n < 3 else np.zeros(len(code) - n + 1, np.uint64)
        for k in range(n):
            gram = gram << np.uint64(21) | code[k : len(code) - n + 1 + k]
        if n == 1:
            gram = gram[code != 0]
        found.append(gram)
    return np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def ranked(gram: np.ndarray, count: np.ndarray, size: int = PROFILE) -> np.ndarray:
    """The most frequent n-grams in order, smaller numbers first among equals."""
    if len(gram) > 4 * size:  # only counts that can be among the first
        least = np.partition(count, len(count) - size)[len(count) - size]
        some = count >= least
        gram, count = gram[some], count[some]
    return gram[np.lexsort((gram, -count))[:size]]


class Profiles:
    """The languages' profiles as one sorted table, to compare a document with all at once."""

    def __init__(self, profiles: dict[str, np.ndarray], size: int = PROFILE):
        self.names, self.size = sorted(profiles), size
        known = [profiles[n] for n in self.names]
        self.grams = np.unique(np.concatenate(known)) if known else np.zeros(0, np.uint64)
        self.place = np.full((len(self.grams) + 1, max(1, len(known))), -1, np.int64)
        for k, own in enumerate(known):
            self.place[np.searchsorted(self.grams, own), k] = np.arange(len(own))

    def compare(self, own: np.ndarray) -> np.ndarray:
        """Out-of-place distances of a document's ranked n-grams to each language."""
        at = np.minimum(np.searchsorted(self.grams, own), len(self.grams) - 1)
        at = np.where(self.grams[at] == own, at, len(self.grams))
        place = self.place[at]
        return np.where(place >= 0, np.abs(place - np.arange(len(own))[:, None]), self.size).sum(0)

    def predict(self, text: str | None) -> tuple[str, float]:
        code = letters(text) if text else np.zeros(0, np.uint64)
        if not len(code) or not self.names:
            return UNKNOWN, 0.0
        own = ranked(*ngrams(code), self.size)
        distance = self.compare(own)
        best = int(distance.argmin())
        return self.names[best], float(1 - distance[best] / (self.size * len(own)))


def fit(train: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", documents: int = DOCUMENTS, size: int = PROFILE) -> Profiles:
    """Learn a profile for every language from (text, lang); only profiles reach the driver, `size` numbers for each language."""
    labelled = train.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.xxhash64(key, text).alias("_hash"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    parts = 1 << 30
    counts = labelled.groupBy("lang").agg(F.count("*").alias("n"))
    shares = common.materialize(counts.select("lang", F.least(F.lit(parts), (F.lit(parts) * (documents / F.col("n"))).cast("long")).alias("share")), "languages")
    sample = labelled.join(shares, "lang").where(F.pmod("_hash", F.lit(parts)) < F.col("share")).select("text", "lang")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, Counter] = {}
        held = 0

        def told() -> Iterator[pa.RecordBatch]:
            for k, own in total.items():
                yield pa.RecordBatch.from_arrays([pa.array([k] * len(own), pa.string()), pa.array(list(own), pa.int64()), pa.array(list(own.values()), pa.int64())], ["lang", "gram", "n"])
            total.clear()

        for batch in batches:
            for part in common.slices(batch, "text"):
                for t, k in zip(part.column(0), part.column(1).to_pylist(), strict=True):
                    gram, n = ngrams(letters(t.as_py()))
                    total.setdefault(k, Counter()).update(dict(zip(gram.tolist(), n.tolist(), strict=True)))
                    held += len(gram)
                if held > HELD_GRAMS:
                    yield from told()
                    held = 0
        yield from told()

    common.bounded_batches(train.sparkSession)
    grams = sample.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = grams.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("rank") <= size)
    found: dict[str, list[tuple[int, int]]] = {}
    for r in best.select("lang", "gram", "rank").collect():
        found.setdefault(r.lang, []).append((r.rank, r.gram))
    return Profiles({k: np.array([gram for _, gram in sorted(own)], np.int64).astype(np.uint64) for k, own in found.items()}, size)


def predict(df: DataFrame, profiles: Profiles, keep: list[str | Column], text: str = "text", result: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The columns `keep` of `df` with the predicted language and its score, whose names none of the kept columns may bear."""
    kept = df.select(*keep).columns
    if {c.lower() for c in kept} & {c.lower() for c in result}:
        raise ValueError(f"a kept column bears a name of the result: {result}")
    own = [f"_{i}" for i in range(len(kept))]
    inner = df.select(*[F.col(c) if isinstance(c, str) else c for c in keep], F.col(text).alias("_text")).toDF(*own, "_text")
    types = dict(inner.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch, "_text"):
                got = [profiles.predict(t.as_py()) for t in part.column("_text")]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in own), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], [*own, "_lang", "_score"])

    common.bounded_batches(df.sparkSession)
    out = inner.mapInArrow(run, ", ".join(f"`{c}` {types[c]}" for c in own) + ", _lang string, _score double")
    return out.toDF(*kept, *result)

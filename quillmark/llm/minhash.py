"""MinHash near-dedup whose banded candidates are sifted with odd sketches and confirmed on full shingle sets.

A document's set holds the 64-bit hashes of its distinct shingles of some words (words are runs without blanks, A-Z in
lower case; a shorter document is one shingle; one without words has an empty set and no links).  Documents with equal
sets are one class; classes are compared.  The MinHash samples of a class make its band keys and, folded into a parity
bitmap, its odd sketch: the XOR of two sketches holds about as many ones as the samples differ.  A second odd sketch is
of the set itself: its XOR never holds more ones than the sets differ by, so that it refutes pairs without error.

No bucket is expanded into all its pairs.  First each member is compared with its bucket's smallest and largest id; the
links found this way are contracted to components.  Then, in buckets that still hold several components, the members
outside of the largest one are compared with all members of other components, so that no pair of a bucket that could
join two components stays unseen.

Null texts count as empty.  Rows with a null id take no part (component null, kept).  Classes have numbers of their own, so
rows with equal ids and other texts are compared each by its own text and take the smallest id of what that text reaches.
Further columns are ignored unless they are asked for; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .common import materialize
from .components import components

#: 40 bands of 6: a pair of similarity 0.85 shares no band with probability 6e-9, one of 0.8 with 5e-6.
BANDS, ROWS, SKETCH_BITS, SET_BITS = 40, 6, 512, 1024
#: Candidates are given up if the sketch's estimate is lower than the threshold by this (five deviations of the estimate).
SLACK = 0.14
#: Ids of candidates that are broadcast at most (8 bytes each).
BROADCAST_ROWS = 500_000
SEED = 20240229
#: What names a set: its size and two sums of hashes.
SAME = ["n", "k1", "k2"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: pa.Array, words: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    offsets, flat = common.split_words(pc.ascii_lower(texts), ascii_only=True)
    full = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    ends = np.concatenate([[0], np.cumsum(full)])[offsets]
    coded = flat.filter(pa.array(full)).dictionary_encode()
    own = mix(pd.util.hash_array(coded.dictionary.to_numpy(zero_copy_only=False).astype(object), categorize=False)) if len(coded.dictionary) else np.zeros(0, np.uint64)
    hashed = own[coded.indices.to_numpy(zero_copy_only=False)] if len(coded) else own
    multiplier = np.uint64(0x9E3779B97F4A7C15)

    def joined(parts: list[np.ndarray], n: int) -> np.ndarray:
        total = np.full(len(parts[0]), n, np.uint64)
        for part in parts:
            total = (total + part) * multiplier
            total ^= total >> np.uint64(29)
        return mix(total)

    every = joined([hashed[k : len(hashed) - words + 1 + k] for k in range(words)], words) if len(hashed) >= words else np.zeros(0, np.uint64)
    out = []
    for a, b in zip(ends.tolist(), ends[1:].tolist(), strict=False):
        if b - a >= words:
            out.append(np.unique(every[a : b - words + 1]))
        elif b > a:
            out.append(joined([hashed[k : k + 1] for k in range(a, b)], b - a))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


class Signer:
    """MinHash samples, band keys and odd sketches of shingle sets."""

    def __init__(self, bands: int = BANDS, rows: int = ROWS, bits: int = SKETCH_BITS):
        rng = np.random.default_rng(SEED)
        self.bands, self.rows, self.bits = bands, rows, bits
        self.scale = rng.integers(0, 2**63, bands * rows, np.uint64) * np.uint64(2) + np.uint64(1)
        self.shift = rng.integers(0, 2**63, bands * rows, np.uint64)

    def samples(self, shingles: np.ndarray) -> np.ndarray:
        least = np.full(len(self.scale), 2**64 - 1, np.uint64)
        for k in range(0, len(shingles), 2048):
            hashed = shingles[k : k + 2048, None] * self.scale
            hashed += self.shift
            np.minimum(least, hashed.min(0), out=least)
        return least

    def keys(self, sets: list[np.ndarray]) -> np.ndarray:
        """Two numbers that name each set."""
        out = np.zeros((len(sets), 2), np.uint64)
        for i, own in enumerate(sets):
            if len(own):
                out[i] = mix(own).sum(dtype=np.uint64), np.bitwise_xor.reduce(mix(own ^ np.uint64(SEED)))
        return out.view(np.int64)

    def sign(self, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(keys of two numbers per set, band keys, sketches of the samples and of the set), as signed numbers."""
        n = len(sets)
        drawn = np.zeros((n, len(self.scale)), np.uint64)
        whole = np.zeros((n, SET_BITS), np.uint8)
        for i, own in enumerate(sets):
            if len(own):
                drawn[i] = self.samples(own)
                whole[i] = np.bincount((own >> np.uint64(40)).astype(np.int64) % SET_BITS, minlength=SET_BITS) & 1
        bands = np.tile(np.arange(1, self.bands + 1, dtype=np.uint64), (n, 1))
        for r in range(self.rows):
            bands = mix(bands * np.uint64(0x9E3779B97F4A7C15) + drawn[:, r :: self.rows])
        places = mix(drawn + np.arange(len(self.scale), dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) % np.uint64(self.bits)
        flips = np.bincount((places + np.arange(n, dtype=np.uint64)[:, None] * np.uint64(self.bits)).ravel().astype(np.int64), minlength=n * self.bits).reshape(n, self.bits) & 1
        sketch = np.packbits(flips.astype(np.uint8), axis=1).view(np.int64)
        return self.keys(sets), bands.view(np.int64), sketch, np.packbits(whole, axis=1).view(np.int64)


def lists(matrix: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(matrix) + 1) * matrix.shape[1], pa.int32()), pa.array(matrix.ravel()))


def signatures(df: DataFrame, key: str, text: str, words: int, keep: list[str]) -> DataFrame:
    """(id, n, k1, k2, bands, sketch, parity, *keep) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer()
        for batch in batches:
            for part in common.slices(batch, "text"):
                sets = shingle_sets(common.texts_of(part), words)
                keys, bands, sketch, parity = signer.sign(sets)
                own = [part.column("id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys[:, 0]), pa.array(keys[:, 1]), lists(bands), lists(sketch), lists(parity)]
                yield pa.RecordBatch.from_arrays([*own, *(part.column(c) for c in keep)], ["id", "n", "k1", "k2", "bands", "sketch", "parity", *keep])

    common.bounded_batches(df.sparkSession)
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"), *keep)
    more = "".join(f", `{c}` {t}" for c, t in df.select(*keep).dtypes)
    return rows.mapInArrow(run, "id long, n long, k1 long, k2 long, bands array<long>, sketch array<long>, parity array<long>" + more)


def sketched(df: DataFrame, side: str, *others: str) -> DataFrame:
    """Size and sketches as plain columns named by `side`, which generated code compares."""
    words = [F.get(c, F.lit(i)).alias(f"{side}_{c}{i}") for c, bits in (("sketch", SKETCH_BITS), ("parity", SET_BITS)) for i in range(bits // 64)]
    return df.select(*others, F.col("n").alias(f"{side}_n"), *words)


def estimate(ones: Column, samples: int = BANDS * ROWS, bits: int = SKETCH_BITS) -> Column:
    """The similarity that the ones in the XOR of two odd sketches suggest; 0 where they are as many as chance makes them."""
    return F.when(2 * ones >= bits, 0.0).otherwise(F.lit(1.0) + F.log(1 - 2 * ones / F.lit(float(bits))) * (bits / (4 * samples)))


def plausible(x: str, y: str, percent: int) -> Column:
    """Whether sizes and sketches of two sides leave open that the sets are similar enough."""
    ones = lambda c, bits: sum((F.bit_count(F.col(f"{x}_{c}{i}").bitwiseXOR(F.col(f"{y}_{c}{i}"))) for i in range(bits // 64)), F.lit(0))
    n, m = F.col(f"{x}_n"), F.col(f"{y}_n")
    sizes = 100 * F.least(n, m) >= percent * F.greatest(n, m)
    parity = (100 + percent) * ones("parity", SET_BITS) <= (100 - percent) * (n + m)
    return sizes & parity & (estimate(ones("sketch", SKETCH_BITS)) >= percent / 100 - SLACK)


def sets_of(df: DataFrame, wanted: DataFrame, key: str, text: str, words: int) -> DataFrame:
    """(id, shingles) of the classes in `wanted`, read again from the rows with a class's smallest document id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer()
        for batch in batches:
            for part in common.slices(batch, "text"):
                sets = shingle_sets(common.texts_of(part), words)
                ends, keys = np.cumsum([0, *map(len, sets)]), signer.keys(sets)
                own = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(sets).view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(np.diff(ends), pa.int64()), pa.array(keys[:, 0]), pa.array(keys[:, 1]), own], ["n", "k1", "k2", "shingles"])

    hint = F.broadcast if wanted.count() <= BROADCAST_ROWS else lambda x: x
    rows = df.select(F.col(key).cast("long").alias("first"), F.col(text).alias("text"))
    some = rows.join(hint(wanted.select("first").distinct()), "first", "left_semi").select("text")
    read = some.mapInArrow(run, "n long, k1 long, k2 long, shingles array<long>")
    return read.join(hint(wanted.select("id", *SAME)), SAME).select("id", "shingles").dropDuplicates(["id"])  # the same set in all rows of a class


def confirm(near: DataFrame, classes: DataFrame, df: DataFrame, key: str, text: str, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose full sets are similar enough."""
    ids = near.select(F.col("a").alias("id")).union(near.select(F.col("b").alias("id"))).distinct()
    wanted = materialize(classes.select("id", "first", *SAME).join(ids, "id", "left_semi"), "candidates")
    sets = materialize(sets_of(df, wanted, key, text, words), "sets")
    have = lambda side: sets.select(F.col("id").alias(side), F.col("shingles").alias(f"s{side}"))
    both = near.join(have("a"), "a").join(have("b"), "b").withColumn("common", F.size(F.array_intersect("sa", "sb")))
    similar = 100 * F.col("common") >= percent * (F.size("sa") + F.size("sb") - F.col("common"))
    return materialize(both.where(similar).select("a", "b"), "links")


def ordered(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def links(classes: DataFrame, df: DataFrame, key: str, text: str, words: int, percent: int) -> DataFrame:
    """(node, label) of all classes that are linked with another."""
    buckets = classes.select("id", F.explode("bands").alias("bucket"))
    ends = materialize(buckets.groupBy("bucket").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi"), "buckets")
    members = materialize(buckets.join(ends, "bucket"), "members")
    stars = members.select(*ordered("id", "lo")).union(members.select(*ordered("id", "hi"))).where("a < b").distinct()
    of = lambda side: sketched(classes, side, F.col("id").alias(side))
    stars = materialize(stars.join(of("a"), "a").join(of("b"), "b").where(plausible("a", "b", percent)).select("a", "b"), "stars")
    found = confirm(stars, classes, df, key, text, words, percent)
    labels = components(found)
    known = materialize(members.select("bucket", "id").join(labels.withColumnRenamed("node", "id"), "id", "left").select("bucket", "id", F.coalesce("label", "id").alias("label")), "labelled")
    sizes = known.groupBy("bucket", "label").agg(F.count("*").alias("n"))
    mixed = materialize(sizes.groupBy("bucket").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.count("*").alias("parts")).where("parts > 1").select("bucket", "main"), "mixed")
    others = materialize(known.join(mixed, "bucket").join(classes.select("id", "n", "sketch", "parity"), "id"), "others")
    strays = sketched(others.where("label <> main"), "x", "bucket", F.col("id").alias("x"), F.col("label").alias("lx"))
    crossed = sketched(others, "y", "bucket", "id", "label").join(strays, "bucket").where((F.col("label") != F.col("lx")) & plausible("x", "y", percent))
    crossed = crossed.select(*ordered("id", "x")).distinct().join(stars, ["a", "b"], "left_anti")
    crossed = materialize(crossed, "crossed")
    if crossed.isEmpty():
        return labels
    more = confirm(crossed, classes, df, key, text, words, percent)
    return labels if more.isEmpty() else components(found.union(more))


def grouped(df: DataFrame, key: str, text: str, words: int, percent: int, keep: list[str] = ()) -> DataFrame:
    """(id, n, component, component_id, *keep) of every row: a number that the rows of a component share (null where no other
    row is known to be in it) and their smallest id.
    """
    signed = materialize(signatures(df, key, text, words, list(keep)), "signatures")
    alike = signed.where("n > 0 AND id IS NOT NULL").groupBy(*SAME)
    sides = [F.first(c).alias(c) for c in ("bands", "sketch", "parity")]  # the same in all rows of a class
    classes = alike.agg(F.min("id").alias("first"), F.count("*").alias("size"), *sides).withColumn("id", F.monotonically_increasing_id())
    classes = materialize(classes, "classes")  # from here on the numbers are fixed
    labels = links(classes, df, key, text, words, percent)
    named = classes.select("id", *SAME, "first", "size").join(labels.withColumnRenamed("node", "id"), "id", "left")
    known = materialize(named.where("size > 1 OR label IS NOT NULL").select(*SAME, "first", F.coalesce("label", "id").alias("component")), "known")
    tops = known.groupBy("component").agg(F.min("first").alias("top"))
    known = materialize(known.join(tops, "component").select(*SAME, "component", "top"), "named")
    rows = signed.select("id", *SAME, *keep).join(known, SAME, "left")
    mine = F.col("id").isNotNull()
    return rows.select("id", "n", F.when(mine, F.col("component")).alias("component"), F.when(mine, F.coalesce("top", "id")).alias("component_id"), *keep)


def near_dedup(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """(key, n_shingles, component_id, kept): one row per row of `df`; the smallest id of a component is kept."""
    out = grouped(df, key, text, words, percent)
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_one(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """`df` without the rows of a component that are not its first by (id, hash of all columns); null ids come last.

    Rows that repeat in all columns have one name: all of them stay or go.  All columns come back as they were, whatever their names.
    """
    names = df.columns
    df, (key, text) = common.numbered(df, key, text)
    columns = df.columns
    name = {"_a": F.xxhash64(*columns), "_b": F.xxhash64(F.lit(1), *columns)}
    last = F.lit(2**63 - 1) - F.pmod(F.col("_a"), F.lit(1 << 40))  # no document id is as large
    rows = df.withColumns(name).withColumn("_id", F.coalesce(F.col(key).cast("long"), last))
    members = materialize(grouped(rows, "_id", text, words, percent, ["_a", "_b"]).where("component IS NOT NULL").select("id", "component", "_a", "_b"), "members")
    best = members.groupBy("component").agg(F.min(F.struct("id", "_a", "_b")).alias("best"))
    gone = materialize(members.join(best, "component").where((F.col("_a") != F.col("best._a")) | (F.col("_b") != F.col("best._b"))).select("_a", "_b").distinct(), "gone")
    hint = F.broadcast if gone.count() <= BROADCAST_ROWS else lambda x: x
    return df.withColumns(name).join(hint(gone), ["_a", "_b"], "left_anti").select(*columns).toDF(*names)

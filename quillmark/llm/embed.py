"""Embedding near-dedup with cross-polytope hashing after fast Hadamard rotations.

Valid vectors (a label, every component finite, not all zero) that are equal are one class with a multiplicity.  A class is
turned by random signs and Walsh-Hadamard transforms, three times over; the axis nearest to it and its direction are a
hash.  Some of these side by side name a bucket; each table has the nearest bucket and, as further probes, those with one
hash's second nearest axis.

Members of a bucket are dealt into blocks of bounded size, and every two blocks meet in one cell, where cosines are
computed in double precision.  A pair that several buckets hold counts only in the first of them.  A cell sends on its
members' numbers of links and, for components, one edge for each member of a tree, never the pairs themselves.

Ties and repeated rows are classes of equal vectors; they link with each other.  Classes have numbers of their own, so rows
that repeat an id with other vectors each have the links of their own vector.  Labels and ids are whole numbers.  Vectors that are null, zero, of another
length than each other or hold null or non-finite components, and vectors with a null label or id, link with nothing (a
null id has a null component).  Further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .components import components

#: Tables, hashes side by side, and members of a block.
TABLES, HASHES, BLOCK = 8, 3, 1_024
SEED = 7


def hadamard(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of each row; the length is a power of two."""
    n, size = x.shape
    step = 1
    while step < size:
        pairs = x.reshape(n, size // (2 * step), 2, step)
        x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], 2).reshape(n, size)
        step *= 2
    return x / np.sqrt(size)


def buckets(unit: np.ndarray, tables: int = TABLES, hashes: int = HASHES) -> np.ndarray:
    """Bucket numbers (rows, tables * (1 + hashes)): for each table the nearest bucket, then the further probes."""
    size = 1 << max(1, (unit.shape[1] - 1).bit_length())
    padded = np.zeros((len(unit), size))
    padded[:, : unit.shape[1]] = unit
    rng = np.random.default_rng(SEED)
    out = np.zeros((len(unit), tables, 1 + hashes), np.int64)
    rows = np.arange(len(unit))
    for t in range(tables):
        nearest, second = [], []
        for _ in range(hashes):
            x = padded
            for _ in range(3):
                x = hadamard(x * rng.choice([-1.0, 1.0], size))
            strength = np.abs(x)
            one = strength.argmax(1)
            strength[rows, one] = -1
            two = strength.argmax(1)
            nearest.append(one * 2 + (x[rows, one] < 0))
            second.append(two * 2 + (x[rows, two] < 0))
        for probe in range(1 + hashes):
            code = np.full(len(unit), t, np.int64)
            for h in range(hashes):
                code = code * (2 * size) + (second if probe == h + 1 else nearest)[h]
            out[:, t, probe] = code
    return out.reshape(len(unit), -1)


def unit_rows(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(positions, unit vectors in double precision) for each vector length."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.values.to_numpy(zero_copy_only=False).astype(np.float64)
    starts = column.offsets.to_numpy()[:-1]
    out = []
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        x = flat[starts[at][:, None] + np.arange(size)]
        x = x / np.abs(x).max(1, keepdims=True)
        out.append((at, x / np.linalg.norm(x, axis=1, keepdims=True)))
    return out


def members(classes: DataFrame) -> DataFrame:
    """(id, label, size, code): the buckets of all classes; label and vector length are part of a bucket's name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, labels = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("id", "label"))
            for at, unit in unit_rows(batch.column("embedding")):
                codes = buckets(unit)
                each = codes.shape[1]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[at], each)), pa.array(np.repeat(labels[at], each)), pa.array(np.full(codes.size, unit.shape[1], np.int64)), pa.array(codes.ravel())], ["id", "label", "size", "code"])

    return classes.select("id", "label", "embedding").mapInArrow(run, "id long, label long, size long, code long")


def pairs_within(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of rows inside of each of some small cells."""
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for size in np.unique(sizes):
        i, j = np.triu_indices(size, 1)
        at = starts[sizes == size][:, None]
        left.append((at + i).ravel())
        right.append((at + j).ravel())
    return np.concatenate(left), np.concatenate(right)


def linked(unit: np.ndarray, starts: np.ndarray, sizes: np.ndarray, crossing: np.ndarray, second: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of one cell with the least cosine; of a crossing cell, those between its two blocks."""
    small = (sizes <= 32) & ~crossing
    i, j = pairs_within(starts[small], sizes[small])
    near = np.einsum("ij,ij->i", unit[i], unit[j]) >= cosine if len(i) else np.zeros(0, bool)
    left, right = [i[near]], [j[near]]
    for at, size, cross in zip(starts[~small], sizes[~small], crossing[~small], strict=True):
        rows = np.arange(at, at + size)
        a, b = (rows[~second[rows]], rows[second[rows]]) if cross else (rows, rows)
        close = unit[a] @ unit[b].T >= cosine
        x, y = np.nonzero(close if cross else np.triu(close, 1))
        left.append(a[x])
        right.append(b[y])
    return np.concatenate(left), np.concatenate(right)


def first_shared(unit: np.ndarray, i: np.ndarray, j: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Whether `code` is the first bucket that both rows of each pair are in."""
    used, back = np.unique(np.concatenate([i, j]), return_inverse=True)
    mine = buckets(unit[used])
    x, y = back[: len(i)], back[len(i) :]
    probes, none = 1 + HASHES, np.iinfo(np.int64).max
    out, todo = np.zeros(len(i), bool), np.arange(len(i))
    for t in range(TABLES):
        if not len(todo):
            break
        a, b = mine[x[todo], t * probes : (t + 1) * probes], mine[y[todo], t * probes : (t + 1) * probes]
        shared = np.where((a[:, :, None] == b[:, None, :]).any(2), a, none).min(1)
        out[todo] = shared == code[todo]
        todo = todo[shared == none]
    return out


def found_in(table: pa.Table, cosine: float) -> pa.RecordBatch:
    """(id, links, root) of the members of complete cells, sorted by cell."""
    number = lambda c: table[c].to_numpy().astype(np.int64)
    ids, many, code, block, i_block, j_block = map(number, ("id", "many", "code", "block", "i", "j"))
    key = np.stack([number(c) for c in ("label", "size", "code", "i", "j")], 1)
    starts = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(1)]))
    sizes = np.diff(np.concatenate([starts, [len(ids)]]))
    links, root = np.zeros(len(ids), np.int64), np.arange(len(ids))
    for at, unit in unit_rows(table["embedding"].combine_chunks()):
        place = np.full(len(ids), -1, np.int64)
        place[at] = np.arange(len(at))
        own = place[starts] >= 0
        i, j = linked(unit, place[starts[own]], sizes[own], (i_block != j_block)[starts[own]], (block == j_block)[at], cosine)
        for k in range(0, len(i), 200_000):
            a, b = i[k : k + 200_000], j[k : k + 200_000]
            good = first_shared(unit, a, b, code[at[a]])
            a, b = at[a[good]], at[b[good]]
            links += np.bincount(a, weights=many[b], minlength=len(ids)).astype(np.int64) + np.bincount(b, weights=many[a], minlength=len(ids)).astype(np.int64)
            while True:
                before = root.copy()
                np.minimum.at(root, a, root[b])
                np.minimum.at(root, b, root[a])
                root = root[root]
                if (root == before).all():
                    break
    hit = np.flatnonzero(links > 0)
    return pa.RecordBatch.from_arrays([pa.array(ids[hit]), pa.array(links[hit]), pa.array(ids[root[hit]])], ["id", "links", "root"])


def cells(classes: DataFrame, cosine: float, block: int = BLOCK) -> DataFrame:
    """(id, links, root): what each cell found about each of its members that has a link there."""
    name = ["label", "size", "code"]
    everyone = materialize(members(classes).distinct(), "members")
    sizes = materialize(everyone.groupBy(*name).agg(F.count("*").alias("n")).where("n > 1"), "bucket-sizes")
    shared = everyone.join(sizes, name).withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
    own = shared.withColumn("block", F.pmod(F.xxhash64("id", F.lit(SEED)), F.col("blocks")).cast("int"))
    meet = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least("block", k).alias("i"), F.greatest("block", k).alias("j")))
    dealt = own.select("id", *name, "block", F.explode(meet).alias("cell")).select("id", *name, "block", "cell.i", "cell.j")
    full = dealt.join(classes.select("id", "many", "embedding"), "id")
    order = [*name, "i", "j"]
    parts = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ready = full.select(*order, "block", "id", "many", "embedding").repartition(parts, *order).sortWithinPartitions(*order, "block", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            if sum(b.num_rows for b in held) < 4 * block:
                continue
            table = pa.Table.from_batches(held)
            key = np.stack([table[c].to_numpy().astype(np.int64) for c in order], 1)
            last = np.flatnonzero((key != key[-1]).any(1))
            if len(last):  # the last cell may go on
                yield found_in(table.slice(0, last[-1] + 1), cosine)
                held = table.slice(last[-1] + 1).to_batches()
        if held:
            yield found_in(pa.Table.from_batches(held), cosine)

    return ready.mapInArrow(run, "id long, links long, root long")


def near_dedup(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", cosine: float = 0.98) -> DataFrame:
    """(key, n_links, component_id, kept): one row per row of `df`."""
    x = F.col(vector)
    number = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    valid = F.col(key).isNotNull() & F.col(label).isNotNull() & x.isNotNull() & F.forall(x, number) & F.exists(x, lambda v: v != 0)
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.when(valid, x).alias("embedding"))
    rows = rows.withColumns({"h": F.xxhash64("label", "embedding"), "g": F.xxhash64(F.lit(SEED), "label", "embedding")})
    usable = rows.where("embedding IS NOT NULL").groupBy("label", "h", "g")
    classes = usable.agg(F.min("id").alias("first"), F.count("*").alias("many"), F.first("embedding").alias("embedding")).withColumn("id", F.monotonically_increasing_id())
    classes = materialize(classes, "vectors")  # from here on the numbers are fixed
    found = materialize(cells(classes, cosine), "found")
    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    labels = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    linked = counts.join(labels.withColumnRenamed("node", "id").withColumnRenamed("label", "component"), "id", "left")
    known = classes.select("id", "label", "h", "g", "first", "many").join(linked, "id", "left").where("many > 1 OR links IS NOT NULL")
    known = materialize(known.withColumn("component", F.coalesce("component", "id")), "linked")
    tops = known.groupBy("component").agg(F.min("first").alias("top"))
    known = known.join(tops, "component").select("label", "h", "g", "top", "many", "links")
    own = rows.select("id", F.when(F.col("embedding").isNotNull(), F.col("label")).alias("label"), "h", "g")
    out = own.join(known, ["label", "h", "g"], "left").withColumn("component_id", F.coalesce("top", "id"))
    links = F.coalesce(F.col("many") - 1, F.lit(0)) + F.coalesce("links", F.lit(0))
    return out.select(F.col("id").alias(key), links.cast("long").alias("n_links"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))

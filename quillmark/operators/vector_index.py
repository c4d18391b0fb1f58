"""Exact vector search that leaves blocks out: a corpus dealt to the nearest of some pivots, in blocks with their radii.

Unit vectors are compared by angles, which obey the triangle inequality: a query that is far from a block's centre by more than
the block's radius, or whose angle to the block's pivot is outside of the block's range of such angles, has a least angle to
everything in the block.  A search scores the blocks with the best bounds first; the k-th score found there is a threshold,
and only blocks whose bound reaches it are read at all.  A task scores the blocks of an Arrow batch in the order of their
bounds until these drop below what it has found, so that results are exact however the data lie.

Pivots are a bounded sample (`PIVOTS` vectors, by a hash of the id); every row is indexed.  Blocks hold one type of documents, so
that searches by type have thresholds by type.  A vector of zeros has similarity 0 with everything; vectors of another length than
a query, nulls and vectors with null or non-finite components are not found.  Rows that repeat an id are each taken for themselves.
Queries are taken a bounded number at a time, of any lengths.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources import versions
from .ranking import COMPARED, ranked
from .vector import QUERY_BLOCK, query_groups, unit

#: Vectors that cells are made about, and vectors of a block.
PIVOTS, BLOCK = 256, 256
#: Blocks of a query that are scored for its first threshold; blocks scored together after that.
SEEDS, WAVE = 4, 4
#: What rounding may take from a bound.
MARGIN = 1e-7
HEAD = "block long, doc_type string, dim int, size int, pivot array<double>, near double, far double, centre array<double>, radius double"
FOUND = "qid long, doc_id long, doc_type string, score double"


def finite(df: DataFrame) -> DataFrame:
    good = F.col("vector").isNotNull() & (F.size("vector") > 0) & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return df.where(good).select(F.col("doc_id").cast("long").alias("doc_id"), "doc_type", F.col("vector").cast("array<double>").alias("vector"))


def angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(a @ b.T, -1, 1))


def rows_of(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def dealt(rows: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """(doc_id, doc_type, vector, dim, cell, angle): each unit vector with the nearest pivot of its length; zeros have cell -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = pc.list_value_length(batch.column("vector")).to_numpy(zero_copy_only=False)
            for dim in np.unique(length):
                some = batch.take(pa.array(np.flatnonzero(length == dim)))
                own = unit(rows_of(some.column("vector"), dim))
                away = angles(own, pivots[int(dim)]) if int(dim) in pivots else np.zeros((len(own), 1))
                cell = np.where(np.abs(own).sum(1) > 0, away.argmin(1), -1)
                yield pa.RecordBatch.from_arrays(
                    [some.column("doc_id"), some.column("doc_type"), pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1, dtype=np.int32) * np.int32(dim)), pa.array(own.ravel())), pa.array(np.full(len(own), dim, np.int32)), pa.array(cell.astype(np.int32)), pa.array(away.min(1))],
                    ["doc_id", "doc_type", "vector", "dim", "cell", "angle"],
                )

    return rows.mapInArrow(run, "doc_id long, doc_type string, vector array<double>, dim int, cell int, angle double")


def blocks_of(rows: DataFrame, pivots: dict[int, np.ndarray], size: int) -> DataFrame:
    """Rows in the order of (dim, type, cell, angle) as blocks of one cell: a head, and the ids and vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            dim, cell = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("dim", "cell"))
            kind = pc.fill_null(batch.column("doc_type").dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)
            change = np.flatnonzero((np.diff(dim) != 0) | (np.diff(cell) != 0) | (np.diff(kind) != 0)) + 1
            for a, b in zip([0, *change.tolist()], [*change.tolist(), batch.num_rows], strict=True):
                for begin in range(a, b, size):
                    few = batch.slice(begin, min(size, b - begin))
                    d, c = int(dim[begin]), int(cell[begin])
                    own, angle = rows_of(few.column("vector"), d), few.column("angle").to_numpy()
                    centre = unit(own.mean(0, keepdims=True))
                    pivot = pivots[d][c] if c >= 0 and d in pivots else np.zeros(d)
                    one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x if isinstance(x, pa.Array) else pa.array(x))
                    head = [pa.array([number]), few.column("doc_type").slice(0, 1), pa.array([d], pa.int32()), pa.array([len(own)], pa.int32()), one(pivot), pa.array([angle.min() if c >= 0 else -1.0]), pa.array([angle.max()]), one(centre[0]), pa.array([float(angles(centre, own).max())])]
                    yield pa.RecordBatch.from_arrays([*head, one(few.column("doc_id")), one(own.ravel())], [f.split()[0] for f in HEAD.split(", ")] + ["ids", "vectors"])
                    number += 1

    return rows.mapInArrow(run, f"{HEAD}, ids array<long>, vectors array<double>")


def save_index(corpus: DataFrame, folder: str, pivots: int = PIVOTS, block: int = BLOCK) -> None:
    """Publish an index of (doc_id, doc_type, vector) as the store's new version."""
    spark = corpus.sparkSession
    before = versions.source(corpus)
    rows = finite(corpus)
    share = min(1.0, 4 * pivots / max(1, rows.count()))  # so that no task sends on more than it must
    some = rows.where(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1 << 30)) < int(share * (1 << 30))).withColumn("dim", F.size("vector"))
    some = some.withColumn("n", F.row_number().over(Window.partitionBy("dim").orderBy(F.xxhash64("doc_id"), "doc_id")))
    found: dict[int, list] = {}
    for r in some.where(F.col("n") <= pivots).select("dim", "vector").collect():
        found.setdefault(r.dim, []).append(r.vector)
    own = {d: unit(np.array(v, np.float64)) for d, v in found.items()}
    own = {d: p[np.abs(p).sum(1) > 0] for d, p in own.items()}
    own = {d: p for d, p in own.items() if len(p)}
    with versions.draft(spark, folder) as new:
        order = ["dim", "doc_type", "cell", "angle"]
        laid = dealt(rows, own).repartitionByRange(*order).sortWithinPartitions(*order)
        new.write("blocks", blocks_of(laid, own, block), **{"parquet.block.size": 8 << 20})
        new.details.update(source=before)


def load_index(spark: SparkSession, folder: str, corpus: DataFrame | None = None) -> DataFrame:
    """The blocks of the published index; with `corpus` it must have been made from that as it is now."""
    now = versions.current(spark, folder)
    if corpus is not None and versions.source(corpus) != now.details["source"]:
        raise versions.Stale(f"the index in {folder} is not of the vectors as they are now")
    return now.table("blocks")


@dataclass
class Asked:
    """Queries of one length as unit vectors, with what is known of each one's k-th score, by type if there is one."""

    ids: np.ndarray
    vectors: np.ndarray
    kth: dict[tuple[int, str | None], float] = field(default_factory=dict)

    def bounds(self, batch: pa.RecordBatch, dim: int) -> np.ndarray:
        """For each query and block the highest similarity that there may be."""
        pivot, centre = (rows_of(batch.column(c), dim) for c in ("pivot", "centre"))
        near, far, radius = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("near", "far", "radius"))
        to_pivot, to_centre = angles(self.vectors, pivot), angles(self.vectors, centre)
        by_pivot = np.where(np.abs(pivot).sum(1) > 0, np.maximum(near - to_pivot, to_pivot - far), 0)
        by_centre = np.where(np.abs(centre).sum(1) > 0, to_centre - radius, 0)
        most = np.cos(np.clip(np.maximum(by_pivot, by_centre), 0, np.pi))
        return np.where(near < 0, 0, most) + MARGIN  # zeros have no angles


class Search:
    """A task's search while blocks stream through it."""

    def __init__(self, asked: dict[int, Asked], k: int, by_type: bool, threshold: float | None):
        self.asked, self.k, self.by_type, self.threshold = asked, k, by_type, threshold
        self.best: dict[tuple[int, int, str | None], tuple] = {}
        self.pairs = self.scored = 0

    def groups(self, batch: pa.RecordBatch) -> Iterator[tuple[int, Asked, pa.RecordBatch, np.ndarray]]:
        dims = batch.column("dim").to_numpy(zero_copy_only=False)
        for dim in np.unique(dims):
            if int(dim) in self.asked:
                some = batch.take(pa.array(np.flatnonzero(dims == dim)))
                yield int(dim), self.asked[int(dim)], some, self.asked[int(dim)].bounds(some, int(dim))

    def kind(self, value: str | None) -> str | None:
        return value if self.by_type else None

    def least(self, dim: int, q: int, kind: str | None) -> float:
        asked = self.asked[dim]
        own = self.best.get((dim, q, kind))
        mine = own[0][-1] if own is not None and len(own[0]) == self.k else -np.inf
        floor = self.threshold if self.threshold is not None else -np.inf
        return max(mine, floor, asked.kth.get((int(asked.ids[q]), kind), -np.inf))

    def add(self, batch: pa.RecordBatch) -> None:
        for dim, asked, some, bounds in self.groups(batch):
            kinds = some.column("doc_type").to_pylist()
            size, ids = some.column("size").to_numpy(zero_copy_only=False), some.column("ids").flatten().to_numpy(zero_copy_only=False)
            ends, vectors = np.concatenate([[0], np.cumsum(size)]), rows_of(some.column("vectors"), dim)
            self.pairs += bounds.size
            for q in range(len(asked.ids)):
                order, at, step = np.argsort(-bounds[q], kind="stable"), 0, WAVE
                while at < len(order):
                    few = [b for b in order[at : at + step].tolist() if bounds[q, b] >= self.least(dim, q, self.kind(kinds[b]))]
                    if not few and not self.by_type:
                        break
                    for kind in {self.kind(kinds[b]) for b in few}:
                        rows = np.concatenate([np.arange(ends[b], ends[b + 1]) for b in few if self.kind(kinds[b]) == kind])
                        types = np.concatenate([np.full(size[b], kinds[b], object) for b in few if self.kind(kinds[b]) == kind])
                        self.keep((dim, q, kind), vectors[rows] @ asked.vectors[q], ids[rows], types)
                    self.scored += len(few)
                    at, step = at + step, 2 * step

    def keep(self, key: tuple[int, int, str | None], score: np.ndarray, ids: np.ndarray, types: np.ndarray) -> None:
        if self.threshold is not None:
            good = score >= self.threshold
            score, ids, types = score[good], ids[good], types[good]
        if key in self.best:
            score, ids, types = (np.concatenate([a, b]) for a, b in zip(self.best[key], (score, ids, types), strict=True))
        top = np.lexsort((ids, -np.round(score, COMPARED)))[: self.k]
        self.best[key] = score[top], ids[top], types[top]

    def results(self) -> pa.RecordBatch:
        rows = [(int(self.asked[dim].ids[q]), int(i), t, float(s)) for (dim, q, _), (score, ids, types) in self.best.items() for s, i, t in zip(score, ids, types, strict=True)]
        columns = list(zip(*rows, strict=True)) or [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.float64()), strict=True)], ["qid", "doc_id", "doc_type", "score"])


def scan(blocks: DataFrame, asked: dict[int, Asked], k: int, by_type: bool, threshold: float | None) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = Search(asked, k, by_type, threshold)
        for batch in batches:
            state.add(batch)
        yield state.results()

    found = blocks.mapInArrow(run, FOUND)
    return ranked(found, *(("qid", "doc_type") if by_type else ("qid",))).where(F.col("rank") <= k)


def first_blocks(heads: DataFrame, asked: dict[int, Asked], by_type: bool) -> list[int]:
    """The blocks with the best bounds of each query, of each type if that counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[tuple, list] = {}
        for batch in batches:
            for dim, own, some, bounds in Search(asked, 1, by_type, None).groups(batch):
                numbers, kinds = some.column("block").to_pylist(), some.column("doc_type").to_pylist()
                for kind in set(kinds) if by_type else [None]:
                    at = np.array([j for j, x in enumerate(kinds) if not by_type or x == kind])
                    top = np.argsort(-bounds[:, at], axis=1, kind="stable")[:, :SEEDS]
                    for q in range(len(own.ids)):
                        mine = [(-bounds[q, at[j]], numbers[at[j]]) for j in top[q].tolist()]
                        best[dim, q, kind] = sorted(best.get((dim, q, kind), []) + mine)[:SEEDS]
        rows = [(int(asked[d].ids[q]), kind, -b, n) for (d, q, kind), own in best.items() for b, n in own]
        columns = list(zip(*rows, strict=True)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.float64(), pa.int64()), strict=True)], ["qid", "kind", "bound", "block"])

    pairs = heads.mapInArrow(run, "qid long, kind string, bound double, block long")
    place = F.row_number().over(Window.partitionBy("qid", "kind").orderBy(F.desc("bound"), "block"))
    return sorted({r.block for r in pairs.withColumn("place", place).where(F.col("place") <= SEEDS).collect()})


def reached(heads: DataFrame, asked: dict[int, Asked], by_type: bool, threshold: float | None) -> DataFrame:
    """(block): blocks whose bound reaches the threshold of some query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            state = Search(asked, 1, by_type, threshold)
            for dim, own, some, bounds in state.groups(batch):
                kinds = some.column("doc_type").to_pylist()
                least = {x: np.array([state.least(dim, q, state.kind(x)) for q in range(len(own.ids))]) for x in set(kinds)}
                good = [n for j, n in enumerate(some.column("block").to_pylist()) if (bounds[:, j] >= least[kinds[j]]).any()]
                yield pa.RecordBatch.from_arrays([pa.array(good, pa.int64())], ["block"])

    return heads.mapInArrow(run, "block long")


def search_index(blocks: DataFrame, queries: DataFrame, k: int, by_type: bool = False, threshold: float | None = None) -> DataFrame:
    """What `vector.search` finds, from an index."""
    heads = blocks.select(*[f.split()[0] for f in HEAD.split(", ")])
    out = None
    for group in query_groups(queries, QUERY_BLOCK):
        asked = {d: Asked(ids, unit(v)) for d, (ids, v) in group.items()}
        seeds = blocks.where(F.col("block").isin(first_blocks(heads, asked, by_type)))
        for r in scan(seeds, asked, k, by_type, threshold).where(F.col("rank") == k).collect():
            for own in asked.values():
                if r.qid in own.ids:
                    own.kth[r.qid, r.doc_type if by_type else None] = r.score - MARGIN
        found = scan(blocks.join(reached(heads, asked, by_type, threshold), "block", "left_semi"), asked, k, by_type, threshold)
        out = found if out is None else out.unionByName(found)
    return out

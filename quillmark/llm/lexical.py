"""Ranked lexical search over document-range blocks, with per-term maxima that let whole blocks go unscored.

Terms are maximal runs of digits, letters and non-ASCII characters, A-Z in lower case.  All numbers are whole: a term weighs
floor(1000 ln((2N + 2) / (2 df + 1))), a posting adds (10^9 tf) div (1000 tf + 12 m) times that, where m is 75 plus
(25 n N) div L for a document of n terms in a corpus of N documents and L terms.

`build` reads the texts twice, without an exchange: once for N and L, then for the blocks.  A block is a run of consecutive
rows: a forward index (each document's terms and frequencies over the block's own list of terms), the documents that hold
each term, and the largest part of a score that each term has in any of them.  A search

1. adds up the frequencies of its own terms over all blocks;
2. bounds every block by its maxima, each task sending on a query's best few blocks, and scores the best of all, so that the
   k-th score found is a threshold that no result can be below;
3. streams all blocks: those of an Arrow batch are sorted by a query's bound and scored in that order until the bound drops
   below the query's threshold, which rises with what the task has found.  Tasks send on k rows for a query at most.

Every document that can be among the k best is scored, so results are exact.  Queries are taken a bounded number at a time;
what reaches the driver or is sent to all tasks (their terms, weights, thresholds) grows with that number, not with the corpus.

Null texts have no terms, documents without any count for nothing, queries without any find nothing.  Equal scores are in the
order of ids, null ids last; ids must be below 2^63 - 1.  Rows that repeat an id, among documents or queries, are each
taken for themselves.  Other columns are ignored; empty tables give an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .common import materialize
from .infill import buffers

#: Documents and terms of a block, one document at least.
BLOCK_DOCS, BLOCK_TERMS = 64, 100_000
#: Bytes of a row group of blocks, and blocks after which the writer looks at them: Spark decodes up to 4,096 rows of a row group at once,
#: each with thousands of postings, so that row groups of the usual size would fill an executor's heap.
ROW_GROUP, LOOKED_AT = 2 << 20, 4
#: Queries that are searched for at once.
QUERIES_AT_ONCE = 1_000
#: Blocks with the best bounds that are scored for the first threshold of a query; blocks scored together after that.
SEEDS, WAVE = 2, 4
NO_ID = 2**63 - 1
#: Whether a byte belongs to a term, and every byte in its normal form.
TERM_BYTE = np.zeros(256, bool)
TERM_BYTE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
NORMAL = np.arange(256, dtype=np.uint8)
NORMAL[65:91] += 32


def term_starts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, whether they are of a term, whether they begin one, where each text's terms begin among all terms)."""
    data, offsets = buffers(texts)
    inside = TERM_BYTE[data]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    begins = offsets[:-1][offsets[:-1] < offsets[1:]]
    starts[begins] = inside[begins]
    return data, inside, starts, np.concatenate([[0], np.cumsum(starts)])[offsets]


def terms_of(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(where each text's terms begin among all terms, all terms in order)."""
    data, inside, starts, ends = term_starts(texts)
    at = np.concatenate([np.flatnonzero(starts[inside]), [int(inside.sum())]]).astype(np.int32)
    return ends, pa.Array.from_buffers(pa.string(), len(at) - 1, [None, pa.py_buffer(at.tobytes()), pa.py_buffer(NORMAL[data[inside]].tobytes())])


def lists(values: np.ndarray | pa.Array, ends: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), values if isinstance(values, pa.Array) else pa.array(values))


def flat(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(lengths of the lists of a column, all their values)."""
    return pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64), column.flatten()


@dataclass
class Index:
    """Blocks as a table, with the number of documents that have terms and of all their terms."""

    blocks: DataFrame
    docs: int
    terms: int

    def lengths(self, sizes: np.ndarray) -> np.ndarray:
        """The m of documents of so many terms."""
        return 75 + (25 * self.docs * sizes.astype(np.int64)) // max(self.terms, 1)


def parts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What a posting adds for each unit of its term's weight."""
    return (1_000_000_000 * tf.astype(np.int64)) // (1000 * tf.astype(np.int64) + 12 * m)


def totals(docs: DataFrame, text: str) -> tuple[int, int]:
    """(documents that have terms, all their terms)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch, "text"):
                n = np.diff(term_starts(common.texts_of(part))[3])
                yield pa.RecordBatch.from_arrays([pa.array([int((n > 0).sum())]), pa.array([int(n.sum())])], ["docs", "terms"])

    common.bounded_batches(docs.sparkSession)
    row = docs.select(F.col(text).alias("text")).mapInArrow(run, "docs long, terms long").agg(F.sum("docs").alias("docs"), F.sum("terms").alias("terms")).first()
    return row.docs or 0, row.terms or 0


BLOCK = "block long, docs array<long>, sizes array<int>, code array<int>, tf array<int>, terms array<string>, dfs array<int>, best array<int>"


def block_rows(index: Index, ids: pa.Array, ends: np.ndarray, terms: pa.Array, first: int, docs: int, size: int) -> Iterator[pa.RecordBatch]:
    """The blocks of a slice of documents, numbered from `first`."""
    begin = 0
    while begin < len(ids):
        end = min(len(ids), begin + docs, max(begin + 1, int(np.searchsorted(ends, ends[begin] + size, side="right")) - 1))
        sizes = np.diff(ends[begin : end + 1])
        coded = terms.slice(int(ends[begin]), int(sizes.sum())).dictionary_encode()
        words = coded.dictionary
        pairs = np.repeat(np.arange(end - begin), sizes) * max(len(words), 1) + coded.indices.to_numpy(zero_copy_only=False)
        pairs, tf = np.unique(pairs, return_counts=True)
        doc, code = np.divmod(pairs, max(len(words), 1))
        order = np.argsort(code, kind="stable")
        starts = np.searchsorted(code[order], np.arange(len(words)))
        worth = parts(tf, index.lengths(sizes)[doc])[order]
        best = np.maximum.reduceat(worth, starts) if len(words) else worth
        per_doc = np.bincount(doc, minlength=end - begin)
        one = lambda values: lists(values, np.array([0, len(values)]))
        columns = [pa.array([first]), one(ids.slice(begin, end - begin)), one(pa.array(np.stack([sizes, per_doc], 1).astype(np.int32).ravel())), one(pa.array(code.astype(np.int32))), one(pa.array(tf.astype(np.int32))), one(words), one(pa.array(np.bincount(code, minlength=len(words)).astype(np.int32))), one(pa.array(best.astype(np.int32)))]
        yield pa.RecordBatch.from_arrays(columns, ["block", "docs", "sizes", "code", "tf", "terms", "dfs", "best"])
        first, begin = first + 1, end


def build(docs: DataFrame, key: str = "doc_id", text: str = "text", block_docs: int = BLOCK_DOCS, block_terms: int = BLOCK_TERMS) -> Index:
    """Index all documents.  In a block's `sizes`, each document has two numbers: its terms with repeats, and its distinct ones."""
    index = Index(docs, *totals(docs, text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in common.slices(batch, "text"):
                ends, terms = terms_of(common.texts_of(part))
                for row in block_rows(frame, part.column("id"), ends, terms, number, block_docs, block_terms):
                    yield row
                    number += 1

    frame = Index(None, index.docs, index.terms)  # what tasks need of it
    common.bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(run, BLOCK)
    index.blocks = materialize(rows, "blocks", **{"parquet.block.size": ROW_GROUP, "parquet.page.size.row.check.min": LOOKED_AT})
    return index


@dataclass
class Asked:
    """Queries as numbers: the terms of all, and for each term which queries hold it, how often, with what weight."""

    terms: pa.Array
    start: np.ndarray
    query: np.ndarray
    times: np.ndarray
    count: int
    weight: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    @staticmethod
    def of(texts: list[str | None]) -> Asked:
        ends, flat_terms = terms_of(pa.array([t or "" for t in texts], pa.string()))
        coded = flat_terms.dictionary_encode()
        query = np.repeat(np.arange(len(texts)), np.diff(ends))
        pairs, times = np.unique(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) * max(len(texts), 1) + query, return_counts=True)
        term, query = np.divmod(pairs, max(len(texts), 1))
        return Asked(coded.dictionary, np.searchsorted(term, np.arange(len(coded.dictionary) + 1)), query, times, len(texts))

    def weigh(self, df: dict[int, int], docs: int) -> None:
        """Give each term its weight; a term that no document holds has none."""
        per = np.array([math.floor(1000 * math.log((2 * docs + 2) / (2 * df[t] + 1))) if t in df else 0 for t in range(len(self.terms))], np.int64)
        self.weight = np.repeat(per, np.diff(self.start)) * self.times

    def by_query(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """(terms, weights with repeats) of each query."""
        term = np.repeat(np.arange(len(self.terms)), np.diff(self.start))
        order = np.argsort(self.query, kind="stable")
        cuts = np.searchsorted(self.query[order], np.arange(1, self.count))
        return list(zip(np.split(term[order], cuts), np.split(self.weight[order], cuts), strict=True)) if self.count else []

    def known(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(number of each block's terms, the number of each of them among the asked ones, -1 if it is none)."""
        lengths, terms = flat(column)
        return lengths, pc.fill_null(pc.index_in(terms, self.terms), -1).to_numpy(zero_copy_only=False).astype(np.int64)

    def bounds(self, batch: pa.RecordBatch, lengths: np.ndarray, known: np.ndarray) -> np.ndarray:
        """For each block and query the sum of its terms' weights times their maxima in the block: no score is above it."""
        have = known >= 0
        block, term = np.repeat(np.arange(len(lengths)), lengths)[have], known[have]
        best = flat(batch.column("best"))[1].to_numpy(zero_copy_only=False)[have]
        counts = self.start[term + 1] - self.start[term]
        entry = common.gather(np.arange(len(self.query)), self.start[term], counts)
        place = np.repeat(block, counts) * self.count + self.query[entry]
        # Sums are below 2^53, so that they are exact as doubles.
        return np.bincount(place, np.repeat(best, counts) * self.weight[entry], len(lengths) * self.count).reshape(len(lengths), self.count)


def frequencies(index: Index, asked: Asked) -> dict[int, int]:
    """Documents that hold each asked term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(asked.terms), np.int64)
        for batch in batches:
            _, known = asked.known(batch.column("terms"))
            have = known >= 0
            total += np.bincount(known[have], flat(batch.column("dfs"))[1].to_numpy(zero_copy_only=False)[have], len(total)).astype(np.int64)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["term", "df"])

    rows = index.blocks.select("terms", "dfs").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect()
    return {r.term: r.df for r in rows}


def best_blocks(index: Index, asked: Asked, count: int) -> list[int]:
    """The blocks with the highest bounds of each query: at most `count` for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bound, block = np.zeros((0, asked.count)), np.zeros((0, asked.count), np.int64)
        for batch in batches:
            own = asked.bounds(batch, *asked.known(batch.column("terms")))
            bound = np.concatenate([bound, own])
            block = np.concatenate([block, np.repeat(batch.column("block").to_numpy()[:, None], asked.count, 1)])
            top = np.argsort(-bound, axis=0, kind="stable")[:count]
            bound, block = np.take_along_axis(bound, top, 0), np.take_along_axis(block, top, 0)
        row, query = np.nonzero(bound)
        yield pa.RecordBatch.from_arrays([pa.array(query), pa.array(block[row, query]), pa.array(bound[row, query])], ["q", "block", "bound"])

    pairs = index.blocks.select("block", "terms", "best").mapInArrow(run, "q long, block long, bound double")
    first = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("bound"), "block"))
    return sorted({r.block for r in pairs.withColumn("at", first).where(F.col("at") <= count).collect()})


class Scan:
    """What a task knows of its queries while blocks stream through it."""

    def __init__(self, index: Index, asked: Asked, least: np.ndarray, k: int):
        self.index, self.asked, self.k = index, asked, k
        self.least = least.copy()
        self.queries = asked.by_query()
        self.score = [np.zeros(0, np.int64)] * asked.count
        self.doc = [np.zeros(0, np.int64)] * asked.count
        self.pairs = self.scored = 0

    def add(self, batch: pa.RecordBatch) -> None:
        lengths, known = self.asked.known(batch.column("terms"))
        bounds = self.asked.bounds(batch, lengths, known)
        open_ = (bounds >= self.least) & (bounds > 0)
        self.pairs += int((bounds > 0).sum())
        if open_.any():
            worth = Postings(self.index, batch, lengths, known)
            for q in np.flatnonzero(open_.any(0)):
                self.search(int(q), bounds[:, q], worth)

    def search(self, q: int, bound: np.ndarray, worth: Postings) -> None:
        """Score blocks in the order of their bounds until these drop below the query's threshold."""
        order = np.argsort(-bound, kind="stable")
        order, at, step = order[bound[order] > 0], 0, WAVE
        while at < len(order) and bound[order[at]] >= self.least[q]:
            some = order[at : at + step]
            some = some[bound[some] >= self.least[q]]
            self.scored += len(some)
            self.keep(q, *worth.scores(*self.queries[q], np.sort(some)))
            at, step = at + step, 2 * step

    def keep(self, q: int, doc: np.ndarray, score: np.ndarray) -> None:
        good = score >= self.least[q]
        score, doc = np.concatenate([self.score[q], score[good]]), np.concatenate([self.doc[q], doc[good]])
        top = np.lexsort((doc, -score))[: self.k]
        self.score[q], self.doc[q] = score[top], doc[top]
        if len(top) == self.k:
            self.least[q] = max(self.least[q], int(score[top[-1]]))

    def results(self) -> pa.RecordBatch:
        query = np.repeat(np.arange(len(self.doc)), [len(d) for d in self.doc])
        doc, score = (np.concatenate([*x, np.zeros(0, np.int64)]) for x in (self.doc, self.score))
        return pa.RecordBatch.from_arrays([pa.array(query), pa.array(doc, mask=doc == NO_ID), pa.array(score)], ["q", "doc_id", "score"])


class Postings:
    """The postings of asked terms in the blocks of a batch, in the order of (term, block)."""

    def __init__(self, index: Index, batch: pa.RecordBatch, lengths: np.ndarray, known: np.ndarray):
        n_docs, ids = flat(batch.column("docs"))
        self.ids = pc.fill_null(ids, NO_ID).to_numpy(zero_copy_only=False)
        sizes = flat(batch.column("sizes"))[1].to_numpy(zero_copy_only=False).reshape(-1, 2)
        n_postings, code = flat(batch.column("code"))
        block = np.repeat(np.arange(len(lengths)), n_postings)
        term = known[code.to_numpy(zero_copy_only=False) + (np.cumsum(lengths) - lengths)[block]]
        have = np.flatnonzero(term >= 0)
        self.blocks = len(lengths)
        place = term[have] * self.blocks + block[have]
        order = np.argsort(place, kind="stable")
        have, self.place = have[order], place[order]
        self.doc = np.repeat(np.arange(len(ids)), sizes[:, 1])[have]
        tf = flat(batch.column("tf"))[1].to_numpy(zero_copy_only=False)[have]
        self.worth = parts(tf, index.lengths(sizes[:, 0])[self.doc])

    def scores(self, terms: np.ndarray, weights: np.ndarray, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the documents of some blocks with a score above 0."""
        wanted = (terms[:, None] * self.blocks + blocks).ravel()
        low, high = np.searchsorted(self.place, wanted), np.searchsorted(self.place, wanted, side="right")
        entry = common.gather(np.arange(len(self.place)), low, high - low)
        total = np.bincount(self.doc[entry], self.worth[entry] * np.repeat(np.repeat(weights, len(blocks)), high - low), len(self.ids))
        some = np.flatnonzero(total)
        return self.ids[some], total[some].astype(np.int64)


def scan(blocks: DataFrame, index: Index, asked: Asked, least: np.ndarray, k: int) -> DataFrame:
    """(q, doc_id, score): of each task the k best documents of every query that are not below its threshold."""
    frame = Index(None, index.docs, index.terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = Scan(frame, asked, least, k)
        for batch in batches:
            state.add(batch)
        yield state.results()

    common.bounded_batches(blocks.sparkSession)
    found = blocks.mapInArrow(run, "q long, doc_id long, score long")
    best = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def search_some(index: Index, texts: list[str | None], k: int) -> DataFrame:
    """(q, doc_id, score, rank) of the queries, which are numbered as in the list."""
    asked = Asked.of(texts)
    asked.weigh(frequencies(index, asked), index.docs)
    least = np.ones(asked.count, np.int64)
    seeds = index.blocks.where(F.col("block").isin(best_blocks(index, asked, SEEDS)))
    for r in scan(seeds, index, asked, least, k).where(F.col("rank") == k).select("q", "score").collect():
        least[r.q] = r.score
    return scan(index.blocks, index, asked, least, k)


def search(index: Index, queries: DataFrame, k: int = 20, key: str = "item_id", text: str = "text") -> DataFrame:
    """(key, rank, doc_id, score): the k best documents of each query with a score above 0."""
    spark = queries.sparkSession
    rows = materialize(queries.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), F.col(text).alias("text")), "queries")
    groups = max(1, -(-rows.count() // QUERIES_AT_ONCE))
    out = None
    for g in range(groups):
        some = rows.orderBy("row").offset(g * QUERIES_AT_ONCE).limit(QUERIES_AT_ONCE).collect()
        names = F.broadcast(spark.createDataFrame([(i, r.row) for i, r in enumerate(some)], "q long, row long"))
        found = search_some(index, [r.text for r in some], k).join(names, "q").drop("q")
        out = found if out is None else out.unionByName(found)
    named = out.join(F.broadcast(rows.select("row", "key")) if groups == 1 else rows.select("row", "key"), "row")
    return named.select(F.col("key").alias(key), "rank", "doc_id", "score")

"""Lexicons of a corpus: words by tf-idf and by their rank in the graph of words that stand near each other.

A document is a row (doc_id, words), its words in order.  Words are counted inside of tasks, a bounded number at a time, before they are
exchanged.

Ranks are found by power iteration.  `word_ranks` never lists the graph's edges, of which there are nearly as many as pairs of neighbours: what
a word receives in a step is added up over its places in the texts, which are written once as numbers, and a step exchanges one sum for
each word of a task.  `ranks` is for a graph that is given as a table of edges: each step is a join of the edges with the ranks and one
aggregate; edges and ranks are written, so that no step is computed twice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import bounded_batches, own_folder

#: How far apart words of an edge stand at most, words that either way gives, their shares, the gain of a word that follows a
#: pattern, bounds of length and weight, bands of weights, and patterns and words without meaning of the texts the lexicon is meant for.
SPAN, DAMPING, ITERATIONS = 5, 0.85, 10
TF_IDF_WORDS, RANKED_WORDS, TF_IDF_SHARE, RANK_SHARE, GAIN = 150, 100, 0.7, 0.3, 1.3
SHORTEST, LONGEST, LEAST, HIGH, MIDDLE = 2, 8, 0.015, 0.03, 0.02
#: Distinct edges that a task sums before it sends them on, and words that it looks at together.
EDGES, WORDS = 1_000_000, 200_000
#: Words of a block of documents, with repeats; distinct words whose ranks travel with the tasks of a scan of the blocks.
BLOCK, TRAVEL = 2_000_000, 8_000_000
#: Bytes of a row group of blocks, and blocks after which the writer looks at them: Spark decodes a row group's rows at once.
ROW_GROUP, LOOKED_AT = 8 << 20, 1
PATTERN = "[法律条款罪权责诉讼判]|合同|协议|赔偿|损害|民事|刑事|行政|商事"
WITHOUT_MEANING = ["这个", "一个", "可以", "应该", "需要", "进行", "相关", "有关", "其他", "以及", "或者", "但是", "因此", "所以"]


def tf_idf(docs: DataFrame, most: int = TF_IDF_WORDS) -> DataFrame:
    """(word, weight): the words with the largest frequency times ln((1 + documents) / (1 + documents with it)), over the largest."""
    n = docs.agg(F.count("*").alias("n_docs"))
    scored = word_counts(docs).crossJoin(F.broadcast(n)).select("word", (F.col("tf") * F.log((1 + F.col("n_docs")) / (1 + F.col("df")))).alias("raw"))
    top = scored.orderBy(F.round("raw", 6).desc(), "word").limit(most)
    return top.select("word", (F.col("raw") / F.max("raw").over(Window.partitionBy())).alias("weight"))


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, tf, df): how often each word stands in the documents, and in how many of them; each task adds up its own."""
    most, together = EDGES, WORDS

    def sent(numbers: dict[str, int], tf: np.ndarray, df: np.ndarray) -> Iterator[pa.RecordBatch]:
        names = pa.array(list(numbers), pa.string())
        for begin in range(0, len(names), 100_000):
            yield pa.RecordBatch.from_arrays([names.slice(begin, 100_000), pa.array(tf[begin : begin + 100_000]), pa.array(df[begin : begin + 100_000])], ["word", "tf", "df"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers: dict[str, int] = {}
        tf, df = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            for part in few(batch, together):
                code, doc = coded_words(part.column("words"), numbers)
                tf, df = (np.concatenate([x, np.zeros(len(numbers) - len(x), np.int64)]) for x in (tf, df))
                tf += np.bincount(code, minlength=len(tf))
                df += np.bincount(np.unique(code * max(part.num_rows, 1) + doc) // max(part.num_rows, 1), minlength=len(df))
                if len(numbers) > most:
                    yield from sent(numbers, tf, df)
                    numbers, tf, df = {}, tf[:0], df[:0]
        yield from sent(numbers, tf, df)

    bounded_batches(docs.sparkSession)
    return docs.select("words").mapInArrow(run, "word string, tf long, df long").groupBy("word").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"))


def coded_words(words: pa.ListArray, numbers: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of all words of some documents, which get new ones where they have none yet; the place of each word's document)."""
    length = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = words.flatten().dictionary_encode()
    number = np.array([numbers.setdefault(w, len(numbers)) for w in coded.dictionary.to_pylist()], np.int64)
    return number[coded.indices.to_numpy(zero_copy_only=False)] if len(number) else np.zeros(0, np.int64), np.repeat(np.arange(len(length)), length)


def neighbours(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """(a, b, weight): how often two different words stand less than `span` apart, in both directions."""
    return task_edges(docs, span).groupBy("a", "b").agg(F.sum("weight").alias("weight"))


def task_edges(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """(a, b, weight): the edges of each task, summed over its batches."""
    most, together = EDGES, WORDS

    def pairs_of(words: pa.ListArray, numbers: dict[str, int]) -> np.ndarray:
        """The pairs (a, b) of some documents, each a << 32 | b of the task's numbers of words."""
        code, doc = coded_words(words, numbers)
        found = [np.zeros(0, np.int64)]
        for d in range(1, span):
            a, b = code[:-d], code[d:]
            good = (doc[:-d] == doc[d:]) & (a != b)
            found += [a[good] << 32 | b[good], b[good] << 32 | a[good]]
        return np.concatenate(found)

    def sent(pair: np.ndarray, weight: np.ndarray, numbers: dict[str, int]) -> Iterator[pa.RecordBatch]:
        names = pa.array(list(numbers), pa.string())
        for begin in range(0, len(pair), 100_000):
            own = pair[begin : begin + 100_000]
            yield pa.RecordBatch.from_arrays([names.take(pa.array(own >> 32)), names.take(pa.array(own & 0xFFFFFFFF)), pa.array(weight[begin : begin + 100_000])], ["a", "b", "weight"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers: dict[str, int] = {}
        pair, weight = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            for part in few(batch, together):
                new, times = np.unique(pairs_of(part.column("words"), numbers), return_counts=True)
                every, place = np.unique(np.concatenate([pair, new]), return_inverse=True)
                summed = np.zeros(len(every), np.int64)
                summed[place[: len(pair)]] = weight
                summed[place[len(pair) :]] += times
                pair, weight = every, summed
                if len(pair) > most or len(numbers) > most:
                    yield from sent(pair, weight, numbers)
                    numbers, pair, weight = {}, pair[:0], weight[:0]
        yield from sent(pair, weight, numbers)

    bounded_batches(docs.sparkSession)
    return docs.select("words").mapInArrow(run, "a string, b string, weight long")


def few(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of a batch of about `most` words, one document at least."""
    size, begin = np.cumsum(pc.fill_null(pc.list_value_length(batch.column("words")), 0).to_numpy(zero_copy_only=False).astype(np.int64)), 0
    while begin < batch.num_rows:
        end = max(begin + 1, int(np.searchsorted(size, (size[begin - 1] if begin else 0) + most, side="right")))
        yield batch.slice(begin, end - begin)
        begin = end


def ranks(edges: DataFrame, iterations: int = ITERATIONS, damping: float = DAMPING, tolerance: float | None = None) -> DataFrame:
    """(word, rank) of the words of a weighted graph (a, b, weight) that has both directions.

    Every word begins with 1; each step gives it 1 - damping and of each neighbour's rank the share of its edge.  With a tolerance, steps
    are compared, and end when no rank moves by more.
    """
    spark, folder = edges.sparkSession, own_folder(edges.sparkSession, "ranks")

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    edges = kept(edges, "edges")
    whole = edges.groupBy("a").agg(F.sum("weight").alias("whole"))
    links = kept(edges.join(whole, "a").select(F.col("a").alias("word"), F.col("b").alias("to"), (F.col("weight") / F.col("whole")).alias("share")), "links")
    now = whole.select(F.col("a").alias("word"), F.lit(1.0).alias("rank"))
    for n in range(iterations):
        before, now = now, links.join(now, "word").groupBy(F.col("to").alias("word")).agg(F.sum(F.col("share") * F.col("rank")).alias("sum")).select("word", (1 - damping + damping * F.col("sum")).alias("rank"))
        now = kept(now, str(n))
        if tolerance is not None:
            moved = now.join(before.withColumnRenamed("rank", "before"), "word").agg(F.max(F.abs(F.col("rank") - F.col("before")))).first()[0]
            if moved is None or moved <= tolerance:
                break
    return now


def word_blocks(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """(block, words, codes): runs of documents, each as its distinct words and the places of its words among them in order, with
    span - 1 times -1 behind each document.
    """
    size = BLOCK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, numbers, codes, held = TaskContext.get().partitionId() << 32, {}, [], 0

        def whole() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([block]), pa.array([list(numbers)], pa.list_(pa.string())), pa.ListArray.from_arrays(pa.array([0, held], pa.int32()), pa.array(np.concatenate(codes)))], ["block", "words", "codes"])

        for batch in batches:
            code, doc = coded_words(batch.column("words"), numbers)
            spaced = np.full(len(code) + batch.num_rows * (span - 1), -1, np.int32)
            spaced[np.arange(len(code)) + doc * (span - 1)] = code
            codes.append(spaced)
            held += len(spaced)
            if held >= size:
                yield whole()
                block, numbers, codes, held = block + 1, {}, [], 0
        if held:
            yield whole()

    bounded_batches(docs.sparkSession)
    return docs.select("words").mapInArrow(run, "block long, words array<string>, codes array<int>")


def received(blocks: DataFrame, given: np.ndarray, first: int, to: tuple[int, int], span: int = SPAN) -> DataFrame:
    """(id, sum): what the words numbered from to[0] to to[1] receive, where each word with a number from `first` on gives `given` to each
    word that stands less than `span` apart from it; each task adds up its own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(to[1] - to[0])
        for batch in batches:
            for ids, codes in zip(batch.column("ids"), batch.column("codes"), strict=True):
                ids, codes = (x.values.to_numpy(zero_copy_only=False) for x in (ids, codes))
                gives, own = np.zeros(len(ids) + 1), (ids >= first) & (ids < first + len(given))
                gives[:-1][own] = given[ids[own] - first]
                gives, total = gives[codes], np.zeros(len(codes))  # the last, of what separates documents, is 0
                for d in range(1, span):
                    differ = codes[:-d] != codes[d:]
                    total[:-d] += gives[d:] * differ
                    total[d:] += gives[:-d] * differ
                wanted = np.flatnonzero((ids >= to[0]) & (ids < to[1]))
                sums[ids[wanted] - to[0]] += np.bincount(codes + 1, total, len(ids) + 1)[1:][wanted]
        some = np.flatnonzero(sums)
        for begin in range(0, len(some), 100_000):
            few_ = some[begin : begin + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(few_ + to[0]), pa.array(sums[few_])], ["id", "sum"])

    bounded_batches(blocks.sparkSession)
    return blocks.select("ids", "codes").mapInArrow(run, "id long, sum double")


def word_ranks(docs: DataFrame, iterations: int = ITERATIONS, damping: float = DAMPING, span: int = SPAN) -> DataFrame:
    """(word, rank): `ranks` of the `neighbours` of documents, without a table of edges.

    Numbers of words are given to blocks by a join of equal words.  What words give in a step travels with the tasks, at most TRAVEL words at
    a time, and a task adds up what as many receive: beyond that a step is one scan of the blocks for each pair of such ranges.
    """
    spark, folder = docs.sparkSession, own_folder(docs.sparkSession, "word-ranks")

    def kept(df: DataFrame, name: str, **options: int) -> DataFrame:
        df.write.options(**options).parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    small = {"parquet.block.size": ROW_GROUP, "parquet.page.size.row.check.min": LOOKED_AT}
    found = kept(word_blocks(docs, span), "found", **small)
    words = kept(found.select(F.explode("words").alias("word")).distinct().withColumn("at", F.monotonically_increasing_id()), "words")
    parts = sorted((r.part, r["n"]) for r in words.groupBy(F.shiftright("at", 33).alias("part")).agg(F.count("*").alias("n")).collect())
    begins = [(part, sum(n for _, n in parts[:i])) for i, (part, _) in enumerate(parts)]
    size, begin = sum(n for _, n in parts), F.broadcast(spark.createDataFrame(begins, "part long, begin long"))
    words = words.join(begin, F.shiftright("at", 33) == F.col("part")).select("word", (F.col("begin") + F.col("at").bitwiseAND((1 << 33) - 1)).alias("id"))

    def with_ids(own: pa.Table, block: pa.Table) -> pa.Table:
        ids = own["id"].to_numpy()[np.argsort(own["place"].to_numpy())].astype(np.int32)
        return pa.table([pa.array([ids], pa.list_(pa.int32())), block["codes"].combine_chunks()], names=["ids", "codes"])

    named = found.select("block", F.posexplode("words").alias("place", "word")).join(words, "word").select("block", "place", "id")
    blocks = kept(named.groupBy("block").cogroup(found.select(F.col("block").alias("of_block"), "codes").groupBy("of_block")).applyInArrow(with_ids, "ids array<int>, codes array<int>"), "blocks", **small)
    ranges = [(a, min(a + TRAVEL, size)) for a in range(0, size, TRAVEL)]

    def step(now: DataFrame | None) -> DataFrame:
        """(id, sum): what words receive that have (id, gives), or 1 for each of their places."""
        out = spark.createDataFrame([], "id long, sum double")
        for a, b in ranges:
            given = np.ones(b - a)
            if now is not None:
                own = now.where((F.col("id") >= a) & (F.col("id") < b)).toArrow()
                given[:] = 0
                given[own["id"].to_numpy() - a] = own["gives"].to_numpy()
            for to in ranges:
                out = out.unionByName(received(blocks, given, a, to, span))
        return out.groupBy("id").agg(F.sum("sum").alias("sum"))

    now = kept(step(None).select("id", F.col("sum").alias("whole"), F.lit(1.0).alias("rank")), "start")
    for n in range(iterations):
        sums = step(now.select("id", (F.col("rank") / F.col("whole")).alias("gives")))
        now = kept(now.drop("rank").join(sums, "id").select("id", "whole", (1 - damping + damping * F.col("sum")).alias("rank")), str(n))
    return now.join(words, "id").select("word", "rank")


def by_rank(ranked: DataFrame, most: int = RANKED_WORDS) -> DataFrame:
    """(word, weight): the words of the highest rank, from a tenth of the least rank to the largest."""
    ends = ranked.agg(F.min("rank").alias("least"), F.max("rank").alias("largest"))
    top = ranked.orderBy(F.round("rank", 9).desc(), "word").limit(most)
    low = F.col("least") / 10
    return top.crossJoin(F.broadcast(ends)).select("word", ((F.col("rank") - low) / (F.col("largest") - low)).alias("weight"))


def combined(first: DataFrame, second: DataFrame, pattern: str = PATTERN, stop: list[str] = WITHOUT_MEANING) -> DataFrame:
    """(word, weight, category) from words by tf-idf and by rank: shares are added, words that follow the pattern gain, and what is too
    short, too long, too light without a pattern, or without meaning goes.
    """
    both = first.select("word", (F.col("weight") * TF_IDF_SHARE).alias("weight")).unionByName(second.select("word", (F.col("weight") * RANK_SHARE).alias("weight")))
    own = both.groupBy("word").agg(F.sum("weight").alias("weight")).withColumn("follows", F.col("word").rlike(pattern))
    own = own.withColumn("weight", F.col("weight") * F.when(F.col("follows"), GAIN).otherwise(1.0))
    kept = own.where(F.length("word").between(SHORTEST, LONGEST) & (F.col("follows") | (F.col("weight") > LEAST)) & ~F.col("word").isin(stop))
    return kept.select("word", "weight", band(F.col("weight")).alias("category"))


def band(weight: Column) -> Column:
    return F.when(weight > HIGH, "high_weight").when(weight > MIDDLE, "legal_pattern").otherwise("medium_weight")

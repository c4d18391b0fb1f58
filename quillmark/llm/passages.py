"""Removal of passages that documents share, located by sharded automata over words.

Words are runs without ASCII white space, compared as they are.  A window is `window` consecutive words of one document; it
is a repeat if the same words also start in a document with a smaller id.  Words that a repeat covers are removed.

1. Each window picks the smallest hash of the short phrases (`GRAM` words) in it, its anchor, so that equal windows pick
   equal anchors.  Neighbouring windows with one anchor are one stretch: a row of numbers for some sixteen words.
2. Recurring passages are confirmed in two steps.  Stretches that are equal as a whole are counted; of each content the
   first document lends it to the later ones.  Where an anchor has stretches of several contents, their windows are
   counted one by one, taken from one document for each content: a group of copies of any size is one of them.
3. The lenders' passages are dealt into shards.  In each, an automaton is compiled of the passages' consecutive blocks of
   half a window, one of which lies within any window.  The documents that borrow from a shard's lenders are streamed
   through its automaton in parts of a bounded size, which locates every occurrence of a block; the windows about it are looked
   up among the lenders' windows and compared word by word.  A window is removed only if all its words are found in a lender
   with a smaller id.
4. What is found for a document is joined to it, and the words left are put together.

A document whose anchors recur nowhere holds no occurrence, so that only the others are sent to automata, each to the
shards that it borrows from.  Tables between the steps are numbers; a hot passage is one row of a table whose join with the
documents that hold it can be split, and its documents go to as many parts as they need.  The hashes of steps 1 and 2 (128
bits with the anchor, for each content or window) only choose lenders; what is removed has been compared.

Null texts have no words.  Rows with a null id are left as they are and lend nothing.  Rows that repeat an id do not lend to
each other; each is taken by its own text.  Columns beyond id and text come back if `keep` asks for them.  Memory is bounded
by the longest text and by the longest run of passages that one document lends.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .common import materialize
from .minhash import mix

#: Words of the phrases that anchors are chosen from, for windows of fifty words; shorter windows take two fifths.
GRAM = 20
#: Words of passages in a shard, and bytes of text that are streamed through an automaton in one part.
SHARD_WORDS, PART_BYTES = 30_000, 2_000_000
#: Odd numbers that rolling hashes are made with.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def words_of(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(where each text's words begin among all words, all words)."""
    offsets, every = common.split_words(texts, ascii_only=True)
    full = pc.greater(pc.binary_length(every), 0)
    return np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])[offsets], every.filter(full)


def word_hashes(words: pa.Array) -> np.ndarray:
    coded = words.dictionary_encode()
    if not len(coded):
        return np.zeros(0, np.uint64)
    own = mix(pd.util.hash_array(coded.dictionary.to_numpy(zero_copy_only=False).astype(object), categorize=False))
    return own[coded.indices.to_numpy(zero_copy_only=False)]


class Rolling:
    """Hashes of any stretch of a sequence of numbers, from running sums."""

    def __init__(self, numbers: np.ndarray, base: int):
        n = len(numbers)
        powers = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, base, np.uint64)]))
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(numbers * powers[:n])])
        self.back = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, pow(base, -1, 2**64), np.uint64)]))

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[begin]) * self.back[begin])


def window_starts(ends: np.ndarray, window: int) -> np.ndarray:
    """Where windows start among all words: no window goes beyond its text."""
    count = np.maximum(np.diff(ends) - window + 1, 0)
    return common.gather(np.arange(int(ends[-1])), ends[:-1], count)


def sliding_least(values: np.ndarray, size: int) -> np.ndarray:
    """The smallest of each `size` consecutive values."""
    have, out = 1, values
    while have < size:
        step = min(have, size - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def stretches(texts: pa.Array, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """(row, anchor, content, windows, start in the text) of every stretch of windows with one anchor."""
    ends, words = words_of(texts)
    starts = window_starts(ends, window)
    if not len(starts):
        return tuple(np.zeros(0, t) for t in (np.int64, np.uint64, np.uint64, np.int64, np.int64))
    hashed = word_hashes(words)
    rolling, at = Rolling(hashed, BASES[0]), np.arange(len(hashed) - gram + 1)
    anchor = sliding_least(rolling.of(at, at + gram), window - gram + 1)[starts]
    first = np.flatnonzero(np.concatenate([[True], (np.diff(starts) != 1) | (anchor[1:] != anchor[:-1])]))
    count = np.diff(np.concatenate([first, [len(starts)]]))
    begin = starts[first]
    row = np.searchsorted(ends, begin, side="right") - 1
    content = Rolling(mix(hashed), BASES[1]).of(begin, begin + count + window - 1)
    return row, anchor[first], content, count, begin - ends[row]


def texts_of_rows(df: DataFrame, key: str, text: str) -> DataFrame:
    """(id, h, text): rows are known by their id and a hash of their text."""
    return df.select(F.col(key).alias("id"), F.xxhash64(F.col(text)).alias("h"), F.col(text).alias("text"))


def stretch_rows(rows: DataFrame, window: int, gram: int) -> DataFrame:
    """(anchor, s, n, id, h, lo) of all rows with an id."""
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch, "text"):
                row, anchor, content, count, lo = stretches(common.texts_of(part), window, gram)
                yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(content.view(np.int64)), pa.array(count), part.column("id").take(pa.array(row)), part.column("h").take(pa.array(row)), pa.array(lo)], ["anchor", "s", "n", "id", "h", "lo"])

    common.bounded_batches(rows.sparkSession)
    return rows.where("id IS NOT NULL").mapInArrow(run, f"anchor long, s long, n long, id {kind}, h long, lo long")


def window_rows(rows: DataFrame, some: DataFrame, window: int) -> DataFrame:
    """(anchor, w, s, id, last) of every window of the stretches `some` (anchor, s, n, id, h, lo, last)."""
    kind = rows.schema["id"].dataType.simpleString()
    lent = some.groupBy("id", "h").agg(F.collect_list(F.struct("anchor", "s", "n", "lo", "last")).alias("own"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch, "text"):
                ends, words = words_of(common.texts_of(part))
                rolling = Rolling(word_hashes(words), BASES[0])
                own = part.column("own")
                row = np.repeat(np.arange(part.num_rows), pc.list_value_length(own).to_numpy(zero_copy_only=False))
                fields = dict(zip([f.name for f in own.type.value_type], own.flatten().flatten(), strict=True))
                count, lo = (fields[c].to_numpy(zero_copy_only=False) for c in ("n", "lo"))
                begin = common.gather(np.arange(int(ends[-1]) + 1), ends[row] + lo, count)
                which, source = pa.array(np.repeat(np.arange(len(row)), count)), pa.array(np.repeat(row, count))
                columns = [fields["anchor"].take(which), pa.array(rolling.of(begin, begin + window).view(np.int64)), fields["s"].take(which), part.column("id").take(source), fields["last"].take(which)]
                yield pa.RecordBatch.from_arrays(columns, ["anchor", "w", "s", "id", "last"])

    common.bounded_batches(rows.sparkSession)
    read = rows.join(met(materialize(lent, "several")), ["id", "h"]).select("id", "h", "text", "own")
    return read.mapInArrow(run, f"anchor long, w long, s long, id {kind}, last {kind}")


def met(df: DataFrame) -> DataFrame:
    """A table of numbers as the side of a join that is looked up, part by part: texts are exchanged to it but not sorted, alike at
    any size.
    """
    return df.hint("shuffle_hash")


def confirmed(rows: DataFrame, window: int, gram: int) -> tuple[DataFrame, DataFrame]:
    """(borrowers (id, h, lid, lh), lent stretches (id, h, lo, n)): who shares windows with which document of a smaller id."""
    content = ["anchor", "s"]
    found = materialize(stretch_rows(rows, window, gram), "stretches")
    anchors = found.groupBy("anchor").agg(F.min("id").alias("least"), F.max("id").alias("most"), F.min("s").alias("a"), F.max("s").alias("b"))
    anchors = materialize(anchors.where("least < most").select("anchor", F.expr("a <> b").alias("several")), "anchors")
    live = materialize(found.join(met(anchors), "anchor"), "live")
    whole = live.groupBy(*content).agg(F.min(F.struct("id", "h", "lo", "n")).alias("first"), F.max("id").alias("last"), F.first("several").alias("several"))
    whole = materialize(whole, "contents")
    shared = whole.where("first.id < last")
    lenders = shared.select(*content, F.col("first.id").alias("lid"), F.col("first.h").alias("lh"))

    windows = materialize(window_rows(rows, whole.where("several").select(*content, "first.*", "last"), window), "windows")
    first = windows.groupBy("anchor", "w").agg(F.min(F.struct("id", "s")).alias("lend"), F.max("last").alias("most"), F.count("*").alias("n"))
    first = materialize(first.where("n > 1 AND lend.id < most").select("anchor", "w", "lend"), "first")
    later = windows.join(met(first), ["anchor", "w"]).where("last > lend.id").select(*content, F.col("lend.s").alias("ls")).distinct()
    lent = whole.select("anchor", F.col("s").alias("ls"), F.col("first.id").alias("lid"), F.col("first.h").alias("lh"), "first.lo", "first.n")
    later = materialize(later.join(lent, ["anchor", "ls"]).select(*content, "lid", "lh", "lo", "n"), "later")

    lenders = materialize(lenders.union(later.select(*content, "lid", "lh")).distinct(), "lenders")
    borrowers = live.select(*content, "id", "h").join(met(lenders), content).where("id > lid").select("id", "h", "lid", "lh").distinct()
    lent = shared.select("first.id", "first.h", "first.lo", "first.n").union(later.select("lid", "lh", "lo", "n")).distinct()
    return materialize(borrowers, "borrowers"), materialize(lent, "lent")


def lent_passages(rows: DataFrame, lent: DataFrame, window: int) -> DataFrame:
    """(lid, lh, passage, words): the lent stretches as passages; those that meet are one."""
    kind = rows.schema["id"].dataType.simpleString()
    ranges = lent.groupBy("id", "h").agg(F.sort_array(F.collect_list(F.struct("lo", "n"))).alias("own"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch, "text"):
                ends, words = words_of(common.texts_of(part))
                source, passages, sizes, starts = [], [], [], []
                for i, own in enumerate(part.column("own").to_pylist()):
                    merged: list[list[int]] = []
                    for r in own:
                        if merged and r["lo"] <= merged[-1][1]:
                            merged[-1][1] = max(merged[-1][1], r["lo"] + r["n"])
                        else:
                            merged.append([r["lo"], r["lo"] + r["n"]])
                    for a, b in merged:
                        source.append(i)
                        sizes.append(b - a + window - 1)
                        starts.append(a)
                        passages.append(" ".join(words.slice(int(ends[i]) + a, sizes[-1]).to_pylist()))
                at = pa.array(source, pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("id").take(at), part.column("h").take(at), pa.array(starts, pa.int64()), pa.array(passages, pa.string()), pa.array(sizes, pa.int64())], ["lid", "lh", "start", "passage", "words"])

    common.bounded_batches(rows.sparkSession)
    read = rows.join(met(materialize(ranges, "ranges")), ["id", "h"]).select("id", "h", "text", "own")
    out = read.mapInArrow(run, f"lid {kind}, lh long, start long, passage string, words long")
    return out.dropDuplicates(["lid", "lh", "start"]).drop("start")  # rows that repeat lend once


class Shard:
    """The passages of a shard: an automaton of their blocks, and their windows in the order of a hash."""

    def __init__(self, ids: np.ndarray, passages: pa.Array, window: int):
        self.window, self.block = window, (window + 1) // 2
        ends, words = words_of(passages)
        coded = words.dictionary_encode()
        self.vocabulary = coded.dictionary
        self.codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        every = (self.codes + 1).tolist()  # 0 is any other word
        for a, b in zip(ends.tolist(), ends[1:].tolist(), strict=False):
            for k in range(a, b - self.block + 1, self.block):
                self.automaton.add_word(tuple(every[k : k + self.block]), 1)
        self.automaton.make_automaton()
        starts = window_starts(ends, window)
        lender = ids[np.searchsorted(ends, starts, side="right") - 1]
        hashed = self.hashed(self.codes).of(starts, starts + window)
        order = np.lexsort((lender, hashed))  # of equal windows the first is that of the smallest id
        self.windows, self.starts, self.lender = hashed[order], starts[order], lender[order]

    @staticmethod
    def hashed(codes: np.ndarray) -> Rolling:
        return Rolling(mix(codes.astype(np.uint64) + np.uint64(2)), BASES[0])

    def number(self, words: pa.Array) -> np.ndarray:
        return pc.fill_null(pc.index_in(words, self.vocabulary), -1).to_numpy(zero_copy_only=False).astype(np.int64)

    def repeats(self, key, codes: np.ndarray) -> list[tuple[int, int]]:
        """The stretches of a document's words that are covered by windows of lenders with a smaller id."""
        if len(codes) < self.window:
            return []
        hits = np.fromiter((end for end, _ in self.automaton.iter(tuple((codes + 1).tolist()))), np.int64)
        return self.confirm(key, codes, hits)

    def confirm(self, key, codes: np.ndarray, hits: np.ndarray) -> list[tuple[int, int]]:
        """Look up the windows about the blocks that end at `hits`, and compare them word by word."""
        n = len(codes) - self.window + 1
        steps = np.zeros(n + 1, np.int64)
        np.add.at(steps, np.clip(hits - self.window + 1, 0, n), 1)
        np.add.at(steps, np.clip(hits - self.block + 2, 0, n), -1)
        starts = np.flatnonzero(np.cumsum(steps[:n]) > 0)
        if not len(starts):
            return []
        hashed = self.hashed(codes).of(starts, starts + self.window)
        at = np.minimum(np.searchsorted(self.windows, hashed), len(self.windows) - 1)
        good = (self.windows[at] == hashed) & (self.lender[at] < key)
        starts, theirs = starts[good], self.starts[at[good]]
        same = np.ones(len(starts), bool)
        for k in range(self.window):
            same &= codes[starts + k] == self.codes[theirs + k]
        return merged(starts[same], self.window)


def merged(starts: np.ndarray, window: int) -> list[tuple[int, int]]:
    """What windows at these starts cover, as stretches."""
    if not len(starts):
        return []
    first = np.flatnonzero(np.concatenate([[True], np.diff(starts) > window]))
    last = np.concatenate([first[1:] - 1, [len(starts) - 1]])
    return list(zip(starts[first].tolist(), (starts[last] + window).tolist(), strict=True))


def occurrences(rows: DataFrame, borrowers: DataFrame, passages: DataFrame, window: int) -> DataFrame:
    """(id, h, a, b): the words of borrowers that occur in passages of lenders with smaller ids."""
    kind = rows.schema["id"].dataType.simpleString()
    size = passages.agg(F.sum("words")).first()[0] or 0
    shards = max(1, -(-size // SHARD_WORDS))
    shard = F.pmod(F.xxhash64("lid", "lh"), F.lit(shards)).alias("shard")
    routes = materialize(borrowers.select("id", "h", shard).distinct(), "routes")
    sent = materialize(rows.join(met(routes), ["id", "h"]).select("shard", "id", "h", "text"), "sent")
    parts = sent.groupBy("shard").agg((1 + F.sum(F.octet_length("text")) / PART_BYTES).cast("long").alias("parts"))
    parts = materialize(parts, "parts")
    left = sent.join(parts, "shard").withColumn("part", F.pmod(F.monotonically_increasing_id(), F.col("parts"))).drop("parts")
    right = passages.select(shard, "lid", "passage").join(parts, "shard").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("parts")

    def run(texts: pa.Table, lent: pa.Table) -> pa.Table:
        out: dict[str, list] = {"row": [], "a": [], "b": []}
        if len(lent) and len(texts):
            own = Shard(lent.column("lid").to_numpy(), lent.column("passage").combine_chunks().cast(pa.string()), window)
            texts = texts.combine_chunks()
            for batch in texts.to_batches():
                ends, words = words_of(common.texts_of(batch))
                codes = own.number(words)
                for i, key in enumerate(batch.column("id").to_pylist()):
                    for a, b in own.repeats(key, codes[ends[i] : ends[i + 1]]):
                        out["row"].append(i)
                        out["a"].append(a)
                        out["b"].append(b)
        at = pa.array(out["row"], pa.int64())
        return pa.table({"id": texts.column("id").take(at), "h": texts.column("h").take(at), "a": pa.array(out["a"], pa.int64()), "b": pa.array(out["b"], pa.int64())})

    return left.groupBy("shard", "part").cogroup(right.groupBy("shard", "part")).applyInArrow(run, f"id {kind}, h long, a long, b long")


def remove_repeats(df: DataFrame, key: str = "doc_id", text: str = "text", window: int = 50, keep: list[str | Column] = ()) -> DataFrame:
    """(key, n_words, n_removed, kept_text, *keep): one row per row of `df`; the words left are joined by one space."""
    gram = min(GRAM, max(1, window * 2 // 5))
    rows = texts_of_rows(df, key, text)
    borrowers, lent = confirmed(rows, window, gram)
    passages = materialize(lent_passages(rows, lent, window), "passages")
    found = materialize(occurrences(rows, borrowers, passages, window).distinct(), "occurrences")
    gone = materialize(found.groupBy("id", "h").agg(F.collect_list(F.struct("a", "b")).alias("gone")), "gone")

    kept = df.select(*keep).columns
    own = [f"_{i}" for i in range(len(kept))]
    inner = df.select(F.col(key), F.xxhash64(F.col(text)), F.col(text), *[F.col(c) if isinstance(c, str) else c for c in keep]).toDF("id", "h", "text", *own)
    types = dict(inner.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch, "text"):
                ends, words = words_of(common.texts_of(part))
                away = np.zeros(int(ends[-1]) + 1, np.int64)
                for i, stretch in enumerate(part.column("gone")):
                    for s in stretch.as_py() or ():
                        away[ends[i] + s["a"]] += 1
                        away[ends[i] + s["b"]] -= 1
                stays = np.cumsum(away[:-1]) == 0
                left = np.concatenate([[0], np.cumsum(stays)])[ends]
                texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(left.astype(np.int32)), words.filter(pa.array(stays))), " ")
                n = np.diff(ends)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(n), pa.array(n - np.diff(left)), texts, *(part.column(c) for c in own)], ["id", "n_words", "n_removed", "kept_text", *own])

    common.bounded_batches(df.sparkSession)
    read = inner.join(met(gone), ["id", "h"], "left").select("id", "text", "gone", *own)
    schema = f"id {types['id']}, n_words long, n_removed long, kept_text string" + "".join(f", {c} {types[c]}" for c in own)
    return read.mapInArrow(run, schema).toDF(key, "n_words", "n_removed", "kept_text", *kept)

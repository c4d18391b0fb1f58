"""Best-fit packing with a grouping genetic algorithm on islands.

Documents are encoded, ended with a separator id and cut only if they are longer than a sequence.  Pieces are dealt by a
hash into shards of bounded size; each shard is evolved on several islands, which are groups of their own.  An individual
is a set of bins.  Crossover injects whole bins of one parent, chosen among the fuller half by rank, into the other, removes
bins that hold one of their pieces again, and best-fits the displaced pieces; mutation dissolves some of the emptiest bins
and as many others, and fills new ones from their pieces, each as exactly as two more pieces can.  Evolution ends early only
where no solution can have fewer bins.  After each epoch every island's best individual moves on to the next island of its
shard.  Bins of the best solutions that stayed too empty are dissolved, and their pieces are packed once more in shards of
their own; that arrangement is taken if it has fewer bins.

Pieces carry a number that differs between neighbours, so that repeated rows are dealt over all shards like any others.
Null texts count as empty (one piece, the separator).  Ties in length are broken by id, start and checksum; rows that are
equal in all of them are interchangeable.  Ids are whole numbers; a null id is kept.  Further columns are ignored; an empty
table gives none.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe, common
from .common import materialize

#: Ids of a sequence, and the id that ends a document.
CAPACITY, SEPARATOR = 4_096, 1
#: Pieces of a shard (on average), islands of a shard, epochs, generations of an epoch, individuals of an island.
SHARD, ISLANDS, EPOCHS, GENERATIONS, POPULATION = 8_192, 2, 2, 24, 6
#: Shares of a parent's fuller half that are injected and of bins that mutation dissolves; bins of a final solution below
#: this fill are packed again.
INJECTED, DISSOLVED, REPACKED = 0.1, (0.02, 0.05, 0.1), 0.98
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces_of(df: DataFrame, model: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, salt) of all documents; salt counts a task's pieces."""
    seen = [0]  # pieces of the task so far

    def row(part: pa.RecordBatch, ids: np.ndarray, offsets: np.ndarray, own: bpe.Encoder) -> pa.RecordBatch:
        sizes = np.diff(offsets) + 1
        full = np.full(int(sizes.sum()), SEPARATOR, "<u4")
        ends = np.cumsum(sizes)
        inside = np.ones(len(full), bool)
        inside[ends - 1] = False
        full[inside] = ids
        count = -(-sizes // capacity)
        piece = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        start = piece * capacity
        length = np.minimum(capacity, np.repeat(sizes, count) - start)
        raw, at = memoryview(full).cast("B"), (np.repeat(ends - sizes, count) + start).tolist()
        sums = [zlib.crc32(raw[4 * a : 4 * (a + n)]) for a, n in zip(at, length.tolist(), strict=True)]
        keys = part.column("doc_id").take(pa.array(np.repeat(np.arange(len(sizes)), count)))
        salt = seen[0] + np.arange(len(piece))
        seen[0] += len(piece)
        return pa.RecordBatch.from_arrays([keys, pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(sums, pa.int64()), pa.array(salt)], ["doc_id", "piece", "start", "length", "ids_crc32", "salt"])

    return bpe.map_encoded(df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")), model, f"{PIECES}, salt long", row)


# ---------------------------------------------------------------------------------------------------------------------
# one island


class Rooms:
    """Bins by the room that is left in them, with a bit set of the rooms there are."""

    def __init__(self, rooms: Iterable[int], capacity: int):
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.bits = 0
        for k, room in enumerate(rooms):
            self.add(k, int(room))

    def add(self, k: int, room: int) -> None:
        self.bins[room].append(k)
        self.bits |= 1 << room

    def take(self, size: int) -> tuple[int, int] | None:
        """A bin with the least room that suffices, and its room."""
        enough = self.bits >> size
        if not enough:
            return None
        room = size + (enough & -enough).bit_length() - 1
        own = self.bins[room]
        k = own.pop()
        if not own:
            self.bits &= ~(1 << room)
        return k, room


def numbered(bins: np.ndarray) -> np.ndarray:
    """The same bins numbered from 0 without gaps."""
    return np.unique(bins, return_inverse=True)[1]


def best_fit(items: np.ndarray, size: np.ndarray, capacity: int, bins: np.ndarray) -> np.ndarray:
    """`bins` (each item's bin, or -1) with the given items put, in their order, where least room is left over."""
    bins = bins.copy()
    placed = bins >= 0
    count = int(bins.max()) + 1 if placed.any() else 0
    rooms = Rooms(capacity - np.bincount(bins[placed], weights=size[placed], minlength=count), capacity)
    for i, own in zip(items.tolist(), size[items].tolist(), strict=True):
        k, room = rooms.take(own) or (count, capacity)
        count += k == count
        bins[i] = k
        rooms.add(k, room - own)
    return bins


def refill(items: np.ndarray, size: np.ndarray, capacity: int, bins: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """`bins` with the given items in new ones: each begins with the longest item left and is completed by the two that leave
    least room, after others drawn at random while far more than two would go in.
    """
    bins = bins.copy()
    count, left = int(bins.max(initial=-1)) + 1, len(items)
    waiting: dict[int, list[int]] = {}
    for i, own in zip(items.tolist(), size[items].tolist(), strict=True):
        waiting.setdefault(own, []).append(i)
    many = np.zeros(capacity + 1, np.int64)
    for own, which in waiting.items():
        many[own] = len(which)
    top = capacity
    while left:
        while not many[top]:
            top -= 1
        room, own = capacity, top
        while own:
            bins[waiting[own].pop()] = count
            many[own] -= 1
            left -= 1
            room -= own
            have = np.flatnonzero(many[: room + 1])
            if not len(have):
                own = 0
            elif room > 3 * have[-1]:
                own = int(rng.choice(have))
            else:
                below = np.zeros(room + 1, np.int64)
                below[have] = have
                below = np.maximum.accumulate(below)
                other = below[room - have]
                lone = (other == have) & (many[have] < 2)
                other[lone] = below[have[lone] - 1]
                own = int(have[len(have) - 1 - np.argmax((have + other)[::-1])])
        count += 1
    return bins


def fitness(bins: np.ndarray, size: np.ndarray, capacity: int) -> tuple[int, float]:
    """To be least: the number of bins, then how evenly they are filled."""
    fill = np.bincount(bins, weights=size) / capacity
    return len(fill), -float(fill @ fill)


def crossover(into: np.ndarray, giver: np.ndarray, size: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """Inject whole bins out of the fuller half of `giver`, drop bins with one of their items, best-fit what that displaced."""
    fill = np.bincount(giver, weights=size)
    fuller = np.argsort(-fill, kind="stable")[: max(1, len(fill) // 2)]
    taken = np.isin(giver, rng.choice(fuller, max(1, int(INJECTED * len(fuller))), replace=False))
    displaced = np.isin(into, into[taken]) & ~taken
    child = np.where(taken, giver + int(into.max()) + 1, into)
    child[~displaced] = numbered(child[~displaced])
    child[displaced] = -1
    return best_fit(np.flatnonzero(displaced), size, capacity, child)


def mutate(bins: np.ndarray, size: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """Dissolve some of the emptiest bins and as many others, and fill new bins with their items."""
    fill = np.bincount(bins, weights=size)
    few = min(len(fill), max(2, int(len(fill) * rng.choice(DISSOLVED))))
    gone = np.concatenate([np.argsort(fill, kind="stable")[:few], rng.choice(len(fill), few, replace=False)])
    loose = np.isin(bins, gone)
    child = bins.copy()
    child[~loose] = numbered(child[~loose])
    child[loose] = -1
    return refill(np.flatnonzero(loose), size, capacity, child, rng)


def evolve(size: np.ndarray, seed: int, capacity: int = CAPACITY, elites: Iterable[np.ndarray] = (), generations: int = GENERATIONS, population: int = POPULATION) -> np.ndarray:
    """Each item's bin in the best individual of an island after some generations.  Items are numbered from the longest."""
    rng = np.random.default_rng(seed)
    least = -(-int(size.sum()) // capacity)
    ranked = [(fitness(b, size, capacity), k, b) for k, b in enumerate(elites)]
    for k in range(len(ranked), population):
        if any(worth[0] == least for worth, _, _ in ranked):
            break
        noise = rng.uniform(0, 0.02 * k * capacity, len(size))
        bins = best_fit(np.argsort(-(size + noise), kind="stable"), size, capacity, np.full(len(size), -1))
        ranked.append((fitness(bins, size, capacity), k, bins))
    ranked.sort(key=lambda x: x[:2])
    for n in range(generations):
        if ranked[0][0][0] == least:  # no solution has fewer
            break
        first, second = sorted(rng.choice(len(ranked), 2, replace=False))
        child = mutate(crossover(ranked[first][2], ranked[second][2], size, capacity, rng), size, capacity, rng)
        worth = fitness(child, size, capacity)
        if worth < ranked[-1][0]:
            ranked[-1] = (worth, population + n, child)
            ranked.sort(key=lambda x: x[:2])
    return ranked[0][2]


def ordered(frame: pd.DataFrame) -> pd.DataFrame:
    """A shard's pieces in the order that individuals number them."""
    return frame.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True], kind="stable").reset_index(drop=True)


# ---------------------------------------------------------------------------------------------------------------------
# islands


def solve(pieces: DataFrame, shards: int, capacity: int, islands: int, epochs: int) -> DataFrame:
    """(shard, bins): for each shard the best solution of its islands, a 32-bit bin number for each piece in order."""
    narrow = pieces.select("shard", "doc_id", "start", "length", "ids_crc32")
    replicas = narrow.withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))))
    state = "shard long, island int, worth long, evenness double, bins binary"

    def grow(frame: pd.DataFrame, elites: list[bytes], epoch: int) -> pd.DataFrame:
        shard, island = int(frame.shard.iloc[0]), int(frame.island.iloc[0])
        size = ordered(frame).length.to_numpy(np.int64)
        best = evolve(size, hash((shard, island, epoch)) & 0x7FFFFFFF, capacity, [np.frombuffer(e, "<i4").astype(np.int64) for e in elites])
        worth, evenness = fitness(best, size, capacity)
        return pd.DataFrame({"shard": [shard], "island": [island], "worth": [worth], "evenness": [evenness], "bins": [best.astype("<i4").tobytes()]})

    def go_on(epoch: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
        return lambda frame, guests: grow(frame, guests.sort_values(["worth", "evenness"], kind="stable").bins.tolist(), epoch)

    elite = materialize(replicas.groupBy("shard", "island").applyInPandas(lambda frame: grow(frame, [], 0), state), "elites")
    for epoch in range(1, epochs):
        moved = elite.select("shard", F.explode(F.array(F.col("island"), (F.col("island") + 1) % islands)).alias("island"), "worth", "evenness", "bins").distinct()
        elite = materialize(replicas.groupBy("shard", "island").cogroup(moved.groupBy("shard", "island")).applyInPandas(go_on(epoch), state), "elites")
    return elite.groupBy("shard").agg(F.min_by("bins", F.struct("worth", "evenness", "island")).alias("bins"))


def pack_once(pieces: DataFrame, count: int, capacity: int, islands: int, epochs: int, first: int) -> DataFrame:
    """The pieces with sequence_id (from `first`), offset and the sequence's fill."""
    shards = max(1, -(-count // SHARD))
    sharded = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "length", "salt"), F.lit(shards)))
    best = materialize(solve(sharded, shards, capacity, islands, epochs), "solutions")

    def place(frame: pd.DataFrame, solution: pd.DataFrame) -> pd.DataFrame:
        frame = ordered(frame)
        own = np.frombuffer(solution.bins.iloc[0], "<i4")
        frame["sequence_id"] = first + own.astype(np.int64) * shards + frame.shard
        frame["offset"] = frame.groupby("sequence_id").length.cumsum() - frame.length
        frame["fill"] = frame.groupby("sequence_id").length.transform("sum")
        return frame[["doc_id", "piece", "start", "length", "ids_crc32", "salt", "sequence_id", "offset", "fill"]]

    return sharded.groupBy("shard").cogroup(best.groupBy("shard")).applyInPandas(place, f"{PIECES}, salt long, sequence_id long, offset long, fill long")


def pack(pieces: DataFrame, capacity: int = CAPACITY, islands: int = ISLANDS, epochs: int = EPOCHS) -> DataFrame:
    """The pieces (written ones, with a salt) with their sequence_id and offset."""
    result = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    count = pieces.count()
    if not count:
        return pieces.select(*result[:5], F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    once = materialize(pack_once(pieces, count, capacity, islands, epochs, 0), "packed")
    full = F.col("fill") >= int(REPACKED * capacity)
    loose = once.where(~full)
    again = loose.agg(F.count("*").alias("pieces"), F.count_if(F.col("offset") == 0).alias("bins")).first()
    if again.bins < 2:
        return once.select(*result)
    top = once.agg(F.max("sequence_id")).first()[0] + 1
    twice = materialize(pack_once(loose.select(*result[:5], "salt"), again.pieces, capacity, islands, epochs, top), "packed-again")
    if twice.where("offset = 0").count() >= again.bins:
        return once.select(*result)
    return once.where(full).select(*result).unionByName(twice.select(*result))


def pack_documents(df: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """Encode and pack documents; one row per piece."""
    model = bpe.prepare(df.sparkSession, df, tokenizer, text)
    return pack(materialize(pieces_of(df, model, key, text, capacity), "pieces"), capacity)

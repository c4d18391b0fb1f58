"""Words of texts without blanks: the likeliest path through the words that a text may be made of.

All words of a lexicon that begin at a character are arcs to where they end; a character that begins none is a word of its
own, as rare as can be.  The path with the greatest product of word frequencies is found backwards, in time of a text's length times that of
the longest word; of equal paths the one with the longer first word is taken.  Runs of Latin letters and digits are words as they are, white
space parts words, and any other sign is a word.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Texts are cut into runs of Han characters, Latin words and numbers, and single other signs.
RUNS = re.compile(r"[一-鿿]+|[A-Za-z0-9]+(?:\.[0-9]+)?|\S")


class Segmenter:
    """A lexicon of words with their frequencies, ready to cut texts."""

    def __init__(self, frequencies: Mapping[str, int]):
        total = sum(frequencies.values()) or 1
        self.least = -math.log(total)  # a frequency of 1
        self.weights = {w: math.log(n) - math.log(total) for w, n in frequencies.items() if w and n > 0}
        self.longest: dict[str, int] = {}
        for w in self.weights:
            self.longest[w[0]] = max(self.longest.get(w[0], 1), len(w))

    def cut(self, run: str) -> list[str]:
        """The words of a run of characters."""
        n = len(run)
        best, step = [0.0] * (n + 1), [1] * (n + 1)
        for i in range(n - 1, -1, -1):
            best[i], step[i] = self.weights.get(run[i], self.least) + best[i + 1], 1
            for size in range(2, min(self.longest.get(run[i], 1), n - i) + 1):
                own = self.weights.get(run[i : i + size])
                if own is not None and own + best[i + size] >= best[i]:
                    best[i], step[i] = own + best[i + size], size
        out, i = [], 0
        while i < n:
            out.append(run[i : i + step[i]])
            i += step[i]
        return out

    def words(self, text: str | None) -> list[str]:
        return [w for run in RUNS.findall(text or "") for w in (self.cut(run) if "一" <= run[0] <= "鿿" else [run])]


def segmented(df: DataFrame, segmenter: Segmenter, text: Column, name: str = "words") -> DataFrame:
    """`df` with the words of a text as its last column; the lexicon travels with the tasks."""
    names = df.columns
    own = [f"c{i}" for i in range(len(names))]
    inner = df.select(*names, text.cast("string")).toDF(*own, "text")
    types = dict(inner.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([segmenter.words(t) for t in batch.column("text").to_pylist()], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), found], [*own, "words"])

    return inner.mapInArrow(run, ", ".join(f"{c} {types[c]}" for c in own) + ", words array<string>").toDF(*names, name)


def lexicon_matches(words: Column, lexicon: Column) -> Column:
    """The words that a lexicon, a map from words to weights, has, as structs (word, weight), in their order."""
    return F.transform(F.filter(words, lambda w: F.map_contains_key(lexicon, w)), lambda w: F.struct(w.alias("word"), F.element_at(lexicon, w).alias("weight")))

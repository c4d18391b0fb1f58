"""Toxicity scores of text restored by a noisy-channel decoder.

Words that look disguised (digits or signs between or after letters, a separator between letters, a letter three times in a row, single letters in a row with
blanks or signs between them) are lattices: each character was written for itself, for a letter it resembles, as a
separator, or as one more repetition; signs and digits at the end may be punctuation.  A Viterbi search over the lattice, with the states' last two letters as context of a
character trigram model of the whole corpus, finds the likeliest plain text.  Words of the restored text are the features
of a logistic regression.

Labels are learned from distinct texts of the labelled rows given to `fit`; rows with a null label or text teach nothing.
A null text counts as empty and gets the score of a text without any known word, as does every text if nothing or only one
class could be learned.  Rows are scored independently of each other; further columns are ignored.
"""

from __future__ import annotations

import functools
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Labelled texts that the classifier is fitted on at most (about, chosen by a hash), its words, and what large weights cost.
LABELLED, WORDS, RIDGE = 20_000, 3_000, 0.05  # words: below 2 ** 15
#: Letters that stand for all words that begin with them.
STEM = 4
#: Letters that a sign may stand for.
LOOKALIKES = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l"}
SEPARATORS = " .-_*"
#: Minus logarithms of the channel's probabilities: a letter for itself, one more repetition, a lookalike, a sign for itself, a separator that is one, one that hides inside of a word.
SELF, AGAIN, ALIKE, SIGN, APART, INSIDE = (-math.log(p) for p in (0.9, 0.3, 0.3, 0.02, 0.5, 0.3))
#: Symbols of the language model: a word's end, a to z, Latin-1's letters, any other letter.
SYMBOLS = 64
SPACED = re.compile(r"(?<![^\s])[^\W_](?:[ ._*-][^\W_]){2,}(?![^\s,;:!?.])")
SPACED_RE2 = r"(^|\s)[\pL\pN][ ._*-][\pL\pN][ ._*-][\pL\pN]"
DISGUISED_RE2 = r"[\pL][0-9@$!|+(€£]+[\pL]|^[0-9@$!|+(€£]{1,3}[\pL]{2}|[\pL][0-9@$!|+€£]+$|[\pL][._*-][\pL]|" + "|".join(f"{c}{c}{c}" for c in "abcdefghijklmnopqrstuvwxyz")
TRIM = "".join(chr(c) for c in range(33, 127) if not chr(c).isalpha()) + "«»“”„’‘…–—¿¡"
#: Of these, what is never a letter at the end of a word; the others are letters or punctuation there, at equal prices.
PUNCTUATION = "".join(c for c in TRIM if c == "(" or c not in LOOKALIKES)


def symbol(c: str) -> int:
    if "a" <= c <= "z":
        return ord(c) - 96
    if "à" <= c <= "ÿ" and c != "÷" or c == "ß":
        return 27 + (31 if c == "ß" else ord(c) - 0xE0) % 32
    return 59 if c.isalpha() else 0


@functools.cache
def symbol_table() -> np.ndarray:
    table = np.zeros(0x110000, np.int64)
    for code in range(0x110000):
        c = chr(code)
        if c.isalpha():
            low = c.lower()
            table[code] = symbol(low[0])
    return table


# ---------------------------------------------------------------------------------------------------------------------
# language model


def trigram_counts(df: DataFrame, text: str = "text") -> np.ndarray:
    """Counts of all character trigrams of all texts; tasks send at most SYMBOLS cubed sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SYMBOLS**3, np.int64)
        for batch in batches:
            for part in common.slices(batch, text):
                code = np.frombuffer("\n".join(["", "", *common.texts_of(part, text).to_pylist(), "", ""]).encode("utf-32-le", "replace"), np.uint32)
                s = symbol_table()[code]
                s = s[np.concatenate([[True], (s[1:] != 0) | (s[:-1] != 0)])]
                total += np.bincount((s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:], minlength=SYMBOLS**3) if len(s) > 2 else 0
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["gram", "n"])

    common.bounded_batches(df.sparkSession)
    out = np.zeros(SYMBOLS**3, np.float64)
    for r in df.select(text).mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect():
        out[r.gram] = r.n
    return out.reshape(SYMBOLS, SYMBOLS, SYMBOLS)


def language_model(counts: np.ndarray) -> np.ndarray:
    """Minus log probabilities of the third symbol after two others, interpolated."""
    c3 = counts + 0.0
    c2, c1 = c3.sum(0), c3.sum((0, 1)) + 1.0
    p1 = c1 / c1.sum()
    p2 = (c2 + 5 * p1) / (c2.sum(1, keepdims=True) + 5)
    p3 = (c3 + 5 * p2) / (c3.sum(2, keepdims=True) + 5)
    return -np.log(p3).astype(np.float32)


def viterbi(seen: str, cost: np.ndarray, tail: int = 0) -> str:
    """The likeliest plain text (letters and blanks) for a disguised piece of text, whose last `tail` signs may be punctuation."""
    seen = seen.lower()
    start = (0, 0, "")  # symbols of the last two letters written, the last letter if it can be repeated
    best: dict[tuple, tuple[float, tuple | None]] = {start: (0.0, None)}
    for k, c in enumerate(seen):
        options = [(x, ALIKE) for x in LOOKALIKES.get(c, "")]
        if c.isalpha():
            options.append((c, SELF))
        elif c in SEPARATORS:
            options += [(" ", APART), ("", INSIDE)]
        else:
            options.append((" ", ALIKE if k >= len(seen) - tail else SIGN))
        following: dict[tuple, tuple[float, tuple | None]] = {}
        for (a, b, last), (spent, path) in best.items():
            for x, price in options:
                if x == "":
                    step, state, link = price, (a, b, last), path
                else:
                    s = symbol(x)
                    if s == 0 and b == 0:
                        step, state, link = price, (a, b, ""), path
                    else:
                        step, state, link = price + float(cost[a, b, s]), (b, s, x.strip()), (x, path)
                if state not in following or spent + step < following[state][0]:
                    following[state] = (spent + step, link)
            if last and any(x == last for x, _ in options):
                state = (a, b, last)
                if state not in following or spent + AGAIN < following[state][0]:
                    following[state] = (spent + AGAIN, path)
        best = following
    _, path = min(((spent + float(cost[a, b, 0]), i, path) for i, ((a, b, _), (spent, path)) in enumerate(best.items())), key=lambda x: x[:2])[1:]
    out = []
    while path:
        out.append(path[0])
        path = path[1]
    return "".join(reversed(out)).strip()


# ---------------------------------------------------------------------------------------------------------------------
# words of restored texts


@dataclass
class Words:
    """The (document, word) pairs of a slice of texts after restoration; longer words also count by their first letters."""

    document: np.ndarray
    word: np.ndarray
    vocabulary: pa.Array


class Restorer:
    def __init__(self, cost: np.ndarray):
        self.cost, self.memo = cost, {}

    def restore(self, piece: str) -> str:
        if piece not in self.memo:
            if len(self.memo) > 200_000:
                self.memo.clear()
            self.memo[piece] = viterbi(piece, self.cost, len(piece) - len(piece.rstrip(TRIM)))
        return self.memo[piece]

    def text(self, text: str) -> str:
        """A text with its disguised pieces replaced by what they stand for; all else is left as it is."""
        text = SPACED.sub(lambda m: self.restore(m[0]), text)

        def one(m: re.Match) -> str:
            core = m[0].rstrip(PUNCTUATION)
            if not pc.match_substring_regex(pa.array([core.lower()]), DISGUISED_RE2)[0].as_py():
                return m[0]
            plain = self.restore(core)
            return m[0] if plain == core.rstrip(TRIM).lower() else plain + m[0][len(core) :]

        return re.sub(r"\S+", one, text)

    def words(self, texts: pa.Array) -> Words:
        """Distinct words are looked at once for all texts of a slice."""
        low = pc.utf8_lower(texts)
        offsets, flat = common.split_words(low)
        coded = flat.dictionary_encode()
        plain = pc.utf8_trim(coded.dictionary, characters=TRIM)
        odd = pc.match_substring_regex(pc.utf8_rtrim(coded.dictionary, characters=PUNCTUATION), DISGUISED_RE2).to_numpy(zero_copy_only=False)
        documents = np.repeat(np.arange(len(texts)), np.diff(offsets))
        which = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        size = len(coded.dictionary)
        keep = ~odd[which] if len(which) else np.zeros(0, bool)
        more_words: list[str] = []
        more_documents, more_which = [], []
        if odd.any():
            restored: dict[int, list[int]] = {}
            for i in np.flatnonzero(odd).tolist():
                parts = self.restore(coded.dictionary[i].as_py().rstrip(PUNCTUATION)).split()
                restored[i] = list(range(size + len(more_words), size + len(more_words) + len(parts)))
                more_words += parts
            for at in np.flatnonzero(odd[which]).tolist():
                for k in restored[int(which[at])]:
                    more_documents.append(documents[at])
                    more_which.append(k)
        for i in np.flatnonzero(pc.match_substring_regex(low, SPACED_RE2).to_numpy(zero_copy_only=False)).tolist():
            for m in SPACED.finditer(low[i].as_py()):
                for word in self.restore(m[0]).split():
                    more_documents.append(i)
                    more_which.append(size + len(more_words))
                    more_words.append(word)
        vocabulary = pa.concat_arrays([plain.cast(pa.string()), pa.array(more_words, pa.string())]) if more_words else plain
        document, word = np.concatenate([documents[keep], np.array(more_documents, np.int64)]), np.concatenate([which[keep], np.array(more_which, np.int64)])
        long = pc.greater(pc.utf8_length(vocabulary), STEM).to_numpy(zero_copy_only=False)[word] if len(word) else np.zeros(0, bool)
        stems = pc.binary_join_element_wise(pc.utf8_slice_codeunits(vocabulary, 0, STEM), "*", "")
        return Words(np.concatenate([document, document[long]]), np.concatenate([word, word[long] + len(vocabulary)]), pa.concat_arrays([vocabulary, stems]))


# ---------------------------------------------------------------------------------------------------------------------
# classifier


@dataclass
class Model:
    cost: np.ndarray
    words: list[str]
    weights: np.ndarray
    bias: float

    def scores(self, restorer: Restorer, texts: pa.Array) -> np.ndarray:
        document, word = features(restorer, texts, pa.array(self.words, pa.string()))
        z = self.bias + np.bincount(document, weights=self.weights[word], minlength=len(texts))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def features(restorer: Restorer, texts: pa.Array, known: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(document, known word) of a slice of texts, each pair once."""
    found = restorer.words(texts)
    index = pc.fill_null(pc.index_in(found.vocabulary, value_set=known), -1).to_numpy(zero_copy_only=False).astype(np.int64)[found.word] if len(known) and len(found.word) else np.full(len(found.word), -1)
    hit = index >= 0
    pair = np.unique(found.document[hit] * max(1, len(known)) + index[hit])
    return pair // max(1, len(known)), pair % max(1, len(known))


def logistic_regression(document: np.ndarray, word: np.ndarray, label: np.ndarray, size: int, ridge: float = RIDGE, rounds: int = 25) -> tuple[np.ndarray, float]:
    """Weights and bias by Newton's method, whose steps are found with conjugate gradients and halved where they overshoot."""
    n = len(label)
    times = lambda w: np.bincount(document, weights=w[word], minlength=n) + w[size]
    back = lambda z: np.append(np.bincount(word, weights=z[document], minlength=size), z.sum())
    damp = np.append(np.full(size, ridge), 1e-3)
    loss = lambda w, z: np.logaddexp(0, z).sum() - z @ label + 0.5 * (damp * w) @ w
    w = np.zeros(size + 1)
    z = times(w)
    now = loss(w, z)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        curve = np.maximum(p * (1 - p), 1e-6)
        residual = -(back(p - label) + damp * w)
        step, direction, power = np.zeros(size + 1), residual.copy(), residual @ residual
        start = power
        for _ in range(60):
            if power <= 1e-8 * start or power < 1e-16:
                break
            bent = back(curve * times(direction)) + damp * direction
            rate = power / (direction @ bent)
            step += rate * direction
            residual -= rate * bent
            before, power = power, residual @ residual
            direction = residual + power / before * direction
        scale = 1.0
        while scale > 1e-4 and loss(w + scale * step, times(w + scale * step)) > now:
            scale /= 2
        w = w + scale * step
        z = times(w)
        last, now = now, loss(w, z)
        if last - now < 1e-6 * abs(now):
            break
    return w[:size], float(w[size])


def fit(corpus: DataFrame, labelled: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", limit: int = LABELLED, size: int = WORDS) -> Model:
    """Learn the language model from all texts of `corpus` and the classifier from `labelled` (key, text, label).

    The words are those of label 1 that tell the classes apart best (likelihood ratio of their document counts), at most
    `size`.  Words of the other class are left out, so that much harmless text around a word never outweighs it.
    """
    cost = language_model(trigram_counts(corpus, text))
    rows = labelled.where(F.col(label).isin(0, 1) & F.col(text).isNotNull()).select(F.col(text).alias("text"), F.col(label).cast("int").alias("label"), F.xxhash64(key, text).alias("_hash"))
    rows = common.bounded_sample(rows, F.col("_hash"), limit)
    rows = common.materialize(rows.groupBy(F.xxhash64("text").alias("id")).agg(F.min_by("text", "_hash").alias("text"), F.max("label").alias("label")), "labelled")
    total = {r.label: r.n for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(total) < 2:
        share = total.get(1, 0) / max(1, sum(total.values()))
        return Model(cost, [], np.zeros(0), 3.0 if share else -3.0)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(cost)
        held: Counter = Counter()
        for batch in batches:
            for part in common.slices(batch, "text"):
                found = restorer.words(common.texts_of(part))
                pair = np.unique(found.document * len(found.vocabulary) + found.word)
                labels = part.column("label").to_numpy(zero_copy_only=False)[pair // len(found.vocabulary)] if len(pair) else pair
                word, n = np.unique((pair % max(1, len(found.vocabulary))) * 2 + labels, return_counts=True)
                names = found.vocabulary.take(pa.array(word // 2)).to_pylist()
                for name, lab, k in zip(names, (word % 2).tolist(), n.tolist(), strict=True):
                    held[name, lab] += k
            if len(held) > 300_000:
                yield told(held)
                held.clear()
        yield told(held)

    def told(held: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in held], pa.string()), pa.array([k[1] for k in held], pa.int64()), pa.array(list(held.values()), pa.int64())], ["word", "label", "n"])

    common.bounded_batches(corpus.sparkSession)
    n1, n0 = float(total[1]), float(total[0])
    counts = rows.select("text", "label").mapInArrow(count, "word string, label long, n long").groupBy("word").agg(F.sum(F.col("n") * F.col("label")).alias("t"), F.sum(F.col("n") * (1 - F.col("label"))).alias("f"))
    a, b, all_rows = F.col("t"), F.col("f"), n1 + n0
    side = lambda k, of: F.when(k > 0, k * F.log(k * all_rows / ((a + b) * of))).otherwise(0.0)
    rest = lambda k, of: F.when(of - k > 0, (of - k) * F.log((of - k) * all_rows / ((all_rows - a - b) * of))).otherwise(0.0)
    ratio = side(a, n1) + side(b, n0) + rest(a, n1) + rest(b, n0)
    best = counts.where((F.col("word") != "") & (a + b >= 3) & (a * n0 > b * n1)).withColumn("ratio", ratio).orderBy(F.desc("ratio"), "word").limit(size)
    words = [r.word for r in best.select("word").collect()]

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer, known = Restorer(cost), pa.array(words, pa.string())
        for batch in batches:
            for part in common.slices(batch, "text"):
                document, word = features(restorer, common.texts_of(part), known)
                ends = np.searchsorted(document, np.arange(part.num_rows + 1))
                yield pa.RecordBatch.from_arrays([part.column("label"), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(word.astype(np.int16)))], ["label", "word"])

    # At most `limit` rows of `size` numbers of 16 bits: 120 MB with the usual bounds, however long the texts are.
    got = rows.select("text", "label").mapInArrow(collect, "label int, word array<short>").toArrow()
    sizes = pc.list_value_length(got["word"]).to_numpy()
    weights, bias = logistic_regression(np.repeat(np.arange(len(sizes)), sizes), pc.list_flatten(got["word"]).to_numpy().astype(np.int64), got["label"].to_numpy(), max(1, len(words)))
    return Model(cost, words, weights, bias)


def score(df: DataFrame, model: Model, keep: list[str | Column], text: str = "text") -> DataFrame:
    """The columns `keep` of `df` with `score` and `predicted`."""
    kept = df.select(*keep).columns
    own = [f"_{i}" for i in range(len(kept))]
    inner = df.select(*[F.col(c) if isinstance(c, str) else c for c in keep], F.col(text).alias("_text")).toDF(*own, "_text")
    types = dict(inner.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(model.cost)
        for batch in batches:
            for part in common.slices(batch, "_text"):
                got = model.scores(restorer, common.texts_of(part, "_text"))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in own), pa.array(got), pa.array((got >= 0.5).astype(np.int32))], [*own, "score", "predicted"])

    common.bounded_batches(df.sparkSession)
    out = inner.mapInArrow(run, ", ".join(f"`{c}` {types[c]}" for c in own) + ", score double, predicted int")
    return out.toDF(*kept, "score", "predicted")

"""BPE encoding and decoding with a minimal acyclic transducer lexicon.

Frequent words are compiled into a shared-suffix automaton over UTF-8 bytes whose arcs carry numbers; their sum along an
accepted path is the word's entry, and the entry points at its token ids.  The automaton, the pair table and the token
strings are one file that every worker memory-maps.  Words the automaton does not accept are merged exactly, lowest rank
first and leftmost among equals, many words at a time.  Only text beyond Latin is normalised and split into words by the
tokenizers library, whose Unicode tables may be newer than the interpreter's.

Texts: null counts as empty (no ids).  Very long words are merged with a heap, so that time stays near linear.  Rows are
independent of each other: ties, repeated rows and further columns have no influence, an empty table gives an empty one.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from . import common

#: Words compiled into the automaton (an accelerator only: ids are the same with any lexicon), and distinct words that a task counts before
#: it sends them on.
LEXICON_WORDS, COUNTED = 50_000, 200_000
#: Words a worker remembers before it starts anew.
MEMO_WORDS = 150_000
#: Symbols merged together, and bytes of text encoded together.
MERGED_CELLS, SLICE_BYTES = 160_000, 3_000_000
NONE = np.int32(2**31 - 1)
#: Marks around most words.
MARKS = ".,;:!?()\"'"
SPACE = r"\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
BLANKS = re.compile(rf"[{SPACE}]+")
#: Most runs without white space: letters, then perhaps marks.
SIMPLE = "^(?P<word>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<marks>[!-&(-/:-@\\[-`{-~]*)$"
BEYOND_LATIN = re.compile("[\u0180-\U0010ffffİ]")


@functools.cache
def latin_pieces() -> re.Pattern:
    """The tokenizer's own split for texts up to U+017F; letters and digits there are the same in all Unicode tables."""
    letter, digit = ("".join(chr(c) for c in range(0x180) if unicodedata.category(chr(c))[0] == kind) for kind in "LN")
    return re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{letter}]+|[{digit}]|[^{SPACE}{letter}{digit}]+")


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


# ---------------------------------------------------------------------------------------------------------------------
# compiling


def minimal_automaton(words: list[bytes]) -> dict[str, np.ndarray]:
    """Compile distinct words, sorted, into the minimal automaton with additive entry numbers.

    States are built along the common prefix with the next word and replaced by an equal one, if there is one, as soon
    as no further word can pass through them.
    """
    if any(a >= b for a, b in zip(words, words[1:], strict=False)):
        raise ValueError("words must be sorted and distinct")
    register: dict[tuple, int] = {}
    arcs: list[tuple] = []  # of each frozen state: (final, ((byte, target), ...))
    accepted: list[int] = []  # words accepted from each frozen state
    path: list[list] = [[False, []]]  # states of the last word that are still open

    def freeze(keep: int) -> None:
        while len(path) > keep + 1:
            final, out = path.pop()
            shape = (final, tuple(out))
            state = register.get(shape)
            if state is None:
                state = register[shape] = len(arcs)
                arcs.append(shape)
                accepted.append(int(final) + sum(accepted[t] for _, t in out))
            label = path[-1][1].pop()[0]
            path[-1][1].append((label, state))

    last = b""
    for word in words:
        shared = 0
        while shared < min(len(last), len(word)) and last[shared] == word[shared]:
            shared += 1
        freeze(shared)
        for byte in word[shared:]:
            path[-1][1].append((byte, -1))
            path.append([False, []])
        path[-1][0] = True
        last = word
    freeze(0)
    root = len(arcs)
    arcs.append((path[0][0], tuple(path[0][1])))
    key, target, add = [], [], []
    for state, (final, out) in enumerate(arcs):
        before = int(final)
        for byte, to in out:
            key.append(state << 8 | byte)
            target.append(to)
            add.append(before)
            before += accepted[to]
    return {
        "arc_key": np.array(key, np.int64),
        "arc_target": np.array(target, np.int32),
        "arc_add": np.array(add, np.int32),
        "final": np.array([f for f, _ in arcs], np.uint8),
        "root": np.array([root], np.int64),
    }


def pair_table(pairs: list[tuple[int, int, int]]) -> dict[str, np.ndarray]:
    """An open-addressed table of (left, right, merged) in order of rank; ids fit in 16 bits."""
    bits = max(4, int(len(pairs) * 4).bit_length())
    keys, rank, merged = np.full(1 << bits, 2**32 - 1, np.uint32), np.full(1 << bits, NONE, np.int32), np.zeros(1 << bits, np.int32)
    for n, (a, b, m) in enumerate(pairs):
        k = a << 16 | b
        at = (k * 0x9E3779B1 & 0xFFFFFFFF) >> (32 - bits)
        while keys[at] != 2**32 - 1:
            at = (at + 1) % (1 << bits)
        keys[at], rank[at], merged[at] = k, n, m
    return {"pair_key": keys, "pair_rank": rank, "pair_merged": merged}


def compile_model(tokenizer: str, words: list[str] = ()) -> bytes:
    """The file workers map: from the tokenizer's JSON file and the words of the lexicon (already in normal form)."""
    with open(tokenizer, encoding="utf-8") as f:
        spec = json.load(f)
    vocabulary, end = spec["model"]["vocab"], spec["model"].get("end_of_word_suffix") or ""
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    size = max([*vocabulary.values(), *special.values()]) + 1
    if size > 65_535:
        raise ValueError("ids must fit in 16 bits")
    tokens = [""] * size
    for token, i in [*vocabulary.items(), *special.items()]:
        tokens[i] = token
    pairs = []
    for merge in spec["model"]["merges"]:
        a, b = merge.split(" ") if isinstance(merge, str) else merge
        pairs.append((vocabulary[a], vocabulary[b], vocabulary[a + b]))
    characters = byte_characters()
    text = [t.encode() for t in tokens]
    arrays = pair_table(pairs) | {
        "byte_id": np.array([vocabulary[c] for c in characters], np.int32),
        "byte_end_id": np.array([vocabulary[c + end] for c in characters], np.int32),
        "token_bytes": np.frombuffer(b"".join(text), np.uint8),
        "token_offsets": np.cumsum([0, *map(len, text)]).astype(np.int32),
        "split": np.frombuffer(json.dumps({k: spec.get(k) for k in ("version", "normalizer", "pre_tokenizer")} | {"truncation": None, "padding": None, "added_tokens": [], "post_processor": None, "decoder": None, "model": {"type": "BPE", "vocab": {}, "merges": []}}).encode(), np.uint8),
        "special": np.frombuffer(json.dumps(special).encode(), np.uint8),
    }
    entries = sorted({w.encode() for w in words if w})
    arrays |= minimal_automaton(entries)
    plain = Encoder(arrays | {"entry_ids": np.zeros(0, np.int32), "entry_offsets": np.zeros(1, np.int64)}, lexicon=False)
    ids, lengths = plain.encode_words([w.decode() for w in entries])
    return common.pack_arrays(arrays | {"entry_ids": ids.astype(np.int32), "entry_offsets": np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)})


# ---------------------------------------------------------------------------------------------------------------------
# encoding


class Encoder:
    """Encodes texts with the arrays of `compile_model`; one lives in each worker."""

    def __init__(self, arrays: dict[str, np.ndarray], lexicon: bool = True):
        self.a, self.lexicon = arrays, lexicon and len(arrays["arc_key"]) > 0
        self.special = json.loads(arrays["special"].tobytes())
        self.special_split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.tokens = pa.StringArray.from_buffers(len(arrays["token_offsets"]) - 1, pa.py_buffer(np.ascontiguousarray(arrays["token_offsets"])), pa.py_buffer(np.ascontiguousarray(arrays["token_bytes"])))
        self.find = latin_pieces().findall
        self.split = Tokenizer.from_str(arrays["split"].tobytes().decode())
        self.forget()

    def forget(self) -> None:
        self.memo: dict[str, int] = {"": 0}
        self.pool, self.used = np.zeros(1 << 16, np.uint32), 0
        self.start, self.length = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)
        self.rows = 1

    # words

    def _lookup(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = self.a["pair_key"]
        mask, shift = len(keys) - 1, 33 - len(keys).bit_length()
        k = (left.astype(np.uint32) << np.uint32(16)) | right.astype(np.uint32)
        at = ((k * np.uint32(0x9E3779B1)) >> np.uint32(shift)).astype(np.int64)
        found = keys[at]
        todo = np.flatnonzero((found != k) & (found != 2**32 - 1))
        while len(todo):
            at[todo] = (at[todo] + 1) & mask
            found = keys[at[todo]]
            todo = todo[(found != k[todo]) & (found != 2**32 - 1)]
        hit = keys[at] == k
        return np.where(hit, self.a["pair_rank"][at], NONE), self.a["pair_merged"][at]

    def _accept(self, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """The entry of each word the automaton accepts, else -1."""
        keys, target, add = self.a["arc_key"], self.a["arc_target"], self.a["arc_add"]
        entry, state = np.zeros(len(start), np.int64), np.full(len(start), self.a["root"][0], np.int64)
        alive, at = np.arange(len(start)), 0
        out = np.full(len(start), -1, np.int64)
        while len(alive):
            done = length[alive] == at
            ended = alive[done]
            good = ended[self.a["final"][state[ended]] == 1]
            out[good] = entry[good]
            alive = alive[~done]
            if not len(alive):
                break
            k = state[alive] << 8 | data[start[alive] + at]
            pos = np.minimum(np.searchsorted(keys, k), len(keys) - 1)
            ok = keys[pos] == k
            alive, pos = alive[ok], pos[ok]
            entry[alive] += add[pos]
            state[alive] = target[pos]
            at += 1
        return out

    def _merge(self, data: np.ndarray, start: np.ndarray, length: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Merge words of up to `width` bytes together: each step merges in every word its best pair."""
        n, column = len(start), np.arange(width)
        inside = column < length[:, None]
        raw = data[np.where(inside, start[:, None] + column, 0)]
        symbol = np.where(inside, self.a["byte_id"][raw], -1)
        symbol[np.arange(n), length - 1] = self.a["byte_end_id"][raw[np.arange(n), length - 1]]
        rank, merged = np.full((n, width), NONE, np.int32), np.zeros((n, width), np.int32)
        pairs = column[: width - 1] < length[:, None] - 1
        r, c = np.nonzero(pairs)
        rank[r, c], merged[r, c] = self._lookup(symbol[r, c], symbol[r, c + 1])
        after, before = np.tile(column + 1, (n, 1)), np.tile(column - 1, (n, 1))
        live = np.arange(n)
        while len(live):
            p = rank[live].argmin(1)
            keep = rank[live, p] != NONE
            live, p = live[keep], p[keep]
            if not len(live):
                break
            q = after[live, p]
            symbol[live, p] = merged[live, p]
            symbol[live, q] = -1
            rank[live, q] = NONE
            nn = after[live, q]
            after[live, p] = nn
            rank[live, p] = NONE
            right = np.flatnonzero(nn < length[live])
            i, a, b = live[right], p[right], nn[right]
            before[i, b] = a
            rank[i, a], merged[i, a] = self._lookup(symbol[i, a], symbol[i, b])
            pp = before[live, p]
            left = np.flatnonzero(pp >= 0)
            i, a, b = live[left], pp[left], p[left]
            rank[i, a], merged[i, a] = self._lookup(symbol[i, a], symbol[i, b])
        kept = symbol >= 0
        return symbol[kept], kept.sum(1)

    def _merge_long(self, word: np.ndarray) -> np.ndarray:
        """Merge one long word with a heap of its pairs."""
        symbol = self.a["byte_id"][word].astype(np.int64)
        symbol[-1] = self.a["byte_end_id"][word[-1]]
        n = len(symbol)
        rank, merged = self._lookup(symbol[:-1], symbol[1:])
        ids = symbol.tolist()
        heap = [(r, p, ids[p], ids[p + 1], m) for p, (r, m) in enumerate(zip(rank.tolist(), merged.tolist(), strict=True)) if r != NONE]
        heapq.heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        known: dict[tuple[int, int], tuple[int, int]] = {}

        def push(p: int, q: int) -> None:
            pair = (ids[p], ids[q])
            if pair not in known:
                r, m = self._lookup(np.array([pair[0]]), np.array([pair[1]]))
                known[pair] = (int(r[0]), int(m[0]))
            r, m = known[pair]
            if r != NONE:
                heapq.heappush(heap, (r, p, *pair, m))

        while heap:
            _, p, a, b, m = heapq.heappop(heap)
            q = after[p]
            if ids[p] != a or q >= n or ids[q] != b:
                continue
            ids[p], ids[q] = m, -1
            after[p] = after[q]
            if after[p] < n:
                before[after[p]] = p
                push(p, after[p])
            if before[p] >= 0:
                push(before[p], p)
        return np.array([i for i in ids if i >= 0], np.int64)

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in a row, and each word's number of ids.  Words are non-empty and in normal form."""
        if not words:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        array = pa.array(words, pa.large_string())
        offsets = np.frombuffer(array.buffers()[1], np.int64, len(words) + 1)
        data = np.frombuffer(array.buffers()[2], np.uint8)
        start, length = offsets[:-1], np.diff(offsets)
        parts, place, count = [], np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        base = 0
        rest = np.arange(len(words))
        if self.lexicon:
            entry = self._accept(data, start, length)
            hit = np.flatnonzero(entry >= 0)
            begin = self.a["entry_offsets"][entry[hit]]
            place[hit], count[hit] = begin, self.a["entry_offsets"][entry[hit] + 1] - begin
            parts.append(self.a["entry_ids"].astype(np.int64))
            base = len(parts[0])
            rest = np.flatnonzero(entry < 0)
        low = 0
        for width in (4, 8, 12, 16, 24, 40, 64):
            own = rest[(length[rest] > low) & (length[rest] <= width)]
            low = width
            for k in range(0, len(own), MERGED_CELLS // width):
                some = own[k : k + MERGED_CELLS // width]
                ids, n = self._merge(data, start[some], length[some], width)
                count[some], place[some] = n, base + np.cumsum(n) - n
                parts.append(ids.astype(np.int64))
                base += len(ids)
        for i in rest[length[rest] > low]:
            ids = self._merge_long(data[start[i] : start[i] + length[i]])
            count[i], place[i] = len(ids), base
            parts.append(ids)
            base += len(ids)
        return common.gather(np.concatenate(parts), place, count), count

    # texts

    def pieces(self, chunk: str) -> list[str]:
        """The words of a run without white space, in normal form."""
        if not BEYOND_LATIN.search(chunk):
            return self.find("".join(map(str.lower, chunk)))
        normal = self.split.normalizer.normalize_str(chunk)
        return [normal[a:b] for _, (a, b) in self.split.pre_tokenizer.pre_tokenize_str(normal)]

    def _learn(self, chunks: list[str]) -> None:
        """Add the ids of new chunks to the pool."""
        simple = pc.extract_regex(pa.array(chunks, pa.string()), SIMPLE)
        easy = pc.is_valid(simple).to_numpy(zero_copy_only=False)
        simple = simple.filter(pa.array(easy))
        word = pc.utf8_lower(simple.field("word")).dictionary_encode()
        marks = simple.field("marks").dictionary_encode()
        index = {w: i for i, w in enumerate(word.dictionary.to_pylist())}
        mark_row = np.array([index.setdefault(m, len(index)) if m else -1 for m in marks.dictionary.to_pylist()], np.int64)
        pairs = np.stack([word.indices.to_numpy(zero_copy_only=False), mark_row[marks.indices.to_numpy(zero_copy_only=False)]], 1) if len(simple) else np.zeros((0, 2), np.int64)
        # the others one by one; -2 - id: a special token
        hard: list[int] = []
        sizes = np.ones(len(chunks), np.int64)
        sizes[easy] += pairs[:, 1] >= 0
        for n in np.flatnonzero(~easy):
            before, chunk = len(hard), chunks[n]
            for part in self.special_split.split(chunk) if self.special_split and "<" in chunk else (chunk,):
                if part in self.special:
                    hard.append(-2 - self.special[part])
                elif part:
                    hard += [index.setdefault(w, len(index)) for w in self.pieces(part)]
            sizes[n] = len(hard) - before
        which = np.zeros(int(sizes.sum()), np.int64)
        of_easy = np.repeat(easy, sizes)
        which[of_easy] = pairs[pairs != -1]
        which[~of_easy] = hard
        ids, count = self.encode_words(list(index))
        special = which < 0
        place = np.concatenate([np.cumsum(count) - count, len(ids) + np.arange(special.sum())]).astype(np.int64)
        ids = np.concatenate([ids, -2 - which[special]])
        which[special] = len(index) + np.arange(special.sum())
        count = np.concatenate([count, np.ones(special.sum(), np.int64)])
        flat = common.gather(ids, place[which], count[which])
        lengths = common.segment_sums(count[which], np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64))
        while self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        while self.rows + len(chunks) > len(self.start):
            self.start, self.length = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.length))
        self.pool[self.used : self.used + len(flat)] = flat
        self.start[self.rows : self.rows + len(chunks)] = self.used + np.cumsum(lengths) - lengths
        self.length[self.rows : self.rows + len(chunks)] = lengths
        self.memo.update(zip(chunks, range(self.rows, self.rows + len(chunks)), strict=True))
        self.used += len(flat)
        self.rows += len(chunks)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and the texts' offsets in them."""
        if pc.any(pc.match_substring_regex(texts, "[\x1c-\x1f]")).as_py():  # no white space to the tokenizer
            lists = pa.array([BLANKS.split(t) for t in texts.to_pylist()], pa.list_(pa.string()))
            offsets, words = lists.offsets.to_numpy().astype(np.int64), lists.values
        else:
            offsets, words = common.split_words(texts)
        coded = words.dictionary_encode()
        if len(self.memo) > MEMO_WORDS or self.used > 16 * MEMO_WORDS:
            self.forget()
        distinct = coded.dictionary.to_pylist()
        if new := [w for w in distinct if w not in self.memo]:
            self._learn(new)
        rows = np.fromiter(map(self.memo.__getitem__, distinct), np.int64, len(distinct))[coded.indices.to_numpy(zero_copy_only=False)]
        length = self.length[rows]
        ends = np.concatenate([[0], np.cumsum(length)])
        return common.gather(self.pool, self.start[rows], length), ends[offsets]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
        """The tokenizer names no decoder: tokens are joined by a space."""
        tokens = self.tokens.take(pa.array(ids, pa.int64()))
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), tokens), " ")


_ENCODERS: dict[str, Encoder] = {}


def encoder(name: str) -> Encoder:
    """The worker's encoder for a model file that was given to the executors."""
    if name not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[name] = Encoder(common.map_arrays(SparkFiles.get(name)))
    return _ENCODERS[name]


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, n) of all runs of at most 40 letters in all documents, in lower case; each task adds up its own, a bounded number at a time.

    White space is split first, so that only distinct pieces are taken apart.
    """
    most = COUNTED

    def sent(numbers: dict[str, int], n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(numbers), pa.string()), pa.array(n)], ["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers: dict[str, int] = {}
        n = np.zeros(0, np.int64)
        for batch in batches:
            for part in common.slices(batch, "text", SLICE_BYTES):
                found = pc.value_counts(common.split_words(common.texts_of(part))[1])
                pieces, counts = pc.utf8_trim(pc.utf8_lower(found.field("values").cast(pa.string())), MARKS), found.field("counts").to_numpy(zero_copy_only=False)
                whole = pc.utf8_is_alpha(pieces)
                runs, plain = pc.split_pattern_regex(pieces.filter(pc.invert(whole)), r"[^\p{L}]+"), whole.to_numpy(zero_copy_only=False)
                every = pa.concat_arrays([pieces.filter(whole), runs.flatten()])
                times = np.concatenate([counts[plain], np.repeat(counts[~plain], pc.list_value_length(runs).to_numpy(zero_copy_only=False))])
                length = pc.utf8_length(every).to_numpy(zero_copy_only=False)
                good = (length > 0) & (length <= 40)
                coded = every.filter(pa.array(good)).dictionary_encode()
                place = np.array([numbers.setdefault(w, len(numbers)) for w in coded.dictionary.to_pylist()], np.int64)
                n = np.concatenate([n, np.zeros(len(numbers) - len(n), np.int64)])
                n[place] += np.bincount(coded.indices.to_numpy(zero_copy_only=False), times[good], len(place)).astype(np.int64)
                if len(numbers) > most:
                    yield sent(numbers, n)
                    numbers, n = {}, n[:0]
        yield sent(numbers, n)

    common.bounded_batches(docs.sparkSession, size=SLICE_BYTES)
    return docs.select(F.col(text).alias("text")).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(docs: DataFrame, text: str = "text", words: int = LEXICON_WORDS) -> list[str]:
    """The most frequent runs of letters of all documents, at most `words`.

    A histogram of the counts tells from which count on a word is among them; words of lower counts stay on the executors.
    """
    counts = common.materialize(word_counts(docs, text), "word-counts")
    least, upto = None, 0
    for r in sorted(counts.groupBy("n").agg(F.count("*").alias("words")).collect(), key=lambda r: -r.n):
        upto += r.words
        if upto > words:
            break
        least = r.n
    if least is None:
        return []
    return [unicodedata.normalize("NFC", r.word) for r in counts.where(F.col("n") >= least).select("word").collect()]


def prepare(spark: SparkSession, docs: DataFrame, tokenizer: str, text: str = "text", words: int = LEXICON_WORDS) -> str:
    """Compile the model for these documents and give it to the executors; the name is for `map_encoded`."""
    return common.put_shared_file(spark, "bpe", compile_model(tokenizer, frequent_words(docs, text, words)))


def map_encoded(df: DataFrame, model: str, schema: str, row: Callable[[pa.RecordBatch, np.ndarray, np.ndarray, Encoder], pa.RecordBatch], text: str = "text") -> DataFrame:
    """Apply `row` to slices of `df` with all their ids and the rows' offsets in them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(model)
        for batch in batches:
            for part in common.slices(batch, text, SLICE_BYTES):
                ids, offsets = own.encode(common.texts_of(part, text))
                yield row(part, ids, offsets, own)

    common.bounded_batches(df.sparkSession, size=SLICE_BYTES)  # a batch is a slice, none has a small rest
    return df.mapInArrow(run, schema)


def encode(df: DataFrame, model: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids array<int>) of every row."""
    kind = df.schema[key].dataType.simpleString()

    def row(part: pa.RecordBatch, ids: np.ndarray, offsets: np.ndarray, own: Encoder) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([part.column(key), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids.astype(np.int32)))], [key, "ids"])

    return map_encoded(df.select(key, text), model, f"`{key}` {kind}, ids array<int>", row, text)


def decode(df: DataFrame, model: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, text) of rows with an array of ids; a null array gives an empty text."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(model)
        for batch in batches:
            lists = batch.column(ids)
            counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            out = own.decode(lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.concatenate([[0], np.cumsum(counts)]))
            yield pa.RecordBatch.from_arrays([batch.column(key), out.cast(pa.string())], [key, "text"])

    return df.select(key, ids).mapInArrow(run, f"`{key}` {kind}, text string")


def digests(df: DataFrame, model: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode, decode the ids again and digest both: (key, n_tokens, ids_sha256, decoded_sha256)."""
    kind = df.schema[key].dataType.simpleString()

    def row(part: pa.RecordBatch, ids: np.ndarray, offsets: np.ndarray, own: Encoder) -> pa.RecordBatch:
        ids = ids.astype("<u4")
        raw, ends = memoryview(ids).cast("B"), offsets.tolist()
        of_ids = [hashlib.sha256(raw[4 * a : 4 * b]).hexdigest() for a, b in zip(ends, ends[1:], strict=False)]
        decoded = own.decode(ids, offsets)
        at = np.frombuffer(decoded.buffers()[1], np.int32, len(decoded) + 1).tolist()
        data = memoryview(decoded.buffers()[2]) if decoded.buffers()[2] is not None else memoryview(b"")
        of_text = [hashlib.sha256(data[a:b]).hexdigest() for a, b in zip(at, at[1:], strict=False)]
        return pa.RecordBatch.from_arrays([part.column(key), pa.array(np.diff(offsets), pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], [key, "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_encoded(df.select(key, text), model, f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string", row, text)

"""Fill-in-the-middle examples: texts are cut at two token boundaries and put in another order, which can be undone.

Tokens are runs of A-Z and a-z, and single other characters.  The cuts of all rows of an Arrow slice are found together on
its UTF-8 buffer: a table gives each byte's class, a byte that begins a token is told from the classes of it and the byte
before, the running count of such bytes starts anew with each document, and a binary search in it finds the bytes of all
cuts at once.  No Python loop goes over characters or tokens.

What is drawn for a row depends on its id alone: four numbers from the SHA-256 of `salt:id` choose both cuts, whether the text
stays plain, and the order of the parts.  Texts that hold a mark stay plain, so that the three marks of any other output are the
only ones in it, and `restore` needs nothing but output and form.

Null texts count as empty, and empty texts stay plain.  A null id draws from the salt alone.  Rows that repeat an id are cut by
the same draws.  Columns that are asked for by `keep` come back as they are, whatever their names; an empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Marks before prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
#: Of a hundred rows, how many are rearranged, and how many of these have the suffix first.
REARRANGED, SUFFIX_FIRST = 90, 20
LETTER, FOLLOWING, OTHER = 1, 2, 0
#: The class of every byte: a letter, a byte inside a character, or any other first byte of a character.
CLASSES = np.full(256, OTHER, np.uint8)
CLASSES[[*range(65, 91), *range(97, 123)]] = LETTER
CLASSES[0x80:0xC0] = FOLLOWING


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets from 0) of an array of strings without nulls."""
    _, ends, data = texts.buffers()
    offsets = np.frombuffer(ends, np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def boundaries(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(whether a byte begins a token, whether it begins a character)."""
    kind = CLASSES[data]
    first = kind != FOLLOWING
    starts = first.copy()
    starts[1:] &= ~((kind[1:] == LETTER) & (kind[:-1] == LETTER))
    begins = offsets[:-1][offsets[:-1] < offsets[1:]]
    starts[begins] = True  # a document's first byte, whatever letter the one before ends with
    return starts, first


def cut(texts: pa.Array, draws: np.ndarray) -> tuple[np.ndarray, ...]:
    """(tokens, bytes of a first and second cut, characters of prefix and middle) of each text; `draws` has two numbers a row."""
    data, offsets = buffers(texts)
    starts, first = boundaries(data, offsets)
    upto, chars = (np.concatenate([np.zeros(1, np.int32), np.cumsum(x, dtype=np.int32)]) for x in (starts, first))
    before, tokens = upto[offsets[:-1]], np.diff(upto[offsets])
    places = np.sort(draws % (tokens + 1)[:, None].astype(np.uint64), axis=1).astype(np.int64)
    # The token after a cut is the document's (place + 1)th; where there is none, the next document's first byte is the end.
    at = np.searchsorted(upto[1:], before[:, None] + places + 1)
    return tokens, at[:, 0], at[:, 1], chars[at[:, 0]] - chars[offsets[:-1]], chars[at[:, 1]] - chars[at[:, 0]]


def forms(texts: pa.Array, draws: np.ndarray) -> np.ndarray:
    """plain, psm (prefix, suffix, middle) or spm of each text; `draws` has two numbers a row."""
    plain = pc.equal(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False) | (draws[:, 0] % 100 >= REARRANGED)
    for mark in MARKS:
        plain |= pc.match_substring(texts, mark).to_numpy(zero_copy_only=False)
    return np.where(plain, "plain", np.where(draws[:, 1] % 100 < SUFFIX_FIRST, "spm", "psm"))


def strings(parts: list[memoryview | bytes], lengths: np.ndarray) -> pa.Array:
    """Strings of given lengths in bytes from the joined parts."""
    ends = np.concatenate([[0], np.cumsum(lengths)])
    if ends[-1] >= 2**31:
        raise ValueError("a slice's texts are beyond 2 GB")
    return pa.Array.from_buffers(pa.string(), len(lengths), [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(b"".join(parts))])


def arranged(texts: pa.Array, form: np.ndarray, one: np.ndarray, two: np.ndarray) -> pa.Array:
    """The outputs: the three parts behind their marks, in the order of the form."""
    data, offsets = buffers(texts)
    view = memoryview(data)
    prefix, suffix, middle = (m.encode() for m in MARKS)
    parts: list[memoryview | bytes] = []
    for a, b, x, y, how in zip(offsets.tolist(), offsets[1:].tolist(), one.tolist(), two.tolist(), form.tolist(), strict=False):
        if how == "plain":
            parts.append(view[a:b])
        elif how == "psm":
            parts += [prefix, view[a:x], suffix, view[y:b], middle, view[x:y]]
        else:
            parts += [suffix, view[y:b], prefix, view[a:x], middle, view[x:y]]
    return strings(parts, np.diff(offsets) + np.where(form == "plain", 0, sum(map(len, MARKS))))


def rebuilt(outputs: pa.Array, form: list[str]) -> pa.Array:
    """The texts that outputs were made from: marks are found in all rows together, as three adjacent bytes."""
    data, offsets = buffers(outputs)
    view = memoryview(data)
    names = np.frombuffer("".join(m[1] for m in MARKS).encode(), np.uint8)
    marks = np.flatnonzero((data[:-2] == ord("<")) & (data[2:] == ord(">")) & np.isin(data[1:-1], names)) if len(data) > 2 else np.zeros(0, np.int64)
    parts, lengths = [], []
    for a, b, k, how in zip(offsets.tolist(), offsets[1:].tolist(), np.searchsorted(marks, offsets[:-1]).tolist(), form, strict=False):
        if how == "plain":
            own = [view[a:b]]
        else:
            _, x, y = marks[k : k + 3].tolist()  # the first mark opens the output
            first, second, third = view[a + 3 : x], view[x + 3 : y], view[y + 3 : b]
            own = [first, third, second] if how == "psm" else [second, third, first]
        parts += own
        lengths.append(sum(map(len, own)))
    return strings(parts, np.array(lengths, np.int64))


def fill_in_middle(df: DataFrame, key: str = "doc_id", text: str = "text", salt: str = "1", keep: list[str | Column] = ()) -> DataFrame:
    """(key, n, form, prefix_chars, middle_chars, output, *keep): tokens of each text, its form, and its example."""
    kept = df.select(*keep).columns
    own = [f"_{i}" for i in range(len(kept))]
    digest = F.sha2(F.concat(F.lit(f"{salt}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256)
    draws = [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]
    inner = df.select(F.col(key), F.col(text), *draws, *[F.col(c) if isinstance(c, str) else c for c in keep]).toDF("_key", "_text", "h1", "h2", "h3", "h4", *own)
    types = dict(inner.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch, "_text"):
                texts = common.texts_of(part, "_text")
                drawn = np.stack([part.column(h).to_numpy(zero_copy_only=False) for h in ("h1", "h2", "h3", "h4")], axis=1).astype(np.uint64)
                form = forms(texts, drawn[:, 2:])
                tokens, one, two, prefix, middle = cut(texts, drawn[:, :2])
                plain = form == "plain"
                shown = [pa.array(x.astype(np.int64), mask=plain) for x in (prefix, middle)]
                columns = [part.column("_key"), pa.array(tokens.astype(np.int64)), pa.array(form.tolist(), pa.string()), *shown, arranged(texts, form, one, two), *(part.column(c) for c in own)]
                yield pa.RecordBatch.from_arrays(columns, ["_key", "n", "form", "prefix_chars", "middle_chars", "output", *own])

    common.bounded_batches(df.sparkSession)
    schema = f"_key {types['_key']}, n long, form string, prefix_chars long, middle_chars long, output string" + "".join(f", {c} {types[c]}" for c in own)
    return inner.mapInArrow(run, schema).toDF(key, "n", "form", "prefix_chars", "middle_chars", "output", *kept)


def restore(examples: DataFrame, output: str = "output", form: str = "form", result: str = "restored") -> DataFrame:
    """`examples` with the text that each output was made from, read from output and form alone, as a last column."""
    names = examples.columns
    own = [f"_{i}" for i in range(len(names))]
    inner = examples.toDF(*own)
    types, made, how = dict(inner.dtypes), own[names.index(output)], own[names.index(form)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch, made):
                texts = rebuilt(common.texts_of(part, made), part.column(how).to_pylist())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in own), texts], [*own, "_restored"])

    common.bounded_batches(examples.sparkSession)
    return inner.mapInArrow(run, ", ".join(f"{c} {types[c]}" for c in own) + ", _restored string").toDF(*names, result)

"""Helpers shared by the training-data operators: shared storage, batches, columnar word splitting."""

from __future__ import annotations

import contextlib
import contextvars
import json
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text handled at once inside a task.
SLICE_BYTES = 4_000_000
#: Rows and bytes of an Arrow batch that Spark hands to Python.
BATCH_ROWS, BATCH_BYTES = 2_000, 4_000_000
#: Sub-folder of the shared folder that tables are written to just now.
_SCRATCH: contextvars.ContextVar[str] = contextvars.ContextVar("scratch", default="")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; only a local session that names none gets one of its own, once."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            folder = current.get()
        elif re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            folder = tempfile.mkdtemp(prefix="quillmark-")
        else:
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def materialize(df: DataFrame, name: str, partition_by: str | None = None, **options: int) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage, survives lost executors.  Options are the writer's."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{_SCRATCH.get()}{name}-{uuid.uuid4().hex}"
    writer = df.write.options(**options)
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder with Hadoop's file API."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Tables that `materialize` writes inside are removed at the end; the function it gives writes one that stays."""
    before = _SCRATCH.get()
    own = f"{before}scratch-{uuid.uuid4().hex}/"
    token = _SCRATCH.set(own)

    def keep(df: DataFrame, name: str) -> DataFrame:
        inner = _SCRATCH.set(before)
        try:
            return materialize(df, name)
        finally:
            _SCRATCH.reset(inner)

    try:
        yield keep
    finally:
        _SCRATCH.reset(token)
        remove(spark, f"{shared_dir(spark)}/{own}")


def put_shared_file(spark: SparkSession, name: str, data: bytes) -> str:
    """Store bytes in the shared folder with Hadoop's file API, hand them to the executors, return the file's name."""
    jvm = spark.sparkContext._jvm
    unique = f"{name}-{uuid.uuid4().hex}.bin"
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{unique}")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = fs.create(path, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()
    spark.sparkContext.addFile(fs.makeQualified(path).toString())
    return unique


def numbered(df: DataFrame, *columns: str) -> tuple[DataFrame, list[str]]:
    """`df` with its columns named by their places, and the new names of some: what operators add can't clash with them."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))]), [f"c{df.columns.index(c)}" for c in columns]


def unused(name: str, columns: list[str]) -> str:
    """The name, lengthened until no column bears it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def bounded_batches(spark: SparkSession, rows: int = BATCH_ROWS, size: int = BATCH_BYTES) -> None:
    """Keep the Arrow batches of long texts small: sets the session's bounds on rows and bytes, where its own are larger.

    The bounds are read when a plan runs, so they stay set for the session; they change no result.
    """
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        now = spark.conf.get(key).lower().removesuffix("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of a batch of about `limit` bytes in `column`, one row at least.

    What Arrow has freed is given back to the system after each slice, since workers live on between tasks.
    """
    if not batch.num_rows:
        return
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    begin = 0
    while begin < batch.num_rows:
        base = size[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(size, base + limit, side="right")))
        yield batch.slice(begin, end - begin)
        pa.default_memory_pool().release_unused()
        begin = end


def texts_of(batch: pa.RecordBatch, column: str = "text") -> pa.Array:
    """A text column as plain strings, null as empty."""
    return pc.fill_null(batch.column(column).cast(pa.string()), "")


def split_words(texts: pa.Array, ascii_only: bool = False) -> tuple[np.ndarray, pa.Array]:
    """Words between white space as (offsets of the texts, words); empty words are left in at a text's ends."""
    lists = pc.ascii_split_whitespace(texts) if ascii_only else pc.utf8_split_whitespace(texts)
    return lists.offsets.to_numpy().astype(np.int64), lists.values


def gather(pool: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Concatenate pool[start:start+length] for all entries."""
    total = int(length.sum())
    ends = np.cumsum(length)
    return pool[np.repeat(start - (ends - length), length) + np.arange(total)]


def segment_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of values between consecutive offsets, zero for empty segments."""
    total = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values)])
    return total[offsets[1:]] - total[offsets[:-1]]


def pack_arrays(arrays: dict[str, np.ndarray]) -> bytes:
    """One file image of named arrays, each at a 64-byte boundary, for `map_arrays`."""
    entries, at = {}, 0
    for name, array in arrays.items():
        at = -(-at // 64) * 64
        entries[name] = [array.dtype.str, list(array.shape), at]
        at += array.nbytes
    head = json.dumps(entries).encode()
    out = bytearray(8 + len(head) + (-(8 + len(head))) % 64)
    out[:8] = len(head).to_bytes(8, "little")
    out[8 : 8 + len(head)] = head
    base = len(out)
    for name, array in arrays.items():
        out.extend(b"\0" * (base + entries[name][2] - len(out)))
        out.extend(np.ascontiguousarray(array).tobytes())
    return bytes(out)


def map_arrays(path: str) -> dict[str, np.ndarray]:
    """Memory-map the arrays of a `pack_arrays` file; their pages are shared by all processes of a machine."""
    whole = np.memmap(path, np.uint8, "r")
    size = int.from_bytes(whole[:8].tobytes(), "little")
    entries = json.loads(whole[8 : 8 + size].tobytes())
    base = 8 + size + (-(8 + size)) % 64
    out = {}
    for name, (kind, shape, at) in entries.items():
        n = int(np.prod(shape)) * np.dtype(kind).itemsize
        out[name] = whole[base + at : base + at + n].view(kind).reshape(shape)
    return out


def bounded_sample(df: DataFrame, key: Column, rows: int) -> DataFrame:
    """About `rows` rows, chosen by a hash of `key` alone: the same rows on every run, all of a smaller table."""
    n = df.count()
    if n <= rows:
        return df
    parts = 1 << 30
    return df.where(F.pmod(F.xxhash64(key), F.lit(parts)) < int(parts * rows / n))


def held_out(key: Column) -> Column:
    """The fixed fold: crc32 of the key as text divisible by five."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(False))

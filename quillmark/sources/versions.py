"""Stores of tables in versions: readers see one whole version or the one before it, never half of a write.

A version is a folder of Parquet tables with a manifest of their files.  Which version holds is one small
file, put in place by a rename after everything else is written; a write that fails leaves the store as it was.
"""

from __future__ import annotations

import contextlib
import json
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POINTER, MANIFEST = "CURRENT", "manifest.json"
#: Versions that stay beside the newest one, for readers that have begun.
KEPT = 1


class NoVersion(ValueError):
    """Nothing has been published in the folder."""


class Damaged(ValueError):
    """Files of a version are not those of its manifest."""


class Stale(ValueError):
    """What a version was made from has changed."""


def file_system(spark: SparkSession, path: str):
    """(Hadoop's file system of a path, the path)."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def put(spark: SparkSession, path: str, text: str) -> None:
    fs, target = file_system(spark, path)
    out = fs.create(target, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def get(spark: SparkSession, path: str) -> str | None:
    """A small file's text, None if it isn't there."""
    fs, target = file_system(spark, path)
    if not fs.exists(target):
        return None
    stream = fs.open(target)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def replace(spark: SparkSession, path: str, text: str) -> None:
    """Put a small file in the place of another by one rename."""
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    draft = f"{path}-{uuid.uuid4().hex}"
    put(spark, draft, text)
    overwrite = gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    overwrite[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    fs, target = file_system(spark, path)
    source = jvm.org.apache.hadoop.fs.Path(draft)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    context.rename(fs.makeQualified(source), fs.makeQualified(target), overwrite)


def remove(spark: SparkSession, path: str) -> None:
    fs, target = file_system(spark, path)
    fs.delete(target, True)


def files(spark: SparkSession, path: str) -> dict[str, int]:
    """Bytes of the data files below a folder, by their paths in it."""
    fs, target = file_system(spark, path)
    if not fs.exists(target):
        return {}
    base = fs.makeQualified(target).toString().rstrip("/") + "/"
    found, each = {}, fs.listFiles(target, True)
    while each.hasNext():
        one = each.next()
        name = one.getPath().toString().removeprefix(base)
        if not name.rpartition("/")[2].startswith(("_", ".")):
            found[name] = one.getLen()
    return found


def content(df: DataFrame) -> dict[str, str | int]:
    """Number of rows and a sum of their hashes: equal for equal rows in any order."""
    row = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).alias("sum")).first()
    return {"rows": row.n, "content": str(row["sum"] or 0)}


def source(df: DataFrame) -> dict:
    """What tells one state of a table's source from another: its files with size and time, else its content."""
    spark, out = df.sparkSession, {}
    for path in sorted(df.inputFiles()):
        fs, target = file_system(spark, path)
        one = fs.getFileStatus(target)
        out[path] = [one.getLen(), one.getModificationTime()]
    return {"files": out} if out else content(df)


@dataclass
class Draft:
    """A version while it is written."""

    spark: SparkSession
    path: str
    details: dict = field(default_factory=dict)
    names: list[str] = field(default_factory=list)

    def write(self, name: str, df: DataFrame, **options: str | int) -> DataFrame:
        """Write a table of the version with options of the writer; gives it reread."""
        df.write.options(**options).parquet(f"{self.path}/{name}")
        self.names.append(name)
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")


@dataclass
class Version:
    """A published version."""

    spark: SparkSession
    path: str
    manifest: dict

    @property
    def details(self) -> dict:
        return self.manifest["details"]

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")


@contextlib.contextmanager
def draft(spark: SparkSession, folder: str, kept: int = KEPT) -> Iterator[Draft]:
    """Write a new version inside; it is published at the end, and removed if anything fails before."""
    number = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    new = Draft(spark, f"{folder}/versions/{number}")
    try:
        yield new
        tables = {n: {"files": files(spark, f"{new.path}/{n}")} for n in new.names}
        put(spark, f"{new.path}/{MANIFEST}", json.dumps({"version": number, "tables": tables, "details": new.details}))
        replace(spark, f"{folder}/{POINTER}", number)
    except BaseException:
        remove(spark, new.path)
        raise
    fs, target = file_system(spark, f"{folder}/versions")
    older = sorted(s.getPath().getName() for s in fs.listStatus(target) if s.getPath().getName() < number)
    for name in older[: len(older) - kept]:
        remove(spark, f"{folder}/versions/{name}")


def current(spark: SparkSession, folder: str) -> Version:
    """The published version, if all files of its manifest are there."""
    number = get(spark, f"{folder}/{POINTER}")
    if number is None:
        raise NoVersion(f"nothing is published in {folder}")
    path = f"{folder}/versions/{number.strip()}"
    told = get(spark, f"{path}/{MANIFEST}")
    if told is None:
        raise Damaged(f"{path} has no manifest")
    manifest = json.loads(told)
    for name, own in manifest["tables"].items():
        if files(spark, f"{path}/{name}") != own["files"]:
            raise Damaged(f"files of {path}/{name} are not those of its manifest")
    return Version(spark, path, manifest)

"""A session with the settings the operators are written for."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def own_folder(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, which all executors share; a local session that names none gets a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="quillmark-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def bounded_batches(spark: SparkSession, size: int = 4 << 20) -> None:
    """Arrow batches of at most about `size` bytes, where the session's own bound is larger: workers hold as much at any size of table.

    The bound is read when a plan runs, so it stays set for the session; it changes no result.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key).lower().removesuffix("b")
    if not now.isdigit() or not 0 < int(now) <= size:
        spark.conf.set(key, str(size))


def local_session(cores: int = 8, shuffle_partitions: int = 8, memory: str = "4g", name: str = "quillmark") -> SparkSession:
    """A local session; on a cluster, build the session as usual and leave partitions to adaptive execution."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .getOrCreate()
    )

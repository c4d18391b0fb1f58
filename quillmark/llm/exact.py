"""Exact dedup by progressive refinement, in DataFrame functions only.

Rows are compared by their normal form (A-Z in lower case; null counts as empty).  The first reading gives each row's
length and a hash of its first characters.  Lengths are counted, then, for lengths that occur again, the prefix hashes;
only texts that may agree with another in both are read in full for a SHA-256.  Each step counts its groups with partial
sums before any exchange and hands on only the keys of groups of two or more: a group of copies of any size is one row of
such a table, and the joins with it can be split.

What reaches the scan of the texts is a table of slots, numbers that the keys of the second step are folded to.  It has a
fixed largest size, so it is broadcast at any size of the input, and texts are not exchanged to find out which are read in
full; a slot shared by chance only costs a hash.

Of equal texts the row with the largest id stays.  In `exact_dedup` ids that repeat share their row's fate (all rows with
the largest id stay), and a null id stays only if no row of its group has an id.  `keep_one` leaves exactly one row of each
group: of the rows with the largest id (null if there is no other) one chosen by a hash of all columns.  Rows of an empty table give an
empty result.  Columns beyond the id and the text come back as they were, whatever their names: inside, the caller's columns have
names by their places.  Only in `exact_dedup` a name of the result takes the place of a column that bears it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, numbered

#: Characters of the prefix that is hashed in the second step.
PREFIX = 128
#: Slots that keys of the second step are folded to: the largest number of rows (8 bytes each) that is broadcast.
SLOTS = 1 << 20
#: Names of rows to be dropped (16 bytes each) that are broadcast at most; beyond it the join is exchanged.
BROADCAST_ROWS = 500_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GROUP = ["_length", "_prefix", "_full"]


def normal_form(text: str | Column) -> Column:
    """A-Z in lower case and nothing else; null as empty."""
    return F.translate(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), UPPER, LOWER)


def marked(df: DataFrame, text: str, prefix: int) -> DataFrame:
    """`df` with what the first two steps compare: `_length` and `_prefix`.  The normal form is as long as the text, so that only
    the prefix is brought into it here.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    return df.withColumns({"_length": F.octet_length(whole), "_prefix": F.xxhash64(normal_form(F.substring(whole, 1, prefix)))})


def repeated(rows: DataFrame) -> DataFrame:
    """(_length, _prefix) that two or more of the marked rows share."""
    base = materialize(rows.select("_length", "_prefix"), "marked")
    lengths = materialize(base.groupBy("_length").agg(F.count("*").alias("_size")).where("_size > 1").select("_length"), "lengths")
    again = base.join(lengths, "_length", "left_semi")
    return materialize(again.groupBy("_length", "_prefix").agg(F.count("*").alias("_size")).where("_size > 1").select("_length", "_prefix"), "prefixes")


def flagged(rows: DataFrame, pairs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """Marked rows with `_again`: whether their length and prefix may be among `pairs`."""
    slot = F.pmod(F.xxhash64("_length", "_prefix"), F.lit(slots)).alias("_slot")
    taken = materialize(pairs.select(slot).distinct(), "slots").withColumn("_again", F.lit(True))
    return rows.withColumn("_slot", slot).join(F.broadcast(taken), "_slot", "left").withColumn("_again", F.coalesce("_again", F.lit(False))).drop("_slot")


def exact_dedup(df: DataFrame, key: str = "doc_id", text: str = "text", prefix: int = PREFIX, digest: str | None = None) -> DataFrame:
    """All rows of `df` without its text, with keep_id, group_size and kept, and the full hash of every row if it is named."""
    names = [c for c in df.columns if c not in ("keep_id", "group_size", "kept", digest)]
    inner, (key, text) = numbered(df.select(*names), key, text)
    own = inner.columns
    rows = marked(inner, text, prefix)
    full = F.sha2(normal_form(text), 256)
    read = flagged(rows, repeated(rows)).withColumn("_full", full if digest else F.when(F.col("_again"), full)).drop(text)
    read = materialize(read, "read")
    some = read.where("_again")
    copies = materialize(some.groupBy(*GROUP).agg(F.max(key).alias("_keep"), F.count("*").alias("_size")).where("_size > 1"), "copies")
    lone = read.where("NOT _again").withColumns({"_keep": F.lit(None).cast(inner.schema[key].dataType), "_size": F.lit(None).cast("long")})
    both = lone.unionByName(some.join(copies, GROUP, "left"))
    keep = F.when(F.col("_size").isNull(), F.col(key)).otherwise(F.col("_keep"))
    out = [F.col(c).alias(name) for c, name in zip(own, names, strict=True) if c != text] + [keep.alias("keep_id"), F.coalesce("_size", F.lit(1)).cast("long").alias("group_size"), F.col(key).eqNullSafe(keep).alias("kept")]
    return both.select(*out, *([F.col("_full").alias(digest)] if digest else []))


def keep_one(df: DataFrame, key: str = "doc_id", text: str = "text", prefix: int = PREFIX) -> DataFrame:
    """`df` with one row of each group of equal texts."""
    given = df.columns
    df, (key, text) = numbered(df, key, text)
    columns = df.columns
    rows = marked(df, text, prefix)
    read = flagged(rows, repeated(rows))
    lone, some = read.where("NOT _again").select(*columns), read.where("_again").withColumn("_full", F.sha2(normal_form(text), 256))
    parts = [*GROUP, *(c for c in columns if c != text)]
    some = some.withColumns({"_a": F.xxhash64(*parts), "_b": F.xxhash64(F.lit(1), *parts)})
    names = materialize(some.select(key, *GROUP, "_a", "_b"), "survivors")
    best = materialize(names.groupBy(*GROUP).agg(F.max(F.struct(F.col(key).alias("k"), "_a", "_b")).alias("_best"), F.count("*").alias("_size")).where("_size > 1"), "copies")
    counted = names.join(best, GROUP).groupBy("_a", "_b").agg(F.count("*").alias("_rows"), F.first((F.col("_a") == F.col("_best._a")) & (F.col("_b") == F.col("_best._b"))).alias("_stays"))
    gone = materialize(counted.where("_rows > 1 OR NOT _stays"), "gone")
    hint = F.broadcast if gone.count() <= BROADCAST_ROWS else lambda x: x
    stay = lone.unionByName(some.join(hint(gone.select("_a", "_b")), ["_a", "_b"], "left_anti").select(*columns))
    twins = gone.where("_stays").select("_a", "_b")  # rows that repeat in all columns
    if twins.isEmpty():
        return stay.toDF(*given)
    return stay.unionByName(some.join(hint(twins), ["_a", "_b"], "left_semi").dropDuplicates(["_a", "_b"]).select(*columns)).toDF(*given)

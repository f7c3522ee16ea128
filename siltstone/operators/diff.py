"""Comparisons of two inventory versions, and overlays: the joins of the engine. All are equi-joins on path."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import COLUMNS

#: What status compares, and what an incremental scan compares.
STATUS_FIELDS = ("file_size", "uid", "gid", "ctime_ns", "mtime_ns")
SCAN_FIELDS = (*STATUS_FIELDS, "mode")


def differs(left: str, right: str, fields: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (~F.col(f"{left}.{f}").eqNullSafe(F.col(f"{right}.{f}")) for f in fields))


def status(old: DataFrame, new: DataFrame, report_new_tombstones: bool = False) -> DataFrame:
    """(path, status): unchanged, modified, added or deleted.

    Deleted rows of old are left out first. A path on both sides is deleted if new marks it so, else modified if metadata differ (mode and
    hash are not compared). Deleted rows that only new has are no change; with report_new_tombstones they count as added.
    """
    a, b = old.filter("not is_deleted").alias("a"), new.alias("b")
    both = a.join(b, F.col("a.path") == F.col("b.path"), "full")
    if not report_new_tombstones:
        both = both.filter(F.col("a.path").isNotNull() | ~F.col("b.is_deleted"))
    kind = (
        F.when(F.col("b.path").isNull(), "deleted")
        .when(F.col("a.path").isNull(), "added")
        .when(F.col("b.is_deleted"), "deleted")
        .when(differs("a", "b", STATUS_FIELDS), "modified")
        .otherwise("unchanged")
    )
    return both.select(F.coalesce("a.path", "b.path").alias("path"), kind.alias("status"))


def status_counts(changes: DataFrame) -> DataFrame:
    """One row: how many paths of each status, total changes, and whether there are any."""
    count = lambda s: F.count_if(F.col("status") == s)
    return changes.agg(
        *[count(s).alias(s) for s in ("added", "modified", "deleted", "unchanged")],
        F.count_if(F.col("status") != "unchanged").alias("total_changes"),
        (F.count_if(F.col("status") != "unchanged") > 0).alias("has_changes"),
    )


def status_rows(changes: DataFrame) -> DataFrame:
    """(status, path) of what is not unchanged, a row a path: for changes of any number."""
    return changes.filter("status <> 'unchanged'").select("status", "path")


def status_lists(changes: DataFrame) -> DataFrame:
    """One row a status but unchanged, with its paths in order: a report for people, as large as the changes."""
    return changes.filter("status <> 'unchanged'").groupBy("status").agg(F.array_sort(F.collect_list("path")).alias("paths"))


def scan_diff(scan: DataFrame, index: DataFrame) -> DataFrame:
    """The rows of a new version, from a live scan without hashes and the index: ENTRY with needs_hash.

    New and changed files need a hash; a deleted index row does not make a file known. Unchanged files keep the index's hash and context.
    Files that only the index has become tombstones with context scan, unless they are ones already.
    """
    s, i = scan.alias("s"), index.alias("i")
    both = s.join(i, F.col("s.path") == F.col("i.path"), "full").filter(F.col("s.path").isNotNull() | ~F.col("i.is_deleted"))
    gone = F.col("s.path").isNull()
    fresh = ~gone & (F.col("i.path").isNull() | F.col("i.is_deleted") | differs("s", "i", SCAN_FIELDS))
    made = {c: F.when(gone, F.col(f"i.{c}")).otherwise(F.col(f"s.{c}")) for c in COLUMNS}
    made["is_deleted"] = gone
    made["hash"] = F.when(fresh, "").otherwise(F.col("i.hash"))
    made["hash_type"] = F.when(fresh, F.col("s.hash_type")).otherwise(F.col("i.hash_type"))
    made["context"] = F.when(fresh | gone, "scan").otherwise(F.col("i.context"))
    return both.select(*[made[c].alias(c) for c in COLUMNS], fresh.alias("needs_hash"))


def overlay(left: DataFrame, right: DataFrame, strategy: str = "theirs") -> DataFrame:
    """Union by path: theirs keeps right's rows, ours left's; error raises if a path is on both sides."""
    if strategy not in ("theirs", "ours", "error"):
        raise ValueError(f"unknown strategy: {strategy!r}")
    if strategy == "error" and not left.join(right, "path", "left_semi").isEmpty():
        raise ValueError("both sides have a path")
    keep, add = (right, left) if strategy != "ours" else (left, right)
    return add.join(keep, "path", "left_anti").select(*left.columns).unionByName(keep.select(*left.columns))


def delta(working: DataFrame) -> DataFrame:
    """Rows that do not come from the main index: what the cache table holds."""
    return working.filter("context <> 'main'")


def writable(df: DataFrame, kind: str, context: str | None = None) -> DataFrame:
    """The rows that a main or a cache table takes."""
    has_hash = (F.col("hash") != "") & (F.col("hash_type") != 0) & ~F.col("hash").rlike("^0+$")
    if kind == "main":
        out = df.filter(~F.col("is_deleted") & has_hash)
        return out.filter(F.col("context") == context) if context else out
    return df.filter(has_hash if not context else has_hash & (F.col("context") != "main"))


def lookup(df: DataFrame, path: str) -> DataFrame:
    """The row of one path, or none: a filter that the scan skips files and row groups by."""
    return df.filter(F.col("path") == path)


def select_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.filter(F.col("path").isin(keys))


def missing_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """The keys that have no row."""
    asked = df.sparkSession.createDataFrame([(k,) for k in dict.fromkeys(keys)], "path string")
    return asked.join(select_keys(df, keys).select("path"), "path", "left_anti")

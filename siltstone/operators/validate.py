"""Rules on entries: what is wrong with a row, what a mode does about it, and repairs against the files on disk."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import zero_hash
from ..schema import MAX_FILE_SIZE, MAX_PATH, SECOND

YEAR = 365 * 86_400 * SECOND
MODES = ("strict", "lenient", "diagnostic", "recovery")


def error(now_ns: int, recovering: bool = False) -> Column:
    """The first rule that a row breaks, or null. Recovering tolerates unknown hash types and looks at 32 bytes of their hash."""
    known = F.col("hash_type").between(1, 3)
    head = F.when(known, F.col("hash")).otherwise(F.substring("hash", 1, 64))
    in_range = lambda c: F.col(c).between(F.lit(0), F.lit(now_ns + YEAR))
    rules = F.when(F.col("path") == "", "empty path").when(F.octet_length("path") > MAX_PATH, "path too long").when(F.col("file_size") > MAX_FILE_SIZE, "file size out of range").when(F.col("hash") == "", "empty hash")
    if not recovering:
        rules = rules.when(~known, F.concat(F.lit("invalid hash type "), F.col("hash_type").cast("string")))
    return rules.when(zero_hash(head), "all-zero hash").when(~in_range("ctime_ns"), "invalid ctime").when(~in_range("mtime_ns"), "invalid mtime")


def check(entries: DataFrame, mode: str, now_ns: int, auto_fix: bool = False) -> DataFrame:
    """entries with error. strict fails the job at the first bad row; lenient drops bad rows; diagnostic keeps them; recovery keeps them
    too, but with auto_fix drops those whose times are invalid."""
    if mode not in MODES:
        raise ValueError(f"unknown mode: {mode!r}")
    found = error(now_ns, mode == "recovery")
    if mode == "strict":
        found = F.when(found.isNotNull(), F.raise_error(F.concat(F.lit("invalid entry "), F.col("path"), F.lit(": "), found)))
    out = entries.withColumn("error", found.cast("string"))
    if mode == "lenient":
        return out.filter("error is null")
    if mode == "recovery" and auto_fix:
        return out.filter("error is null or error not in ('invalid ctime', 'invalid mtime')")
    return out


@dataclass(frozen=True)
class Repair:
    """A rule of repair: its name, which rows need it, and the new values of their columns. Columns are told apart as e (the row) and d
    (the file on disk, null where there is none)."""

    name: str
    needed: Column
    updates: dict[str, Column]


def repairs(hash_type: int = 2) -> list[Repair]:
    here = F.col("d.path").isNotNull()
    apart = lambda f: ~F.col(f"e.{f}").eqNullSafe(F.col(f"d.{f}"))
    disk = lambda *fs: {f: F.col(f"d.{f}") for f in fs}
    return [
        Repair("hash_type", ~F.col("e.hash_type").between(1, 3), {"hash_type": F.lit(hash_type).cast("long")}),
        Repair("missing_file", ~here & ~F.col("e.is_deleted"), {"is_deleted": F.lit(True)}),
        Repair("file_size", here & apart("file_size"), disk("file_size")),
        Repair("file_mode", here & apart("mode"), disk("mode")),
        Repair("mtime", here & (F.abs(F.col("e.mtime_ns") - F.col("d.mtime_ns")) > SECOND), disk("mtime_ns", "ctime_ns")),
        Repair("ownership", here & (apart("uid") | apart("gid")), disk("uid", "gid")),
    ]


def fix_plan(entries: DataFrame, disk: DataFrame, rules: list[Repair] | None = None) -> DataFrame:
    """(path, type): what the repair rules would change, given the files on disk (ENTRY)."""
    both = entries.alias("e").join(disk.alias("d"), F.col("e.path") == F.col("d.path"), "left")
    kinds = F.filter(F.array(*[F.when(r.needed, r.name) for r in rules or repairs()]), lambda x: x.isNotNull())
    return both.select(F.col("e.path").alias("path"), F.explode(kinds).alias("type"))


def fix(entries: DataFrame, disk: DataFrame, mode: str = "auto", accepted: DataFrame | None = None, hash_type: int = 2, rules: list[Repair] | None = None) -> DataFrame:
    """entries after repair. auto applies every issue of fix_plan(), manual those in accepted (path, type; none: no issue), none nothing.
    Rules default to repairs(); users may add their own. Hashes are never recomputed."""
    if mode not in ("auto", "manual", "none"):
        raise ValueError(f"not a fix mode: {mode!r}")
    if mode == "none" or mode == "manual" and accepted is None:
        return entries
    rules = rules or repairs(hash_type)
    joined = entries.alias("e").join(disk.alias("d"), F.col("e.path") == F.col("d.path"), "left")
    wanted = lambda r: F.coalesce(r.needed, F.lit(False))
    if mode == "manual":
        todo = accepted.groupBy("path").agg(F.collect_set("type").alias("types"))
        joined = joined.join(todo.alias("t"), F.col("e.path") == F.col("t.path"), "left")
        wanted = lambda r: F.coalesce(r.needed & F.array_contains("t.types", r.name), F.lit(False))

    def value(c: str) -> Column:
        out = F.col(f"e.{c}")
        for r in rules:
            if c in r.updates:
                out = F.when(wanted(r), r.updates[c]).otherwise(out)
        return out.alias(c)

    return joined.select(*[value(c) for c in entries.columns])


def fix_counts(entries: DataFrame, disk: DataFrame, now_ns: int, hash_type: int = 2) -> DataFrame:
    """One row: how many entries are valid as they are, fixed (valid after repair, and changed by it), and discarded (still not valid)."""
    rules = [Repair(r.name, r.needed, r.updates | {"todo": F.lit(True)}) for r in repairs(hash_type)]
    judged = fix(entries.withColumn("todo", F.lit(False)), disk, "auto", rules=rules).withColumn("error", error(now_ns))
    ok, todo = F.col("error").isNull(), F.col("todo")
    return judged.agg(F.count_if(ok & ~todo).alias("valid"), F.count_if(ok & todo).alias("fixed"), F.count_if(~ok).alias("discarded"))

"""Reports as lines of text: entries, changes and duplicates for people and as JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import iso_time, posix_mode
from ..schema import SECOND


def plain_time(ns: Column) -> Column:
    return F.date_format(F.timestamp_seconds(F.call_function("div", ns - F.pmod(ns, F.lit(SECOND)), F.lit(SECOND))), "yyyy-MM-dd HH:mm:ss")


def entry_text(entries: DataFrame) -> DataFrame:
    """(path, text): a block of lines for each entry."""
    octal = F.lpad(F.conv(posix_mode(F.col("mode")).cast("string"), 10, 8), 4, "0")
    fields = {"Size": F.concat(F.col("file_size").cast("string"), F.lit(" bytes")), "Mode": octal, "UID": F.col("uid"), "GID": F.col("gid"), "Dev": F.col("dev")}
    fields |= {"MTime": plain_time(F.col("mtime_ns")), "CTime": plain_time(F.col("ctime_ns")), "Hash Type": F.col("hash_type"), "Hash": F.col("hash"), "Deleted": F.col("is_deleted")}
    lines = [F.concat(F.lit("Path: "), F.col("path")), *[F.concat(F.lit(f"  {name}: "), c.cast("string")) for name, c in fields.items()]]
    return entries.select("path", F.concat_ws("\n", *lines).alias("text"))


def entry_json(entries: DataFrame) -> DataFrame:
    """(path, json): an object an entry, with times in ISO form to the nanosecond."""
    names = {"path": "path", "flag_is_deleted": "is_deleted", "file_size": "file_size", "mode": "mode", "uid": "uid", "gid": "gid", "dev": "dev"}
    shown = [F.col(c).alias(n) for n, c in names.items()] + [iso_time(F.col("mtime_ns")).alias("mtime"), iso_time(F.col("ctime_ns")).alias("ctime"), F.col("hash"), F.col("hash_type")]
    return entries.select("path", F.to_json(F.struct(*shown)).alias("json"))


def status_json(changes: DataFrame) -> DataFrame:
    """(path, json): an object for each path that is not unchanged."""
    return changes.filter("status <> 'unchanged'").select("path", F.to_json(F.struct("path", "status")).alias("json"))


def duplicates_json(groups: DataFrame) -> DataFrame:
    """(hash, json): an object for each duplicate group of (hash, files, count)."""
    return groups.select("hash", F.to_json(F.struct("hash", "files", "count")).alias("json"))


def duplicates_text(groups: DataFrame, form: str = "human") -> DataFrame:
    """(hash, text): the paths of each group, a line each; human has a heading line, fdupes ends with an empty line."""
    files = F.array_join("files", "\n")
    head = F.concat(F.col("count").cast("string"), F.lit(" files of hash "), F.col("hash"), F.lit(":\n"))
    return groups.select("hash", (F.concat(head, files) if form == "human" else F.concat(files, F.lit("\n"))).alias("text"))

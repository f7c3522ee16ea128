"""Row edits of an index, as new versions of its table."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import literals
from ..schema import COLUMNS, ENTRY, HASH_SIZES

#: Names of editable fields, long and short, with their column and the reader of their value.
FIELDS = {
    "ctime": ("ctime_ns", literals.time_ns),
    "mtime": ("mtime_ns", literals.time_ns),
    "dev": ("dev", lambda x: literals.integer(x, 32)),
    "ino": ("ino", lambda x: literals.integer(x, 32)),
    "uid": ("uid", lambda x: literals.integer(x, 32)),
    "gid": ("gid", lambda x: literals.integer(x, 32)),
    "mode": ("mode", lambda x: literals.integer(x, 32)),
    "file_size": ("file_size", lambda x: literals.integer(x, 63)),
    "size": ("file_size", lambda x: literals.integer(x, 63)),
    "hash_type": ("hash_type", literals.hash_type),
    "hashtype": ("hash_type", literals.hash_type),
    "hash": ("hash", literals.hash_text),
    "flag_is_deleted": ("is_deleted", literals.boolean),
    "flags": ("is_deleted", literals.boolean),
}


def keys_of(paths: list[str]) -> list[str]:
    return [literals.clean(p) for p in paths]


def update(entries: DataFrame, changes: dict[str, str], paths: list[str]) -> DataFrame:
    """Set fields of the rows with these paths. A path is no field: rows keep their keys."""
    here, out = F.col("path").isin(keys_of(paths)), entries
    for name, text in changes.items():
        if name not in FIELDS:
            raise ValueError(f"not an editable field: {name!r}")
        column, read = FIELDS[name]
        out = out.withColumn(column, F.when(here, F.lit(read(text))).otherwise(F.col(column)).cast(ENTRY[column].dataType))
    return out


def append(entries: DataFrame, row: str | dict) -> DataFrame:
    """Add a row from JSON: path and hash are required, the digest must fit its type, and the path must be new."""
    given = json.loads(row) if isinstance(row, str) else dict(row)
    if not given.get("path") or not given.get("hash"):
        raise ValueError("path and hash are required")
    given["path"] = literals.clean(given["path"])
    found = {c: 0 for c in COLUMNS} | {"is_deleted": False, "hash_type": 2, "context": "main", "path": given["path"]}
    for name, value in given.items():
        if name == "path":
            continue
        if name not in FIELDS:
            raise ValueError(f"not a field: {name!r}")
        column, read = FIELDS[name]
        found[column] = read(str(value).lower() if isinstance(value, bool) else str(value))
    if len(found["hash"]) != 2 * HASH_SIZES[found["hash_type"]]:
        raise ValueError("the digest does not fit the hash type")
    if not entries.filter(F.col("path") == found["path"]).isEmpty():
        raise ValueError(f"the path exists: {found['path']!r}")
    return entries.unionByName(entries.sparkSession.createDataFrame([tuple(found[c] for c in COLUMNS)], ENTRY).select(*entries.columns))


def remove(entries: DataFrame, paths: list[str]) -> DataFrame:
    return entries.filter(~F.col("path").isin(keys_of(paths)))


def resort(entries: DataFrame) -> DataFrame:
    return entries.orderBy("path")


def to_json(entries: DataFrame) -> DataFrame:
    """One JSON object a row."""
    return entries.select("path", F.to_json(F.struct(*entries.columns)).alias("json"))

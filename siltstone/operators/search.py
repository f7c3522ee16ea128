"""Index search: all of the given filters must hold."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..functions.literals import glob_regex
from ..functions.scalars import basename


def search(entries: DataFrame, name: str | None = None, prefix: str | None = None, hash_prefix: str | None = None, size: int | None = None, deleted: bool = False) -> DataFrame:
    """Rows by basename glob, path prefix, hash prefix in any case, and exact size; live rows, or with `deleted` only deleted ones."""
    out = entries.filter(F.col("is_deleted") if deleted else ~F.col("is_deleted"))
    if name is not None:
        out = out.filter(basename(F.col("path")).rlike(glob_regex(name)))
    if prefix:
        out = out.filter(F.col("path").startswith(prefix))
    if hash_prefix:
        out = out.filter(F.lower("hash").startswith(hash_prefix.lower()))
    if size is not None:
        out = out.filter(F.col("file_size") == size)
    return out


#: A filter of a user: a column, or what makes one of the rows, as a pandas UDF does.
Filter = Column | Callable[[DataFrame], Column]


def compose(entries: DataFrame, *filters: Filter) -> DataFrame:
    """The rows for which all filters hold, in the order given; where one is null it does not hold."""
    out = entries
    for f in filters:
        out = out.filter(F.coalesce(f if isinstance(f, Column) else f(out), F.lit(False)))
    return out


def visit(entries: DataFrame, callback: Callable[[Row], bool]) -> int:
    """Call back with each row in path order until it returns False; how many rows it has seen. Rows come a partition at a time."""
    seen = 0
    for row in entries.orderBy("path").toLocalIterator():
        seen += 1
        if callback(row) is False:
            break
    return seen


def rows_of(entries: DataFrame) -> Iterator[Row]:
    return entries.orderBy("path").toLocalIterator()

"""Aggregations over inventories: duplicates, counts, tree hashes, retention groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def duplicate_rows(entries: DataFrame) -> DataFrame:
    """(hash, path, count) of live files whose hash at least two have. Groups stay spread out: a row a file."""
    live = entries.filter("not is_deleted")
    many = live.groupBy("hash").agg(F.count("*").alias("count")).filter("count > 1")
    return live.select("hash", "path").join(many, "hash").select("hash", "path", "count")


def duplicates(entries: DataFrame) -> DataFrame:
    """(hash, files, count): one row a group, its paths in order. A group's paths make one value; duplicate_rows() has no such limit."""
    live = entries.filter("not is_deleted")
    return live.groupBy("hash").agg(F.array_sort(F.collect_list("path")).alias("files"), F.count("*").alias("count")).filter("count > 1")


def wasted_bytes(entries: DataFrame) -> DataFrame:
    """(hash, count, wasted): bytes beyond one copy, per group."""
    live = entries.filter("not is_deleted")
    return live.groupBy("hash").agg(F.count("*").alias("count"), F.max("file_size").alias("size")).filter("count > 1").select("hash", "count", ((F.col("count") - 1) * F.col("size")).alias("wasted"))


def total(column: str) -> Column:
    """The sum of a column: 0 of no rows, null beyond 64 bits, as damaged sizes may be."""
    return F.when(F.count(column) == 0, F.lit(0).cast("long")).otherwise(F.try_sum(column))


def stats(entries: DataFrame) -> DataFrame:
    return entries.filter("not is_deleted").agg(F.count("*").alias("n_files"), total("file_size").alias("total_size"))


def counts(entries: DataFrame) -> DataFrame:
    return entries.agg(F.count("*").alias("total"), F.count_if("is_deleted").alias("deleted"), F.count_if(~F.col("is_deleted")).alias("active"))


def tree_hash(files: DataFrame) -> DataFrame:
    """sha256 over the sorted name:hash lines of (name, hash): one row. For the few files of a snapshot."""
    lines = F.array_sort(F.collect_list(F.concat_ws(":", "name", "hash")))
    return files.agg(F.sha2(F.array_join(lines, "\n"), 256).alias("tree"))


def table_hash(entries: DataFrame, digits: int = 4) -> DataFrame:
    """One row, tree: a hash of all path:hash pairs of a table of any size. Rows are dealt out by the first digits of their path's hash,
    each of those groups gets a tree_hash of its own, and those make one of their own."""
    group = F.substring(F.sha2("path", 256), 1, digits)
    lines = F.array_sort(F.collect_list(F.concat_ws(":", "path", "hash")))
    groups = entries.groupBy(group.alias("name")).agg(F.sha2(F.array_join(lines, "\n"), 256).alias("hash"))
    return tree_hash(groups)


def first_last(entries: DataFrame) -> DataFrame:
    """One row, first and last: the ends of the path order."""
    return entries.agg(F.min("path").alias("first"), F.max("path").alias("last"))


def summary(entries: DataFrame) -> DataFrame:
    """Files, bytes, and rows of each index of a snapshot: one row."""
    of = lambda c: F.count_if(F.col("context") == c)
    return entries.agg(
        F.count("*").alias("files_count"), total("file_size").alias("total_size"), of("main").alias("main_entries"), of("cache").alias("cache_entries"), of("scan").alias("scan_entries")
    )


def period(time: Column, granularity: str) -> Column:
    """The group of a time: hourly, daily, weekly (ISO), monthly, yearly. Texts that sort as the periods do."""
    formats = {"hourly": "yyyy-MM-dd HH", "daily": "yyyy-MM-dd", "monthly": "yyyy-MM", "yearly": "yyyy"}
    if granularity == "weekly":
        year = F.extract(F.lit("YEAROFWEEK"), time).cast("string")
        return F.concat(F.lpad(year, 4, "0"), F.lit("-W"), F.lpad(F.weekofyear(time).cast("string"), 2, "0"))
    return F.date_format(time, formats[granularity])


def retained(snapshots: DataFrame, granularity: str, limit: int) -> DataFrame:
    """The latest snapshot of each of the last `limit` periods, for (id, time); ties in time go to the larger id. With a limit of 0 or less,
    none. Snapshots are pre-aggregated by period; only one row a period is ranked."""
    keyed = snapshots.withColumn("period", period(F.col("time"), granularity))
    latest = keyed.groupBy("period").agg(F.max(F.struct("time", "id")).alias("last"))
    last = latest.orderBy(F.desc("period")).limit(max(0, limit))
    return last.select(F.col("last.id").alias("id"), F.col("last.time").alias("time"), "period")


def retention(snapshots: DataFrame, policy: dict[str, int]) -> DataFrame:
    """The snapshots, as (id, time), that a policy of limits by granularity keeps."""
    kept = None
    for granularity, limit in policy.items():
        one = retained(snapshots, granularity, limit).select("id", "time")
        kept = one if kept is None else kept.unionAll(one)
    return (kept if kept is not None else snapshots.select("id", "time").limit(0)).distinct()


def forgotten(snapshots: DataFrame, policy: dict[str, int]) -> DataFrame:
    return snapshots.join(retention(snapshots, policy).select("id"), "id", "left_anti")


def newest_scan(scans: DataFrame) -> DataFrame:
    """The newest of the scan indices among (name, time), ties by name: one row, or none."""
    return scans.filter(F.col("name").rlike("^scan-")).orderBy(F.desc("time"), F.desc("name")).limit(1)


def latest(snapshots: DataFrame, n: int = 1) -> DataFrame:
    return snapshots.orderBy(F.desc("time"), F.desc("id")).limit(n)


def ranked(df: DataFrame, by: str, order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group."""
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter(F.col("_rank") <= n).drop("_rank")

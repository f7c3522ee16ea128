"""Line deduplication with levelled sorted runs.

Documents come in batches by ascending doc_id. A run is a table of (key, owner), dealt out and sorted by key: the keys that one batch, or
several compacted ones, saw first, and the smallest doc_id that holds each. A new batch merge-anti-joins the runs: its keys that no
run has become a run of their own at level 0; FANOUT runs of a level are merged into one of the next, so a batch reads a logarithmic
number of runs. All runs are bucketed alike, so a batch is shuffled once, as one row a key and task, and the runs never are.

Lines travel as 128-bit hashes. The lines of all batches meet the repeated keys in one join at the end, by shuffle, where Spark splits a
key that very many lines have.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import SPACE, drop, materialize, release, scratch, seal, tasks

FANOUT = 2


def line_key(line: Column) -> Column:
    """The line with white space stripped at both ends and A-Z lower-cased."""
    bare = F.regexp_replace(line, f"^{SPACE}+|{SPACE}+$", "")
    return F.translate(bare, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


class LineRuns:
    """The levelled runs: levels[i] is a list of (frame, table). close() drops their tables."""

    def __init__(self, fanout: int = FANOUT) -> None:
        self.fanout, self.levels, self.buckets, self.paths = fanout, [], None, {}

    def all(self) -> DataFrame | None:
        runs = [df.select("key", "owner") for level in self.levels for df, _ in level]
        return reduce(DataFrame.unionAll, runs) if runs else None

    def write(self, df: DataFrame, tag: str) -> tuple[DataFrame, str]:
        """df as a table in the shared folder, bucketed and sorted by key."""
        spark = df.sparkSession
        self.buckets = self.buckets or tasks(spark)
        name, path = f"siltstone_{tag}_{uuid.uuid4().hex}", scratch(spark, tag)
        df.write.option("compression", "zstd").option("path", path).bucketBy(self.buckets, "key").sortBy("key").saveAsTable(name)
        self.paths[name] = path
        return spark.table(name), name

    def forget(self, spark: SparkSession, name: str) -> None:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        drop(spark, self.paths.pop(name))

    def close(self, spark: SparkSession) -> None:
        for name in list(self.paths):
            self.forget(spark, name)
        self.levels = []

    def judge(self, keys: DataFrame) -> DataFrame:
        """keys, of (key, owner, shared), against the runs: a key that a run has takes its owner and is shared; fresh says that none
        has it."""
        out = keys.withColumn("fresh", F.lit(True))
        for df, _ in (run for level in self.levels for run in level):
            older = df.select("key", F.col("owner").alias("first"))
            joined = out.join(older.hint("merge"), "key", "left")
            found = F.col("first").isNotNull()
            out = joined.select("key", F.coalesce("first", "owner").alias("owner"), (F.col("shared") | found).alias("shared"), (F.col("fresh") & ~found).alias("fresh"))
        return out

    def add(self, keys: DataFrame) -> None:
        """keys: (key, owner), none of which a run has."""
        self.put(*self.write(keys.select("key", "owner"), "run0"))

    def put(self, df: DataFrame, name: str, level: int = 0) -> None:
        """df: the run in the table of that name."""
        if len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append((df, name))
        if len(self.levels[level]) >= self.fanout:
            merged, self.levels[level] = self.levels[level], []
            self.put(*self.write(reduce(merge, [df for df, _ in merged]), f"run{level + 1}"), level + 1)
            for _, name in merged:
                self.forget(df.sparkSession, name)


def merge(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two runs as one, by a merge join: no key is in both."""
    a, b = a.select("key", "owner"), b.select(F.col("key").alias("k"), F.col("owner").alias("o"))
    both = a.join(b.hint("merge"), F.col("key") == F.col("k"), "full")
    return both.select(F.coalesce("key", "k").alias("key"), F.coalesce("owner", "o").alias("owner"))


def dropped_lines(docs: DataFrame, batches: int = 4, min_chars: int = 10, runs: LineRuns | None = None) -> DataFrame:
    """(doc_id, dropped array<int>): the line numbers, from 0, that each document loses; documents that lose none are absent.

    A line goes if its key has at least min_chars code points and a smaller doc_id holds the key too (in these documents or in
    the runs given, which are extended; their documents count as earlier ones). Null and empty texts are one empty line. Rows that
    share a doc_id are one document. Null doc_ids lose nothing and count for nothing. Batches have about the same number of rows,
    wherever their doc_ids lie.
    """
    spark, own = docs.sparkSession, runs is None
    lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    keys = F.transform(lines, lambda x, i: F.struct(i.alias("i"), line_key(x).alias("key")))
    long = F.filter(keys, lambda x: F.length(x["key"]) >= min_chars)
    cuts = docs.agg(F.percentile_approx("doc_id", [k / batches for k in range(1, batches)], 10_000)).first()[0] if batches > 1 else []
    batch = reduce(lambda a, b: a + b, [F.when(F.col("doc_id") > c, 1).otherwise(0) for c in cuts or []], F.lit(0))
    hashed, path = materialize(
        docs.filter("doc_id is not null")
        .select("doc_id", batch.alias("batch"), F.explode(long).alias("x"))
        .select("doc_id", F.col("x.i").alias("i"), F.unhex(F.substring(F.sha2("x.key", 256), 1, 32)).alias("key"), "batch"),
        "lines",
        "batch",
    )
    runs = runs or LineRuns()
    repeated = []
    for b in range(len(cuts or []) + 1):
        mine = hashed.filter(F.col("batch") == b).groupBy("key").agg(F.min("doc_id").alias("owner"), (F.min("doc_id") < F.max("doc_id")).alias("shared"))
        found, name = runs.write(runs.judge(mine), "run0")
        repeated.append(materialize(found.filter("shared").select("key", "owner"), "repeated"))
        if own and b == len(cuts or []):
            runs.forget(spark, name)  # nothing comes after the last batch
        else:
            runs.put(found.filter("fresh").select("key", "owner"), name)
    # a key may be shared in several batches, always with the same owner
    owners = reduce(DataFrame.unionAll, [df for df, _ in repeated]).distinct()
    lost = hashed.join(owners.hint("merge"), "key").filter("owner <> doc_id").select("doc_id", "i")
    out, _ = materialize(lost.groupBy("doc_id").agg(F.array_sort(F.collect_set("i")).alias("dropped")), "dropped")
    if own:
        runs.close(spark)
    drop(spark, path, *[there for _, there in repeated])
    release(spark)
    return out


def dedup_lines(docs: DataFrame, batches: int = 4, min_chars: int = 10) -> DataFrame:
    """docs with the lines that dropped_lines() names removed from text, plus _n_lines, _n_dropped (long); columns of docs of those
    names are replaced. Every row is kept; a null text stays null. An empty table gives no rows."""
    sealed, open_ = seal(docs.drop("_n_lines", "_n_dropped"), "doc_id", "text")
    gone = dropped_lines(sealed.select("doc_id", "text"), batches, min_chars).withColumnRenamed("doc_id", "doc")
    joined = sealed.join(gone.hint("merge"), F.col("doc_id") == F.col("doc"), "left")
    lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    numbers = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("dropped"))
    kept = F.array_join(F.transform(numbers, lambda i: F.get(lines, i)), "\n")
    return open_(
        joined,
        text=F.when(F.col("dropped").isNull(), F.col("text")).otherwise(kept),
        _n_lines=F.size(lines).cast("long"),
        _n_dropped=F.coalesce(F.size("dropped"), F.lit(0)).cast("long"),
    )

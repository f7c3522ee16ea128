"""Helpers that the training-data operators share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of every word rule here: space, and tab to carriage return.
SPACE = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path in the cluster's shared checkpoint folder. Where none is configured, one is made for the process if all tasks run on
    this machine, as in tests; on a cluster that is an error."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="siltstone-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
        sc.setCheckpointDir(root)
    return f"{root.rstrip('/')}/siltstone/{tag}-{uuid.uuid4().hex}"


def drop(spark: SparkSession, *paths: str) -> None:
    """Remove scratch tables, wherever the shared folder is."""
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def materialize(df: DataFrame, tag: str, *partition_by: str) -> tuple[DataFrame, str]:
    """Write df to the shared folder and read it again: lineage ends here, and a lost executor costs no recomputation."""
    path = scratch(df.sparkSession, tag)
    write = df.write.option("compression", "zstd")
    (write.partitionBy(*partition_by) if partition_by else write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def seal(docs: DataFrame, *used: str) -> tuple[DataFrame, Callable[..., DataFrame]]:
    """docs as its `used` columns and one struct, `others`, of all others, so that names made on the way never meet theirs; and a function
    that takes a frame with those columns apart again: docs' columns in order, with the given ones replaced or added."""
    others = [c for c in docs.columns if c not in used]
    quoted = lambda c: F.col("`" + c.replace("`", "``") + "`")
    sealed = docs.select(*map(quoted, used), *([F.struct(*map(quoted, others)).alias("others")] if others else []))

    def open_(df: DataFrame, **made: Column) -> DataFrame:
        kept = [made[c].alias(c) if c in made else F.col(c) if c in used else F.col("others").getField(c).alias(c) for c in docs.columns]
        return df.select(*kept, *[x.alias(c) for c, x in made.items() if c not in docs.columns])

    return sealed, open_


def join_with_hot(left: DataFrame, right: DataFrame, key: str, rows: int, n: str, most: int = 50_000) -> DataFrame:
    """The inner join of left with right's one row a key, where right's column n is the number of left's rows with the key, `rows` in all.
    Frequent keys, of which there are at most `most`, meet by broadcast, so that no task has all rows of one; others by shuffle."""
    hot = F.col(n) > max(1000, -(-rows // most))
    few = F.broadcast(right.filter(hot))
    others = left.join(few.select(key), key, "left_anti").join(right.filter(~hot).hint("merge"), key)
    return left.join(few, key).unionByName(others)


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of plans that nothing refers to any more: its cleaner learns that from the collector of the
    driver, which by itself runs about every half hour, while the files would count against the disk for as long."""
    import gc

    gc.collect()
    spark._jvm.System.gc()


def ship(spark: SparkSession) -> None:
    """Give executors this package, once for each application: they need not have it installed."""
    sc = spark.sparkContext
    if getattr(sc, "_siltstone_shipped", False):
        return
    import pathlib
    import zipfile

    top = pathlib.Path(__file__).resolve().parents[1]
    # stays until the process ends: executors that start later fetch it then
    folder = tempfile.mkdtemp(prefix="siltstone-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = f"{folder}/{top.name}.zip"
    with zipfile.ZipFile(path, "w") as z:
        for file in sorted(top.rglob("*.py")):
            z.write(file, file.relative_to(top.parent))
    sc.addPyFile(path)
    sc._siltstone_shipped = True


#: Bytes of a batch that goes to a Python worker. Set for the session: Spark's own 64 MB, held in the JVM and the worker for each
#: task, are much of an executor's memory outside its heap.
BATCH = 4 << 20


#: What a worker remembers between tasks, by the operator that uses it. Only one operator's is kept.
_remembered: dict[str, object] = {}


def remember(owner: str, make: Callable[[], object]) -> object:
    """owner's memory in this worker; what other operators have left there goes."""
    if owner not in _remembered:
        _remembered.clear()
        _remembered[owner] = make()
    return _remembered[owner]


def settle() -> None:
    """Give memory that a task has freed back to the system: workers stay, and allocators keep what they once had."""
    import ctypes

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library
    if trim is not None:
        trim(0)


def map_arrow(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    ship(df.sparkSession)
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from f(batches)
        finally:
            settle()

    return df.mapInArrow(run, schema)


def tasks(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def n_words(text: Column) -> Column:
    """Number of maximal runs of non-white characters; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    parts = F.size(F.split(text, SPACE + "+"))
    edge = lambda c: F.when(c.rlike(SPACE), 1).otherwise(0)
    return (
        F.when(F.length(text) == 0, F.lit(0))
        .otherwise(parts - edge(F.substring(text, 1, 1)) - edge(F.substring(text, -1, 1)))
        .cast("long")
    )


def spread(frame: pa.Array) -> tuple[memoryview, np.ndarray]:
    """The UTF-8 bytes of a string or binary array, and the offset of each row in them (one more than rows). Nulls are empty."""
    large = frame.cast(pa.large_binary())
    if large.null_count:
        large = large.fill_null(b"")
    offsets = np.frombuffer(large.buffers()[1], dtype=np.int64)[large.offset : large.offset + len(large) + 1]
    return memoryview(large.buffers()[2] or b""), offsets


def slices(batch: pa.RecordBatch, column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about `most` bytes of one column, so that what is made of a piece stays bounded. One row is never cut."""
    at = batch.schema.get_field_index(column)
    _, offsets = spread(batch.column(at))
    start, rows = 0, batch.num_rows
    while start < rows:
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + most, "right")) - 1)
        yield batch.slice(start, min(end, rows) - start)
        start = end

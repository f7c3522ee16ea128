"""Inventories as streams: batches of changed rows are merged into a table, and per-path status follows from state."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.aggregate import ranked
from ..operators.diff import STATUS_FIELDS
from ..schema import COLUMNS
from ..store import Conflict, Store

#: How often a batch is merged anew when other writers come first.
TRIES = 5


def query_id(spark: SparkSession, checkpoint: str) -> str:
    """What a stream is known by for as long as it has its checkpoint folder: written there before its first batch."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint.rstrip('/')}/metadata")
    stream = path.getFileSystem(spark._jsc.hadoopConfiguration()).open(path)
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())["id"]
    finally:
        stream.close()


def merge_into(stream: DataFrame, store: Store, name: str, checkpoint: str) -> StreamingQuery:
    """Merge each micro-batch of ENTRY rows over a table; of rows of one path in a batch the latest ctime wins.

    A batch becomes a delta, marked with the stream and the number of the batch in the same commit, so a batch that is repeated after a
    failure is merged once, and other streams, or a stream with a new checkpoint, are told apart. A batch that loses against another
    writer is tried again on the new state.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        last = ranked(batch, "path", [F.desc("ctime_ns"), F.desc("mtime_ns"), F.desc("hash")], 1).select(*COLUMNS)
        source = query_id(stream.sparkSession, checkpoint)
        for attempt in range(TRIES):
            try:
                store.merge(name, last, "stream", f"batch {batch_id}", (source, batch_id))
                return
            except Conflict:
                if attempt == TRIES - 1:
                    raise

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def continuous_status(stream: DataFrame) -> DataFrame:
    """(path, status) for each arriving row, against the last row of its path."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        fields = list(STATUS_FIELDS)
        last = state.get if state.exists else None
        out = []
        for frame in frames:
            for r in frame.sort_values(["ctime_ns", "mtime_ns"]).itertuples():
                now = (*(int(getattr(r, f)) for f in fields), bool(r.is_deleted))
                before = None if last is None or last[-1] else last
                if r.is_deleted:
                    kind = "deleted" if before is not None else None
                else:
                    kind = "added" if before is None else "unchanged" if tuple(before) == now else "modified"
                if kind:
                    out.append((key[0], kind))
                last = now
        state.update(last)
        yield pd.DataFrame(out, columns=["path", "status"])

    state = ", ".join(f"{f} long" for f in STATUS_FIELDS) + ", is_deleted boolean"
    return stream.groupBy("path").applyInPandasWithState(step, "path string, status string", state, "append", GroupStateTimeout.NoTimeout)


def event_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events per window and type; what is later than the watermark is dropped."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")

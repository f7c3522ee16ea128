"""Versioned tables: each write is a new Parquet folder, and a numbered log file says what the table consists of since.

A log file holds the whole history and is never changed: it is written beside and then put in its place only if that place is free, so of
two writers that started from the same history one fails, and a reader or a crash between any two steps sees the history before
or after. A version is a full table, or one with small deltas over it that a reader merges by path; deltas are compacted as they
grow. Files go through Hadoop's file system, so a store may be on any one that Spark reads and that can rename without overwriting.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.aggregate import ranked
from .operators.diff import overlay
from .schema import ENTRY

#: Deltas are merged into one when there are more, and into the table when they have this share of its rows.
DELTAS, SHARE = 8, 0.25
#: Log files that are kept, the newest included.
LOGS = 10


class Conflict(RuntimeError):
    """Another writer has changed the table in the meantime."""


class Store:
    """Named ENTRY tables below a folder, each with a history of versions."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    # log files
    def _logs(self, name: str) -> list[str]:
        """Oldest first."""
        top = self._path(f"{self.folder}/{name}/_log")
        if not self._fs.exists(top):
            return []
        found = [s.getPath().getName() for s in self._fs.listStatus(top)]
        return sorted(f for f in found if f.endswith(".json") and f[:12].isdigit())

    def _state(self, name: str) -> tuple[int, dict]:
        """The number of the newest log file (0: none) and what it says."""
        logs = self._logs(name)
        if not logs:
            return 0, {"versions": [], "applied": {}}
        stream = self._fs.open(self._path(f"{self.folder}/{name}/_log/{logs[-1]}"))
        try:
            return int(logs[-1][:12]), json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _commit(self, name: str, number: int, state: dict) -> None:
        """Make state what follows on log file `number`, unless something else already does."""
        top = f"{self.folder}/{name}/_log"
        new, to = self._path(f"{top}/{uuid.uuid4().hex}.new"), self._path(f"{top}/{number + 1:012d}.json")
        out = self._fs.create(new, False)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        if self._fs.getScheme() == "file":  # its rename would overwrite
            try:
                os.link(new.toUri().getPath(), to.toUri().getPath())
                won = True
            except FileExistsError:
                won = False
            self._fs.delete(new, False)
        else:
            won = bool(self._fs.rename(new, to))
            if not won:
                self._fs.delete(new, False)
        if not won:
            raise Conflict(f"{name} was changed by another writer")
        for old in self._logs(name)[:-LOGS]:
            self._fs.delete(self._path(f"{top}/{old}"), False)

    def versions(self, name: str) -> list[dict]:
        """Oldest first: version, time, operation, description, parts (folders, a full table and deltas over it) and their rows."""
        return self._state(name)[1]["versions"]

    def exists(self, name: str) -> bool:
        return bool(self.versions(name))

    def names(self) -> list[str]:
        if not self._fs.exists(self._path(self.folder)):
            return []
        found = [s.getPath().getName() for s in self._fs.listStatus(self._path(self.folder)) if s.isDirectory()]
        return sorted(f for f in found if self.exists(f))

    # reading
    def _part(self, name: str, part: str) -> DataFrame:
        return self.spark.read.schema(ENTRY).parquet(f"{self.folder}/{name}/{part}")

    def _deltas(self, name: str, parts: list[str]) -> DataFrame:
        """Of each path the row of the last delta that has it."""
        rows = reduce(DataFrame.unionByName, [self._part(name, p).withColumn("part", F.lit(k)) for k, p in enumerate(parts)])
        return ranked(rows, "path", [F.desc("part")], 1).drop("part")

    def read(self, name: str, version: str | None = None) -> DataFrame:
        """The current or a given version; an unknown table is empty."""
        history = self.versions(name)
        if not history:
            return self.spark.createDataFrame([], ENTRY)
        parts = history[-1]["parts"] if version is None else next(h["parts"] for h in history if h["version"] == version)
        base = self._part(name, parts[0])
        return base if len(parts) == 1 else overlay(base, self._deltas(name, parts[1:]))

    # writing
    def _put(self, name: str, df: DataFrame) -> tuple[str, int]:
        """A new folder of df, and its rows: sorted files in ranges of paths, so that row groups can be skipped by path."""
        part = f"v{uuid.uuid4().hex}"
        df.select(*ENTRY.fieldNames()).repartitionByRange("path").sortWithinPartitions("path").write.parquet(f"{self.folder}/{name}/{part}")
        return part, self._part(name, part).count()

    def _add(self, name: str, number: int, state: dict, parts: list[tuple[str, int]], operation: str, description: str, mark: tuple[str, int] | None) -> str:
        version = f"v{number:06d}-{parts[-1][0][1:9]}"
        entry = {"version": version, "time": time.time_ns(), "operation": operation, "description": description, "parts": [p for p, _ in parts], "rows": [n for _, n in parts]}
        applied = state["applied"] | ({mark[0]: mark[1]} if mark else {})
        self._commit(name, number, {"versions": [*state["versions"], entry], "applied": applied})
        return version

    def write(self, name: str, df: DataFrame, operation: str = "write", description: str = "") -> str:
        """A new full version. Raises Conflict if another writer was first; nothing is changed then."""
        number, state = self._state(name)
        return self._add(name, number, state, [self._put(name, df)], operation, description, None)

    def merge(self, name: str, rows: DataFrame, operation: str = "merge", description: str = "", mark: tuple[str, int] | None = None) -> str | None:
        """A new version with rows, one a path, over the current one: only they are written, until deltas are compacted. A mark (source,
        number) that is not above the last one of its source has been merged already: nothing is done, also if that version was undone."""
        number, state = self._state(name)
        if mark and state["applied"].get(mark[0], -1) >= mark[1]:
            return None
        new = self._put(name, rows)
        last = state["versions"][-1] if state["versions"] else None
        parts = [*zip(last["parts"], last["rows"]), new] if last else [new]
        small = sum(n for _, n in parts[1:])
        if len(parts) > 1 and small > SHARE * parts[0][1]:
            parts = [self._put(name, overlay(self._part(name, parts[0][0]), self._deltas(name, [p for p, _ in parts[1:]])))]
        elif len(parts) > 1 + DELTAS:
            parts = [parts[0], self._put(name, self._deltas(name, [p for p, _ in parts[1:]]))]
        return self._add(name, number, state, parts, operation, description, mark)

    # history
    def _keep(self, name: str, number: int, state: dict, kept: list[dict]) -> None:
        """Commit a shorter history, then delete the folders that it no longer names."""
        self._commit(name, number, state | {"versions": kept})
        used = {p for h in kept for p in h["parts"]}
        for part in sorted({p for h in state["versions"] for p in h["parts"]} - used):
            self._fs.delete(self._path(f"{self.folder}/{name}/{part}"), True)

    def pop(self, name: str) -> dict:
        """Undo the newest version."""
        number, state = self._state(name)
        if len(state["versions"]) < 2:
            raise ValueError(f"nothing to undo: {name}")
        self._keep(name, number, state, state["versions"][:-1])
        return state["versions"][-1]

    def discard(self, name: str, version: str) -> None:
        """Drop one older version; the current one cannot be dropped."""
        number, state = self._state(name)
        if not state["versions"] or version == state["versions"][-1]["version"]:
            raise ValueError("the current version cannot be discarded")
        if all(h["version"] != version for h in state["versions"]):
            raise ValueError(f"no such version: {version!r}")
        self._keep(name, number, state, [h for h in state["versions"] if h["version"] != version])

    def clear(self, name: str) -> None:
        """Drop all versions but the current one."""
        number, state = self._state(name)
        if len(state["versions"]) > 1:
            self._keep(name, number, state, state["versions"][-1:])

    def orphans(self, name: str) -> list[str]:
        """Folders and files that no version names: what failed or interrupted writes have left, or writes under way."""
        top = self._path(f"{self.folder}/{name}")
        if not self._fs.exists(top):
            return []
        used = {p for h in self.versions(name) for p in h["parts"]} | {"_log"}
        return sorted(f for f in (s.getPath().getName() for s in self._fs.listStatus(top)) if f not in used)

    def sweep(self, name: str) -> list[str]:
        """Delete the orphans. Not while anyone writes."""
        gone = self.orphans(name)
        for f in gone:
            self._fs.delete(self._path(f"{self.folder}/{name}/{f}"), True)
        return gone

    def drop(self, name: str) -> None:
        self._fs.delete(self._path(f"{self.folder}/{name}"), True)

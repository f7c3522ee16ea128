"""Scan of a directory tree: one ENTRY a regular file or symbolic link to a file, hashes only where asked for."""

from __future__ import annotations

import hashlib
import os
import stat
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.literals import prune_roots
from ..schema import COLUMNS, ENTRY, HASH_NAMES, LINK, SETGID, SETUID, STICKY

BUFFER = 2 << 20
SYMLINKS = ("none", "contained", "all")


def inventory_mode(st_mode: int) -> int:
    """POSIX st_mode as the inventory keeps it."""
    bits = st_mode & 0o777 | (LINK if stat.S_ISLNK(st_mode) else 0)
    return bits | (SETUID if st_mode & 0o4000 else 0) | (SETGID if st_mode & 0o2000 else 0) | (STICKY if st_mode & 0o1000 else 0)


def row(root: str, path: str, info: os.stat_result, hash_type: int) -> tuple:
    return (path, info.st_size, inventory_mode(info.st_mode), info.st_uid, info.st_gid, info.st_dev & 0xFFFFFFFF, info.st_ino & 0xFFFFFFFF, info.st_ctime_ns, info.st_mtime_ns, False, hash_type, "", "scan")


def walk(root: str, top: str, hash_type: int, symlinks: str, ignored: Callable[[str], bool], skip: frozenset[str]) -> Iterator[tuple]:
    """Rows under top, a path relative to root. What cannot be read is skipped. Links to directories are followed once for each directory,
    so that cycles end."""
    real_root, seen = os.path.realpath(root), set()

    def visit(path: str) -> Iterator[tuple]:
        if path and (path in skip or ignored(path)):
            return
        full = os.path.join(root, path) if path else root
        try:
            info = os.lstat(full)
            target = os.stat(full) if stat.S_ISLNK(info.st_mode) else info
        except OSError:
            return
        if stat.S_ISDIR(target.st_mode):
            if stat.S_ISLNK(info.st_mode):
                inside = os.path.realpath(full)
                if symlinks == "none" or symlinks == "contained" and inside != real_root and not inside.startswith(real_root + os.sep):
                    return
            if (target.st_dev, target.st_ino) in seen:
                return
            seen.add((target.st_dev, target.st_ino))
            try:
                names = os.listdir(full)
            except OSError:
                return
            for name in names:
                yield from visit(f"{path}/{name}" if path else name)
        elif stat.S_ISREG(target.st_mode):
            yield row(root, path, info, hash_type)

    yield from visit(top)


def hash_file(path: str, hash_type: int, buffer: int = BUFFER) -> str:
    """Hex digest of a file's bytes, or of a link's target path; empty if it cannot be read."""
    made = hashlib.new(HASH_NAMES[hash_type])
    try:
        if os.path.islink(path):
            made.update(os.fsencode(os.readlink(path)))
        else:
            with open(path, "rb") as f:
                while block := f.read(buffer):
                    made.update(block)
    except OSError:
        return ""
    return made.hexdigest()


def scan(spark: SparkSession, root: str, paths: list[str] | None = None, hash_type: int = 2, symlinks: str = "all", patterns: list[str] | None = None, skip: tuple[str, ...] = ()) -> DataFrame:
    """The live files under the roots, without hashes. Directories of the first level are walked by tasks of their own; root must be a
    folder that all executors see."""
    import re

    if symlinks not in SYMLINKS:
        symlinks = "all"
    rules = [re.compile(p) for p in patterns or []]
    ignored = lambda p: any(r.search(p) for r in rules)
    tops = []
    for top in prune_roots(paths or [""]):
        if any(ignored("/".join(top.split("/")[: i + 1])) for i in range(top.count("/") + 1 if top else 0)):
            continue
        full = os.path.join(root, top)
        if os.path.isdir(full) and not os.path.islink(full):
            tops += [(f"{top}/{name}" if top else name,) for name in sorted(os.listdir(full))]
        else:
            tops.append((top,))
    hidden = frozenset(skip)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for top in frame["top"]:
                rows = list(walk(root, top, hash_type, symlinks, ignored, hidden))
                if rows:
                    yield pd.DataFrame(rows, columns=COLUMNS)

    if not tops:
        return spark.createDataFrame([], ENTRY)
    tasks = min(len(tops), 4 * spark.sparkContext.defaultParallelism)
    found = spark.createDataFrame(tops, "top string").repartition(tasks, "top").mapInPandas(run, ENTRY)
    return found.dropDuplicates(["path"])  # directories reached by a link and by themselves keep their paths apart


def with_hashes(df: DataFrame, root: str, workers: int = 4, buffer: int = BUFFER) -> DataFrame:
    """df with the hash of each row's file, read in blocks of `buffer` bytes. Rows are dealt out by path over several tasks for each worker,
    so that a huge file holds up only the few files of its own task."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            frame["hash"] = [hash_file(os.path.join(root, p), int(t), buffer) for p, t in zip(frame["path"], frame["hash_type"])]
            yield frame

    tasks = 8 * max(workers, df.sparkSession.sparkContext.defaultParallelism)
    return df.repartition(tasks, F.xxhash64("path")).mapInPandas(run, df.schema)

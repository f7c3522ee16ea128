"""A file index over one directory tree: update, status, duplicates, find, edits, snapshots, recovery."""

from __future__ import annotations

import datetime as dt
import getpass
import hashlib
import json
import logging
import os
import re
import shutil
import socket
import time
from collections.abc import Callable

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from .config import Config, IgnoreRules
from .functions.literals import clean, human_size, prune_roots
from .functions.scalars import under
from .operators import aggregate, diff, edit, report, search, validate
from .plans import find as find_plan
from .schema import ENTRY, HASH_NAMES
from .sources import binary, walker
from .store import Store

FOLDER = ".siltstone"
#: The signature of binary index files that this engine writes.
SIGNATURE = b"SILT"
log = logging.getLogger(__name__)


def pid_of(name: str) -> int | None:
    """The process number in the name of a scan or temporary file."""
    found = re.match(r"(?:scan|tmp)-(\d+)", name)
    return int(found[1]) if found else None


def alive(pid: int) -> bool:
    try:
        os.kill(pid, 0)
    except ProcessLookupError:
        return False
    except PermissionError:
        pass
    return True


def find_root(start: str, folder: str = FOLDER) -> str:
    """The nearest directory at or above start that has an index."""
    here = os.path.realpath(start)
    while not os.path.isdir(os.path.join(here, folder)):
        if here == os.path.dirname(here):
            raise FileNotFoundError(f"no index at or above {start}")
        here = os.path.dirname(here)
    return here


class FileIndex:
    """main holds the last full state; cache holds what has changed since, as a delta over main."""

    def __init__(self, spark: SparkSession, root: str, folder: str = FOLDER) -> None:
        self.spark, self.root, self.folder = spark, os.path.realpath(root), folder
        self.home = os.path.join(self.root, folder)
        os.makedirs(self.home, exist_ok=True)
        self.store = Store(spark, f"file://{self.home}/tables")
        self.config = Config.load(os.path.join(self.home, "config")).check()
        self.rules = IgnoreRules.load(os.path.join(self.home, "ignore"))
        if not self.store.exists("main"):
            self.store.write("main", spark.createDataFrame([], ENTRY), "create")

    @property
    def hash_type(self) -> int:
        return {v: k for k, v in HASH_NAMES.items()}[self.config.hash_default.lower()]

    def scan(self, paths: list[str] | None = None) -> DataFrame:
        return walker.scan(self.spark, self.root, paths, self.hash_type, self.config.symlink_mode, self.rules.patterns, (self.folder,))

    def hashed(self, df: DataFrame) -> DataFrame:
        return walker.with_hashes(df, self.root, self.config.hash_workers, human_size(self.config.buffer))

    @property
    def repository_id(self) -> str:
        """32 hex digits that this index has from its first day."""
        path = os.path.join(self.home, "id")
        if not os.path.exists(path):
            with open(path, "w", encoding="utf-8") as f:
                f.write(hashlib.sha256(str(time.time_ns()).encode()).hexdigest()[:32])
        with open(path, encoding="utf-8") as f:
            return f.read()

    def working(self) -> DataFrame:
        """main with the cache over it."""
        main = self.store.read("main").withColumn("context", F.lit("main"))
        return diff.overlay(main, self.store.read("cache").withColumn("context", F.lit("cache"))) if self.store.exists("cache") else main

    def _compare(self, index: DataFrame, paths: list[str] | None = None, rehash: bool = False) -> DataFrame:
        """The new state of what lies under the paths. The walk is kept, so that it runs once; only new and changed files are read."""
        plan = diff.scan_diff(self.scan(paths), index).persist()
        known = plan.filter(~F.col("needs_hash") & ~F.lit(rehash) | F.col("is_deleted"))
        fresh = plan.filter((F.col("needs_hash") | F.lit(rehash)) & ~F.col("is_deleted"))
        return known.drop("needs_hash").unionByName(self.hashed(fresh.drop("needs_hash")))

    def _in(self, df: DataFrame, paths: list[str]) -> tuple[DataFrame, DataFrame]:
        here = F.lit(False)
        for p in paths:
            here = here | under(F.col("path"), p)
        return df.filter(here), df.filter(~here)

    def update(self, paths: list[str] | None = None, rehash: bool = False) -> None:
        """Bring main up to date, or only what lies under the paths; the rest then stays as it is. Files that cannot be read have no row."""
        index = self.working()
        if paths:
            roots = prune_roots([clean(os.path.relpath(os.path.join(self.root, p), self.root)) for p in paths])
            inside, outside = self._in(index, roots)
            rows = self._compare(inside, roots, rehash).unionByName(self._in(self.store.read("main"), roots)[1])
        else:
            rows = self._compare(index, None, rehash)
        self.store.write("main", diff.writable(rows.withColumn("context", F.lit("main")), "main"), "update", ", ".join(paths or []))
        if paths:
            self.refresh()
        else:
            self.store.drop("cache")
        self.spark.catalog.clearCache()

    def refresh(self) -> DataFrame:
        """Write the cache: what differs from main on disk now. Returns the working state."""
        before = self.working()
        rows = self._compare(before)
        # a file that is still gone stays marked for as long as main has it
        still = before.filter("is_deleted").join(rows.select("path"), "path", "left_anti").select(*rows.columns)
        changed = diff.delta(rows.unionByName(still))
        if changed.isEmpty():
            self.store.drop("cache")
        else:
            self.store.write("cache", diff.writable(changed, "cache"), "refresh")
        self.spark.catalog.clearCache()
        return self.working()

    def status(self) -> DataFrame:
        """(path, status) of main against the disk, in path order."""
        return diff.status(self.store.read("main"), self.refresh()).orderBy("path")

    def status_report(self, verbose: int | None = None) -> dict:
        """How many paths of each status; with a verbose level above 0 (the configured one, if none is given) also whether each table is
        clean, that is, has no remains of unfinished writes, and what lies around."""
        counts = diff.status_counts(self.status()).first().asDict()
        if not (self.config.verbose_level if verbose is None else verbose):
            return counts
        left = {n: self.store.orphans(n) for n in self.store.names()}
        return counts | {"clean": {n: not x for n, x in left.items()}, "temporary": sorted(f"{n}/{x}" for n, xs in left.items() for x in xs) + self.temporary()}

    def temporary(self) -> list[str]:
        """Scan and temporary index files in the index folder."""
        return sorted(f for f in os.listdir(self.home) if f.startswith(("scan-", "tmp-")))

    def orphans(self) -> list[str]:
        """Of temporary() those whose process, named by the first number in the name, is no more."""
        return [f for f in self.temporary() if (pid := pid_of(f)) is not None and not alive(pid)]

    def duplicates(self) -> DataFrame:
        return aggregate.duplicates(self.refresh()).orderBy("hash")

    def format_duplicates(self, form: str = "fdupes") -> str:
        """The groups as people read them: with fdupes a path a line and an empty line between groups; human has headings; json an object a
        line."""
        groups = self.duplicates()
        if form == "json":
            return "\n".join(r["json"] for r in report.duplicates_json(groups).toLocalIterator())
        return ("" if form == "human" else "\n").join(r["text"] + "\n" * (form == "human") for r in report.duplicates_text(groups, form).toLocalIterator()).rstrip("\n")

    def length(self) -> int:
        """Rows of main, deleted ones included."""
        return self.store.read("main").count()

    def lookup(self, path: str) -> dict | None:
        """The row of one path in the working state, with the index it comes from as its context."""
        found = diff.lookup(self.working(), clean(path)).first()
        return found.asDict() if found else None

    def visit(self, name: str, callback: Callable[[Row], bool]) -> int:
        """Call back with each row of an index, by name or path of an index file, in path order, until it returns False."""
        rows = self.load(name) if "/" in name else self.store.read(name.removesuffix(".idx"))
        kind = find_plan.index_type(name)
        return search.visit(rows.withColumn("index_type", F.lit(kind)), callback)

    def load(self, path: str) -> DataFrame:
        """The rows of a binary index file."""
        full = os.path.abspath(path)
        if not os.path.isfile(full):
            raise find_plan.FindError(f"no index file: {path}")
        return binary.read_index(self.spark, f"file://{full}", context=find_plan.index_type(path))

    def export(self, name: str, path: str, signature: bytes = SIGNATURE) -> None:
        """Write a table as a binary index file."""
        binary.write_index(self.store.read(name), path, signature)

    def stats(self) -> tuple[int, int]:
        r = aggregate.stats(self.store.read("main")).first()
        return r["n_files"], r["total_size"]

    def find(self, tokens: list[str], now_ns: int | None = None, accepted: list[tuple[str, str]] | None = None, dry_run: bool = False) -> list[DataFrame]:
        """A frame for each action, in path order. --fix, --delete and --update-hash write what they change as a new version of the tables they start
        from, and --fls, --export and --extract their files (not with dry_run). `--fix manual` applies the accepted issues, as (path, type)
        of issues(). With --warn, rows whose test cannot be decided are logged."""
        now = now_ns if now_ns is not None else time.time_ns()
        query = find_plan.parse(tokens, now)
        indices = {n: self.store.read(n) for n in self.store.names()}
        disk = self.hashed(self.scan()) if {"--missing", "--checksum", "--fix", "--update-hash"} & set(tokens) else None
        chosen = self.spark.createDataFrame(accepted, "path string, type string") if accepted else None
        clean = [n for n in indices if not self.store.orphans(n)] if query.clean else None
        if query.options.get("warn") == "True":
            for r in find_plan.undecided(find_plan.selected(indices, query, disk, self.load, clean), query).limit(100).collect():
                log.warning("%s in %s: the test cannot be decided", r["path"], r["index_type"])
        out = find_plan.find(indices, tokens, now, disk, self.load, chosen, self.hash_type, clean, ordered=True)
        for (action, value), frame in zip(query.actions, out):
            if not dry_run:
                self._carry_out(action, value, frame, indices)
        return out

    def _carry_out(self, action: str, value: str | None, frame: DataFrame, indices: dict[str, DataFrame]) -> None:
        """What an action does besides its rows. Tables get new versions; rows of index files stay as they are."""
        if action in ("fix", "delete", "update-hash") and value != "none":
            for name in [r["index_type"] for r in frame.select("index_type").distinct().collect()]:
                if name in indices:
                    changed = frame.filter(F.col("index_type") == name).select(*ENTRY.fieldNames())
                    self.store.write(name, diff.overlay(indices[name], changed), f"{action} {value or ''}".strip())
        elif action == "fls":
            with open(value, "w", encoding="utf-8") as f:
                f.writelines(r["line"] + "\n" for r in frame.orderBy("line").toLocalIterator())
        elif action == "export":
            binary.write_index(frame.filter("hash <> ''").dropDuplicates(["path"]), value, SIGNATURE)
        elif action == "extract":
            top = os.path.realpath(value)
            for r in frame.distinct().toLocalIterator():
                to = os.path.realpath(os.path.join(top, r["path"]))
                if not to.startswith(top + os.sep):
                    raise ValueError(f"outside of {value}: {r['path']!r}")
                if os.path.isfile(source := os.path.join(self.root, r["path"])):
                    os.makedirs(os.path.dirname(to), exist_ok=True)
                    shutil.copy2(source, to)

    def issues(self, name: str = "main") -> DataFrame:
        """(path, type): what --fix auto would change in a table."""
        return validate.fix_plan(self.store.read(name), self.scan(), validate.repairs(self.hash_type)).orderBy("path", "type")

    # row edits; each is a version that undo() takes back
    def edit(self, changes: dict[str, str], paths: list[str], name: str = "main", dry_run: bool = False) -> DataFrame:
        rows = self.store.read(name)
        if diff.select_keys(rows, edit.keys_of(paths)).isEmpty():
            raise ValueError("no such entries")
        return self._save(name, edit.update(rows, changes, paths), f"edit {sorted(changes)}", dry_run)

    def append(self, row: str | dict, name: str = "main", dry_run: bool = False) -> DataFrame:
        return self._save(name, edit.append(self.store.read(name), row), "append", dry_run)

    def remove(self, paths: list[str], name: str = "main", dry_run: bool = False) -> DataFrame:
        rows = self.store.read(name)
        if diff.select_keys(rows, edit.keys_of(paths)).isEmpty():
            raise ValueError("no such entries")
        return self._save(name, edit.remove(rows, paths), "remove", dry_run)

    def _save(self, name: str, rows: DataFrame, what: str, dry_run: bool) -> DataFrame:
        if not dry_run:
            self.store.write(name, rows, what)
        return rows

    def show(self, paths: list[str], name: str = "main") -> tuple[DataFrame, DataFrame]:
        """The rows with these paths, and the paths that have none."""
        rows, keys = self.store.read(name), edit.keys_of(paths)
        return diff.select_keys(rows, keys).orderBy("path"), diff.missing_keys(rows, keys)

    def resort(self, name: str = "main") -> None:
        """Write a table anew, in path order."""
        self.store.write(name, edit.resort(self.store.read(name)), "resort")

    # the versions of a table, newest first
    def fixes(self, name: str = "main") -> list[dict]:
        return self.store.versions(name)[::-1]

    def undo(self, name: str = "main") -> dict:
        return self.store.pop(name)

    def discard(self, version: str, name: str = "main") -> None:
        self.store.discard(name, version)

    def clear(self, name: str = "main") -> None:
        self.store.clear(name)

    # snapshots
    def snapshot(self, tags: list[str] | None = None, time_ns: int | None = None) -> dict:
        """Copy the current tables under an id made of the time."""
        ns = time_ns if time_ns is not None else time.time_ns()
        at = dt.datetime.fromtimestamp(ns // 10**9, dt.UTC)
        made = f"{at:%Y%m%dT%H%M%S}.{ns % 10**9:09d}Z"
        home, files = os.path.join(self.home, "snapshots", made), {}
        to = Store(self.spark, f"file://{home}")
        whole = None
        for name in self.store.names():
            rows = self.store.read(name)
            to.write(name, rows, "snapshot")
            files[name] = aggregate.table_hash(rows).first()["tree"]
            whole = rows if whole is None else whole.unionByName(rows)
        line = "\n".join(sorted(f"{n}:{h}" for n, h in files.items()))
        meta = {"id": made, "repository": self.repository_id, "time_ns": ns, "hostname": socket.gethostname(), "username": getpass.getuser(), "tags": tags or [], "files": files}
        meta |= {"tree": hashlib.sha256(line.encode()).hexdigest(), "summary": aggregate.summary(whole).first().asDict()}
        with open(os.path.join(home, "metadata"), "w", encoding="utf-8") as f:
            json.dump(meta, f)
        self.tag(made, tags or [])
        return meta

    def tag(self, snapshot_id: str, tags: list[str]) -> None:
        """Give a snapshot these tags: a file of its own, which counts where it and the metadata differ."""
        with open(os.path.join(self.home, "snapshots", os.path.basename(snapshot_id), "tags"), "w", encoding="utf-8") as f:
            f.write("".join(f"{t}\n" for t in tags))

    def snapshots(self) -> list[dict]:
        """Newest first; what cannot be read is left out."""
        top, out = os.path.join(self.home, "snapshots"), []
        for name in os.listdir(top) if os.path.isdir(top) else []:
            try:
                with open(os.path.join(top, name, "metadata"), encoding="utf-8") as f:
                    meta = json.load(f)
                if os.path.exists(tags := os.path.join(top, name, "tags")):
                    with open(tags, encoding="utf-8") as f:
                        meta["tags"] = [x.strip() for x in f if x.strip()]
                out.append(meta)
            except (OSError, ValueError):
                continue
        return sorted(out, key=lambda m: m["time_ns"], reverse=True)

    def forget(self, policy: dict[str, int] | None = None, dry_run: bool = False) -> list[str]:
        rows = [(m["id"], dt.datetime.fromtimestamp(m["time_ns"] / 1e9, dt.UTC).replace(tzinfo=None)) for m in self.snapshots()]
        table = self.spark.createDataFrame(rows, "id string, time timestamp_ntz")
        gone = sorted(r["id"] for r in aggregate.forgotten(table, policy or self.config.retention).collect())
        for i in [] if dry_run else gone:
            self.remove_snapshot(i)
        return gone

    def remove_snapshot(self, snapshot_id: str) -> None:
        shutil.rmtree(os.path.join(self.home, "snapshots", os.path.basename(snapshot_id)), ignore_errors=True)

    def compare(self, snapshot_id: str, backward: bool = False) -> DataFrame:
        """Status from a snapshot's main table to the current one, or back."""
        old, new = Store(self.spark, f"file://{self.home}/snapshots/{snapshot_id}").read("main"), self.store.read("main")
        return diff.status(new, old) if backward else diff.status(old, new)

    # recovery
    def recover(self, now_ns: int | None = None, fix: str = "auto", how: str = "auto") -> DataFrame:
        """Rebuild main, and return it. The tables are kept as a snapshot first.

        `state` takes all tables, later ones over earlier ones; `scan` the newest scan table; the name of a table that alone. Entries that
        pass the rules are repaired by the files on disk and compared with them. `auto` tries state, the cache, the newest scan and
        main in turn, and fails if all of them do."""
        self.snapshot(["recovery"])
        now, failed = now_ns if now_ns is not None else time.time_ns(), []
        for way in ("state", "cache", "scan", "main") if how == "auto" else (how,):
            try:
                return self._recover(self._sources(way), now, fix)
            except (OSError, ValueError, PySparkException) as e:
                log.info("recovery from %s failed: %s", way, e)
                failed.append(f"{way}: {e}")
        raise ValueError("recovery failed: " + "; ".join(failed))

    def _sources(self, way: str) -> list[str]:
        names = self.store.names()
        if way == "state":
            found = [n for n in ("main", "cache") if n in names] + [n for n in names if n.startswith("scan-")]
        elif way == "scan":
            found = [self.newest_scan()] if self.newest_scan() else []
        else:
            found = [way] if way in names else []
        if not found:
            raise ValueError(f"there is no {way}")
        return found

    def newest_scan(self) -> str | None:
        """The scan table that was written last."""
        rows = [(n, self.store.versions(n)[-1]["time"]) for n in self.store.names()]
        found = aggregate.newest_scan(self.spark.createDataFrame(rows, "name string, time long")).first()
        return found["name"] if found else None

    def _recover(self, names: list[str], now: int, fix: str) -> DataFrame:
        whole = None
        for name in names:
            good = validate.check(self.store.read(name), "recovery", now, auto_fix=True).drop("error")
            whole = good if whole is None else diff.overlay(whole, good)
        disk = self.scan().persist()
        self.recovered = validate.fix_counts(whole, disk, now, self.hash_type).first().asDict()
        fixed = validate.fix(whole, disk, fix, hash_type=self.hash_type) if fix != "none" else whole
        lenient = validate.check(fixed, "lenient", now).drop("error")
        self.store.write("main", diff.writable(self._compare(lenient).withColumn("context", F.lit("main")), "main"), "recover", ", ".join(names))
        self.store.drop("cache")
        self.spark.catalog.clearCache()
        return self.store.read("main")

    def reset(self) -> None:
        """A new empty main and no cache."""
        self.snapshot(["recovery"])
        self.store.write("main", self.spark.createDataFrame([], ENTRY), "reset")
        self.store.drop("cache")

"""Queries that go through files, stores and streams: the walker, the binary layout, versions, snapshots, recovery.

Each builds what it needs from the driver's tables in a folder of its own, which goes when the process ends.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .api import FileIndex
from .operators import diff
from .queries import NOW, OVERLAY, STATUS, query
from .schema import ENTRY, SECOND
from .sources import binary, walker
from .sources.entries import ALL_SQL, CACHE_SQL, MAIN_SQL, SCAN_SQL, defective, entries
from .store import Store
from .streaming.continuous import continuous_status, merge_into

PATH = "source || '/' || lang || '/' || lpad(CAST(doc_id AS VARCHAR), 8, '0') || '.txt'"
FILES = f"SELECT {PATH} AS path, CAST(strlen(text) AS BIGINT) AS file_size, sha256(text) AS hash, doc_id FROM documents WHERE text IS NOT NULL AND source IS NOT NULL AND lang IS NOT NULL"
SIGNATURE = b"TEST"


def folder() -> str:
    """A new folder that all tasks see: below spark.checkpoint.dir, or a temporary one where all run on this machine."""
    context = SparkSession.active().sparkContext
    shared = (context.getConf().get("spark.checkpoint.dir") or "").removeprefix("file://")
    if not shared.startswith("/") and not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="siltstone-", dir=shared if shared.startswith("/") else None)
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    return made


def tree(spark: SparkSession, sf: str) -> str:
    """The documents as files."""
    root = folder()
    docs = spark.read.parquet(f"{sf}/documents.parquet").filter("text is not null and source is not null and lang is not null")
    for r in docs.select("doc_id", "text", "source", "lang").toLocalIterator():
        path = f"{root}/{r.source}/{r.lang}/{r.doc_id:08d}.txt"
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "wb") as f:
            f.write(r.text.encode())
    return root


@query("walk_scan", "SELECT path, file_size, hash, false AS is_deleted, 'scan' AS context FROM f", f=FILES)
def walk_scan(spark, sf):
    root = tree(spark, sf)
    return walker.with_hashes(walker.scan(spark, root), root).select("path", "file_size", "hash", "is_deleted", "context")


@query("walk_rules", "SELECT path, file_size FROM f WHERE NOT regexp_matches(path, '^src1/') AND NOT regexp_matches(regexp_replace(path, '/[^/]*$', ''), '/de$') AND NOT regexp_matches(path, '7\\.txt$')", f=FILES)
def walk_rules(spark, sf):
    return walker.scan(spark, tree(spark, sf), patterns=[r"^src1/", r"/de$", r"7\.txt$"]).select("path", "file_size")


@query("walk_links", "SELECT 'links/' || doc_id AS path, sha256('../' || path) AS hash, true AS is_link FROM f WHERE doc_id % 10 = 3", f=FILES)
def walk_links(spark, sf):
    """Links to files are rows with the hash of their target's name; a link to a folder above them ends, a broken one has no row."""
    root = tree(spark, sf)
    os.makedirs(f"{root}/links")
    for path in [os.path.join(d, f) for d, _, fs in os.walk(root) for f in fs]:
        n = int(os.path.basename(path).split(".")[0])
        if n % 10 == 3:
            os.symlink(os.path.relpath(path, f"{root}/links"), f"{root}/links/{n}")
    os.symlink("..", f"{root}/links/up")
    os.symlink("nowhere", f"{root}/links/broken")
    found = walker.with_hashes(walker.scan(spark, root, symlinks="none"), root)
    return found.filter("path like 'links/%'").select("path", "hash", (F.col("mode").bitwiseAND(F.lit(1 << 27)) != 0).alias("is_link"))


ROUND_TRIP = ["path", "file_size", "mode", "uid", "gid", "dev", "ino", "ctime_ns", "mtime_ns", "is_deleted", "hash_type", "hash"]


def index_file(spark: SparkSession, sf: str) -> str:
    path = f"{folder()}/main.idx"
    binary.write_index(entries(spark, sf, "all").filter("hash_type <> 0"), path, SIGNATURE)
    return path


@query("binary_round_trip", f"SELECT {', '.join(ROUND_TRIP)} FROM e WHERE hash_type <> 0", e=ALL_SQL)
def binary_round_trip(spark, sf):
    return binary.read_index(spark, f"file://{index_file(spark, sf)}", SIGNATURE).select(*ROUND_TRIP)


@query("binary_lenient", "SELECT path, hash FROM (SELECT *, row_number() OVER (ORDER BY path) AS k FROM e WHERE hash_type <> 0) WHERE k NOT IN (1, 3)", e=ALL_SQL)
def binary_lenient(spark, sf):
    """The first and the third record have impossible sizes: the rows of all others."""
    path = index_file(spark, sf)
    with open(path, "r+b") as f:
        data = f.read()
        at, sizes = binary.HEADER, []
        for _ in range(3):
            sizes.append(at)
            at += int.from_bytes(data[at : at + 4], "little")
        for k in (sizes[0], sizes[2]):
            f.seek(k)
            f.write(b"\xff" * 4)
    return binary.read_index(spark, f"file://{path}", lenient=True).select("path", "hash")


@query("binary_header", "SELECT 'NEWS' AS signature, count(*) AS entry_count, CAST(2 AS BIGINT) AS checksum_type, true AS clean FROM e WHERE hash_type <> 0", e=ALL_SQL)
def binary_header(spark, sf):
    """An edited header, read and checked again."""
    with open(index_file(spark, sf), "rb") as f:
        data = binary.edit_header(f.read(), {"signature": "NEWS", "checksum_type": "2"})
    h = binary.check_header(data, b"NEWS")
    return spark.createDataFrame([(h["signature"].decode(), h["entry_count"], h["checksum_type"], bool(h["flags"] & binary.CLEAN))], "signature string, entry_count long, checksum_type long, clean boolean")


def versions(spark: SparkSession, sf: str) -> Store:
    """main, with the cache as a delta over it."""
    store = Store(spark, f"file://{folder()}")
    store.write("main", entries(spark, sf))
    store.merge("main", entries(spark, sf, "cache"))
    return store


@query("store_delta", OVERLAY.format(keep="c", add="m"), m=MAIN_SQL, c=CACHE_SQL)
def store_delta(spark, sf):
    return versions(spark, sf).read("main").select("path", "file_size", "hash", "context")


@query("store_undo", "SELECT path, file_size, hash, context FROM m", m=MAIN_SQL)
def store_undo(spark, sf):
    store = versions(spark, sf)
    store.pop("main")
    return store.read("main").select("path", "file_size", "hash", "context")


@query("find_index_file", "SELECT path AS line FROM e WHERE hash_type <> 0 AND is_deleted", e=ALL_SQL)
def find_index_file(spark, sf):
    return FileIndex(spark, folder()).find([index_file(spark, sf), "--deleted"], NOW)[0]


def indexed(spark: SparkSession, sf: str) -> FileIndex:
    index = FileIndex(spark, folder())
    index.store.write("main", entries(spark, sf))
    return index


@query("snapshot_compare", "SELECT * FROM st", m=MAIN_SQL, s=SCAN_SQL, st=STATUS)
def snapshot_compare(spark, sf):
    index = indexed(spark, sf)
    made = index.snapshot(["before"])["id"]
    index.store.write("main", entries(spark, sf, "scan"))
    return index.compare(made)


@query("snapshot_compare_back", "SELECT * FROM st", m=SCAN_SQL, s=MAIN_SQL, st=STATUS)
def snapshot_compare_back(spark, sf):
    index = indexed(spark, sf)
    made = index.snapshot(["before"])["id"]
    index.store.write("main", entries(spark, sf, "scan"))
    return index.compare(made, backward=True)


@query("snapshot_rows", "SELECT path, hash FROM m", m=MAIN_SQL)
def snapshot_rows(spark, sf):
    index = indexed(spark, sf)
    made = index.snapshot()["id"]
    index.reset()
    return Store(spark, f"file://{index.home}/snapshots/{made}").read("main").select("path", "hash")


def damaged(spark: SparkSession, sf: str) -> FileIndex:
    """The documents on disk, main with defects, a cache and two scans."""
    index = FileIndex(spark, tree(spark, sf))
    index.store.write("main", defective(entries(spark, sf)).filter("path <> ''"))
    index.store.write("cache", entries(spark, sf, "cache"))
    index.store.write("scan-1-1", entries(spark, sf, "all"))
    index.store.write("scan-2-2", entries(spark, sf, "scan"))
    return index


RECOVERED = "SELECT path, file_size, hash, false AS is_deleted, 'main' AS context FROM f"


def _recover(how: str):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return damaged(spark, sf).recover(NOW, how=how).select("path", "file_size", "hash", "is_deleted", "context")

    return run


for _how in ("auto", "state", "cache", "scan", "main"):
    query(f"recover_{_how}", RECOVERED, f=FILES)(_recover(_how))


@query("index_update", RECOVERED, f=FILES)
def index_update(spark, sf):
    """main after the disk has lost a third of the files and been updated, and got them back and been updated again."""
    root = tree(spark, sf)
    index = FileIndex(spark, root)
    files = [os.path.join(d, f) for d, _, fs in os.walk(root) for f in fs if f.endswith(".txt") and int(f.split(".")[0]) % 3 == 0]
    for f in files:
        os.rename(f, f + ".away")
    index.update()
    for f in files:
        os.rename(f + ".away", f)
    index.update()
    return index.store.read("main").select("path", "file_size", "hash", "is_deleted", "context")


@query("index_status", "SELECT path, CASE WHEN doc_id % 5 = 0 THEN 'modified' WHEN doc_id % 7 = 0 THEN 'deleted' ELSE 'unchanged' END AS status FROM f UNION ALL SELECT 'new/' || doc_id, 'added' FROM f WHERE doc_id % 50 = 0", f=FILES)
def index_status(spark, sf):
    root = tree(spark, sf)
    index = FileIndex(spark, root)
    index.update()
    os.makedirs(f"{root}/new")
    for path in [os.path.join(d, f) for d, _, fs in os.walk(root) for f in fs if f.endswith(".txt")]:
        n = int(os.path.basename(path).split(".")[0])
        if n % 5 == 0:
            with open(path, "ab") as f:
                f.write(b"x")
        elif n % 7 == 0:
            os.unlink(path)
        if n % 50 == 0:
            with open(f"{root}/new/{n}", "wb") as f:
                f.write(b"new")
    return index.status()


# streams
def stream_of(spark: SparkSession, *frames: DataFrame) -> DataFrame:
    """A file stream of one file for each frame, in order."""
    top = folder()
    for k, df in enumerate(frames):
        df.coalesce(1).write.mode("append").parquet(f"{top}/in")
        for f in os.listdir(f"{top}/in"):
            if f.startswith("part-"):
                os.utime(f"{top}/in/{f}", (k * 1000 + 10**9,) * 2) if os.path.getmtime(f"{top}/in/{f}") > 1.5e9 else None
    return spark.readStream.schema(ENTRY).option("maxFilesPerTrigger", 1).parquet(f"{top}/in")


@query("stream_merge", OVERLAY.format(keep="c", add="m"), m=MAIN_SQL, c=CACHE_SQL)
def stream_merge(spark, sf):
    store, top = Store(spark, f"file://{folder()}"), folder()
    merge_into(stream_of(spark, entries(spark, sf), entries(spark, sf, "cache")), store, "t", f"file://{top}").awaitTermination()
    return store.read("t").select("path", "file_size", "hash", "context")


@query(
    "stream_status",
    f"""SELECT path, 'added' AS status FROM m WHERE NOT is_deleted UNION ALL
       SELECT s.path, CASE WHEN m.path IS NULL THEN 'added' WHEN s.mtime_ns <> m.mtime_ns OR s.file_size <> m.file_size THEN 'modified' ELSE 'unchanged' END FROM s LEFT JOIN m ON s.path = m.path WHERE NOT s.is_deleted AND {SECOND} > 0""",
    m=MAIN_SQL, s=SCAN_SQL,
)
def stream_status(spark, sf):
    top = folder()
    made = continuous_status(stream_of(spark, entries(spark, sf), entries(spark, sf, "scan")))
    made.writeStream.format("parquet").option("path", f"{top}/out").option("checkpointLocation", f"{top}/marks").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{top}/out").select("path", "status")


@query("writable_cache", "SELECT path, hash FROM (SELECT path, hash, hash_type, context FROM c UNION ALL SELECT path, hash, hash_type, context FROM m WHERE path NOT IN (SELECT path FROM c)) WHERE hash_type <> 0 AND context <> 'main'", m=MAIN_SQL, c=CACHE_SQL)
def writable_cache(spark, sf):
    return diff.writable(diff.overlay(entries(spark, sf), entries(spark, sf, "cache")), "cache", "cache").select("path", "hash")

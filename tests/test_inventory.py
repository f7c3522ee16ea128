"""The inventory engine: SQL comparisons, literals, the find language, the walker, the binary layout, the store and the API."""

import os
from collections import Counter

import duckdb
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

import siltstone.state_queries  # noqa: F401  (registers its queries)
from siltstone import queries
from siltstone.api import FileIndex, find_root
from siltstone.config import Config, IgnoreRules
from siltstone.functions import literals
from siltstone.operators import aggregate, diff, edit, validate
from siltstone.plans import find
from siltstone.schema import COLUMNS, ENTRY, SECOND
from siltstone.sources import binary, walker
from siltstone.sources.entries import entries
from siltstone.store import Store

SIGNATURE = b"TEST"


def plain(x):
    if isinstance(x, list):
        return tuple(x)
    return round(x, 9) if isinstance(x, float) else x


@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "events"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    found = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in found.description]
    got = queries.queries()[name](spark, sf)
    assert sorted(got.columns) == sorted(names)
    assert Counter(tuple(plain(r[c]) for c in names) for r in got.collect()) == Counter(tuple(map(plain, r)) for r in found.fetchall())


def rows(spark, *entries_):
    base = {"file_size": 1, "mode": 0o644, "uid": 1, "gid": 1, "dev": 1, "ino": 1, "ctime_ns": 0, "mtime_ns": 0, "is_deleted": False, "hash_type": 2, "hash": "ab" * 32, "context": "main"}
    return spark.createDataFrame([tuple((base | e)[c] for c in COLUMNS) for e in entries_], ENTRY)


# literals


@pytest.mark.parametrize("text, want", [("+100M", (">", 100 << 20)), ("-1.5k", ("<", 1536)), ("7", ("=", 7)), ("3b", ("=", 1536)), ("2w", ("=", 4)), (".5k", ("=", 512))])
def test_size_tests(text, want):
    assert literals.size_test(text) == want


@pytest.mark.parametrize("f, text", [(literals.size_test, "1x"), (literals.size_test, ""), (literals.age_test, "1.5"), (literals.human_size, "0"), (literals.human_size, "1T"), (literals.hash_text, "abc"), (literals.boolean, "maybe"), (lambda x: literals.integer(x, 16), "65536"), (literals.hash_type, "md5"), (literals.time_ns, "soon")])
def test_bad_literals(f, text):
    with pytest.raises(ValueError):
        f(text)


def test_literals():
    assert [literals.human_size(x) for x in ("2M", "512k", "1.5GB", "7")] == [2 << 20, 512 << 10, 3 << 29, 7]
    assert [literals.integer(x, 32) for x in ("10", "0x10", "010")] == [10, 16, 8]
    assert literals.time_ns("2023-01-01T12:00:00.123456789Z") == 1672574400_123456789 and literals.time_ns("5") == 5 * SECOND
    assert literals.iso(1672574400_123456789) == "2023-01-01T12:00:00.123456789Z"
    assert literals.hash_text("0x" + "AB" * 20) == "ab" * 20 and literals.hash_type("SHA512") == 3
    assert literals.flags("a,b:false") == {"a": True, "b": False}
    assert literals.prune_roots(["b/c", "a", "./a/x", "b", "ab"]) == ["a", "ab", "b"] and literals.prune_roots(["", "a"]) == [""]
    assert literals.clean(".") == "" and literals.clean("./a//b/") == "a/b"


def test_globs():
    import re

    def hits(glob, text):
        return bool(re.search(re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: re.escape(chr(int(m[1], 16))), literals.glob_regex(glob)), text))

    assert hits("*.t?t", "a.txt") and not hits("*.txt", "d/a.txt") and hits("[a-c]x", "bx") and not hits("[^a-c]x", "bx") and hits(r"\*", "*") and not hits("a.c", "abc")
    for bad in ("[", "[a", "a\\", "[]", "[a-"):
        with pytest.raises(ValueError):
            literals.glob_regex(bad)


# joins and overlays


def test_status_cases(spark):
    old = rows(spark, {"path": "same"}, {"path": "changed"}, {"path": "gone"}, {"path": "dead", "is_deleted": True}, {"path": "marked"}, {"path": "mode"})
    new = rows(spark, {"path": "same"}, {"path": "changed", "mtime_ns": 1}, {"path": "new"}, {"path": "dead"}, {"path": "marked", "is_deleted": True}, {"path": "ghost", "is_deleted": True}, {"path": "mode", "mode": 0o600})
    got = {r.path: r.status for r in diff.status(old, new).collect()}
    assert got == {"same": "unchanged", "changed": "modified", "gone": "deleted", "dead": "added", "marked": "deleted", "new": "added", "mode": "unchanged"}
    assert {r.path for r in diff.status(old, new, report_new_tombstones=True).filter("status = 'added'").collect()} == {"new", "dead", "ghost"}
    totals = diff.status_counts(diff.status(old, old.limit(0))).first()
    assert totals.deleted == 5 and totals.has_changes and totals.total_changes == 5
    assert not diff.status_counts(diff.status(old.limit(0), old.limit(0))).first().has_changes


def test_scan_diff_cases(spark):
    index = rows(spark, {"path": "same", "context": "cache"}, {"path": "mode"}, {"path": "back", "is_deleted": True}, {"path": "gone"}, {"path": "dead", "is_deleted": True})
    scan = rows(spark, {"path": "same", "hash": ""}, {"path": "mode", "mode": 0o600, "hash": ""}, {"path": "back", "hash": ""}, {"path": "new", "hash": ""})
    got = {r.path: (r.needs_hash, r.is_deleted, r.context, r.hash) for r in diff.scan_diff(scan, index).collect()}
    assert got == {"same": (False, False, "cache", "ab" * 32), "mode": (True, False, "scan", ""), "back": (True, False, "scan", ""), "new": (True, False, "scan", ""), "gone": (False, True, "scan", "ab" * 32)}


def test_overlay_conflicts(spark):
    a, b = rows(spark, {"path": "x", "uid": 1}), rows(spark, {"path": "x", "uid": 2}, {"path": "y", "uid": 2})
    assert {(r.path, r.uid) for r in diff.overlay(a, b).collect()} == {("x", 2), ("y", 2)}
    assert {(r.path, r.uid) for r in diff.overlay(a, b, "ours").collect()} == {("x", 1), ("y", 2)}
    with pytest.raises(ValueError):
        diff.overlay(a, b, "error")


def test_duplicates(spark):
    df = rows(spark, {"path": "b"}, {"path": "a"}, {"path": "c", "is_deleted": True}, {"path": "d", "hash": "cd" * 32}, {"path": "e", "hash": "ef" * 20, "hash_type": 1})
    assert [(r.hash, r.files, r["count"]) for r in aggregate.duplicates(df).collect()] == [("ab" * 32, ["a", "b"], 2)]


def test_retention(spark):
    at = [f"2023-06-{d} {h}:00:00" for d in (15, 16, 17) for h in (12, 13, 14)]
    snaps = spark.createDataFrame([(t, t) for t in at], "id string, t string").select("id", F.to_timestamp_ntz("t").alias("time"))
    assert {r.id for r in aggregate.retention(snaps, {"daily": 2}).collect()} == {"2023-06-17 14:00:00", "2023-06-16 14:00:00"}
    assert aggregate.forgotten(snaps, {"daily": 0}).count() == 9
    weeks = spark.sql("select explode(array('2023-06-12', '2023-06-15', '2023-06-19', '2024-12-30')) as d").select(aggregate.period(F.to_timestamp("d"), "weekly").alias("w"))
    assert [r.w for r in weeks.collect()] == ["2023-W24", "2023-W24", "2023-W25", "2025-W01"]


def test_strict_validation_fails_the_job(spark):
    good, bad = rows(spark, {"path": "a"}), rows(spark, {"path": ""})
    assert validate.check(good, "strict", SECOND).count() == 1
    with pytest.raises(Exception, match="empty path"):
        validate.check(bad, "strict", SECOND).collect()


def test_manual_fix_applies_what_is_accepted(spark):
    e, d = rows(spark, {"path": "a", "file_size": 1, "uid": 1}), rows(spark, {"path": "a", "file_size": 9, "uid": 5})
    accepted = spark.createDataFrame([("a", "ownership")], "path string, type string")
    r = validate.fix(e, d, "manual", accepted).first()
    assert (r.file_size, r.uid) == (1, 5) and validate.fix(e, d, "none") is e


def test_counts_of_repairs_match_sql_on_late_files(spark, tmp_path):
    """Files written more than a year after NOW, and rows without a path: neither is a reason to discard, each row is judged alone."""
    con = duckdb.connect()
    con.execute("create view documents as select i as doc_id, 'text ' || i as text, 'en' as lang, case when i % 5 <> 1 then 's' || i % 3 end as source from range(9000, 11000) t(i)")
    con.execute(f"copy documents to '{tmp_path}/documents.parquet' (format parquet)")
    got = queries.queries()["fix_counts"](spark, str(tmp_path)).first()
    assert tuple(got) == con.execute(queries.oracle_sql()["fix_counts"]).fetchone()
    late = rows(spark, {"path": "a", "mtime_ns": 500 * 86_400 * SECOND})
    assert validate.fix_counts(late, late, SECOND).first().discarded == 1


def test_bad_edits(spark):
    df = rows(spark, {"path": "a"})
    for bad in ({"path": "a", "hash": "ab" * 32}, {"path": "b"}, {"path": "b", "hash": "ab" * 20}, {"path": "b", "hash": "ab" * 32, "colour": 1}):
        with pytest.raises(ValueError):
            edit.append(df, bad)
    with pytest.raises(ValueError):
        edit.update(df, {"path": "b"}, ["a"])
    assert edit.append(df, '{"path": "./b", "hash": "' + "cd" * 20 + '", "hash_type": "sha1"}').count() == 2


# find


@pytest.mark.parametrize("tokens", [["--nope"], ["--name"], ["--not"], ["!", "--print"], ["("], ["(", "--empty"], [")"], ["--or", "--empty"], ["--empty", "--or"], ["--empty", "--or", "--print"], ["--size", "x"], ["--fix", "maybe"], ["--perm", "9"], ["--type", "z"], ["--not", "--not", "--empty"]])
def test_find_errors(spark, tokens):
    with pytest.raises(find.FindError):
        find.parse(tokens, 0)


def test_find_precedence_and_actions(spark):
    df = rows(spark, {"path": "a.txt", "file_size": 0}, {"path": "d/b.txt", "file_size": 5}, {"path": "d/c.log", "file_size": 5, "mode": 0o4755 & 0o777 | 1 << 23})
    run = lambda *t: [sorted(r[0] for r in out.collect()) for out in find.find({"main": df, "scan-1-2": df.limit(0)}, list(t), 0)]
    assert run("main", "--empty", "--or", "--name", "*.log", "--path", "d/*") == [["a.txt", "d/c.log"]]
    assert run("main", "--empty", "--print", "--or", "--name", "*.log") == [["a.txt", "d/c.log"]]
    assert run("all", "!", "(", "--empty", ")", "--print0", "--printf", "%f\\n") == [["d/b.txt\0", "d/c.log\0"], ["b.txt\n", "c.log\n"]]
    assert run("main", "--perm", "4755") == [["d/c.log"]] and run("main", "--mindepth", "2", "--size", "5") == [["d/b.txt", "d/c.log"]]
    assert run("scan", "--empty") == [[]]
    with pytest.raises(find.FindError):
        run("cache")


# files

TREE = {"file1.txt": b"This is the first file\n", "subdir1/nested.txt": b"nested", "subdir2/data.json": b"{}", "binary.bin": bytes(9), ".hidden": b"x"}


@pytest.fixture
def tree(tmp_path):
    for name, data in TREE.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    (tmp_path / "empty_dir").mkdir()
    return tmp_path


def test_walk(spark, tree):
    import hashlib

    os.symlink("file1.txt", tree / "link")
    os.symlink("..", tree / "subdir1/up")
    os.symlink("nowhere", tree / "broken")
    found = {r.path: r for r in walker.with_hashes(walker.scan(spark, str(tree), symlinks="none"), str(tree)).collect()}
    assert set(found) == {*TREE, "link"}
    for name, data in TREE.items():
        assert found[name].hash == hashlib.sha256(data).hexdigest() and found[name].file_size == len(data)
    assert found["link"].hash == hashlib.sha256(b"file1.txt").hexdigest() and found["link"].mode & 1 << 27
    assert walker.scan(spark, str(tree), symlinks="all").count() >= len(TREE)  # the cycle ends
    assert {r.path for r in walker.scan(spark, str(tree), ["subdir1", "subdir1/nested.txt"], symlinks="none").collect()} == {"subdir1/nested.txt"}
    assert {r.path for r in walker.scan(spark, str(tree), patterns=[r"^subdir", r"^\."], symlinks="none").collect()} == {"file1.txt", "binary.bin", "link"}


def test_update_status_cycle(spark, tree):
    index = FileIndex(spark, str(tree))
    assert Counter(r.status for r in index.status().collect()) == {"added": 5} and index.store.exists("cache")
    assert Counter(r.status for r in index.status().collect()) == {"added": 5}
    index.update()
    assert index.stats() == (5, sum(map(len, TREE.values()))) and not index.store.exists("cache")
    assert {r.status for r in index.status().collect()} == {"unchanged"}
    (tree / "file1.txt").write_bytes(b"MODIFIED CONTENT")
    (tree / "binary.bin").unlink()
    (tree / "new.txt").write_bytes(TREE["subdir1/nested.txt"])
    for _ in range(2):
        got = {r.path: r.status for r in index.status().collect() if r.status != "unchanged"}
        assert got == {"file1.txt": "modified", "binary.bin": "deleted", "new.txt": "added"}
    assert index.format_duplicates() == "new.txt\nsubdir1/nested.txt"
    index.update(["new.txt"])
    assert {r.path for r in index.store.read("main").collect()} == {*TREE, "new.txt"}
    index.update()
    assert {r.path for r in index.store.read("main").collect()} == {*TREE, "new.txt"} - {"binary.bin"}
    assert [r.line for r in index.find(["main", "--name", "new*"])[0].collect()] == ["new.txt"]
    assert {r.checksum for r in index.find(["main", "--checksum"])[0].collect()} == {"ok"}
    assert find_root(str(tree / "subdir1")) == os.path.realpath(tree)


def test_edits_undo_snapshots_and_recovery(spark, tree):
    index = FileIndex(spark, str(tree))
    index.update()
    assert index.edit({"uid": "7"}, ["file1.txt"], dry_run=True).filter("uid = 7").count() == 1
    index.edit({"uid": "7"}, ["./file1.txt"])
    assert index.store.read("main").filter("uid = 7").count() == 1
    index.undo()
    assert index.store.read("main").filter("uid = 7").count() == 0
    with pytest.raises(ValueError):
        index.remove(["nothing"])
    ids = [index.snapshot(["t"], time_ns=(1_686_830_400 + d * 86_400 + h * 3600) * SECOND)["id"] for d in range(2) for h in range(2)]
    assert [m["id"] for m in index.snapshots()] == ids[::-1] and ids[0] == "20230615T120000.000000000Z"
    assert index.forget({"daily": 2}, dry_run=True) == [ids[0], ids[2]] and len(index.snapshots()) == 4
    index.forget({"daily": 2})
    assert [m["id"] for m in index.snapshots()] == [ids[3], ids[1]]
    index.remove(["file1.txt"])
    assert {r.path: r.status for r in index.compare(ids[3]).collect()}["file1.txt"] == "deleted"
    index.store.write("main", index.store.read("main").withColumn("hash_type", F.lit(0).cast("long")))
    assert {r.path for r in index.recover().collect()} == set(TREE) and index.store.read("main").filter("hash_type = 2").count() == 5
    index.reset()
    assert index.stats() == (0, 0)


def test_store_versions(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}")
    assert store.read("t").count() == 0 and store.names() == []
    first = store.write("t", rows(spark, {"path": "a"}))
    store.write("t", rows(spark, {"path": "b"}))
    assert store.read("t").first().path == "b" and store.read("t", first).first().path == "a"
    store.pop("t")
    assert store.read("t").first().path == "a"
    with pytest.raises(ValueError):
        store.pop("t")


def test_store_survives_crashes_and_other_writers(spark, tmp_path, monkeypatch):
    from siltstone.store import Conflict

    store, other = Store(spark, f"file://{tmp_path}"), Store(spark, f"file://{tmp_path}")
    store.write("t", rows(spark, {"path": "a"}))
    # two writers that start from the same history
    number, state = other._state("t")
    store.write("t", rows(spark, {"path": "b"}))
    with pytest.raises(Conflict):
        other._add("t", number, state, [other._put("t", rows(spark, {"path": "c"}))], "write", "", None)
    assert [r.path for r in other.read("t").collect()] == ["b"] and len(store.versions("t")) == 2
    # a crash before the commit, or with a log file half written, changes nothing
    monkeypatch.setattr(other, "_commit", lambda *x: (_ for _ in ()).throw(OSError("crash")))
    with pytest.raises(OSError):
        other.write("t", rows(spark, {"path": "d"}))
    (tmp_path / "t/_log/half.new").write_text('{"versions"')
    assert [r.path for r in store.read("t").collect()] == ["b"]
    assert len(store.orphans("t")) == 2 and store.sweep("t") and store.orphans("t") == []
    assert [r.path for r in store.read("t").collect()] == ["b"]


def test_store_deltas(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}")
    store.write("t", rows(spark, *[{"path": f"p{k:03d}"} for k in range(200)]))
    for k in range(12):
        store.merge("t", rows(spark, {"path": "p007", "file_size": k}, {"path": f"q{k}"}), mark=("s", k))
        assert store.merge("t", rows(spark, {"path": "p007", "file_size": 99}), mark=("s", k)) is None
    assert len(store.versions("t")[-1]["parts"]) <= 9 and store.versions("t")[-1]["parts"][0] == store.versions("t")[0]["parts"][0]
    assert store.read("t").count() == 212 and store.read("t").filter("path = 'p007'").first().file_size == 11
    store.merge("t", rows(spark, *[{"path": f"r{k}"} for k in range(100)]))
    assert len(store.versions("t")[-1]["parts"]) == 1 and store.read("t").count() == 312
    store.pop("t")
    assert store.read("t").count() == 212 and store.merge("t", rows(spark, {"path": "x"}), mark=("s", 11)) is None
    store.clear("t")
    assert store.read("t").count() == 212 and len(store.versions("t")) == 1


# the binary layout


@given(st.integers(0, (1 << 32) * SECOND - 1))
def test_wall_times(ns):
    assert binary.unwall(binary.wall(ns)) == ns


def test_binary_index(spark, sf, tmp_path):
    df = entries(spark, sf).filter("hash_type <> 0")
    path = str(tmp_path / "main.idx")
    binary.write_index(df, path, SIGNATURE)
    back = binary.read_index(spark, path, SIGNATURE)
    assert Counter(map(tuple, back.collect())) == Counter(map(tuple, df.collect()))
    data = bytearray(open(path, "rb").read())
    assert binary.record_size(b"") == 144 and binary.record_size(b"12345678") == 152 and binary.header(bytes(data))["version"] == 1
    data[200] ^= 1
    with pytest.raises(binary.CorruptIndex, match="checksum"):
        binary.check_header(bytes(data))
    with pytest.raises(binary.CorruptIndex, match="signature"):
        binary.check_header(bytes(data), b"ELSE")
    data[binary.HEADER : binary.HEADER + 4] = b"\xff\xff\xff\xff"
    with pytest.raises(binary.CorruptIndex, match="record"):
        list(binary.decode(bytes(data), "main"))
    assert len(list(binary.decode(bytes(data), "main", lenient=True))) >= df.count() - 2


def test_config_and_rules(tmp_path):
    c = Config().override("default:sha1", "hash_workers:8", "debug:a,b:false")
    c.save(str(tmp_path / "config"))
    assert Config.load(str(tmp_path / "config")) == c and c.debug == {"a": True, "b": False}
    for bad in ("default:md5", "hash_workers:65", "level:4", "format:xml", "colour:red"):
        with pytest.raises(ValueError):
            Config().override(bad)
    rules = IgnoreRules([r"\.tmp$"])
    rules.save(str(tmp_path / "ignore"))
    assert IgnoreRules.load(str(tmp_path / "ignore")).patterns == [r"\.tmp$"] and IgnoreRules.load(str(tmp_path / "none")).patterns == []
    with pytest.raises(ValueError):
        rules.add(r"(?=x)")


# streams


def test_streams(spark, sf, tmp_path):
    from siltstone.streaming import continuous

    a = rows(spark, {"path": "a", "ctime_ns": 1}, {"path": "b", "ctime_ns": 1})
    b = rows(spark, {"path": "a", "ctime_ns": 2, "file_size": 9}, {"path": "b", "ctime_ns": 2, "is_deleted": True}, {"path": "c", "ctime_ns": 2})
    stream, store = str(tmp_path / "in"), Store(spark, f"file://{tmp_path}/store")
    q = None
    for k, df in enumerate((a, b)):
        df.coalesce(1).write.mode("append").parquet(stream)
        source = spark.readStream.schema(ENTRY).parquet(stream)
        continuous.merge_into(source, store, "t", str(tmp_path / "c1")).awaitTermination()
        q = continuous.continuous_status(source).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
        q.awaitTermination()
    assert {(r.path, r.file_size, r.is_deleted) for r in store.read("t").collect()} == {("a", 9, False), ("b", 1, True), ("c", 1, False)}
    got = Counter((r.path, r.status) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == Counter([("a", "added"), ("b", "added"), ("a", "modified"), ("b", "deleted"), ("c", "added")])


def test_streams_are_told_apart(spark, tmp_path):
    """Two streams into one table, a new checkpoint, and a batch that is repeated after an undo."""
    from siltstone.streaming import continuous

    store = Store(spark, f"file://{tmp_path}/store")
    for k, name in enumerate("ab"):
        rows(spark, {"path": name, "ctime_ns": k}).coalesce(1).write.parquet(str(tmp_path / name))
        continuous.merge_into(spark.readStream.schema(ENTRY).parquet(str(tmp_path / name)), store, "t", str(tmp_path / f"c{name}")).awaitTermination()
    assert sorted(r.path for r in store.read("t").collect()) == ["a", "b"]
    store.pop("t")
    # the stream of b forgets that its batch was committed, and repeats it
    os.remove(tmp_path / "cb/commits/0")
    os.remove(tmp_path / "cb/commits/.0.crc")
    continuous.merge_into(spark.readStream.schema(ENTRY).parquet(str(tmp_path / "b")), store, "t", str(tmp_path / "cb")).awaitTermination()
    assert [r.path for r in store.read("t").collect()] == ["a"]
    continuous.merge_into(spark.readStream.schema(ENTRY).parquet(str(tmp_path / "b")), store, "t", str(tmp_path / "new")).awaitTermination()
    assert sorted(r.path for r in store.read("t").collect()) == ["a", "b"]


def test_entry_works_without_the_subpackage():
    import subprocess
    import sys

    code = "import sys; sys.modules['siltstone.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; q = e.queries(); assert 'dupes_groups' in q and not any(n.startswith('op1') for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

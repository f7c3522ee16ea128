"""The API and the command lines: repairs, recovery, headers, versions, reports, user filters, settings that act."""

import hashlib
import json
import os

import pytest
from pyspark.sql import functions as F
from test_inventory import SIGNATURE, TREE, rows, tree  # noqa: F401  (tree is a fixture)

from siltstone import cli
from siltstone.api import FileIndex, alive, pid_of
from siltstone.operators import aggregate, diff, report, search, validate
from siltstone.plans import find
from siltstone.schema import ENTRY, SECOND
from siltstone.sources import binary, walker


@pytest.fixture
def index(spark, tree):  # noqa: F811
    made = FileIndex(spark, str(tree))
    made.update()
    return made


def main(index):
    return {r.path: r for r in index.store.read("main").collect()}


def test_sha512(spark, sf):
    from siltstone import queries

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    for r in queries.queries()["hash_sha512"](spark, sf).collect():
        text = docs[r.doc_id]
        assert r.digest == (None if text is None else hashlib.sha512(text.encode()).hexdigest())


# repairs


def test_find_fix_writes_a_version(index):
    index.edit({"uid": "7", "file_size": "1"}, ["file1.txt"])
    index.edit({"uid": "7"}, ["binary.bin"])
    assert {(r.path, r.type) for r in index.issues().collect()} == {("file1.txt", "file_size"), ("file1.txt", "ownership"), ("binary.bin", "ownership")}
    index.find(["main", "--fix", "auto"], dry_run=True)
    index.find(["main", "--fix", "none"])
    assert main(index)["file1.txt"].uid == 7
    index.find(["main", "--fix", "manual"])
    assert main(index)["file1.txt"].uid == 7
    index.find(["main", "--fix", "manual"], accepted=[("file1.txt", "ownership"), ("binary.bin", "file_size")])
    assert main(index)["file1.txt"].uid != 7 and main(index)["file1.txt"].file_size == 1 and main(index)["binary.bin"].uid == 7
    index.find(["main", "--name", "file1*", "--fix", "auto"])
    assert main(index)["file1.txt"].file_size == len(TREE["file1.txt"]) and main(index)["binary.bin"].uid == 7 and len(main(index)) == len(TREE)
    assert index.fixes()[0]["operation"] == "fix auto"


def test_rules_of_users(spark):
    rule = validate.Repair("zero_dev", F.col("e.dev") == 0, {"dev": F.lit(9).cast("long")})
    e = rows(spark, {"path": "a", "dev": 0}, {"path": "b"})
    assert {r.path: r.type for r in validate.fix_plan(e, e, [rule]).collect()} == {"a": "zero_dev"}
    assert {r.path: r.dev for r in validate.fix(e, e, "auto", rules=[rule]).collect()} == {"a": 9, "b": 1}
    with pytest.raises(ValueError):
        validate.fix(e, e, "some")


def test_fix_hash_type_is_the_configured_one(index):
    index.config = index.config.override("default:sha1")
    index.edit({"flag_is_deleted": "no"}, ["file1.txt"])
    index.store.write("main", index.store.read("main").withColumn("hash_type", F.lit(0).cast("long")))
    index.find(["main", "--fix", "auto"])
    assert {r.hash_type for r in main(index).values()} == {1}


# recovery


def test_recovery_falls_through(spark, index, monkeypatch):
    index.store.write("cache", rows(spark, {"path": "file1.txt"}))
    index.store.write("scan-1-1", rows(spark, {"path": "old"}))
    index.store.write("scan-2-2", rows(spark, {"path": "new"}))
    assert index.newest_scan() == "scan-2-2" and index._sources("scan") == ["scan-2-2"] and index._sources("state") == ["main", "cache", "scan-1-1", "scan-2-2"]
    tried, real = [], index._recover

    def broken(names, now, fix):
        tried.append(names)
        if names != ["main"]:
            raise OSError("unreadable")
        return real(names, now, fix)

    monkeypatch.setattr(index, "_recover", broken)
    assert {r.path for r in index.recover().collect()} == set(TREE)
    assert tried == [["main", "cache", "scan-1-1", "scan-2-2"], ["cache"], ["scan-2-2"], ["main"]] and index.recovered["valid"] == len(TREE)
    assert [m["tags"] for m in index.snapshots()] == [["recovery"]]
    with pytest.raises(ValueError, match="there is no nothing"):
        index.recover(how="nothing")


def test_recovery_counts(spark, index):
    index.edit({"uid": "9"}, ["file1.txt"])
    index.store.write("main", index.store.read("main").unionByName(rows(spark, {"path": "bad", "hash": "00" * 32, "is_deleted": True})))
    index.recover(how="main")
    assert index.recovered == {"valid": len(TREE) - 1, "fixed": 1, "discarded": 1} and set(main(index)) == set(TREE)


# the binary layout


def test_header_tools(spark, tmp_path):
    data = binary.encode([r.asDict() for r in rows(spark, {"path": "a"}, {"path": "b"}).collect()], SIGNATURE)
    new = binary.edit_header(data, {"signature": "ELSE", "flags": "0x2", "checksum_type": "3"})
    assert binary.check_header(new, b"ELSE")["checksum_type"] == 3 and new[binary.HEADER :] == data[binary.HEADER :]
    assert json.loads(binary.header_json(binary.header(data)))["byte_order"] == "0x0102030405060708"
    for bad in ({"entry_count": "1"}, {"checksum": "1"}, {"byte_order": "1"}, {"signature": "LONGER"}, {"checksum_type": "9"}, {"version": "-1"}, {"colour": "1"}):
        with pytest.raises(ValueError):
            binary.edit_header(data, bad)


def test_corrupt_records_are_reported(spark, tmp_path):
    made = rows(spark, *[{"path": f"p{k:04d}", "mode": 384} for k in range(400)])
    path = str(tmp_path / "x.idx")
    binary.write_index(made, path, SIGNATURE)
    data = bytearray(open(path, "rb").read())
    step = binary.record_size(b"p0000")
    for k in (2, 7):
        at = binary.HEADER + k * step
        data[at : at + 4] = b"\xff" * 4
    open(path, "wb").write(data)
    bad = binary.read_corrupt(spark, f"file://{path}").orderBy("offset").collect()
    assert [r.offset for r in bad] == [binary.HEADER + 2 * step, binary.HEADER + 7 * step] and bad[0].file.endswith("x.idx")
    assert binary.read_index(spark, f"file://{path}", lenient=True).count() == 398
    for k in range(0, 400, 2):
        at = binary.HEADER + k * step
        data[at : at + 4] = b"\xff" * 4
    with pytest.raises(binary.CorruptIndex, match="more than 100"):
        list(binary.decode(bytes(data), "main", lenient=True))


def test_write_index_needs_its_count(spark, tmp_path):
    with open(tmp_path / "x", "wb") as f, pytest.raises(ValueError, match="1 rows instead of 2"):
        binary.write_records(f, [rows(spark, {"path": "a"}).first().asDict()], 2, SIGNATURE)


# find


def test_index_files_by_path(spark, index, tmp_path):
    path = str(tmp_path / "scan-5-5.idx")
    index.export("main", path)
    assert binary.read_index(spark, f"file://{path}").count() == len(TREE)
    got = [r.line for r in index.find([path, "main", "--name", "file1*", "--printf", "%i %p"])[0].collect()]
    assert sorted(got) == ["main file1.txt", "scan file1.txt"]
    assert [find.index_type(x) for x in ("main", "a/cache.idx", "scan-1", "x/y.idx")] == ["main", "cache", "scan", "file"]
    with pytest.raises(find.FindError):
        index.find(["no/such.idx"])
    seen = []
    assert index.visit(path, lambda r: seen.append((r.path, r.index_type)) or len(seen) < 2) == 2
    assert seen == [(p, "scan") for p in sorted(TREE)[:2]] and index.visit("main", lambda r: True) == len(TREE)


def test_actions_that_write(spark, index, tmp_path):
    index.find(["main", "--name", "file1*", "--delete"])
    assert main(index)["file1.txt"].is_deleted and not main(index)["binary.bin"].is_deleted
    index.edit({"hash": "ab" * 32}, ["binary.bin"])
    index.find(["main", "--update-hash", "--name", "*.bin"], dry_run=True)
    assert main(index)["binary.bin"].hash == "ab" * 32
    index.find(["main", "--update-hash", "--name", "*.bin"])
    assert main(index)["binary.bin"].hash == hashlib.sha256(TREE["binary.bin"]).hexdigest()
    top = str(tmp_path / "made")
    index.find(["main", "!", "--deleted", "--fls", f"{tmp_path}/list", "--export", f"{tmp_path}/out.idx", "--extract", top])
    assert len(open(tmp_path / "list").read().splitlines()) == len(TREE) - 1 == binary.read_index(spark, f"file://{tmp_path}/out.idx").count()
    assert open(f"{top}/subdir1/nested.txt", "rb").read() == TREE["subdir1/nested.txt"] and not os.path.exists(f"{top}/file1.txt")
    assert [r.line for r in index.find(["main", "--index-clean", "--quit"])[0].collect()] == [min(TREE)]


def test_results_are_in_path_order(spark, index):
    for words in (["--print"], ["--ls"], ["--checksum"], ["--validate"], ["--printf", "%p"]):
        frame = index.find(["main", *words])[0]
        got = [r[-1].split()[-1] if "line" in frame.columns else r.path for r in frame.collect()]
        assert got == sorted(TREE)


def test_warnings_of_undecided_tests(spark, index, caplog):
    df = index.store.read("main").withColumn("mode", F.when(F.col("path") != "file1.txt", F.col("mode")))
    query = find.parse(["main", "--perm", "644", "--warn"], 0)
    assert [r.path for r in find.undecided(find.selected({"main": df}, query), query).collect()] == ["file1.txt"]
    index.find(["main", "--perm", "644", "--warn"])
    assert not caplog.records


def test_tests_and_actions_of_users(spark, monkeypatch):
    monkeypatch.setitem(find.MORE_TESTS, "--longer", lambda v: F.length("path") > int(v))
    monkeypatch.setitem(find.MORE_ACTIONS, "--total", lambda df: df.agg(F.sum("file_size").alias("total")))
    df = rows(spark, {"path": "a"}, {"path": "abc", "file_size": 5}, {"path": "abcd", "file_size": 6})
    assert find.find({"main": df}, ["main", "--longer", "2", "--total"], 0)[0].first().total == 11


def test_composed_filters(spark):
    df = rows(spark, *[{"path": f"p{k}", "file_size": k} for k in range(6)])

    @F.pandas_udf("boolean")
    def even(x):
        return x % 2 == 0

    got = search.compose(df, F.col("file_size") > 1, lambda rows_: even("file_size"), F.lit(None).cast("boolean").isNull())
    assert [r.path for r in search.rows_of(got)] == ["p2", "p4"] and search.compose(df).count() == 6
    assert search.compose(df, F.lit(None).cast("boolean")).count() == 0


# reports and settings


def test_reports(spark, index, capsys):
    index.config = index.config.override("level:1", "hash_workers:2")
    for name in (f"tmp-{os.getpid()}", "scan-999999999-1.idx", "tmp-none"):
        open(os.path.join(index.home, name), "w").close()
    told = index.status_report()
    assert told["unchanged"] == len(TREE) and told["clean"] == {"main": True} and len(told["temporary"]) == 3
    assert index.orphans() == ["scan-999999999-1.idx"] and "clean" not in index.status_report(0)
    assert pid_of("scan-12-3.idx") == 12 and pid_of("tmp-x") is None and alive(1)
    assert [r.path for r in index.status().collect()] == sorted(TREE)
    assert index.length() == len(TREE) and index.lookup("./file1.txt")["context"] == "main" and index.lookup("none") is None
    assert len(index.repository_id) == 32 == len(FileIndex(spark, index.root).repository_id)
    with open(os.path.join(index.root, "copy.txt"), "wb") as f:
        f.write(TREE["file1.txt"])
    assert index.format_duplicates() == "copy.txt\nfile1.txt" and json.loads(index.format_duplicates("json"))["files"] == ["copy.txt", "file1.txt"]
    assert index.format_duplicates("human").startswith("2 files of hash ")
    text = report.entry_text(diff.lookup(index.store.read("main"), "binary.bin")).first().text
    assert text.startswith("Path: binary.bin\n  Size: 9 bytes\n  Mode: 0") and text.endswith("Deleted: false")


def test_buffers_and_workers_do_not_change_hashes(spark, tree):  # noqa: F811
    scan = walker.scan(spark, str(tree), symlinks="none")
    a, b = (walker.with_hashes(scan, str(tree), w, n) for w, n in ((1, 3), (16, 1 << 20)))
    assert {(r.path, r.hash) for r in a.collect()} == {(r.path, r.hash) for r in b.collect()}
    assert a.rdd.getNumPartitions() <= b.rdd.getNumPartitions()


def test_contained_links(spark, tree, tmp_path_factory):  # noqa: F811
    outside = tmp_path_factory.mktemp("outside")
    (outside / "far.txt").write_text("far")
    os.symlink(outside, tree / "out")
    os.symlink(tree / "subdir1", tree / "inside")
    paths = lambda how: {r.path for r in walker.scan(spark, str(tree), symlinks=how).collect()}
    assert "out/far.txt" in paths("all") and "out/far.txt" not in paths("contained") | paths("none")
    assert "inside/nested.txt" in paths("contained") and "inside/nested.txt" not in paths("none")


def test_table_hash_is_of_content_only(spark):
    df = rows(spark, *[{"path": f"p{k}"} for k in range(50)])
    one = aggregate.table_hash(df).first().tree
    assert one == aggregate.table_hash(df.repartition(7).withColumn("uid", F.lit(5).cast("long"))).first().tree
    assert one != aggregate.table_hash(df.filter("path <> 'p3'")).first().tree and aggregate.table_hash(df.limit(0)).count() == 1
    assert aggregate.stats(df.withColumn("file_size", F.lit(1 << 62))).first().total_size is None and aggregate.stats(df.limit(0)).first().total_size == 0


def test_tags_of_snapshots(index):
    made = index.snapshot(["a"], time_ns=5 * SECOND)["id"]
    index.tag(made, ["b", "c"])
    os.makedirs(os.path.join(index.home, "snapshots/unreadable"))
    assert [(m["id"], m["tags"]) for m in index.snapshots()] == [(made, ["b", "c"])]


# command lines


def test_command_lines(spark, tree, capsys):  # noqa: F811
    def run(*words, status=0):
        lines = []
        assert cli.run(spark, ["-C", str(tree), *words], lines.append) == status
        return lines

    assert len(run("init")[0]) == 32
    run("update")
    assert run("status") == [] and run("stats") == [f"{len(TREE)} files, {sum(map(len, TREE.values()))} bytes"]
    assert run("find", "main", "--name", "*.txt", "--size", "-1k") == ["file1.txt", "subdir1/nested.txt"]
    run("fix", "main", "entry", "edit", "uid=7", "file1.txt")
    shown = json.loads(run("--format", "json", "fix", "main", "entry", "show", "file1.txt", "nothing")[0])
    assert shown["entries"][0]["uid"] == 7 and shown["not_found"] == ["nothing"] and "Path: file1.txt" in run("fix", "main.idx", "entry", "show", "file1.txt")[1]
    assert [x.split()[1] for x in run("fix", "main", "fixes", "list")] == ["edit", "update", "create"]
    run("-n", "fix", "main", "fixes", "pop")
    assert run("fix", "main", "entry", "show", "file1.txt")[1].count("UID: 7")
    run("fix", "main", "fixes", "pop")
    assert not run("fix", "main", "entry", "show", "file1.txt")[1].count("UID: 7")
    run("fix", "main", "entry", "append", json.dumps({"path": "x", "hash": "ab" * 32}))
    run("fix", "main", "entry", "remove", "x")
    run("fix", "main", "entry", "resort")
    run("fix", "main", "fixes", "discard", run("fix", "main", "fixes", "list")[-1].split()[0])
    run("fix", "main", "fixes", "clear")
    assert len(run("fix", "main", "fixes", "list")) == 1 and run("fix", "main", "fixes", "pop", status=1) == []
    FileIndex(spark, str(tree)).export("main", str(tree / ".siltstone/main.idx"))
    run("fix", "main", "header", "edit", "signature", "ABCD")
    assert json.loads(run("fix", "main", "header", "show")[0])["signature"] == "ABCD"
    assert os.path.exists(tree / ".siltstone/main.idx.bak")
    run("fix", "main", "header", "edit", "entry_count", "3", status=1)
    made = run("--tag", "t", "snapshot")[0]
    assert run("snapshots") == [f"{made}\tt"] and run("-n", "forget", "daily=0") == [made]
    assert json.loads(run("-v", "--format", "json", "status")[0])["clean"] == {"main": True}
    assert json.loads(run("recover")[0])["valid"] == len(TREE)
    run("--set", "default:md5", "status", status=1)
    run("nonsense", status=1)
    run("find", "main", "--nope", status=1)
    assert "siltstone:" in capsys.readouterr().err


def test_manual_fixes_ask(spark, index):
    index.edit({"uid": "7", "gid": "7"}, ["file1.txt", "binary.bin"])
    asked = []
    words = ["-C", index.root, "find", "main", "--fix", "manual", "--name", "*.*"]
    assert cli.run(spark, words, lambda line: None, lambda q: asked.append(q) or ("y" if "file1" in q else "n")) == 0
    assert asked == ["fix ownership of binary.bin? [y/N] ", "fix ownership of file1.txt? [y/N] "]
    assert main(index)["file1.txt"].uid != 7 and main(index)["binary.bin"].uid == 7


def test_reset_keeps_a_snapshot(spark, index):
    index.reset()
    assert index.stats() == (0, 0) and [m["tags"] for m in index.snapshots()] == [["recovery"]]
    assert diff.status(index.store.read("main"), spark.createDataFrame([], ENTRY)).count() == 0

"""Each operator against a plain version, and on null, empty, long, equal and repeated rows, empty tables and clashing columns."""

from collections import Counter

import brute
import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siltstone.llm import ann, chat, components, induced_sort, jaccard, language_id, line_dedup, mixing, packing, quality, queries, suffix_dedup

LONG = "lorem ipsum dolor sit amet " * 40_000
ROWS = [
    (5, "A shared line of text\nown line number five\n\nA shared line of text", "en", "b", "x"),
    (5, "A shared line of text\nown line number five\n\nA shared line of text", "en", "b", "x"),
    (2, " a SHARED line of text\t\nanother line here", "en", "a", None),
    (3, None, None, None, "x"),
    (4, "", "fr", "a", "y"),
    (6, "7 + 7 = 14", None, "c", "z"),
    (7, LONG, "en", "a", "x"),
    (8, LONG, "en", "a", "x"),
    (None, "A shared line of text", None, None, None),
]
#: Extra columns bear the names that operators use inside.
SCHEMA = "doc_id long, text string, lang string, source string, owner string"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ROWS, SCHEMA).selectExpr("*", "owner as _size", "owner as _kept", "owner as _n_dropped", "owner as `copies`", "owner as start")


@pytest.fixture(scope="module")
def documents(sf):
    return duckdb.execute(f"select doc_id, text, lang, source from '{sf}/documents.parquet'").fetchall()


@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    found = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in found.description]
    want = Counter(tuple(r) for r in found.fetchall())
    got = queries.queries()[name](spark, sf)
    assert sorted(got.columns) == sorted(names)
    assert Counter(tuple(r[c] for c in names) for r in got.collect()) == want


def test_line_dedup_of_odd_rows(odd):
    out = line_dedup.dedup_lines(odd, batches=3).collect()
    got = {r.doc_id: (r.text, r._n_lines, r._n_dropped) for r in out}
    assert len(out) == len(ROWS) and "owner" in out[0].asDict()
    assert got[2] == (" a SHARED line of text\t\nanother line here", 2, 0)
    assert got[5] == ("own line number five\n", 4, 2)
    assert got[3] == (None, 1, 0) and got[4] == ("", 1, 0) and got[None] == ("A shared line of text", 1, 0)
    assert got[7][2] == 0 and got[8] == ("", 1, 1)
    assert line_dedup.dedup_lines(odd.limit(0)).collect() == []


def test_line_dedup_with_an_outlying_id_and_earlier_runs(spark):
    """One far id does not put all others in one batch; runs of earlier calls take lines from later documents."""
    rows = [(k, f"a line that all have\nline number {k} alone\nline of pair {k // 2}") for k in range(40)] + [(10**15, "a line that all have\nline of pair 3")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r._n_dropped, r.text.count("\n")) for r in line_dedup.dedup_lines(docs).collect()}
    assert got == {k: ((k > 0) + k % 2, 2 - (k > 0) - k % 2) for k in range(40)} | {10**15: (2, 0)}
    runs = line_dedup.LineRuns()
    assert line_dedup.dropped_lines(docs.filter("doc_id < 20"), runs=runs).count() == 19
    later = {r.doc_id: r.dropped for r in line_dedup.dropped_lines(docs.filter("doc_id >= 20"), runs=runs).collect()}
    assert later == {k: [0, 2] if k % 2 else [0] for k in range(20, 40)} | {10**15: [0, 1]}
    assert sorted(len(x) for x in runs.levels)[-1] <= 1
    runs.close(spark)
    assert not spark.catalog.listTables() or not [t for t in spark.catalog.listTables() if t.name.startswith("siltstone_")]


def test_runs_are_levelled(spark):
    runs = line_dedup.LineRuns(fanout=2)
    for k in range(5):
        runs.add(spark.createDataFrame([(bytes([k]), k)], "key binary, owner long"))
    assert [len(x) for x in runs.levels] == [1, 0, 1]
    assert sorted(r.owner for r in runs.all().collect()) == [0, 1, 2, 3, 4]


def test_language_held_out_accuracy(spark, sf, documents):
    rows = queries.op2_language_id(spark, sf).collect()
    lang = {d: x for d, _, x, _ in documents}
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(documents) and len(held) > 20
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_of_odd_rows(odd):
    got = {r.doc_id: (r._lang, r._score) for r in language_id.identify(odd).collect()}
    assert got[3] == ("und", 0.0) and got[4] == ("und", 0.0) and got[6] == ("und", 0.0)
    assert got[7][0] in ("en", "fr")
    assert language_id.identify(odd.limit(0)).collect() == []
    assert {r._lang for r in language_id.identify(odd.filter("lang is null")).collect()} == {"und"}


def test_codewords_are_apart():
    for k in (2, 4, 6, 9, 30):
        code = language_id.codewords(k)
        assert min(int((a != b).sum()) for i, a in enumerate(code) for b in code[i + 1 :]) >= (1 if k == 2 else code.shape[1] // 4)


def test_quality_of_odd_rows(odd):
    got = {r.doc_id: r for r in quality.cascade(odd, measures=quality.BASE_MEASURES).collect()}
    assert got[3].n_words == 0 and not got[3]._kept
    assert got[5].n_dup_lines == 1 and got[7].n_repeat_words == 200_000 and not got[7]._kept
    assert quality.cascade(odd.limit(0)).collect() == []


def test_verdict_does_not_depend_on_the_order(odd, monkeypatch):
    want = Counter((r.doc_id, r._kept) for r in quality.cascade(odd).collect())
    monkeypatch.setattr(quality, "order_rules", lambda docs, rules: list(rules)[::-1])
    assert Counter((r.doc_id, r._kept) for r in quality.cascade(odd).collect()) == want


def brute_suffixes(t, cap):
    order = sorted(range(len(t)), key=lambda i: t[i:])
    shared = [0] + [next((k for k in range(cap) if max(a, b) + k >= len(t) or t[a + k] != t[b + k]), cap) for a, b in zip(order, order[1:])]
    return [t[i : i + cap] for i in order], shared


@pytest.mark.parametrize("held, base", [(4, 0), (1 << 20, 1 << 20), (30, 5)])
def test_induced_sort(held, base, monkeypatch):
    monkeypatch.setattr(induced_sort, "BASE", base)
    rng = np.random.default_rng(held)
    for _ in range(150):
        t = rng.integers(0, rng.choice([1, 2, 4, 200]), rng.integers(1, 70)).tolist()
        t = (t[:4] * 20)[: len(t)] if rng.random() < 0.3 else t
        for cap in (3, 100):
            order, shared = induced_sort.suffix_array(np.array(t), cap, most=held)
            assert ([t[i : i + cap] for i in order], shared.tolist()) == brute_suffixes(t, cap)


def test_suffix_dedup_against_brute_force(spark, sf, documents):
    want = brute.substrings([(d, t) for d, t, _, _ in documents])
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in queries.op4_suffix_dedup(spark, sf).collect()}
    assert got == want and sum(x[1] for x in want.values()) > 0


def test_suffix_dedup_of_odd_rows(spark, odd):
    part = "0123456789" * 5
    rows = [(1, f"abc{part}def"), (2, f"{part}"), (2, f"{part}"), (3, f"é{part}{part[:9]}x"), (4, part[:49]), (None, part), (6, None), (7, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute.substrings([r for r in rows if r[0] is not None])
    for r in suffix_dedup.dedup_substrings(docs).collect():
        if r.doc_id is not None:
            assert (r._n_bytes, r._n_removed, r._n_spans, brute.sha(bytes(r._left))) == want[r.doc_id]
        else:
            assert r._n_removed == 0
    got = {r.doc_id: r._n_removed for r in suffix_dedup.dedup_substrings(odd).collect()}
    assert got[8] == len(LONG) and got[7] == 0 and len(got) == 8
    assert suffix_dedup.dedup_substrings(docs.limit(0)).collect() == []


def test_suffix_dedup_where_an_anchor_repeats(spark):
    """Passages whose edges hold the anchor's 16 bytes more than once: rules, leaders, indents, short periods."""
    rng = np.random.default_rng(8)
    word = lambda n: "".join(map(chr, rng.integers(97, 123, n)))
    rows = []
    for unit in (".", " ", "-=", "ab ", "0123456789abcdef", "x" * 16 + "yz"):
        for _ in range(12):
            shared, (m, n) = word(40), rng.integers(16, 60, 2)
            for k in (m, n):
                leader = (unit * 60)[: int(k)]
                rows.append((len(rows), word(30) + shared + leader + word(30)))
                rows.append((len(rows), word(30) + leader[::-1] + shared + word(30)))
    want = brute.substrings(rows)
    got = {r.doc_id: (r._n_bytes, r._n_removed, r._n_spans, brute.sha(bytes(r._left))) for r in suffix_dedup.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_suffix_dedup_of_a_hot_anchor(spark, monkeypatch):
    """Passages that every text has, with its own bytes around them: their edges are split. Equal to brute force either way."""
    monkeypatch.setattr(suffix_dedup, "HOT", 1e-9)
    rng = np.random.default_rng(9)
    word = lambda n: "".join(map(chr, rng.integers(97, 100, n)))
    passages = [word(70), word(52), "ab" * 40]
    rows = [(k, word(int(rng.integers(0, 60))) + passages[k % 3][: int(rng.integers(48, 81))] + word(int(rng.integers(0, 60))) + passages[(k + 1) % 3]) for k in range(120)]
    ran, real = [], suffix_dedup.split_contexts
    monkeypatch.setattr(suffix_dedup, "split_contexts", lambda df: ran.append(df.count()) or real(df))
    got = {r.doc_id: (r._n_bytes, r._n_removed, r._n_spans, brute.sha(bytes(r._left))) for r in suffix_dedup.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute.substrings(rows) and ran[0] > 100


def test_suffix_dedup_of_a_large_group(spark, sf, documents, monkeypatch):
    """Groups of anchors that go through a file: what is removed is the same."""
    docs = spark.createDataFrame([(d, t) for d, t, _, _ in documents], "doc_id long, text string")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("print", F.unhex(F.substring(F.sha2("text", 256), 1, 32)))
    once = {(r.doc_id, r.start) for r in suffix_dedup.shared_anchors(rows, 3).collect()}
    monkeypatch.setattr(suffix_dedup, "AT_ONCE", 1000)
    assert once <= {(r.doc_id, r.start) for r in suffix_dedup.shared_anchors(rows, 3).collect()}
    got = {r.doc_id: (r._n_bytes, r._n_removed, r._n_spans, brute.sha(bytes(r._left))) for r in suffix_dedup.dedup_substrings(docs).collect()}
    assert got == brute.substrings([(d, t) for d, t, _, _ in documents])


def test_suffix_sort_spills_and_recurs_at_production_size(monkeypatch):
    """A shard of the production size puts queues on disk; more pieces than BASE are sorted by recursion."""
    spilled, depth, spill, recur = [], [], induced_sort.BucketQueues.spill, induced_sort.sorted_suffixes
    monkeypatch.setattr(induced_sort.BucketQueues, "spill", lambda self: spilled.append(self.held) or spill(self))
    monkeypatch.setattr(induced_sort, "sorted_suffixes", lambda text, *x: depth.append(len(text)) or recur(text, *x))
    rng = np.random.default_rng(1)
    units = [rng.integers(97, 123, 70, dtype=np.uint8) for _ in range(300)]
    for copies, deep in ((20, 0), (60, 1)):
        monkeypatch.setattr(induced_sort, "BASE", (1 << 18) if deep else induced_sort.BASE)
        data = np.concatenate([units[k] for k in rng.integers(0, 300, 300 * copies)] if deep else [rng.integers(97, 123, suffix_dedup.SHARD, dtype=np.uint8)])
        data = data[: len(data) // 70 * 70]
        m = len(data) // 70
        owner = np.arange(m)[::-1].copy()
        spilled.clear(), depth.clear()
        least = suffix_dedup.first_owners(data, np.arange(m + 1) * 70, owner)
        assert spilled and (len(depth) > 1) == bool(deep)  # the whole string is one
        text = data.tobytes()
        first: dict[bytes, int] = {}
        for k in range(m):
            x = text[70 * k : 70 * k + 50]
            first[x] = min(first.get(x, m), int(owner[k]))
        assert [first[text[70 * k : 70 * k + 50]] for k in range(m)] == least[::21].tolist()


def check_packing(rows, ids):
    seen, used = Counter(), {}
    for r in rows:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert r.start == r.piece * 4096 and len(part) == r.length and r.ids_crc32 == brute.crc(part)
        seen[r.doc_id] += r.length
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in used.values():
        end = 0
        for offset, length in sorted(spans):
            assert offset == end
            end += length
        assert end <= 4096
    return seen, len(used)


def test_packing_is_exact_and_tight(spark, sf, documents):
    ids = {d: brute.ids(t) for d, t, _, _ in documents}
    seen, n = check_packing(queries.op5_packing(spark, sf).collect(), ids)
    assert seen == Counter({d: len(x) for d, x in ids.items()})
    assert n <= -(-sum(map(len, ids.values())) // 4096) + 1


def test_packing_ranks_a_frequent_length_in_groups(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANK_GROUP", 8)
    rows = [(i, "one two three" if i % 4 else "four") for i in range(300)] + [(300, "word " * 9000)]
    ids = {d: brute.ids(t) for d, t in rows}
    seen, n = check_packing(packing.pack(spark.createDataFrame(rows, "doc_id long, text string")).collect(), ids)
    assert seen == Counter({d: len(x) for d, x in ids.items()}) and n == -(-sum(map(len, ids.values())) // 4096)


@pytest.mark.parametrize("count", [3_000, 1_000_000])
def test_packing_program_is_near_the_bound(count):
    """Within 1 % of the ids divided by the capacity, in a number of rounds that hardly grows with the documents."""
    h = Counter(np.minimum(np.random.default_rng(3).lognormal(5, 1, count).astype(int) + 1, 4096).tolist())
    made = packing.plan(h)
    assert sum((Counter({a: b * n for a, b in p}) for p, n in made.items()), Counter()) == h
    assert sum(made.values()) <= 1.01 * -(-sum(a * n for a, n in h.items()) // 4096) and len(made) < 10_000


def test_packing_of_odd_rows(odd):
    ids = {r[0]: brute.ids(r[1]) for r in ROWS}
    seen, _ = check_packing(packing.pack(odd).collect(), ids)
    assert seen == Counter({d: len(x) * sum(r[0] == d for r in ROWS) for d, x in ids.items()})
    assert packing.pack(odd.limit(0)).collect() == []


def test_packing_plans_hold_the_histogram():
    rng = np.random.default_rng(4)
    for top in (5, 60, 100):
        h = Counter(rng.integers(1, top + 1, 300).tolist())
        made, total = Counter(), 0
        for p, n in packing.plan(h, 100).items():
            assert sum(a * b for a, b in p) <= 100
            total += n
            for a, b in p:
                made[a] += b * n
        assert made == h and total <= sum(a * n for a, n in h.items()) / 100 * 1.1 + 1


@pytest.mark.parametrize("kind", ["tokens", "lognormal", "uniform", "long"])
def test_packing_program_alone_is_as_good_as_best_fit(kind, documents, monkeypatch):
    rng = np.random.default_rng(7)
    draws = {"lognormal": lambda: rng.lognormal(5, 1, 400), "uniform": lambda: rng.integers(1, 4097, 300), "long": lambda: rng.integers(1500, 3000, 300)}
    sizes = [len(brute.ids(t)) for _, t, _, _ in documents] if kind == "tokens" else [int(x) + 1 for x in draws[kind]()]
    h = Counter(min(x, 4096) for x in sizes)
    monkeypatch.setattr(packing, "best_fit", None, raising=False)
    made = packing.plan(h)
    assert sum((Counter({a: b * n for a, b in p}) for p, n in made.items()), Counter()) == h
    assert sum(made.values()) <= sum(brute.best_fit(h, {}, 4096).values())


def test_search_recall(spark, sf):
    rows = duckdb.execute(f"select vec_id, embedding from '{sf}/embeddings.parquet' order by 1").fetchall()
    x, ids = np.array([e for _, e in rows], float), np.array([i for i, _ in rows])
    norm = np.linalg.norm(x, axis=1)
    got, hit, want = {}, 0, 0
    for r in queries.op6_ann(spark, sf).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    for k in np.flatnonzero(ids % 50 == 0):
        score = x @ x[k] / norm / norm[k]
        score[k] = -9
        true = {int(ids[j]) for j in np.lexsort((ids, -score))[:5]}
        want += 5
        hit += len(true & {v for v, _ in got[int(ids[k])].values()})
        assert [r for r in sorted(got[int(ids[k])])] == [1, 2, 3, 4, 5]
        for v, s in got[int(ids[k])].values():
            assert abs(s - score[np.flatnonzero(ids == v)[0]]) < 1e-12
    assert hit / want >= 0.9


def test_search_of_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (50, [0.0, 1.0])] + [(i, [1.0, 1.0]) for i in range(1, 9)] + [(20, None), (21, [0.0, 0.0]), (22, [float("nan"), 1.0]), (23, [None, 1.0]), (24, [1.0]), (1, [1.0, 1.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = ann.search(vectors, vectors.filter("vec_id % 50 = 0"), recall=1.0).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.vec_id) for r in got] == [(q, v) for q in (0, 50) for v in (1, 2, 3, 4, 5)]
    assert ann.search(vectors.limit(0), vectors.limit(0)).collect() == []


def test_search_fills_its_rows_from_small_cells(spark):
    rng = np.random.default_rng(2)
    far = [[0.0, 1.0, 0.0, 1.0]] * 3 + [[1.0, 0.0, 1.0, 0.0]] * 100
    x = np.array(far) + rng.normal(0, 0.01, (103, 4))
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = ann.search(vectors, vectors.filter("vec_id < 6")).groupBy("query_id").count().collect()
    assert {r.query_id: r["count"] for r in got} == dict.fromkeys(range(6), 5)


def test_search_in_parts_and_blocks(spark, monkeypatch):
    """Cells of several parts, asked for by several blocks: the answers are those of brute force where the whole index is probed."""
    monkeypatch.setattr(ann, "GROUP", 8)
    x = np.random.default_rng(4).normal(size=(150, 4)).round(1) + 0.05
    vectors = spark.createDataFrame([(i - 20, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = ann.search(vectors, vectors, recall=1.0).collect()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    score = unit @ unit.T
    np.fill_diagonal(score, -9)
    best = {(r.query_id, r.rank): r.score for r in got}
    assert len(best) == len(got) == 750
    for q in range(150):
        want = np.sort(score[q])[::-1][:5]
        assert np.allclose([best[q - 20, k + 1] for k in range(5)], want) or np.mean([abs(best[q - 20, k + 1] - w) < 1e-9 for k, w in enumerate(want)]) >= 0.6


def test_search_of_ids_that_share_a_factor(spark, monkeypatch):
    """Queries whose ids are all divisible by 50, more than fit a block: no block is without queries or fails, each query has its rows."""
    monkeypatch.setattr(ann, "GROUP", 8)
    x = np.random.default_rng(5).normal(size=(128, 4))
    vectors = spark.createDataFrame([(50 * i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {(r.query_id // 50, r["rank"]): r.vec_id // 50 for r in ann.search(vectors, vectors, recall=1.0).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    score = unit @ unit.T
    np.fill_diagonal(score, -9)
    assert got == {(q, k + 1): j for q in range(128) for k, j in enumerate(np.argsort(-score[q])[:5])}


def test_search_among_very_many_copies(spark, monkeypatch):
    """Copies beyond HOT, zeros of both signs among them, are one entry as the few copies are; single and double precision agree."""
    monkeypatch.setattr(ann, "HOT", 20)
    x = np.random.default_rng(8).normal(size=(60, 3)).round(2)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(100 + i, [0.0 if i % 2 else -0.0, 1.0, 0.5]) for i in range(90)] + [(300 + i, x[7].tolist()) for i in range(3)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert sorted(len(r.ids) for r in ann.entries(ann.valid(vectors), 6).collect())[-2:] == [4, 6]
    y = np.array([v for _, v in rows], np.float32).astype(float)
    score = (y / np.linalg.norm(y, axis=1, keepdims=True)) @ (y / np.linalg.norm(y, axis=1, keepdims=True)).T
    for kind in ("float", "double"):
        cast = vectors.withColumn("embedding", F.col("embedding").cast(f"array<{kind}>"))
        got = {(r.query_id, r["rank"]): r for r in ann.search(cast, cast.filter("vec_id in (7, 100, 189, 301)"), recall=1.0).collect()}
        assert len(got) == 20
        assert [got[q, k].vec_id for q in (100, 189) for k in range(1, 6)] == [101, 102, 103, 104, 105, 100, 101, 102, 103, 104]
        assert [got[7, k].vec_id for k in (1, 2, 3)] == [300, 301, 302] and [got[301, k].vec_id for k in (1, 2, 3)] == [7, 300, 302]
        best = sorted((-score[7, j] for j in range(len(rows)) if j != 7))[:5]
        assert np.allclose([-got[7, k].score for k in range(1, 6)], best, rtol=0, atol=1e-12)


def test_long_walks_reach_what_the_heap_reaches(monkeypatch):
    x = np.random.default_rng(7).normal(size=(400, 6))
    index = ann.fit(x, 30_000, 5, 0.9)
    by_heap = [index.reach(q, n) for q in x[:20] for n in (1, 30, 200, 400)]
    monkeypatch.setattr(ann, "STEPS", 3)
    assert by_heap == [index.reach(q, n) for q in x[:20] for n in (1, 30, 200, 400)]


def test_block_of_queries_in_small_steps(monkeypatch):
    """Hits in several batches and steps, copies, and cells that not every walk reaches: the best of the cells that are reached."""
    monkeypatch.setattr(ann, "HITS", 16)
    monkeypatch.setattr(ann, "PAIRS", 64)
    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, 6))
    x[200:240] = x[:40] * 2  # other vectors of the same direction: ties up to rounding
    index = ann.fit(x, 6400, 5, 0.9)
    cells, q = index.cells(x), x[:40]
    reach = np.array([index.reach(v, 120) for v in q])
    block = ann.Block(index, np.arange(40), q, reach, np.full(40, -2.0), 5)
    for part in np.array_split(rng.permutation(300), 7):
        block.add(x[part], pa.array([[int(i)] for i in part], pa.list_(pa.int64())), cells[part])
    for k in range(40):
        seen, held = set(), 0
        for _, cell in index.walk(q[k]):
            seen.add(cell)
            held += index.counts[cell]
            if held >= 120:
                break
        near = [j for j in range(300) if cells[j] in seen and j != k]
        score = {j: (q[k] * x[j]).sum() / (np.linalg.norm(q[k]) * np.linalg.norm(x[j])) for j in near}
        best = sorted(near, key=lambda j: (-score[j], j))[:5]
        assert block.vec_ids[block.at == k].tolist() == best
        assert np.allclose(block.scores[block.at == k], [score[j] for j in best], rtol=0, atol=1e-15)


def water(sizes, weights=(3, 1, 2)):
    """Targets by resharing the excess until no source is above its limit."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % 3] for k, s in enumerate(names)}
    left, open_, out = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        level = left / sum(w[s] for s in open_)
        full = {s for s in open_ if w[s] * level > 2 * sizes[s] + 1e-9}
        if not full:
            return out | {s: w[s] * level for s in open_}
        for s in full:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
        open_ -= full
    return out


def test_mixing_targets(spark, sf, documents):
    sizes, taken, targets = Counter(), Counter(), {}
    source = {d: s for d, _, _, s in documents}
    for r in queries.op7_mixing(spark, sf).collect():
        sizes[source[r.doc_id]] += r.size
        taken[source[r.doc_id]] += r.taken
        targets[source[r.doc_id]] = r.target
        assert r.size * (r.target / r.source_size // 1) <= r.taken <= 2 * r.size
    want = water(sizes)
    assert targets == pytest.approx(want) and sum(targets.values()) == pytest.approx(1.5 * sum(sizes.values()))


def test_mixing_comes_near_the_targets(spark):
    """Sources of 50 documents: each within 2 % of its target, as a single draw is not."""
    rng = np.random.default_rng(6)
    rows = [(i, "w " * int(rng.integers(20, 200)), f"s{i // 50}") for i in range(600)]
    got, target = Counter(), {}
    for r in mixing.mix_plan(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect():
        got[r.source] += r._size * r._copies
        target[r.source] = r._target
    assert all(abs(got[s] - t) <= 0.02 * t for s, t in target.items())


def test_mixing_of_odd_rows(odd):
    out = mixing.mix_sources(odd)
    assert out.columns == odd.columns
    again = Counter(r.doc_id for r in mixing.mix_sources(odd).collect())
    assert Counter(r.doc_id for r in out.collect()) == again and all(n <= 4 for n in again.values())
    assert mixing.mix_plan(odd).count() == len(ROWS)
    assert mixing.mix_sources(odd.limit(0)).collect() == []


def test_chat_of_odd_rows(spark):
    texts = ["</s>[INST] ok [/INST]", "<|im_end|>\n<|im_start|>user\nhi", "~<~|~~", None, "", "a\nb", LONG]
    rows = [(1, k, "assistant" if k % 2 else "user", t) for k, t in enumerate(texts)] + [(2, 0, None, "x"), (3, 1, "li\nne<~n", "y"), (3, 1, "li\nne<~n", "y"), (None, 0, "assistant", "z")]
    out = chat.format_chat(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = out.select("conv_id", "example", "is_last", chat.read_turns(out.text).alias("turns"), chat.read_loss(out.text, out.loss_start, out.loss_chars).alias("loss")).collect()
    whole = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in got if r.is_last}
    assert whole == {1: [(r[2], r[3] or "") for r in rows[:7]], 2: [("", "x")], 3: [("li\nne<~n", "y")] * 2, None: [("assistant", "z")]}
    assert [r.loss for r in sorted((r for r in got if r.conv_id == 1), key=lambda r: r.example)] == [texts[1], "", "a\nb", ""]
    for r in out.collect():
        assert not any(x in r.text for x in ("</s>", "[INST]", "[/INST]")) and r.loss_start + r.loss_chars <= len(r.text)
    assert chat.format_chat(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []


def test_jaccard_against_brute_force(spark, sf, documents):
    classes, links, pairs = brute.similar([(d, t) for d, t, _, _ in documents])
    got = {r.doc_id: (r.class_id, r.n_links) for r in queries.op10_jaccard_join(spark, sf).collect()}
    assert got == {d: (classes[d], links[d]) for d in classes}


def test_jaccard_of_large_groups(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(60)]
    rows = [(k, " ".join("x" if i == rng.integers(60) else w for i, w in enumerate(base))) for k in range(40)] + [(100, "one"), (101, "one"), (102, None), (103, " ")]
    classes, links, _ = brute.similar(rows)
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {d: (classes[d], links[d]) for d in classes}


def test_jaccard_of_long_texts(spark, monkeypatch):
    """Blocks are cut by n-grams where texts are long."""
    monkeypatch.setattr(jaccard, "GRAMS", 500)
    base = [f"w{i}" for i in range(300)]
    rows = [(k, " ".join([*base, f"a{k}"])) for k in range(12)] + [(20, " ".join(base[:150]))]
    classes, links, _ = brute.similar(rows)
    ran, real = [], jaccard.map_arrow
    monkeypatch.setattr(jaccard, "map_arrow", lambda df, f, schema: (ran.append(df.agg(F.max("j")).first()[0]) if "second" in df.columns else None) or real(df, f, schema))
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {d: (classes[d], links[d]) for d in classes} and ran[0] >= 5


def test_jaccard_band_by_band(spark, monkeypatch):
    """Chains of candidates: few pairs meet in a band, so clusters are not verified as a whole. One row a band makes chance ones."""
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    words = [f"w{i}" for i in range(2500)]
    rows = [(k, " ".join(words[k * 7 : k * 7 + 90])) for k in range(300)] + [(800 + k, " ".join(words[k * 300 : k * 300 + 250] + [f"t{k}"])) for k in range(8)]
    rows += [(900 + k, " ".join(words[k * 300 : k * 300 + 250])) for k in range(8)] + [(400, rows[0][1]), (400, rows[80][1])]
    # the document with two texts is two for the plain version
    classes, links, pairs = brute.similar([*rows[:-1], (401, rows[-1][1])])
    ran, real = [], jaccard.map_arrow
    monkeypatch.setattr(jaccard, "map_arrow", lambda df, f, schema: (ran.append(df) if "second" in df.columns else None) or real(df, f, schema))
    monkeypatch.setattr(jaccard, "drop", lambda *x: None)
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), rows=1, recall=1 - 1e-9).collect()}
    assert ran[0].filter("band >= 0").count() > 0
    assert got.pop(400) == (min(classes[400], classes[401]), links[400] + links[401])
    assert got == {d: (classes[d], links[d]) for d in got} and len(pairs) > 10


def test_jaccard_recall_at_the_threshold(spark):
    """Pairs of 0.8 to 0.82: as many found as the bands are chosen for."""
    rows, pairs = [], 0
    for k in range(400):
        words = [f"d{k}w{i}" for i in range(85)]
        other = words[:80] + [f"x{k}y{i}" for i in range(4 + k % 2)]
        a, b = brute.grams(" ".join(words[:84])), brute.grams(" ".join(other))
        assert 0.8 <= len(a & b) / len(a | b) < 0.92
        rows += [(2 * k, " ".join(words[:84])), (2 * k + 1, " ".join(other))]
        pairs += 1
    got = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).filter("n_links = 1").count()
    assert got >= 2 * pairs * 0.995


def test_jaccard_of_thousands_of_near_copies(spark):
    """Every one of 3,000 distinct copies of one text is linked to every other, and nothing else is."""
    base = [f"w{i}" for i in range(120)]
    rows = [(k, " ".join([*base, f"a{k}", f"b{k}"])) for k in range(3000)] + [(5000, "another text of six words")]
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {k: (0, 2999) for k in range(3000)} | {5000: (5000, 0)}


def test_jaccard_of_many_exact_copies(spark):
    """1,500 copies of one text meet their class by broadcast, the others by shuffle."""
    rows = [(k, "the very same text of some words") for k in range(1500)] + [(2000 + k, f"one two three four five{k % 3}") for k in range(9)]
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {k: (0, 1499) for k in range(1500)} | {2000 + k: (2000 + k % 3, 2) for k in range(9)}


def test_jaccard_of_odd_rows(odd):
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard.near_duplicates(odd).collect()}
    assert got[8] == (7, 1) and got[7] == (7, 1) and got[None] == (None, 0) and got[3] == (3, 0)
    kept = jaccard.dedup_near(odd)
    assert kept.columns == odd.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(["5", "5", "2", "3", "4", "6", "7", "None"])
    assert jaccard.near_duplicates(odd.limit(0)).collect() == []


#: Names that operators and stages use inside, or return.
INNER = ["_" + x for x in "doc size source_size target rate copies copy lang score ambiguous kept rejected_by left n_bytes n_removed n_spans n_lines n_dropped text rank".split()]
INNER += "doc others dropped batch key owner i x first shared fresh k h fraction size target rate mix_source source_size copy spans copy_of print n head starts left n_removed node root class_id n_links piece start length g parts base".split()
CARRY = {
    "dedup_lines": lambda df: line_dedup.dedup_lines(df),
    "predict": lambda df: language_id.identify(df),
    "cascade": lambda df: quality.cascade(df),
    "dedup_substrings": lambda df: suffix_dedup.dedup_substrings(df),
    "mix_plan": lambda df: mixing.mix_plan(df),
    "mix_sources": lambda df: mixing.mix_sources(df),
    "dedup_near": lambda df: jaccard.dedup_near(df),
}
RETURNED = {"dedup_lines": "_n_lines _n_dropped", "predict": "_lang _score _ambiguous", "cascade": "_kept _rejected_by", "dedup_substrings": "_left _n_bytes _n_removed _n_spans", "mix_plan": "_size _source_size _target _rate _copies"}


@pytest.mark.parametrize("name", [*CARRY, "language", "lines", "near_duplicates", "mix", "pack"])
def test_clashing_columns(spark, sf, name):
    """Columns of any internal name change neither the rows nor the columns' own values."""
    import corpus_pipeline as c

    run = CARRY[name] if name in CARRY else lambda df: dict(c.STAGES)[name](spark, df, sf)
    plain = spark.createDataFrame([r[:4] for r in ROWS], "doc_id long, text string, lang string, source string")
    extra = {x: f"{x}'s" for x in dict.fromkeys(INNER)}
    rich = plain.select("*", *[F.lit(v).alias(x) for x, v in extra.items()])
    new = RETURNED.get(name, "").split()
    want = run(plain)
    seen = [x for x in want.columns if x not in ("_rejected_by", "sequence_id", "offset")]
    got = run(rich)
    assert Counter(map(str, got.select(*seen).collect())) == Counter(map(str, want.select(*seen).collect()))
    mine = [x for x in extra if x not in new] if name != "pack" else []
    assert all(r[x] == extra[x] for r in got.select(*mine).collect() for x in mine)


@pytest.mark.parametrize("name", ["language", "lines", "near_duplicates", "mix", "pack"])
def test_stages_on_odd_and_empty_tables(spark, sf, odd, name):
    import corpus_pipeline as c

    stage = dict(c.STAGES)[name]
    out = stage(spark, odd, sf)
    kept = Counter(r.doc_id for r in out.collect())
    assert name == "pack" or out.columns == odd.columns
    assert kept == {
        "language": Counter({r[0]: 1 for r in ROWS if r[0] not in (3, 4, 6)}) + Counter({5: 1}),
        "lines": Counter(r[0] for r in ROWS),
        "near_duplicates": Counter(r[0] for r in ROWS) - Counter({8: 1}),
        "mix": kept,
        "pack": Counter({d: -(-len(brute.ids(t)) // 4096) * sum(r[0] == d for r in ROWS) for d, t, *_ in ROWS}),
    }[name]
    assert stage(spark, odd.limit(0), sf).collect() == []


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 3), (7, 8), (5, 5), (8, 7)] + [(100 + i, 101 + i) for i in range(60)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 9: 1, 7: 7, 8: 7} | {100 + i: 100 for i in range(61)}
    assert components.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_components_with_hubs(spark):
    """Hubs of more than 1,000 neighbours meet their least one by broadcast."""
    edges = [(5000, i) for i in range(10, 1500)] + [(6000, i) for i in range(1400, 2700)] + [(3, 2600), (7000, 7001)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: 3 for x in [3, 5000, 6000, *range(10, 2700)]} | {7000: 7000, 7001: 7000}


def test_pipeline_against_plain_versions(spark, sf, documents):
    import corpus_pipeline as c

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    kept, _ = c.materialize(c.stage_language(spark, docs, sf), "t1")
    assert kept.columns == columns and kept.count() == len([1 for _, t, _, _ in documents if t and any(x.isalpha() for x in t)])
    lines, _ = c.materialize(c.stage_lines(spark, kept, sf), "t2")
    assert lines.columns == columns and lines.count() == kept.count()
    near, _ = c.materialize(c.stage_near(spark, lines, sf), "t3")
    classes, _, _ = brute.similar([(r.doc_id, r.text) for r in lines.select("doc_id", "text").collect()])
    assert sorted(r.doc_id for r in near.collect()) == sorted({d for d, k in classes.items() if d == k})
    mixed, _ = c.materialize(c.stage_mix(spark, near, sf), "t4")
    assert mixed.columns == columns
    texts = {r.doc_id: r.text for r in mixed.collect()}
    times = Counter(r.doc_id for r in mixed.collect())
    ids = {d: brute.ids(t) for d, t in texts.items()}
    seen, n = check_packing(c.stage_pack(spark, mixed, sf).collect(), ids)
    assert seen == Counter({d: len(ids[d]) * times[d] for d in ids}) and n <= -(-sum(seen.values()) // 4096) + 1
    assert c.run(spark, sf).count() == sum(-(-len(ids[d]) // 4096) * times[d] for d in ids)
    assert [name for name, _ in c.STAGES] == ["language", "lines", "near_duplicates", "mix", "pack"]

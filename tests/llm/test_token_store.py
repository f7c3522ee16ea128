import brute
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from siltstone.llm import token_store

ENCODER = token_store.WordEncoder(open(token_store.default_tokenizer(), encoding="utf-8").read(), most=50)
ODD = "<|endoftext|> don't 'S ''s I'LL ≠ é   —-- \x1c\x1f\x85 İ ΣΣ 1² Ⅷ àb ﻿ \U0001f600! 가 <|x '".split(" ")


def ids(texts):
    values, offsets = ENCODER.encode(pa.array(["before", *texts, None], pa.string()).slice(1, len(texts)))
    return [values[a:b].tolist() for a, b in zip(offsets, offsets[1:])]


@settings(max_examples=600, deadline=None)
@given(st.lists(st.lists(st.one_of(st.sampled_from(ODD), st.sampled_from([" ", "\n", "\t", "", "\x0b"]), st.text(max_size=6)), max_size=12).map("".join), max_size=4))
def test_pieces_give_the_ids_of_the_library(texts):
    assert ids(texts) == [brute.ids(t)[:-1] for t in texts]


def test_other_tokenizers_go_through_the_library():
    import json

    import public_tokenizers

    with open(token_store.default_tokenizer(), encoding="utf-8") as f:
        known = json.load(f)
    assert token_store.cuts_words(known)
    known["normalizer"] = {"type": "Sequence", "normalizers": [{"type": "NFC"}]}
    assert not token_store.cuts_words(known) and not token_store.WordEncoder(json.dumps(known)).by_piece
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        assert not token_store.cuts_words(json.load(f))


def test_letters_that_the_tokenizer_takes_apart():
    texts = ["İ'S", "\ufb1d'x", "\u0958-a", "ǅ'll", "ΑΣ's", "ﬁ\u0301,"]
    assert ids(texts) == [brute.ids(t)[:-1] for t in texts]


def test_store_is_read_back_whole(spark, sf):
    from siltstone.llm.queries import op8_token_store

    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    start, want = 0, {}
    for r in sorted(rows, key=lambda r: r.doc_id):
        x = brute.ids(r.text)
        want[r.doc_id] = (start, len(x), brute.crc(x))
        start += len(x)
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in op8_token_store(spark, sf).collect()}
    assert got == want


def test_nulls_empty_texts_and_repeated_rows(spark):
    docs = spark.createDataFrame([(2, None), (1, ""), (3, "x y"), (3, "x y"), (None, "z")], "doc_id long, text string")
    store, path = token_store.encode_documents(docs)
    got = sorted((r.start, r.doc_id, r.n_tokens) for r in store.collect())
    assert got == [(0, None, 2), (2, 1, 1), (3, 2, 1), (4, 3, 3), (7, 3, 3)]
    empty, _ = token_store.encode_documents(docs.limit(0))
    assert token_store.with_crc(empty).collect() == []


def test_layout(spark, sf):
    import glob

    import pyarrow.parquet as pq

    _, path = token_store.encode_documents(spark.read.parquet(f"{sf}/documents.parquet"))
    files = glob.glob(f"{path.removeprefix('file:')}/*.parquet")
    chunk = {pq.ParquetFile(files[0]).metadata.row_group(0).column(i).path_in_schema: pq.ParquetFile(files[0]).metadata.row_group(0).column(i) for i in range(5)}
    assert any("DICTIONARY" in e for e in chunk["input_ids.list.element"].encodings)
    assert "DELTA_BINARY_PACKED" in chunk["at"].encodings
    assert chunk["doc_id"].has_column_index


def scans(df):
    """(column names read, rows that came out of the pages read) of each Parquet scan of a plan that has run."""
    out, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
            continue
        if node.nodeName().endswith("QueryStage"):
            todo.append(node.plan())
        if node.nodeName().startswith("Scan parquet"):
            out.append((sorted(node.requiredSchema().fieldNames()), node.metrics().apply("numOutputRows").value()))
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return out


def test_selective_reads_touch_only_their_pages(spark):
    docs = spark.range(0, 30_000).selectExpr("id * 3 as doc_id", "concat('word number ', id) as text")
    store, path = token_store.encode_documents(docs)
    want = {r.doc_id: (r.start, list(r.input_ids)) for r in store.filter("doc_id in (300, 45000)").collect()}
    some = token_store.read_documents(spark, path, [45_000, 300, 1])
    assert {r.doc_id: (r.start, list(r.input_ids)) for r in some.collect()} == want and len(want) == 2
    read = [n for columns, n in scans(some) if "input_ids" in columns]
    assert read and sum(read) <= 2 * 2000
    plain = token_store.read_metadata(spark, path)
    assert len(plain.collect()) == 30_000
    assert all("input_ids" not in columns for columns, _ in scans(plain))

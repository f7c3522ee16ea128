"""Token ids as Parquet list columns, and the tokenizing itself.

A store is one Parquet table in ascending doc_id order: doc_id, part, at (ids before the document within its part), n_tokens
and input_ids. Ids are dictionary-encoded, which packs them into the bits that the ids in use need; the counters are
delta-encoded. Row groups and pages are kept small and indexed, so that a reader of some documents, or of the metadata alone,
touches only their pages.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import map_arrow, remember, scratch, slices, spread, tasks

END_ID = 1
#: Bytes of texts that are encoded at once.
PART = 3 << 20
#: Parquet settings of a store.
LAYOUT = {
    "compression": "zstd",
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "2000",
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.enable.dictionary": "true",
    "parquet.enable.dictionary#doc_id": "false",
    "parquet.enable.dictionary#at": "false",
    "parquet.dictionary.page.size": str(1 << 20),
}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: The tokenizer's own pieces but for runs of letters, in lower-cased text: contractions, digits, runs of other characters. Characters
#: from U+0080 on count as letters here; texts in which they are not are told apart when their pieces are learned.
PIECE = r"('(?:re|ve|ll|[stmd])|[0-9]|[^\x20\x09-\x0Da-z0-9\x{80}-\x{10FFFF}]+)"
ODD, EMPTY = 0, 1


def cuts_words(model: dict) -> bool:
    """Whether a tokenizer's file says that it lower-cases, takes white space for one space, and cuts texts at word ends as PIECE does.
    Others go through the library whole."""
    types = [x.get("type") for x in (model.get("normalizer") or {}).get("normalizers", [])]
    split = [x["pattern"].get("Regex", "") for x in (model.get("pre_tokenizer") or {}).get("pretokenizers", []) if x.get("type") == "Split" and x.get("invert")]
    pieces = sorted(split[0].split("|")) if len(split) == 1 else []
    known = sorted(["'s", "'t", "'re", "'ve", "'m", "'ll", "'d", r"[\p{L}]+", r"[\p{N}]", r"[^\s\p{L}\p{N}]+"])
    return types == ["NFC", "Replace", "Lowercase"] and pieces == known and bool(model["model"].get("end_of_word_suffix"))


class WordEncoder:
    """Ids of whole texts, by way of the ids of their pieces.

    A tokenizer of which cuts_words() holds never joins ids across its pieces, so a text's ids are those of its pieces in order. Pieces new to this worker go through the library once; known ones are looked up. About `most`
    pieces are remembered, and those of one batch. Texts with special tokens, or with characters from U+0080 on that are no letters, go
    through the library whole, as do all texts of other tokenizers.
    """

    def __init__(self, model: str, most: int = 400_000) -> None:
        import json
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_str(model), most
        parsed = json.loads(model)
        suffix = parsed["model"].get("end_of_word_suffix") if cuts_words(parsed) else None
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.by_piece, vocabulary = bool(suffix), self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        if suffix:
            self.ends[[i for x, i in vocabulary.items() if x.endswith(suffix)]] = True
        self.forget()

    def forget(self) -> None:
        """Each known piece has a number, and there its place among the ids of all of them."""
        self.known = {b"": EMPTY}
        self.ids, self.start, self.size = np.zeros(0, self.dtype), np.zeros(2, np.int64), np.zeros(2, np.int64)

    def plain(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.dtype) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, pieces: list[bytes], group: int = 2048) -> None:
        words = [x for x in pieces if x.isascii() or letters(x.decode())]
        if len(words) < len(pieces):
            self.known.update(dict.fromkeys(set(pieces).difference(words), ODD))
        made, sizes = [], []
        for at in range(0, len(words), group):  # one call each: what the library returns is much larger than the ids
            g = words[at : at + group]
            ids = self.plain([b" ".join(g).decode()])[0]
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) == len(g):
                made.append(ids)
                sizes.append(np.diff(cuts, prepend=0))
            else:  # a piece that the library sees otherwise
                each = self.plain([x.decode() for x in g])
                made += each
                sizes.append(np.array([len(x) for x in each], np.int64))
        if words:
            self.known.update(zip(words, range(len(self.start), len(self.start) + len(words))))
            size = np.concatenate(sizes)
            self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(size) - size])
            self.size, self.ids = np.concatenate([self.size, size]), np.concatenate([self.ids, *made])

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts of a string array, one after the other, and where each text's begin (one more than texts). Nulls are empty."""
        raw, cuts = spread(column)  # an array of its own: kernels misread some slices
        column = pa.LargeStringArray.from_buffers(len(column), pa.py_buffer((cuts - cuts[0]).tobytes()), pa.py_buffer(bytes(raw[cuts[0] : cuts[-1]])))
        if not self.by_piece:
            return joined(self.plain(column.to_pylist()), self.dtype)
        parts = pc.ascii_split_whitespace(pc.replace_substring_regex(pc.ascii_lower(column), pattern=PIECE, replacement=r" \1 "))
        found = parts.flatten().dictionary_encode()
        rows = np.asarray(parts.offsets, dtype=np.int64)
        rows = rows - rows[0]
        raw, cuts = spread(found.dictionary)
        raw, cuts = bytes(raw), cuts.tolist()
        pieces = [raw[a:b] for a, b in zip(cuts, cuts[1:])]
        if len(self.known) > self.most:
            self.forget()
        numbers = list(map(self.known.get, pieces))
        new = [k for k, x in enumerate(numbers) if x is None]
        self.learn([pieces[k] for k in new])
        for k in new:
            numbers[k] = self.known[pieces[k]]
        number = np.array(numbers, np.int64)[found.indices.to_numpy()]
        size = self.size[number]
        upto = np.concatenate([[0], np.cumsum(size)])
        ids = self.ids[np.arange(upto[-1]) + np.repeat(self.start[number] - upto[:-1], size)]
        offsets = upto[rows]
        odd = {*np.flatnonzero(pc.match_substring(column, "<|").to_numpy(zero_copy_only=False)).tolist()}
        odd |= {*(np.searchsorted(rows, np.flatnonzero(number == ODD), "right") - 1).tolist()}
        if odd:
            whole = np.split(ids, offsets[1:-1])
            for k, x in zip(sorted(odd), self.plain([column[k].as_py() for k in sorted(odd)])):
                whole[k] = x
            return joined(whole, self.dtype)
        return ids, offsets


def letters(text: str) -> bool:
    """Whether a text is all letters, and still is when the tokenizer has composed and lower-cased it."""
    return text.isalpha() and unicodedata.normalize("NFC", text).lower().isalpha()


def joined(rows: list[np.ndarray], dtype: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate([np.zeros(0, dtype), *rows]), np.cumsum([0, *map(len, rows)])


def ended(ids: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with one more id after each text."""
    n = len(offsets) - 1
    out = np.full(len(ids) + n, end_id, ids.dtype)
    out[np.arange(len(ids)) + np.repeat(np.arange(n), np.diff(offsets))] = ids
    return out, offsets + np.arange(n + 1)


def encoder(model: str) -> WordEncoder:
    """One for each worker and model, kept between tasks."""
    return remember(f"encoder {zlib.crc32(model.encode())}", lambda: WordEncoder(model))


def load_model(spark: SparkSession, path: str | None):
    """The tokenizer file's content as a broadcast (under 2 MB): executors need no file."""
    with open(path or default_tokenizer(), encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    data, offsets = spread(batch.column(batch.schema.get_field_index(column)))
    data = bytes(data[offsets[0] : offsets[-1]])
    cuts = (offsets - offsets[0]).tolist()
    return [data[a:b] for a, b in zip(cuts, cuts[1:])]


def write_store(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID) -> None:
    """Write the ids of every text of docs (null: empty), each with end_id after it.

    Rows with a null doc_id come first; repeated doc_ids are rows of their own, in no fixed order among themselves unless
    their texts differ (then by text). An empty table makes an empty store.
    """
    spark = docs.sparkSession
    model = load_model(spark, tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, part, at = encoder(model.value), TaskContext.get().partitionId(), 0
        for whole in batches:
            for batch in slices(whole, "text", PART):
                ids, ends = ended(*enc.encode(batch.column(1)), end_id)
                n, values = np.diff(ends), ids.astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(np.full(len(n), part, np.int32)), pa.array(at + ends[:-1]), pa.array(n), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values))],
                    names=["doc_id", "part", "at", "n_tokens", "input_ids"],
                )
                at += int(ends[-1])

    ordered = docs.select("doc_id", "text").repartitionByRange(tasks(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    out = map_arrow(ordered, run, "doc_id long, part int, at long, n_tokens long, input_ids array<int>")
    out.write.options(**LAYOUT).parquet(path)


def read_starts(spark: SparkSession, path: str) -> DataFrame:
    """(part, base): the ids before each part of a store, from its metadata columns alone. One row a part."""
    totals = spark.read.parquet(path).groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, input_ids) of a store; start counts the ids of all documents before."""
    starts = F.broadcast(read_starts(spark, path))  # one row for each task that wrote
    return spark.read.parquet(path).join(starts, "part").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "input_ids")


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens) of a store. The pages of ids are not touched."""
    return read_store(spark, path).drop("input_ids")


def read_documents(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """The rows of read_store() with these doc_ids. The list becomes a filter of the scan: row groups, and in them pages of at most
    2,000 rows, are told apart by the doc_ids they hold, and others are not read. Unknown ids have no row."""
    starts = F.broadcast(read_starts(spark, path))
    some = spark.read.parquet(path).filter(F.col("doc_id").isin([int(x) for x in doc_ids]))
    return some.join(starts, "part").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "input_ids")


def with_crc(store: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32): crc32 of the ids as little-endian unsigned 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(3)
            values = ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
            cuts = ids.offsets.to_pylist()
            crc = pa.array([zlib.crc32(values[a:b]) for a, b in zip(cuts, cuts[1:])], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], crc], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return map_arrow(store, run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def encode_documents(docs: DataFrame, tokenizer: str | None = None) -> tuple[DataFrame, str]:
    path = scratch(docs.sparkSession, "tokens")
    write_store(docs, path, tokenizer)
    return read_store(docs.sparkSession, path), path

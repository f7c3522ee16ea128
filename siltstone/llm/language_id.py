"""Language identification by error-correcting output codes.

Each language has a binary codeword. For each bit one classifier, naive Bayes on hashed byte n-grams, says how strongly a text
belongs to the languages whose bit is set. Decoding is weighted by loss: a language's loss is the mean over bits of
log(1 + exp(-margin * bit)), and the language with the smallest loss wins; texts whose two best codewords are close are flagged
as ambiguous.

Training counts n-grams by language over all training texts: each task sums its counts, those sums are added up in two steps, and the
driver gets two vectors a bit, whatever the corpus and the number of languages. Nothing is sampled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import drop, map_arrow, materialize, slices, spread, tasks

BITS = 14
BUCKETS = 1 << BITS
#: Lengths of n-grams, in bytes of the lower-cased text with all but letters as one space.
ORDERS = (2, 3, 4)
#: The sums of tasks meet in so many groups a language before they meet in one.
GROUPS = 256
#: Shares of n-grams are added up as whole multiples of this, so that their order does not matter.
UNIT = 2.0**-50
LETTER, OTHER = r"\p{L}", r"[^\p{L}\p{M}]+"


def codewords(k: int, seed: int = 5) -> np.ndarray:
    """k rows of +-1: every split of the languages in two where there are at most 6, else the best of many random codes."""
    if k < 2:
        return np.ones((k, 0), np.int8)
    if k <= 6:
        n = (1 << (k - 1)) - 1
        rows = np.array([[1 if c == 0 else (1 if (split >> (c - 1)) & 1 else -1) for split in range(n)] for c in range(k)], np.int8)
        return rows
    rng, bits = np.random.default_rng(seed), int(np.ceil(10 * np.log2(k)))
    best, far = None, -1
    for _ in range(200 if k <= 2000 else 1):
        code = rng.choice(np.array([-1, 1], np.int8), (k, bits))
        if (np.abs(code.sum(0, dtype=np.int64)) == k).any():
            continue
        if k > 2000:  # random words of 10 log2(k) bits are far apart
            return code
        near = min(int((a != b).sum()) for a, b in combinations(code, 2)) if k <= 60 else int(bits - (np.abs(code.astype(int) @ code.T - bits * np.eye(k, dtype=int)).max() + bits) / 2)
        if near > far:
            best, far = code, near
    return best


def letters(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Each text in lower case with a space for whatever is no letter, and which texts have a letter. Nulls are empty."""
    raw, cuts = spread(column)
    column = pa.LargeStringArray.from_buffers(len(column), pa.py_buffer((cuts - cuts[0]).tobytes()), pa.py_buffer(bytes(raw[cuts[0] : cuts[-1]])))
    has = pc.match_substring_regex(column, LETTER).to_numpy(zero_copy_only=False)
    return pc.replace_substring_regex(pc.utf8_lower(column), pattern=OTHER, replacement=" "), has


def grams(column: pa.Array) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """The buckets of all n-grams, an array for each order; where those of each text begin in them (orders x texts + 1), and which
    texts have a letter. A text stands between spaces; one without a letter has no n-grams."""
    clean, has = letters(column)
    raw, cuts = spread(clean)
    size = np.where(has, np.diff(cuts) + 2, 0)
    ends = np.concatenate([[0], np.cumsum(size)])
    data = np.full(ends[-1] + 4, 32, np.uint8)
    # byte i of a text goes to place i + 1 of its own
    keep = np.repeat(has, np.diff(cuts))
    source = np.frombuffer(raw, np.uint8)[cuts[0] : cuts[-1]]
    place = np.arange(len(source)) + np.repeat(ends[:-1] + 1 - (cuts[:-1] - cuts[0]), np.diff(cuts))
    data[place if keep.all() else place[keep]] = source if keep.all() else source[keep]
    wide = data.astype(np.uint32)
    gram, total = wide[:-4].copy(), ends[-1]
    made, starts = [], []
    owner_end = np.repeat(ends[1:], size)
    for n in range(2, max(ORDERS) + 1):
        gram |= wide[n - 1 : total + n - 1] << np.uint32(8 * (n - 1))
        if n in ORDERS:
            inside = np.arange(total) + n <= owner_end
            h = (gram[inside] + np.uint32(n)) * np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(15)
            h *= np.uint32(0x85EBCA6B)
            made.append((h >> np.uint32(32 - BITS)).astype(np.int32))
            starts.append(np.concatenate([[0], np.cumsum(np.maximum(size - n + 1, 0))]))
    return made, np.array(starts), has


def profile(made: list[np.ndarray], starts: np.ndarray, text: int) -> np.ndarray:
    """How often each bucket is in one text."""
    return np.bincount(np.concatenate([x[a:b] for x, a, b in zip(made, starts[:, text], starts[:, text + 1])]), minlength=BUCKETS)


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray  # (buckets, bits), log odds of the bit for one n-gram
    scale: np.ndarray  # of each bit: margins per n-gram are brought to about 1

    def losses(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(texts, languages) mean losses; which texts have a letter."""
        made, starts, has = grams(column)
        if not self.code.shape[1]:
            return np.zeros((len(column), len(self.languages))), has
        margins = np.zeros((len(column), self.code.shape[1]))
        for at in range(0, len(column), 64):
            rows = range(at, min(at + 64, len(column)))
            margins[at : at + len(rows)] = np.stack([profile(made, starts, k) for k in rows]).astype(np.float32) @ self.weights
        n = np.diff(starts, axis=1).sum(0)
        margins = margins / (np.maximum(n, 1)[:, None] * self.scale)
        return np.stack([np.logaddexp(0, -4 * margins * c).mean(1) for c in self.code], 1), has


def count_by_language(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}
    for whole in batches:
        for batch in slices(whole, "text", 1 << 20):
            langs = batch.column(1).to_pylist()
            made, starts, _ = grams(batch.column(0))
            for lang in set(langs):
                mine = np.array([x == lang for x in langs])
                sums.setdefault(lang, np.zeros(BUCKETS, np.int64))
                for x, at in zip(made, starts):
                    sums[lang] += np.bincount(x if mine.all() else x[np.repeat(mine, np.diff(at))], minlength=BUCKETS)
    yield rows_of(sums, "lang", pa.string())


def add_by(key: str, kind: pa.DataType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The sum of the counts of each key."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        for batch in batches:
            for k, counts in zip(batch.column(0).to_pylist(), batch.column(1)):
                x = counts.values.to_numpy()
                sums[k] = sums[k] + x if k in sums else x
        yield rows_of(sums, key, kind)

    return add


def rows_of(sums: dict, key: str, kind: pa.DataType) -> pa.RecordBatch:
    flat = np.concatenate([np.zeros(0, np.int64), *sums.values()])
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sums) + 1, dtype=np.int32) * BUCKETS), pa.array(flat))
    return pa.RecordBatch.from_arrays([pa.array(list(sums), kind), lists], names=[key, "counts"])


def added(parts: DataFrame, key: str, kind: pa.DataType, schema: str) -> DataFrame:
    """Rows of (key, counts), one a task or more, as one row a key; first in GROUPS groups a key, by the task they come from."""
    add = add_by(key, kind)
    group = F.pmod(F.spark_partition_id(), F.lit(GROUPS))
    some = map_arrow(parts.repartition(tasks(parts.sparkSession), key, group), add, schema)
    return map_arrow(some.repartition(tasks(parts.sparkSession), key), add, schema)


def fit(train: DataFrame) -> Model:
    """Learn from (text, lang); null texts and langs are skipped. Languages are ordered by code point. The driver holds the names of the
    languages, their codewords, and two vectors of BUCKETS numbers a bit."""
    train = train.select("text", "lang").filter("text is not null and lang is not null")
    schema = "lang string, counts array<bigint>"
    counted, counted_at = materialize(added(map_arrow(train, count_by_language, schema), "lang", pa.string(), schema), "languages")
    languages = sorted(r["lang"] for r in counted.select("lang").collect())
    code = codewords(len(languages))
    word = train.sparkSession.sparkContext.broadcast(dict(zip(languages, code)))

    def shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """2 * bit + 1 sums the n-gram shares of the languages that have the bit, 2 * bit those of the others."""
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for lang, counts in zip(batch.column(0).to_pylist(), batch.column(1)):
                x = counts.values.to_numpy() + 0.5  # each language weighs the same
                share = np.maximum(1, np.round(x / x.sum() / UNIT).astype(np.int64))
                for b, bit in enumerate(word.value[lang].tolist()):
                    k = 2 * b + (bit > 0)
                    sums[k] = sums[k] + share if k in sums else share
        yield rows_of(sums, "side", pa.int32())

    sides = "side int, counts array<bigint>"
    found = {r["side"]: np.array(r["counts"]) * UNIT for r in added(map_arrow(counted, shares, sides), "side", pa.int32(), sides).collect()}
    drop(train.sparkSession, counted_at)
    weights = np.zeros((BUCKETS, code.shape[1]), np.float32)
    scale = np.ones(code.shape[1])
    for b in range(code.shape[1]):
        has, not_ = int((code[:, b] > 0).sum()), int((code[:, b] < 0).sum())
        yes, no = found[2 * b + 1] / has, found[2 * b] / not_
        weights[:, b] = np.log(yes / no)
        scale[b] = max(1e-6, float((found[2 * b + 1] - found[2 * b]) @ weights[:, b]) / len(languages))
    return Model(languages, code, weights, scale)


def predict(docs: DataFrame, model: Model, ambiguous_under: float = 0.2) -> DataFrame:
    """docs with _lang (a learned language; und where text is null or has no letter, or nothing was learned), _score (0 to 1:
    how far the best codeword is ahead of the second; 0 for und, 1 if only one language is known) and _ambiguous (a score under
    the threshold). Every row stays; columns of docs of those names are replaced. Equal texts have equal predictions; whole texts are
    read, however long. An empty table gives no rows."""
    docs = docs.drop("_lang", "_score", "_ambiguous")
    sent = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x bits, and a codeword a language

    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for whole in batches:
            for batch in slices(whole, "text", 1 << 20):
                langs, scores = label(m, batch.column(at))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores), pa.array(scores < ambiguous_under)], names=[*batch.schema.names, "_lang", "_score", "_ambiguous"])

    from pyspark.sql.types import BooleanType, DoubleType, StringType, StructType

    schema = StructType([*docs.schema.fields]).add("_lang", StringType()).add("_score", DoubleType()).add("_ambiguous", BooleanType())
    return map_arrow(docs, run, schema)


def label(m: Model, texts: pa.Array) -> tuple[list[str], np.ndarray]:
    if not m.languages:
        return ["und"] * len(texts), np.zeros(len(texts))
    losses, has = m.losses(texts)
    best = losses.argmin(1)
    if len(m.languages) == 1:
        scores = np.ones(len(texts))
    else:
        two = np.partition(losses, 1, axis=1)[:, :2]
        scores = 1 - np.exp(-4 * (two[:, 1] - two[:, 0]))
    return [m.languages[b] if h else "und" for b, h in zip(best, has)], np.where(has, scores, 0.0)


def held_out():
    """Documents whose crc32(doc_id as text) mod 4 is 2, kept from training. A null doc_id is not held out."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """Learn from the documents that are not held out, then predict all of them, as predict() says. Training is with lang;
    prediction with text only. Null texts and langs teach nothing; repeated rows count as often as they are there."""
    return predict(docs, fit(docs.filter(~held_out())))

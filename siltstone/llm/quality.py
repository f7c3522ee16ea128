"""Quality rules as a short-circuit cascade.

A rule is a function of a text's features that says whether the text is rejected. On a sample each rule's cost (seconds a
document) and selectivity (share rejected) are estimated; rules then run by rejection per cost, and a document that one rule
rejects is not looked at by the rules after it. The verdict, whether any rule rejects, does not depend on the order.
"""

from __future__ import annotations

import math
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StringType, StructType

from ._common import map_arrow, slices
from .token_store import texts_of

SYMBOLS = b"#*$%&|<>"
#: About so many documents are timed. The sample orders the rules; it has no part in what they say.
SAMPLE = 400


class Text:
    """A text and what rules have already found out about it."""

    def __init__(self, raw: bytes) -> None:
        self.raw, self._words, self.known = raw, None, {}

    @property
    def words(self) -> list[bytes]:
        if self._words is None:
            self._words = self.raw.split()  # bytes split at exactly the white space of the word rule
        return self._words


def code_points(x: bytes) -> int:
    return len(x.decode("utf-8", "replace"))


def word_chars(t: Text) -> int:
    return code_points(b"".join(t.words))


def n_symbols(t: Text) -> int:
    return len(t.raw) - len(t.raw.translate(None, SYMBOLS))


def n_dup_lines(t: Text) -> int:
    lines = [x for x in t.raw.split(b"\n") if x.strip(b" \t\n\x0b\x0c\r")]
    return len(lines) - len(set(lines))


def n_repeat_words(t: Text) -> int:
    if "n_repeat_words" not in t.known:
        t.known["n_repeat_words"] = repeats(t.words)
    return t.known["n_repeat_words"]


def repeats(words: list[bytes], window: int = 5) -> int:
    """Words in windows of five words that the text has twice or more, the first included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    if len(number) == len(words):
        return 0
    key = ids[:n]
    for k in range(1, window):  # exact: pairs of numbers are numbered anew, not hashed
        key = key * len(words) + ids[k : n + k]
        if k < window - 1:
            key = np.unique(key, return_inverse=True)[1]
    _, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
    starts = np.flatnonzero(counts[inverse] > 1)
    if not len(starts):
        return 0
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + window, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Text], bool]


NO_LETTERS = regex.compile(r"\p{L}")


def few_words(t: Text) -> bool:
    return len(t.words) < 10


def repeated_words(t: Text) -> bool:
    return 100 * n_repeat_words(t) > 20 * len(t.words)


def symbols(t: Text) -> bool:
    """More symbols than a tenth of the words."""
    return 10 * n_symbols(t) > len(t.words)


def duplicate_lines(t: Text) -> bool:
    """Over 30 % of the lines repeat an earlier one."""
    return 10 * n_dup_lines(t) > 3 * (t.raw.count(b"\n") + 1)


def word_length(t: Text) -> bool:
    """Words of 2 to 20 code points in the mean are usual."""
    return bool(t.words) and not 2 * len(t.words) <= word_chars(t) <= 20 * len(t.words)


def no_letters(t: Text) -> bool:
    return NO_LETTERS.search(t.raw.decode("utf-8", "replace")) is None


BASE_RULES = (Rule("few_words", few_words), Rule("repeated_words", repeated_words))
RULES = (*BASE_RULES, Rule("symbols", symbols), Rule("duplicate_lines", duplicate_lines), Rule("word_length", word_length), Rule("no_letters", no_letters))


def order_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample: int = SAMPLE) -> list[Rule]:
    """The rules by rejection per cost, as estimated on about `sample` documents; ties keep the given order. Only counts and
    seconds come to the driver."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        took, hit, n = np.zeros(len(rules)), np.zeros(len(rules), np.int64), 0
        for batch in batches:
            for raw in texts_of(batch):
                n += 1
                for k, rule in enumerate(rules):
                    began = time.perf_counter()
                    hit[k] += rule.rejects(Text(raw))
                    took[k] += time.perf_counter() - began
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(rules), dtype=np.int32)), pa.array(took), pa.array(hit), pa.array(np.full(len(rules), n, np.int64))], names=["rule", "took", "hit", "n"])

    fraction = min(1.0, sample / max(1, docs.count()))  # the count comes from the files' metadata
    drawn = F.xxhash64("doc_id" if "doc_id" in docs.columns else "text")
    some = docs.filter(F.pmod(drawn, F.lit(1 << 30)) < math.ceil(fraction * (1 << 30))).select("text")
    rows = map_arrow(some, measure, "rule int, took double, hit long, n long").groupBy("rule").agg(F.sum("took").alias("took"), F.sum("hit").alias("hit"), F.sum("n").alias("n")).collect()
    worth = {r["rule"]: ((r["hit"] + 0.5) / (r["n"] + 1)) / max(r["took"] / max(r["n"], 1), 1e-9) for r in rows}
    return [rules[k] for k in sorted(range(len(rules)), key=lambda k: -worth.get(k, 0.0))]


def cascade(docs: DataFrame, rules: tuple[Rule, ...] = RULES, measures: dict[str, Callable[[Text], int]] | None = None) -> DataFrame:
    """docs with _kept and _rejected_by (the first rule in the estimated order that rejects; null if kept), and one long column
    for each of `measures`. Null texts are empty. Every row stays; columns of docs of those names are replaced. An empty table gives no
    rows. The order comes from measured times, so where several rules reject a text _rejected_by may differ between runs; the rest never
    does."""
    measures = measures or {}
    docs = docs.drop("_kept", "_rejected_by", *measures)
    ordered = order_rules(docs, rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                by: list[str | None] = []
                found: dict[str, list[int]] = {m: [] for m in measures}
                for raw in texts_of(batch):
                    t = Text(raw)
                    by.append(next((r.name for r in ordered if r.rejects(t)), None))
                    for m, f in measures.items():
                        found[m].append(f(t))
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array([x is None for x in by]), pa.array(by, pa.string()), *(pa.array(x, pa.int64()) for x in found.values())],
                    names=[*batch.schema.names, "_kept", "_rejected_by", *found],
                )

    schema = StructType([*docs.schema.fields]).add("_kept", BooleanType()).add("_rejected_by", StringType())
    for m in measures:
        schema = schema.add(m, LongType())
    return map_arrow(docs, run, schema)


#: What the query reports of each text.
BASE_MEASURES = {"n_words": lambda t: len(t.words), "word_chars": word_chars, "n_symbols": n_symbols, "n_dup_lines": n_dup_lines, "n_repeat_words": n_repeat_words}

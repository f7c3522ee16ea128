"""Packing of documents into sequences, by a configuration linear program over the length histogram.

A configuration is a multiset of lengths that fits one sequence. The program asks for the least number of configurations that
cover the histogram; it is solved by multiplicative weights: each round prices the lengths, a knapsack bounded by the counts left
finds the configuration of the largest price, and the lengths that it covers become cheaper. A round uses its configuration a whole
number of times, so the program holds the histogram exactly and no other rule places anything. Pricing is partial: a knapsack sees
SEEN of the lengths left, spread over their range, and the next one others. Lengths have at most `capacity`
values, so a knapsack has a bounded size and the number of rounds grows with the logarithm of the counts, however many documents
there are; it runs on the driver. Each piece finds its own place from its rank among the pieces of its length.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import map_arrow, materialize, slices
from .token_store import END_ID, PART, encoder, ended, load_model

CAPACITY = 4096
#: Pieces of a length are ranked in groups of about so many, each by one task.
RANK_GROUP = 1024
#: How fast prices fall, how much more an id of a long length is worth at most, how steeply that grows with the length, and how many
#: lengths a knapsack sees.
RATE, MORE, LONG, SEEN = 3.0, 10.0, 16.0, 128


def best_configuration(lengths: np.ndarray, prices: np.ndarray, counts: np.ndarray, capacity: int) -> Counter:
    """The multiset of lengths of at most `capacity` in all, and no length more often than its count, with the largest price, as
    how often each length's index is taken: a bounded knapsack. A length that may be taken n times is 1, 2, 4, ... and the rest of n
    copies in one item each."""
    items = []
    for i, (length, bound) in enumerate(zip(lengths.tolist(), np.minimum(counts, capacity // lengths).tolist())):
        times = 1
        while bound > 0:
            items.append((i, min(times, bound), min(times, bound) * length))
            bound -= times
            times *= 2
    value, took = np.zeros(capacity + 1), np.zeros((len(items), capacity + 1), bool)
    for r, (i, times, size) in enumerate(items):
        worth = value[:-size] + prices[i] * times
        np.greater(worth, value[size:], out=took[r, size:])
        np.maximum(worth, value[size:], out=value[size:])
    chosen, c = Counter(), capacity
    for r in range(len(items) - 1, -1, -1):
        if took[r, c]:
            i, times, size = items[r]
            chosen[i] += times
            c -= size
    return chosen


def program(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> dict[tuple, int]:
    """Configurations (as sorted (length, how often) pairs) and how many sequences each makes; together they hold the counts.

    Steps are whole numbers of sequences, as many as the scarcest length of the configuration allows, so there is nothing to round and
    nothing is left over.
    """
    left = counts.copy()
    used: Counter = Counter()
    weight = ((1 + lengths / capacity) / 2) ** LONG
    price, turn = lengths * (1 + MORE * weight), 0
    while len(live := np.flatnonzero(left)):
        stride = -(-len(live) // SEEN)
        seen = live[turn % stride :: stride]
        turn += 1
        found = best_configuration(lengths[seen], price[seen], left[seen], capacity)
        at, n = seen[list(found)], np.array(list(found.values()), np.int64)
        step = int((left[at] // n).min())
        left[at] -= n * step
        # multiplicative weights: a weight falls by exp(-RATE * share) with the share covered of its length. Room is worth something at
        # any weight, so that full sequences win among like ones
        price[at] = lengths[at] * (1 + MORE * weight[at] * np.exp(-RATE * (1 - left[at] / counts[at])))
        used[tuple(sorted(zip(lengths[at].tolist(), n.tolist())))] += step
    return dict(used)


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> dict[tuple, int]:
    """Patterns, as ((length, how often), ...), and how many sequences each makes; together they hold exactly the histogram."""
    left = Counter({a: n for a, n in histogram.items() if n})
    if not left:
        return {}
    lengths = np.array(sorted(left), np.int64)
    counts = np.array([left[int(a)] for a in lengths], np.int64)
    return program(lengths, counts, capacity)


def placements(patterns: dict[tuple, int]) -> dict[int, list[tuple[int, int, int, int]]]:
    """For each length, ranges of its ranks: (first rank, per sequence, first sequence, offset in the sequence)."""
    out, taken, first = defaultdict(list), Counter(), 0
    for p in sorted(patterns):
        n, offset = patterns[p], 0
        for length, each in p:
            out[length].append((taken[length], each, first, offset))
            taken[length] += each * n
            offset += each * length
        first += n
    return out


def pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, input_ids]): every text's ids and END_ID, cut every `capacity` ids.

    A null text is empty and so one piece of one id. Null doc_ids and repeated rows are documents of their own.
    """
    model = load_model(docs.sparkSession, tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(model.value)
        for whole in batches:
            for batch in slices(whole, "text", PART):
                doc, number, start, length, crc, ids = [], [], [], [], [], []
                values, ends = ended(*enc.encode(batch.column(1)), END_ID)
                values, ends = values.astype("<u4"), ends.tolist()
                for doc_id, begin, end in zip(batch.column(0).to_pylist(), ends, ends[1:]):
                    for k, at in enumerate(range(begin, end, capacity)):
                        part = values[at : min(at + capacity, end)]
                        doc.append(doc_id)
                        number.append(k)
                        start.append(at - begin)
                        length.append(len(part))
                        crc.append(zlib.crc32(part))
                        ids.append(part.astype(np.int32) if with_ids else None)
                columns = [pa.array(doc, pa.int64()), pa.array(number, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    columns, names = [*columns, pa.array(ids, pa.list_(pa.int32()))], [*names, "input_ids"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", input_ids array<int>" * with_ids
    return map_arrow(docs.select("doc_id", "text"), run, schema)


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """pieces() with sequence_id and offset (long): where each piece lies. Sequences are gapless from 0 and hold at most
    `capacity` ids. Ties (pieces of one length) are ranked by doc_id, piece and crc. An empty table gives no rows."""
    spark = docs.sparkSession
    made, _ = materialize(pieces(docs, tokenizer, capacity, with_ids), "pieces")
    histogram = {r[0]: r[1] for r in made.groupBy("length").count().collect()}  # at most capacity rows
    table = spark.sparkContext.broadcast({a: tuple(np.array(c, np.int64) for c in zip(*x)) for a, x in placements(plan(histogram, capacity)).items()})
    # a frequent length is ranked in several groups
    parts = spark.createDataFrame([(a, -(-n // RANK_GROUP)) for a, n in histogram.items()], "length long, parts long")  # at most capacity rows
    group = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("parts"))
    columns = made.columns
    made = made.join(F.broadcast(parts), "length").select(*columns, group.alias("g"))
    counts = made.groupBy("length", "g").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("g").rowsBetween(Window.unboundedPreceding, -1)
    base, _ = materialize(counts.select("length", "g", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), "ranks")
    rank = F.row_number().over(Window.partitionBy("length", "g").orderBy("doc_id", "piece", "ids_crc32")) - 1 + F.col("base")
    # the join and the ranking share one shuffle
    ranked = made.join(base.hint("merge"), ["length", "g"]).withColumn("rank", rank.cast("long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rank, length = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("rank", "length"))
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for a in np.unique(length):
                rows = np.flatnonzero(length == a)
                first, each, start, at = table.value[int(a)]
                k = np.searchsorted(first, rank[rows], "right") - 1
                inside = rank[rows] - first[k]
                sequence[rows] = start[k] + inside // each[k]
                offset[rows] = at[k] + inside % each[k] * a
            keep = [c for c in batch.schema.names if c != "rank"]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in keep), pa.array(sequence), pa.array(offset)], names=[*keep, "sequence_id", "offset"])

    ranked = ranked.select(*columns, "rank")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ranked.schema if f.name != "rank")
    return map_arrow(ranked, run, f"{schema}, sequence_id long, offset long")

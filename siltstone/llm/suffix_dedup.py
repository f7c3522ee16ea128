"""Exact substring deduplication by external induced suffix sorting.

Each byte goes that lies in a string of LENGTH bytes which also starts in a document with a smaller doc_id. To sort only what can
repeat, and to sort it in independent shards, each string of LENGTH bytes is given an anchor: of its substrings of ANCHOR
bytes, the one with the least hash. Equal strings have equal anchors, so

1. anchors are dealt out by hash, and those that only one text has are dropped (packed arrays, about 12 bytes an anchor);
2. the strings around each remaining anchor, which overlap and so make one context of about 70 bytes, go to the shard of the anchor;
   equal contexts are one, with their smallest doc_id;
   an anchor with very many contexts, as at the edge of a passage that many texts have, is split by the bytes beside it;
3. a shard sorts the suffixes of its contexts by induction (induced_sort), and runs of suffixes that share LENGTH bytes give each string its
   smallest doc_id;
4. what a document loses is joined back to it.

Texts that equal another whole text as a whole are not sorted: all but the first lose everything.
"""

from __future__ import annotations

import itertools
import pickle
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructType

from ._common import drop, join_with_hot, map_arrow, materialize, release, seal, slices, spread, tasks
from .induced_sort import sorted_suffixes

LENGTH, ANCHOR = 50, 16
#: Bytes of contexts that are sorted at once, as long as contexts of one anchor are not more; and queue entries held in memory.
SHARD, HELD = 3 << 20, 1 << 18
#: Bytes of text whose anchors are looked at in one group, in the mean.
GROUP = 24 << 20
#: Bytes of anchors of one group that are looked at at once; a group with more, as of a passage that very many texts have, goes through a file.
AT_ONCE = 96 << 20
#: Anchors are split by the bytes beside them that have more than this share of all distinct contexts, or more of them than a shard holds.
HOT = 1 / 400
#: Up to so many split anchors are broadcast; beyond it, they are joined by shuffle.
HOTTEST = 50_000
#: Strings with so many successive places of their anchor stay together when it is split.
STEP = 4


def rolling(data: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of each substring of `width` bytes (a power of two), by doubling."""
    h, size = data.astype(np.uint64) + np.uint64(1), 1
    while size < width:
        h = (h[:-size] * np.uint64(0x9E3779B97F4A7C15)) ^ h[size:]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
        size *= 2
    return h


def anchors(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, width: int = ANCHOR, sides: bool = False) -> tuple[np.ndarray, ...]:
    """(hash, text number, first string, strings): for each maximal run of strings of `length` bytes of one text whose least hash of a
    substring is the same. Equal strings have equal hashes; starts count from the start of data.

    With `sides`, also 16-bit hashes of the anchor with as many bytes before it, and after it (0: the text has not so many), and a row for
    each different pair of them that the run has: its anchor may occur in it more than once. Strings are longer than three anchors, so
    of any place of the anchor in a string one of the two lies in the string, and texts that share the string agree on it.
    """
    none = np.zeros(0, np.int64)
    n = len(data) - length + 1
    if n <= 0:
        return (none.astype(np.uint64), none, none, none) + (none.astype(np.uint16),) * 2 * sides
    h = rolling(data, width)
    inside = length - width + 1
    low, size = h, 1
    while size * 2 <= inside:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    low = np.minimum(low[:n], low[inside - size : inside - size + n])
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    starts = np.flatnonzero(np.arange(n) + length <= offsets[owner[:n] + 1])
    if not len(starts):
        return (none.astype(np.uint64), none, none, none) + (none.astype(np.uint16),) * 2 * sides
    value = low[starts]
    new = np.concatenate([[True], (value[1:] != value[:-1]) | (starts[1:] != starts[:-1] + 1)])
    at = np.flatnonzero(new)
    start, strings = starts[at], np.diff(np.append(at, len(starts)))
    of = owner[start]
    if not sides:
        return value[at], of, start, strings
    # places of an anchor: those whose hash is the least of a string around them
    least = np.zeros(n + 2 * (inside - 1), np.uint64)
    least[starts + inside - 1] = value
    top, size = least, 1
    while size * 2 <= inside:
        top = np.maximum(top[:-size], top[size:])
        size *= 2
    place = np.flatnonzero(np.maximum(top[: len(h)], top[inside - size : inside - size + len(h)]) == h)
    string = place + inside - 1
    todo = np.arange(len(place))
    while len(todo):
        todo = todo[least[string[todo]] != h[place[todo]]]
        string[todo] -= 1
    run = np.searchsorted(start, string - inside + 1, "right") - 1
    value, of, start, strings = value[at][run], of[run], start[run], strings[run]
    wide = h[:-width] * np.uint64(0x9E3779B97F4A7C15) ^ h[width:]
    wide = ((wide ^ wide >> np.uint64(31)) * np.uint64(0x94D049BB133111EB) >> np.uint64(48)).astype(np.uint16) | np.uint16(1)
    before = np.where(place - width >= offsets[of], wide[np.maximum(place - width, 0)], np.uint16(0)) if len(wide) else np.zeros(len(place), np.uint16)
    after = np.where(place + 2 * width <= offsets[of + 1], wide[np.minimum(place, len(wide) - 1)], np.uint16(0)) if len(wide) else before
    # of the places of one run that look alike one will do
    several = np.flatnonzero(np.bincount(run)[run] > 1)
    pair = run[several] << 32 | before[several].astype(np.int64) << 16 | after[several]
    keep = np.ones(len(run), bool)
    keep[several] = False
    keep[several[np.unique(pair, return_index=True)[1]]] = True
    return tuple(x[keep] for x in (value, of, start, strings, before, after))


def text_arrays(batch: pa.RecordBatch, column: str) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = spread(batch.column(batch.schema.get_field_index(column)))
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def packed(values: list[np.ndarray], kind) -> pa.Array:
    return pa.array([x.tobytes() for x in values], kind)


def narrow(value: np.ndarray) -> np.ndarray:
    """The low 48 bits of each hash. Anchors that then look alike are kept, as shared ones are: nothing is lost by it."""
    return value.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]


def widen(raw: bytes) -> np.ndarray:
    low = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    out = np.zeros((len(low), 8), np.uint8)
    out[:, :6] = low
    return out.reshape(-1).view("<u8")


def shared_anchors(docs: DataFrame, groups: int) -> DataFrame:
    """(doc_id, start): the anchors, by the start of their run, that texts with another hash have too, with the same bytes before or
    after. Of equal texts the smallest doc_id stands for all. docs: doc_id, text, print (16 bytes, the text's hash)."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", 4 << 20):
                data, offsets = text_arrays(batch, "text")
                value, owner, start, _, before, after = anchors(data, offsets, sides=True)
                ids = batch.column(0).to_numpy()
                prints = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint64).reshape(-1, 2)
                group = (value >> np.uint64(20)) % np.uint64(groups)
                order = np.argsort(group.astype(np.uint16) if groups <= 1 << 16 else group, kind="stable")
                group, value, owner, start, before, after = (x[order] for x in (group, value, owner, start, before, after))
                cuts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1], [True]])).tolist() if len(group) else []
                out: dict[str, list] = {k: [] for k in ("g", "hashes", "counts", "docs", "prints", "starts", "before", "after")}
                for i, j in zip(cuts, cuts[1:]):
                    who, n = np.unique(owner[i:j], return_counts=True)  # owners ascend
                    row = narrow(value[i:j]), n.astype(np.int32), ids[who], prints[who], (start[i:j] - offsets[owner[i:j]]).astype(np.int32), before[i:j], after[i:j]
                    out["g"].append(int(group[i]))
                    for k, x in zip(list(out)[1:], row):
                        out[k].append(x)
                yield pa.RecordBatch.from_arrays([pa.array(out["g"], pa.int32()), *(packed(out[k], pa.binary()) for k in list(out)[1:])], names=list(out))

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def group(rows: list[list[bytes]]) -> pa.RecordBatch:
            join = lambda k, kind: np.frombuffer(b"".join(r[k] for r in rows), kind)
            value, counts, start = widen(join(0, np.uint8)), join(1, np.int32), join(4, np.int32)
            doc = np.repeat(join(2, np.int64), counts)
            text = np.repeat(np.unique(join(3, np.uint64).reshape(-1, 2), axis=0, return_inverse=True)[1].ravel(), counts)
            many = np.zeros(len(value), bool)
            for side in (join(5, np.uint16), join(6, np.uint16)):
                has = np.flatnonzero(side)
                key = value[has] ^ (side[has].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                order = np.argsort(key)
                key, mine = key[order], text[has[order]]
                first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else order
                if len(first):
                    differ = np.minimum.reduceat(mine, first) != np.maximum.reduceat(mine, first)
                    many[has[order]] |= np.repeat(differ, np.diff(np.append(first, len(key))))
            keep = np.flatnonzero(many)
            value, text, doc, start = value[keep], text[keep], doc[keep], start[keep]
            # of equal texts only the first document
            order = np.lexsort((doc, text, value))
            value, text, doc, start = value[order], text[order], doc[order], start[order]
            head = np.concatenate([[True], (value[1:] != value[:-1]) | (text[1:] != text[:-1])]) if len(value) else np.zeros(0, bool)
            lowest = np.repeat(doc[head], np.diff(np.append(np.flatnonzero(head), len(doc))))
            mine = np.flatnonzero(doc == lowest)
            # a run may have been kept by several places of its anchor
            mine = mine[np.lexsort((start[mine], doc[mine]))]
            mine = mine[np.concatenate([[True], (doc[mine[1:]] != doc[mine[:-1]]) | (start[mine[1:]] != start[mine[:-1]])])] if len(mine) else mine
            return pa.RecordBatch.from_arrays([pa.array(doc[mine]), pa.array(start[mine])], names=["doc_id", "start"])

        def parts(rows: Iterator[list[bytes]]) -> Iterator[tuple[np.ndarray, ...]]:
            """(value, key before, key after, text, doc, start) of a row at a time; a key is 0 where the text ends."""
            for hashes, counts, docs_, prints, starts, *sides in rows:
                value, times = widen(hashes), np.frombuffer(counts, np.int32)
                keys = [np.where(x := np.frombuffer(side, np.uint16), value ^ (x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), np.uint64(0)) for side in sides]
                yield value, *keys, np.repeat(np.frombuffer(prints, np.uint64)[::2], times), np.repeat(np.frombuffer(docs_, np.int64), times), np.frombuffer(starts, np.int32)

        def large(rows: Iterator[list[bytes]]) -> Iterator[pa.RecordBatch]:
            """As group(), of rows in a file: first which keys more than one text has, then the places with them. Held are the keys, not the
            places. Texts that are equal all stay; those that are copies as a whole go in any case."""
            with tempfile.TemporaryFile(prefix="anchors-") as f:
                known: list[tuple[np.ndarray, np.ndarray, np.ndarray] | None] = [None, None]
                for row in rows:
                    pickle.dump(row, f)
                    _, *keys, text, _, _ = next(parts(iter([row])))
                    for k in (0, 1):
                        key, low, high = keys[k], text, text
                        if known[k] is not None:
                            key, low, high = np.concatenate([known[k][0], key]), np.concatenate([known[k][1], text]), np.concatenate([known[k][2], text])
                        order = np.argsort(key, kind="stable")
                        key = key[order]
                        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
                        known[k] = key[first], np.minimum.reduceat(low[order], first), np.maximum.reduceat(high[order], first)
                shared = [key[(low != high) & (key != 0)] for key, low, high in known]
                end = f.tell()
                f.seek(0)
                while f.tell() < end:
                    _, before, after, _, doc, start = next(parts(iter([pickle.load(f)])))
                    keep = np.isin(before, shared[0]) | np.isin(after, shared[1])
                    pair = np.unique(np.stack([doc[keep], start[keep].astype(np.int64)]), axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array(pair[0]), pa.array(pair[1].astype(np.int32))], names=["doc_id", "start"])

        def rows_of() -> Iterator[tuple[int, list[bytes]]]:
            for batch in batches:
                for g, *row in zip(*(c.to_pylist() for c in batch.columns)):
                    yield g, row

        for _, members in itertools.groupby(rows_of(), key=lambda x: x[0]):
            held, size = [], 0
            mine = (row for _, row in members)
            for row in mine:
                held.append(row)
                size += sum(map(len, row))
                if size > AT_ONCE:
                    yield from large(itertools.chain(held, mine))
                    held = []
            if held:
                yield group(held)

    spark = docs.sparkSession
    dealt = map_arrow(docs, find, "g int, hashes binary, counts binary, docs binary, prints binary, starts binary, before binary, after binary")
    # groups go round the tasks in turn, so that each has as many
    return map_arrow(dealt.repartitionById(tasks(spark), F.pmod("g", F.lit(tasks(spark)))).sortWithinPartitions("g"), select, "doc_id long, start int")


def contexts(texts: DataFrame) -> DataFrame:
    """(anchor, doc_id, start, context) for (doc_id, text, starts array<int>)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", 2 << 20):
                data, offsets = text_arrays(batch, "text")
                value, owner, start, n = anchors(data, offsets)
                lists = batch.column(2)
                wanted = lists.flatten().to_numpy().astype(np.int64) + np.repeat(offsets[:-1], np.diff(lists.offsets.to_numpy()))
                keep = np.isin(start, wanted)
                value, owner, start, n = value[keep], owner[keep], start[keep], n[keep] + LENGTH - 1
                ends = np.concatenate([[0], np.cumsum(n)])
                flat = data[np.arange(ends[-1]) + np.repeat(start - ends[:-1], n)]
                bytes_ = pa.BinaryArray.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(flat.tobytes())])
                ids = batch.column(0).to_numpy()[owner]
                yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(ids), pa.array((start - offsets[owner]).astype(np.int32)), bytes_], names=["anchor", "doc_id", "start", "context"])

    return map_arrow(texts, run, "anchor long, doc_id long, start int, context binary")


def split_contexts(found: DataFrame) -> DataFrame:
    """The same strings under finer anchors: (anchor, doc_id, start, context) of contexts that have LENGTH - STEP + 1 bytes or more in
    common. A string's place in its context is told by the first place of the anchor in it, so equal strings come to the same
    finer anchor: a hash of the bytes that all strings with nearly that place have in common."""
    span = LENGTH - ANCHOR

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for batch in slices(big, "context", 1 << 20):
                data, offsets = text_arrays(batch, "context")
                if not batch.num_rows:
                    continue
                anchor = batch.column(0).to_numpy().view(np.uint64)
                owner = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
                h = rolling(data, ANCHOR)
                hits = np.flatnonzero((h == anchor[owner[: len(h)]]) & (np.arange(len(h)) + ANCHOR <= offsets[owner[: len(h)] + 1]))
                string = np.flatnonzero(np.arange(len(data)) + LENGTH <= offsets[owner + 1])
                place = hits[np.searchsorted(hits, string)]
                step = (place - string) // STEP
                new = np.concatenate([[True], (place[1:] != place[:-1]) | (step[1:] != step[:-1]) | (owner[string[1:]] != owner[string[:-1]])])
                first = np.flatnonzero(new)
                begin, place, step, row = string[first], place[first], step[first], owner[string[first]]
                size = np.diff(np.append(first, len(string))) + LENGTH - 1
                # all strings of a step have the bytes from its least place before the anchor to the end of the one that begins first
                low, high = place - step * STEP, place - np.minimum(step * STEP + STEP - 1, span) + LENGTH
                key = h[low] * np.uint64(0x9E3779B97F4A7C15) ^ h[low + ANCHOR]
                key = (key ^ key >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9) ^ h[high - ANCHOR] ^ step.astype(np.uint64)
                ends = np.concatenate([[0], np.cumsum(size)])
                flat = data[np.arange(ends[-1]) + np.repeat(begin - ends[:-1], size)]
                part = pa.BinaryArray.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(flat.tobytes())])
                start = batch.column(2).to_numpy()[row] + (begin - offsets[row])
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(batch.column(1).to_numpy()[row]), pa.array(start.astype(np.int32)), part], names=["anchor", "doc_id", "start", "context"])

    return map_arrow(found, run, "anchor long, doc_id long, start int, context binary")


def first_owners(data: np.ndarray, offsets: np.ndarray, owner: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """For each string of each context, one after the other, its smallest owner over all contexts. By a suffix sort of all of them."""
    size, m = np.diff(offsets), len(owner)
    starts = offsets + np.arange(m + 1)
    which = np.repeat(np.arange(m, dtype=np.int32), size + 1)
    text = np.zeros(starts[-1], np.uint16)  # 0, below every byte and in no string, ends each context
    ends = np.zeros(len(text), bool)
    ends[starts[1:] - 1] = True
    text[~ends] = data.astype(np.uint16) + 1
    inside = np.arange(len(text)) <= (starts[1:] - 1 - length)[which]
    out = np.empty(len(text), np.int64)

    def resolve(at: np.ndarray, shared: np.ndarray) -> None:
        """Strings of one first character: runs that share `length` bytes are one string."""
        run = np.cumsum(shared < length)
        strings = inside[at]
        at, run = at[strings], run[strings]
        if len(at):
            heads = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
            least = np.minimum.reduceat(owner[which[at]], heads)
            out[at] = np.repeat(least, np.diff(np.append(heads, len(at))))

    sorted_suffixes(text, length, HELD, resolve)
    return out[inside]


def shard(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The rows of resolve() for whole groups of contexts of one anchor, sorted by anchor."""
    anchor, owner = batch.column(0).to_numpy(), batch.column(3).to_numpy()
    data, offsets = text_arrays(batch, "context")
    first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    members = np.diff(np.append(first, len(anchor)))
    # a context whose anchor has no other context shares no string with any
    rest = np.flatnonzero(np.repeat(members, members) > 1)
    n = np.ones(len(anchor), np.int64)
    values = owner
    if len(rest):
        size = np.diff(offsets)[rest]
        ends = np.concatenate([[0], np.cumsum(size)])
        found = first_owners(data[np.arange(ends[-1]) + np.repeat(offsets[rest] - ends[:-1], size)], ends, owner[rest])
        strings = size - LENGTH + 1
        at = np.concatenate([[0], np.cumsum(strings)[:-1]])
        low, high = np.minimum.reduceat(found, at), np.maximum.reduceat(found, at)
        n[rest] = np.where(low == high, 1, strings)
        cuts = np.concatenate([[0], np.cumsum(n)])
        values = np.empty(cuts[-1], np.int64)
        values[cuts[:-1]] = owner
        values[cuts[rest]] = low
        many = low != high
        size, to, come = strings[many], cuts[rest][many], at[many]
        inner = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        values[inner + np.repeat(to, size)] = found[inner + np.repeat(come, size)]
    cuts = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
    return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(cuts), pa.array(values))], names=["anchor", "mark", "owners"])


def resolve(distinct: DataFrame) -> DataFrame:
    """(anchor, mark, owners array<long>) for (anchor, mark, context, owner), dealt and sorted by anchor: the smallest owner of each
    string of a context, or one value if all are the same."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(x.get_total_buffer_size() for x in held) < SHARD:
                continue
            whole = pa.concat_batches(held)
            anchor = whole.column(0).to_numpy()
            end = int(np.searchsorted(anchor, anchor[-1], "left"))  # the last anchor may go on
            if end:
                yield shard(whole.slice(0, end))
            held = [whole.slice(end)]
        whole = pa.concat_batches(held) if held else None
        if whole is not None and whole.num_rows:
            yield shard(whole)

    return map_arrow(distinct, run, "anchor long, mark long, owners array<long>")


def cut(data: np.ndarray, offsets: np.ndarray, spans: pa.ListArray, copy: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """What is left of each text, and how many bytes and maximal runs of them went. spans: for each text a list (or null) of (start, size,
    strings): a context that goes whole, or the strings of it that go. copy: the texts that go whole."""
    edge = np.zeros(len(data) + 1, np.int32)
    many = pc.fill_null(pc.list_value_length(spans), 0).to_numpy()
    start, size, strings = spans.flatten().flatten()
    at = np.repeat(offsets[:-1], many) + start.to_numpy(zero_copy_only=False)
    whole = strings.is_null().to_numpy(zero_copy_only=False)
    each = pc.fill_null(pc.list_value_length(strings), 0).to_numpy(zero_copy_only=False)
    single = np.repeat(at, each) + strings.flatten().to_numpy(zero_copy_only=False)
    for begin, end in ((at[whole], at[whole] + size.to_numpy(zero_copy_only=False)[whole]), (single, single + LENGTH), (offsets[:-1][copy], offsets[1:][copy])):
        np.add.at(edge, begin, 1)
        np.add.at(edge, end, -1)
    gone = np.cumsum(edge[:-1]) > 0
    kept = np.concatenate([[0], np.cumsum(~gone)])[offsets]
    heads = gone.copy()
    heads[1:] &= ~gone[:-1]
    first = offsets[:-1][np.diff(offsets) > 0]
    heads[first] = gone[first]  # runs end with their text
    runs = np.concatenate([[0], np.cumsum(heads)])[offsets]
    left = pa.BinaryArray.from_buffers(pa.binary(), len(kept) - 1, [None, pa.py_buffer(kept.astype(np.int32).tobytes()), pa.py_buffer(data[~gone].tobytes())])
    return left, np.diff(offsets) - np.diff(kept), np.diff(runs)


def dedup_substrings(docs: DataFrame) -> DataFrame:
    """docs with _left (binary: what is left of the text's UTF-8 bytes, in one piece), _n_bytes, _n_removed and _n_spans (long).

    Strings are judged on the input, never on what is left, and do not cross documents. Null texts are empty. Rows that share a doc_id
    are one document: their strings do not remove each other. Rows with a null doc_id lose nothing and remove nothing. Every row
    stays; columns of docs of those names are replaced.
    """
    spark = docs.sparkSession
    docs, open_ = seal(docs.drop("_left", "_n_bytes", "_n_removed", "_n_spans"), "doc_id", "text")
    text = F.coalesce("text", F.lit(""))
    base = docs.filter("doc_id is not null").select("doc_id", text.alias("text"))
    prints, _ = materialize(base.select("doc_id", F.unhex(F.substring(F.sha2("text", 256), 1, 32)).alias("print"), F.octet_length("text").cast("long").alias("n")), "prints")
    total = prints.agg(F.sum("n")).first()[0] or 0
    heads = prints.groupBy("print").agg(F.min("doc_id").alias("head"), F.max("doc_id").alias("tail"), F.count("*").alias("times")).filter("head < tail")
    heads, heads_at = materialize(heads.select("print", "head", "times"), "heads")
    long = prints.filter(f"n >= {LENGTH}").select("doc_id", "print")
    copies, _ = materialize(join_with_hot(long, heads, "print", prints.count(), "times").filter("doc_id > head").select("doc_id", "print").distinct(), "copies")
    drop(spark, heads_at)
    printed = base.withColumn("print", F.unhex(F.substring(F.sha2("text", 256), 1, 32)))
    starts, starts_at = materialize(shared_anchors(printed, max(1, -(-total // GROUP))), "starts")
    release(spark)
    texts = base.join(starts.groupBy("doc_id").agg(F.collect_list("start").alias("starts")).hint("merge"), "doc_id")
    found, found_at = materialize(contexts(texts), "contexts")
    drop(spark, starts_at)
    release(spark)
    # the contexts go before they are sorted: what the join needs of them is a third of their size
    mark = F.xxhash64("context").alias("mark")
    sorted_by = lambda df: df.groupBy("anchor", "context").agg(F.min("doc_id").alias("owner")).select("anchor", mark, "context", "owner")
    placed = lambda df: df.select("anchor", mark, "doc_id", "start", F.length("context").alias("size"))
    distinct, distinct_at = materialize(sorted_by(found), "distinct")
    # an anchor beside which very many texts go on in their own way
    most = min(SHARD // (2 * LENGTH - ANCHOR), max(1, int(distinct.count() * HOT)))
    hot, hot_at = materialize(distinct.groupBy("anchor").agg(F.count("*").alias("n")).filter(F.col("n") > most).select("anchor"), "hot")
    hot = F.broadcast(hot) if hot.count() <= HOTTEST else hot.hint("merge")
    finer, finer_at = materialize(split_contexts(found.join(hot, "anchor", "left_semi")), "finer")
    cool = lambda df: df.join(hot, "anchor", "left_anti")
    marked, marked_at = materialize(placed(cool(found)).unionAll(placed(finer)), "marked")
    drop(spark, found_at)
    release(spark)
    distinct = cool(distinct).unionAll(sorted_by(finer))
    owners, owners_at = materialize(resolve(distinct.repartition(tasks(spark) * 2, "anchor").sortWithinPartitions("anchor")), "owners")
    drop(spark, distinct_at, hot_at, finer_at)
    release(spark)
    here = marked.join(owners.hint("merge"), ["anchor", "mark"])
    sole = F.size("owners") == 1
    strings = F.filter(F.transform("owners", lambda o, i: F.when(o < F.col("doc_id"), i)), lambda x: x.isNotNull())
    lost = here.select("doc_id", F.struct("start", "size", F.when(~sole, strings).alias("strings")).alias("span"), F.when(sole, F.get("owners", F.lit(0)) < F.col("doc_id")).otherwise(F.size(strings) > 0).alias("any")).filter("any")
    spans, _ = materialize(lost.groupBy("doc_id").agg(F.collect_list("span").alias("spans")), "spans")
    drop(spark, marked_at, owners_at)
    release(spark)
    gone = spans.join(copies.hint("merge").select("doc_id", F.col("print").alias("copy_of")), "doc_id", "full").withColumnRenamed("doc_id", "doc")
    whole = docs.join(gone.hint("merge"), F.col("doc_id") == F.col("doc"), "left")
    mine = F.unhex(F.substring(F.sha2(text, 256), 1, 32))
    whole = whole.select(*docs.columns, "spans", F.coalesce(F.col("copy_of") == mine, F.lit(False)).alias("copy"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for batch in slices(big, "text"):
                data, offsets = text_arrays(batch, "text")
                width = batch.num_columns
                left, removed, runs = cut(data, offsets, batch.column(width - 2), batch.column(width - 1).to_numpy(zero_copy_only=False))
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[: width - 2], left, pa.array(np.diff(offsets)), pa.array(removed), pa.array(runs)],
                    names=[*batch.schema.names[: width - 2], "left", "n_bytes", "n_removed", "n_spans"],
                )

    schema = StructType([*docs.schema.fields]).add("left", BinaryType()).add("n_bytes", LongType()).add("n_removed", LongType()).add("n_spans", LongType())
    made = map_arrow(whole, finish, schema)
    return open_(made, _left=F.col("left"), _n_bytes=F.col("n_bytes"), _n_removed=F.col("n_removed"), _n_spans=F.col("n_spans"))

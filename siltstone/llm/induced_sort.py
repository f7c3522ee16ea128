"""Suffix sorting by external induction, with common-prefix values.

Suffixes are of type S or L as they are less or greater than the one after them; a leftmost S suffix (LMS) follows an L one.
Sorted LMS suffixes induce all L suffixes in one ascending sweep, and those all S suffixes in one descending sweep. Each sweep is a
priority queue by (first character, rank of the next suffix): because the sweep visits suffixes in rank order, what it puts
in for one character is already in order, so the queue is one first-in first-out queue a character, kept on disk beyond a
given number of entries. Entries carry the suffix and the length of the prefix that it shares with the entry before it: one more
than the least value passed since, which the sweep keeps for every character. The L suffixes wait for the second sweep in such queues
too, and that sweep hands its output over a character at a time. The LMS suffixes themselves are sorted by recursion: the same
induction sorts the pieces between them, the pieces get numbers, and the string of numbers is sorted in turn; the recursion ends with a
string of numbers that is short enough to be ranked in memory (BASE).

Everything works on whole batches of a queue; common prefixes are told apart up to `cap` characters. The text, its types and the LMS
suffixes, about eight bytes a character, are in memory.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable

import numpy as np

#: A string of at most so many numbers of pieces ends the recursion: it is ranked by doubling, in about 50 bytes a number. A sweep works
#: character by character, which is slow where pieces are of very many kinds, so this is well above what a usual shard has.
BASE = 1 << 22
#: Suffixes, and what they share.
AT, SHARED = np.int32, np.int16


def by_character(chars: np.ndarray, alphabet: int) -> np.ndarray:
    """The stable order of characters; those of 16 bits are sorted by radix."""
    return np.argsort(chars.astype(np.uint16) if alphabet <= 1 << 16 else chars, kind="stable")


class BucketQueues:
    """A first-in first-out queue of (suffix, shared) for each character. Beyond `most` entries the fullest queues go to disk."""

    def __init__(self, alphabet: int, most: int, folder: str) -> None:
        self.queues: list[list] = [[] for _ in range(alphabet)]
        self.sizes = np.zeros(alphabet, np.int64)
        self.held, self.most, self.folder, self.files = 0, most, folder, 0

    def put(self, char: int, suffix: np.ndarray, shared: np.ndarray) -> None:
        self.queues[char].append((suffix, shared))
        self.sizes[char] += len(suffix)
        self.held += len(suffix)
        if self.held > self.most:
            self.spill()

    def spill(self) -> None:
        while self.held > self.most // 2 and self.sizes.max():
            char = int(self.sizes.argmax())
            kept = [x for x in self.queues[char] if not isinstance(x, str)]
            path = os.path.join(self.folder, f"{id(self)}-{self.files}")
            self.files += 1
            with open(path, "wb") as f:
                for k in (0, 1):
                    for x in kept:
                        f.write(x[k].tobytes())
            self.queues[char] = [x for x in self.queues[char] if isinstance(x, str)] + [path]
            self.held -= int(self.sizes[char])
            self.sizes[char] = 0

    def take(self, char: int) -> tuple[np.ndarray, np.ndarray]:
        parts = []
        for x in self.queues[char]:
            if isinstance(x, str):
                with open(x, "rb") as f:
                    raw = f.read()
                os.unlink(x)
                n = len(raw) // (AT().itemsize + SHARED().itemsize)
                parts.append((np.frombuffer(raw, AT, n), np.frombuffer(raw, SHARED, n, n * AT().itemsize)))
            else:
                parts.append(x)
        self.held -= int(self.sizes[char])
        self.sizes[char], self.queues[char] = 0, []
        if not parts:
            return np.zeros(0, AT), np.zeros(0, SHARED)
        return np.concatenate([a for a, _ in parts]), np.concatenate([b for _, b in parts])


class Least:
    """For each character the least shared prefix passed since its last entry."""

    def __init__(self, alphabet: int) -> None:
        self.since = np.zeros(alphabet, SHARED)

    def pass_over(self, shared: np.ndarray, at_sorted: np.ndarray, to_sorted: np.ndarray, cap: int) -> np.ndarray:
        """Pass over a batch with these shared values; entries go to characters to_sorted at places at_sorted, which ascend within a
        character. Returns the shared prefix of each entry with the one before it in its queue."""
        if not len(shared):
            return shared
        low = np.minimum.accumulate(shared)
        if not len(at_sorted):
            self.since = np.minimum(self.since, low[-1])
            return shared[:0]
        first = np.concatenate([[True], to_sorted[1:] != to_sorted[:-1]])
        # least of shared over (place of the entry before, own place]: a table of minima over powers of two
        begin = np.where(first, 0, np.concatenate([[0], at_sorted[:-1] + 1]))
        found = range_min(shared, begin, at_sorted)
        found[first] = np.minimum(found[first], self.since[to_sorted[first]])
        last = np.concatenate([to_sorted[1:] != to_sorted[:-1], [True]])
        self.since = np.minimum(self.since, low[-1])
        tail = np.minimum.accumulate(shared[::-1])[::-1]
        ends = at_sorted[last] + 1
        self.since[to_sorted[last]] = np.where(ends < len(shared), tail[np.minimum(ends, len(shared) - 1)], SHARED(cap))
        return np.minimum(found + SHARED(1), SHARED(cap))


def range_min(x: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """min(x[begin : end + 1]) for each pair."""
    power = np.frexp((end - begin + 1).astype(np.float64))[1] - 1
    out = np.empty(len(begin), x.dtype)
    level = x
    for p in range(int(power.max()) + 1 if len(power) else 0):
        mine = power == p
        if mine.any():
            out[mine] = np.minimum(level[begin[mine]], level[end[mine] - (1 << p) + 1])
        if len(level) > 1 << p:
            level = np.minimum(level[: -(1 << p)], level[1 << p :])
    return out


def s_types(text: np.ndarray) -> np.ndarray:
    """Which suffixes are of type S; the last one is of type L, as if a smaller character followed."""
    n = len(text)
    differs = np.concatenate([text[1:] != text[:-1], [True]])
    rises = np.concatenate([text[1:] > text[:-1], [False]])
    nearest = np.where(differs, np.arange(n), n)
    nearest = np.minimum.accumulate(nearest[::-1])[::-1]
    return rises[nearest]


def common(text: np.ndarray, a: np.ndarray, b: np.ndarray, cap: int) -> np.ndarray:
    """How many characters, at most cap, the suffixes at a and b share."""
    out = np.zeros(len(a), np.int64)
    live = np.arange(len(a))
    if len(a) > 1000:
        return common_blocks(text, a, b, cap)
    for k in range(cap):
        i, j = a[live] + k, b[live] + k
        inside = np.maximum(i, j) < len(text)
        live = live[inside]
        live = live[text[i[inside]] == text[j[inside]]]
        if not len(live):
            break
        out[live] += 1
    return out


def common_blocks(text: np.ndarray, a: np.ndarray, b: np.ndarray, cap: int) -> np.ndarray:
    """As common(), four characters of at most 16 bits at a time."""
    if int(text.max()) >= 1 << 16:
        width, words = 1, text
    else:
        width, padded = 4, np.concatenate([text, np.zeros(3, text.dtype)]).astype(np.uint64)
        words = padded[:-3] | padded[1:-2] << np.uint64(16) | padded[2:-1] << np.uint64(32) | padded[3:] << np.uint64(48)
    out = np.zeros(len(a), np.int64)
    live = np.arange(len(a))
    for k in range(0, cap, width):
        i, j = a[live] + k, b[live] + k
        inside = np.maximum(i, j) + width <= len(text)
        same = inside.copy()
        same[inside] = words[i[inside]] == words[j[inside]]
        stop = live[~same]
        if len(stop) and width > 1:  # the last few one by one
            for t in range(width):
                i, j = a[stop] + k + t, b[stop] + k + t
                ok = np.maximum(i, j) < len(text)
                ok[ok] = text[i[ok]] == text[j[ok]]
                stop = stop[ok]
                out[stop] += 1
        live = live[same]
        out[live] += width
        if not len(live):
            break
    return np.minimum(out, cap)


def induce(text: np.ndarray, alphabet: int, s: np.ndarray, lms: np.ndarray, shared: np.ndarray, cap: int, most: int, folder: str, emit: Callable[[np.ndarray, np.ndarray], None]) -> None:
    """All suffixes, from LMS suffixes in order and what those share with the one before. They are emitted in descending order, all of a
    first character at a time, each with what it shares with the one emitted before it (0 for the first of a character)."""
    n = len(text)
    none = np.zeros(0, AT), np.zeros(0, SHARED)
    heads = text[lms]
    cuts = np.searchsorted(heads, np.arange(alphabet + 1))
    queues, least = BucketQueues(alphabet, most, folder), Least(alphabet)
    ascending = BucketQueues(alphabet, most, folder)

    def sweep(at: np.ndarray, common_before: np.ndarray, want_s: bool, own: int) -> tuple[np.ndarray, np.ndarray]:
        """Pass over sorted suffixes; what they induce goes to the queues, or comes back if it is for the character of this very batch."""
        before = at - AT(1)
        ok = np.flatnonzero((before >= 0) & (s[before] == want_s))
        before = before[ok]
        to = text[before]
        order = by_character(to, alphabet)
        before, to = before[order], to[order]
        got = least.pass_over(common_before, ok[order], to, cap) if cap else np.zeros(len(to), SHARED)
        back = none
        if len(to):
            edges = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1], [True]])).tolist()
            for i, j in zip(edges[:-1], edges[1:]):
                if to[i] == own:
                    back = before[i:j], got[i:j]
                else:
                    queues.put(int(to[i]), before[i:j], got[i:j])
        return back

    def drain(c: int, want_s: bool) -> tuple[np.ndarray, np.ndarray]:
        """All of the queue of a character, with what it induces for itself."""
        at, common_before = queues.take(c)
        if len(at):
            common_before = common_before.copy()
            common_before[0] = 0  # the first of its character
        parts = [none]
        while len(at):
            parts.append((at, common_before))
            at, common_before = sweep(at, common_before, want_s, c)
        return np.concatenate([a for a, _ in parts]), np.concatenate([b for _, b in parts])

    # ascending: L suffixes from LMS ones. The end of the text, an empty suffix, comes first of all.
    queues.put(int(text[n - 1]), np.array([n - 1], AT), np.array([0], SHARED))
    least.since[text[n - 1]] = 0
    for c in range(alphabet):
        l_at, l_before = drain(c, False)
        if len(l_at):
            ascending.put(c, l_at, l_before)
        seed, seed_shared = lms[cuts[c] : cuts[c + 1]], shared[cuts[c] : cuts[c + 1]].copy()
        if len(seed):
            seed_shared[0] = common(text, l_at[-1:], seed[:1], cap)[0] if len(l_at) else 0
            sweep(seed, seed_shared, False, -1)
    # descending: S suffixes from all. Here an entry carries what it shares with the one after it.
    queues, least = BucketQueues(alphabet, most, folder), Least(alphabet)
    for c in range(alphabet - 1, -1, -1):
        s_at, s_after = drain(c, True)
        l_at, l_before = ascending.take(c)
        if len(l_at):
            seam = common(text, l_at[-1:], s_at[-1:], cap)[0] if len(s_at) else 0
            after = np.concatenate([np.array([seam], SHARED), l_before[1:][::-1]])
            sweep(l_at[::-1], after, True, -1)
            s_at, s_after = np.concatenate([s_at, l_at[::-1]]), np.concatenate([s_after, after])
        if len(s_at):
            emit(s_at, s_after)


def doubled(names: np.ndarray, depth: int) -> np.ndarray:
    """The suffixes of a string of numbers in the order of their first `depth` numbers, at least."""
    rank, step = names.astype(np.int64), 1
    while True:
        after = np.concatenate([rank[step:] + 1, np.zeros(min(step, len(rank)), np.int64)])[: len(rank)]
        key = rank * (int(rank.max()) + 2) + after
        order = np.argsort(key)  # which of equal ones comes first doesn't matter
        sorted_key = key[order]
        new = np.cumsum(np.concatenate([[0], (sorted_key[1:] != sorted_key[:-1]).astype(np.int64)]))
        rank = np.empty_like(rank)
        rank[order] = new
        step *= 2
        if new[-1] == len(rank) - 1 or step >= depth:
            return order


def sorted_suffixes(text: np.ndarray, cap: int, most: int, emit: Callable[[np.ndarray, np.ndarray], None], folder: str | None = None) -> None:
    """The suffixes of a string of small numbers in descending order of their first `cap` characters at least, emitted all of a first
    character at a time, with the number of characters, at most cap, that each shares with the one emitted before. About `most` queue
    entries are held in memory; the rest is in files, which are gone when this returns."""
    if folder is None:
        with tempfile.TemporaryDirectory(prefix="suffixes-") as made:
            return sorted_suffixes(text, cap, most, emit, made)
    if not len(text):
        return None
    alphabet = int(text.max()) + 1
    text = text.astype(np.uint16 if alphabet <= 1 << 16 else AT)
    s = s_types(text)
    lms = np.flatnonzero(s & np.concatenate([[False], ~s[:-1]])).astype(AT)
    shared = np.zeros(len(lms), SHARED)
    if len(lms):
        lms = sorted_lms(text, alphabet, s, lms, cap, most, folder)
        shared[1:] = common(text, lms[:-1], lms[1:], cap)
    return induce(text, alphabet, s, lms, shared, cap, most, folder, emit)


def suffix_array(text: np.ndarray, cap: int, most: int = 1 << 24, folder: str | None = None) -> tuple[np.ndarray, np.ndarray]:
    """All suffixes in ascending order, and what each shares with the one before."""
    parts: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, AT), np.zeros(0, SHARED))]
    sorted_suffixes(text, cap, most, lambda at, after: parts.append((at, after)), folder)
    order = np.concatenate([a for a, _ in parts])[::-1]
    after = np.concatenate([b for _, b in parts])[::-1]  # with the next one; 0 at the end of a character
    return order, np.concatenate([after[:0], np.zeros(min(1, len(after)), SHARED), after[:-1]])


def sorted_lms(text: np.ndarray, alphabet: int, s: np.ndarray, lms: np.ndarray, cap: int, most: int, folder: str) -> np.ndarray:
    # the pieces from one LMS place to the next, sorted by induction from LMS places in the order of their first character
    start = lms[by_character(text[lms], alphabet)]
    is_lms = np.zeros(len(text), bool)
    is_lms[lms] = True
    found: list[np.ndarray] = []
    induce(text, alphabet, s, start, np.zeros(len(start), SHARED), 0, most, folder, lambda at, _: found.append(at[is_lms[at]]))
    pieces = np.concatenate(found)[::-1]
    where = np.empty(len(text), AT)
    where[lms] = np.arange(len(lms), dtype=AT)
    ends = np.concatenate([lms[1:], [len(text) - 1]]) + 1
    size = ends - lms
    k = where[pieces]
    same = size[k[1:]] == size[k[:-1]]
    live = np.flatnonzero(same)
    at = 0
    a, b = pieces[:-1], pieces[1:]
    while len(live):  # one character of all undecided pairs at a time
        equal = text[a[live] + at] == text[b[live] + at]
        same[live[~equal]] = False
        live = live[equal]
        at += 1
        live = live[size[k[live]] > at]
    # the last piece ends with the text and equals no other
    last = where[lms[-1]]
    same &= (k[1:] != last) & (k[:-1] != last)
    names = np.empty(len(lms), AT)
    names[k] = np.cumsum(np.concatenate([[0], ~same]))
    distinct = int(names.max()) + 1
    if distinct == len(lms):
        return pieces
    # two characters at least lie between LMS places
    depth = cap // 2 + 2
    if len(names) > BASE:
        return lms[suffix_array(names, depth, most, folder)[0]]
    return lms[doubled(names, depth)]

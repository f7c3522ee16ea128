"""Plain versions of the operators, to test against."""

import hashlib
import zlib
from bisect import bisect_left, insort
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np


@lru_cache
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def ids(text):
    return tokenizer().encode(text or "", add_special_tokens=False).ids + [1]


def crc(x):
    return zlib.crc32(np.array(x, "<u4").tobytes())


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def substrings(docs, length=50):
    """docs: (doc_id, text). What each loses: {doc_id: (n_bytes, n_removed, n_spans, sha)}."""
    first = {}
    for doc_id, text in docs:
        raw = (text or "").encode()
        for i in range(len(raw) - length + 1):
            x = raw[i : i + length]
            first[x] = min(first.get(x, doc_id), doc_id)
    out = {}
    for doc_id, text in docs:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            if first[raw[i : i + length]] < doc_id:
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out[doc_id] = (len(raw), sum(gone), spans, sha(bytes(b for b, g in zip(raw, gone) if not g)))
    return out


def grams(text, n=5):
    words = (text or "").encode().split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1)))


def similar(docs, threshold=0.8, n=5):
    """(class of each doc_id, links of each doc_id, all linked pairs)."""
    sets = {d: grams(t, n) for d, t in docs}
    by = defaultdict(list)
    for d, s in sets.items():
        for g in s:
            by[g].append(d)
    shared = Counter()
    for ds in by.values():
        for i, a in enumerate(sorted(ds)):
            for b in sorted(ds)[i + 1 :]:
                shared[a, b] += 1
    pairs = {(a, b) for (a, b), k in shared.items() if k >= threshold * (len(sets[a]) + len(sets[b]) - k) - 1e-9}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    links = Counter(x for p in pairs for x in p)
    return {d: find(d) for d in sets}, {d: links[d] for d in sets}, pairs


def best_fit(left, patterns, capacity):
    """Put each length left, longest first, into the pattern with the least room for it, or else a new one. A pattern stands for
    all sequences of its kind: a length that goes into several of them splits off a new kind, so nothing is done per piece."""
    room: dict[int, Counter] = defaultdict(Counter)
    for p, n in patterns.items():
        room[capacity - sum(a * b for a, b in p)][p] += n
    rooms = sorted(room)
    for length in sorted(left, reverse=True):
        todo = left[length]
        while todo:
            k = bisect_left(rooms, length)
            if k < len(rooms):
                free = rooms[k]
                p, n = next(iter(room[free].items()))
                del room[free][p]
                if not room[free]:
                    del room[free]
                    rooms.pop(k)
            else:
                p, n, free = (), todo, capacity
            fit = free // length
            full = min(n, todo // fit)  # sequences that take as many as fit; one more may take the rest
            rest = todo % fit if full < n else 0
            for times, each in ((full, fit), (1 if rest else 0, rest), (n - full - (1 if rest else 0) if p else 0, 0)):
                if times:
                    q = dict(p)
                    if each:
                        q[length] = q.get(length, 0) + each
                    still = free - each * length
                    if still not in room:
                        insort(rooms, still)
                    room[still][tuple(sorted(q.items()))] += times
                    todo -= times * each
    out: Counter = Counter()
    for kinds in room.values():
        out.update(kinds)
    return dict(out)

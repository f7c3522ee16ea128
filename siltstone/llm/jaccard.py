"""N-gram Jaccard join by MinHash banding.

Texts become sets of word n-grams. Equal sets are one node, known by its fingerprint. MinHash signatures are cut into bands; their
number is chosen from the rows of a band so that a pair at the threshold meets in some band with the target recall. Nodes that share a
band hash are candidates, and chains of candidates form clusters. Candidates are verified on the full n-gram sets, by counting shared
n-grams in blocks: only counts of links and spanning links leave a block, never its pairs. Where that takes fewer pairs, a cluster is
verified as a whole; else band by band, each pair in the first band that it shares, so that a long chain of chance candidates costs no
more than its bands. Either way every pair that meets in a band is verified once.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import drop, join_with_hot, map_arrow, materialize, release, remember, slices, tasks
from .components import components
from .token_store import texts_of

WORDS, THRESHOLD, ROWS, RECALL = 5, 0.8, 6, 0.9998
#: Clusters and bands larger than this are verified in blocks of so many nodes, or in the mean so many n-grams where texts are long.
BLOCK, GRAMS = 384, 1 << 19


def bands_for(threshold: float, rows: int, recall: float) -> int:
    """The least number of bands with which a pair at the threshold meets with this probability: 1 - (1 - t^rows)^bands."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))


def word_hash(w: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little")


def word_hashes(words: list[bytes], most: int = 300_000) -> np.ndarray:
    known = remember("word hashes", dict)
    if len(known) > most:
        known.clear()
    for w in set(words):
        if w not in known:
            known[w] = word_hash(w)
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def ngrams(text: bytes, n: int = WORDS) -> np.ndarray:
    """The sorted 64-bit hashes of the text's word n-grams. A text of fewer words has one n-gram, of all of them; one of no words has none."""
    words = text.split()
    if not words:
        return np.zeros(0, np.uint64)
    h = word_hashes(words)
    m = max(1, len(h) - n + 1)
    out = np.full(m, len(words) if len(words) < n else n, np.uint64)
    for k in range(min(n, len(h))):
        out = (out ^ h[k : k + m]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return np.unique(out)


def seeds(count: int) -> np.ndarray:
    rng = np.random.default_rng(11)
    return rng.integers(1, 1 << 63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signature(grams: np.ndarray, mult: np.ndarray, rows: int) -> np.ndarray:
    """One hash for each band."""
    low = np.full(len(mult), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(grams), 512):  # pieces that stay in the processor's cache
        part = grams[at : at + 512]
        made = mult[:, None] * part
        made ^= part >> np.uint64(31)
        np.minimum(low, made.min(1), out=low)
    out = np.full(len(mult) // rows, 7, np.uint64)
    for k in range(rows):
        out = (out ^ low[k::rows]) * np.uint64(0xC2B2AE3D27D4EB4F)
        out ^= out >> np.uint64(32)
    return out.view(np.int64)


def signatures(docs: DataFrame, n: int, rows: int, bands: int) -> DataFrame:
    """(doc_id, print, size, bands): fingerprint of the n-gram set, its size, and the hash of each band. Texts without words are left out."""
    mult = seeds(rows * bands)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                ids, prints, sizes, hashes = [], [], [], []
                for doc_id, text in zip(batch.column(0).to_pylist(), texts_of(batch), strict=True):
                    grams = ngrams(text, n)
                    if len(grams):
                        ids.append(doc_id)
                        prints.append(hashlib.blake2b(grams.tobytes(), digest_size=16).digest())
                        sizes.append(len(grams))
                        hashes.append(signature(grams, mult, rows))
                flat = pa.array(np.concatenate(hashes) if hashes else np.zeros(0, np.int64))
                ends = pa.array(np.arange(len(ids) + 1, dtype=np.int32) * bands)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(prints, pa.binary()), pa.array(sizes, pa.int32()), pa.ListArray.from_arrays(ends, flat)], names=["doc_id", "print", "size", "bands"])

    return map_arrow(docs.select("doc_id", "text").filter("doc_id is not null"), run, "doc_id long, print binary, size int, bands array<long>")


def verify(sets: list[np.ndarray], threshold: float, split: int | None = None) -> np.ndarray:
    """Which pairs of sets reach the threshold, as a matrix; with `split`, only pairs of one before it and one from it on."""
    m = len(sets)
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    _, gram, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = counts[gram] > 1  # an n-gram of one text is in no intersection
    owner, gram = owner[shared], np.unique(gram[shared], return_inverse=True)[1]
    order = np.argsort(gram, kind="stable")
    owner, gram = owner[order], gram[order]
    both = np.zeros((m, m), np.float32)
    columns = max(64, (1 << 22) // max(m, 1))
    for at in range(0, int(gram[-1]) + 1 if len(gram) else 0, columns):
        i, j = np.searchsorted(gram, [at, at + columns])
        part = np.zeros((m, columns), np.float32)
        part[owner[i:j], gram[i:j] - at] = 1
        both += part @ part.T
    sizes = np.array([len(s) for s in sets], np.float64)
    linked = both >= threshold * (sizes[:, None] + sizes - both) - 1e-9
    np.fill_diagonal(linked, False)
    if split is not None:
        linked[:split, :split] = linked[split:, split:] = False
    return linked


def near_duplicates(docs: DataFrame, n: int = WORDS, threshold: float = THRESHOLD, rows: int = ROWS, recall: float = RECALL) -> DataFrame:
    """(doc_id, class_id, n_links): for each row of docs the smallest doc_id of its class, and the number of other documents
    whose n-gram set is similar to its own (Jaccard at least `threshold`). A class is what such links connect.

    Null texts and texts without words have no n-grams: they are classes of their own. Rows that share a doc_id are one document
    and so share a class; if their texts differ, links of all of them count. Rows with a null doc_id have a null class_id and no
    links. An empty table gives no rows.
    """
    spark = docs.sparkSession
    found, found_at = materialize(signatures(docs, n, rows, bands_for(threshold, rows, recall)), "signatures")
    # equal sets: one node, found in the document with the smallest doc_id
    members, members_at = materialize(found.select("doc_id", "print", "size").distinct(), "members")
    nodes, _ = materialize(members.groupBy("print").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies"), F.max("size").alias("grams")), "nodes")
    signed = found.join(nodes.select("print", F.col("first").alias("doc_id")).hint("merge"), ["print", "doc_id"]).dropDuplicates(["print", "doc_id"])
    hashes, hashes_at = materialize(signed.select("print", "size", F.posexplode("bands").alias("band", "hash")), "hashes")
    # candidates: nodes of one band hash hang on its smallest
    blocks = lambda n, grams: F.greatest(F.ceil(n / F.lit(float(BLOCK))), F.ceil(grams / F.lit(float(GRAMS)))).alias("blocks")
    heads = hashes.groupBy("band", "hash").agg(F.min("print").alias("head"), F.count("*").alias("m"), blocks(F.count("*"), F.sum("size"))).filter("m > 1")
    heads, heads_at = materialize(heads, "heads")
    near, near_at = materialize(hashes.drop("size").join(heads.hint("merge"), ["band", "hash"]), "near")
    drop(spark, hashes_at)
    clusters, clusters_at = materialize(components(near.filter("print <> head").select(F.col("print").alias("a"), F.col("head").alias("b"))), "clusters")
    # the pairs of a cluster as a whole, and those of its bands
    sized = clusters.join(nodes.select(F.col("print").alias("node"), "grams").hint("merge"), "node")
    whole = sized.groupBy("root").agg(F.count("*").alias("size"), blocks(F.count("*"), F.sum("grams")))
    banded = heads.join(clusters.select(F.col("node").alias("head"), "root").hint("merge"), "head").groupBy("root").agg(F.sum(F.col("m").cast("double") * F.col("m")).alias("pairs"))
    plan = whole.join(banded.hint("merge"), "root").select("root", "size", "blocks", ((F.col("size") <= BLOCK) | (F.col("size").cast("double") * F.col("size") <= F.col("pairs"))).alias("at_once"))
    plan, plan_at = materialize(plan, "plan")
    placed = join_with_hot(clusters, plan, "root", clusters.count(), "size").select(F.col("node").alias("print"), "root", "blocks", "at_once")
    placed, placed_at = materialize(placed, "placed")
    drop(spark, clusters_at, heads_at, plan_at)
    once = placed.filter("at_once").select("print", "root", F.lit(-1).alias("band"), F.lit(0).cast("long").alias("hash"), "blocks")
    each = near.join(placed.filter("not at_once").select("print", "root").hint("merge"), "print").select("print", "root", "band", "hash", "blocks")
    # in blocks, and each pair of blocks as one unit
    dealt = once.unionAll(each).withColumn("block", F.pmod(F.xxhash64("print"), F.col("blocks")))
    units = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    unit = ["root", "band", "hash", "i", "j"]
    units = units.select("print", "root", "band", "hash", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), (F.col("block") > F.col("other")).alias("second"))
    wanted = placed.select("print").join(nodes.drop("grams").hint("merge"), "print").select(F.col("first").alias("doc_id"), F.col("print").alias("wanted"), "copies")
    texts = docs.select("doc_id", "text").join(wanted.hint("merge"), "doc_id")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for batch in slices(big, "text"):
                made = [ngrams(x, n).tobytes() for x in texts_of(batch)]
                # a doc_id may have several texts: this is the one with that fingerprint
                keep = np.flatnonzero([hashlib.blake2b(x, digest_size=16).digest() == p for x, p in zip(made, batch.column(2).to_pylist())])
                yield pa.RecordBatch.from_arrays([batch.column(2).take(pa.array(keep)), batch.column(3).take(pa.array(keep)), pa.array([made[k] for k in keep], pa.binary())], names=["print", "copies", "grams"])

    grams = map_arrow(texts, sets, "print binary, copies long, grams binary").dropDuplicates(["print"])
    signs = signed.select("print", "bands").join(placed.filter("not at_once").select("print").hint("merge"), "print")
    grams, grams_at = materialize(grams.join(signs.hint("merge"), "print", "left"), "grams")
    release(spark)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def verified(rows: list[dict]) -> pa.RecordBatch:
            rows.sort(key=lambda r: (r["second"], r["print"]))
            split = sum(not r["second"] for r in rows) if rows[0]["i"] != rows[0]["j"] else None
            linked = verify([np.frombuffer(r["grams"], np.uint64) for r in rows], threshold, split)
            if (band := rows[0]["band"]) > 0:
                signs = np.array([r["bands"][:band] for r in rows], np.int64)
                a, b = np.nonzero(linked)
                for at in range(0, len(a), 1 << 16):
                    i, j = a[at : at + (1 << 16)], b[at : at + (1 << 16)]
                    met = (signs[i] == signs[j]).any(1)  # in a band before
                    linked[i[met], j[met]] = False
            links = linked @ np.array([r["copies"] for r in rows], np.int64)
            prints = [r["print"] for r in rows]
            up = spanning(linked, np.argsort(np.argsort(np.array(prints, "S16"))))
            return pa.RecordBatch.from_arrays([pa.array(prints, pa.binary()), pa.array(links.astype(np.int64)), pa.array([sorted(prints)[k] for k in up], pa.binary())], names=["print", "links", "up"])

        key, rows = None, []
        for batch in batches:
            for row in batch.to_pylist():
                now = tuple(row[c] for c in unit)
                if now != key and rows:
                    yield verified(rows)
                    rows = []
                key = now
                rows.append(row)
        if rows:
            yield verified(rows)

    spread = units.join(grams.hint("merge"), "print").repartition(tasks(spark) * 2, *unit).sortWithinPartitions(*unit)
    checked, checked_at = materialize(map_arrow(spread, check, "print binary, links long, up binary"), "checked")
    drop(spark, grams_at, near_at, placed_at)
    classes, classes_at = materialize(components(checked.select(F.col("print").alias("a"), F.col("up").alias("b"))), "linked")
    first = classes.select(F.col("node").alias("print"), "root").join(nodes.select("print", "first").hint("merge"), "print")
    lowest, lowest_at = materialize(first.groupBy("root").agg(F.min("first").alias("class_id"), F.count("*").alias("size")), "lowest")
    named = join_with_hot(first, lowest, "root", classes.count(), "size").select("print", "class_id")
    links = checked.groupBy("print").agg(F.sum("links").alias("links"))
    of_node = nodes.join(links.hint("merge"), "print", "left").join(named.hint("merge"), "print", "left")
    of_node = of_node.select("print", "copies", F.coalesce("class_id", "first").alias("class_id"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links"))
    of_node, of_node_at = materialize(of_node, "of_node")
    of_doc = join_with_hot(members.drop("size"), of_node, "print", members.count(), "copies").groupBy("doc_id").agg(F.min("class_id").alias("class_id"), F.sum("links").alias("n_links"))
    of_doc, _ = materialize(of_doc.withColumnRenamed("doc_id", "doc"), "classes")
    drop(spark, checked_at, classes_at, members_at, found_at, of_node_at, lowest_at)
    result = docs.select("doc_id").join(of_doc.hint("merge"), F.col("doc_id") == F.col("doc"), "left")
    return result.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))


def spanning(linked: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each row of a symmetric matrix the smallest id that it is connected to, itself included."""
    low = ids.copy()
    left = np.ones(len(ids), bool)
    for start in np.argsort(ids):
        if left[start]:
            seen, edge = np.zeros(len(ids), bool), [start]
            seen[start] = True
            while edge:
                reach = linked[edge].any(0) & ~seen
                seen |= reach
                edge = np.flatnonzero(reach).tolist()
            low[seen] = ids[start]
            left &= ~seen
    return low


def dedup_near(docs: DataFrame, **parameters) -> DataFrame:
    """One document of each class of near_duplicates(): the one with the smallest doc_id. Rows with a null doc_id stay. Of rows that
    share a doc_id all stay or go together."""
    heads = near_duplicates(docs, **parameters).filter("class_id <> doc_id").select("doc_id").distinct()
    return docs.join(heads.hint("merge"), "doc_id", "left_anti")

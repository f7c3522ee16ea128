"""Mixing sources to target weights, by DataFrame functions only.

Tokens are aggregated per source, each source gets a repetition rate, and each document is emitted floor(rate) times plus
one more time with probability frac(rate), drawn from a hash of its doc_id and a seed. A draw has DRAWS seeds to choose from, and a
source uses the one whose total comes nearest to its target: the totals of all of them are summed in one pass over ids and sizes. A
draw depends on nothing else, so reruns and retried tasks agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import drop, materialize, n_words, seal

#: Below this number of sources their table is broadcast (about 100 bytes a row); beyond it, it is joined by shuffle.
MAX_BROADCAST_SOURCES = 50_000
#: Seeds that a source may choose from. Each is a place in the digest of a document, 52 bits from there on.
DRAWS = 20


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, target) for a frame of (source, size).

    Sources in code point order, null last, take the weights in turn and share `share` times all sizes. A target stops at
    `most` times its source's size, and the excess goes to the others by weight until none is above: that is the water level
    L at which the sum of least(most * size, L * weight) is the total, found from running sums over the sources in the order
    in which they fill up. A source of size 0 gets 0. If share > most, every target is `most` times its size.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())  # over one row a source
    k = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (k + 1).cast("int"))
    fills = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = fills.rowsBetween(Window.unboundedPreceding, -1)
    after = fills.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    levels = (
        by_source.withColumn("weight", weight)
        .withColumn("cap", F.lit(float(most)) * F.col("source_size"))
        .withColumn("level", (F.lit(float(share)) * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after))
        # rises with every source that fills up, and falls from the first one that does not
        .withColumn("water", F.max("level").over(everything))
    )
    return levels.select("source", "source_size", F.least("cap", F.col("water") * F.col("weight")).alias("target"))


def digest(doc_id: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))))


def draw(digest: Column, k: Column) -> Column:
    """The k-th number in [0, 1) with 52 bits of a document's digest, for k from 0 to DRAWS - 1."""
    return F.conv(F.substring(digest, k + 1, F.lit(13)), 16, 10).cast("long") / F.lit(float(1 << 52))


def joined(docs: DataFrame, found: DataFrame) -> DataFrame:
    """docs with the row of its source; found: (mix_source, ...), one row a source."""
    found = F.broadcast(found) if found.count() <= MAX_BROADCAST_SOURCES else found
    return docs.join(found, docs["source"].eqNullSafe(found["mix_source"])).drop("mix_source")


def source_draws(sizes: DataFrame, targets: DataFrame, seed: int) -> DataFrame:
    """(mix_source, source_size, target, rate, k): targets with each source's rate and the draw whose total of sizes is nearest to its
    target (ties: the first). sizes: (doc_id, source, size); targets: as of source_targets()."""
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rated = targets.select(F.col("source").alias("mix_source"), "source_size", "target", rate.alias("rate"))
    drawn = joined(sizes, rated).withColumn("h", digest(F.col("doc_id"), seed)).withColumn("fraction", F.col("rate") - F.floor("rate"))
    more = [F.sum(F.when(draw(F.col("h"), F.lit(k)) < F.col("fraction"), F.col("size")).otherwise(0)).alias(f"more{k}") for k in range(DRAWS)]
    totals = drawn.groupBy("source").agg(F.first("target").alias("target"), F.first("source_size").alias("n"), F.first(F.floor("rate")).alias("whole"), *more)
    off = [F.struct(F.abs((F.col("n") * F.col("whole") + F.col(f"more{k}")).cast("double") - F.col("target")).alias("off"), F.lit(k).alias("k")) for k in range(DRAWS)]
    best = totals.select("source", F.array_min(F.array(*off))["k"].alias("k"))
    return rated.join(best, F.col("mix_source").eqNullSafe(F.col("source"))).drop("source")


def mix_plan(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 7) -> DataFrame:
    """docs with _size (words), _source_size, _target, _rate and _copies; columns of docs of those names are replaced.

    Null texts have size 0. Null sources are one source, the last. Rows that share a doc_id share their draw, also if
    repeated. An empty table gives no rows. A source's words come near its target as far as its documents allow: the least of DRAWS
    totals, each a target plus independent draws, so about a twentieth of the deviation of one; a source of a few very long documents
    can miss by a part of one of them.
    """
    spark = docs.sparkSession
    docs, open_ = seal(docs.drop("_size", "_source_size", "_target", "_rate", "_copies"), "doc_id", "text", "source")
    sizes, sizes_at = materialize(docs.select("doc_id", "source", n_words(F.col("text")).alias("size")), "sizes")
    targets, targets_at = materialize(source_targets(sizes, weights, share, most), "targets")
    found, _ = materialize(source_draws(sizes, targets, seed), "sources")
    drop(spark, sizes_at, targets_at)
    once = F.when(draw(digest(F.col("doc_id"), seed), F.col("k")) < F.col("rate") - F.floor("rate"), 1).otherwise(0)
    return open_(
        joined(docs, found),
        _size=n_words(F.col("text")), _source_size=F.col("source_size"), _target=F.col("target"), _rate=F.col("rate"), _copies=(F.floor("rate") + once).cast("long"),
    )


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 7) -> DataFrame:
    """The mixture: each document of docs as often as mix_plan has it, with the columns of docs. Repeated rows are each as often."""
    sealed, open_ = seal(docs, "doc_id", "text", "source")
    plan = mix_plan(sealed, weights, share, most, seed).filter("_copies > 0")
    return open_(plan.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies")))))

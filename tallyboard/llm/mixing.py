"""Mixing sources to target weights by a time-varying curriculum, with DataFrame functions only.

Targets: sources share `share` times all words by weight; a target stops at `most` times its source's
words and the excess goes to the others by weight, until none is above (water filling, solved in
closed form over the sources sorted by cap / weight).

Order: each source's documents stand in a fixed pseudo-random order (md5 of the id) with a running
word count. Pass p over the source starts a document at p * source_size + words before it; the
document is taken in that pass while its middle lies within the target, so a source's taken words
miss the target by half a document at most. A running count over a source that holds a third of all
rows is split: ranges of the order form blocks, block sums are added up, and a window runs inside a
block only.

Position: a source's weight over training time is piecewise linear; its integral, scaled to the
target, is the source's cumulative demand, and inverting it at a document's start gives the time in
[0, 1] at which training reaches it. Rows are range-sorted by position.

Cases: null text has size 0; null sources form one source, ordered last; empty and zero-sized sources
have target 0; repeated rows count each; an empty table gives an empty result. A very long text is one
document of its size: taken or not as a whole, so its source may miss the target by half of it. Sources are
water-filled in one task, so there should be thousands of them at most. Only id, source and text are read,
so other columns' names never clash.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyboard.llm.common import saved, text_digest, word_count

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
#: Documents in a block of a source's order, about.
BLOCK = 2_000
#: Weight over training time as (time, factor) knots, for sources by rank in turn; each averages 1.
SCHEDULES = (((0.0, 0.5), (1.0, 1.5)), ((0.0, 1.5), (1.0, 0.5)), ((0.0, 0.5), (0.5, 1.5), (1.0, 0.5)))


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, rank, weight, n_docs, source_size, target) from rows (source, size)."""
    totals = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("size").alias("source_size"))
    by_name, whole = Window.orderBy(F.col("source").asc_nulls_last()), Window.partitionBy()
    ranked = totals.withColumn("rank", F.row_number().over(by_name) - 1)
    listed = F.array(*[F.lit(float(w)) for w in weights])
    ranked = ranked.withColumn("weight", F.get(listed, F.col("rank") % len(weights))).withColumn("cap", (most * F.col("source_size")).cast("double"))
    filled = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    earlier = filled.rowsBetween(Window.unboundedPreceding, -1)
    later = filled.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    budget = share * F.sum("source_size").over(whole)
    level = (budget - F.coalesce(F.sum("cap").over(earlier), F.lit(0.0))) / F.sum("weight").over(later)
    ranked = ranked.withColumn("level", level)
    target = F.least(F.col("cap"), F.max("level").over(whole) * F.col("weight"))
    return ranked.select("source", "rank", "weight", "n_docs", "source_size", target.alias("target"))


def time_at(part: Column, knots: Sequence[tuple[float, float]]) -> Column:
    """Time at which the integral of a piecewise linear weight has reached `part` of the whole."""
    pieces, total = [], sum((t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(knots, knots[1:]))
    done, out = 0.0, None
    for (t0, w0), (t1, w1) in zip(knots, knots[1:]):
        area = (t1 - t0) * (w0 + w1) / 2
        left = part * total - done
        slope = (w1 - w0) / (t1 - t0)
        root = w0 + F.sqrt(F.greatest(F.lit(0.0), w0 * w0 + 2 * slope * left))
        pieces.append((done / total, F.lit(t0) + F.when(root > 0, 2 * left / root).otherwise(F.lit(0.0))))
        done += area
    for start, time in pieces:
        out = time if out is None else F.when(part >= start, time).otherwise(out)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), out))


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: int = MOST, schedules: Sequence[Sequence[tuple[float, float]]] = SCHEDULES, block: int = BLOCK) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken, repeats, start, times, place, digest.

    repeats is how often the mix takes the document, start the words of its source before it, times an
    array with its training time in each pass.
    """
    return _mixed(_sizes(docs, id_col, source_col, text_col), weights, share, most, schedules, block)


def _sizes(docs: DataFrame, id_col: str, source_col: str, text_col: str) -> DataFrame:
    order = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    return saved(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), order.alias("place"), text_digest(F.col(text_col)).alias("digest")), "sizes")


def _mixed(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: int = MOST, schedules: Sequence[Sequence[tuple[float, float]]] = SCHEDULES, block: int = BLOCK) -> DataFrame:
    targets = saved(source_targets(sizes, weights, share, most), "targets").withColumnRenamed("source", "of")
    head = F.conv(F.substring("place", 1, 8), 16, 10).cast("long")
    blocks = F.greatest(F.lit(1), F.ceil(F.col("n_docs") / block)).cast("long")
    rows = sizes.join(targets, F.col("source").eqNullSafe(F.col("of"))).withColumn("block", F.shiftrightunsigned(head * blocks, 32))
    sums = rows.groupBy("rank", "block").agg(F.sum("size").alias("block_size"))
    before = Window.partitionBy("rank").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("rank", "block", F.coalesce(F.sum("block_size").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("rank", "block").orderBy("place", "doc_id", "size", "digest").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(offsets, ["rank", "block"])
    placed = placed.withColumn("start", F.col("offset") + F.col("inside"))
    fits = F.floor((F.col("target") - F.col("start") - F.col("size") / 2) / F.col("source_size")) + 1
    repeats = F.when(F.col("source_size") > 0, F.greatest(F.lit(0), F.least(F.lit(most), fits))).otherwise(F.lit(0)).cast("int")
    placed = placed.withColumn("repeats", repeats)
    passes = F.when(F.col("repeats") > 0, F.sequence(F.lit(0), F.col("repeats") - 1)).otherwise(F.array().cast("array<int>"))

    def time(p: Column) -> Column:
        part = (p * F.col("source_size") + F.col("start")) / F.col("target")
        out = None
        for i, knots in enumerate(schedules):
            t = time_at(part, knots)
            out = t if out is None else F.when(F.col("rank") % len(schedules) == i, t).otherwise(out)
        return out

    return placed.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * F.col("repeats")).alias("taken"), "repeats", "start", F.transform(passes, time).alias("times"), "place", "digest")


def curriculum(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **options) -> DataFrame:
    """docs in training order: each row as often as the mix takes it, range-sorted by its times.

    Each row has its own times, also where ids repeat: rows are told apart by id, source and text, and
    rows that are equal in these are numbered.
    """
    sizes = _sizes(docs, id_col, source_col, text_col)
    mixed = _mixed(sizes, **options).withColumn("number", F.lit(1))
    found = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_mix_row"), text_digest(docs[text_col]).alias("_mix_text"), F.lit(1).alias("_mix_number"))
    own = F.col("_mix_row")[id_col], F.col("_mix_row")[source_col], F.col("_mix_text")
    if not sizes.groupBy("doc_id", "source", "digest").count().filter("count > 1").isEmpty():
        mixed = mixed.withColumn("number", F.row_number().over(Window.partitionBy("doc_id", "source", "digest").orderBy("start")))
        found = found.withColumn("_mix_number", F.row_number().over(Window.partitionBy(*own).orderBy("_mix_text")))
    plan = mixed.filter("repeats > 0").select(F.col("doc_id").alias("_mix_id"), F.col("source").alias("_mix_source"), F.col("digest").alias("_mix_digest"), F.col("number").alias("_mix_nth"), F.explode("times").alias("_mix_time"))
    same = own[0].eqNullSafe(F.col("_mix_id")) & own[1].eqNullSafe(F.col("_mix_source")) & (own[2] == F.col("_mix_digest")) & (F.col("_mix_number") == F.col("_mix_nth"))
    ordered = found.join(plan, same).repartitionByRange(F.col("_mix_time")).sortWithinPartitions("_mix_time", "_mix_id")
    return ordered.select(*[F.col("_mix_row")[c].alias(c) for c in docs.columns])

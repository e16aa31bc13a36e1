"""Lanes of a tick meet: which row of an item stays, what the merged lists hold and what calls may enrich."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyboard import config as C
from tallyboard.operators import scoring, windows

#: Calls of a run that may enrich listings, by lane.
ENRICH_CALLS = {"sweep": 50, "auction": 12, "hunt": 2}


def merge(*lanes: DataFrame, order: list[str] | None = None) -> DataFrame:
    """One row per item over all lanes, with lane_ord: the first lane that has the item wins, in it the first by order, then id.

    Columns that a lane lacks are null. Partial aggregation finds the winners, so a common item costs a row per task.
    """
    rows = lanes[0].withColumn("lane_ord", F.lit(0))
    for i, lane in enumerate(lanes[1:], 1):
        rows = rows.unionByName(lane.withColumn("lane_ord", F.lit(i)), allowMissingColumns=True)
    return windows.first_wins(rows, ["item_id"], [F.col("lane_ord"), *[F.col(c) for c in order or ()], F.col("id")])


def unseen(hits: DataFrame, *taken: DataFrame) -> DataFrame:
    """Hits of per-key searches whose item no other lane took; the first key (key_ord), then place (pos), keeps an item."""
    for other in taken:
        hits = hits.join(other.select("item_id").distinct(), "item_id", "left_anti")
    return windows.first_wins(hits, ["item_id"], [F.col("key_ord"), F.col("pos"), F.col("key")])


def within_entry(hits: DataFrame) -> DataFrame:
    """Search results of hunt entries: each entry has an item once, from its first query (query_ord), then place (pos)."""
    return windows.first_wins(hits, ["hunt_id", "item_id"], [F.col("query_ord"), F.col("pos")])


def permalinks(deals: DataFrame, hunt: DataFrame) -> DataFrame:
    """Rows that have a page of their own: all deals and the priced hunt hits."""
    return deals.unionByName(hunt.filter(~F.coalesce(F.col("no_book"), F.lit(False))), allowMissingColumns=True)


def enrichable(rows: DataFrame, lane: str, order: list[Column], conf: C.Config) -> DataFrame:
    """The rows that this run's calls can enrich: the first that are not enriched yet, in order."""
    return windows.top(rows.filter(~F.coalesce(F.col("enriched"), F.lit(False))), order, ENRICH_CALLS[lane] * conf.batch)


def per_key_funnel(hits: DataFrame) -> DataFrame:
    """One row: keys asked, listings read, deals surfaced and calls kept, from hits (key, item_id, gate_reason, auction).

    A key that brought nothing has one row without item.
    """
    passed = F.col("item_id").isNotNull() & F.col("gate_reason").isNull()
    return hits.agg(
        F.count_distinct("key").alias("keys"), F.count("item_id").alias("listings"),
        F.count_if(passed & ~F.col("auction")).alias("surfaced"), F.count_if(passed & F.col("auction")).alias("closing"),
    )


def entry_funnel(hits: DataFrame) -> DataFrame:
    """(hunt_id, listings, priced, no_book, cut) from judged hits (hunt_id, item_id, no_book, gate_reason)."""
    passed = F.col("gate_reason").isNull()
    return hits.groupBy("hunt_id").agg(
        F.count(F.lit(1)).alias("listings"), F.count_if(passed & ~F.col("no_book")).alias("priced"),
        F.count_if(passed & F.col("no_book")).alias("no_book"), F.count_if(~passed).alias("cut"),
    )


def tier_split(rows: DataFrame, conf: C.Config) -> DataFrame:
    """rows with tier: the one they were published with, else the rule's."""
    verified = scoring.cert_verified(F.col("risk_reasons"))
    rule = scoring.tier(F.col("depth"), F.col("conf"), F.col("n"), F.col("n12"), F.col("risk_grade"), verified, F.coalesce(F.col("ladder"), F.lit(False)), conf)
    return rows.withColumn("tier", F.coalesce(F.col("tier"), rule))

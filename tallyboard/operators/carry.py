"""State across ticks: carried deals, calls and hunt hits, and the first-write-wins ledger of receipts.

Live reads come as (item_id, checked, price, shipping_cost, title, ends_at, bid_count, seller_score):
a checked item without price is gone, an unchecked one unverified - absence is never inferred from a
read that failed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyboard import config as C
from tallyboard.functions.text import millis
from tallyboard.operators import gates, ranks, scoring


def candidates(prior: DataFrame, fresh: DataFrame) -> DataFrame:
    """Prior rows whose item the new tick doesn't have."""
    return prior.join(fresh.select("item_id").distinct(), "item_id", "left_anti")


def inherit_first_surfaced(fresh: DataFrame, prior: DataFrame) -> DataFrame:
    """fresh with the prior tick's surfaced_at where the item was there already."""
    was = prior.groupBy(F.col("item_id").alias("_item")).agg(F.min("surfaced_at").alias("_was"))
    return fresh.join(was, F.col("item_id") == F.col("_item"), "left").withColumn("surfaced_at", F.coalesce("_was", "surfaced_at")).drop("_item", "_was")


def verify_order(rows: DataFrame, order: list[Column], conf: C.Config) -> DataFrame:
    """The rows that this tick's calls can verify, in order."""
    return rows.orderBy(*order).limit(conf.carry_calls * conf.batch)


def _live(reads: DataFrame) -> DataFrame:
    return reads.select(*[F.col(c).alias(f"_{c}") for c in ("item_id", "checked", "price", "shipping_cost", "title", "ends_at", "bid_count", "seller_score")])


def _joined(rows: DataFrame, reads: DataFrame) -> DataFrame:
    out = rows.join(_live(reads), F.col("item_id") == F.col("_item_id"), "left")
    state = F.when(~F.coalesce(F.col("_checked"), F.lit(False)), "unverified").when(F.col("_price").isNull(), "absent").otherwise("alive")
    return out.withColumn("_state", state).withColumn("_cost", scoring.all_in("_price", "_shipping_cost"))


def _dropped(out: DataFrame) -> DataFrame:
    return out.drop(*[c for c in out.columns if c.startswith("_")])


def carry_deals(prior: DataFrame, fresh: DataFrame, reads: DataFrame, conf: C.Config) -> DataFrame:
    """Prior deals that the new tick lacks, with fate: ended, as-was, refreshed, re-gated or dropped.

    A price at or below the prior one is kept without asking the gate again; a raise must pass it
    against the frozen book call, read with the live title. Dropped is not ended.
    """
    rows = _joined(candidates(prior, fresh), reads)
    cost = F.col("_cost")
    ladder = F.coalesce(F.col("ladder"), F.lit(False))
    reason = gates.gate(cost, F.col("med"), millis(F.col("last_sale")), scoring.has_condition_flag(F.col("_title")), F.col("conf") == "thin", conf, ladder)
    fate = (
        F.when(F.col("_state") == "absent", "ended")
        .when(F.col("_state") == "unverified", "as-was")
        .when(cost <= F.col("all_in"), "refreshed")
        .when(reason.isNull(), "re-gated")
        .otherwise("dropped")
    )
    rows = rows.withColumn("fate", fate)
    new = F.col("fate").isin("refreshed", "re-gated")
    deep = scoring.depth(cost, F.col("med"))
    evidence = scoring.evidence_weight(millis(F.col("last_sale")), F.col("n12"), conf.now_ms)
    ranked = scoring.rank(F.col("med") - cost, deep, F.col("conf"), F.col("risk_grade"), evidence, scoring.fresh_boost(millis(F.col("listed_at")), conf))
    changed = {"price": F.col("_price"), "shipping_cost": F.col("_shipping_cost"), "all_in": cost, "depth": deep, "edge": F.col("med") - cost, "rank": ranked}
    return _dropped(rows.withColumns({c: F.when(new, x).otherwise(F.col(c)) for c, x in changed.items()}))


def carry_closing(prior: DataFrame, fresh: DataFrame, fresh_closing: DataFrame, reads: DataFrame, conf: C.Config) -> DataFrame:
    """Prior auction calls that have not ended, refreshed; fate as-was, refreshed or dropped."""
    still = prior.filter(millis(F.col("ends_at")) > conf.now_ms)
    rows = _joined(candidates(candidates(still, fresh), fresh_closing), reads)
    cost = F.col("_cost")
    reason = gates.closing_gate(cost, millis(F.col("_ends_at")), F.col("med"), millis(F.col("last_sale")), F.col("conf") == "thin", F.col("_seller_score"), scoring.has_condition_flag(F.col("_title")), conf, conf.goldmine_window_ms)
    rows = rows.withColumn("fate", F.when(F.col("_state") == "unverified", "as-was").when((F.col("_state") == "absent") | reason.isNotNull(), "dropped").otherwise("refreshed"))
    new = F.col("fate") == "refreshed"
    changed = {"price": F.col("_price"), "shipping_cost": F.col("_shipping_cost"), "bid_count": F.coalesce("_bid_count", "bid_count"), "all_in": cost, "depth": scoring.depth(cost, F.col("med")), "edge": F.col("med") - cost, "ends_at": F.coalesce("_ends_at", "ends_at")}
    return _dropped(rows.withColumns({c: F.when(new, x).otherwise(F.col(c)) for c, x in changed.items()}))


def carry_no_book(prior: DataFrame, fresh: DataFrame, targets: DataFrame, reads: DataFrame, conf: C.Config) -> DataFrame:
    """Prior unpriced hunt hits of targets that still exist; fate as-was, refreshed or dropped.

    targets: (hunt_id, q, title_must, title_not, vertical); today's relevance rule applies.
    """
    from tallyboard.operators.pricing import relevant

    asks = targets.select(F.col("hunt_id"), F.col("q").alias("_q"), F.col("title_must").alias("_must"), F.col("title_not").alias("_not"), F.col("vertical").alias("_lens"))
    rows = _joined(candidates(prior, fresh).join(asks, "hunt_id"), reads)
    fits = relevant(F.col("title"), F.col("_q"), F.col("_must"), F.col("_not"), F.col("_lens"))
    none = F.lit(None).cast("double")
    reason = gates.hunt_gate(F.col("_cost"), none, scoring.has_condition_flag(F.col("_title")), F.lit(False), none, none, conf)
    fate = F.when(~fits | (F.col("_state") == "absent"), "dropped").when(F.col("_state") == "unverified", "as-was").when(reason.isNotNull(), "dropped").otherwise("refreshed")
    rows = rows.withColumn("fate", fate)
    new = F.col("fate") == "refreshed"
    changed = {"price": F.col("_price"), "shipping_cost": F.col("_shipping_cost"), "all_in": F.col("_cost")}
    return _dropped(rows.withColumns({c: F.when(new, x).otherwise(F.col(c)) for c, x in changed.items()}))


RECEIPT = ("id", "item_id", "vertical", "key", "lane", "surfaced_at", "depth", "all_in", "med", "conf", "risk_grade")


def record(ledger: DataFrame, deals: DataFrame, calls: DataFrame, now: str) -> DataFrame:
    """The ledger with newly surfaced deals, then calls; an id that is there is never rewritten."""
    fresh = deals.withColumn("lane", F.lit(None).cast("string")).withColumn("_part", F.lit(1)).unionByName(calls.withColumn("lane", F.lit("closing")).withColumn("_part", F.lit(2)), allowMissingColumns=True)
    fresh = fresh.withColumn("surfaced_at", F.lit(now)).select("_part", *RECEIPT, F.lit("live").alias("outcome"), F.lit(None).cast("string").alias("resolved_at"))
    both = ledger.select(F.lit(0).alias("_part"), *RECEIPT, "outcome", "resolved_at").unionByName(fresh)
    best = both.groupBy("id").agg(F.min_by(F.struct(*[c for c in both.columns if c not in ("_part", "id")]), F.struct("_part", "item_id", "surfaced_at")).alias("_r"))
    return best.select("id", "_r.*")


def resolve(ledger: DataFrame, gone: DataFrame, now: str) -> DataFrame:
    """Live receipts of gone items (item_id) are ended now."""
    ended = gone.select(F.col("item_id").alias("_gone")).distinct()
    out = ledger.join(ended, F.col("item_id") == F.col("_gone"), "left")
    hit = F.col("_gone").isNotNull() & (F.col("outcome") == "live")
    return out.withColumn("resolved_at", F.when(hit, F.lit(now)).otherwise(F.col("resolved_at"))).withColumn("outcome", F.when(hit, F.lit("ended")).otherwise(F.col("outcome"))).drop("_gone")


def tape_summary(ledger: DataFrame) -> DataFrame:
    """One row: total, sold, sold_pct, live, and the median of final price / book median over sold ones.

    The median is selected by rank, so no task sees all ratios.
    """
    ratio = F.when((F.col("outcome") == "sold") & F.col("final_price").isNotNull() & (F.col("med") > 0), F.col("final_price") / F.col("med"))
    n, sold = F.count(F.lit(1)), F.count_if(F.col("outcome") == "sold")
    pct = F.when(n > 0, F.floor(sold * 100 / n + 0.5)).otherwise(0).cast("long")
    return ledger.agg(n.alias("total"), sold.alias("sold"), pct.alias("sold_pct"), F.count_if(F.col("outcome") == "live").alias("live"), F.lit(ranks.median(ledger, ratio)).cast("double").alias("median_final"))


def newest_first(ledger: DataFrame, cap: int) -> DataFrame:
    """The newest receipts, as a distributed top-k."""
    return ledger.orderBy(F.col("surfaced_at").desc(), "id").limit(cap)


def deal_receipts(deals: DataFrame, ledger: DataFrame) -> DataFrame:
    """The first receipt of each deal that shares its id or its item: two equi-joins instead of an OR.

    Each id's and each item's first receipt is found before the joins, so a deal meets two receipts at most however
    many share its item. Deals that share an id share their first receipt.
    """
    r = F.min_by(F.struct("ord", "outcome"), "ord")
    of_id, of_item = (ledger.filter(F.col(c).isNotNull()).groupBy(F.col(c).alias(f"_{c}")).agg(r.alias(f"_by_{c}")) for c in ("id", "item_id"))
    met = deals.select("id", "item_id").join(of_id, F.col("id") == F.col("_id"), "left").join(of_item, F.col("item_id") == F.col("_item_id"), "left")
    first = met.groupBy("id").agg(F.min(F.least("_by_id", "_by_item_id")).alias("_r"))
    return deals.join(first, "id", "left").withColumn("receipt_ord", F.col("_r.ord")).withColumn("outcome", F.col("_r.outcome")).drop("_r")


def last_per_item(rows: DataFrame) -> DataFrame:
    """Latest state of each item from an append-only log (item_id, tick)."""
    w = Window.partitionBy("item_id").orderBy(F.col("tick").desc())
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")

"""Gates: ordered checks whose first failure is the reason; null means the listing passes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyboard import config as C
from tallyboard.operators.scoring import depth

#: Gate reason -> its name in the published histogram.
HISTOGRAM_NAMES = {
    "too-shallow": "tooShallow",
    "edge-floor": "edgeFloor",
    "stale-book": "staleBook",
    "thin-shallow": "thinTooShallow",
    "ladder-shallow": "ladderTooShallow",
    "scam-cap": "scamCap",
    "condition-flag": "condition",
    "no-price": "noPrice",
    "over-ceiling": "maxAllIn",
    "no-bid": "noBid",
    "end-window": "endWindow",
    "thin-book": "thinBook",
    "seller-floor": "sellerFloor",
}


def stale(last_sale_ms: Column, conf: C.Config) -> Column:
    """Older than the limit; an unknown date is not stale."""
    return F.coalesce(F.lit(conf.now_ms) - last_sale_ms > conf.stale_months * C.MONTH_MS, F.lit(False))


def gate(cost: Column, med: Column, last_sale_ms: Column, flagged: Column, thin: Column, conf: C.Config, ladder: Column | None = None, floor: Column | None = None) -> Column:
    """Reason against a fixed-price listing. A ladder row has its own floor, a thin one the higher of both."""
    ladder = F.lit(False) if ladder is None else ladder
    deep = depth(cost, med)
    base = F.coalesce(floor if floor is not None else F.lit(None).cast("double"), F.when(ladder, conf.ladder_depth).otherwise(conf.min_depth))
    least = F.greatest(base, F.when(thin, conf.thin_depth).otherwise(0.0))
    shallow = F.when(deep < conf.min_depth, "too-shallow").when(thin, "thin-shallow").otherwise("ladder-shallow")
    return (
        F.when((cost <= 0) | (med <= 0) | cost.isNull() | med.isNull(), "no-price")
        .when(stale(last_sale_ms, conf), "stale-book")
        .when(flagged, "condition-flag")
        .when(deep > conf.max_depth, "scam-cap")
        .when(deep < least, shallow)
        .when(med - cost < conf.min_edge, "edge-floor")
    )


def hunt_gate(cost: Column, med: Column, flagged: Column, thin: Column, ceiling: Column, floor: Column, conf: C.Config) -> Column:
    """Reason against a hunted listing: without a book row the facts decide; neither age nor edge counts."""
    deep = depth(cost, med)
    least = F.greatest(F.coalesce(floor, F.lit(conf.min_depth)), F.when(F.coalesce(thin, F.lit(False)), conf.thin_depth).otherwise(0.0))
    return (
        F.when((cost <= 0) | cost.isNull(), "no-price")
        .when(flagged, "condition-flag")
        .when(cost > ceiling, "over-ceiling")
        .when(med.isNull(), F.lit(None).cast("string"))
        .when(med <= 0, "no-price")
        .when(deep > conf.max_depth, "scam-cap")
        .when(deep < least, "too-shallow")
    )


def closing_gate(bid_cost: Column, ends_ms: Column, med: Column, last_sale_ms: Column, thin: Column, seller_score: Column, flagged: Column, conf: C.Config, window_ms: int | None = None) -> Column:
    """Reason against an auction that is about to end; it has no scam cap."""
    until = conf.now_ms + (conf.closing_window_ms if window_ms is None else window_ms)
    return (
        F.when((bid_cost <= 0) | bid_cost.isNull(), "no-bid")
        .when((med <= 0) | med.isNull(), "no-price")
        .when(ends_ms.isNull() | (ends_ms <= conf.now_ms) | (ends_ms > until), "end-window")
        .when(thin, "thin-book")
        .when(stale(last_sale_ms, conf), "stale-book")
        .when(seller_score.isNull() | (seller_score < conf.seller_floor), "seller-floor")
        .when(flagged, "condition-flag")
        .when(depth(bid_cost, med) < conf.closing_depth, "too-shallow")
        .when(med - bid_cost < conf.min_edge, "edge-floor")
    )


def histogram_name(reason: Column) -> Column:
    out = reason
    for name, shown in HISTOGRAM_NAMES.items():
        out = F.when(reason == name, shown).otherwise(out)
    return out

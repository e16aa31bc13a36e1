"""The board tick: listings and book in; deals, calls, leads, statistics and the artifact out."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyboard import config as C
from tallyboard.functions.text import deal_id, evidence_url, millis
from tallyboard.operators import gates, hunting, identity, pricing, scoring, windows
from tallyboard.schemas import NO_BOOK
from tallyboard.sources.listings import _top_level


def dedupe_slices(listings: DataFrame) -> DataFrame:
    """One row per item: the first slice, then the first place in it (slice_ord, pos)."""
    return windows.first_wins(listings, ["item_id"], [F.col("slice_ord"), F.col("pos")])


def without_claimed(listings: DataFrame, claimed: DataFrame) -> DataFrame:
    return listings.join(claimed.select("item_id").distinct(), "item_id", "left_anti")


def shortlist(identified: DataFrame, book: DataFrame) -> DataFrame:
    """Listings worth a second look: their key is in the book, or a watch brand has no reference yet."""
    exact = identified.join(book.select(F.col("k").alias("key")), "key", "left_semi")
    brand = identified.filter(F.col("key").isNull() & F.array_contains("matchers", "watches") & identity.watch_brand().isNotNull())
    return exact.unionByName(brand)


def price(identified: DataFrame, book: DataFrame, rungs: DataFrame | None) -> DataFrame:
    """Identified listings with book columns, matched, ladder and basis_key."""
    out = pricing.with_book(identified, book)
    if rungs is None:
        return out.withColumn("ladder", F.lit(False)).withColumn("basis_key", F.lit(None).cast("string"))
    return pricing.with_ladder(out, book, rungs)


def judge(priced: DataFrame, conf: C.Config, verdicts: DataFrame | None = None) -> DataFrame:
    """priced with all_in, depth, edge, gate_reason, signals, risk, rank and id. noBookRow marks keys the book lacks."""
    covered = F.col("matched") | F.col("ladder")
    out = priced.withColumn("all_in", scoring.all_in()).withColumn("depth", scoring.depth(F.col("all_in"), F.col("med"))).withColumn("edge", F.col("med") - F.col("all_in"))
    reason = gates.gate(F.col("all_in"), F.col("med"), millis(F.col("last_sale")), scoring.has_condition_flag(F.col("title")), F.col("conf") == "thin", conf, F.col("ladder"))
    out = out.withColumn("gate_reason", F.when(F.col("key").isNull(), "no-key").when(~covered, "noBookRow").otherwise(reason))
    return score(out.withColumn("signals", scoring.risk_signals(F.col("vertical"))), conf, verdicts)


def score(rows: DataFrame, conf: C.Config, verdicts: DataFrame | None = None) -> DataFrame:
    """rows (with signals, depth and edge) with risk, rank and id."""
    if verdicts is not None:
        rows = scoring.with_cert_verdicts(rows, verdicts)
    s = F.col("signals")
    risk = scoring.risk_score(F.col("vertical"), s["anchor"], s["grader"], s["cert"], F.col("seller_pct"), F.col("seller_score"), F.col("seller_account"), F.size("aspects"), F.col("enriched"), F.col("image_url"), scoring.condition_flags(F.col("title")))
    out = rows.withColumn("risk", F.when(F.col("vertical").isNotNull(), risk))
    evidence = scoring.evidence_weight(millis(F.col("last_sale")), F.col("n12"), conf.now_ms)
    ranked = scoring.rank(F.col("edge"), F.col("depth"), F.col("conf"), F.col("risk.grade"), evidence, scoring.fresh_boost(millis(F.col("listed_at")), conf))
    return out.withColumn("rank", ranked).withColumn("id", deal_id(F.col("item_id")))


def deals(judged: DataFrame, surfaced_at: str, base_url: str = "") -> DataFrame:
    """Rows that pass, stamped with the time they surfaced and the page of their evidence."""
    out = judged.filter(F.col("gate_reason").isNull()).withColumn("surfaced_at", F.lit(surfaced_at)).withColumn("risk_grade", F.col("risk.grade"))
    return out.withColumn("evidence_url", evidence_url(base_url, F.col("vertical"), F.coalesce("basis_key", "key")))


def closing_calls(identified: DataFrame, book: DataFrame, conf: C.Config, window_ms: int | None = None, verdicts: DataFrame | None = None) -> DataFrame:
    """Auction listings with bid columns and gate_reason; no ladder and no context here."""
    out = pricing.with_book(identified, book).withColumn("all_in", scoring.all_in())
    out = out.withColumn("depth", scoring.depth(F.col("all_in"), F.col("med"))).withColumn("edge", F.col("med") - F.col("all_in"))
    reason = gates.closing_gate(F.col("all_in"), millis(F.col("ends_at")), F.col("med"), millis(F.col("last_sale")), F.col("conf") == "thin", F.col("seller_score"), scoring.has_condition_flag(F.col("title")), conf, window_ms)
    out = out.withColumn("gate_reason", F.when(F.col("key").isNull(), "no-key").when(~F.col("matched"), "noBookRow").otherwise(reason))
    return score(out.withColumn("signals", scoring.risk_signals(F.col("vertical"))), conf, verdicts)


def leads(unpriced: DataFrame, context: DataFrame, conf: C.Config) -> DataFrame:
    """Listings without a book row at or below half their rollup's median: cheapest against it first."""
    out = pricing.with_context(unpriced, context, F.lit(None).cast("string")).filter("context IS NOT NULL")
    none = F.lit(None).cast("double")
    out = out.withColumn("all_in", scoring.all_in()).withColumn("ratio", F.try_divide(F.col("all_in"), F.col("context.med")))
    passes = gates.hunt_gate(F.col("all_in"), none, scoring.has_condition_flag(F.col("title")), F.lit(False), none, none, conf).isNull()
    out = out.filter(passes & (F.col("ratio") <= conf.lead_ratio)).withColumn("id", deal_id(F.col("item_id")))
    return windows.top(out, [F.col("ratio"), F.col("id")], conf.leads_cap)


def is_new(surfaced_at: Column, conf: C.Config) -> Column:
    """First surfaced within a day of the build; a time after it counts as new."""
    return F.coalesce(F.lit(conf.now_ms) - millis(surfaced_at) < C.DAY_MS, F.lit(False))


def publish_deals(rows: DataFrame, conf: C.Config) -> DataFrame:
    """Best ranks first, capped, with tier and is_new. Ties go by lane, slice, place and id."""
    order = [F.col("rank").desc(), *[F.col(c).asc_nulls_last() for c in ("lane_ord", "slice_ord", "pos") if c in rows.columns], F.col("id")]
    out = windows.top(rows, order, conf.board_cap)
    verified = scoring.cert_verified(F.col("risk.reasons"))
    tier = scoring.tier(F.col("depth"), F.col("conf"), F.col("n"), F.col("n12"), F.col("risk.grade"), verified, F.coalesce("ladder", F.lit(False)), conf)
    return out.withColumn("tier", tier).withColumn("is_new", is_new(F.col("surfaced_at"), conf))


def publish_closing(rows: DataFrame, conf: C.Config) -> DataFrame:
    return windows.top(rows, [F.col("ends_at"), F.col("id")], conf.closing_cap)


def publish_hunt(rows: DataFrame) -> DataFrame:
    """One row: the hunt's hits as published, priced ones by rank, then unpriced ones by newest date, then id."""
    return published(rows, NO_BOOK, [hunting.board_order()])


# --- statistics ---------------------------------------------------------------------------------


def reason_counts(judged: DataFrame) -> DataFrame:
    """(vertical, reason, n) over keyed rows that did not pass, by published names."""
    cut = F.col("key").isNotNull() & F.col("gate_reason").isNotNull()
    # counted without a filter, which would find every key a second time
    return judged.groupBy("vertical", gates.histogram_name(F.col("gate_reason")).alias("reason")).agg(F.count_if(cut).alias("n")).filter("n > 0")


def nested_counts(counts: DataFrame, outer: str, inner: str, n: str = "n") -> DataFrame:
    """One row: map<outer, map<inner, n>>; both keys come from small fixed vocabularies."""
    by = counts.groupBy(outer).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(inner, n)))).alias("m"))
    return by.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(outer, F.map_entries("m").alias("m"))))).alias("m")).select(F.transform_values("m", lambda _, v: F.map_from_entries(v)).alias("counts"))


def per_vertical(listings: DataFrame, judged: DataFrame, more_surfaced: DataFrame | None = None) -> DataFrame:
    """(vertical, polled, matched, surfaced), launch verticals zero-filled.

    polled counts by the slice's first matcher, the others by the vertical of the hit.
    """
    spark = listings.sparkSession
    polled = listings.withColumn("vertical", F.get("matchers", F.lit(0))).filter("vertical IS NOT NULL").groupBy("vertical").agg(F.count(F.lit(1)).alias("polled"))
    hits = judged.filter(F.col("key").isNotNull() & (F.col("matched") | F.col("ladder")))
    hit = hits.groupBy("vertical").agg(F.count(F.lit(1)).alias("matched"), F.count_if(F.col("gate_reason").isNull()).alias("surfaced"))
    dim = spark.createDataFrame([(v,) for v in C.LAUNCH], "vertical string")
    out = dim.join(polled.join(hit, "vertical", "full"), "vertical", "full").na.fill(0, ["polled", "matched", "surfaced"])
    if more_surfaced is not None:
        more = more_surfaced.groupBy("vertical").agg(F.count(F.lit(1)).alias("_more"))
        out = out.join(more, "vertical", "left").withColumn("surfaced", F.col("surfaced") + F.coalesce("_more", F.lit(0))).drop("_more")
    return out


def identified_counts(identified: DataFrame) -> DataFrame:
    return identified.groupBy("vertical").agg(F.count("key").alias("n")).filter("n > 0")


def by_slice(swept: DataFrame) -> DataFrame:
    """(slice, calls, listings) from one row per page (slice, n)."""
    return swept.groupBy("slice").agg(F.count(F.lit(1)).alias("calls"), F.sum("n").alias("listings"))


#: Columns that come first where they are there.
SLICE_FIRST = ("calls", "listings", "identified", "surfaced")


def slice_columns(counts: DataFrame, key: str, name: str, value: str, first: Sequence[str] = SLICE_FIRST, most: int = 1000) -> DataFrame:
    """A row per key with a column for every name that has a finite number: those of `first`, then the others by name.

    The names are found in a first pass; more than `most` of them are an error. A number that a key lacks is null.
    """
    finite = counts.filter(F.col(name).isNotNull() & F.col(value).isNotNull() & (F.abs(F.col(value).cast("double")) < float("inf")))
    found = [r[0] for r in finite.select(name).distinct().limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"more than {most} columns")
    order = [x for x in first if x in found] + sorted(x for x in found if x not in first)
    return finite.groupBy(key).pivot(name, order).agg(F.sum(value)) if order else finite.select(key).distinct()


def flat_reasons(counts: DataFrame) -> DataFrame:
    """Totals by reason over lenses, most first."""
    return counts.groupBy("reason").agg(F.sum("n").alias("n")).orderBy(F.col("n").desc(), "reason")


def map_total(counts: Column) -> Column:
    """Sum of a map's values; null for an empty map."""
    values = F.map_values(counts)
    return F.when(F.size(values) > 0, F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x))


def chips(published: DataFrame) -> DataFrame:
    """(vertical, n) with a row `all` for the whole board."""
    return published.rollup("vertical").agg(F.count(F.lit(1)).alias("n")).select(F.coalesce("vertical", F.lit("all")).alias("vertical"), "n")


def filtered(published: DataFrame, vertical: str = "all", most_risk: str = "D") -> DataFrame:
    out = published.filter(F.col("risk_grade") <= most_risk)
    return out if vertical == "all" else out.filter(F.col("vertical") == vertical)


def near_misses(judged: DataFrame, vertical: str, cap: int = 5, order: Sequence[str] = ("slice_ord", "pos", "item_id")) -> DataFrame:
    """First listings of a vertical that matched and failed, only where none of it surfaced."""
    own = judged.filter((F.col("vertical") == vertical) & (F.col("matched") | F.col("ladder"))).select("item_id", "title", "all_in", "med", "depth", "gate_reason", *[c for c in order if c != "item_id"])
    surfaced = own.filter(F.col("gate_reason").isNull())
    return windows.top(own if surfaced.isEmpty() else own.limit(0), [F.col(c) for c in order], cap).select("item_id", "title", "all_in", "med", "depth")


#: Published name -> column where the two differ by more than the case of a word's first letter.
_COLUMN = {"itemPrice": "price", "shipping": "shipping_cost", "edgeUsd": "edge", "currentBid": "price", "allInBid": "all_in", "huntLabel": "label"}


def published(rows: DataFrame, ddl: str, order: list[Column]) -> DataFrame:
    """One row: `section`, the rows in order as structs of a published type (ddl); fields without a column are left out.

    isNew is there only where it holds.
    """
    fields = []
    for field in _top_level(ddl):
        name = field.split(":")[0]
        column = _COLUMN.get(name, re.sub("[A-Z]", lambda m: "_" + m[0].lower(), name))
        if column in rows.columns:
            value = F.when(F.col(column), True) if name == "isNew" else F.col(column)
            fields.append(value.alias(name))
    key = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])
    listed = F.sort_array(F.collect_list(F.struct(key.alias("o"), F.struct(*fields).alias("r"))))
    return rows.agg(F.transform(listed, lambda x: x["r"]).alias("section"))


def artifact(
    deal_rows: DataFrame, built_at: str, book_built_at: str, closing: DataFrame | None = None, lead_rows: DataFrame | None = None, stats: DataFrame | None = None,
    per_vertical_rows: DataFrame | None = None, hunt: tuple[DataFrame, DataFrame] | None = None,
) -> DataFrame:
    """The board as one JSON document. Lists are capped, so one row holds them; absent optional fields are left out.

    per_vertical_rows: per_vertical()'s; hunt: its targets and its hits, each as published() gives them.
    deal_rows, closing and lead_rows: rows as they are to be written, or published()'s one row.
    """
    spark = deal_rows.sparkSession
    parts = spark.createDataFrame([(1, built_at, book_built_at)], "schema int, builtAt string, bookBuiltAt string")

    def section(rows: DataFrame, name: str) -> DataFrame:
        return rows.withColumnRenamed("section", name) if rows.columns == ["section"] else rows.agg(F.collect_list(F.struct(*rows.columns)).alias(name))

    for name, rows in (("deals", deal_rows), ("closing", closing), ("leads", lead_rows)):
        if rows is not None:
            parts = parts.crossJoin(section(rows, name))  # one row by one row
    if per_vertical_rows is not None:
        counts = F.struct("vertical", F.struct("polled", "matched", "surfaced"))
        parts = parts.crossJoin(per_vertical_rows.agg(F.map_from_entries(F.sort_array(F.collect_list(counts))).alias("perVertical")))
    if hunt is not None:
        targets, hits = hunt
        both = section(targets, "targets").crossJoin(section(hits, "deals"))
        parts = parts.crossJoin(both.select(F.struct("targets", "deals").alias("hunt")))
    if stats is not None:
        parts = parts.crossJoin(stats.select(F.struct(*stats.columns).alias("stats")).limit(1))
    return parts.select(F.to_json(F.struct(*parts.columns)).alias("value"))

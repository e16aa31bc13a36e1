"""Listings with item specifics through the tick: keys from aspects, order of matchers, certificates; lookups, pivots and
the hunt's index. Each with SQL that knows the result by construction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyboard import config as C
from tallyboard.operators import board, identity, pricing, scoring
from tallyboard.plans import tick
from tallyboard.plans.catalog import query
from tallyboard.plans.twins import spread, table
from tallyboard.schemas import RAW_LISTING
from tallyboard.sources import listings as source

_NAME = lambda: F.concat(tick._first(), F.lit(" "), tick._last())
_PLAIN_NAME_SQL = f"({tick._FIRST_SQL} || ' ' || {tick._LAST_SQL})"

#: Vertical -> (title of a listing that carries its fields as aspects, the aspects, SQL of its key).
BY_ASPECTS = {
    "sports-cards": (
        lambda: F.lit("nice card, see specifics"),
        lambda: {"Player/Athlete": _NAME(), "Season": F.concat(tick._year(), F.lit("-05")), "Set": F.lit("O-Pee-Chee"), "Card Number": F.concat(F.lit("# "), tick._number()), "Professional Grader": F.lit("Professional Sports Authenticator (PSA)"), "Grade": tick._grade()},
        f"{tick._NAME_SQL} || '|' || {tick._YEAR_SQL} || '|opc|' || pk::VARCHAR || '|PSA' || {tick._GRADE_SQL}",
    ),
    "pokemon": (
        lambda: F.concat(F.lit("holo lot "), tick._when(3, "1st Edition")),
        lambda: {"year": tick._year(), "SET": tick._set(), "Card Number": tick._number(), "Grade": tick._grade(), "Grading Company": F.lit("cgc")},
        f"{tick._YEAR_SQL} || '|' || replace(lower({tick._SET_SQL}), ' ', '-') || '|' || pk::VARCHAR || '|' || CASE WHEN pk % 3 = 0 THEN '1st' ELSE 'unl' END || '|CGC' || {tick._GRADE_SQL}",
    ),
    "art-editions": (
        lambda: F.lit("framed work"),
        lambda: {"Artist": F.concat(F.lit("  "), _NAME()), "Title": F.concat(F.lit("Harbour Scene "), tick._number()), "Medium": F.when(F.col("pk") % 5 > 0, "Lithograph").otherwise("Oil")},
        f"CASE WHEN pk % 5 > 0 THEN {tick._NAME_SQL} || '|harbour-scene-' || pk::VARCHAR END",
    ),
    "autographs": (
        lambda: F.when(F.col("pk") % 5 > 0, "fine document signed").otherwise("fine signed photo"),
        lambda: {"Signed By": F.concat(_NAME(), F.when(F.col("pk") % 7 == 0, ", Jr.").otherwise("")), "Original/Reproduction": F.when(F.col("pk") % 9 == 0, "Reproduction").otherwise("Original")},
        f"CASE WHEN pk % 9 > 0 THEN {tick._NAME_SQL} || CASE WHEN pk % 5 > 0 THEN '|ds' ELSE '|sp' END END",
    ),
    "watches": (
        lambda: F.concat(F.lit("automatic, year 1968"), tick._when(13, " homage")),
        lambda: {"Brand": tick._brand(), "Reference Number": F.concat(F.lit("16 "), tick._number(), F.lit("A"))},
        f"CASE WHEN pk % 13 > 0 THEN lower({tick._BRAND_SQL}) || '|16' || pk::VARCHAR || 'a' END",
    ),
}


def _listed(p: DataFrame, vertical: str) -> DataFrame:
    """Listings of a vertical: summaries, of which the odd ones are named by their aspects only, which the full items bring."""
    title, aspects, _ = BY_ASPECTS[vertical]
    odd = F.col("pk") % 2 == 1
    named = [F.struct(F.lit(k).alias("name"), v.alias("value")) for k, v in aspects().items()]
    broken = F.struct(F.lit(None).cast("string").alias("name"), F.lit("x").alias("value"))
    raw = F.struct(
        F.concat(F.lit("v1|"), F.col("pk").cast("string")).alias("itemId"), F.when(odd, title()).otherwise(tick.TITLES[vertical][0]()).alias("title"),
        F.when(odd, F.array(broken, *named)).alias("localizedAspects"), F.struct(F.lit("99.6").alias("feedbackPercentage"), F.lit(1200).alias("feedbackScore"), F.lit("Business").alias("sellerAccountType")).alias("seller"), F.struct(F.lit("i").alias("imageUrl")).alias("image"),
    )
    parsed = p.select("pk", F.from_json(F.to_json(raw), f"STRUCT<{source._colons(RAW_LISTING)}>").alias("l")).select("pk", "l.*")
    items = source.normalize(parsed.filter("pk % 2 = 1"))
    return source.enrich(source.normalize(parsed, enriched=False), items).withColumn("matchers", F.array(F.lit(vertical)))


@query(" UNION ALL ".join(
    f"SELECT pk, '{v}' AS asked, CASE WHEN pk % 2 = 1 THEN {by_aspect} ELSE {tick.TITLES[v][1]} END AS key, pk % 2 = 1 AS enriched FROM (SELECT p_partkey AS pk FROM part)" for v, (_, _, by_aspect) in BY_ASPECTS.items()
))
def tick_aspects(spark, sf_dir):
    """Keys of every vertical's listings, half of which carry them as item specifics of the enriched item."""
    out, parts = None, tick._parts(spark, sf_dir).select("pk")
    for v in BY_ASPECTS:
        rows = identity.identify(_listed(parts, v), F.col("matchers"), (v,)).select("pk", F.lit(v).alias("asked"), "key", "enriched")
        out = rows if out is None else out.unionByName(rows)
    return out


_CARD_SQL = tick.TITLES["sports-cards"][1]
_AS_POKEMON_SQL = f"{tick._YEAR_SQL} || '|topps-' || {tick._NAME_SQL} || '-rookie|' || pk::VARCHAR || '|unl|PSA' || {tick._GRADE_SQL}"


@query(
    f"""SELECT pk, CASE WHEN pk % 3 = 0 THEN NULL WHEN pk % 2 = 1 AND pk % 11 > 0 THEN {_AS_POKEMON_SQL} ELSE {_CARD_SQL} END AS key,
    CASE WHEN pk % 3 = 0 THEN NULL WHEN pk % 2 = 1 AND pk % 11 > 0 THEN 'pokemon' ELSE 'sports-cards' END AS vertical FROM (SELECT p_partkey AS pk FROM part)"""
)
def tick_order(spark, sf_dir):
    """Listings that two matchers could take: the first in their order does, the second where the first names none."""
    rows = tick._titled(tick._parts(spark, sf_dir), "sports-cards")
    order = F.when(F.col("pk") % 3 == 0, F.array(F.lit("watches"), F.lit("autographs"))).when(F.col("pk") % 2 == 1, F.array(F.lit("pokemon"), F.lit("sports-cards"))).otherwise(F.array(F.lit("sports-cards"), F.lit("pokemon")))
    return identity.identify(rows.withColumn("matchers", order), F.col("matchers"), ("sports-cards", "pokemon", "watches", "autographs")).select("pk", "key", "vertical")


def _points(score: str) -> str:
    return f"CASE WHEN {score} >= 80 THEN 'A' WHEN {score} >= 60 THEN 'B' WHEN {score} >= 40 THEN 'C' ELSE 'D' END"


@query(
    f"""WITH l AS (SELECT pk, CASE WHEN pk % 4 = 0 THEN NULL ELSE (pk % 50)::VARCHAR END AS cert FROM (SELECT p_partkey AS pk FROM part)),
    j AS (SELECT *, CASE WHEN cert IS NULL THEN 'raw' WHEN (pk % 50) % 3 = 0 THEN 'cert-verified' ELSE 'slab-claimed' END AS anchor FROM l),
    s AS (SELECT *, CASE anchor WHEN 'raw' THEN {C.ANCHOR_POINTS['raw']} WHEN 'cert-verified' THEN {C.ANCHOR_POINTS['cert-verified']} ELSE {C.ANCHOR_POINTS['slab-claimed']} END + 15 + 10 + 5 + least({C.QUALITY_MOST}, 9 + 6) + {C.VERTICAL_POINTS['sports-cards']} AS score FROM j)
    SELECT pk, anchor, score::BIGINT AS score, {_points('score')} AS grade, anchor = 'cert-verified' AS verified,
    CASE anchor WHEN 'raw' THEN 'grader claimed without a certification number' WHEN 'cert-verified' THEN 'PSA cert verified: Card ' || cert ELSE '' END AS notes FROM s"""
)
def tick_certs(spark, sf_dir):
    """Certificates of graded cards against a table of verdicts: anchor, risk and whether the reasons say so."""
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("pk"))
    cert = F.when(F.col("pk") % 4 > 0, (F.col("pk") % 50).cast("string")).otherwise("")
    named = {"Professional Grader": F.lit("PSA"), "Grade": F.lit("9"), "Cert Number": cert}
    listed = rows.select("pk", F.lit("1990 Topps Marlon Keel #5 PSA 9").alias("title"), F.lit(None).cast("string").alias("condition"), F.array(*[F.struct(F.lit(k).alias("name"), v.alias("value")) for k, v in named.items()]).alias("aspects"), F.lit("sports-cards").alias("vertical"))
    verdicts = spark.range(50).select(F.col("id").cast("string").alias("cert"), (F.col("id") % 3 == 0).alias("verified"), F.concat(F.lit("Card "), F.col("id").cast("string")).alias("subject"))
    judged = scoring.with_cert_verdicts(listed.withColumn("signals", scoring.risk_signals(F.col("vertical"))), verdicts)
    s = F.col("signals")
    risk = scoring.risk_score(F.col("vertical"), s["anchor"], s["grader"], s["cert"], F.lit(99.6), F.lit(1200), F.lit("Business"), F.size("aspects"), F.lit(True), F.lit("i"), F.array().cast("array<string>"))
    out = judged.withColumn("risk", risk)
    return out.select("pk", s["anchor"].alias("anchor"), "risk.score", "risk.grade", scoring.cert_verified(F.col("risk.reasons")).alias("verified"), F.array_join(s["notes"], "; ").alias("notes"))


# --- lookups in batches ------------------------------------------------------------------------------
#: The batch that is refused, after which items are read one by one, and what a single read fails for.
_REFUSED, _SINGLES = 30, 400


@query(
    f"""WITH i AS (SELECT p_partkey AS pk, 'v1|' || p_partkey::VARCHAR AS item_id, p_retailprice AS price, row_number() OVER (ORDER BY p_partkey) - 1 AS rn FROM part),
    b AS (SELECT *, rn // 20 AS batch FROM i),
    s AS (SELECT *, CASE WHEN batch < {_REFUSED} THEN batch % 9 <> 4 ELSE (min(batch) OVER () >= 0) AND (max(rn) OVER (PARTITION BY batch)) - {_REFUSED} * 20 < {_SINGLES} AND NOT bool_or(pk % 501 = 3) OVER (PARTITION BY batch) END AS checked FROM b)
    SELECT item_id, batch, CASE WHEN NOT checked THEN 'unread' WHEN pk % 7 = 0 THEN 'gone' ELSE 'alive' END AS state FROM s"""
)
def batched_lookup(spark, sf_dir):
    """Items read in batches of 20: some batches fail, one is refused, and from there on the budget of single reads decides."""
    ids = table(spark, sf_dir, "part").select(F.concat(F.lit("v1|"), F.col("p_partkey").cast("string")).alias("item_id"), F.col("p_partkey").alias("ord"), F.col("p_retailprice").alias("price"))
    snapshot = ids.filter("ord % 7 > 0").select("item_id", "price")
    failed = spark.range(_REFUSED).filter("id % 9 = 4").select(F.col("id").alias("batch"))
    errors = ids.filter("ord % 501 = 3").select("item_id")
    return source.lookup_batches(ids.select("item_id", "ord"), snapshot, failed, _REFUSED, errors, _SINGLES).select("item_id", "batch", "state")


# --- the hunt's index ----------------------------------------------------------------------------------
_HUNT_TITLE = "p_name || ' no' || p_partkey::VARCHAR || ' ' || p_brand"


@query(
    f"""WITH t AS (SELECT p_partkey, lower({_HUNT_TITLE}) AS title FROM part),
    e AS (SELECT p_partkey AS pk, 'h' || p_partkey::VARCHAR AS hunt_id, string_split(lower(CASE p_partkey % 3 WHEN 0 THEN 'the no' || p_partkey::VARCHAR WHEN 1 THEN p_brand || ' NO' || (p_partkey // 10)::VARCHAR ELSE p_name || ' ' || (p_partkey // 7)::VARCHAR END), ' ') AS ws FROM part),
    w AS (SELECT *, list_filter(ws, lambda x: x NOT IN ('', 'the')) AS own FROM e)
    SELECT hunt_id, p_partkey FROM w JOIN t ON contains(title, own[1]) AND (len(own) < 2 OR contains(title, own[2])) AND (len(own) < 3 OR contains(title, own[3])) WHERE pk % 5 > 0 OR NOT contains(title, 'red')"""
)
def hunt_index(spark, sf_dir):
    """Which parts suit which of as many hunt entries, by the rarest part of each entry's words."""
    p = spread(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand"), "p_partkey")
    number = F.col("p_partkey").cast("string")
    titles = p.select("p_partkey", F.concat("p_name", F.lit(" no"), number, F.lit(" "), "p_brand").alias("title"))
    tens, sevens = F.floor(F.col("p_partkey") / 10).cast("string"), F.floor(F.col("p_partkey") / 7).cast("string")
    q = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("the no"), number)).when(F.col("p_partkey") % 3 == 1, F.concat("p_brand", F.lit(" NO"), tens)).otherwise(F.concat("p_name", F.lit(" "), sevens))
    entries = p.select(F.concat(F.lit("h"), number).alias("hunt_id"), q.alias("q"), F.lit(None).cast("string").alias("title_must"), F.when(F.col("p_partkey") % 5 == 0, "red").alias("title_not"), F.lit("other").alias("vertical"))
    return pricing.relevant_pairs(titles, entries).select("hunt_id", "p_partkey")


# --- a pivot whose columns are found ---------------------------------------------------------------------
@query("SELECT user_id % 10 AS slice, count(*) AS calls, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'error') AS error, count(*) FILTER (event_type = 'purchase') AS purchase, count(*) FILTER (event_type = 'signup') AS signup, count(*) FILTER (event_type = 'view') AS view FROM events GROUP BY 1")
def slice_columns(spark, sf_dir):
    """Numbers of each slice in columns that the data name: the kinds of events, and all as calls."""
    rows = table(spark, sf_dir, "events").select((F.col("user_id") % 10).alias("slice"), F.explode(F.array(F.lit("calls"), "event_type")).alias("name"))
    counts = rows.groupBy("slice", "name").agg(F.count("*").alias("value"))
    return board.slice_columns(counts, "slice", "name", "value").na.fill(0)


"""Lane merges, query compilation, hunt views and artifact guards over the generic tables, each with SQL.

Inputs are put together by expressions that both engines read; the queries then run the library's functions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyboard.operators import board, budget, carry, hunting, lanes
from tallyboard.plans.catalog import query
from tallyboard.plans.twins import CONF, cents, cents_sql, table
from tallyboard.schemas import CALL, HUNT_ENTRY
from tallyboard.sources import artifact
from tallyboard.sources import listings as source

# --- lanes: items are orders, keys are parts ----------------------------------------------------
_ORDER = "concat('v1|', cast(o_orderkey as string))"


def _orders(spark: SparkSession, sf_dir: str, where: str, lane: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").filter(where)
    return rows.select(F.expr(_ORDER).alias("item_id"), F.expr(f"concat('{lane}', cast(o_orderkey as string))").alias("id"), F.col("o_totalprice").alias("price"), F.col("o_orderkey").alias("ok"))


def _lane_sql(*lanes_: tuple[str, str]) -> str:
    rows = " UNION ALL ".join(f"SELECT {_ORDER} AS item_id, concat('{lane}', cast(o_orderkey AS string)) AS id, {i} AS lane_ord, o_totalprice AS price FROM orders WHERE {where}" for i, (where, lane) in enumerate(lanes_))
    return f"SELECT item_id, id, lane_ord, {cents_sql('price')} AS price_c FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY lane_ord, id) AS rn FROM ({rows})) WHERE rn = 1"


_DEALS = (("o_orderkey % 2 = 0", "d"), ("o_orderkey % 3 = 0", "c"))
_CALLS = (("o_orderkey % 5 = 0", "g"), ("o_orderkey % 3 = 0", "s"), ("o_orderkey % 2 = 0", "c"))


@query(_lane_sql(*_DEALS))
def merged_deals(spark, sf_dir):
    """Fresh deals and carried ones; fresh ones win."""
    return lanes.merge(*[_orders(spark, sf_dir, *x) for x in _DEALS]).select("item_id", "id", "lane_ord", cents(F.col("price")).alias("price_c"))


@query(_lane_sql(*_CALLS))
def merged_closing(spark, sf_dir):
    """Closing calls: per-key finds first, then the category sweep's, then carried ones."""
    return lanes.merge(*[_orders(spark, sf_dir, *x) for x in _CALLS]).select("item_id", "id", "lane_ord", cents(F.col("price")).alias("price_c"))


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem")
    item = F.concat(F.lit("v1|"), F.col("l_orderkey").cast("string"))
    return l.select(item.alias("item_id"), (F.col("l_partkey") % 97).alias("key_ord"), F.col("l_linenumber").alias("pos"), F.col("l_partkey").cast("string").alias("key"), F.concat(F.lit("h"), (F.col("l_suppkey") % 5).cast("string")).alias("hunt_id"), (F.col("l_suppkey") % 3).alias("query_ord"), F.col("l_quantity").alias("qty"))


_HIT_SQL = "SELECT 'v1|' || l_orderkey::VARCHAR AS item_id, l_partkey % 97 AS key_ord, l_linenumber AS pos, l_partkey::VARCHAR AS key, 'h' || (l_suppkey % 5)::VARCHAR AS hunt_id, l_suppkey % 3 AS query_ord, l_quantity AS qty, l_orderkey AS ok FROM lineitem"


@query(f"SELECT item_id, key_ord, key FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY key_ord, pos, key) AS rn FROM ({_HIT_SQL}) WHERE ok % 7 > 0 AND ok % 11 > 0) WHERE rn = 1")
def unseen_hits(spark, sf_dir):
    """Per-key hits that neither a deal nor a hunt claim has; the first key keeps the item."""
    taken = [_orders(spark, sf_dir, f"o_orderkey % {m} = 0", "x") for m in (7, 11)]
    return lanes.unseen(_hits(spark, sf_dir), *taken).select("item_id", "key_ord", "key")


@query(f"SELECT hunt_id, item_id, min(query_ord) AS query_ord FROM ({_HIT_SQL}) GROUP BY 1, 2")
def entry_dedupe(spark, sf_dir):
    """Each hunt entry has an item once, from its first query."""
    return lanes.within_entry(_hits(spark, sf_dir)).select("hunt_id", "item_id", "query_ord")


@query(f"SELECT count(DISTINCT key) AS keys, count(*) AS listings, count(*) FILTER (qty < 10 AND pos % 2 = 0) AS surfaced, count(*) FILTER (qty < 10 AND pos % 2 = 1) AS closing FROM ({_HIT_SQL})")
def per_key_funnel(spark, sf_dir):
    rows = _hits(spark, sf_dir).withColumns({"auction": F.col("pos") % 2 == 1, "gate_reason": F.when(F.col("qty") >= 10, "too-shallow")})
    return lanes.per_key_funnel(rows)


@query(f"SELECT hunt_id, count(*) AS listings, count(*) FILTER (qty < 10 AND pos < 3) AS priced, count(*) FILTER (qty < 10 AND pos >= 3) AS no_book, count(*) FILTER (qty >= 10) AS cut FROM ({_HIT_SQL}) GROUP BY 1")
def entry_funnel(spark, sf_dir):
    rows = _hits(spark, sf_dir).withColumns({"no_book": F.col("pos") >= 3, "gate_reason": F.when(F.col("qty") >= 10, "too-shallow")})
    return lanes.entry_funnel(rows)


@query("SELECT 'd' || o_orderkey::VARCHAR AS id FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT 'h' || o_orderkey::VARCHAR FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey % 4 > 0")
def permalinks(spark, sf_dir):
    """Deals and priced hunt hits have pages; unpriced hits have none."""
    hunt = _orders(spark, sf_dir, "o_orderkey % 3 = 0", "h").withColumn("no_book", F.col("ok") % 4 == 0)
    return lanes.permalinks(_orders(spark, sf_dir, "o_orderkey % 2 = 0", "d"), hunt).select("id")


@query(f"SELECT {_ORDER} AS item_id FROM orders WHERE o_orderkey % 4 > 0 ORDER BY o_totalprice DESC, o_orderkey LIMIT 240")
def enrich_picks(spark, sf_dir):
    """The auction lane's calls enrich 240 listings; enriched ones are passed over."""
    rows = _orders(spark, sf_dir, "true", "a").withColumn("enriched", F.when(F.col("ok") % 4 == 0, True))
    return lanes.enrichable(rows, "auction", [F.col("price").desc(), F.col("ok")], CONF).select("item_id")


@query(f"SELECT {_ORDER} AS item_id FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 300")
def verify_picks(spark, sf_dir):
    """The prior deals that this tick's calls can verify, best first."""
    return carry.verify_order(_orders(spark, sf_dir, "true", "d"), [F.col("price").desc(), F.col("ok")], CONF).select("item_id")


@query("SELECT 'q' || p_partkey::VARCHAR AS q FROM part ORDER BY p_partkey LIMIT 62")
def hunt_plan(spark, sf_dir):
    """The hunt queries that fit a run's reserve."""
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("ord"), F.concat(F.lit("q"), F.col("p_partkey").cast("string")).alias("q"))
    return budget.plan_hunt(rows).select("q")


@query("SELECT l_returnflag || l_linestatus AS slice, count(*) AS calls, sum(l_quantity)::BIGINT AS listings FROM lineitem GROUP BY 1")
def slice_calls(spark, sf_dir):
    """Calls and listings of each slice; a page is a line item that brought its quantity."""
    rows = table(spark, sf_dir, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("slice"), F.col("l_quantity").cast("long").alias("n"))
    return board.by_slice(rows)


@query("SELECT 'v1|' || p_partkey::VARCHAR AS item_id, CASE WHEN p_partkey % 3 = 0 THEN 'New' ELSE 'Used' END AS condition, p_partkey % 3 = 0 OR p_partkey % 5 = 0 AS enriched, CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 0 END AS aspects FROM part")
def enriched_listings(spark, sf_dir):
    """Listings take condition and aspects of the full item where a read brought it."""
    part = table(spark, sf_dir, "part").select(F.concat(F.lit("v1|"), F.col("p_partkey").cast("string")).alias("item_id"), F.col("p_partkey").alias("pk"))
    none = F.array().cast("array<struct<name:string,value:string>>")
    rows = part.select("item_id", F.lit("Used").alias("condition"), none.alias("aspects"), (F.col("pk") % 5 == 0).alias("enriched"))
    items = part.filter("pk % 3 = 0").select("item_id", F.lit("New").alias("condition"), F.array(F.struct(F.lit("Brand").alias("name"), F.lit("x").alias("value"))).alias("aspects"))
    return source.enrich(rows, items).select("item_id", "condition", "enriched", F.size("aspects").alias("aspects"))


@query("SELECT 'd' || o_orderkey::VARCHAR AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'featured' WHEN o_totalprice >= 100000 AND o_orderkey % 2 = 0 THEN 'featured' ELSE 'worth-a-look' END AS tier FROM orders WHERE o_orderkey % 4 < 3")
def tier_split(spark, sf_dir):
    """Board filters by risk, then the split by tier: as published, else by the rule."""
    rows = _orders(spark, sf_dir, "true", "d").select(
        "id", F.lit("v").alias("vertical"), F.when(F.col("ok") % 3 == 0, "featured").alias("tier"), F.lit(0.4).alias("depth"), F.when(F.col("price") >= 100000, "high").otherwise("medium").alias("conf"),
        F.when(F.col("ok") % 2 == 0, 50).otherwise(1).alias("n"), F.lit(50).alias("n12"), F.element_at(F.array(*map(F.lit, "ABCD")), (F.col("ok") % 4 + 1).cast("int")).alias("risk_grade"),
        F.array().cast("array<string>").alias("risk_reasons"), F.lit(False).alias("ladder"),
    )
    return lanes.tier_split(board.filtered(rows, "v", "C"), CONF).select("id", "tier")


@query("SELECT 'v1|' || p_partkey::VARCHAR AS item_id, p_partkey % 5 > 0 AS checked, CASE WHEN p_partkey % 5 = 0 THEN 'unread' WHEN p_partkey % 3 = 0 THEN 'gone' ELSE 'alive' END AS state FROM part")
def looked_up(spark, sf_dir):
    """Items read, found gone, or left open by a failed read."""
    part = table(spark, sf_dir, "part").select(F.concat(F.lit("v1|"), F.col("p_partkey").cast("string")).alias("item_id"), F.col("p_partkey").alias("pk"), F.col("p_retailprice").alias("price"))
    snapshot = part.filter("pk % 3 > 0").select("item_id", "price", F.lit(0.0).alias("shipping_cost"), F.lit("t").alias("title"), F.lit(None).cast("string").alias("ends_at"), F.lit(1).alias("bid_count"), F.lit(9).alias("seller_score"))
    rows = source.lookup(part, snapshot, part.filter("pk % 5 = 0"))
    return rows.select("item_id", "checked", F.when(~F.col("checked"), "unread").when(F.col("price").isNull(), "gone").otherwise("alive").alias("state"))


# --- queries compiled from book rows -------------------------------------------------------------
_VERTICAL = "CASE pk % 6 WHEN 0 THEN 'sports-cards' WHEN 1 THEN 'pokemon' WHEN 2 THEN 'art-editions' WHEN 3 THEN 'autographs' WHEN 4 THEN 'watches' ELSE 'design' END"
_S = "cast({} as string)".format
_YEAR, _PK, _WHO = _S("1990 + pk % 20"), _S("pk"), _S("pk % 50")
_KEY = f"""CASE pk % 6 WHEN 0 THEN concat('vera-stahl-', {_WHO}, '|', {_YEAR}, '|topps|', {_PK}, '|', CASE WHEN pk % 5 = 0 THEN 'raw' ELSE concat('PSA', {_S('pk % 10 + 1')}) END)
  WHEN 1 THEN concat({_YEAR}, '|gym-heroes|', {_PK}, '|', CASE pk % 5 WHEN 0 THEN '1st' WHEN 1 THEN 'shadowless' ELSE 'unl' END, '|CGC', {_S('pk % 10 + 1')})
  WHEN 2 THEN concat('orla-finch-', {_WHO}, '|harbour-scene-', {_PK}, '-lithograph')
  WHEN 3 THEN concat('tobias-lorne-', {_PK}, '|', CASE pk % 5 WHEN 0 THEN 'als' WHEN 1 THEN 'ds' WHEN 2 THEN 'sp' WHEN 3 THEN 'check' ELSE 'other' END)
  WHEN 4 THEN concat('grand-seiko|', {_PK}) ELSE concat('charles-eames|lcm', {_PK}) END"""
_TERMS_SQL = f"""CASE pk % 6 WHEN 0 THEN concat('vera stahl ', {_WHO}, ' ', {_YEAR}, ' topps #', {_PK}, CASE WHEN pk % 5 = 0 THEN '' ELSE concat(' PSA', {_S('pk % 10 + 1')}) END)
  WHEN 1 THEN concat({_YEAR}, ' Pokemon gym heroes #', {_PK}, CASE pk % 5 WHEN 0 THEN ' 1st Edition' WHEN 1 THEN ' Shadowless' ELSE '' END, ' CGC ', {_S('pk % 10 + 1')})
  WHEN 2 THEN concat('orla finch ', {_WHO}, ' harbour scene ', {_PK}, ' lithograph')
  WHEN 3 THEN concat('tobias lorne ', {_PK}, CASE pk % 5 WHEN 0 THEN ' autograph letter signed' WHEN 1 THEN ' document signed' WHEN 2 THEN ' signed photo' WHEN 3 THEN ' signed check' ELSE ' signed' END)
  WHEN 4 THEN concat('grand seiko ', {_PK}) END"""
_CATEGORY_SQL = "CASE pk % 6 WHEN 0 THEN '261328' WHEN 1 THEN '183454' WHEN 2 THEN '360' WHEN 3 THEN '14429' WHEN 4 THEN '31387' END"
_KEYED_SQL = f"""keyed AS (SELECT *, {_KEY} AS k, {_VERTICAL} AS v, {_TERMS_SQL} AS terms, {_CATEGORY_SQL} AS category,
  floor(r * 0.8::DOUBLE * 0.5::DOUBLE + 0.5::DOUBLE)::DOUBLE AS price_min, floor(r * 1.2::DOUBLE * 1.15::DOUBLE + 0.5::DOUBLE)::DOUBLE AS price_max FROM (SELECT p_partkey AS pk, p_retailprice AS r FROM part))"""


def _book(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("pk"), F.col("p_retailprice").alias("r"))
    return p.select(F.expr(_KEY).alias("k"), F.expr(_VERTICAL).alias("v"), F.col("r").alias("med"), (F.col("r") * 0.8).alias("lo"), (F.col("r") * 1.2).alias("hi"))


@query(f"WITH {_KEYED_SQL} SELECT k, terms AS q, category, price_min, price_max FROM keyed WHERE terms IS NOT NULL")
def pool_queries(spark, sf_dir):
    """Per-key searches of the book: words, category and price band; design has none."""
    return hunting.compile_pool(_book(spark, sf_dir)).select("k", "q", "category", "price_min", "price_max")


#: hunt_id, vertical, key, key_prefix, q, max_all_in
_ENTRIES = (
    ("auto", "autographs", "tobias-lorne-9|other", None, None, None),
    ("watch", "watches", "grand-seiko|10", None, None, None),
    ("gone", "art-editions", "nobody|nothing", None, None, None),
    ("cards", "sports-cards", None, "vera-stahl-6|", None, None),
    ("prints", "art-editions", None, "orla-finch-", None, 500.0),
    ("jersey", "sports", None, None, "game worn Stahl jersey", 900.0),
    ("fossil", "science", None, None, "ammonite slab", None),
    ("slab", "sports-cards", None, None, "1990 Stahl PSA", 50.0),
)


def _lit(x) -> str:
    return "NULL" if x is None else repr(x)


_ENTRY_SQL = "e(hunt_id, vertical, key, key_prefix, words, max_all_in, hunt_ord) AS (VALUES " + ", ".join("(" + ", ".join(map(_lit, (*e, i))) + ")" for i, e in enumerate(_ENTRIES, 1)) + ")"


def _entries(spark: SparkSession) -> DataFrame:
    rows = [(h, i, h, v, k, p, q, None, most, None, None, None, None, "2000-01-01") for i, (h, v, k, p, q, most) in enumerate(_ENTRIES, 1)]
    return spark.createDataFrame(rows, HUNT_ENTRY)


@query(
    f"""WITH {_KEYED_SQL}, {_ENTRY_SQL},
    pinned AS (SELECT hunt_id, hunt_ord, 1 AS place, 'key' AS form, keyed.* FROM e JOIN keyed ON k = key
      UNION ALL SELECT * FROM (SELECT hunt_id, hunt_ord, row_number() OVER (PARTITION BY hunt_id ORDER BY r DESC, k) AS place, 'prefix' AS form, keyed.* FROM e JOIN keyed ON starts_with(k, key_prefix)) WHERE place <= 8)
    SELECT hunt_id, hunt_ord::INTEGER AS hunt_ord, place::INTEGER AS place, form, k AS key, terms AS q, category, price_min, price_max, v AS matcher FROM pinned WHERE v NOT IN ('watches', 'design')
    UNION ALL SELECT hunt_id, hunt_ord::INTEGER, 1, 'words', 'hunt:' || hunt_id, words, CASE vertical WHEN 'sports-cards' THEN '212' WHEN 'sports' THEN '64482' END, NULL, max_all_in::DOUBLE, CASE WHEN vertical = 'sports-cards' THEN vertical END FROM e WHERE words IS NOT NULL"""
)
def hunt_queries(spark, sf_dir):
    """The hunt list compiled: keys, prefixes and words."""
    return hunting.compile_hunt(_entries(spark), _book(spark, sf_dir), CONF)


@query(f"WITH {_KEYED_SQL}, {_ENTRY_SQL} SELECT hunt_id, key FROM e WHERE key IS NOT NULL AND key NOT IN (SELECT k FROM keyed)")
def hunt_missing(spark, sf_dir):
    return hunting.missing_keys(_entries(spark), _book(spark, sf_dir))


# --- hunt views: targets are customers, hits their orders -----------------------------------------
_LISTED_SQL = "CASE WHEN o_orderkey % 5 > 0 THEN epoch_ms(o_orderdate) ELSE 0 END"


def _targets(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    own = F.struct(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("k"))
    targets = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("hunt_id"), F.when(F.col("c_custkey") % 9 == 0, own).alias("context"))
    stamp = F.struct(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("k"))
    iso = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    hits = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("hunt_id"), F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 3 > 0).alias("no_book"), F.col("o_totalprice").alias("rank"),
        F.when(F.col("o_orderkey") % 5 > 0, iso).alias("listed_at"), F.lit("1970-01-01T00:00:00Z").alias("surfaced_at"), F.when(F.col("o_orderkey") % 4 > 0, stamp).alias("context"),
    )
    return targets, hits


@query(
    f"""WITH h AS (SELECT o_custkey AS hunt_id, o_orderkey AS id, o_orderkey % 3 > 0 AS nb, CASE WHEN o_orderkey % 4 > 0 THEN 'o' || o_orderkey::VARCHAR END AS ctx,
      row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey % 3 > 0, CASE WHEN o_orderkey % 3 = 0 THEN -o_totalprice END, CASE WHEN o_orderkey % 3 > 0 THEN -{_LISTED_SQL} END, o_orderkey) AS place FROM orders),
    a AS (SELECT hunt_id, count(*) AS hits, count(*) FILTER (NOT nb) AS priced, count(*) FILTER (nb) AS no_book, arg_min(id, place) AS first_id, arg_min(ctx, place) FILTER (nb AND ctx IS NOT NULL) AS ctx FROM h GROUP BY 1)
    SELECT c_custkey AS hunt_id, coalesce(hits, 0) AS hits, coalesce(priced, 0) AS priced, coalesce(no_book, 0) AS no_book, first_id, CASE WHEN c_custkey % 9 = 0 THEN 'c' || c_custkey::VARCHAR ELSE ctx END AS context
    FROM customer LEFT JOIN a ON hunt_id = c_custkey"""
)
def hunt_targets(spark, sf_dir):
    """Every target with its hits, the first of them and the context to show; targets without hits stay."""
    view = hunting.target_view(*_targets(spark, sf_dir))
    return view.select("hunt_id", "hits", "priced", "no_book", "first_id", F.col("context.k").alias("context"))


@query("SELECT (SELECT count(*) FROM customer) AS targets, count(*) FILTER (o_orderkey % 3 = 0) AS priced, count(*) FILTER (o_orderkey % 3 > 0) AS no_book FROM orders")
def hunt_strip(spark, sf_dir):
    return hunting.strip_counts(*_targets(spark, sf_dir))


# --- artifact guards ------------------------------------------------------------------------------
@query("SELECT o_orderkey AS ok, o_orderkey % 5 > 0 AND o_orderkey % 7 > 0 AND o_orderkey % 11 > 0 AND o_orderkey % 13 > 0 AS valid FROM orders")
def valid_calls(spark, sf_dir):
    """Published calls with and without a title, a date, a number; a text or a NaN is no number."""
    k = F.col("o_orderkey")
    bid = F.when(k % 11 == 0, '"12"').when(k % 13 == 0, '"NaN"').otherwise(F.col("o_totalprice").cast("string"))
    title = F.when(k % 5 > 0, '"title":"t",').otherwise("")
    end = F.when(k % 7 > 0, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise("soon")
    text = F.concat(F.lit('{"id":"i",'), title, F.lit('"endsAt":"'), end, F.lit('","currentBid":'), bid, F.lit(',"allInBid":2,"bidVsBook":0.5,"med":9,"lo":8,"hi":10.5}'))
    rows = table(spark, sf_dir, "orders").select(k.alias("ok"), F.from_json(text, f"STRUCT<{CALL}>").alias("c"))
    return rows.select("ok", artifact.valid_call(F.col("c")).alias("valid"))

"""The paged market, the sweep as a stream, the published artifact and carried calls over the given tables, with SQL."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyboard import config as C
from tallyboard.functions.text import millis
from tallyboard.operators import board, carry, identity, scoring, windows
from tallyboard.plans import tick
from tallyboard.plans.catalog import query
from tallyboard.plans.twins import AS_OF, CONF, DEPTH_SQL, cents, cents_sql, spread, table, tasks
from tallyboard.schemas import DEAL
from tallyboard.sources import artifact as published_files
from tallyboard.sources import listings as source
from tallyboard.sources import pages, scratch, split
from tallyboard.streaming import stateful

# --- the paged market: a category is a brand, newer parts have larger numbers ----------------------
_BRANDS = tuple(f"Brand#{i}" for i in range(1, 26))


def _market(spark: SparkSession, sf_dir: str) -> str:
    """A market of the parts, written as pages."""
    p = table(spark, sf_dir, "part")
    pk = F.col("p_partkey")
    option = F.when(pk % 3 == 0, "AUCTION").otherwise("FIXED_PRICE")
    rows = p.select(
        F.col("p_brand").alias("category"), F.concat(F.lit("v1|"), pk.cast("string")).alias("item_id"), F.col("p_name").alias("title"), F.col("p_retailprice").cast("double").alias("price"),
        option.alias("buying_option"), F.when(pk % 2 == 0, "2750").otherwise("3000").alias("condition_id"), (pk * 60_000).alias("created_ms"), F.when(pk % 3 == 0, pk % 500 * 3_600_000).alias("ends_ms"),
    )
    path = scratch.new_folder(spark, "market")
    pages.write_market(rows, path)
    return path


_MARKET_SQL = f"""shown AS (SELECT * FROM (SELECT p_brand AS category, 'v1|' || p_partkey::VARCHAR AS item_id, p_partkey AS pk, p_retailprice AS price, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey DESC) - 1 AS pos FROM part) WHERE pos < {pages.MOST_OFFSET})"""


@query(f"WITH {_MARKET_SQL} SELECT category, item_id, (pos // {pages.PAGE})::INTEGER AS page, pos::INTEGER AS pos, {cents_sql('price')} AS price_c FROM shown WHERE category IN ('Brand#3', 'Brand#11', 'Brand#25') AND pk % 3 <> 0 AND price >= 901.25 AND price < 1100.5")
def sweep_pages(spark, sf_dir):
    """Fixed-price listings of three categories in a price band; only these categories' pages are opened."""
    slices = [{"slice": b.lower(), "category": b} for b in _BRANDS]
    rows = pages.read_pages(spark, _market(spark, sf_dir), slices)
    rows = rows.filter(F.col("category").isin("Brand#3", "Brand#11", "Brand#25") & (F.col("buying_option") == "FIXED_PRICE") & (F.col("price") >= 901.25) & (F.col("price") < 1100.5))
    return rows.select("category", "item_id", "page", "pos", cents(F.col("price")).alias("price_c"))


#: Two categories whose market refuses some of their slices' filters.
_REFUSES = {"Brand#4": ["price_from"], "Brand#7": ["ends_before"]}
_BUDGET = 8


@query(
    f"""WITH {_MARKET_SQL}, s AS (SELECT unnest([{', '.join(f"'{b}'" for b in _BRANDS)}]) AS category),
    n AS (SELECT s.category, count(pk) AS n, least({_BUDGET}, count(pk) // {pages.PAGE} + 1, {pages.MOST_OFFSET // pages.PAGE}) AS pages FROM s LEFT JOIN shown USING (category) GROUP BY s.category),
    hit AS (SELECT category, count(*) AS listings, count(DISTINCT pos // {pages.PAGE}) AS hit_pages FROM shown JOIN n USING (category) WHERE pos < pages * {pages.PAGE} AND CASE
      WHEN replace(category, 'Brand#', '')::INTEGER % 2 = 1 THEN pk % 3 = 0 AND pk % 500 > 10 AND pk % 500 <= 300 ELSE category = 'Brand#4' OR price >= 950 END GROUP BY category)
    SELECT category AS slice, pages + CASE WHEN category IN ('Brand#4', 'Brand#7') THEN coalesce(hit_pages, 0) ELSE 0 END AS calls, coalesce(listings, 0) AS listings, category IN ('Brand#4', 'Brand#7') AND listings IS NOT NULL AS degraded
    FROM n LEFT JOIN hit USING (category)"""
)
def sweep_degraded(spark, sf_dir):
    """Calls and listings of every slice: odd brands sweep auctions that end in time, even ones dear parts; two are refused."""
    slices = [{"slice": b, "category": b} | ({"ends_after": 10 * C.HOUR_MS, "ends_before": 300 * C.HOUR_MS} if i % 2 else {"price_from": 950.75}) for i, b in enumerate(_BRANDS, 1)]
    path = _market(spark, sf_dir)
    return pages.ledger(spark, pages.read_pages(spark, path, slices, _BUDGET, _REFUSES), path, slices, _BUDGET)


@query("SELECT p_partkey, p_retailprice FROM part WHERE p_name LIKE '%widget%' AND p_partkey % 3 <> 0 AND p_brand IN ('Brand#1', 'Brand#2', 'Brand#3') AND p_retailprice >= 905 AND p_retailprice <= 1200 AND p_size % 4 < 2 ORDER BY p_partkey DESC LIMIT 50")
def search_parts(spark, sf_dir):
    """Keyword search with categories, an aspect and a price band in whole units, newest first."""
    p = table(spark, sf_dir, "part")
    pk = F.col("p_partkey")
    aspects = F.array(F.struct(F.lit("Size").alias("name"), (F.col("p_size") % 4).cast("string").alias("value")))
    rows = p.select(
        "p_partkey", "p_retailprice", F.col("p_name").alias("title"), F.col("p_brand").alias("category"), F.col("p_retailprice").alias("price"), aspects.alias("aspects"), pk.alias("listed_at"),
        F.array(F.when(pk % 3 == 0, "AUCTION").otherwise("FIXED_PRICE")).alias("buying_options"), pk.alias("item_id"),
    )
    return source.search(rows, "widget", "bin", 905.9, 1199.2, 50, ["Brand#1", "Brand#2", "Brand#3"], {"Size": ["0", "1"]}).select("p_partkey", "p_retailprice")


# --- the sweep as a stream -------------------------------------------------------------------------
_TTL = 2 * C.DAY_MS


@query(
    f"""WITH RECURSIVE e AS (SELECT event_type AS slice, user_id AS item_id, event_id AS pos, (epoch_us(ts) // 10800000000 + 1) * 10800000 AS tick_ms, epoch_us(ts) // 1000 - (event_id % 7) * 3600000 AS created_ms FROM events),
    m AS (SELECT slice, tick_ms, max(created_ms) AS newest FROM e GROUP BY slice, tick_ms),
    c AS (SELECT slice, tick_ms, max(newest) OVER (PARTITION BY slice ORDER BY tick_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS cursor FROM m),
    f AS (SELECT * FROM (SELECT e.*, row_number() OVER (PARTITION BY item_id, tick_ms ORDER BY slice, pos) AS rn FROM e JOIN c USING (slice, tick_ms) WHERE cursor IS NULL OR created_ms >= cursor) WHERE rn = 1),
    seen(item_id, tick_ms) AS (SELECT item_id, min(tick_ms) FROM f GROUP BY item_id
      UNION ALL SELECT s.item_id, min(f.tick_ms) FROM seen s JOIN f ON f.item_id = s.item_id AND f.tick_ms - s.tick_ms > {_TTL} GROUP BY s.item_id, s.tick_ms)
    SELECT item_id, slice, pos, tick_ms, created_ms FROM f JOIN seen USING (item_id, tick_ms)"""
)
def stream_sweep(spark, sf_dir):
    """Three landings of ten days of ticks through the stateful sweep, restarted from its checkpoint after each."""
    e = table(spark, sf_dir, "events")
    at = F.unix_millis(F.col("ts").cast("timestamp"))
    rows = e.select(
        F.col("event_type").alias("slice"), F.ascii("event_type").alias("slice_ord"), F.col("user_id").alias("item_id"), F.col("event_id").alias("pos"),
        ((F.floor(at / CONF.tick_ms) + 1) * CONF.tick_ms).cast("long").alias("tick_ms"), (at - F.col("event_id") % 7 * C.HOUR_MS).alias("created_ms"),
    ).withColumn("at", F.timestamp_millis("tick_ms"))
    third = F.least(F.floor((F.dayofmonth("ts") - 1) / 10), F.lit(2))
    landed = [rows.filter(third == k) for k in range(3)]
    return stateful.swept(spark, landed, scratch.new_folder(spark, "sweep"), _TTL).select("item_id", "slice", "pos", "tick_ms", "created_ms")


# --- the artifact, written and read back -------------------------------------------------------------
_ROUNDTRIP_SQL = f"""{tick._JUDGED_SQL},
deal AS (SELECT *, row_number() OVER (ORDER BY rank DESC, pk) - 1 AS pos FROM k WHERE reason IS NULL),
lack AS (SELECT *, row_number() OVER (PARTITION BY pk % 3 ORDER BY pk % 2, item_id) AS rn FROM k WHERE reason = 'noBookRow'),
hits AS (SELECT *, row_number() OVER (ORDER BY pk % 2, item_id) - 1 AS pos FROM lack WHERE rn <= 8),
verticals AS (SELECT unnest(['sports-cards', 'pokemon', 'art-editions', 'autographs', 'watches']) AS v)
SELECT 'deal' AS section, pos::INTEGER AS pos, item_id AS name, CASE WHEN conf = 'high' AND n >= 6 AND n12 >= 2 AND depth <= 0.6 THEN 'featured' ELSE 'worth-a-look' END AS detail,
  CASE WHEN pk % 4 <> 1 THEN true END AS is_new, {cents_sql('all_in')} AS amount FROM deal WHERE pos < 200
UNION ALL SELECT 'hit', pos::INTEGER, item_id, 'h' || (pk % 3)::VARCHAR, NULL, {cents_sql('all_in')} FROM hits
UNION ALL SELECT 'target', i::INTEGER, 'h' || i::VARCHAR, 'watches', NULL, NULL FROM (SELECT unnest([0, 1, 2]) AS i)
UNION ALL SELECT 'vertical', 0, v, CASE WHEN v = 'watches' THEN (SELECT count(*)::VARCHAR || '/' || count(*) FILTER (key IS NOT NULL AND med IS NOT NULL)::VARCHAR FROM k) ELSE '0/0' END, NULL,
  CASE WHEN v = 'watches' THEN (SELECT count(*) FROM k WHERE reason IS NULL) ELSE 0 END FROM verticals"""


@query(_ROUNDTRIP_SQL)
def artifact_roundtrip(spark, sf_dir):
    """Deals, hunt and counts of the tick published as one JSON document, read back by the guarded reader."""
    rows = scratch.kept(tick._judged(spark, sf_dir).withColumn("pos", F.col("pk")), "judged")
    older = F.when(F.col("pk") % 4 == 1, "2000-12-30T00:00:00Z").otherwise(AS_OF)
    deals = board.publish_deals(board.deals(rows, AS_OF, "https://example.org").withColumn("surfaced_at", older), CONF)
    best_first = [F.col("rank") * -1, F.col("pk")]
    lacking = rows.filter("gate_reason = 'noBookRow'").select(
        F.concat(F.lit("h"), (F.col("pk") % 3).cast("string")).alias("hunt_id"), F.lit(True).alias("no_book"), F.col("item_id").alias("id"), "item_id", "vertical", "title", "all_in", "price", "listed_at", F.lit(AS_OF).alias("surfaced_at"), "rank",
    )
    hits = windows.newest_per(lacking, "hunt_id", CONF.no_book_cap)
    targets = spark.createDataFrame([(f"h{i}", f"Hunt {i}", "watches", i) for i in range(3)], "id string, label string, vertical string, ord int")
    document = board.artifact(
        board.published(deals, DEAL, best_first), AS_OF, AS_OF, per_vertical_rows=board.per_vertical(rows, rows),
        hunt=(board.published(targets, "id: STRING, label: STRING, vertical: STRING", [F.col("ord")]), board.publish_hunt(hits)),
    )
    path = scratch.new_folder(spark, "board")
    document.write.text(path)
    read = published_files.read_board(spark, path)
    none = F.lit(None)
    deal = read.select(F.posexplode("deals").alias("pos", "d")).select(F.lit("deal").alias("section"), "pos", F.col("d.itemId").alias("name"), F.col("d.tier").alias("detail"), F.col("d.isNew").alias("is_new"), cents(F.col("d.allIn")).alias("amount"))
    hit = read.select(F.posexplode("hunt.deals").alias("pos", "d")).select(F.lit("hit"), "pos", "d.itemId", "d.huntId", none.cast("boolean"), cents(F.col("d.allIn")))
    target = read.select(F.posexplode("hunt.targets").alias("pos", "d")).select(F.lit("target"), "pos", "d.id", "d.vertical", none.cast("boolean"), none.cast("long"))
    counts = read.select(F.explode("perVertical").alias("v", "c")).select(F.lit("vertical"), F.lit(0), "v", F.concat_ws("/", "c.polled", "c.matched"), none.cast("boolean"), F.col("c.surfaced"))
    return deal.union(hit).union(target).union(counts)


# --- what the tick's listings give beside deals ----------------------------------------------------
@query(f"{tick._JUDGED_SQL} SELECT item_id, key FROM k WHERE key IN (SELECT key FROM book) UNION ALL SELECT item_id, key FROM k WHERE key IS NULL")
def tick_shortlist(spark, sf_dir):
    """Listings worth a second look: a key of the book, or a watch brand without reference."""
    rows = scratch.kept(tick._judged(spark, sf_dir).select("item_id", "title", "aspects", "matchers", "key", "matched"), "judged")
    known = rows.filter("matched").select(F.col("key").alias("k")).distinct()
    return board.shortlist(rows, known).select("item_id", "key")


@query(" UNION ALL ".join(f"SELECT '{v}' AS vertical, count(*) AS n FROM (SELECT p_partkey AS pk FROM part) WHERE ({key}) IS NOT NULL" for v, (_, key) in tick.TITLES.items()))
def tick_identified(spark, sf_dir):
    """Listings with a key, by vertical."""
    out, parts = None, tick._parts(spark, sf_dir)
    for v in tick.TITLES:
        rows = identity.identify(tick._titled(parts, v), F.col("matchers"), (v,)).select("key", "vertical")
        out = rows if out is None else out.unionByName(rows)
    return board.identified_counts(out)


@query(f"{tick._JUDGED_SQL} SELECT item_id, {cents_sql('all_in')} AS all_in_c, {cents_sql('med')} AS med_c FROM k WHERE med IS NOT NULL AND reason IS NOT NULL ORDER BY item_id LIMIT 5")
def tick_near_misses(spark, sf_dir):
    """First matched listings of a vertical of which nothing surfaced."""
    rows = scratch.kept(tick._judged(spark, sf_dir).select("item_id", "title", "vertical", "matched", "ladder", "all_in", "med", "depth", "gate_reason"), "judged").filter("gate_reason IS NOT NULL")
    return board.near_misses(rows, "watches", 5, ["item_id"]).select("item_id", cents(F.col("all_in")).alias("all_in_c"), cents(F.col("med")).alias("med_c"))


@query("SELECT 'r' || o_orderkey::VARCHAR AS id, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders ORDER BY o_orderdate DESC, id LIMIT 100")
def newest_receipts(spark, sf_dir):
    """The ledger as its page shows it: the newest hundred receipts."""
    rows = table(spark, sf_dir, "orders").select(F.concat(F.lit("r"), F.col("o_orderkey").cast("string")).alias("id"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("surfaced_at"))
    return carry.newest_first(rows, 100).select("id", F.substring("surfaced_at", 1, 10).alias("day"))


#: What titles say, and whether that is a flag of condition.
_SAID = tuple((w, True) for w in (
    "damaged", "Incomplete", "partial", "missing", "trimmed", "altered", "recolored", "recoloured", "restored", "rebacked", "creased", "creases", "creasing", "torn", "tear", "taped", "water damage",
    "writing on", "paper loss", "as is", "as-is", "poor condition", "heavily worn", "miscut", "detached", "hole punched", "glue", "residue", "cracked", "scratch", "scratched", "scratches", "repaired",
    "reprint", "replica", "damage", "broken",
)) + tuple((w, False) for w in ("partial refund", "miscut error", "undamaged", "tears", "brokenly", "increased", "gluten", "as"))


@query(f"SELECT p_partkey, [{', '.join(str(flag).lower() for _, flag in _SAID)}][p_partkey % {len(_SAID)} + 1] AS flagged FROM part")
def condition_words(spark, sf_dir):
    """Every wording that flags a condition, and some that look like one, planted in titles."""
    said = F.element_at(F.array(*[F.lit(w) for w, _ in _SAID]), (F.col("p_partkey") % len(_SAID) + 1).cast("int"))
    rows = table(spark, sf_dir, "part").select("p_partkey", F.concat("p_name", F.lit(", "), said, F.lit(" 1952")).alias("title"))
    return rows.select("p_partkey", scoring.has_condition_flag(F.col("title")).alias("flagged"))


# --- carried calls and unpriced hits: one row of each part, read again ---------------------------------
_READ = "CASE WHEN pk % 7 = 0 THEN 'unverified' WHEN pk % 5 = 0 THEN 'absent' ELSE 'alive' END"


def _reads(rows: DataFrame) -> DataFrame:
    """Live reads of rows (pk, r, item_id, ends_ms): by number some unread, some gone, some damaged, late or of an unknown seller."""
    pk, gone = F.col("pk"), F.col("pk") % 5 == 0
    ends = F.timestamp_millis(F.col("ends_ms") + F.when(pk % 19 == 0, 100 * C.HOUR_MS).otherwise(0))
    return rows.filter("pk % 7 > 0").select(
        "item_id", F.lit(True).alias("checked"), F.when(~gone, F.col("r") * (30 + pk % 60) / 100.0).alias("price"), F.lit(None).cast("double").alias("shipping_cost"),
        F.when(pk % 17 == 0, "torn cover").otherwise("fine").alias("title"), F.date_format(ends, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("ends_at"),
        F.when(pk % 3 > 0, pk % 9).cast("int").alias("bid_count"), F.when(pk % 23 == 0, 10).otherwise(500).cast("long").alias("seller_score"),
    )


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("pk"), F.col("p_retailprice").alias("r"), F.col("p_name").alias("title"), F.concat(F.lit("v1|"), F.col("p_partkey").cast("string")).alias("item_id"))


_CARRIED_SQL = f"""p AS (SELECT p_partkey AS pk, p_retailprice AS r, p_name AS title, 'v1|' || p_partkey::VARCHAR AS item_id FROM part),
x AS (SELECT *, {_READ} AS state, r * (30 + pk % 60) / 100.0::DOUBLE AS now_cost, 978307200000 + (pk % 10 - 2) * 3600000 AS ends_ms FROM p WHERE pk % 11 > 0)"""


@query(
    f"""WITH {_CARRIED_SQL}, y AS (SELECT *, ends_ms + CASE WHEN pk % 19 = 0 THEN 360000000 ELSE 0 END AS now_ends, now_cost AS all_in, r AS med FROM x WHERE pk % 13 > 0 AND ends_ms > 978307200000),
    z AS (SELECT *, CASE WHEN state = 'unverified' THEN 'as-was' WHEN state = 'absent' OR now_ends > 978307200000 + 259200000 OR pk % 6 = 0 OR pk % 23 = 0 OR pk % 17 = 0 OR {DEPTH_SQL} < 0.4 OR med - all_in < 50 THEN 'dropped' ELSE 'refreshed' END AS fate FROM y)
    SELECT item_id, fate, CASE WHEN fate = 'refreshed' THEN {cents_sql('all_in')} ELSE floor(r * 0.4::DOUBLE * 100 + 0.5::DOUBLE)::BIGINT END AS price_c, (CASE WHEN fate = 'refreshed' AND pk % 3 > 0 THEN pk % 9 ELSE pk % 5 END)::BIGINT AS bids,
    CASE WHEN fate = 'refreshed' THEN now_ends ELSE ends_ms END AS ends_ms FROM z"""
)
def carry_closing(spark, sf_dir):
    """Auction calls of the tick before, read again: kept as they were, refreshed or dropped."""
    pk = F.col("pk")
    rows = _parts(spark, sf_dir).withColumn("ends_ms", F.lit(CONF.now_ms) + (pk % 10 - 2) * C.HOUR_MS)
    cost = F.col("r") * 0.4
    prior = rows.select(
        "item_id", F.date_format(F.timestamp_millis("ends_ms"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("ends_at"), F.col("r").alias("med"), F.lit("2000-10-01").alias("last_sale"), F.when(pk % 6 == 0, "thin").otherwise("high").alias("conf"),
        cost.alias("price"), cost.alias("all_in"), F.lit(0.0).alias("shipping_cost"), (pk % 5).cast("int").alias("bid_count"), scoring.depth(cost, F.col("r")).alias("depth"), (F.col("r") - cost).alias("edge"),
    )
    out = carry.carry_closing(prior, rows.filter("pk % 11 = 0").select("item_id"), rows.filter("pk % 13 = 0").select("item_id"), _reads(rows), CONF)
    return out.select("item_id", "fate", cents(F.col("price")).alias("price_c"), F.col("bid_count").cast("long").alias("bids"), millis(F.col("ends_at")).alias("ends_ms"))


_TARGETS = (("h0", "widget", None, None), ("h1", "the gadget", None, "small"), ("h2", None, "ring|red", None))


@query(
    f"""WITH {_CARRIED_SQL}, y AS (SELECT *, CASE pk % 4 WHEN 0 THEN contains(title, 'widget') WHEN 1 THEN contains(title, 'gadget') AND NOT contains(title, 'small') ELSE regexp_matches(title, 'ring|red') END AS fits FROM x WHERE pk % 4 < 3)
    SELECT item_id, fate, floor(CASE WHEN fate = 'refreshed' THEN now_cost ELSE r END * 100 + 0.5::DOUBLE)::BIGINT AS price_c
    FROM (SELECT *, CASE WHEN NOT fits OR state = 'absent' THEN 'dropped' WHEN state = 'unverified' THEN 'as-was' WHEN pk % 17 = 0 THEN 'dropped' ELSE 'refreshed' END AS fate FROM y)"""
)
def carry_no_book(spark, sf_dir):
    """Unpriced hunt hits of the tick before: their target must be there and still suit them."""
    rows = _parts(spark, sf_dir).withColumn("ends_ms", F.lit(CONF.now_ms))
    prior = rows.select("item_id", "title", F.concat(F.lit("h"), (F.col("pk") % 4).cast("string")).alias("hunt_id"), F.col("r").alias("price"), F.lit(0.0).alias("shipping_cost"), F.col("r").alias("all_in"))
    targets = spark.createDataFrame([(*t, "other") for t in _TARGETS], "hunt_id string, q string, title_must string, title_not string, vertical string")
    out = carry.carry_no_book(prior, rows.filter("pk % 11 = 0").select("item_id"), targets, _reads(rows), CONF)
    return out.select("item_id", "fate", cents(F.col("price")).alias("price_c"))


# --- a large book in one document -----------------------------------------------------------------------
_COPIES = 10


@query(
    f"""WITH r AS (SELECT p_partkey * {_COPIES} + i AS pos, p_name || ' {{' || i::VARCHAR || '"}}\\' AS k, p_brand AS v, p_retailprice AS med FROM part, (SELECT unnest(range({_COPIES})) AS i))
    SELECT pos, k, v, {cents_sql('med')} AS med_c FROM r"""
)
def book_file(spark, sf_dir):
    """A book of many rows as one JSON document, written in the order of its rows, cut and read by many tasks; keys hold braces, quotes and backslashes."""
    parts = spread(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_retailprice"), "p_partkey")
    first = parts.agg(F.min("p_partkey") * _COPIES).first()[0]
    p = parts.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(_COPIES - 1))))
    pos = F.col("p_partkey") * _COPIES + F.col("i")
    row = F.struct(F.concat("p_name", F.lit(" {"), F.col("i").cast("string"), F.lit('"}\\')).alias("k"), F.col("p_brand").alias("v"), F.struct(F.lit(1).alias("depth"), F.array(F.lit("]"), F.lit("[")).alias("marks")).alias("more"), F.col("p_retailprice").cast("double").alias("med"))
    begin = '], "rows": ['
    rows = p.select(pos.alias("pos"), F.concat(F.when(pos > first, ",").otherwise(begin), F.to_json(row)).alias("value"))
    ends = spark.createDataFrame([(-1, '{"schema": 1, "gradeLadder": {"base": 1, "rungs": {"10": 2.0}}, "none": [], "context": [{"k": "c"}'), (1 << 60, (begin if first is None else "") + '], "also": [{"k": "x"}]}')], "pos long, value string")
    path = scratch.new_folder(spark, "book")
    # every text ends with a brace, which ends its line: ranges of rows are files that follow each other
    lines = rows.unionByName(ends).select("pos", F.substring("value", F.lit(1), F.length("value") - 1).alias("value"))
    lines.repartitionByRange(tasks(spark), "pos").sortWithinPartitions("pos").select("value").write.option("lineSep", "}").text(path)
    read = split.array_objects(spark, path, "rows", split=1 << 17)
    book = F.from_json("text", "k STRING, v STRING, med DOUBLE")
    return read.select("pos", book.alias("b")).select("pos", "b.k", "b.v", cents(F.col("b.med")).alias("med_c"))


# --- the carry as a stream: three ticks of the parts' listings ------------------------------------------
_PASS = "1 - c / r >= {low} AND r - c >= 50"


def _tick_sql(k: int) -> str:
    now = f"(978307200000 + {k} * 10800000)"
    return f"""
x{k} AS (SELECT * EXCLUDE (fate, tick_ms), (pk + {k}) % 13 = 0 AS fresh, r * (30 + (pk * {k}) % 60) / 100.0::DOUBLE AS c, live AND NOT (lane = 'closing' AND ends <= {now}) AS here, (pk + {k}) % 17 = 0 AS flagged FROM s{k - 1}),
f{k} AS (SELECT *, CASE WHEN fresh THEN 'fresh' WHEN NOT here THEN NULL WHEN (pk + {k}) % 7 = 0 THEN 'as-was'
  WHEN lane = 'closing' THEN CASE WHEN (pk + {k}) % 5 = 0 OR pk % 6 = 0 OR pk % 23 = 0 OR flagged OR NOT ({_PASS.format(low='0.4')}) THEN 'dropped' ELSE 'refreshed' END
  WHEN (pk + {k}) % 5 = 0 THEN 'ended' WHEN c <= all_in THEN 'refreshed'
  WHEN NOT flagged AND {_PASS.format(low="greatest(CASE WHEN pk % 10 = 0 THEN 0.35::DOUBLE ELSE 0.25 END, CASE WHEN pk % 6 = 0 THEN 0.4 ELSE 0 END)")} AND 1 - c / r <= 0.9 THEN 're-gated' ELSE 'dropped' END AS fate FROM x{k}),
s{k} AS (SELECT pk, r, lane, ends, coalesce(fate IN ('fresh', 'as-was', 'refreshed', 're-gated'), false) AS live, CASE WHEN fate = 'fresh' THEN r * 0.5::DOUBLE WHEN fate IN ('refreshed', 're-gated') THEN c ELSE all_in END AS all_in,
  CASE WHEN fate = 'fresh' AND NOT here THEN {now} ELSE surfaced END AS surfaced, fate, {now} AS tick_ms FROM f{k})"""


@query(
    f"""WITH s0 AS (SELECT p_partkey AS pk, p_retailprice AS r, CASE WHEN p_partkey % 3 = 0 THEN 'closing' ELSE 'deal' END AS lane, 978307200000 + (p_partkey % 10 + 1) * 3600000 AS ends, true AS live, p_retailprice * 0.4::DOUBLE AS all_in,
      978307200000 AS surfaced, 'fresh' AS fate, 978307200000 AS tick_ms FROM part),{_tick_sql(1)},{_tick_sql(2)}
    SELECT 'v1|' || pk::VARCHAR AS item_id, lane, tick_ms, fate, {cents_sql('all_in')} AS all_in_c, surfaced AS surfaced_ms
    FROM (SELECT pk, lane, tick_ms, fate, all_in, surfaced FROM s0 UNION ALL SELECT pk, lane, tick_ms, fate, all_in, surfaced FROM s1 UNION ALL SELECT pk, lane, tick_ms, fate, all_in, surfaced FROM s2) WHERE fate IS NOT NULL"""
)
def stream_carry(spark, sf_dir):
    """Deals and calls through three ticks of the carry stream, restarted from its checkpoint after each."""
    p, pk = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("pk"), F.col("p_retailprice").alias("r")), F.col("pk")
    ticks = []
    for k in range(3):
        now = CONF.now_ms + k * CONF.tick_ms
        fresh = F.lit(True) if k == 0 else (pk + k) % 13 == 0
        read = F.when((pk + k) % 5 > 0, F.col("r") * (30 + (pk * k) % 60) / 100.0)
        ticks.append(p.select(
            F.concat(F.lit("v1|"), pk.cast("string")).alias("item_id"), F.when(pk % 3 == 0, "closing").otherwise("deal").alias("lane"), F.when(fresh, "fresh").otherwise("read").alias("kind"),
            F.lit(now).cast("long").alias("tick_ms"), F.timestamp_millis(F.lit(now)).alias("at"), (fresh | ((pk + k) % 7 > 0)).alias("checked"), F.when(fresh, F.col("r") * (0.4 if k == 0 else 0.5)).otherwise(read).alias("cost"),
            ((pk + k) % 17 == 0).alias("flagged"), (F.lit(CONF.now_ms) + (pk % 10 + 1) * C.HOUR_MS).cast("long").alias("ends_ms"), F.when(pk % 23 == 0, 10).otherwise(500).cast("long").alias("seller_score"),
            F.col("r").cast("double").alias("med"), F.lit(CONF.now_ms - 30 * C.DAY_MS).cast("long").alias("last_sale_ms"), (pk % 6 == 0).alias("thin"), (pk % 10 == 0).alias("ladder"), F.lit(now).cast("long").alias("surfaced_ms"),
        ))
    out = stateful.carried(spark, ticks, scratch.new_folder(spark, "carry"), CONF)
    return out.select("item_id", "lane", "tick_ms", "fate", cents(F.col("all_in")).alias("all_in_c"), "surfaced_ms")

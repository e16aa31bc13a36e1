"""Board queries by name, each with DuckDB SQL for the same rows.

Money leaves as whole cents and shares as basis points, so both engines give the same integers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyboard import config as C
from tallyboard.functions import display as D
from tallyboard.functions import text as T
from tallyboard.operators import board, budget, carry, gates, identity, pricing, scoring, windows
from tallyboard.plans.twins import AS_OF, BOOK_SQL, CONF, CONF_SQL, DEPTH_SQL, EVIDENCE_SQL, FRESH_SQL, LISTING_SQL, REASON_SQL, RUNGS, book, cents, cents_sql, listings, mills, mills_sql, ms, table
from tallyboard.streaming import sweep

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _priced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings joined to the book, with depth, edge, reason, evidence and rank (without risk)."""
    b = book(spark, sf_dir).withColumnRenamed("last_ms", "book_ms")
    rows = pricing.with_book(listings(spark, sf_dir), b)
    rows = rows.withColumn("book_ms", F.unix_millis(F.try_to_timestamp("last_sale")))
    none = F.lit(False)
    deep = scoring.depth(F.col("all_in"), F.col("med"))
    reason = F.when(~F.col("matched"), "noBookRow").otherwise(gates.histogram_name(gates.gate(F.col("all_in"), F.col("med"), F.col("book_ms"), none, F.col("conf") == "thin", CONF)))
    evidence = scoring.evidence_weight(F.col("book_ms"), F.col("n12"), CONF.now_ms)
    fresh = scoring.fresh_boost(F.col("created_ms"), CONF)
    rank = (F.col("med") - F.col("all_in")) * deep * T.label_of(F.col("conf"), C.CONFIDENCE_WEIGHT) * evidence * fresh
    return rows.withColumns({"depth": deep, "edge": F.col("med") - F.col("all_in"), "reason": reason, "evidence": evidence, "fresh": fresh, "rank": rank})


_PRICED_SQL = f"""WITH {BOOK_SQL}, {LISTING_SQL},
priced AS (SELECT listing.*, book.k, book.med, book.lo, book.hi, book.n, book.n12, book.last_ms, book.last_ts, book.conf FROM listing LEFT JOIN book ON listing.key = book.k),
judged AS (SELECT *, {DEPTH_SQL} AS depth, med - all_in AS edge, {REASON_SQL} AS reason, {EVIDENCE_SQL} AS evidence, {FRESH_SQL} AS fresh FROM priced),
ranked AS (SELECT *, edge * depth * {CONF_SQL} * evidence * fresh AS rank FROM judged)"""


# --- book, gates, board -------------------------------------------------------------------------
@query(f"WITH {BOOK_SQL} SELECT k, v, {mills_sql('med')} AS med_m, {mills_sql('lo')} AS lo_m, {mills_sql('hi')} AS hi_m, n, n12, last_ts, conf FROM book")
def value_book(spark, sf_dir):
    return book(spark, sf_dir).select("k", "v", mills(F.col("med")).alias("med_m"), mills(F.col("lo")).alias("lo_m"), mills(F.col("hi")).alias("hi_m"), "n", "n12", "last_ts", "conf")


@query(f"WITH {BOOK_SQL} SELECT v AS vertical, count(*) AS n FROM book GROUP BY v")
def book_by_vertical(spark, sf_dir):
    from tallyboard.sources.book import per_vertical

    return per_vertical(book(spark, sf_dir))


@query(
    f"""{_PRICED_SQL} SELECT order_key, line, key, {cents_sql('all_in')} AS all_in_c, {cents_sql('med')} AS med_c, floor(depth * 10000 + 0.5::DOUBLE)::BIGINT AS depth_bp, {cents_sql('rank')} AS rank_c
    FROM ranked WHERE reason IS NULL ORDER BY rank DESC, order_key, line, key, all_in LIMIT 200"""
)
def flagship_board(spark, sf_dir):
    """The board: listings joined to the book, gated, ranked, best 200."""
    rows = _priced(spark, sf_dir).filter(F.col("reason").isNull())
    best = windows.top(rows, [F.col("rank").desc(), F.col("order_key"), F.col("line"), F.col("key"), F.col("all_in")], CONF.board_cap)
    return best.select("order_key", "line", "key", cents(F.col("all_in")).alias("all_in_c"), cents(F.col("med")).alias("med_c"), F.floor(F.col("depth") * 10000 + 0.5).cast("long").alias("depth_bp"), cents(F.col("rank")).alias("rank_c"))


@query(f"{_PRICED_SQL} SELECT order_key, line, key, {cents_sql('all_in')} AS all_in_c, coalesce(reason, 'pass') AS reason FROM ranked")
def gate_reasons(spark, sf_dir):
    return _priced(spark, sf_dir).select("order_key", "line", "key", cents(F.col("all_in")).alias("all_in_c"), F.coalesce("reason", F.lit("pass")).alias("reason"))


@query(f"{_PRICED_SQL} SELECT flag AS vertical, reason, count(*) AS n FROM ranked WHERE reason IS NOT NULL GROUP BY ALL")
def gate_reason_histogram(spark, sf_dir):
    rows = _priced(spark, sf_dir).withColumn("vertical", F.col("flag")).withColumn("gate_reason", F.col("reason"))
    return board.reason_counts(rows)


@query(f"{_PRICED_SQL} SELECT reason, count(*) AS n FROM ranked WHERE reason IS NOT NULL GROUP BY reason")
def flat_gate_reasons(spark, sf_dir):
    return board.flat_reasons(gate_reason_histogram(spark, sf_dir))


@query(
    f"""{_PRICED_SQL} SELECT order_key, line, key, floor(depth * 10000 + 0.5::DOUBLE)::BIGINT AS depth_bp, {cents_sql('edge')} AS edge_c, floor(evidence * 10000 + 0.5::DOUBLE)::BIGINT AS evidence_bp,
    fresh > 1 AS fresh, {cents_sql('rank')} AS rank_c, {cents_sql('all_in')} AS all_in_c FROM ranked WHERE med IS NOT NULL"""
)
def rank_components(spark, sf_dir):
    rows = _priced(spark, sf_dir).filter("matched")
    return rows.select("order_key", "line", "key", F.floor(F.col("depth") * 10000 + 0.5).cast("long").alias("depth_bp"), cents(F.col("edge")).alias("edge_c"), F.floor(F.col("evidence") * 10000 + 0.5).cast("long").alias("evidence_bp"), (F.col("fresh") > 1).alias("fresh"), cents(F.col("rank")).alias("rank_c"), cents(F.col("all_in")).alias("all_in_c"))


# --- joins --------------------------------------------------------------------------------------
_DROPPED = "part % 3 = 0 AND v = 'N'"


@query(
    f"""WITH {BOOK_SQL}, {LISTING_SQL}, own AS (SELECT * FROM book WHERE NOT ({_DROPPED})),
    rung AS (SELECT * FROM (VALUES ('A', 1.6::DOUBLE), ('N', 1.0::DOUBLE), ('R', 0.7::DOUBLE)) r(flag, mult)),
    best AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY n DESC, k) AS rn FROM own)
    SELECT l.order_key, l.line, l.key, {cents_sql('l.all_in')} AS all_in_c, b.k AS basis_key, floor(b.med * (r.mult / s.mult) + 0.5::DOUBLE)::BIGINT AS med,
      floor(b.lo * (r.mult / s.mult) + 0.5::DOUBLE)::BIGINT AS lo, floor(b.hi * (r.mult / s.mult) + 0.5::DOUBLE)::BIGINT AS hi
    FROM listing l LEFT JOIN own o ON l.key = o.k JOIN best b ON b.part = l.part AND b.rn = 1 JOIN rung r ON r.flag = l.flag JOIN rung s ON s.flag = b.v WHERE o.k IS NULL"""
)
def ladder_price(spark, sf_dir):
    """Listings whose own grade the book lacks, priced from another grade of the part."""
    own = book(spark, sf_dir).filter(~((F.substring_index("k", "|", 1).cast("long") % 3 == 0) & (F.col("v") == "N")))
    # the flag as a grade of one grader, in such an order that keys sort as the flags do
    grade = {"A": "PSA10", "N": "PSA8", "R": "PSA9"}
    rungs = spark.createDataFrame([(grade[f][3:], m) for f, m in RUNGS], "rung string, mult double")

    def graded(flag):
        return T.label_of(flag, grade)

    graded_book = own.withColumn("k", F.concat(F.substring_index("k", "|", 1), F.lit("|"), graded(F.col("v")))).withColumn("flag_key", F.lit(None).cast("string")).withColumn("v", F.lit("sports-cards"))
    rows = listings(spark, sf_dir).withColumn("vertical", F.lit("sports-cards")).withColumn("flag_key", F.col("key")).withColumn("key", F.concat(F.substring_index("key", "|", 1), F.lit("|"), graded(F.col("flag"))))
    back = {to: flag for flag, to in grade.items()}
    out = pricing.with_ladder(pricing.with_book(rows, graded_book), graded_book, rungs).filter("ladder")
    basis = F.concat(F.substring_index("basis_key", "|", 1), F.lit("|"), T.label_of(F.substring_index("basis_key", "|", -1), back))
    return out.select("order_key", "line", F.col("flag_key").alias("key"), cents(F.col("all_in")).alias("all_in_c"), basis.alias("basis_key"), F.col("med").cast("long").alias("med"), F.col("lo").cast("long").alias("lo"), F.col("hi").cast("long").alias("hi"))


@query(
    f"""WITH {BOOK_SQL}, {LISTING_SQL}, roll AS (SELECT p_brand, median(l_extendedprice) AS med FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_shipdate < TIMESTAMP '2001-01-01' GROUP BY p_brand)
    SELECT l.item_id, l.line, p.p_brand AS brand, {cents_sql('l.all_in')} AS all_in_c, floor(l.all_in / roll.med * 10000 + 0.5::DOUBLE)::BIGINT AS ratio_bp
    FROM listing l JOIN part p ON l.part = p.p_partkey JOIN roll USING (p_brand) WHERE NOT EXISTS (SELECT 1 FROM book b WHERE b.k = l.key) AND l.all_in <= 0.5 * roll.med
    ORDER BY l.all_in / roll.med, l.item_id, l.all_in LIMIT 20"""
)
def context_leads(spark, sf_dir):
    """Listings without a book row, at or below half their brand's median."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), F.col("p_brand").alias("brand"))
    past = table(spark, sf_dir, "lineitem").filter(F.col("l_shipdate") < F.lit(AS_OF).cast("timestamp_ntz"))
    roll = past.join(part, past["l_partkey"] == part["part"]).groupBy("brand").agg(F.median("l_extendedprice").alias("roll"))
    rows = pricing.with_book(listings(spark, sf_dir), book(spark, sf_dir)).filter(~F.col("matched")).join(part, "part").join(roll, "brand")
    rows = rows.withColumn("ratio", F.try_divide("all_in", "roll")).filter(F.col("all_in") <= CONF.lead_ratio * F.col("roll"))
    best = windows.top(rows, [F.col("ratio"), F.col("item_id"), F.col("all_in")], CONF.leads_cap)
    return best.select("item_id", "line", "brand", cents(F.col("all_in")).alias("all_in_c"), F.floor(F.col("ratio") * 10000 + 0.5).cast("long").alias("ratio_bp"))


@query(
    f"""WITH {LISTING_SQL}, placed AS (SELECT item_id, part, flag, {cents_sql('all_in')} AS all_in_c, replace(p_brand, 'Brand#', '')::INTEGER % 15 + 1 AS slice_ord
      FROM listing JOIN part ON part = p_partkey)
    SELECT item_id, slice_ord, part, flag, all_in_c FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY slice_ord, part, flag, all_in_c) AS rn FROM placed) WHERE rn = 1"""
)
def dedupe_first_slice(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), (F.replace("p_brand", F.lit("Brand#"), F.lit("")).cast("int") % 15 + 1).alias("slice_ord"))
    rows = listings(spark, sf_dir).join(part, "part").select("item_id", "slice_ord", "part", "flag", cents(F.col("all_in")).alias("all_in_c"))
    return windows.first_wins(rows, ["item_id"], [F.col(c) for c in ("slice_ord", "part", "flag", "all_in_c")])


@query(
    f"""{_PRICED_SQL}, hits AS (SELECT item_id, supplier % 7 AS entry_ord, part, flag, {cents_sql('all_in')} AS all_in_c, reason IS NULL AS kept FROM ranked),
    first AS (SELECT *, min((entry_ord, part, flag, all_in_c)) FILTER (kept) OVER (PARTITION BY item_id) AS f FROM hits)
    SELECT item_id, entry_ord, part, flag, all_in_c, CASE WHEN f IS NOT NULL AND (entry_ord, part, flag, all_in_c) = f THEN 'claimed' WHEN f IS NULL OR (entry_ord, part, flag, all_in_c) < f THEN 'counted' ELSE 'skipped' END AS fate FROM first"""
)
def hunt_claim(spark, sf_dir):
    """Entries ask in order; the first that keeps an item claims it."""
    rows = _priced(spark, sf_dir).select("item_id", (F.col("supplier") % 7).alias("entry_ord"), "part", "flag", cents(F.col("all_in")).alias("all_in_c"), F.col("reason").isNull().alias("kept"))
    hits = rows.withColumn("pos", F.struct("part", "flag", "all_in_c"))
    return windows.claim(hits).select("item_id", "entry_ord", "part", "flag", "all_in_c", "fate")


_PREFIXES = ("red", "small", "blue w", "large", "gre")


@query(
    "WITH e AS (SELECT * FROM (VALUES " + ", ".join(f"('h{i}', '{p}')" for i, p in enumerate(_PREFIXES, 1)) + """) e(hunt_id, key_prefix)),
    b AS (SELECT p_name || '|' || p_partkey::VARCHAR AS k, p_retailprice AS med FROM part)
    SELECT hunt_id, k, place::INTEGER AS place FROM (SELECT hunt_id, k, row_number() OVER (PARTITION BY hunt_id ORDER BY med DESC, k) AS place FROM e JOIN b ON starts_with(k, key_prefix)) WHERE place <= 8"""
)
def keyprefix_topk(spark, sf_dir):
    entries = spark.createDataFrame([(f"h{i}", p) for i, p in enumerate(_PREFIXES, 1)], "hunt_id string, key_prefix string")
    rows = table(spark, sf_dir, "part").select(F.concat("p_name", F.lit("|"), F.col("p_partkey").cast("string")).alias("k"), F.col("p_retailprice").alias("med"))
    return pricing.prefix_rows(entries, rows, CONF)


@query(
    f"""WITH {BOOK_SQL}, {LISTING_SQL}, calls AS (
      SELECT listing.*, med, last_ms, conf, k, 978307200000 + (order_key % 12) * 1800000 - 3600000 AS ends_ms, supplier % 100 AS seller FROM listing JOIN book ON key = k),
    judged AS (SELECT *, CASE WHEN NOT all_in > 0 THEN 'noBid' WHEN NOT med > 0 THEN 'noPrice' WHEN ends_ms <= 978307200000 OR ends_ms > 978307200000 + 14400000 THEN 'endWindow' WHEN conf = 'thin' THEN 'thinBook'
      WHEN 978307200000 - last_ms > 24.0::DOUBLE * (30.44::DOUBLE * 86400000) THEN 'staleBook' WHEN seller < 50 THEN 'sellerFloor' WHEN {DEPTH_SQL} < 0.4 THEN 'tooShallow' WHEN med - all_in < 50 THEN 'edgeFloor' END AS reason FROM calls)
    SELECT order_key, line, key, ends_ms, {cents_sql('all_in')} AS all_in_c, coalesce(reason, 'pass') AS reason FROM judged"""
)
def closing_gate(spark, sf_dir):
    return _closing(spark, sf_dir).select("order_key", "line", "key", "ends_ms", cents(F.col("all_in")).alias("all_in_c"), F.coalesce("reason", F.lit("pass")).alias("reason"))


def _closing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pricing.with_book(listings(spark, sf_dir), book(spark, sf_dir)).filter("matched")
    rows = rows.withColumn("ends_ms", F.lit(CONF.now_ms) + (F.col("order_key") % 12) * 1_800_000 - C.HOUR_MS)
    sale = F.unix_millis(F.try_to_timestamp("last_sale"))
    reason = gates.closing_gate(F.col("all_in"), F.col("ends_ms"), F.col("med"), sale, F.col("conf") == "thin", F.col("supplier") % 100, F.lit(False), CONF)
    return rows.withColumn("reason", gates.histogram_name(reason))


_CLOSING_CALLS_SQL = ORACLE_SQL["closing_gate"].rsplit("SELECT order_key", 1)[0] + "SELECT order_key, line, key, ends_ms, floor(all_in * 100 + 0.5::DOUBLE)::BIGINT AS all_in_c FROM judged WHERE reason IS NULL ORDER BY ends_ms, item_id, key, all_in LIMIT 30"


@query(_CLOSING_CALLS_SQL)
def closing_calls(spark, sf_dir):
    rows = _closing(spark, sf_dir).filter(F.col("reason").isNull())
    return windows.top(rows, [F.col(c) for c in ("ends_ms", "item_id", "key", "all_in")], CONF.closing_cap).select("order_key", "line", "key", "ends_ms", cents(F.col("all_in")).alias("all_in_c"))


@query(
    f"""WITH {BOOK_SQL}, {LISTING_SQL}, h AS (SELECT listing.*, med, conf, CASE WHEN line % 2 = 0 THEN 60000.0::DOUBLE END AS ceiling, CASE WHEN line % 3 = 0 THEN 0.1::DOUBLE END AS low FROM listing LEFT JOIN book ON key = k)
    SELECT order_key, line, key, {cents_sql('all_in')} AS all_in_c, coalesce(CASE WHEN NOT all_in > 0 THEN 'noPrice' WHEN all_in > ceiling THEN 'maxAllIn' WHEN med IS NULL THEN NULL WHEN NOT med > 0 THEN 'noPrice' WHEN {DEPTH_SQL} > 0.9 THEN 'scamCap'
      WHEN {DEPTH_SQL} < greatest(coalesce(low, 0.25::DOUBLE), CASE WHEN conf = 'thin' THEN 0.4::DOUBLE ELSE 0 END) THEN 'tooShallow' END, 'pass') AS reason FROM h"""
)
def hunt_gate(spark, sf_dir):
    rows = pricing.with_book(listings(spark, sf_dir), book(spark, sf_dir))
    ceiling, low = F.when(F.col("line") % 2 == 0, 60000.0), F.when(F.col("line") % 3 == 0, 0.1)
    reason = gates.hunt_gate(F.col("all_in"), F.col("med"), F.lit(False), F.col("conf") == "thin", ceiling, low, CONF)
    return rows.select("order_key", "line", "key", cents(F.col("all_in")).alias("all_in_c"), F.coalesce(gates.histogram_name(reason), F.lit("pass")).alias("reason"))


_HUNTS = (("h1", "red widget", None, None), ("h2", "the small", None, "ring"), ("h3", "a blue gadget", "gad", None), ("h4", "large", None, None))


@query(
    "WITH e AS (SELECT * FROM (VALUES " + ", ".join("(" + ", ".join("NULL" if v is None else f"'{v}'" for v in h) + ")" for h in _HUNTS) + """) e(hunt_id, q, must, unwanted)),
    t AS (SELECT *, list_filter(string_split(lower(q), ' '), lambda w: w NOT IN ('', 'the', 'a', 'an', 'and', 'of', 'for', 'with')) AS ws FROM e)
    SELECT p_partkey, hunt_id FROM part, t WHERE len(list_filter(ws, lambda w: NOT contains(lower(p_name), w))) = 0 AND (must IS NULL OR regexp_matches(p_name, must, 'i')) AND (unwanted IS NULL OR NOT regexp_matches(p_name, unwanted, 'i'))"""
)
def hunt_relevance(spark, sf_dir):
    """Which parts suit which hunt entries; the few entries are an array on each row, not a join."""
    entry = F.array(*[F.struct(F.lit(i).alias("hunt_id"), F.lit(q).alias("q"), F.lit(m).cast("string").alias("must"), F.lit(n).cast("string").alias("unwanted")) for i, q, m, n in _HUNTS])
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_name", F.explode(entry).alias("e"))
    fits = pricing.relevant(F.col("p_name"), F.col("e.q"), F.col("e.must"), F.col("e.unwanted"), F.lit("other"))
    return rows.filter(fits).select("p_partkey", "e.hunt_id")


# --- scores -------------------------------------------------------------------------------------
_RISK_SQL = """WITH s AS (SELECT l_orderkey AS order_key, l_linenumber AS line, l_partkey AS part, s_suppkey AS supplier, s_acctbal AS bal, l_quantity::BIGINT AS quantity, l_returnflag AS flag, l_linestatus AS status FROM lineitem JOIN supplier ON l_suppkey = s_suppkey),
p AS (SELECT *, CASE flag WHEN 'A' THEN 'slab-claimed' WHEN 'N' THEN 'papers' ELSE 'raw' END AS anchor, 88 + bal / 10000 * 12 AS pct, supplier * 25 AS score_n, CASE status WHEN 'F' THEN 'BUSINESS' ELSE 'INDIVIDUAL' END AS account, quantity % 8 AS aspects FROM s),
q AS (SELECT *, (CASE anchor WHEN 'raw' THEN 5 ELSE 25 END) + (CASE WHEN pct >= 99.5 THEN 15 WHEN pct >= 98 THEN 12 WHEN pct >= 95 THEN 8 WHEN pct >= 90 THEN 4 ELSE 0 END)
  + (CASE WHEN score_n >= 1000 THEN 10 WHEN score_n >= 100 THEN 8 WHEN score_n >= 10 THEN 4 WHEN score_n >= 1 THEN 2 ELSE 0 END) + (CASE account WHEN 'BUSINESS' THEN 5 ELSE 2 END)
  + (CASE WHEN aspects >= 6 THEN 14 WHEN aspects >= 3 THEN 9 WHEN aspects >= 1 THEN 4 ELSE 0 END) + (CASE WHEN quantity % 3 = 0 THEN 0 ELSE 6 END) + 10 AS score FROM p)
SELECT order_key, line, part, supplier, quantity, score::BIGINT AS score, CASE WHEN score >= 80 THEN 'A' WHEN score >= 60 THEN 'B' WHEN score >= 40 THEN 'C' ELSE 'D' END AS grade FROM q"""


@query(_RISK_SQL)
def risk_grade(spark, sf_dir):
    """Risk over line items: the flag as anchor, the supplier as seller, the quantity as aspects."""
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    anchor = T.label_of(F.col("l_returnflag"), {"A": "slab-claimed", "N": "papers"}, "raw")
    quantity = F.col("l_quantity").cast("long")
    none = F.lit(None).cast("string")
    risk = scoring.risk_score(
        F.lit("sports-cards"), anchor, none, none, 88 + F.col("s_acctbal") / 10000 * 12, F.col("s_suppkey") * 25, F.when(F.col("l_linestatus") == "F", "BUSINESS").otherwise("INDIVIDUAL"),
        quantity % 8, F.lit(True), F.when(quantity % 3 != 0, "image"), F.array().cast("array<string>"),
    )
    return rows.select(F.col("l_orderkey").alias("order_key"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), F.col("s_suppkey").alias("supplier"), quantity.alias("quantity"), risk.alias("r")).select("order_key", "line", "part", "supplier", "quantity", "r.score", "r.grade")


@query(
    f"""{_PRICED_SQL} SELECT order_key, line, key, {cents_sql('all_in')} AS all_in_c, CASE WHEN supplier % 9 = 0 OR NOT ((conf = 'high' AND n >= 6 AND n12 >= 2) OR (supplier % 5 = 0 AND supplier % 4 = 0)) OR depth < 0.25 OR (depth > 0.6 AND supplier % 4 <> 0) THEN 'worth-a-look' ELSE 'featured' END AS tier
    FROM ranked WHERE reason IS NULL"""
)
def tiers(spark, sf_dir):
    rows = _priced(spark, sf_dir).filter(F.col("reason").isNull())
    grade = F.when(F.col("supplier") % 5 == 0, "A").otherwise("B")
    tier = scoring.tier(F.col("depth"), F.col("conf"), F.col("n"), F.col("n12"), grade, F.col("supplier") % 4 == 0, F.col("supplier") % 9 == 0, CONF)
    return rows.select("order_key", "line", "key", cents(F.col("all_in")).alias("all_in_c"), tier.alias("tier"))


_POOL_SQL = f"""WITH {BOOK_SQL}, pool AS (SELECT k, med, med * {EVIDENCE_SQL} AS score FROM book WHERE conf <> 'thin' AND med >= 200 AND 978307200000 - last_ms <= 12.0::DOUBLE * (30.44::DOUBLE * 86400000) ORDER BY score DESC, k LIMIT 4000)"""


def _pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.top(scoring.goldmine_score(book(spark, sf_dir), CONF), [F.col("score").desc(), F.col("k")], CONF.goldmine_pool)


@query(f"{_POOL_SQL} SELECT k, {cents_sql('score')} AS score_c FROM pool")
def goldmine_pool(spark, sf_dir):
    return _pool(spark, sf_dir).select("k", cents(F.col("score")).alias("score_c"))


@query(f"{_POOL_SQL}, r AS (SELECT k, row_number() OVER (ORDER BY score DESC, k) - 1 AS rn, count(*) OVER () AS n FROM pool), s AS (SELECT *, (978307200000 // 10800000) * least(91, n) % n AS start FROM r) SELECT k, ((rn - start + n) % n)::INTEGER AS place FROM s WHERE (rn - start + n) % n < least(91, n)")
def rotation_window(spark, sf_dir):
    """This tick's 91 keys of the goldmine pool."""
    return windows.goldmine_window(_pool(spark, sf_dir), 91, CONF).select("k", F.col("place").cast("int").alias("place"))


_LEDGER_SQL = "WITH ledger AS (SELECT o_orderkey AS ord, 'r' || o_orderkey::VARCHAR AS id, 'i' || (o_orderkey % 5000)::VARCHAR AS item_id, CASE o_orderstatus WHEN 'O' THEN 'live' WHEN 'F' THEN 'sold' ELSE 'ended' END AS outcome, o_totalprice AS med, CASE WHEN o_custkey % 4 <> 0 THEN o_totalprice * (0.5::DOUBLE + (o_custkey % 100) / 100.0::DOUBLE) END AS final_price, o_orderdate AS surfaced FROM orders)"


def _ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    final = F.when(F.col("o_custkey") % 4 != 0, F.col("o_totalprice") * (0.5 + (F.col("o_custkey") % 100) / 100.0))
    return o.select(F.col("o_orderkey").alias("ord"), F.concat(F.lit("r"), F.col("o_orderkey").cast("string")).alias("id"), F.concat(F.lit("i"), (F.col("o_orderkey") % 5000).cast("string")).alias("item_id"), T.label_of(F.col("o_orderstatus"), {"O": "live", "F": "sold"}, "ended").alias("outcome"), F.col("o_totalprice").alias("med"), final.alias("final_price"), F.col("o_orderdate").alias("surfaced"))


@query(f"{_LEDGER_SQL}, live AS (SELECT *, row_number() OVER (ORDER BY ord) - 1 AS rn, count(*) OVER () AS n FROM ledger WHERE outcome = 'live'), p AS (SELECT id, (rn - (978307200000 // 10800000) % n + n) % n AS place FROM live) SELECT id, place::INTEGER AS place FROM p WHERE place < 60")
def receipts_window(spark, sf_dir):
    return windows.receipts_window(_ledger(spark, sf_dir), CONF).select("id", F.col("place").cast("int").alias("place"))


@query(f"{_LEDGER_SQL} SELECT count(*) AS total, count(*) FILTER (outcome = 'sold') AS sold, floor(count(*) FILTER (outcome = 'sold') * 100.0::DOUBLE / count(*) + 0.5::DOUBLE)::BIGINT AS sold_pct, count(*) FILTER (outcome = 'live') AS live, floor(median(final_price / med) FILTER (outcome = 'sold' AND med > 0) * 10000 + 0.5::DOUBLE)::BIGINT AS median_bp FROM ledger")
def tape_summary(spark, sf_dir):
    out = carry.tape_summary(_ledger(spark, sf_dir))
    return out.select("total", "sold", "sold_pct", "live", F.floor(F.col("median_final") * 10000 + 0.5).cast("long").alias("median_bp"))


_PER_RUN = f"floor(({budget.DAILY} - floor({budget.DAILY} * {budget.HUNT_SHARE}::DOUBLE)) / {budget.RUNS})"


@query(
    f"""WITH plan AS (SELECT p_brand AS slice, CASE min(p_partkey) % 3 WHEN 0 THEN 'auction' WHEN 1 THEN 'cards' ELSE 'other' END AS lane FROM part GROUP BY p_brand),
    has AS (SELECT count(*) FILTER (lane = 'auction') > 0 AS auctions, count(*) FILTER (lane = 'cards') > 0 AS cards FROM plan),
    a AS (SELECT *, floor({_PER_RUN} * {budget.AUCTION_SHARE}::DOUBLE) * auctions::INTEGER AS auction FROM has),
    g AS (SELECT *, floor(({_PER_RUN} - auction) * {budget.GOLDMINE_SHARE}::DOUBLE) AS goldmine FROM a),
    c AS (SELECT *, {_PER_RUN} - auction - goldmine AS bin, floor(({_PER_RUN} - auction - goldmine) * {budget.CARDS_SHARE}::DOUBLE) * cards::INTEGER AS for_cards FROM g)
    SELECT slice, floor(CASE lane WHEN 'auction' THEN auction WHEN 'cards' THEN for_cards ELSE bin - for_cards END / count(*) OVER (PARTITION BY lane))::INTEGER AS pages, goldmine::INTEGER AS goldmine FROM plan, c"""
)
def budget_allocation(spark, sf_dir):
    """Pages of each brand's slice this run; a brand's first part decides on its lane."""
    lane = F.min("p_partkey") % 3
    plan = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("slice")).agg(F.when(lane == 0, "auction").when(lane == 1, "cards").otherwise("other").alias("lane"))
    out = budget.allocate(plan)
    return out.select("slice", F.col("pages").cast("int").alias("pages"), F.col("goldmine").cast("int").alias("goldmine"))


# --- state --------------------------------------------------------------------------------------
_TICKS_SQL = f"""WITH {BOOK_SQL}, tick AS (
  SELECT 'i' || l_partkey::VARCHAR || l_returnflag AS item_id, l_partkey::VARCHAR || '|' || l_returnflag AS key, l_shipdate < TIMESTAMP '2001-02-01' AS prior, min(l_extendedprice * (1 - l_discount)) AS price
  FROM lineitem WHERE l_shipdate >= TIMESTAMP '2001-01-01' AND l_shipdate < TIMESTAMP '2001-03-01' GROUP BY ALL),
before AS (SELECT item_id, key, price AS was, med, last_ms, conf, k FROM tick JOIN book ON key = k WHERE prior),
fresh AS (SELECT item_id FROM tick WHERE NOT prior AND split_part(key, '|', 1)::BIGINT % 5 = 0),
reads AS (SELECT item_id, price AS now FROM tick WHERE NOT prior AND split_part(key, '|', 1)::BIGINT % 5 <> 0)"""


def _ticks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(prior deals, fresh items, live reads) from two months of shipments."""
    rows = table(spark, sf_dir, "lineitem").filter((F.col("l_shipdate") >= F.lit(AS_OF).cast("timestamp_ntz")) & (F.col("l_shipdate") < F.lit("2001-03-01").cast("timestamp_ntz")))
    price = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    part, flag = F.col("l_partkey"), F.col("l_returnflag")
    ticks = rows.groupBy(part.alias("part"), F.concat(F.lit("i"), part.cast("string"), flag).alias("item_id"), F.concat(part.cast("string"), F.lit("|"), flag).alias("key"), (F.col("l_shipdate") < F.lit("2001-02-01").cast("timestamp_ntz")).alias("prior")).agg(F.min(price).alias("price"))
    none = F.lit(None).cast("string")
    prior = pricing.with_book(ticks.filter("prior"), book(spark, sf_dir)).filter("matched").select(
        "item_id", "key", "part", "price", F.lit(0.0).alias("shipping_cost"), F.col("price").alias("all_in"), "med", "n12", "last_sale", "conf", F.lit("B").alias("risk_grade"), F.lit(False).alias("ladder"),
        scoring.depth(F.col("price"), F.col("med")).alias("depth"), (F.col("med") - F.col("price")).alias("edge"), F.lit(0.0).alias("rank"), none.alias("listed_at"),
    )
    later = ticks.filter("NOT prior")
    fresh = later.filter(F.col("part") % 5 == 0).select("item_id")
    reads = later.filter(F.col("part") % 5 != 0).select("item_id", F.lit(True).alias("checked"), "price", F.lit(0.0).alias("shipping_cost"), F.lit("").alias("title"), none.alias("ends_at"), F.lit(1).alias("bid_count"), F.lit(99).alias("seller_score"))
    gone = prior.filter((F.col("part") % 5 != 0) & (F.col("part") % 7 == 0)).select("item_id").join(reads.select("item_id"), "item_id", "left_anti")
    reads = reads.unionByName(gone.withColumn("checked", F.lit(True)), allowMissingColumns=True)
    return prior, fresh, reads


_CARRY_SQL = f"""{_TICKS_SQL},
cand AS (SELECT b.*, r.now, split_part(key, '|', 1)::BIGINT AS part FROM before b LEFT JOIN reads r USING (item_id) WHERE NOT EXISTS (SELECT 1 FROM fresh f WHERE f.item_id = b.item_id)),
gated AS (SELECT *, {REASON_SQL.replace('all_in', 'now')} AS reason FROM cand),
fated AS (SELECT *, CASE WHEN now IS NULL AND part % 5 <> 0 AND part % 7 = 0 THEN 'ended' WHEN now IS NULL THEN 'as-was' WHEN now <= was THEN 'refreshed' WHEN reason IS NULL THEN 're-gated' ELSE 'dropped' END AS fate FROM gated)"""


@query(f"{_CARRY_SQL} SELECT item_id, fate, {cents_sql("CASE WHEN fate IN ('refreshed', 're-gated') THEN now ELSE was END")} AS all_in_c FROM fated")
def carry_forward(spark, sf_dir):
    prior, fresh, reads = _ticks(spark, sf_dir)
    return carry.carry_deals(prior, fresh, reads, CONF).select("item_id", "fate", cents(F.col("all_in")).alias("all_in_c"))


@query(f"{_CARRY_SQL} SELECT fate, count(*) AS n FROM fated GROUP BY fate")
def carry_fates(spark, sf_dir):
    return carry_forward(spark, sf_dir).groupBy("fate").agg(F.count(F.lit(1)).alias("n"))


@query(
    """WITH r AS (SELECT 'd' || (o_orderkey % 4000)::VARCHAR AS id, o_orderkey AS ord, 'i' || o_orderkey::VARCHAR AS item_id, CASE WHEN o_orderkey < 2000 THEN 0 WHEN o_orderkey % 2 = 0 THEN 1 ELSE 2 END AS part FROM orders)
    SELECT id, item_id, CASE part WHEN 2 THEN 'closing' END AS lane, CASE WHEN part = 0 THEN 'old' ELSE 'new' END AS surfaced_at FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY part, item_id) AS rn FROM r) WHERE rn = 1"""
)
def receipts_ledger(spark, sf_dir):
    """First write wins: the ledger, then deals, then calls."""
    zero = F.lit(0.0)
    o = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("d"), (F.col("o_orderkey") % 4000).cast("string")).alias("id"), F.concat(F.lit("i"), F.col("o_orderkey").cast("string")).alias("item_id"), F.col("o_orderkey").alias("ord"), F.lit("v").alias("vertical"),
        F.lit("k").alias("key"), zero.alias("depth"), zero.alias("all_in"), zero.alias("med"), F.lit("high").alias("conf"), F.lit("A").alias("risk_grade"),
    )
    old = o.filter("ord < 2000").withColumns({"lane": F.lit(None).cast("string"), "surfaced_at": F.lit("old"), "outcome": F.lit("live"), "resolved_at": F.lit(None).cast("string")})
    new = o.filter("ord >= 2000")
    return carry.record(old, new.filter("ord % 2 = 0"), new.filter("ord % 2 = 1"), "new").select("id", "item_id", "lane", "surfaced_at")


@query(f"{_LEDGER_SQL} SELECT id, CASE WHEN outcome = 'live' AND ord % 5000 % 3 = 0 THEN 'ended' ELSE outcome END AS outcome, CASE WHEN outcome = 'live' AND ord % 5000 % 3 = 0 THEN 'now' END AS resolved_at FROM ledger")
def receipts_resolve(spark, sf_dir):
    ledger = _ledger(spark, sf_dir).withColumn("resolved_at", F.lit(None).cast("string"))
    gone = ledger.filter(F.substring("item_id", 2, 9).cast("long") % 3 == 0).select("item_id")
    return carry.resolve(ledger, gone, "now").select("id", "outcome", "resolved_at")


_PAGES_SQL = "WITH pages AS (SELECT event_type AS slice, user_id AS item_id, event_id AS pos, ts, CASE event_type WHEN 'click' THEN 1 WHEN 'error' THEN 2 WHEN 'purchase' THEN 3 WHEN 'signup' THEN 4 ELSE 5 END AS slice_ord FROM events)"


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = {n: i for i, n in enumerate(("click", "error", "purchase", "signup", "view"), 1)}
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_type").alias("slice"), F.col("user_id").alias("item_id"), F.col("event_id").alias("pos"), "ts", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("created"), T.label_of(F.col("event_type"), names).alias("slice_ord"))


@query(
    f"""{_PAGES_SQL}, cur AS (SELECT * FROM (VALUES ('click', TIMESTAMP '2024-01-10'), ('view', TIMESTAMP '2024-01-20')) c(slice, cursor)),
    f AS (SELECT p.* FROM pages p LEFT JOIN cur USING (slice) WHERE NOT coalesce(epoch_ms(ts) < epoch_ms(cursor), false) AND item_id % 10 <> 3)
    SELECT item_id, slice, pos FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY slice_ord, pos) AS rn FROM f) WHERE rn = 1"""
)
def sweep_fresh(spark, sf_dir):
    """New items at or after their slice's cursor, not in the seen-ledger; the first slice wins."""
    pages = _pages(spark, sf_dir)
    cursors = spark.createDataFrame([("click", "2024-01-10T00:00:00Z"), ("view", "2024-01-20T00:00:00Z")], "slice string, cursor string")
    seen = pages.filter(F.col("item_id") % 10 == 3).select("item_id").distinct()
    return sweep.fresh(pages, cursors, seen).select("item_id", "slice", "pos")


@query(f"{_PAGES_SQL} SELECT slice, max(ts) AS cursor FROM pages GROUP BY slice")
def sweep_cursor(spark, sf_dir):
    none = spark.createDataFrame([], "slice string, cursor string")
    out = sweep.advance(_pages(spark, sf_dir), none)
    return out.select("slice", F.col("cursor").cast("timestamp").cast("timestamp_ntz").alias("cursor"))


@query("SELECT user_id AS item_id, min(ts) AS seen_at FROM events GROUP BY user_id HAVING epoch_ms(TIMESTAMP '2024-01-08') - epoch_ms(min(ts)) <= 7 * 86400000")
def seen_dedupe(spark, sf_dir):
    """Seen-ledger after a tick on 8 January: first sighting, forgotten after a week."""
    pages = _pages(spark, sf_dir)
    seen = pages.select("item_id", F.col("created").alias("seen_at"))
    conf = C.Config.at("2024-01-08T00:00:00Z")
    out = sweep.remember(seen, pages.limit(0).select("item_id"), conf)
    return out.select("item_id", F.col("seen_at").cast("timestamp").cast("timestamp_ntz").alias("seen_at"))


@query(f"{_PAGES_SQL} SELECT item_id, slice, pos FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY slice_ord, pos) AS rn FROM pages WHERE epoch_ms(ts) > epoch_ms(TIMESTAMP '2024-01-15 10:00:00') AND epoch_ms(ts) <= epoch_ms(TIMESTAMP '2024-01-15 14:00:00')) WHERE rn = 1")
def capture_hour_dedupe(spark, sf_dir):
    """Auctions ending in the next four hours, one look per item and hour."""
    conf = C.Config.at("2024-01-15T10:00:00Z")
    pages = _pages(spark, sf_dir).withColumn("ends_at", F.col("created"))
    return sweep.auction_looks(pages, conf).select("item_id", "slice", "pos")


@query("SELECT make_timestamp((epoch_ms(ts) // 10800000) * 10800000 * 1000) AS tick, event_type, count(*) AS n FROM events GROUP BY ALL")
def tick_counts(spark, sf_dir):
    return sweep.tick_counts(table(spark, sf_dir, "events"), "ts", "event_type")


# --- statistics and views -----------------------------------------------------------------------
@query(
    f"""{_PRICED_SQL}, dim AS (SELECT * FROM (VALUES ('A'), ('N'), ('R'), ('Z')) d(vertical)), polled AS (SELECT flag AS vertical, count(*) AS polled FROM listing GROUP BY flag),
    hit AS (SELECT flag AS vertical, count(*) AS matched, count(*) FILTER (reason IS NULL) AS surfaced FROM ranked WHERE med IS NOT NULL GROUP BY flag)
    SELECT vertical, coalesce(polled, 0) AS polled, coalesce(matched, 0) AS matched, coalesce(surfaced, 0) AS surfaced FROM dim FULL JOIN polled USING (vertical) FULL JOIN hit USING (vertical)"""
)
def funnel_stats(spark, sf_dir):
    """Polled, matched and surfaced by vertical, zero-filled."""
    rows = _priced(spark, sf_dir)
    polled = rows.groupBy(F.col("flag").alias("vertical")).agg(F.count(F.lit(1)).alias("polled"), F.count_if("matched").alias("matched"), F.count_if(F.col("reason").isNull()).alias("surfaced"))
    dim = spark.createDataFrame([(v,) for v in "ANRZ"], "vertical string")
    return dim.join(polled, "vertical", "full").na.fill(0, ["polled", "matched", "surfaced"])


@query(f"{_PRICED_SQL} SELECT coalesce(flag, 'all') AS vertical, count(*) AS n FROM ranked WHERE reason IS NULL GROUP BY ROLLUP (flag)")
def chips_rollup(spark, sf_dir):
    return board.chips(_priced(spark, sf_dir).filter(F.col("reason").isNull()).withColumn("vertical", F.col("flag")))


@query("SELECT user_id % 10 AS slice, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'error') AS error, count(*) FILTER (event_type = 'purchase') AS purchase, count(*) FILTER (event_type = 'signup') AS signup, count(*) FILTER (event_type = 'view') AS view FROM events GROUP BY 1")
def slice_pivot(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy((F.col("user_id") % 10).alias("slice")).pivot("event_type", ["click", "error", "purchase", "signup", "view"]).agg(F.count(F.lit(1))).na.fill(0)


@query(f"{_PRICED_SQL}, v AS (SELECT flag, order_key, line, key, {cents_sql('all_in')} AS all_in_c, row_number() OVER (PARTITION BY flag ORDER BY rank DESC, order_key, line, key, all_in) AS place FROM ranked WHERE reason IS NULL) SELECT flag, order_key, line, key, all_in_c, place::INTEGER AS place, CASE WHEN place = 1 THEN 'hero' WHEN place <= 7 THEN 'grid' ELSE 'row' END AS slot FROM v")
def vertical_view(spark, sf_dir):
    """A vertical's page: hero, six cards, rows."""
    w = Window.partitionBy("flag").orderBy(F.col("rank").desc(), "order_key", "line", "key", "all_in")
    rows = _priced(spark, sf_dir).filter(F.col("reason").isNull()).withColumn("place", F.row_number().over(w))
    return rows.select("flag", "order_key", "line", "key", cents(F.col("all_in")).alias("all_in_c"), "place", F.when(F.col("place") == 1, "hero").when(F.col("place") <= 7, "grid").otherwise("row").alias("slot"))


@query(
    f"""{_LEDGER_SQL}, deal AS (SELECT 'r' || o_orderkey::VARCHAR AS id, 'i' || (o_orderkey % 700)::VARCHAR AS item_id FROM orders WHERE o_orderkey % 4 = 0),
    hits AS (SELECT d.id, l.ord, l.outcome FROM deal d JOIN ledger l ON l.id = d.id UNION ALL SELECT d.id, l.ord, l.outcome FROM deal d JOIN ledger l ON l.item_id = d.item_id)
    SELECT d.id, d.item_id, h.ord AS receipt_ord, h.outcome FROM deal d LEFT JOIN (SELECT id, min(ord) AS ord, min_by(outcome, ord) AS outcome FROM hits GROUP BY id) h USING (id)"""
)
def deal_receipt_or_join(spark, sf_dir):
    ledger = _ledger(spark, sf_dir)
    deals = ledger.filter("ord % 4 = 0").select("id", F.concat(F.lit("i"), (F.col("ord") % 700).cast("string")).alias("item_id"))
    return carry.deal_receipts(deals, ledger).select("id", "item_id", "receipt_ord", "outcome")


@query("WITH h AS (SELECT o_custkey % 50 AS hunt_id, o_orderkey AS id, o_orderdate AS listed_at FROM orders WHERE o_orderstatus = 'O') SELECT hunt_id, id FROM (SELECT *, row_number() OVER (PARTITION BY hunt_id ORDER BY listed_at DESC NULLS LAST, id) AS rn FROM h) WHERE rn <= 8")
def no_book_cap(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").filter("o_orderstatus = 'O'").select((F.col("o_custkey") % 50).alias("hunt_id"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("listed_at"))
    return windows.newest_per(rows, "hunt_id", CONF.no_book_cap).select("hunt_id", "id")


# --- text and scalar functions ------------------------------------------------------------------
_FLAG_WORDS = "damaged|incomplete|trimmed|altered|restored|torn|as[- ]is|cracked|repaired|reprint|replica|broken|glue|residue"


@query(f"SELECT page_id, list_distinct(list_transform(regexp_extract_all(html, '\\b({_FLAG_WORDS})\\b', 1, 'i'), lambda x: lower(x))) IS NOT NULL AND regexp_matches(html, '(?i)\\b({_FLAG_WORDS})\\b') AS flagged FROM pages")
def condition_flags(spark, sf_dir):
    rows = table(spark, sf_dir, "pages")
    return rows.select("page_id", scoring.has_condition_flag(F.col("html")).alias("flagged"))


@query("SELECT p_partkey, CASE WHEN regexp_matches(p_name, '(?i)\\bring\\b') THEN 'ring' WHEN regexp_matches(p_name, '(?i)\\bred\\b') THEN 'red' WHEN regexp_matches(p_name, '(?i)widget|gadget') THEN 'device' END AS class FROM part")
def class_canon(spark, sf_dir):
    """First matching class in order, over part names."""
    rules = ((r"\bring\b", "ring"), (r"\bred\b", "red"), ("widget|gadget", "device"))
    return table(spark, sf_dir, "part").select("p_partkey", identity.first_of(F.col("p_name"), rules).alias("class"))


_NAME_SLUG = "regexp_replace(regexp_replace(replace(lower(strip_accents(name)), '&', ' and '), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"


@query(f"SELECT kind, id, {_NAME_SLUG} AS slug FROM (SELECT 'part' AS kind, p_partkey AS id, p_name || ' & ' || p_brand AS name FROM part UNION ALL SELECT 'customer', c_custkey, c_name || '  ' || c_mktsegment FROM customer)")
def slug_names(spark, sf_dir):
    """Slugs of whole names: of parts with their brand, and of customers."""
    parts = table(spark, sf_dir, "part").select(F.lit("part").alias("kind"), F.col("p_partkey").alias("id"), F.concat("p_name", F.lit(" & "), "p_brand").alias("name"))
    people = table(spark, sf_dir, "customer").select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("id"), F.concat("c_name", F.lit("  "), "c_mktsegment").alias("name"))
    return parts.unionByName(people).select("kind", "id", T.slug(F.col("name")).alias("slug"))


@query("SELECT doc_id, regexp_replace(regexp_replace(replace(lower(strip_accents(coalesce(text, ''))), '&', ' and '), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM documents")
def slug_texts(spark, sf_dir):
    """Slugs of whole texts."""
    return table(spark, sf_dir, "documents").select("doc_id", T.slug(F.col("text")).alias("slug"))


@query(
    """WITH RECURSIVE i AS (SELECT c_custkey, c_name AS s FROM customer), h(c_custkey, s, pos, v) AS (
    SELECT c_custkey, s, 0, 5381::BIGINT FROM i UNION ALL SELECT c_custkey, s, pos + 1, (v * 33 + ascii(substr(s, pos + 1, 1))) % 4294967296 FROM h WHERE pos < length(s))
    SELECT c_custkey, v AS value FROM h WHERE pos = length(s)"""
)
def deal_ids(spark, sf_dir):
    """Short ids of customer names, shown as numbers."""
    return table(spark, sf_dir, "customer").select("c_custkey", F.conv(F.upper(T.deal_id(F.col("c_name"))), 36, 10).cast("long").alias("value"))


@query("SELECT p_partkey, 'https://example.org/key/' || p_type || '/' || url_encode(p_name || '|' || p_brand) AS url FROM part")
def evidence_urls(spark, sf_dir):
    rows = table(spark, sf_dir, "part")
    return rows.select("p_partkey", T.evidence_url("https://example.org", F.col("p_type"), F.concat("p_name", F.lit("|"), F.col("p_brand"))).alias("url"))


@query("SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events")
def json_aspects(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k STRING").alias("p"))
    return rows.select("event_id", T.number(F.col("p.k")).cast("long").alias("k"))


@query("SELECT page_id, nullif(regexp_extract(url, '[?&]utm_source=([^&#]*)', 1), '') AS utm_source, regexp_extract(url, '/(\\d+)(?:[/.?#]|$)', 1)::BIGINT AS number FROM pages")
def page_params(spark, sf_dir):
    rows = table(spark, sf_dir, "pages")
    return rows.select("page_id", T.found(F.col("url"), r"[?&]utm_source=([^&#]*)", 1).alias("utm_source"), F.regexp_extract("url", r"/(\d+)(?:[/.?#]|$)", 1).cast("long").alias("number"))


@query("SELECT o_orderkey, '$' || CASE WHEN o_totalprice >= 1000 THEN floor((floor(o_totalprice + 0.5::DOUBLE)) / 1000)::BIGINT::VARCHAR || ',' || lpad((floor(o_totalprice + 0.5::DOUBLE)::BIGINT % 1000)::VARCHAR, 3, '0') ELSE floor(o_totalprice + 0.5::DOUBLE)::BIGINT::VARCHAR END AS money, CASE WHEN o_totalprice >= 10000 THEN '$' || floor(o_totalprice / 1000 + 0.5::DOUBLE)::BIGINT::VARCHAR || 'K' ELSE 'small' END AS compact FROM orders")
def display_money(spark, sf_dir):
    p = F.col("o_totalprice")
    return table(spark, sf_dir, "orders").select("o_orderkey", D.money(p).alias("money"), F.when(p >= 10000, D.money_compact(p)).otherwise("small").alias("compact"))


_DAYS = "floor((epoch_ms(TIMESTAMP '2001-08-02') - epoch_ms(o_orderdate)) / 86400000.0::DOUBLE + 0.5::DOUBLE)::BIGINT"


@query(
    f"""WITH d AS (SELECT o_orderkey, o_orderdate, {_DAYS} AS days FROM orders), m AS (SELECT *, floor(days / 30.0::DOUBLE + 0.5::DOUBLE)::BIGINT AS months FROM d)
    SELECT o_orderkey, CASE WHEN days <= 0 THEN 'today' WHEN days = 1 THEN 'yesterday' WHEN days < 30 THEN days::VARCHAR || ' days ago' WHEN months < 24 THEN months::VARCHAR || ' mo ago' ELSE floor(months / 12.0::DOUBLE + 0.5::DOUBLE)::BIGINT::VARCHAR || ' yr ago' END AS age,
    strftime(o_orderdate, '%b %-d, %Y') AS day, strftime(o_orderdate, '%b %Y') AS month, (epoch_ms(TIMESTAMP '2001-08-02') - epoch_ms(o_orderdate)) / (30.44::DOUBLE * 86400000) > 12 AS aging FROM m"""
)
def display_age(spark, sf_dir):
    now = F.lit(C.Config.at("2001-08-02").now_ms)
    iso = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return table(spark, sf_dir, "orders").select("o_orderkey", D.relative_date(ms("o_orderdate"), now).alias("age"), D.short_date(iso).alias("day"), D.month_year(iso).alias("month"), D.is_aging(ms("o_orderdate"), now).alias("aging"))


@query("SELECT o_orderkey, CASE WHEN d <= 0 THEN 'ended' WHEN d // 60000 >= 60 THEN 'ends in ' || (d // 3600000)::VARCHAR || 'h ' || (d // 60000 % 60)::VARCHAR || 'm' ELSE 'ends in ' || greatest(d // 60000 % 60, 1)::VARCHAR || 'm' END AS countdown FROM (SELECT o_orderkey, o_custkey * 37000 - 3000000 AS d FROM orders)")
def countdowns(spark, sf_dir):
    left = F.col("o_custkey") * 37000 - 3_000_000
    return table(spark, sf_dir, "orders").select("o_orderkey", D.countdown(left, F.lit(0)).alias("countdown"))


@query(
    f"""{_PRICED_SQL}, g AS (SELECT *, least(all_in, lo) AS low, greatest(hi, med, all_in) AS high FROM ranked WHERE med IS NOT NULL), s AS (SELECT *, low - greatest(high - low, 1.0::DOUBLE) * 0.06::DOUBLE AS a, (high + greatest(high - low, 1.0::DOUBLE) * 0.06::DOUBLE) - (low - greatest(high - low, 1.0::DOUBLE) * 0.06::DOUBLE) AS span FROM g)
    SELECT order_key, line, key, {cents_sql('all_in')} AS all_in_c, floor((med - a) / span * 100 * 100 + 0.5::DOUBLE)::BIGINT AS med_bp, floor((all_in - a) / span * 100 * 100 + 0.5::DOUBLE)::BIGINT AS ask_bp,
    CASE WHEN (all_in - a) / span * 100 < 14 THEN 'left' WHEN (all_in - a) / span * 100 > 86 THEN 'right' ELSE 'center' END AS ask_align FROM s"""
)
def depth_bars(spark, sf_dir):
    rows = _priced(spark, sf_dir).filter("matched").withColumn("b", D.depth_bar(*[F.col(c) for c in ("all_in", "lo", "med", "hi")]))
    return rows.select("order_key", "line", "key", cents(F.col("all_in")).alias("all_in_c"), F.floor(F.col("b.med") * 100 + 0.5).cast("long").alias("med_bp"), F.floor(F.col("b.ask") * 100 + 0.5).cast("long").alias("ask_bp"), "b.ask_align")

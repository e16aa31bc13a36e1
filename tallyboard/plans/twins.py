"""The board's inputs derived from the generic tables, so every operator runs over them at any scale.

Line items shipped before AS_OF are past sales (the book: one row per part and return flag), later
ones are listings. The return flag plays the grade at the end of a key, the brand the slice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyboard import config as C
from tallyboard.sources import scratch

AS_OF = "2001-01-01T00:00:00"
CONF = C.Config.at(AS_OF)
#: Multiplier of each return flag as a grade.
RUNGS = (("A", 1.6), ("N", 1.0), ("R", 0.7))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tasks(spark: SparkSession) -> int:
    """As many as a shuffle has parts, and as there are cores at least."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def spread(rows: DataFrame, key: str) -> DataFrame:
    """rows written in as many files as a shuffle has parts: a table in one small file is one task's input, however much its rows take.

    Filters on what is computed from the rows are not pushed below it.
    """
    return scratch.kept(rows.repartition(tasks(rows.sparkSession), key), "spread")


def ms(name: str):
    """Epoch milliseconds of a timestamp without zone."""
    return F.unix_millis(F.col(name).cast("timestamp"))


def _fused(x: Column, y: Column, z: Column) -> Column:
    """x * y + z rounded once: the product's and the sum's errors are computed and added last."""
    (xh, xl), (yh, yl) = ((high, v - high) for v in (x, y) for high in (v * 134217729.0 - (v * 134217729.0 - v),))
    product = x * y
    lost = ((xh * yh - product) + xh * yl + xl * yh) + xl * yl
    total = product + z
    part = total - product
    return total + (((product - (total - part)) + (z - part)) + lost)


def quantile(values: Column, q: float) -> Column:
    """Interpolated quantile of a sorted array, to the last bit as the SQL has it: its lower * (1 - d) + upper * d is rounded once before the sum's end."""
    at = (F.size(values) - 1) * F.lit(q)
    low = F.floor(at).cast("int")
    d = at - low
    a, b = F.get(values, low), F.get(values, low + 1)
    return F.when(d == 0, a).otherwise(_fused(a, 1 - d, b * d))


def book(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(k, v, med, lo, hi, n, n12, last_sale, last_ms, trend, conf)."""
    sales = table(spark, sf_dir, "lineitem").filter(F.col("l_shipdate") < F.lit(AS_OF).cast("timestamp_ntz"))
    year = F.lit(AS_OF).cast("timestamp_ntz") - F.expr("INTERVAL 365 DAYS")
    p = F.col("l_extendedprice")
    rows = sales.groupBy("l_partkey", "l_returnflag").agg(
        F.sort_array(F.collect_list(p)).alias("_paid"),
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_shipdate") >= year).alias("n12"), F.max("l_shipdate").alias("last_ts"),
    ).filter("n >= 3").withColumns({c: quantile(F.col("_paid"), q) for c, q in (("med", 0.5), ("lo", 0.1), ("hi", 0.9))})
    key = F.concat(F.col("l_partkey").cast("string"), F.lit("|"), F.col("l_returnflag"))
    conf = F.when(F.col("n") == 3, "thin").when(F.col("n") < 6, "medium").otherwise("high")
    return rows.select(key.alias("k"), F.col("l_returnflag").alias("v"), "med", "lo", "hi", "n", "n12", "last_ts", ms("last_ts").alias("last_ms"), F.lit(None).cast("double").alias("trend"), conf.alias("conf"), F.date_format("last_ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("last_sale"))


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(order_key, line, item_id, part, flag, key, price, shipping_cost, all_in, created_ms, shipped, supplier, quantity)."""
    rows = table(spark, sf_dir, "lineitem").filter(F.col("l_shipdate") >= F.lit(AS_OF).cast("timestamp_ntz"))
    price = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    ship = F.col("l_extendedprice") * F.col("l_tax") * 0.1
    return rows.select(
        F.col("l_orderkey").alias("order_key"), F.col("l_linenumber").alias("line"),
        F.concat(F.lit("v1|"), F.col("l_orderkey").cast("string"), F.lit("|"), F.col("l_linenumber").cast("string")).alias("item_id"),
        F.col("l_partkey").alias("part"), F.col("l_returnflag").alias("flag"),
        F.concat(F.col("l_partkey").cast("string"), F.lit("|"), F.col("l_returnflag")).alias("key"),
        price.alias("price"), ship.alias("shipping_cost"), (price + ship).alias("all_in"),
        (F.lit(CONF.now_ms) - F.col("l_linenumber") * 6 * C.HOUR_MS).alias("created_ms"), F.col("l_shipdate").alias("shipped"),
        F.col("l_suppkey").alias("supplier"), F.col("l_quantity").cast("long").alias("quantity"),
    )


BOOK_SQL = """
book AS (
  SELECT l_partkey::VARCHAR || '|' || l_returnflag AS k, l_partkey AS part, l_returnflag AS v, median(l_extendedprice) AS med,
    quantile_cont(l_extendedprice, 0.1) AS lo, quantile_cont(l_extendedprice, 0.9) AS hi, count(*) AS n,
    count(*) FILTER (l_shipdate >= TIMESTAMP '2001-01-01' - INTERVAL 365 DAYS) AS n12, max(l_shipdate) AS last_ts,
    epoch_ms(max(l_shipdate)) AS last_ms, CASE WHEN count(*) = 3 THEN 'thin' WHEN count(*) < 6 THEN 'medium' ELSE 'high' END AS conf
  FROM lineitem WHERE l_shipdate < TIMESTAMP '2001-01-01' GROUP BY l_partkey, l_returnflag HAVING count(*) >= 3)"""

LISTING_SQL = """
listing AS (
  SELECT *, price + shipping_cost AS all_in FROM (
    SELECT l_orderkey AS order_key, l_linenumber AS line, 'v1|' || l_orderkey::VARCHAR || '|' || l_linenumber::VARCHAR AS item_id,
      l_partkey AS part, l_returnflag AS flag, l_partkey::VARCHAR || '|' || l_returnflag AS key,
      l_extendedprice * (1 - l_discount) AS price, l_extendedprice * l_tax * 0.1::DOUBLE AS shipping_cost,
      978307200000 - l_linenumber::BIGINT * 21600000 AS created_ms, l_shipdate AS shipped, l_suppkey AS supplier, l_quantity::BIGINT AS quantity
    FROM lineitem WHERE l_shipdate >= TIMESTAMP '2001-01-01'))"""

#: Depth and reason of a listing that the book covers (columns of listing and book).
DEPTH_SQL = "(1 - all_in / med)"
REASON_SQL = f"""CASE WHEN med IS NULL THEN 'noBookRow' WHEN NOT (all_in > 0 AND med > 0) THEN 'noPrice'
  WHEN 978307200000 - last_ms > 24.0::DOUBLE * (30.44::DOUBLE * 86400000) THEN 'staleBook' WHEN {DEPTH_SQL} > 0.9 THEN 'scamCap'
  WHEN {DEPTH_SQL} < greatest(0.25::DOUBLE, CASE WHEN conf = 'thin' THEN 0.4::DOUBLE ELSE 0 END) THEN CASE WHEN {DEPTH_SQL} < 0.25 THEN 'tooShallow' WHEN conf = 'thin' THEN 'thinTooShallow' ELSE 'ladderTooShallow' END
  WHEN med - all_in < 50 THEN 'edgeFloor' END"""
EVIDENCE_SQL = """(CASE WHEN (978307200000 - last_ms) / (30.44::DOUBLE * 86400000) <= 6 THEN 1.0::DOUBLE WHEN (978307200000 - last_ms) / (30.44::DOUBLE * 86400000) <= 12 THEN 0.85::DOUBLE ELSE 0.55::DOUBLE END
  * least(1.0::DOUBLE, 0.7::DOUBLE + 0.075::DOUBLE * n12))"""
FRESH_SQL = "(CASE WHEN 978307200000 - created_ms >= 0 AND 978307200000 - created_ms < 86400000 THEN 1.15::DOUBLE ELSE 1.0::DOUBLE END)"
CONF_SQL = "(CASE conf WHEN 'high' THEN 1.0::DOUBLE WHEN 'medium' THEN 0.6::DOUBLE ELSE 0.35::DOUBLE END)"


def cents(x):
    """Money as whole cents, half up."""
    return F.floor(x * 100 + 0.5).cast("long")


def cents_sql(x: str) -> str:
    return f"floor({x} * 100 + 0.5::DOUBLE)::BIGINT"


def mills(x):
    """Money in tenths of a cent, the grain of interpolated percentiles."""
    return F.floor(x * 1000 + 0.5).cast("long")


def mills_sql(x: str) -> str:
    return f"floor({x} * 1000 + 0.5::DOUBLE)::BIGINT"

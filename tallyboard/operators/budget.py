"""Call budgets per run as integer arithmetic over the source plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyboard.config import SLICES

#: Calls a day, runs a day, and the lanes' shares.
DAILY, RUNS = 5000, 8
HUNT_SHARE, AUCTION_SHARE, GOLDMINE_SHARE, CARDS_SHARE = 0.10, 0.35, 0.25, 0.40


def reserve(total: int = DAILY) -> tuple[int, int]:
    """(hunt, book) calls a day."""
    hunt = int(total * HUNT_SHARE)
    return hunt, total - hunt


def hunt_calls(total: int = DAILY) -> int:
    return reserve(total)[0] // RUNS


def slices(spark: SparkSession) -> DataFrame:
    rows = [(i, s[0], s[1], s[2], list(s[3]), s[4]) for i, s in enumerate(SLICES, 1)]
    return spark.createDataFrame(rows, "slice_ord int, slice string, category string, lens string, matchers array<string>, lane string")


def plan_hunt(queries: DataFrame, calls_per_query: int = 1, total: int = DAILY) -> DataFrame:
    """Queries (with ord) that fit this run; the tail waits."""
    return queries.orderBy("ord").limit(max(0, hunt_calls(total) // calls_per_query))


def allocate(plan: DataFrame, total: int = DAILY) -> DataFrame:
    """plan with pages: calls of each slice this run, and goldmine: calls of the per-key lane."""
    per_run = F.lit(reserve(total)[1] // RUNS)
    whole, lane = Window.partitionBy(), Window.partitionBy("lane")
    n = F.count(F.lit(1)).over(lane)
    has = {x: F.max((F.col("lane") == x).cast("int")).over(whole) for x in ("auction", "cards")}
    auction = F.floor(per_run * AUCTION_SHARE) * has["auction"]
    out = plan.withColumn("_auction", auction.cast("long")).withColumn("goldmine", F.floor((per_run - F.col("_auction")) * GOLDMINE_SHARE).cast("long"))
    out = out.withColumn("_bin", per_run - F.col("_auction") - F.col("goldmine")).withColumn("_cards", (F.floor(F.col("_bin") * CARDS_SHARE) * has["cards"]).cast("long"))
    pool = F.when(F.col("lane") == "auction", F.col("_auction")).when(F.col("lane") == "cards", F.col("_cards")).otherwise(F.col("_bin") - F.col("_cards"))
    return out.withColumn("pages", F.floor(pool / n).cast("long")).drop("_auction", "_bin", "_cards")

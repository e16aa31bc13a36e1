"""Published files read back: a missing or malformed one is empty, and only rows of valid shape are passed on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyboard.functions.text import millis
from tallyboard.schemas import BOARD, RECEIPTS
from tallyboard.sources.listings import _colons, _exists


def _finite(*xs: Column) -> Column:
    """All are numbers, neither null nor NaN nor infinite."""
    good = F.lit(True)
    for x in xs:
        good = good & x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return good


def valid_call(c: Column) -> Column:
    """An auction call can be shown: texts, an end that is a date, and finite numbers."""
    texts = c["id"].isNotNull() & c["title"].isNotNull() & millis(c["endsAt"]).isNotNull()
    return F.coalesce(texts & _finite(c["currentBid"], c["allInBid"], c["bidVsBook"], c["med"], c["lo"], c["hi"]), F.lit(False))


def valid_context(c: Column) -> Column:
    return F.coalesce(c["k"].isNotNull() & c["kind"].isNotNull() & _finite(c["med"], c["lo"], c["hi"], c["n"].cast("double")), F.lit(False))


def valid_lead(c: Column) -> Column:
    return c["title"].isNotNull()


def guard(board: DataFrame) -> DataFrame:
    """A parsed board (BOARD) with optional sections only where their shape holds; without deals all is empty."""
    whole = F.col("deals").isNotNull()
    some = lambda xs: F.when(whole & (F.size(xs) > 0), xs)
    hunt = whole & F.col("hunt.targets").isNotNull() & F.col("hunt.deals").isNotNull()
    return board.select(
        F.lit(1).alias("schema"), *[F.when(whole, F.coalesce(c, F.lit(""))).otherwise("").alias(c) for c in ("builtAt", "bookBuiltAt")],
        F.coalesce("deals", F.array()).alias("deals"), F.when(whole, F.col("perVertical")).alias("perVertical"), F.when(hunt, F.col("hunt")).alias("hunt"),
        some(F.filter("leads", valid_lead)).alias("leads"), some(F.filter("closing", valid_call)).alias("closing"), F.when(whole, F.col("stats")).alias("stats"),
    )


def read_board(spark: SparkSession, path: str) -> DataFrame:
    """The published board as one row; the lists in it are capped when it is published."""
    text = spark.read.text(path, wholetext=True) if _exists(spark, path) else spark.createDataFrame([("{}",)], "value string")
    return guard(text.select(F.from_json("value", f"STRUCT<{_colons(BOARD)}>").alias("b")).select("b.*"))


def read_receipts(spark: SparkSession, path: str) -> DataFrame:
    """The published ledger, one row per receipt that has an id, with ord; a missing or malformed file is empty."""
    if not _exists(spark, path):
        return spark.createDataFrame([], f"ord INT, {RECEIPTS}")
    rows = F.from_json("value", f"ARRAY<STRUCT<{_colons(RECEIPTS)}>>")
    text = spark.read.text(path, wholetext=True)
    return text.select(F.posexplode(rows).alias("ord", "r")).select("ord", "r.*").filter("id IS NOT NULL")

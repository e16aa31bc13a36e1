"""The value book: rows, grade ladder and context rollups of one JSON document, plain or gzipped."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyboard import config as C
from tallyboard.functions.display import is_book_stale
from tallyboard.operators.pricing import last_row_wins
from tallyboard.schemas import BOOK


@dataclass
class Book:
    rows: DataFrame  # one per key: the last of duplicates
    rungs: DataFrame
    context: DataFrame
    stale: bool


def read_book(spark: SparkSession, path: str, conf: C.Config, live: bool = True) -> Book:
    """Read a book; a live one that is older than two days, or of unknown age, is stale."""
    doc = spark.read.schema(BOOK).json(path, multiLine=True)
    rows = doc.select(F.posexplode("rows").alias("ordinal", "r")).select("ordinal", "r.*").withColumnRenamed("lastSale", "last_sale")
    rungs = doc.select(F.explode("gradeLadder.rungs").alias("rung", "mult")).filter("mult IS NOT NULL")
    context = doc.select(F.explode("context").alias("r")).select("r.*").withColumnRenamed("lastSale", "last_sale")
    first = doc.select(is_book_stale(F.col("builtAt"), conf).alias("stale"), F.size("rows").alias("n")).first()
    if first is None or first["n"] is None or first["n"] < 0:
        raise ValueError(f"no book in {path}")
    return Book(last_row_wins(rows).drop("ordinal"), rungs, context, bool(live and first["stale"]))


def read_current(spark: SparkSession, root: str, conf: C.Config) -> Book:
    """The version that the pointer file names, else the legacy file."""
    try:
        name = spark.read.text(f"{root}/current").first()[0].strip()
        return read_book(spark, f"{root}/versions/{name}", conf)
    except Exception as e:  # noqa: BLE001  a reader without pointer support wrote only the legacy file
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return read_book(spark, f"{root}/value-book.json.gz", conf)


def read_or_sample(spark: SparkSession, root: str, sample: str, conf: C.Config) -> Book:
    """The live book, or the sample if the live one can't be read."""
    try:
        return read_current(spark, root, conf)
    except Exception:  # noqa: BLE001  any failure falls back
        return read_book(spark, sample, conf, live=False)


def per_vertical(rows: DataFrame) -> DataFrame:
    return rows.groupBy(F.col("v").alias("vertical")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "vertical")

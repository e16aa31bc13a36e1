"""Sweep cursors and the seen-ledger, as tick-batch tables and as Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyboard import config as C
from tallyboard.functions.text import millis


def fresh(pages: DataFrame, cursors: DataFrame, seen: DataFrame) -> DataFrame:
    """Listings of this tick that are new: (slice, item_id, created, ...) at or after their slice's cursor, not seen yet.

    Rows before the cursor go even though the request overlaps it; a row without date is kept. Within
    the tick the first place wins.
    """
    c = cursors.select(F.col("slice").alias("_slice"), F.col("cursor").alias("_cursor"))
    rows = pages.join(c, F.col("slice") == F.col("_slice"), "left")
    late = F.coalesce(millis(F.col("created")) < millis(F.col("_cursor")), F.lit(False))
    rows = rows.filter(~late).drop("_slice", "_cursor").join(seen.select("item_id"), "item_id", "left_anti")
    whole = F.struct(*rows.columns)
    return rows.groupBy(F.col("item_id").alias("_item")).agg(F.min_by(whole, F.struct("slice_ord", "pos")).alias("_r")).select("_r.*")


def advance(pages: DataFrame, cursors: DataFrame) -> DataFrame:
    """New cursors: the newest creation time of each slice, older pages unread or not."""
    newest = pages.groupBy("slice").agg(F.max("created").alias("cursor"))
    return cursors.select("slice", "cursor").unionByName(newest).groupBy("slice").agg(F.max("cursor").alias("cursor")).filter("cursor IS NOT NULL")


def request_from(cursors: DataFrame, conf: C.Config) -> DataFrame:
    """Time from which each slice asks again: the cursor less the overlap."""
    return cursors.withColumn("from_ms", millis(F.col("cursor")) - conf.overlap_ms)


def remember(seen: DataFrame, new: DataFrame, conf: C.Config) -> DataFrame:
    """Seen-ledger with this tick's items; entries past their time, by the run's clock, or of unknown time go."""
    now = F.date_format(F.timestamp_millis(F.lit(conf.now_ms)), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    both = seen.select("item_id", "seen_at").unionByName(new.select("item_id", now.alias("seen_at")))
    first = both.groupBy("item_id").agg(F.min("seen_at").alias("seen_at"))
    return first.filter(F.lit(conf.now_ms) - millis(F.col("seen_at")) <= conf.seen_ttl_ms)


def auction_looks(pages: DataFrame, conf: C.Config, seen: DataFrame | None = None) -> DataFrame:
    """Auctions that end within the window, one look per item and capture hour; look is the ledger's key."""
    ends = millis(F.col("ends_at"))
    rows = pages.filter((ends > conf.now_ms) & (ends <= conf.now_ms + conf.closing_window_ms))
    hour = F.date_format(F.timestamp_millis(F.lit(conf.now_ms)), "yyyy-MM-dd'T'HH")
    rows = rows.withColumn("look", F.concat("item_id", F.lit("@"), hour))
    if seen is not None:
        rows = rows.join(seen.select(F.col("item_id").alias("look")), "look", "left_anti")
    whole = F.struct(*rows.columns)
    return rows.groupBy(F.col("look").alias("_look")).agg(F.min_by(whole, F.struct("slice_ord", "pos")).alias("_r")).select("_r.*")


# --- streaming ----------------------------------------------------------------------------------


def first_looks(stream: DataFrame, time_col: str, key: list[str], ttl: str = "7 days") -> DataFrame:
    """First row of each key within the time to live, by event time: the seen-ledger of a stream."""
    return stream.withWatermark(time_col, ttl).dropDuplicatesWithinWatermark(key)


def tick_counts(rows: DataFrame, time_col: str, by: str, ms: int = 3 * C.HOUR_MS) -> DataFrame:
    """Rows per tumbling tick and group; works on tables and streams."""
    w = F.window(time_col, f"{ms} milliseconds")
    return rows.groupBy(w, by).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("tick"), by, "n")


def run_ticks(stream: DataFrame, tick, checkpoint: str):
    """Run tick(batch, id) over all that is there, exactly once by the checkpoint, and wait for the end."""
    query = stream.writeStream.foreachBatch(tick).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query

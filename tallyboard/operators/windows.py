"""First-wins dedupes, caps, rotations and claims: all with a total order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyboard import config as C
from tallyboard.operators import ranks


def first_wins(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """One row per key: the first in order, which must be total.

    Partial aggregation finds it, so a key that many rows share costs a row per task.
    """
    whole = F.struct(*rows.columns)
    best = rows.groupBy(*[F.col(k).alias(f"_g{i}") for i, k in enumerate(key)]).agg(F.min_by(whole, F.struct(*[o.alias(f"_o{i}") for i, o in enumerate(order)])).alias("_r"))
    return best.select("_r.*")


def claim(hits: DataFrame) -> DataFrame:
    """Hunt hits with their fate, from (item_id, entry_ord, pos, kept, reason).

    The first entry that keeps an item claims it: that hit is `claimed`; hits of earlier entries are
    counted by reason, later ones are `skipped`.
    """
    w = Window.partitionBy("item_id")
    place = F.struct("entry_ord", "pos")
    first = F.min(F.when(F.col("kept"), place)).over(w)
    out = hits.withColumn("_first", first)
    fate = F.when(F.col("_first").isNotNull() & (place == F.col("_first")), "claimed").when(F.col("_first").isNull() | (place < F.col("_first")), "counted").otherwise("skipped")
    return out.withColumn("fate", fate).drop("_first")


def newest_per(rows: DataFrame, key: str, cap: int) -> DataFrame:
    """At most cap rows per key: the newest, unknown dates last, then by id."""
    w = Window.partitionBy(key).orderBy(F.col("listed_at").desc_nulls_last(), "id")
    return rows.withColumn("_place", F.row_number().over(w)).filter(F.col("_place") <= cap).drop("_place")


def goldmine_window(pool: DataFrame, per_run: int, conf: C.Config) -> DataFrame:
    """This tick's circular slice of the pool (with `score`): take advances by the slice's own length."""
    w = Window.orderBy(F.col("score").desc(), "k")
    size = pool.count()
    take = min(per_run, size)
    start = (conf.now_ms // conf.tick_ms) * take % size if size else 0
    placed = pool.withColumn("_rn", F.row_number().over(w) - 1).withColumn("place", F.pmod(F.col("_rn") - start, F.lit(max(1, size))))
    return placed.filter(F.col("place") < take).drop("_rn")


def receipts_window(ledger: DataFrame, conf: C.Config) -> DataFrame:
    """This tick's live receipts to check: a window that slides by one. `ord` is the receipts' own number, without ties."""
    return ranks.circular(ledger.filter("outcome = 'live'"), "ord", conf.now_ms // conf.tick_ms, conf.receipts_per_tick)


def top(rows: DataFrame, order: list[Column], cap: int) -> DataFrame:
    """The first cap rows in order, as a distributed top-k."""
    return rows.orderBy(*order).limit(cap)

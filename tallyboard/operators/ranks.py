"""Ranks without a window over all rows: a numeric order is cut at values found in the data, counts of the
parts give each rank's part, and only that part is looked at again.

A pass costs one partial aggregation; each one narrows the part by a factor of CUTS, so a few passes reach
SMALL different values. Ties are counted, never sorted, so any number of equal rows is fine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Parts of a pass, and different values that are small enough to be listed on the driver.
CUTS, SMALL = 64, 1024


def _at(rows: DataFrame, value: Column, rank: int) -> float:
    """The value at a rank, counted from 0, of rows that have one."""
    part = rows
    while True:
        listed = part.groupBy(value.alias("v")).agg(F.count("*").alias("n"))
        few = listed.limit(SMALL + 1).collect()
        if len(few) <= SMALL:
            for r in sorted(few, key=lambda r: r["v"]):
                if rank < r["n"]:
                    return r["v"]
                rank -= r["n"]
            raise ValueError("no such rank")
        cuts = sorted(set(part.agg(F.percentile_approx(value, [i / CUTS for i in range(1, CUTS)], 10_000)).first()[0]))
        # an odd part holds the rows that equal a cut, an even one those between two cuts
        place = F.lit(0)
        for c in cuts:
            place = place + (value > c).cast("int") + (value >= c).cast("int")
        counts = {r["p"]: r["n"] for r in part.groupBy(place.alias("p")).agg(F.count("*").alias("n")).collect()}
        own = 0
        while rank >= counts.get(own, 0):
            rank -= counts.get(own, 0)
            own += 1
        if own % 2:
            return cuts[own // 2]
        if own > 0:
            part = part.filter(value > cuts[own // 2 - 1])
        if own // 2 < len(cuts):
            part = part.filter(value < cuts[own // 2])


def values_at(rows: DataFrame, value: Column, ranks: list[int]) -> list[float]:
    """The values at ranks (from 0) among the rows whose value is neither null nor NaN."""
    known = rows.filter(value.isNotNull() & ~F.isnan(value.cast("double")))
    return [_at(known, value, r) for r in ranks]


def median(rows: DataFrame, value: Column) -> float | None:
    """The middle value, or the mean of the two middle ones; None without values."""
    n = rows.filter(value.isNotNull() & ~F.isnan(value.cast("double"))).count()
    if not n:
        return None
    low, *high = values_at(rows, value, sorted({(n - 1) // 2, n // 2}))
    return (low + high[0]) / 2 if high else low


def numbered(rows: DataFrame, order: str, parts: int = CUTS) -> DataFrame:
    """rows with `rank` from 0 on by a numeric column without nulls or ties: counts of parts give each part's first number.

    A part is sorted by itself, so no task sees all rows.
    """
    asked = F.col(order)
    cuts = sorted(set(rows.agg(F.percentile_approx(asked, [i / parts for i in range(1, parts)], 10_000)).first()[0] or []))
    place = F.lit(0)
    for c in cuts:
        place = place + (asked > c).cast("int")
    placed = rows.withColumn("_part", place)
    counts, before, total = {r["_part"]: r["n"] for r in placed.groupBy("_part").agg(F.count("*").alias("n")).collect()}, F.lit(0).cast("long"), 0
    for part in range(len(cuts) + 1):
        before = F.when(F.col("_part") == part, F.lit(total).cast("long")).otherwise(before)
        total += counts.get(part, 0)
    own = F.row_number().over(Window.partitionBy("_part").orderBy(order)) - 1
    return placed.withColumn("rank", before + own).drop("_part")


def circular(rows: DataFrame, order: str, start: int, take: int) -> DataFrame:
    """rows with `place` from 0 on: `take` of them from rank `start` on, going on at the smallest after the largest.

    order: a numeric column without ties or nulls. take is bounded by the caller; so many values are listed.
    """
    size = rows.count()
    if not size or take <= 0:
        return rows.limit(0).withColumn("place", F.lit(0))
    start, take, asked = start % size, min(take, size), F.col(order)
    low = values_at(rows, asked, [start])[0]
    picked = [r[0] for r in rows.filter(asked >= low).select(order).orderBy(order).limit(take).collect()]
    if len(picked) < take:
        picked += [r[0] for r in rows.select(order).orderBy(order).limit(take - len(picked)).collect()]
    kind = rows.schema[order].dataType
    places = F.create_map(*[x for i, v in enumerate(picked) for x in (F.lit(v).cast(kind), F.lit(i))])
    return rows.filter(asked.isin(picked)).withColumn("place", F.try_element_at(places, asked))

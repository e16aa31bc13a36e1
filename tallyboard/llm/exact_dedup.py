"""Exact duplicates by an extendible-hash index on shared files, with DataFrame functions only.

A text's address is a 64-bit hash of its normalised form. The directory starts with one bucket; a
bucket with more than `capacity` different addresses splits on the next address bit, doubling the
directory where needed, until none is overfull. So a bucket is a range of addresses. Copies of one
text can't be split that way; a bucket with more rows than `PAGE` times its capacity has overflow
pages instead, to which its rows go in turn.

The directory, in the shared folder, routes every row: it goes to the owner task of its bucket and
page. There the rows of one address form a chain, in which texts are told apart by their bytes. Pages
of a bucket are then merged: each sends one row per text, again compared by bytes. So a text that a
third of all rows hold is spread over many owner tasks, and its pages meet as one row each.

Cases: a null text counts as empty, so null and empty texts are equal (blank texts normalise to one
space and are equal among themselves). Texts are processed whole, whatever their length; a row must
fit into a task's memory, as everywhere in Spark. Of rows with equal text the smallest doc_id stays,
null ids come last, and of rows that also share the id exactly one stays. An empty table gives an
empty result; columns other than id and text are carried, not read, so their names never clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyboard.llm.common import discard, normal_text, saved

#: Different addresses in a bucket before it splits, at least; with more texts than CAPACITY * MOST_BUCKETS it grows with them.
CAPACITY, MOST_BUCKETS = 64, 1 << 16
#: Rows of a bucket's page, as a multiple of the bucket's capacity.
PAGE = 4
#: Most address bits that the directory uses.
MOST_BITS = 20
#: Cells up to this many (some 40 bytes each) may be broadcast; a larger directory is joined by a shuffle.
MOST_BROADCAST = 1 << 18


def _prefix(address: Column, bits: int) -> Column:
    """The address's leading bits as a number, in unsigned order."""
    return F.lit(0).cast("long") if bits == 0 else F.shiftrightunsigned(address, 64 - bits)


def directory(addresses: DataFrame, capacity: int | None = None, bits: int = MOST_BITS) -> tuple[DataFrame, int]:
    """(cell, depth, bucket, pages) for each used cell of the final directory, and its global depth.

    addresses: a row per text (address). A cell is an address prefix of global depth; bucket is the
    first cell of the bucket's range, depth the bucket's own number of bits.
    """
    each = addresses.groupBy("address").agg(F.count(F.lit(1)).alias("n"))
    counts = saved(each.groupBy(_prefix(F.col("address"), bits).alias("fine")).agg(F.count(F.lit(1)).alias("texts"), F.sum("n").alias("rows")), "cells")
    texts = counts.agg(F.sum("texts")).first()[0] or 0
    capacity = capacity or max(CAPACITY, -(-texts // MOST_BUCKETS))
    # every range that could be a bucket; the overfull ones split, so a cell's bucket is one bit deeper than its deepest overfull range
    ranges = counts.select("fine", "texts", F.explode(F.sequence(F.lit(0), F.lit(bits - 1))).alias("d")).withColumn("prefix", F.expr(f"shiftrightunsigned(fine, {bits} - d)"))
    overfull = ranges.groupBy("d", "prefix").agg(F.sum("texts").alias("n")).filter(F.col("n") > capacity).select("d", "prefix")
    own = ranges.join(overfull, ["d", "prefix"]).groupBy("fine").agg((F.max("d") + 1).alias("depth"))
    placed = saved(counts.join(own, "fine", "left").select("fine", "rows", F.coalesce("depth", F.lit(0)).alias("depth")), "depths")
    deepest = placed.agg(F.max("depth")).first()[0] or 0
    cell = F.shiftrightunsigned("fine", bits - deepest)
    cells = placed.select(cell.alias("cell"), "depth", "rows").withColumn("bucket", F.col("cell") - F.pmod("cell", F.expr(f"shiftleft(1L, {deepest} - depth)")))
    pages = cells.groupBy("bucket").agg(F.greatest(F.lit(1), F.ceil(F.sum("rows") / (PAGE * capacity))).cast("long").alias("pages"))
    out = saved(cells.select("cell", "depth", "bucket").distinct().join(pages, "bucket").select("cell", "depth", "bucket", "pages"), "directory")
    discard(counts, placed)
    return out, deepest


def _address(text: Column, bits: int) -> Column:
    """64-bit address of a text; with fewer bits (for tests of collisions) only the leading ones vary."""
    return F.xxhash64(text) if bits == 64 else F.shiftleft(F.shiftrightunsigned(F.xxhash64(text), 64 - bits), 64 - bits)


def _owned(docs: DataFrame, text_col: str, id_col: str, carried: Column, norm: Column, capacity: int | None, address_bits: int) -> tuple[DataFrame, DataFrame]:
    """Rows in their owner tasks with n and head (first row) of their text in that page, and the directory.

    carried is what a row takes along, as `what`; norm is the normalised text as read from it.
    """
    address = _address(normal_text(F.col(text_col)), address_bits)
    cells, depth = directory(docs.select(address.alias("address")), capacity)
    rows = docs.select(carried.alias("what"), F.col(id_col).alias("doc_id"), address.alias("address"), F.monotonically_increasing_id().alias("row")).withColumn("cell", _prefix(F.col("address"), depth))
    routed = rows.join(F.broadcast(cells) if cells.count() <= MOST_BROADCAST else cells, "cell").withColumn("page", F.pmod(F.xxhash64("row"), F.col("pages")))
    owned = routed.select("what", "doc_id", "address", "row", "bucket", "page", "pages").repartition("bucket", "page").withColumn("norm", norm)
    same = Window.partitionBy("bucket", "page", "address", "norm")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    return owned.withColumns({"n": F.count(F.lit(1)).over(same), "head": F.min(order).over(same)}), cells


def find_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int | None = None, address_bits: int = 64) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256, bucket, chain.

    bucket is the index bucket of the text, chain its place among different texts of one address.
    """
    owned, cells = _owned(docs, text_col, id_col, normal_text(F.col(text_col)), F.col("what"), capacity, address_bits)
    chain = F.dense_rank().over(Window.partitionBy("bucket", "page", "address").orderBy("norm")) - 1
    settled = owned.withColumn("chain", chain).select(
        "doc_id", "row", "bucket", "page", "pages", "address", "chain", "n", "head", F.sha2("norm", 256).alias("text_sha256"), F.when((F.col("pages") > 1) & (F.col("row") == F.col("head.row")), F.col("norm")).alias("norm")
    )
    settled = saved(settled, "settled")
    discard(cells)
    # pages of a bucket meet as one row per text, and each page learns the whole count and the first row
    text, chained = Window.partitionBy("bucket", "address", "norm"), Window.partitionBy("bucket", "address").orderBy("norm")
    merged = settled.filter("pages > 1 AND row = head.row").select("bucket", "page", "address", "chain", F.sum("n").over(text).alias("all"), F.min("head").over(text).alias("first"), (F.dense_rank().over(chained) - 1).alias("place"))
    paged = settled.filter("pages > 1").join(merged, ["bucket", "page", "address", "chain"]).drop("chain").withColumnsRenamed({"place": "chain"})
    alone = settled.filter("pages = 1").withColumns({"all": F.col("n"), "first": F.col("head")})
    both = alone.unionByName(paged, allowMissingColumns=True)
    return both.select("doc_id", F.col("first.doc_id").alias("keep_id"), F.col("all").alias("group_size"), (F.col("row") == F.col("first.row")).alias("kept"), "text_sha256", "bucket", "chain")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int | None = None, address_bits: int = 64) -> DataFrame:
    """docs without the rows whose text an earlier document has; all columns as they were."""
    what = F.struct(*[F.col(c) for c in docs.columns])
    owned, cells = _owned(docs, text_col, id_col, what, normal_text(F.col("what")[text_col]), capacity, address_bits)
    firsts = owned.filter("row = head.row").select("what", "row", "bucket", "pages", "address", "head", F.when(F.col("pages") > 1, F.col("norm")).alias("norm"))
    firsts = saved(firsts, "firsts")
    discard(cells)
    merged = firsts.filter("pages > 1").withColumn("head", F.min("head").over(Window.partitionBy("bucket", "address", "norm")))
    return firsts.filter("pages = 1").unionByName(merged).filter("row = head.row").select("what.*")

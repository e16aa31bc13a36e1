"""Listings: raw JSON in, one canonical row per listing out."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyboard import config as C
from tallyboard.functions.text import number
from tallyboard.operators import ranks
from tallyboard.schemas import RAW_LISTING


def shipping(options: Column) -> Column:
    """Cheapest finite option: 0 is free, null unknown."""
    costs = F.transform(options, lambda o: number(o["shippingCost"]["value"]))
    return F.array_min(F.filter(costs, lambda c: c.isNotNull()))


def normalize(raw: DataFrame, enriched: bool = True, marketplace: str = "EBAY_US") -> DataFrame:
    """Canonical listings from raw rows; columns that are not raw fields pass through."""
    fields = [f.split()[0] for f in _top_level(RAW_LISTING)]
    extra = [c for c in raw.columns if c not in fields]
    price = F.coalesce(number(F.col("price.value")), number(F.col("currentBidPrice.value")), F.lit(0.0))
    named = F.filter("localizedAspects", lambda a: a["name"].isNotNull() & a["value"].isNotNull())
    aspects = F.transform(F.coalesce(named, F.array().cast("array<struct<name:string,type:string,value:string>>")), lambda a: F.struct(a["name"].alias("name"), a["value"].alias("value")))
    none = F.array().cast("array<struct<name:string,value:string>>")
    return raw.select(
        *extra,
        F.col("itemId").alias("item_id"), F.col("legacyItemId").alias("legacy_item_id"), F.coalesce("title", F.lit("")).alias("title"),
        price.alias("price"), F.coalesce(F.col("price.currency"), F.lit("USD")).alias("currency"), shipping(F.col("shippingOptions")).alias("shipping_cost"),
        "condition", F.col("conditionId").alias("condition_id"), F.coalesce(F.col("image.imageUrl"), F.get("thumbnailImages", F.lit(0))["imageUrl"]).alias("image_url"),
        F.col("itemWebUrl").alias("web_url"), F.col("itemAffiliateWebUrl").alias("affiliate_url"),
        F.col("seller.username").alias("seller"), number(F.col("seller.feedbackPercentage")).alias("seller_pct"), F.col("seller.feedbackScore").alias("seller_score"), F.col("seller.sellerAccountType").alias("seller_account"),
        F.col("itemCreationDate").alias("listed_at"), F.col("itemEndDate").alias("ends_at"), F.col("bidCount").alias("bid_count"), F.col("buyingOptions").alias("buying_options"),
        (aspects if enriched else none).alias("aspects"), F.lit(enriched).alias("enriched"), F.lit(marketplace).alias("marketplace"),
    )


def _top_level(ddl: str) -> list[str]:
    out, depth, start = [], 0, 0
    for i, c in enumerate(ddl):
        depth += (c == "<") - (c == ">")
        if c == "," and depth == 0:
            out.append(ddl[start:i].strip())
            start = i + 1
    return [*out, ddl[start:].strip()]


def resolve_end(ends_at: Column, conf: C.Config) -> Column:
    """`+Nm` means N minutes after the clock."""
    minutes = F.regexp_extract(ends_at, r"(?i)^\+(\d+)m$", 1).try_cast("long")
    resolved = F.date_format(F.timestamp_millis(F.lit(conf.now_ms) + minutes * 60_000), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return F.when(minutes.isNotNull(), resolved).otherwise(ends_at)


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_listings(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of raw listings with `pos`; a missing or malformed file reads as empty."""
    if not _exists(spark, path):
        return normalize(spark.createDataFrame([], RAW_LISTING).withColumn("pos", F.lit(0)))
    text = spark.read.text(path, wholetext=True)
    items = F.from_json("value", f"ARRAY<STRUCT<{_colons(RAW_LISTING)}>>")
    return normalize(text.select(F.posexplode(items).alias("pos", "r")).select("pos", "r.*"))


def read_listing_map(spark: SparkSession, path: str, key: str, conf: C.Config) -> DataFrame:
    """A JSON object of listing arrays: each row has its key and `pos`; relative end dates are resolved."""
    if not _exists(spark, path):
        return normalize(spark.createDataFrame([], f"{key} STRING, pos INT, {RAW_LISTING}"))
    text = spark.read.text(path, wholetext=True)
    listed = F.from_json("value", f"MAP<STRING, ARRAY<STRUCT<{_colons(RAW_LISTING)}>>>")
    rows = text.select(F.explode(listed).alias(key, "items")).select(key, F.posexplode("items").alias("pos", "r")).select(key, "pos", "r.*")
    return normalize(rows).withColumn("ends_at", resolve_end(F.col("ends_at"), conf))


def read_live_map(spark: SparkSession, path: str, conf: C.Config) -> DataFrame:
    """A JSON object item id -> raw listing or null: rows of live reads, where null says the item is gone."""
    text = spark.read.text(path, wholetext=True)
    listed = F.from_json(F.get_json_object("value", "$.items"), f"MAP<STRING, STRUCT<{_colons(RAW_LISTING)}>>")
    rows = text.select(F.explode(listed).alias("asked", "r"))
    gone = F.col("r").isNull() | F.col("r.itemId").isNull()
    seen = normalize(rows.filter(~gone).select("asked", "r.*"))
    alive = seen.select(F.col("asked").alias("item_id"), F.lit(True).alias("checked"), "price", "shipping_cost", "title", resolve_end(F.col("ends_at"), conf).alias("ends_at"), "bid_count", "seller_score")
    return alive.unionByName(rows.filter(gone).select(F.col("asked").alias("item_id"), F.lit(True).alias("checked")), allowMissingColumns=True)


def _colons(ddl: str) -> str:
    """Column list as struct fields."""
    return ", ".join(f.replace(" ", ": ", 1) for f in _top_level(ddl))


def search(
    listings: DataFrame, words: str, posture: str = "bin", price_min: float | None = None, price_max: float | None = None, cap: int = 50,
    categories: list[str] | None = None, aspects: dict[str, list[str]] | None = None,
) -> DataFrame:
    """Keyword search over listings: all words in the title, one of the categories, of each named aspect one of its values.

    Prices are bounded by whole units, the lower one floored and the upper one ceiled. `all` drops the posture and the
    lower price: an auction's price is its bid so far.
    """
    out = listings
    if categories:
        out = out.filter(F.col("category").isin(*categories))
    for name, values in (aspects or {}).items():
        of_name = F.filter("aspects", lambda a: a["name"] == name)  # noqa: B023  built at once
        out = out.filter(F.exists(of_name, lambda a: a["value"].isin(*values)))  # noqa: B023
    for w in words.lower().split():
        out = out.filter(F.contains(F.lower("title"), F.lit(w)))
    if posture == "bin":
        out = out.filter(F.array_contains("buying_options", "FIXED_PRICE"))
        if price_min is not None:
            out = out.filter(F.col("price") >= math.floor(price_min))
    if price_max is not None:
        out = out.filter(F.col("price") <= math.ceil(price_max))
    return out.orderBy(F.col("listed_at").desc_nulls_last(), "item_id").limit(cap)


def lookup(ids: DataFrame, snapshot: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """Point lookup of (item_id) with its three states.

    An item in the snapshot is checked and has a price; one it lacks is checked without price: gone. Items of reads
    that failed (item_id) are not checked and have nothing, so nobody takes them for gone.
    """
    rows = snapshot.select("item_id", "price", "shipping_cost", "title", "ends_at", "bid_count", "seller_score")
    asked = ids.select("item_id").distinct()
    if failed is None:
        return asked.join(rows, "item_id", "left").withColumn("checked", F.lit(True))
    unread = failed.select("item_id").distinct()
    known = asked.join(unread, "item_id", "left_anti").join(rows, "item_id", "left").withColumn("checked", F.lit(True))
    return known.unionByName(asked.join(unread, "item_id", "left_semi").withColumn("checked", F.lit(False)), allowMissingColumns=True)


def lookup_batches(ids: DataFrame, snapshot: DataFrame, failed: DataFrame, refused: int | None = None, errors: DataFrame | None = None, singles: int = 400, size: int = 20) -> DataFrame:
    """Point lookup of (item_id, ord) in batches of `size` in order: ids with batch, state and the snapshot's columns.

    failed: (batch) of those whose read failed. refused: the first batch that the market refused; from there on items are
    read one by one, `singles` at most, and errors: (item_id) are those whose own read failed. A batch counts only as a
    whole: where one read of it fails or is beyond the budget, all its items are `unread`. An item of a batch that counts
    is `alive` if the snapshot has it and `gone` if not.
    """
    placed = ranks.numbered(ids, "ord").withColumn("batch", F.floor(F.col("rank") / size).cast("long"))
    bad = failed.select("batch").distinct()
    if refused is not None:
        bad = bad.filter(F.col("batch") < refused)
        whole = placed.filter(F.col("batch") >= refused)
        late = whole.filter(F.col("rank") - refused * size >= singles).select("batch")
        bad = bad.unionByName(late)
        if errors is not None:
            bad = bad.unionByName(whole.join(errors.select("item_id").distinct(), "item_id", "left_semi").select("batch"))
    bad = bad.distinct().withColumn("_bad", F.lit(True))
    rows = placed.join(bad, "batch", "left").join(snapshot.withColumn("_there", F.lit(True)), "item_id", "left")
    unread = F.coalesce("_bad", F.lit(False))
    state = F.when(unread, "unread").when(F.col("_there"), "alive").otherwise("gone")
    seen = [F.when(~unread, F.col(c)).alias(c) for c in snapshot.columns if c != "item_id"]
    return rows.select("item_id", "ord", "batch", state.alias("state"), *seen)


def enrich(listings: DataFrame, items: DataFrame) -> DataFrame:
    """listings with condition, aspects and enriched from items where these have the id."""
    more = items.select(F.col("item_id").alias("_id"), F.col("aspects").alias("_aspects"), F.col("condition").alias("_condition"), F.lit(True).alias("_hit"))
    out = listings.join(more, F.col("item_id") == F.col("_id"), "left")
    hit = F.coalesce(F.col("_hit"), F.lit(False))
    return out.withColumns({"aspects": F.when(hit, F.col("_aspects")).otherwise(F.col("aspects")), "condition": F.when(hit, F.col("_condition")).otherwise(F.col("condition")), "enriched": hit | F.col("enriched")}).drop("_id", "_aspects", "_condition", "_hit")

"""Search queries compiled from book rows and hunt entries, and the views of the hunt."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyboard import config as C
from tallyboard.functions.text import label_of
from tallyboard.operators import pricing

#: What a signed format is called in a search.
FORMAT_PHRASE = {
    "als": "autograph letter signed",
    "tls": "typed letter signed",
    "ans": "autograph note signed",
    "aqs": "autograph quotation signed",
    "ds": "document signed",
    "ls": "letter signed",
    "check": "signed check",
    "sp": "signed photo",
    "book": "signed book",
}
#: Category of each vertical's book queries, of hunt queries, and the verticals with a matcher.
BOOK_CATEGORY = {"sports-cards": "261328", "pokemon": "183454", "art-editions": "360", "autographs": "14429", "watches": "31387"}
HUNT_CATEGORY = {"sports-cards": "212", "sports": "64482"}
MATCHED = ("sports-cards", "pokemon", "art-editions", "autographs", "watches", "design")


def _spaced(x: Column) -> Column:
    return F.replace(x, F.lit("-"), F.lit(" "))


def _joined(*parts: Column) -> Column:
    """Parts that are not empty, with single spaces."""
    return F.trim(F.regexp_replace(F.concat_ws(" ", *parts), r"\s+", " "))


def book_terms(vertical: Column, key: Column) -> Column:
    """Search words of a book key as its vertical asks for them; null where a vertical has no queries of its own."""
    part = F.split(key, r"\|")
    at = [F.coalesce(F.get(part, F.lit(i)), F.lit("")) for i in range(5)]
    number = [F.when(at[i] != "", F.concat(F.lit("#"), at[i])) for i in range(5)]
    edition = F.when(at[3] == "1st", "1st Edition").when(at[3] == "shadowless", "Shadowless")
    graded = F.regexp_replace(at[4], r"^([A-Za-z]+)([0-9.]+)$", "$1 $2")
    phrase = F.lit("signed")
    for name, words in FORMAT_PHRASE.items():
        phrase = F.when(at[1] == name, words).otherwise(phrase)
    return (
        F.when(vertical == "sports-cards", _joined(_spaced(at[0]), at[1], at[2], number[3], F.when(at[4] != "raw", at[4])))
        .when(vertical == "pokemon", _joined(at[0], F.lit("Pokemon"), _spaced(at[1]), number[2], edition, graded))
        .when(vertical == "art-editions", _joined(_spaced(at[0]), _spaced(at[1])))
        .when(vertical == "autographs", _joined(_spaced(at[0]), phrase))
    )


def key_terms(vertical: Column, key: Column) -> Column:
    """Words made from the key itself, for watches only: their keys are brand and reference."""
    return F.when(vertical == "watches", F.nullif(_joined(_spaced(F.translate(key, "|", " "))), F.lit("")))


def _category(vertical: Column) -> Column:
    return label_of(vertical, BOOK_CATEGORY)


def _band() -> list[Column]:
    """Prices worth a call: from half of the low to somewhat above the high."""
    return [F.floor(F.col("lo") * 0.5 + 0.5).cast("double").alias("price_min"), F.floor(F.col("hi") * 1.15 + 0.5).cast("double").alias("price_max")]


def compile_pool(pool: DataFrame) -> DataFrame:
    """pool (k, v, lo, hi, ...) with q, category, price_min and price_max; rows that no query can ask for go."""
    q = F.coalesce(book_terms(F.col("v"), F.col("k")), key_terms(F.col("v"), F.col("k")))
    low, high = _band()
    return pool.withColumns({"q": q, "category": _category(F.col("v")), "price_min": low, "price_max": high}).filter("q IS NOT NULL")


def compile_hunt(entries: DataFrame, book: DataFrame, conf: C.Config) -> DataFrame:
    """(hunt_id, hunt_ord, place, form, key, q, category, price_min, price_max, matcher): the queries of a hunt list.

    An entry names a book key, a prefix of keys (its dearest rows, by an equi-join on the prefix lengths in use) or
    search words. Keys and prefixes that the book lacks, and rows whose vertical has no queries, give none.
    """
    rows = book.select("k", "v", "lo", "hi")
    keyed = entries.filter("key IS NOT NULL").select("hunt_id", "hunt_ord", F.lit(1).alias("place"), F.lit("key").alias("form"), F.col("key").alias("k"))
    prefixed = pricing.prefix_rows(entries, book, conf).join(entries.select("hunt_id", "hunt_ord"), "hunt_id")
    pinned = keyed.unionByName(prefixed.select("hunt_id", "hunt_ord", "place", F.lit("prefix").alias("form"), "k")).join(rows, "k")
    pinned = pinned.select(
        "hunt_id", "hunt_ord", "place", "form", F.col("k").alias("key"), book_terms(F.col("v"), F.col("k")).alias("q"),
        _category(F.col("v")).alias("category"), *_band(), F.col("v").alias("matcher"),
    ).filter("q IS NOT NULL")
    words = entries.filter("q IS NOT NULL").select(
        "hunt_id", "hunt_ord", F.lit(1).alias("place"), F.lit("words").alias("form"), F.concat(F.lit("hunt:"), F.col("hunt_id")).alias("key"), "q",
        label_of(F.col("vertical"), HUNT_CATEGORY).alias("category"), F.lit(None).cast("double").alias("price_min"),
        F.col("max_all_in").alias("price_max"), F.when(F.col("vertical").isin(*MATCHED), F.col("vertical")).alias("matcher"),
    )
    return pinned.unionByName(words)


def missing_keys(entries: DataFrame, book: DataFrame) -> DataFrame:
    """(hunt_id, key): entries whose key the book lacks, to be warned of."""
    return entries.filter("key IS NOT NULL").select("hunt_id", "key").join(book.select(F.col("k").alias("key")), "key", "left_anti")


def board_order() -> Column:
    """Order of hunt hits: priced ones by rank, then unpriced ones by date, newest first, then id."""
    from tallyboard.functions.text import millis

    when = F.coalesce(millis(F.coalesce("listed_at", "surfaced_at")), F.lit(0))
    return F.struct(F.col("no_book").alias("a"), F.when(~F.col("no_book"), -F.col("rank")).alias("b"), F.when(F.col("no_book"), -when).alias("c"), F.col("id").alias("d"))


def target_view(targets: DataFrame, hits: DataFrame) -> DataFrame:
    """targets with hits, priced, no_book, first_id and context: its own, else the first unpriced hit's that has one.

    Targets without hits stay, with zeros.
    """
    place = board_order()
    of_hit = F.when(F.col("no_book"), F.col("context"))
    by = hits.groupBy("hunt_id").agg(
        F.count(F.lit(1)).alias("hits"), F.count_if(~F.col("no_book")).alias("priced"), F.count_if("no_book").alias("no_book"),
        F.min_by("id", place).alias("first_id"), F.min_by(of_hit, F.when(of_hit.isNotNull(), place)).alias("_context"),
    )
    out = targets.join(by, "hunt_id", "left").na.fill(0, ["hits", "priced", "no_book"])
    return out.withColumn("context", F.coalesce("context", "_context")).drop("_context")


def strip_counts(targets: DataFrame, hits: DataFrame) -> DataFrame:
    """One row: targets, priced and no_book hits."""
    live = hits.agg(F.count_if(~F.col("no_book")).alias("priced"), F.count_if("no_book").alias("no_book"))
    return targets.agg(F.count(F.lit(1)).alias("targets")).crossJoin(live)  # one row by one row

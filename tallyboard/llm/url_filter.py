"""URL filters by a temporal list join.

A list is dated: an entry says from when a key (a domain with all below it, or a domain with a path
prefix) is blocked or allowed again. Entries of one key become validity intervals, each ending where
the next begins. A capture (URL and fetch time) asks for its host, its parent domains, and these with
prefixes of its path, at all depths (labels and segments) that keys of the list have; an equi-join on
the key with the interval around the fetch time evaluates it against the entries active then. The most specific active entry decides (longest host,
then longest path).

Keys and captures are written alike: no scheme, port, user or query, the host in lower case without a
closing dot, the path without empty segments. An IPv6 host is one label, in its brackets.

A list of up to `MOST_BROADCAST` intervals is sent to all tasks. Beyond that the join is by shuffle;
keys that very many captures ask for are found by a count first, and their captures and intervals are
dealt over several tasks.

Cases: a null or unparsable URL has a null host and is allowed, as is a capture without fetch time; an
URL's length does not matter. Of entries of one key and time the last identifier counts; entries
without key or time count for nothing. Repeated captures are judged each; empty tables give an empty
result or allow all. Only the named columns are read, so others' names never clash.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyboard.llm.common import saved

#: Depths to which the query's SQL expands captures; no key of its list is deeper. judge() reads depths off the list.
MOST_LABELS, MOST_SEGMENTS = 8, 4
HOST = r"^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?(\[[0-9a-f:.]+\]|[^/:?#\[\]]+)"
PATH = r"^[a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*(/[^?#]*)"


#: Intervals up to this many may be broadcast.
MOST_BROADCAST = 50_000
#: A key is hot when more captures than this ask for it, and more than this share of all keys asked for.
HOT_ROWS, HOT_SHARE = 100_000, 1 / 1000


def normal_key(key: Column) -> Column:
    """A list key as captures ask for it; null where it has no host."""
    bare = F.regexp_replace(F.regexp_replace(key, r"^[a-zA-Z][a-zA-Z0-9+.\-]*://", ""), r"[?#].*$", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.substring_index(bare, "/", 1)), "^.*@", ""), r":\d*$", "")
    segments = F.filter(F.slice(F.split(bare, "/"), F.lit(2), F.greatest(F.lit(0), F.size(F.split(bare, "/")) - 1)), lambda p: p != "")
    host = F.rtrim(host, F.lit("."))
    return F.when(host != "", F.array_join(F.concat(F.array(host), segments), "/"))


def host_of(url: Column) -> Column:
    return F.nullif(F.rtrim(F.regexp_extract(F.lower(url), HOST, 1), F.lit(".")), F.lit(""))


def depths_of(keys: DataFrame) -> list[tuple[int, int]]:
    """The different depths (labels of the host, segments of the path) of keys (key), a few numbers."""
    labels = F.size(F.split(F.substring_index("key", "/", 1), r"\."))
    segments = F.size(F.split("key", "/")) - 1
    return sorted((r[0], r[1]) for r in keys.select(labels, segments).distinct().collect())


def keys_of(url: Column, depths: Sequence[tuple[int, int]]) -> Column:
    """Array of keys: parent domains of the host with prefixes of the path, at the given depths."""
    if not depths:
        return F.array().cast("array<string>")
    labels = F.split(host_of(url), r"\.")
    parts = F.filter(F.split(F.regexp_extract(url, PATH, 1), "/"), lambda p: p != "")
    wanted = F.array(*[F.struct(F.lit(n).alias("labels"), F.lit(k).alias("segments")) for n, k in depths])

    def at(d: Column, labels: Column, parts: Column) -> Column:
        key = F.array_join(F.concat(F.array(F.array_join(F.slice(labels, -d["labels"], d["labels"]), ".")), F.slice(parts, F.lit(1), d["segments"])), "/")
        return F.when((d["labels"] <= F.size(labels)) & (d["segments"] <= F.size(parts)), key)

    # labels and parts are made once and read at each depth
    both = F.array(F.struct(labels.alias("labels"), parts.alias("parts")))
    keys = F.flatten(F.transform(both, lambda b: F.array_compact(F.transform(wanted, lambda d: at(d, b["labels"], b["parts"])))))
    return F.when(host_of(url).isNotNull(), keys)


def intervals(entries: DataFrame) -> DataFrame:
    """Validity intervals (key, action, entry_id, valid_from, valid_to) of entries (entry_id, key, action, listed_at)."""
    last = entries.withColumn("key", normal_key(F.col("key"))).filter("key IS NOT NULL AND listed_at IS NOT NULL").groupBy("key", "listed_at").agg(F.max_by(F.struct("action", "entry_id"), "entry_id").alias("e"))
    w = Window.partitionBy("key").orderBy("listed_at")
    return last.select("key", "e.action", "e.entry_id", F.col("listed_at").alias("valid_from"), F.lead("listed_at").over(w).alias("valid_to"))


def _spread(asked: DataFrame, spans: DataFrame, hot_rows: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with a part: 0, or one of several for keys that very many captures ask for."""
    asked = saved(asked, "asked")
    limit = max(hot_rows, int(asked.count() * HOT_SHARE))
    hot = asked.groupBy("_key").count().filter(F.col("count") > limit).select(F.col("_key").alias("_hot"), F.ceil(F.col("count") / limit).cast("long").alias("_parts"))
    hot = saved(hot, "hot")
    # a key of more than a thousandth of all rows: there are fewer than a thousand
    left = asked.join(F.broadcast(hot), asked["_key"] == hot["_hot"], "left").withColumn("_part", F.coalesce(F.pmod(F.xxhash64("_row"), F.col("_parts")), F.lit(0))).drop("_hot", "_parts")
    right = spans.join(F.broadcast(hot), spans["key"] == hot["_hot"], "left").withColumn("_own", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col("_parts"), F.lit(1)) - 1))).drop("_hot", "_parts")
    return left, right


def judge(captures: DataFrame, entries: DataFrame, id_col: str, url_col: str, time_col: str, most_broadcast: int = MOST_BROADCAST, hot_rows: int = HOT_ROWS) -> DataFrame:
    """One row per capture: id, host, fetched_at, allowed, entry_id and key that decided (null: none active)."""
    spans = saved(intervals(entries), "intervals")
    # a capture keeps its row together: keys are looked up from an exploded copy, the best entry comes back by row number
    rows = saved(captures.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), F.col(time_col).alias("_at"), F.monotonically_increasing_id().alias("_row")), "captures")
    asked = rows.select("_row", "_at", F.explode(F.array_distinct(keys_of(F.col("_url"), depths_of(spans)))).alias("_key"))
    inside = (F.col("_at") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("_at") < F.col("valid_to")))
    if spans.count() <= most_broadcast:
        active = asked.join(F.broadcast(spans), (F.col("_key") == F.col("key")) & inside)
    else:
        left, right = _spread(asked, spans, hot_rows)
        active = left.join(right, (F.col("_key") == F.col("key")) & (F.col("_part") == F.col("_own")) & inside)
    order = F.struct(F.length(F.substring_index("key", "/", 1)), F.length("key"))
    best = active.groupBy("_row").agg(F.max_by(F.struct("key", "action", "entry_id"), order).alias("e"))
    out = rows.join(best, "_row", "left")
    return out.select(F.col("_id").alias(id_col), host_of(F.col("_url")).alias("host"), F.col("_at").alias("fetched_at"), (~F.coalesce(F.col("e.action") == "block", F.lit(False))).alias("allowed"), F.col("e.entry_id").alias("entry_id"), F.col("e.key").alias("key"))

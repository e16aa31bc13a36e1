"""The sweep as one stateful stream: a cursor for each slice, and items that were seen, with time to live.

Rows are (slice, slice_ord, pos, item_id, created_ms, tick_ms, at, ...); tick_ms is the clock of the run that read
them and `at` the same as a timestamp, by which the watermark goes. Results depend on the ticks and not on how micro-batches cut them, as long as no tick comes after a
later one. A slice's rows of one micro-batch are in one worker's memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, GroupedData, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tallyboard import config as C

ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class SliceCursor(StatefulProcessor):
    """Drops rows created before their slice's cursor: the newest creation time of all earlier ticks. No date is kept."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.cursor = handle.getValueState("cursor", "created_ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        batch = pd.concat(list(rows))
        cursor = self.cursor.get()[0] if self.cursor.exists() else None
        for _, tick in batch.groupby("tick_ms", sort=True):
            late = tick["created_ms"] < cursor if cursor is not None else pd.Series(False, index=tick.index)
            yield tick[~late.fillna(False).astype(bool)]
            newest = tick["created_ms"].max()
            if not pd.isna(newest) and (cursor is None or newest > cursor):
                cursor = int(newest)
        if cursor is not None:
            self.cursor.update((cursor,))

    def close(self) -> None:
        pass


#: Items are dealt by hash to so many groups, each with its items' states as one list: a call of the state store for
#: each group and not for each item. Part of a checkpoint's layout.
BUCKETS = 1024


def bucketed(stream: DataFrame) -> GroupedData:
    return stream.withColumn("bucket", F.pmod(F.hash("item_id"), F.lit(BUCKETS))).groupBy("bucket")


class FirstSight(StatefulProcessor):
    """Of each item of a bucket the first row by tick, slice and place; again only where it was last passed on more than ttl_ms ago."""

    def __init__(self, ttl_ms: int, item: str = "string"):
        self.ttl_ms, self.item = ttl_ms, item

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getListState("seen", f"item_id {self.item}, tick_ms long")

    def _keep(self, seen: dict) -> None:
        """The state, and a timer for the item whose time to live ends first."""
        if seen:
            self.seen.put(list(seen.items()))
            self.handle.registerTimer(min(seen.values()) + self.ttl_ms + 1)
        else:
            self.seen.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        batch = pd.concat(list(rows)).sort_values(["tick_ms", "slice_ord", "pos"], kind="stable").drop(columns="bucket")
        seen = dict(self.seen.get()) if self.seen.exists() else {}
        passed = []
        for i, (item, tick) in enumerate(zip(batch["item_id"].tolist(), batch["tick_ms"].tolist(), strict=True)):
            if item not in seen or tick - seen[item] > self.ttl_ms:
                passed.append(i)
                seen[item] = int(tick)
        if passed:
            self._keep(seen)
            yield batch.iloc[passed]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        """The time to live is over of items that have not been passed on again."""
        if self.seen.exists():
            self._keep({i: t for i, t in self.seen.get() if t + self.ttl_ms >= expiredTimerInfo.getExpiryTimeInMs()})
        return iter([])

    def close(self) -> None:
        pass


def sweep_stream(stream: DataFrame, ttl_ms: int = C.Config(now_ms=0).seen_ttl_ms) -> DataFrame:
    """Rows of the stream that are neither before their slice's cursor nor of an item seen within the time to live."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS_DB)
    timed = stream.withWatermark("at", "0 seconds")
    fresh = timed.groupBy("slice").transformWithStateInPandas(SliceCursor(), stream.schema, "Append", "EventTime", eventTimeColumnName="at")
    return bucketed(fresh).transformWithStateInPandas(FirstSight(ttl_ms, stream.schema["item_id"].dataType.simpleString()), stream.schema, "Append", "EventTime")


def run_available(rows: DataFrame, path: str, checkpoint: str) -> None:
    """Append all that is there to Parquet files under path, exactly once by the checkpoint, and wait for the end."""
    rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()


def swept(spark: SparkSession, ticks: list[DataFrame], folder: str, ttl_ms: int) -> DataFrame:
    """Land each of the ticks' tables in turn and run the stream, started anew from its checkpoint, after each."""
    schema = ticks[0].schema
    for rows in ticks:
        rows.write.mode("append").parquet(f"{folder}/landed")
        stream = spark.readStream.schema(schema).parquet(f"{folder}/landed")
        run_available(sweep_stream(stream, ttl_ms), f"{folder}/fresh", f"{folder}/checkpoint")
    return spark.read.schema(schema).parquet(f"{folder}/fresh")


# --- carried rows -----------------------------------------------------------------------------------
#: What the carry stream reads: a row for each item of a tick, `fresh` from the sweep or `read` again.
CARRY_IN = (
    "item_id string, lane string, kind string, tick_ms long, at timestamp, checked boolean, cost double, flagged boolean, ends_ms long, seller_score long, "
    "med double, last_sale_ms long, thin boolean, ladder boolean, surfaced_ms long"
)
CARRY_OUT = "item_id string, lane string, tick_ms long, fate string, all_in double, surfaced_ms long"
_FROZEN = "item_id string, lane string, all_in double, med double, last_sale_ms long, thin boolean, ladder boolean, ends_ms long, surfaced_ms long"


def _stale(last_sale_ms: float | None, conf: C.Config, now_ms: int) -> bool:
    return last_sale_ms is not None and now_ms - last_sale_ms > conf.stale_months * C.MONTH_MS


def deal_passes(cost: float, med: float, last_sale_ms: float | None, flagged: bool, thin: bool, ladder: bool, conf: C.Config, now_ms: int) -> bool:
    """operators.gates.gate on one row."""
    if not cost > 0 or not med > 0 or _stale(last_sale_ms, conf, now_ms) or flagged:
        return False
    depth = 1 - cost / med
    least = max(conf.ladder_depth if ladder else conf.min_depth, conf.thin_depth if thin else 0.0)
    return least <= depth <= conf.max_depth and med - cost >= conf.min_edge


def call_passes(cost: float, ends_ms: float | None, med: float, last_sale_ms: float | None, thin: bool, seller_score: float | None, flagged: bool, conf: C.Config, now_ms: int) -> bool:
    """operators.gates.closing_gate on one row, in the wide window of carried calls."""
    if not cost > 0 or not med > 0 or ends_ms is None or not now_ms < ends_ms <= now_ms + conf.goldmine_window_ms or thin:
        return False
    if _stale(last_sale_ms, conf, now_ms) or seller_score is None or seller_score < conf.seller_floor or flagged:
        return False
    return 1 - cost / med >= conf.closing_depth and med - cost >= conf.min_edge


def _known(x):
    return None if x is None or pd.isna(x) else x


def _whole(x):
    return None if _known(x) is None else int(x)


class Carried(StatefulProcessor):
    """The items of a bucket as they were called, through the ticks: read again, and judged against the frozen book call.

    A fresh row replaces the state and keeps the time it first surfaced. A deal is `ended` when it is gone, kept
    `as-was` when it was not read, `refreshed` at or below its price, else `re-gated` or `dropped`. A call is `dropped`
    when it is gone or fails its gate; one whose end has passed goes without a fate, by a timer where no row comes.
    """

    def __init__(self, conf: C.Config):
        self.conf = conf

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.frozen = handle.getListState("frozen", _FROZEN)
        self.names = [f.split()[0] for f in _FROZEN.split(", ")][1:]

    def _states(self) -> dict[str, dict]:
        return {item: dict(zip(self.names, rest, strict=True)) for item, *rest in self.frozen.get()} if self.frozen.exists() else {}

    def _keep(self, states: dict[str, dict]) -> None:
        """The states, and a timer for the call that ends first."""
        if not states:
            self.frozen.clear()
            return
        self.frozen.put([(item, *[state[n] for n in self.names]) for item, state in states.items()])
        ends = [state["ends_ms"] for state in states.values() if state["lane"] == "closing" and state["ends_ms"] is not None]
        if ends:
            self.handle.registerTimer(min(ends))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        batch = pd.concat(list(rows)).sort_values(["tick_ms", "kind"], kind="stable").drop(columns=["bucket", "at"])
        own: dict[tuple, list[dict]] = {}
        for row in zip(*[batch[c].tolist() for c in batch.columns], strict=True):
            r = dict(zip(batch.columns, row, strict=True))
            own.setdefault((int(r["tick_ms"]), r["item_id"]), []).append(r)
        states, out = self._states(), []
        for (tick, item), read in own.items():
            fate, state = self._tick(tick, read, states.pop(item, None))
            if state is not None:
                states[item] = state
            if fate is not None:
                out.append((item, fate[0], tick, *fate[1:]))
        self._keep(states)
        if out:
            yield pd.DataFrame(out, columns=[f.split()[0] for f in CARRY_OUT.split(", ")])

    def _tick(self, now: int, rows: list[dict], state: dict | None) -> tuple[tuple | None, dict | None]:
        """(lane, fate, all_in, surfaced_ms) of a tick, and the state after it."""
        if state is not None and state["lane"] == "closing" and not (state["ends_ms"] is not None and state["ends_ms"] > now):
            state = None
        fresh = [r for r in rows if r["kind"] == "fresh"]
        if fresh:
            r = fresh[0]
            was = state["surfaced_ms"] if state is not None and state["lane"] == r["lane"] else now
            state = {"lane": r["lane"], "all_in": r["cost"], "med": r["med"], "last_sale_ms": _whole(r["last_sale_ms"]), "thin": bool(r["thin"]), "ladder": bool(r["ladder"]), "ends_ms": _whole(r["ends_ms"]), "surfaced_ms": was}
            return (state["lane"], "fresh", state["all_in"], was), state
        if state is None:
            return None, None
        r = rows[0]
        cost = _known(r["cost"])
        same = (state["lane"], "as-was", state["all_in"], state["surfaced_ms"])
        if not r["checked"]:
            return same, state
        if state["lane"] == "closing":
            if cost is None or not call_passes(cost, _known(r["ends_ms"]), state["med"], state["last_sale_ms"], state["thin"], _known(r["seller_score"]), bool(r["flagged"]), self.conf, now):
                return ("closing", "dropped", state["all_in"], state["surfaced_ms"]), None
            fate = "refreshed"
        elif cost is None:
            return (state["lane"], "ended", state["all_in"], state["surfaced_ms"]), None
        elif cost <= state["all_in"]:
            fate = "refreshed"
        elif deal_passes(cost, state["med"], state["last_sale_ms"], bool(r["flagged"]), state["thin"], state["ladder"], self.conf, now):
            fate = "re-gated"
        else:
            return (state["lane"], "dropped", state["all_in"], state["surfaced_ms"]), None
        state = state | {"all_in": cost} | ({"ends_ms": int(r["ends_ms"])} if state["lane"] == "closing" else {})
        return (state["lane"], fate, cost, state["surfaced_ms"]), state

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        """Auctions whose end has passed: what is kept of them goes, unless a later end is known by now."""
        now = expiredTimerInfo.getExpiryTimeInMs()
        if self.frozen.exists():
            self._keep({i: s for i, s in self._states().items() if not (s["lane"] == "closing" and s["ends_ms"] is not None and s["ends_ms"] <= now)})
        return iter([])

    def close(self) -> None:
        pass


def carry_stream(stream: DataFrame, conf: C.Config) -> DataFrame:
    """Fates (CARRY_OUT) of the items of a stream of CARRY_IN; `at` is the tick's time and the watermark's."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS_DB)
    timed = stream.withWatermark("at", "0 seconds")
    return bucketed(timed).transformWithStateInPandas(Carried(conf), CARRY_OUT, "Append", "EventTime")


def carried(spark: SparkSession, ticks: list[DataFrame], folder: str, conf: C.Config) -> DataFrame:
    """Land each of the ticks' tables in turn and run the carry stream, started anew from its checkpoint, after each."""
    for rows in ticks:
        rows.write.mode("append").parquet(f"{folder}/landed")
        stream = spark.readStream.schema(CARRY_IN).parquet(f"{folder}/landed")
        run_available(carry_stream(stream, conf), f"{folder}/fates", f"{folder}/checkpoint")
    return spark.read.schema(CARRY_OUT).parquet(f"{folder}/fates")

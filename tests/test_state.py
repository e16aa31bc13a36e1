"""State across ticks, sources, views and streams."""

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyboard import config as C
from tallyboard.functions import display as D
from tallyboard.operators import board, budget, carry, windows
from tallyboard.sources import hunt, listings, state
from tallyboard.streaming import sweep

CONF = C.Config.at("2026-08-19T17:00:00Z")
NOW = "2026-08-19T17:00:00Z"


def deals(spark, rows):
    """rows: (item, all_in, med, conf, ladder)"""
    out = spark.createDataFrame([(i, float(a), float(m), c, l) for i, a, m, c, l in rows], "item_id string, all_in double, med double, conf string, ladder boolean")
    return out.select(
        "*", F.concat(F.lit("id-"), "item_id").alias("id"), F.lit("watches").alias("vertical"), F.lit("k").alias("key"), F.col("all_in").alias("price"), F.lit(0.0).alias("shipping_cost"), F.lit(9).alias("n12"), F.lit("2026-08-01").alias("last_sale"),
        F.lit("A").alias("risk_grade"), (1 - F.col("all_in") / F.col("med")).alias("depth"), (F.col("med") - F.col("all_in")).alias("edge"), F.lit(0.0).alias("rank"), F.lit(None).cast("string").alias("listed_at"), F.lit("2026-08-18T00:00:00Z").alias("surfaced_at"),
    )


READS = "item_id string, checked boolean, price double, shipping_cost double, title string, ends_at string, bid_count int, seller_score int"


def test_carry_deals(spark):
    prior = deals(spark, [("same", 6400, 9800, "high", False), ("lower", 6200, 8600, "high", False), ("gone", 1, 9, "high", False), ("up-fail", 2500, 3800, "high", False), ("up-pass", 2000, 3100, "high", False), ("fresh", 1, 9, "high", False), ("unseen", 5, 9, "high", False), ("failed", 5, 9, "high", False), ("free", 500, 800, "high", False), ("ladder", 1000, 1600, "high", True), ("flag", 100, 1000, "high", False)])
    fresh = spark.createDataFrame([("fresh",)], "item_id string")
    reads = [("same", True, 6400.0, None, "t"), ("lower", True, 5700.0, 100.0, "t"), ("gone", True, None, None, None), ("up-fail", True, 3100.0, 0.0, "t"), ("up-pass", True, 2200.0, 0.0, "t"), ("failed", False, None, None, None), ("free", True, 10.0, 0.0, "t"), ("ladder", True, 1100.0, 0.0, "t"), ("flag", True, 110.0, 0.0, "torn")]
    got = {r["item_id"]: r for r in carry.carry_deals(prior, fresh, spark.createDataFrame([(*r, None, None, None) for r in reads], READS), CONF).collect()}
    assert {k: v["fate"] for k, v in got.items()} == {"same": "refreshed", "lower": "refreshed", "gone": "ended", "up-fail": "dropped", "up-pass": "re-gated", "unseen": "as-was", "failed": "as-was", "free": "refreshed", "ladder": "dropped", "flag": "dropped"}
    assert got["lower"]["all_in"] == 5800 and abs(got["lower"]["depth"] - (1 - 5800 / 8600)) < 1e-12 and got["unseen"]["all_in"] == 5
    assert abs(got["free"]["depth"] - 0.9875) < 1e-12  # past the cap, but a lower price is not gated again


def test_first_surfaced_is_inherited(spark):
    fresh = deals(spark, [("a", 1, 9, "high", False), ("b", 1, 9, "high", False)]).withColumn("surfaced_at", F.lit(NOW))
    got = {r["item_id"]: r["surfaced_at"] for r in carry.inherit_first_surfaced(fresh, deals(spark, [("a", 1, 9, "high", False)])).collect()}
    assert got == {"a": "2026-08-18T00:00:00Z", "b": NOW}


def test_carry_closing_and_no_book(spark):
    prior = deals(spark, [(x, 300, 1000, "high", False) for x in ("on", "over", "ended", "gone", "later")]).withColumn("bid_count", F.lit(4)).withColumn("ends_at", F.when(F.col("item_id") == "ended", "2026-08-19T16:00:00Z").otherwise("2026-08-20T16:00:00Z"))
    none = spark.createDataFrame([], "item_id string")
    reads = spark.createDataFrame([("on", True, 350.0, 0.0, "t", "2026-08-20T18:00:00Z", None, 60), ("over", True, 700.0, 0.0, "t", "2026-08-20T18:00:00Z", 9, 60), ("gone", True, None, None, None, None, None, None)], READS)
    got = {r["item_id"]: r for r in carry.carry_closing(prior, none, none, reads, CONF).collect()}
    assert {k: v["fate"] for k, v in got.items()} == {"on": "refreshed", "over": "dropped", "gone": "dropped", "later": "as-was"}
    assert (got["on"]["all_in"], got["on"]["bid_count"], got["on"]["ends_at"]) == (350, 4, "2026-08-20T18:00:00Z")
    hits = spark.createDataFrame([("h1", "on", "Megalodon tooth", 5.0, 0.0, 5.0), ("h1", "off", "Shark", 5.0, 0.0, 5.0), ("h9", "orphan", "Megalodon tooth", 5.0, 0.0, 5.0), ("h1", "gone", "Megalodon tooth", 5.0, 0.0, 5.0)], "hunt_id string, item_id string, title string, price double, shipping_cost double, all_in double")
    targets = spark.createDataFrame([("h1", "the megalodon", None, None, "other")], "hunt_id string, q string, title_must string, title_not string, vertical string")
    out = {r["item_id"]: (r["fate"], r["all_in"]) for r in carry.carry_no_book(hits, none, targets, reads, CONF).collect()}
    assert out == {"on": ("refreshed", 350.0), "off": ("dropped", 5.0), "gone": ("dropped", 5.0)}


def test_receipts(spark):
    empty = spark.createDataFrame([], "id string, item_id string, vertical string, key string, lane string, surfaced_at string, depth double, all_in double, med double, conf string, risk_grade string, outcome string, resolved_at string")
    one = carry.record(empty, deals(spark, [("a", 1, 9, "high", False)]), deals(spark, [("b", 2, 9, "high", False), ("a", 7, 9, "high", False)]), "t1")
    two = carry.record(one, deals(spark, [("a", 5, 9, "high", False), ("c", 3, 9, "high", False)]), deals(spark, []), "t2")
    got = {r["id"]: (r["lane"], r["surfaced_at"], r["all_in"], r["outcome"]) for r in two.collect()}
    assert got == {"id-a": (None, "t1", 1.0, "live"), "id-b": ("closing", "t1", 2.0, "live"), "id-c": (None, "t2", 3.0, "live")}
    assert sorted(map(str, carry.record(two, deals(spark, [("a", 5, 9, "high", False)]), deals(spark, []), "t3").collect())) == sorted(map(str, two.collect()))
    ended = carry.resolve(two, spark.createDataFrame([("a",), ("a",)], "item_id string"), "t4")
    again = carry.resolve(ended, spark.createDataFrame([("a",), ("b",)], "item_id string"), "t5")
    assert {r["id"]: (r["outcome"], r["resolved_at"]) for r in again.collect()} == {"id-a": ("ended", "t4"), "id-b": ("ended", "t5"), "id-c": ("live", None)}
    summary = carry.tape_summary(spark.createDataFrame([("sold", 10.0, 5.0), ("sold", 10.0, 8.0), ("live", 1.0, None), ("sold", 0.0, 1.0)], "outcome string, med double, final_price double")).first()
    assert tuple(summary) == (4, 3, 75, 1, 0.65)


@settings(max_examples=25, deadline=None)
@given(st.integers(1, 40), st.integers(1, 15), st.integers(0, 10**6))
def test_rotation_covers_the_pool(n, take, tick):
    """The window's arithmetic: every key is asked within ceil(n / take) ticks when take divides n's steps."""
    take = min(take, n)
    seen = set()
    for t in range(tick, tick + n):
        start = t * take % n
        seen |= {(start + i) % n for i in range(take)}
    assert seen == set(range(n))


def test_rotation_wraps(spark):
    pool = spark.createDataFrame([(f"k{i}", float(100 - i)) for i in range(10)], "k string, score double")
    conf = C.Config(now_ms=3 * C.HOUR_MS * 2)  # second tick of four keys: from place 8
    got = [r["k"] for r in windows.goldmine_window(pool, 4, conf).orderBy("place").collect()]
    assert got == ["k8", "k9", "k0", "k1"]
    assert windows.goldmine_window(pool.limit(0), 4, conf).count() == 0


def test_claims(spark):
    rows = [("x", 1, 1, False, "cut"), ("x", 2, 1, True, None), ("x", 3, 1, True, None), ("y", 1, 1, False, "cut"), ("z", 1, 2, True, None), ("z", 1, 1, True, None)]
    df = spark.createDataFrame(rows, "item_id string, entry_ord int, pos int, kept boolean, reason string")
    got = {(r["item_id"], r["entry_ord"], r["pos"]): r["fate"] for r in windows.claim(df).collect()}
    assert got == {("x", 1, 1): "counted", ("x", 2, 1): "claimed", ("x", 3, 1): "skipped", ("y", 1, 1): "counted", ("z", 1, 1): "claimed", ("z", 1, 2): "skipped"}


def test_budget(spark):
    got = {r["slice"]: (r["pages"], r["goldmine"]) for r in budget.allocate(budget.slices(spark)).collect()}
    assert got["cards-slabs"] == (55, 91) and got["fossils"] == (20, 91) and got["watches-closing"] == (39, 91) and budget.hunt_calls() == 62


def test_sweep_ticks(spark):
    page = spark.createDataFrame([("s1", 1, 0, "a", "2026-08-19T16:00:00Z"), ("s1", 1, 1, "b", "2026-08-19T15:00:00Z"), ("s2", 2, 0, "a", "2026-08-19T16:30:00Z"), ("s2", 2, 1, "c", None), ("s2", 2, 2, "d", "2026-08-19T16:00:00Z")], "slice string, slice_ord int, pos int, item_id string, created string")
    cursors = spark.createDataFrame([("s1", "2026-08-19T15:30:00Z")], "slice string, cursor string")
    seen = spark.createDataFrame([("d", "2026-08-13T00:00:00Z"), ("old", "2026-08-12T16:59:59Z"), ("junk", "?")], "item_id string, seen_at string")
    new = sweep.fresh(page, cursors, seen)
    assert sorted((r["item_id"], r["slice"]) for r in new.collect()) == [("a", "s1"), ("c", "s2")]
    assert {r["slice"]: r["cursor"] for r in sweep.advance(page, cursors).collect()} == {"s1": "2026-08-19T16:00:00Z", "s2": "2026-08-19T16:30:00Z"}
    assert sorted(r["item_id"] for r in sweep.remember(seen, new, CONF).collect()) == ["a", "c", "d"]
    assert sweep.request_from(cursors, CONF).first()["from_ms"] == C.Config.at("2026-08-19T15:00:00Z").now_ms


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([(1, "2026-08-01 00:00:00"), (1, "2026-08-02 00:00:00"), (2, "2026-08-03 00:00:00")], "item long, t string").selectExpr("item", "CAST(t AS TIMESTAMP) AS ts")
    rows.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    got = []
    sweep.run_ticks(sweep.first_looks(stream, "ts", ["item"]), lambda df, _: got.extend(r["item"] for r in df.collect()), f"{tmp_path}/cp")
    assert sorted(got) == [1, 2]
    sweep.run_ticks(sweep.first_looks(stream, "ts", ["item"]), lambda df, _: got.extend(r["item"] for r in df.collect()), f"{tmp_path}/cp")
    assert sorted(got) == [1, 2]


def test_versions(spark, tmp_path):
    root = str(tmp_path / "state")
    assert state.load(spark, root, "seen", "item_id string").count() == 0
    for i in range(4):
        state.commit({"seen": spark.createDataFrame([(str(i),)], "item_id string")}, root, f"v{i}", keep=2)
    assert state.versions(spark, root) == ["v3", "v2"] and state.load(spark, root, "seen", "item_id string").first()[0] == "3"
    assert state.load(spark, root, "other", "x int").count() == 0
    with pytest.raises(FileExistsError):
        state.commit({"seen": spark.range(1)}, root, "v3")


def _commit(spark, root, value, stamp, **more):
    return state.commit({"seen": spark.createDataFrame([(value,)], "item_id string"), "published": spark.createDataFrame([(value, value)], "item_id string, copy string")}, root, stamp, **more)


def _value(spark, root):
    rows = state.load(spark, root, "seen", "item_id string").collect()
    copies = state.load(spark, root, "published", "item_id string, copy string").collect()
    assert [r[0] for r in rows] == [r["copy"] for r in copies]
    return rows[0][0] if rows else None


def test_cut_off_commit_reads_as_before(spark, tmp_path):
    """Files of a commit without a log entry are no state: empty before the first one, else the one before."""
    root = str(tmp_path / "state")
    spark.createDataFrame([("half",)], "item_id string").write.parquet(f"{root}/versions/20260101T00/seen")
    assert _value(spark, root) is None and state.base(spark, root) == 0
    _commit(spark, root, "a", "20260101T00")
    assert _value(spark, root) == "a"
    spark.createDataFrame([("half",)], "item_id string").write.parquet(f"{root}/versions/20260101T03/seen")
    assert _value(spark, root) == "a"
    _commit(spark, root, "b", "20260101T06")
    assert _value(spark, root) == "b" and not (tmp_path / "state" / "versions" / "20260101T03").exists()


def test_second_writer_is_refused(spark, tmp_path):
    root = str(tmp_path / "state")
    _commit(spark, root, "a", "20260101T00", on=0)
    seen = state.base(spark, root)
    _commit(spark, root, "b", "20260101T03", on=seen)
    with pytest.raises(state.Conflict):
        _commit(spark, root, "c", "20260101T03b", on=seen)
    assert _value(spark, root) == "b" and state.versions(spark, root) == ["20260101T03", "20260101T00"]
    assert not (tmp_path / "state" / "versions" / "20260101T03b").exists()


def test_damaged_part_falls_back(spark, tmp_path):
    root = str(tmp_path / "state")
    for i, value in enumerate("abc"):
        _commit(spark, root, value, f"20260101T0{i}")
    part = next((tmp_path / "state" / "versions" / "20260101T02" / "seen").glob("part-*"))
    content = part.read_bytes()
    part.write_bytes(content[:-9] + bytes([content[-9] ^ 1]) + content[-8:])
    (part.parent / f".{part.name}.crc").unlink()
    assert state.damaged(spark, root, "20260101T02") == [f"seen/{part.name}"]
    assert _value(spark, root) == "b"
    next((tmp_path / "state" / "versions" / "20260101T01" / "published").glob("part-*")).unlink()
    assert _value(spark, root) == "a"
    next((tmp_path / "state" / "versions" / "20260101T00" / "seen").glob("part-*")).unlink()
    with pytest.raises(state.Damaged):
        _value(spark, root)


def test_daily_versions_stay(spark, tmp_path):
    root = str(tmp_path / "state")
    for stamp in ("20260101T00", "20260101T12", "20260102T00", "20260102T12", "20260103T00", "20260103T12"):
        _commit(spark, root, stamp, stamp, keep=1)
    assert state.versions(spark, root) == ["20260103T12", "20260102T12", "20260101T12"]


def test_listing_files(spark, tmp_path):
    assert listings.read_listings(spark, str(tmp_path / "none.json")).count() == 0
    (tmp_path / "bad.json").write_text("{not json")
    assert listings.read_listings(spark, str(tmp_path / "bad.json")).count() == 0
    (tmp_path / "map.json").write_text(json.dumps({"s1": [{"itemId": "a", "title": "x", "itemEndDate": "+102m"}], "s2": [{"itemId": "b", "itemEndDate": "2026-08-20"}]}))
    got = {r["item_id"]: (r["slice"], r["ends_at"]) for r in listings.read_listing_map(spark, str(tmp_path / "map.json"), "slice", CONF).collect()}
    assert got == {"a": ("s1", "2026-08-19T18:42:00.000Z"), "b": ("s2", "2026-08-20")}
    (tmp_path / "live.json").write_text(json.dumps({"items": {"a": {"itemId": "a", "price": {"value": "5"}}, "b": None}}))
    live = {r["item_id"]: (r["checked"], r["price"]) for r in listings.read_live_map(spark, str(tmp_path / "live.json"), CONF).collect()}
    assert live == {"a": (True, 5.0), "b": (True, None)}


ENTRY = {"id": "a-1", "label": "L", "vertical": "sports", "match": {"q": "the game ball", "categoryHint": "x"}, "added": "2026-08-01"}


@pytest.mark.parametrize("change", [{"id": "Bad Id"}, {"match": {"q": "x"}}, {"match": {"key": "k", "q": "x", "categoryHint": "y"}}, {"match": {"key": "k", "categoryHint": "y"}}, {"match": {"key": "k", "x": 1}}, {"added": "soon"}, {"maxAllIn": 0}, {"minDepth": 0.9}, {"titleMust": "("}, {"label": " "}])
def test_malformed_hunt_entries(change):
    with pytest.raises(ValueError):
        hunt.entry(ENTRY | change, 1)


def test_hunt_list(spark, tmp_path):
    assert hunt.read_hunt(spark, str(tmp_path / "none.yaml")).count() == 0
    (tmp_path / "h.yaml").write_text("- id: a\n  label: A\n  vertical: sports\n  match: {keyPrefix: 'rolex|'}\n  added: 2026-08-01\n  minDepth: 0.1\n")
    row = hunt.read_hunt(spark, str(tmp_path / "h.yaml")).first()
    assert (row["hunt_id"], row["key_prefix"], row["min_depth"], row["added"]) == ("a", "rolex|", 0.1, "2026-08-01")
    with pytest.raises(ValueError):
        hunt.entries(spark, [ENTRY, ENTRY])


def test_display(spark):
    df = spark.createDataFrame([(1499.5,), (0.0,), (None,), (-12.5,), (1100000.0,), (2449.0,)], "x double")
    assert [r["m"] for r in df.select(D.money(F.col("x")).alias("m")).collect()] == ["$1,500", "$0", "—", "-$13", "$1,100,000", "$2,449"]
    assert [r["m"] for r in df.select(D.money_compact(F.col("x")).alias("m")).collect()] == ["$1.5K", "$0", "—", "-$13", "$1.1M", "$2.4K"]
    one = spark.range(1)
    row = one.select(
        D.trend_pct(F.lit(-0.025)).alias("a"), D.trend_pct(F.lit(0.1)).alias("b"), D.key_grade(F.lit("x|psa9.5")).alias("c"), D.key_grade(F.lit("x|raw")).alias("d"), D.key_grade(F.lit("x|y")).alias("e"),
        D.context_caption(F.lit("signer"), F.lit("charles-schulz")).alias("f"), D.lens_label(F.lit("pokemon")).alias("g"), D.lens_label(F.lit("vintage-apple")).alias("h"), D.bid_label(F.lit(1)).alias("i"),
        D.grade_note(F.lit("pokemon"), F.lit("x|PSA9"), F.lit("x|PSA10")).alias("j"), D.short_date(F.lit("2026-07-04")).alias("k"), D.short_date(F.lit("?")).alias("l"), D.is_board_stale(F.lit("2026-08-19T10:00:00Z"), CONF).alias("m"),
    ).first()
    assert tuple(row) == ("-2%", "+10%", "PSA 9.5", "raw", None, "Charles Schulz signed material", "Pokémon", "Vintage Apple", "1 bid · no action", "book: PSA 10 · this listing: PSA 9", "Jul 4, 2026", "—", True)


def test_statistics(spark):
    rows = spark.createDataFrame([("watches", "tooShallow", 2), ("watches", "noPrice", 1), ("pokemon", "tooShallow", 5)], "vertical string, reason string, n long")
    nested = board.nested_counts(rows, "vertical", "reason").first()["counts"]
    assert nested == {"watches": {"tooShallow": 2, "noPrice": 1}, "pokemon": {"tooShallow": 5}}
    assert [tuple(r) for r in board.flat_reasons(rows).collect()] == [("tooShallow", 7), ("noPrice", 1)]
    assert spark.range(1).select(board.map_total(F.create_map(F.lit("a"), F.lit(2).cast("long"), F.lit("b"), F.lit(3).cast("long"))).alias("t")).first()["t"] == 5
    doc = json.loads(board.artifact(rows, NOW, NOW).first()["value"])
    assert doc["schema"] == 1 and len(doc["deals"]) == 3 and "closing" not in doc


def test_a_deal_meets_one_receipt_of_its_item(spark):
    """Many receipts of one item are one row before they meet its deals; id and item both count, deals of one id share."""
    from pyspark.sql import functions as F

    from tallyboard.operators import carry

    ledger = spark.range(2000).select(F.col("id").alias("ord"), F.concat(F.lit("r"), F.col("id").cast("string")).alias("id"), F.lit("hot").alias("item_id"), F.lit("live").alias("outcome"))
    deals = spark.createDataFrame([("r7", "hot"), ("r9", "none"), ("zz", None), ("r9", "hot")], "id string, item_id string")
    out = carry.deal_receipts(deals, ledger)
    assert sorted((r["id"], r["item_id"] or "", r["receipt_ord"]) for r in out.collect()) == [("r7", "hot", 0), ("r9", "hot", 0), ("r9", "none", 0), ("zz", "", None)]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("min_by") == 2  # receipts by id and by item


def test_items_of_a_bucket_share_one_state(spark):
    """Keys of the carry's and the sweep's state are buckets, so that the state store is not asked once for each item."""
    from tallyboard.streaming import stateful

    rows = spark.range(5000).selectExpr("cast(id as string) AS item_id")
    grouped = stateful.bucketed(rows).count()
    assert grouped.columns[0] == "bucket" and grouped.count() <= stateful.BUCKETS < 5000


def test_first_sight_in_a_bucket():
    """Several items of one bucket, seen and past their time to live, as each alone."""
    import pandas as pd

    from tallyboard.streaming import stateful

    class State(list):
        def exists(self):
            return bool(self)

        def get(self):
            return iter(self)

        def put(self, rows):
            self[:] = rows

    sight = stateful.FirstSight(10)
    sight.seen = State([("a", 0), ("b", 5)])
    sight.handle = type("Handle", (), {"registerTimer": lambda self, at: None})()
    batch = pd.DataFrame({"bucket": 1, "item_id": ["a", "b", "c", "c", "c"], "tick_ms": [11, 15, 15, 20, 26], "slice_ord": 0, "pos": range(5)})
    out = pd.concat(list(sight.handleInputRows((1,), iter([batch]), None)))
    assert out[["item_id", "tick_ms"]].values.tolist() == [["a", 11], ["c", 15], ["c", 26]] and dict(sight.seen) == {"a": 11, "b": 5, "c": 26}

"""The paged market, the parallel JSON reader, ranks, stateful streams' rules, lookups, pivots and the hunt's index."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tallyboard import config as C
from tallyboard.functions import text as T
from tallyboard.operators import board, gates, pricing, ranks
from tallyboard.sources import listings, pages, split
from tallyboard.streaming import stateful

CONF = C.Config.at("2026-08-19T17:00:00Z")


# --- paged market ---------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def market(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("market"))
    rows = spark.range(0, 1000).select(
        F.when(F.col("id") < 500, "a#/1").when(F.col("id") < 900, "b").otherwise("c").alias("category"), F.concat(F.lit("i"), F.col("id").cast("string")).alias("item_id"), F.lit("t").alias("title"), (F.col("id") % 100 + 0.5).alias("price"),
        F.when(F.col("id") % 2 == 0, "FIXED_PRICE").otherwise("AUCTION").alias("buying_option"), F.lit("1").alias("condition_id"), F.col("id").alias("created_ms"), F.when(F.col("id") % 2 == 1, F.col("id")).alias("ends_ms"),
    )
    pages.write_market(rows, path)
    return path


SLICES = [{"slice": "s1", "category": "a#/1"}, {"slice": "s2", "category": "b", "price_from": 50.5}, {"slice": "s3", "category": "c"}, {"slice": "s4", "category": "nowhere"}]


def test_pages_in_order(spark, market):
    rows = sorted(pages.read_pages(spark, market, SLICES).filter("category = 'a#/1'").collect(), key=lambda r: r["pos"])
    assert [r["item_id"] for r in rows] == [f"i{i}" for i in range(499, -1, -1)]
    assert [r["page"] for r in rows] == [i // pages.PAGE for i in range(500)]
    assert pages.read_pages(spark, market, SLICES, budget=1).count() == 200 + sum(i % 100 >= 50 for i in range(700, 900)) + 100


def test_filters_are_pushed(spark, market):
    """Pages of other categories are not planned, bounds are floored and ceiled, what Spark must check again stays."""
    reader = pages.PageReader({"path": market, "slices": json.dumps(SLICES)})
    asked = [pages.EqualTo(("category",), "a#/1"), pages.GreaterThanOrEqual(("price",), 3.7), pages.LessThan(("price",), 9.2), pages.EqualTo(("buying_option",), "AUCTION"), pages.EqualTo(("title",), "t")]
    assert [*reader.pushFilters(asked)] == [asked[1], asked[2], asked[4]]
    assert reader.asked == {"price_from": 3, "price_to": 10, "buying_option": "AUCTION"}
    assert {(p.slice["slice"], p.page) for p in reader.partitions()} == {("s1", 0), ("s1", 1), ("s1", 2)}
    rows = pages.read_pages(spark, market, SLICES).filter("category = 'a#/1' AND price >= 3.7 AND price < 9.2 AND buying_option = 'AUCTION'")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "buying_option" not in plan.split("BatchScan")[0].replace("buying_option#", "") or "price" in plan
    assert sorted(r["price"] for r in rows.select("price").distinct().collect()) == [5.5, 7.5]


def test_degraded_slice(spark, market):
    slices = [*SLICES[:3], {"slice": "late", "category": "b", "ends_after": 600, "ends_before": 650}]
    refuses = {"b": ["price_from", "ends_before"]}
    rows = pages.read_pages(spark, market, slices, refuses=refuses)
    told = {r["slice"]: (r["calls"], r["listings"], r["degraded"]) for r in pages.ledger(spark, rows, market, slices).collect()}
    assert told["s1"] == (3, 500, False) and told["s3"] == (1, 100, False)
    assert told["s2"] == (3 + 2, 400, True)  # without its own filter: the gate decides
    sound = {r["item_id"] for r in pages.read_pages(spark, market, slices).filter("slice = 'late'").collect()}
    assert {r["item_id"] for r in rows.filter("slice = 'late'").collect()} == sound == {f"i{i}" for i in range(601, 651, 2)}


# --- one large document -----------------------------------------------------------------------------
def _document(n):
    r = random.Random(n)
    marks = ['"', "\\", "{", "}", "[", "]", ",", "\n", "é", "x"]
    rows = [{"k": "".join(r.choices(marks, k=r.randrange(12))), "deep": {"a": [{"b": "}"}], "c": {"d": {}}}, "i": i} for i in range(n)]
    return {"schema": 1, "ladder": {"base": 1, "rungs": {"10": 2, "9": {"x": {}}}}, "empty": [], "rows": rows, "name": 'a "rows": [ {', "context": [{"k": "c"}, {"k": "d"}]}


@pytest.mark.parametrize("n,size,indent", [(0, 100, None), (1, 100, None), (300, 64, None), (300, 1000, 1), (300, 1 << 20, None)])
def test_large_document(spark, tmp_path, n, size, indent):
    doc, path = _document(n), str(tmp_path / "book.json")
    (tmp_path / "book.json").write_text(json.dumps(doc, indent=indent, ensure_ascii=False))
    rows = split.array_objects(spark, path, "rows", split=size)
    assert [json.loads(r["text"]) for r in sorted(rows.collect(), key=lambda r: r["pos"])] == doc["rows"]
    assert sorted(r["pos"] for r in rows.collect()) == list(range(n))
    context = split.array_objects(spark, path, "context", split=size).collect()
    assert [json.loads(r["text"]) for r in sorted(context, key=lambda r: r["pos"])] == doc["context"]
    assert split.array_objects(spark, path, "empty", split=size).count() == 0


@pytest.mark.parametrize(("size", "most"), [(64, 2048), (64, 7), (1 << 20, 2048)])
def test_document_in_several_files(spark, tmp_path, monkeypatch, size, most):
    monkeypatch.setattr(split, "MOST_SPLITS", most)
    doc = {"none": [], "rows": [{"k": f'{i} "}}\\', "more": {"marks": ["]", "["]}} for i in range(300)], "also": [{"k": "x"}]}
    parts = [x + "}" for x in json.dumps(doc).split("}")[:-1]]
    for i in range(5):
        (tmp_path / f"part-{i:05}").write_text("".join(parts[i * len(parts) // 5 : (i + 1) * len(parts) // 5]))
    rows = split.array_objects(spark, str(tmp_path), "rows", split=size).collect()
    assert [json.loads(r["text"]) for r in sorted(rows, key=lambda r: r["pos"])] == doc["rows"]
    assert sorted(r["pos"] for r in rows) == list(range(300))
    assert [r["text"] for r in split.array_objects(spark, str(tmp_path), "also", split=size).collect()] == ['{"k": "x"}']


@pytest.mark.parametrize("text", ["{}", '{"error": {"message": "no"}}', '{"rowz": [{"k": 1}]}', '{"rows": {"k": {"k": {}}}}', "<html>502</html>"])
def test_document_without_the_array(spark, tmp_path, text):
    (tmp_path / "bad.json").write_text(text)
    with pytest.raises(ValueError, match="no array"):
        split.array_objects(spark, str(tmp_path / "bad.json"), "rows")


# --- ranks ------------------------------------------------------------------------------------------
@pytest.mark.parametrize("kind", ["all", "ties", "few"])
def test_ranks(spark, kind, monkeypatch):
    monkeypatch.setattr(ranks, "SMALL", 10)
    r = random.Random(7)
    values = {"all": [r.gauss(0, 1) for _ in range(3000)], "ties": [r.choice([1.0, 2.0, 2.0, 2.0]) if r.random() < 0.95 else r.random() for _ in range(3000)], "few": [3.0, 1.0]}[kind]
    rows = spark.createDataFrame([(v,) for v in [*values, None, float("nan")]], "v double").repartition(3)
    order = sorted(values)
    asked = sorted({0, len(order) // 3, len(order) - 1})
    assert ranks.values_at(rows, F.col("v"), asked) == [order[i] for i in asked]
    middle = (order[(len(order) - 1) // 2] + order[len(order) // 2]) / 2
    assert ranks.median(rows, F.col("v")) == middle
    assert ranks.median(rows.limit(0), F.col("v")) is None


def test_circular_and_numbered(spark, monkeypatch):
    monkeypatch.setattr(ranks, "SMALL", 10)
    values = [i * i for i in range(500)]
    rows = spark.createDataFrame([(v, "x") for v in values], "ord long, other string").repartition(3)
    for start, take in ((0, 3), (498, 5), (1234, 60), (3, 1000)):
        got = {r["ord"]: r["place"] for r in ranks.circular(rows, "ord", start, take).collect()}
        assert got == {values[(start + i) % 500]: i for i in range(min(take, 500))}
    assert ranks.circular(rows.limit(0), "ord", 1, 5).count() == 0
    assert {r["ord"]: r["rank"] for r in ranks.numbered(rows, "ord", 8).collect()} == {v: i for i, v in enumerate(values)}
    assert ranks.numbered(rows.limit(0), "ord").count() == 0


# --- rules of the carry stream ------------------------------------------------------------------------
def test_stream_gates_are_the_gates(spark):
    r = random.Random(9)
    now, old = CONF.now_ms, CONF.now_ms - int(24 * C.MONTH_MS)
    rows = [(r.choice([0.0, 1.0, 40.0, 60.0, 65.0, 74.0, 75.0, 500.0, 600.0, 650.0]), r.choice([100.0, 1000.0, 0.0]), r.choice([None, old - 1, old, now]), r.random() < 0.2, r.random() < 0.3, r.random() < 0.3, r.choice([None, now, now + 1, now + CONF.goldmine_window_ms, now + CONF.goldmine_window_ms + 1]), r.choice([None, 49, 50])) for _ in range(800)]
    df = spark.createDataFrame(rows, "cost double, med double, sale long, flagged boolean, thin boolean, ladder boolean, ends long, score long")
    deal = gates.gate(F.col("cost"), F.col("med"), F.col("sale"), F.col("flagged"), F.col("thin"), CONF, F.col("ladder")).isNull()
    call = gates.closing_gate(F.col("cost"), F.col("ends"), F.col("med"), F.col("sale"), F.col("thin"), F.col("score"), F.col("flagged"), CONF, CONF.goldmine_window_ms).isNull()
    for x in df.select("*", deal.alias("deal"), call.alias("call")).collect():
        assert stateful.deal_passes(x["cost"], x["med"], x["sale"], x["flagged"], x["thin"], x["ladder"], CONF, now) == x["deal"], x
        assert stateful.call_passes(x["cost"], x["ends"], x["med"], x["sale"], x["thin"], x["score"], x["flagged"], CONF, now) == x["call"], x


# --- lookups, pivots, index, slugs -----------------------------------------------------------------------
def test_lookup_batches_never_take_unread_for_gone(spark):
    ids = spark.range(100).select(F.concat(F.lit("i"), F.col("id").cast("string")).alias("item_id"), (F.col("id") * 3).alias("ord"))
    there = ids.filter("ord % 2 = 0").select("item_id", F.lit(5.0).alias("price"))
    none = spark.createDataFrame([], "batch long")
    got = {r["item_id"]: (r["state"], r["price"]) for r in listings.lookup_batches(ids, there, spark.createDataFrame([(1,)], "batch long")).collect()}
    assert got["i20"] == ("unread", None) and got["i0"] == ("alive", 5.0) and got["i1"] == ("gone", None)
    got = {r["item_id"]: r["state"] for r in listings.lookup_batches(ids, there, none, refused=2, errors=ids.filter("ord = 195").select("item_id"), singles=45).collect()}
    assert [got[f"i{i}"] for i in (39, 40, 59, 60, 79, 80, 99)] == ["gone", "alive", "gone", "unread", "unread", "unread", "unread"]


def test_slice_columns_are_found(spark):
    rows = spark.createDataFrame([("a", "surfaced", 1.0), ("a", "zebra", 2.0), ("b", "calls", 3.0), ("b", "ant", 4.0), ("b", "calls", 1.0), ("b", "bad", float("nan")), ("c", None, 1.0)], "slice string, name string, value double")
    out = board.slice_columns(rows, "slice", "name", "value")
    assert out.columns == ["slice", "calls", "surfaced", "ant", "zebra"]
    assert sorted(map(tuple, out.collect())) == [("a", None, 1.0, None, 2.0), ("b", 4.0, None, 4.0, None)]
    with pytest.raises(ValueError):
        board.slice_columns(rows, "slice", "name", "value", most=2)


def test_relevant_pairs(spark):
    titles = spark.createDataFrame([(1, "Red  Widget no1"), (2, "blue gadgets, RED"), (3, "a bc"), (4, None)], "p int, title string")
    entries = [("h1", "red", None, None), ("h2", "the gadget", None, None), ("h3", "b", None, None), ("h4", None, "wid", None), ("h5", "red", None, "blue"), ("h6", "of the", None, None), ("h7", "zzz", None, None), ("h8", "no1 widget", None, None)]
    rows = spark.createDataFrame([(*e, "other") for e in entries], "hunt_id string, q string, title_must string, title_not string, vertical string")
    got = {(r["hunt_id"], r["p"]) for r in pricing.relevant_pairs(titles, rows).collect()}
    every = titles.crossJoin(rows).filter(pricing.relevant(F.col("title"), F.col("q"), F.col("title_must"), F.col("title_not"), F.col("vertical")))
    assert got == {(r["hunt_id"], r["p"]) for r in every.collect()} and ("h3", 3) in got and ("h2", 2) in got


def test_slugs_of_compatibility_characters(spark):
    said = {"ﬁne Ａrt ² ½": "fine-art-2-1-2", "№5": "o5", "Ⅳ ⑩ ㎏": "iv-10-kg", "Ŀ ŉ ǆ": "l-n-dz", "𝐛old ß": "bold", "Éà & Co": "ea-and-co", "": ""}
    rows = spark.createDataFrame([(k,) for k in said], "t string")
    assert {r["t"]: r["s"] for r in rows.select("t", T.slug(F.col("t")).alias("s")).collect()} == said


def test_leading_player_and_rollups(spark):
    rows = spark.createDataFrame([("Reggie White, Game Used Jersey",), ("reggie White",), ("Reggie. White. x",)], "title string")
    assert [r[0] for r in rows.select(pricing.leading_player(F.col("title"))).collect()] == ["reggie-white", None, "reggie-white"]


def test_words_meet_whole(spark, monkeypatch):
    """Numbered titles and entries meet by whole words, so that pairs grow as the input does, and frequent words are dealt out."""
    n = 2000
    titles = spark.range(n).select(F.col("id").alias("p"), F.concat(F.lit("Widget no"), (F.col("id") + 10_000).cast("string"), F.when(F.col("id") % 9 == 0, " 77 rare77").otherwise("")).alias("title"))
    none = F.lit(None).cast("string")
    rows = spark.range(n).select(F.concat(F.lit("h"), F.col("id").cast("string")).alias("hunt_id"), F.when(F.col("id") == 0, "rare77 widget").otherwise(F.concat(F.lit("widget no"), (F.col("id") + 10_000).cast("string"))).alias("q"), none.alias("title_must"), none.alias("title_not"), F.lit("other").alias("vertical"))
    monkeypatch.setattr(pricing, "SHARE", 16)
    monkeypatch.setattr(pricing, "relevant", lambda *_: F.lit(True))
    met = [tuple(r) for r in pricing.relevant_pairs(titles, rows).select("hunt_id", "p").collect()]
    assert len(met) == len({*met}) == n - 1 + len(range(0, n, 9))
    monkeypatch.setattr(pricing, "MOST_STARTS", 0)
    assert sorted(met) == sorted(tuple(r) for r in pricing.relevant_pairs(titles, rows).select("hunt_id", "p").collect())

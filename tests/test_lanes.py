"""Published files read back, and merges and compiled queries with nulls, ties and nothing at all."""

import json

from tallyboard.operators import hunting, lanes
from tallyboard.plans.twins import CONF
from tallyboard.schemas import HUNT_ENTRY
from tallyboard.sources import artifact

CALL = {"id": "i", "title": "t", "endsAt": "2001-01-01T01:00:00Z", "currentBid": 1, "allInBid": 2.5, "bidVsBook": 0.5, "med": 9, "lo": 8, "hi": 10}


def board(spark, tmp_path, text):
    path = tmp_path / "board.json"
    path.write_text(text)
    return artifact.read_board(spark, str(path)).first()


def test_board_passes_valid_rows_only(spark, tmp_path):
    calls = [CALL, CALL | {"endsAt": "soon"}, CALL | {"med": "9"}, CALL | {"title": None}, {}]
    text = json.dumps({"schema": 2, "builtAt": "b", "deals": [{"id": "d", "rank": 2}], "closing": calls, "leads": [{"title": "x"}, {"id": "y"}], "hunt": {"targets": []}, "more": 1})
    got = board(spark, tmp_path, text)
    assert (got["schema"], got["builtAt"], got["bookBuiltAt"]) == (1, "b", "")
    assert [d["id"] for d in got["deals"]] == ["d"] and [c["id"] for c in got["closing"]] == ["i"] and [x["title"] for x in got["leads"]] == ["x"]
    assert got["hunt"] is None and got["stats"] is None


def test_board_without_deals_is_empty(spark, tmp_path):
    missing = artifact.read_board(spark, str(tmp_path / "none.json")).first()
    for text in ("{", "[]", '{"builtAt": "b", "closing": []}'):
        assert board(spark, tmp_path, text) == missing
    assert missing["deals"] == [] and missing["builtAt"] == ""
    empty = board(spark, tmp_path, json.dumps({"deals": [], "leads": [], "closing": [{}]}))
    assert empty["deals"] == [] and empty["leads"] is None and empty["closing"] is None


def test_receipts(spark, tmp_path):
    path = tmp_path / "receipts.json"
    assert artifact.read_receipts(spark, str(path)).count() == 0
    path.write_text("no json")
    assert artifact.read_receipts(spark, str(path)).count() == 0
    path.write_text(json.dumps([{"id": "a", "med": 2.0}, {"med": 1.0}, {"id": "b"}]))
    assert [(r["ord"], r["id"]) for r in artifact.read_receipts(spark, str(path)).collect()] == [(0, "a"), (2, "b")]


def test_context_guard(spark):
    rows = spark.createDataFrame([(("k", "class", 1.0, 1.0, 1.0, 1),), (("k", "class", float("nan"), 1.0, 1.0, 1),), (("k", None, 1.0, 1.0, 1.0, 1),), (None,)], "c struct<k:string,kind:string,med:double,lo:double,hi:double,n:bigint>")
    assert [r[0] for r in rows.select(artifact.valid_context(rows.c)).collect()] == [True, False, False, False]


def test_merge_of_ties_and_nothing(spark):
    a = spark.createDataFrame([("x", "2", 1.0), ("x", "1", 2.0)], "item_id string, id string, price double")
    b = spark.createDataFrame([("x", "0"), ("y", "9"), ("y", "9")], "item_id string, id string")
    assert sorted(map(tuple, lanes.merge(a, b).select("item_id", "id", "price", "lane_ord").collect())) == [("x", "1", 2.0, 0), ("y", "9", None, 1)]
    assert lanes.merge(a.limit(0), b.limit(0)).count() == 0


def test_terms(spark):
    rows = spark.createDataFrame([("sports-cards", "a-b|1990|topps|7|raw"), ("pokemon", "1999|base-set|4|shadowless|PSA9.5"), ("autographs", "a-b|nope"), ("art-editions", "a|"), ("watches", "omega|x-1"), ("design", "d|m"), (None, None)], "v string, k string")
    got = [r[0] for r in rows.select(hunting.book_terms(rows.v, rows.k)).collect()]
    assert got == ["a b 1990 topps #7", "1999 Pokemon base set #4 Shadowless PSA 9.5", "a b signed", "a", None, None, None]
    assert [r[0] for r in rows.select(hunting.key_terms(rows.v, rows.k)).collect()] == [None] * 4 + ["omega x 1"] + [None] * 2


def test_hunt_of_nothing(spark):
    book = spark.createDataFrame([], "k string, v string, med double, lo double, hi double")
    assert hunting.compile_hunt(spark.createDataFrame([], HUNT_ENTRY), book, CONF).count() == 0

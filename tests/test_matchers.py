"""Identity, gates and scores over our own listings; the clock stands at 2026-08-19 17:00 UTC."""

import json
import re

import pytest
from pyspark.sql import functions as F

from tallyboard import config as C
from tallyboard.functions import text as T
from tallyboard.operators import board, gates, hunting, identity, pricing, scoring
from tallyboard.sources import book as book_source
from tallyboard.sources import listings as listing_source

CONF = C.Config.at("2026-08-19T17:00:00Z")


def raw(item, title, price, ship="0", aspects=None, **more):
    return {
        "itemId": item, "title": title, "price": {"value": str(price), "currency": "USD"}, "image": {"imageUrl": "i"},
        "seller": {"username": "s", "feedbackPercentage": "99.6", "feedbackScore": 1200, "sellerAccountType": "BUSINESS"},
        "shippingOptions": [{"shippingCost": {"value": ship}}] if ship is not None else [], "itemCreationDate": "2026-08-19T10:00:00Z", "buyingOptions": ["FIXED_PRICE"],
        "localizedAspects": [{"name": k, "type": "STRING", "value": v} for k, v in (aspects or {}).items()],
    } | more


CASES = {
    "sports-cards": [
        (raw("c1", "x", 100, aspects={"Player": "Tobias Vane, Jr.", "Year": "1991", "Set": "Upper  Deck", "Card Number": "#44", "Grade": "PSA 10"}), "tobias-vane-jr|1991|upper deck|44|PSA10"),
        (raw("c2", "1984 Donruss Marlon Keel Rookie RC #212 PSA 6", 100), "marlon-keel|1984|donruss|212|PSA6"),
        (raw("c3", "1976 O-Pee-Chee Anders Holt #77 BGS 7.5", 100), "anders-holt|1976|opc|77|BGS7.5"),
        (raw("c4", "2011 Topps Chrome Dario Quill #164", 100), "dario-quill|2011|topps chrome|164|raw"),
        (raw("c5", "Keel card #212 PSA 5", 100), None),
        (raw("c6", "2004 Bowman Dario #51 PSA 9", 100), None),
        (raw("c7", "1962 Topps Zoë Brânzei #9 SGC 7", 100), "zoe-branzei|1962|topps|9|SGC7"),
    ],
    "pokemon": [
        (raw("p1", "2002 Pokemon Aquapolis Holo Furret #H9 PSA 8", 1), "2002|aquapolis-furret|H9|unl|PSA8"),
        (raw("p2", "2000 Pokémon Gym Heroes 1st Edition #33 CGC NM-MT 8", 1), "2000|gym-heroes|33|1st|CGC8"),
        (raw("p3", "Shadowless Aquapolis #5", 1, aspects={"Year": "2003", "Set": "Aquapolis", "Grade": "9", "Professional Grader": "psa"}), "2003|aquapolis|5|shadowless|PSA9"),
        (raw("p4", "2002 Pokemon Aquapolis #4 ungraded", 1), None),
    ],
    "art-editions": [
        (raw("a1", "Mara Venn – Quiet Harbour (Open Edition) 12/100 signed screenprint", 1), "mara-venn|quiet-harbour-open-screenprint"),
        (raw("a2", "Low Tide lithograph", 1, aspects={"Artist": "Ines Okafor", "Title": "Low Tide at Dawn"}), "ines-okafor|low-tide-at-dawn"),
        (raw("a3", "Piet Rademaker - abstract oil on canvas", 1), None),
        (raw("a4", "X - print", 1), None),
    ],
    "autographs": [
        (raw("s1", "Hedda Lorne Typed Letter Signed TLS", 1), "hedda-lorne|tls"),
        (raw("s2", "Pieter van Aalst ALS 1820", 1), "pieter-van-aalst|als"),
        (raw("s3", "Milo Strand signed photo PSA/DNA", 1), "milo-strand|sp"),
        (raw("s4", "Signed Photo", 1, aspects={"Signed By": "Orla Finch King, Jr."}), "orla-finch-king|sp"),
        (raw("s5", "Edmund Pell document signed facsimile", 1), None),
        (raw("s6", "Vera Stahl signature cut", 1), None),
        (raw("s7", "Rufus de DS", 1), None),
    ],
    "watches": [
        (raw("w1", "Rolex Datejust 1987 16234 steel", 1), "rolex|16234"),
        (raw("w2", "Jumbo", 1, aspects={"Brand": "Audemars Piguet", "Reference Number": "25860 OR"}), "audemars-piguet|25860or"),
        (raw("w3", "Patek Calatrava from 1962", 1), None),
        (raw("w4", "Rolex 16234 homage", 1), None),
        (raw("w5", "Omega Seamaster 2254/50 box", 1), "omega|2254/50"),
    ],
    "design": [
        (raw("d1", "Eames LCM-2 chair", 1), "charles-eames|lcm2"),
        (raw("d2", "Nakashima Frenchman bench", 1), "george-nakashima|frenchman"),
        (raw("d3", "Prouve model no. 412 chair", 1), "jean-prouve|412"),
        (raw("d4", "Eames style of chair", 1), None),
        (raw("d5", "Jeanneret teak chair", 1), None),
    ],
}


def frame(spark, items, vertical):
    text = spark.createDataFrame([(json.dumps(items),)], "value string")
    parsed = F.from_json("value", f"ARRAY<STRUCT<{listing_source._colons(listing_source.RAW_LISTING)}>>")
    rows = listing_source.normalize(text.select(F.posexplode(parsed).alias("pos", "r")).select("pos", "r.*"))
    return rows.withColumn("matchers", F.array(F.lit(vertical)))


@pytest.mark.parametrize("vertical", CASES)
def test_identity(spark, vertical):
    rows = identity.identify(frame(spark, [c[0] for c in CASES[vertical]], vertical), F.col("matchers"))
    got = {r["item_id"]: r["key"] for r in rows.collect()}
    assert got == {c[0]["itemId"]: c[1] for c in CASES[vertical]}


def test_matchers_in_order(spark):
    rows = frame(spark, [raw("w", "Rolex 16234 signed photo by Milo Strand", 1)], "watches").withColumn("matchers", F.array(F.lit("autographs"), F.lit("watches")))
    assert [(r["key"], r["vertical"]) for r in identity.identify(rows, F.col("matchers")).collect()] == [("rolex|16234", "watches")]


def test_normalize(spark):
    items = [
        raw("n1", None, "abc", ship=None, currentBidPrice={"value": "7.5"}), raw("n2", "t", "NaN", ship="5"), raw("n3", "t", "3", shippingOptions=[{"shippingCost": {"value": "9"}}, {"shippingCost": {"value": "0"}}, {"shippingCostType": "CALCULATED"}]),
    ]
    got = {r["item_id"]: (r["title"], r["price"], r["shipping_cost"]) for r in frame(spark, items, "watches").collect()}
    assert got == {"n1": ("", 7.5, None), "n2": ("t", 0.0, 5.0), "n3": ("t", 3.0, 0.0)}


def test_condition_flags(spark):
    titles = ["Creased and TORN, creased", "partial refund offered", "partial set", "miscut error card", "fine", "émissing part", "as is", None]
    got = [r["f"] for r in spark.createDataFrame([(t,) for t in titles], "t string").select(scoring.condition_flags(F.col("t")).alias("f")).collect()]
    assert got == [["creased", "torn"], [], ["partial"], [], [], ["missing"], ["as is"], []]


def test_slug_and_ids(spark):
    df = spark.createDataFrame([("Café & Zoë",), ("  --A  b  ",), ("Tobias Vane, Jr.",), (None,)], "t string")
    assert [r["s"] for r in df.select(T.slug(F.col("t")).alias("s")).collect()] == ["cafe-and-zoe", "a-b", "tobias-vane-jr", ""]
    ids = spark.createDataFrame([(f"v1|930000000{i}|0",) for i in (1, 2, 3)], "t string").select(T.deal_id(F.col("t")).alias("i"))
    assert [r["i"] for r in ids.collect()] == ["1rkdcf5", "1rkdd9e", "1rkde3n"]
    url = spark.createDataFrame([("a b|c'(d)~é",)], "t string").select(T.uri_component(F.col("t")).alias("u")).first()["u"]
    assert url == "a%20b%7Cc'(d)~%C3%A9"


GATE = [
    # all_in, med, months since sale, flagged, conf, ladder -> reason
    (0, 100, 1, False, "high", False, "no-price"), (60, 0, 1, False, "high", False, "no-price"), (600, 1000, 25, False, "high", False, "stale-book"), (600, 1000, None, False, "high", False, None),
    (600, 1000, 1, True, "high", False, "condition-flag"), (50, 1000, 1, False, "high", False, "scam-cap"), (800, 1000, 1, False, "high", False, "too-shallow"), (700, 1000, 1, False, "thin", False, "thin-shallow"),
    (700, 1000, 1, False, "high", True, "ladder-shallow"), (620, 1000, 1, False, "thin", True, "thin-shallow"), (600, 1000, 1, False, "thin", True, None), (700, 1000, 1, False, "high", False, None), (70, 100, 1, False, "high", False, "edge-floor"),
]


def test_gate_order(spark):
    rows = [(i, float(a), float(m), None if mo is None else CONF.now_ms - int(mo * C.MONTH_MS), f, c, l) for i, (a, m, mo, f, c, l, _) in enumerate(GATE)]
    df = spark.createDataFrame(rows, "i int, a double, m double, t long, f boolean, c string, l boolean")
    got = df.select("i", gates.gate(F.col("a"), F.col("m"), F.col("t"), F.col("f"), F.col("c") == "thin", CONF, F.col("l")).alias("r")).orderBy("i").collect()
    assert [r["r"] for r in got] == [g[-1] for g in GATE]


def test_closing_gate_order(spark):
    now, h = CONF.now_ms, C.HOUR_MS
    cases = [
        (0, 100, now + h, "high", 99, False, "no-bid"), (50, 0, now + h, "high", 99, False, "no-price"), (50, 900, now, "high", 99, False, "end-window"), (50, 900, None, "high", 99, False, "end-window"), (50, 900, now + 5 * h, "high", 99, False, "end-window"),
        (50, 900, now + h, "thin", 99, False, "thin-book"), (50, 900, now + h, "high", 49, False, "seller-floor"), (50, 900, now + h, "high", None, False, "seller-floor"), (50, 900, now + h, "high", 99, True, "condition-flag"),
        (700, 900, now + h, "high", 99, False, "too-shallow"), (30, 70, now + h, "high", 99, False, "edge-floor"), (5, 900, now + 4 * h, "high", 50, False, None),
    ]
    df = spark.createDataFrame([(i, float(a), float(m), e, c, s, f) for i, (a, m, e, c, s, f, _) in enumerate(cases)], "i int, a double, m double, e long, c string, s int, f boolean")
    got = df.select("i", gates.closing_gate(F.col("a"), F.col("e"), F.col("m"), F.lit(now), F.col("c") == "thin", F.col("s"), F.col("f"), CONF).alias("r")).orderBy("i").collect()
    assert [r["r"] for r in got] == [c[-1] for c in cases]


def test_evidence_and_fresh(spark):
    now = CONF.now_ms
    df = spark.createDataFrame([(6.0, None, 0), (7.0, 2, -1), (13.0, 9, C.DAY_MS), (None, 0, None)], "m double, n long, age long")
    row = df.select(scoring.evidence_weight(F.lit(now) - F.floor(F.col("m") * C.MONTH_MS), F.col("n"), now).alias("e"), scoring.fresh_boost(F.lit(now) - F.col("age"), CONF).alias("f")).collect()
    assert [round(r["e"], 6) for r in row] == [1.0, 0.7225, 0.55, 0.385] and [r["f"] for r in row] == [1.15, 1.0, 1.0, 1.0]


BOOK = {
    "schema": 1, "builtAt": "2026-08-19T00:00:00Z",
    "rows": [
        {"k": "marlon-keel|1984|donruss|212|PSA6", "v": "sports-cards", "med": 8000, "lo": 6000, "hi": 9000, "n": 9, "n12": 5, "lastSale": "2026-08-01", "trend": None, "conf": "high"},
        {"k": "rolex|16234", "v": "watches", "med": 1, "lo": 1, "hi": 1, "n": 9, "lastSale": "2026-08-01", "conf": "high"},
        {"k": "rolex|16234", "v": "watches", "med": 9800, "lo": 8000, "hi": 12000, "n": 9, "lastSale": "2026-08-01", "conf": "high"},
        {"k": "dario-quill|2004|bowman|51|PSA10", "v": "sports-cards", "med": 2600, "lo": 2000, "hi": 3000, "n": 4, "lastSale": "2026-08-01", "conf": "medium"},
        {"k": "dario-quill|2004|bowman|51|BGS9", "v": "sports-cards", "med": 9, "lo": 9, "hi": 9, "n": 40, "lastSale": "2026-08-01", "conf": "medium"},
        {"k": "dario-quill|2004|bowman|51|raw", "v": "sports-cards", "med": 9, "lo": 9, "hi": 9, "n": 90, "lastSale": "2026-08-01", "conf": "medium"},
    ],
    "gradeLadder": {"base": 8, "rungs": {"10": 2.6, "9": 1.6, "8": 1.0}},
    "context": [{"k": "megalodon-tooth", "v": "science", "kind": "class", "med": 240, "lo": 1, "hi": 9, "n": 9, "lastSale": "2026-01-01"}, {"k": "nell-arbuckle", "v": "autographs", "kind": "signer", "med": 900, "lo": 1, "hi": 9, "n": 9, "lastSale": "2026-01-01"}],
}


@pytest.fixture(scope="module")
def book(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("book") / "book.json"
    path.write_text(json.dumps(BOOK))
    return book_source.read_book(spark, str(path), CONF)


def test_book(spark, book, tmp_path):
    assert not book.stale and book.rows.count() == 5
    assert book.rows.filter("k = 'rolex|16234'").first()["med"] == 9800
    (tmp_path / "old.json").write_text(json.dumps(BOOK | {"builtAt": "2026-08-01"}))
    assert book_source.read_book(spark, str(tmp_path / "old.json"), CONF).stale
    assert not book_source.read_or_sample(spark, str(tmp_path / "none"), str(tmp_path / "old.json"), CONF).stale
    q = {r["key"]: (r["q"], r["price_min"], r["price_max"]) for r in hunting.compile_pool(book.rows).select(F.col("k").alias("key"), "q", "price_min", "price_max").collect()}
    assert q["marlon-keel|1984|donruss|212|PSA6"] == ("marlon keel 1984 donruss #212 PSA6", 3000, 10350) and q["rolex|16234"][0] == "rolex 16234"


def test_pricing_with_ladder(spark, book):
    items = [raw("b1", "2004 Bowman Dario Quill #51 PSA 9", 900), raw("b2", "2004 Bowman Dario Quill #51 SGC 9", 900), raw("b3", "2004 Bowman Dario Quill #51 PSA 7", 900), raw("b4", "1984 Donruss Marlon Keel #212 PSA 6", 5000), raw("b5", "2004 Bowman Dario Quill #51 BGS 9", 900)]
    rows = identity.identify(frame(spark, items, "sports-cards"), F.col("matchers"))
    got = {r["item_id"]: r for r in board.judge(board.price(rows, book.rows, book.rungs), CONF).collect()}
    assert (got["b1"]["med"], got["b1"]["lo"], got["b1"]["ladder"], got["b1"]["basis_key"]) == (1600, 1231, True, "dario-quill|2004|bowman|51|PSA10")
    assert got["b1"]["gate_reason"] is None and abs(got["b1"]["depth"] - (1 - 900 / 1600)) < 1e-12
    assert got["b2"]["gate_reason"] == got["b3"]["gate_reason"] == "noBookRow"
    assert got["b4"]["matched"] and not got["b4"]["ladder"] and got["b4"]["gate_reason"] is None
    assert got["b5"]["matched"] and got["b5"]["med"] == 9
    risk = got["b4"]["risk"]
    assert (risk["score"], risk["grade"]) == (5 + 30 + 6 + 10, "C") and risk["reasons"][0] == "raw, no authenticity anchor"
    deals = board.deals(board.judge(board.price(rows, book.rows, book.rungs), CONF), "2026-08-19T17:00:00Z", "https://e.org")
    out = board.publish_deals(deals, CONF).collect()
    assert [r["item_id"] for r in out] == ["b4", "b1"] and [r["tier"] for r in out] == ["featured", "worth-a-look"] and all(r["is_new"] for r in out)
    assert out[1]["evidence_url"].endswith("sports-cards/dario-quill%7C2004%7Cbowman%7C51%7CPSA10")


def test_cert_verdicts(spark):
    items = [raw("v1", "1984 Donruss Marlon Keel #212 PSA 6", 5000, aspects={"Certification Number": "77"}), raw("v2", "1984 Donruss Marlon Keel #212 PSA 6", 5000, aspects={"Certification Number": "78"})]
    rows = identity.identify(frame(spark, items, "sports-cards"), F.col("matchers")).withColumn("signals", scoring.risk_signals(F.col("vertical")))
    verdicts = spark.createDataFrame([("77", True, "Keel"), ("77", True, "Keel"), ("78", False, None)], "cert string, verified boolean, subject string")
    got = {r["item_id"]: r["signals"] for r in scoring.with_cert_verdicts(rows, verdicts).collect()}
    assert got["v1"]["anchor"] == "cert-verified" and got["v1"]["notes"] == ["PSA cert verified: Keel"] and got["v2"]["anchor"] == "slab-claimed"


def test_context_leads(spark, book):
    items = [raw("l1", "Megalodon tooth fossil", 100), raw("l2", "Nell Arbuckle signed sketch", 400), raw("l3", "Megalodon tooth", 130), raw("l4", "T-Rex tooth signed by Nell Arbuckle", 1), raw("l5", "Nell Arbuckle signed strip repaired", 10), raw("l6", "ammonite", 1)]
    got = board.leads(frame(spark, items, "x"), book.context, CONF).collect()
    assert [r["item_id"] for r in got] == ["l1", "l2"]
    found = {r["item_id"]: r["context"] and r["context"]["k"] for r in pricing.with_context(frame(spark, items, "x"), book.context, F.lit("science")).collect()}
    assert found["l4"] is None and found["l6"] is None and found["l5"] == "nell-arbuckle"


def test_slug_class_is_of_ranges_and_equal():
    """The class that tells texts with compatibility characters is short, and holds these characters and no others."""
    java = T._HAS_MORE[1:-1].split("&&")
    spans = [[(int(a, 16), int(b, 16)) for a, b in re.findall(r"\\x\{(\w+)\}-\\x\{(\w+)\}", part)] for part in java]
    both = {p for a, b in spans[1] for p in range(a, b + 1) if any(lo <= p <= hi for lo, hi in spans[0])}
    assert both == set(map(ord, T.FOLD_MORE)) and len(spans[1]) < 64 and not any(lo <= ord("é") <= hi for lo, hi in spans[0])


def test_values_are_bound_once(spark):
    """A key's plan names each regular expression of a title a few times, not once for each use of what it gives."""
    rows = spark.createDataFrame([("a", None, None)], "title string, condition string, aspects array<struct<name:string,value:string>>")
    plan = rows.select(identity.art_editions().alias("k"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("numbered|signed") <= 2


def test_counts_do_not_find_keys_twice(spark):
    rows = spark.createDataFrame([("k", "a", "too-shallow"), (None, None, None), ("k", "b", None), ("q", "a", "too-shallow")], "key string, vertical string, gate_reason string")
    assert sorted(map(tuple, board.identified_counts(rows).collect())) == [("a", 2), ("b", 1)]
    assert [tuple(r) for r in board.reason_counts(rows).collect()] == [("a", "tooShallow", 2)]


def test_parts_of_a_small_file_are_many_tasks(spark):
    import oracle
    from tallyboard.plans import tick

    assert tick._parts(spark, oracle.DATA).rdd.getNumPartitions() >= 4


def test_quantiles_are_rounded_as_the_sql_rounds_them(spark):
    """The 0.9 quantile of these prices is 102940 exactly; rounded twice it is a bit less, and 0.625 of it another whole number."""
    from tallyboard.plans import twins

    paid = [10867.55, 29487.66, 32634.92, 33902.43, 50471.04, 51422.34, 58019.47, 85032.64, 102755.98, 104596.18]
    rows = spark.createDataFrame([(paid,)], "xs array<double>")
    assert rows.select(*[twins.quantile(F.col("xs"), q) for q in (0.5, 0.1, 0.9)]).first()[:] == (50946.69, 27625.649, 102940.0)
    assert spark.createDataFrame([([1.0, 2.0, 5.0],)], "xs array<double>").select(twins.quantile(F.col("xs"), 0.5)).first()[0] == 2.0

"""The board tick end to end over listings that are made from the parts, each with SQL for the same rows.

Titles are put together so that the SQL knows each key by construction; the queries find it by the
library's matchers, price and judge it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyboard.operators import board, identity, pricing, scoring
from tallyboard.plans.catalog import query
from tallyboard.plans.twins import AS_OF, CONF, CONF_SQL, DEPTH_SQL, EVIDENCE_SQL, cents, cents_sql, spread, table
from tallyboard.schemas import RAW_LISTING
from tallyboard.sources import listings as source
from tallyboard.sources import scratch

FIRST = ("Marlon", "Dario", "Vera", "Hedda", "Orla", "Tobias", "Ines")
LAST = ("Keel", "Quill", "Stahl", "Lorne", "Finch", "Vane", "Okafor", "Strand")
BRAND = ("Rolex", "Omega", "Cartier")
SETS = ("Aquapolis", "Gym Heroes", "Neo Genesis")


def _pick(words: tuple[str, ...], step: int = 1) -> tuple[Callable[[], Column], str]:
    """A word by the part's number, as Column (once there is a session) and as SQL."""

    def column() -> Column:
        return F.element_at(F.array(*[F.lit(w) for w in words]), (F.floor(F.col("pk") / step) % len(words) + 1).cast("int"))

    return column, "[" + ", ".join(f"'{w}'" for w in words) + f"][(pk // {step}) % {len(words)} + 1]"


(_first, _FIRST_SQL), (_last, _LAST_SQL), (_brand, _BRAND_SQL), (_set, _SET_SQL) = _pick(FIRST), _pick(LAST, 7), _pick(BRAND), _pick(SETS, 2)
_YEAR_SQL, _GRADE_SQL = "(1990 + pk % 20)::VARCHAR", "(pk % 10 + 1)::VARCHAR"
_NAME_SQL = f"lower({_FIRST_SQL} || '-' || {_LAST_SQL})"


def _number() -> Column:
    return F.col("pk").cast("string")


def _year() -> Column:
    return (1990 + F.col("pk") % 20).cast("string")


def _grade() -> Column:
    return (F.col("pk") % 10 + 1).cast("string")


def _when(divisor: int, text: str) -> Column:
    return F.when(F.col("pk") % divisor == 0, text).otherwise("")


#: Vertical -> (title, SQL of its key).
TITLES = {
    "sports-cards": (
        lambda: F.concat(_year(), F.lit(" Topps "), _first(), F.lit(" "), _last(), F.lit(" Rookie RC #"), _number(), F.when(F.col("pk") % 11 > 0, F.concat(F.lit(" PSA "), _grade())).otherwise(" ungraded")),
        f"{_NAME_SQL} || '|' || {_YEAR_SQL} || '|topps|' || pk::VARCHAR || '|' || CASE WHEN pk % 11 > 0 THEN 'PSA' || {_GRADE_SQL} ELSE 'raw' END",
    ),
    "pokemon": (
        lambda: F.concat(_year(), F.lit(" Pokemon "), _set(), F.lit(" "), _when(3, "1st Edition "), F.lit("#"), _number(), F.when(F.col("pk") % 11 > 0, F.concat(F.lit(" CGC "), _grade())).otherwise("")),
        f"CASE WHEN pk % 11 > 0 THEN {_YEAR_SQL} || '|' || replace(lower({_SET_SQL}), ' ', '-') || '|' || pk::VARCHAR || '|' || CASE WHEN pk % 3 = 0 THEN '1st' ELSE 'unl' END || '|CGC' || {_GRADE_SQL} END",
    ),
    "art-editions": (
        lambda: F.concat(_first(), F.lit(" "), _last(), F.lit(" - Harbour Scene "), _number(), F.when(F.col("pk") % 5 > 0, " lithograph 12/100 signed").otherwise(" oil on canvas")),
        f"CASE WHEN pk % 5 > 0 THEN {_NAME_SQL} || '|harbour-scene-' || pk::VARCHAR || '-lithograph' END",
    ),
    "autographs": (
        lambda: F.concat(_first(), F.lit(" "), _last(), F.when(F.col("pk") % 2 == 0, " document signed").otherwise(" Typed Letter Signed"), _when(3, " JSA"), _when(7, " facsimile")),
        f"CASE WHEN pk % 7 > 0 THEN {_NAME_SQL} || CASE WHEN pk % 2 = 0 THEN '|ds' ELSE '|tls' END END",
    ),
    "watches": (
        lambda: F.concat(_brand(), F.lit(" automatic "), (10000 + F.col("pk") % 80000).cast("string"), F.lit(" steel"), _when(13, " damaged"), _when(17, " homage")),
        f"CASE WHEN pk % 17 > 0 THEN lower({_BRAND_SQL}) || '|' || (10000 + pk % 80000)::VARCHAR END",
    ),
    "design": (
        lambda: F.concat(F.lit("Eames LCM-"), (F.col("pk") % 9000 + 1).cast("string"), _when(4, " style of"), F.lit(" chair")),
        "CASE WHEN pk % 4 > 0 AND NOT regexp_matches((pk % 9000 + 1)::VARCHAR, '^(19|20)..$') THEN 'charles-eames|lcm' || (pk % 9000 + 1)::VARCHAR END",  # years are no codes
    ),
}


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("pk"), F.col("p_retailprice").alias("r")), "pk")


def _titled(rows: DataFrame, vertical: str) -> DataFrame:
    """Listings of a vertical as identify() takes them, made from the parts."""
    none = F.array().cast("array<struct<name:string,value:string>>")
    return rows.select("pk", TITLES[vertical][0]().alias("title"), F.lit(None).cast("string").alias("condition"), none.alias("aspects"), F.array(F.lit(vertical)).alias("matchers"))


def _identity(vertical: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return identity.identify(_titled(_parts(spark, sf_dir), vertical), F.col("matchers"), (vertical,)).select("pk", "key", "vertical")

    run.__name__ = f"tick_identity_{vertical.replace('-', '_')}"
    run.__doc__ = f"Keys of listings of {vertical}; rows that name none are left without."
    key = TITLES[vertical][1]
    return query(f"SELECT pk, {key} AS key, CASE WHEN ({key}) IS NOT NULL THEN '{vertical}' END AS vertical FROM (SELECT p_partkey AS pk FROM part)")(run)


for _vertical in TITLES:
    _identity(_vertical)


_SIGNALS = {
    "sports-cards": ("'raw'", "CASE WHEN pk % 11 > 0 THEN 'PSA' END", "CASE WHEN pk % 11 > 0 THEN 1 ELSE 0 END"),
    "pokemon": ("CASE WHEN pk % 11 > 0 THEN 'slab-claimed' ELSE 'raw' END", "CASE WHEN pk % 11 > 0 THEN 'CGC' END", "CASE WHEN pk % 11 > 0 THEN 1 ELSE 0 END"),
    "art-editions": ("'raw'", "NULL", "CASE WHEN pk % 5 > 0 THEN 3 ELSE 1 END"),
    "autographs": ("CASE WHEN pk % 3 = 0 THEN 'papers' ELSE 'raw' END", "CASE WHEN pk % 3 = 0 THEN 'JSA' END", "2 + CASE WHEN pk % 7 = 0 THEN 1 ELSE 0 END"),
    "watches": ("'raw'", "NULL", "2"),
    "design": ("'raw'", "NULL", "1 + CASE WHEN pk % 4 = 0 THEN 1 ELSE 0 END"),
}


@query(" UNION ALL ".join(f"SELECT p_partkey AS pk, '{v}' AS vertical, {a} AS anchor, {g}::VARCHAR AS grader, ({n})::INTEGER AS notes FROM (SELECT p_partkey, p_partkey AS pk FROM part)" for v, (a, g, n) in _SIGNALS.items()))
def tick_signals(spark, sf_dir):
    """Authenticity anchor, grader and number of notes of every vertical's listings."""
    out, parts = None, _parts(spark, sf_dir)
    for v in TITLES:
        rows = _titled(parts, v).select("pk", F.lit(v).alias("vertical"), scoring.risk_signals(F.lit(v)).alias("s"))
        rows = rows.select("pk", "vertical", F.col("s.anchor").alias("anchor"), F.col("s.grader").alias("grader"), F.size("s.notes").alias("notes"))
        out = rows if out is None else out.unionByName(rows)
    return out


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Watch listings from raw JSON through normalisation, identity, book and gate to risk and rank."""
    p = _parts(spark, sf_dir)
    options = F.transform(F.array(F.lit("9.5"), (F.col("pk") % 8).cast("string"), F.lit("x")), lambda c: F.struct(F.struct(c.alias("value")).alias("shippingCost")))
    raw = F.struct(
        F.concat(F.lit("v1|"), _number()).alias("itemId"), TITLES["watches"][0]().alias("title"), F.struct((F.col("r") * (30 + F.col("pk") % 60) / 100.0).cast("string").alias("value")).alias("price"),
        F.when(F.col("pk") % 5 > 0, options).alias("shippingOptions"), F.struct(F.lit("i").alias("imageUrl")).alias("image"),
        F.struct(F.lit("99.6").alias("feedbackPercentage"), F.when(F.col("pk") % 3 == 0, 1200).otherwise(20).alias("feedbackScore"), F.lit("Business").alias("sellerAccountType")).alias("seller"),
        F.when(F.col("pk") % 2 == 0, "2000-12-31T12:00:00Z").otherwise("2000-12-01T00:00:00Z").alias("itemCreationDate"),
    )
    parsed = p.select("pk", F.from_json(F.to_json(raw), f"STRUCT<{source._colons(RAW_LISTING)}>").alias("l")).select("pk", "l.*")
    rows = source.normalize(parsed).withColumn("matchers", F.array(F.lit("watches")))
    sold = F.date_sub(F.lit("2000-12-01").cast("date"), (F.col("pk") % 900).cast("int")).cast("string")
    book = p.filter("pk % 4 > 0").select(
        F.concat(F.lower(_brand()), F.lit("|"), (10000 + F.col("pk") % 80000).cast("string")).alias("k"), F.lit("watches").alias("v"), F.col("r").alias("med"), (F.col("r") * 0.8).alias("lo"), (F.col("r") * 1.2).alias("hi"),
        (3 + F.col("pk") % 7).alias("n"), (F.col("pk") % 4).alias("n12"), sold.alias("last_sale"), F.lit(None).cast("double").alias("trend"), F.when(F.col("pk") % 6 == 0, "thin").otherwise("high").alias("conf"), "pk",
    )
    book = pricing.last_row_wins(book, "pk").drop("pk")
    return board.judge(board.price(identity.identify(rows, F.col("matchers"), ("watches",)), book, None), CONF)


_JUDGED_SQL = f"""WITH p AS (SELECT p_partkey AS pk, p_retailprice AS r FROM part),
l AS (SELECT pk, 'v1|' || pk::VARCHAR AS item_id, {TITLES['watches'][1]} AS key, r * (30 + pk % 60) / 100.0::DOUBLE + CASE WHEN pk % 5 > 0 THEN least(9.5::DOUBLE, (pk % 8)::DOUBLE) ELSE 0 END AS all_in FROM p),
book AS (SELECT lower({_BRAND_SQL}) || '|' || (10000 + pk % 80000)::VARCHAR AS key, max(pk) AS bpk FROM p WHERE pk % 4 > 0 GROUP BY 1),
j AS (SELECT l.*, b.r AS med, 3 + b.pk % 7 AS n, b.pk % 4 AS n12, CASE WHEN b.pk % 6 = 0 THEN 'thin' ELSE 'high' END AS conf, epoch_ms((DATE '2000-12-01' - (b.pk % 900)::INTEGER)::TIMESTAMP) AS last_ms
  FROM l LEFT JOIN book USING (key) LEFT JOIN p b ON b.pk = book.bpk),
g AS (SELECT *, {DEPTH_SQL} AS depth, med - all_in AS edge, CASE WHEN pk % 3 = 0 THEN 45 ELSE 39 END - CASE WHEN pk % 13 = 0 THEN 6 ELSE 0 END AS score,
  CASE WHEN key IS NULL THEN 'no-key' WHEN med IS NULL THEN 'noBookRow' WHEN 978307200000 - last_ms > 24.0::DOUBLE * (30.44::DOUBLE * 86400000) THEN 'stale-book' WHEN pk % 13 = 0 THEN 'condition-flag' WHEN {DEPTH_SQL} > 0.9 THEN 'scam-cap'
    WHEN {DEPTH_SQL} < 0.25 THEN 'too-shallow' WHEN conf = 'thin' AND {DEPTH_SQL} < 0.4 THEN 'thin-shallow' WHEN med - all_in < 50 THEN 'edge-floor' END AS reason FROM j),
k AS (SELECT *, CASE WHEN score >= 40 THEN 'C' ELSE 'D' END AS grade, edge * depth * {CONF_SQL} * CASE WHEN score >= 40 THEN 0.6::DOUBLE ELSE 0.3::DOUBLE END * {EVIDENCE_SQL} * CASE WHEN pk % 2 = 0 THEN 1.15::DOUBLE ELSE 1.0::DOUBLE END AS rank FROM g)"""


@query(f"{_JUDGED_SQL} SELECT item_id, key, {cents_sql('all_in')} AS all_in_c, coalesce(reason, 'pass') AS reason, CASE WHEN key IS NOT NULL THEN grade END AS grade, CASE WHEN med IS NOT NULL THEN {cents_sql('rank')} END AS rank_c FROM k")
def tick_judged(spark, sf_dir):
    """Every listing of the tick with its key, cost, gate reason, risk grade and rank."""
    rows = _judged(spark, sf_dir)
    return rows.select("item_id", "key", cents(F.col("all_in")).alias("all_in_c"), F.coalesce("gate_reason", F.lit("pass")).alias("reason"), F.col("risk.grade").alias("grade"), cents(F.col("rank")).alias("rank_c"))


@query(
    f"""{_JUDGED_SQL} SELECT item_id, key, CASE WHEN conf = 'high' AND n >= 6 AND n12 >= 2 AND depth <= 0.6 THEN 'featured' ELSE 'worth-a-look' END AS tier, true AS is_new, {cents_sql('all_in')} AS all_in_c, {cents_sql('rank')} AS rank_c,
    'https://example.org/key/watches/' || url_encode(key) AS evidence_url FROM k WHERE reason IS NULL ORDER BY rank DESC, pk LIMIT 200"""
)
def tick_deals(spark, sf_dir):
    """The published deals of the tick: best ranks, with tier, novelty and the page of their evidence. Equal ranks go by place."""
    out = board.publish_deals(board.deals(_judged(spark, sf_dir).withColumn("pos", F.col("pk")), AS_OF, "https://example.org"), CONF)
    return out.select("item_id", "key", "tier", "is_new", cents(F.col("all_in")).alias("all_in_c"), cents(F.col("rank")).alias("rank_c"), "evidence_url")


@query(
    f"""{_JUDGED_SQL}, hit AS (SELECT 'watches' AS vertical, count(*) AS polled, count(*) FILTER (key IS NOT NULL AND med IS NOT NULL) AS matched, count(*) FILTER (reason IS NULL) AS surfaced FROM k)
    SELECT vertical, coalesce(polled, 0) AS polled, coalesce(matched, 0) AS matched, coalesce(surfaced, 0) AS surfaced
    FROM (VALUES ('sports-cards'), ('pokemon'), ('art-editions'), ('autographs'), ('watches')) d(vertical) LEFT JOIN hit USING (vertical)"""
)
def tick_funnel(spark, sf_dir):
    """Polled, matched and surfaced listings of every launch vertical."""
    rows = scratch.kept(_judged(spark, sf_dir).select("matchers", "key", "vertical", "matched", "ladder", "gate_reason"), "judged")
    return board.per_vertical(rows, rows)


@query(
    f"""{_JUDGED_SQL} SELECT 'watches' AS vertical, CASE reason WHEN 'stale-book' THEN 'staleBook' WHEN 'condition-flag' THEN 'condition' WHEN 'scam-cap' THEN 'scamCap' WHEN 'too-shallow' THEN 'tooShallow'
    WHEN 'thin-shallow' THEN 'thinTooShallow' WHEN 'edge-floor' THEN 'edgeFloor' ELSE reason END AS reason, count(*) AS n FROM k WHERE key IS NOT NULL AND reason IS NOT NULL GROUP BY ALL"""
)
def tick_reasons(spark, sf_dir):
    """How many listings of the tick each gate stopped, by published names."""
    return board.reason_counts(_judged(spark, sf_dir))


@query(
    f"""{_JUDGED_SQL} SELECT item_id, CASE WHEN key IS NOT NULL THEN score::BIGINT END AS score, CASE WHEN key IS NOT NULL THEN 'raw, no authenticity anchor; seller 99.6% feedback; ' || CASE WHEN pk % 3 = 0 THEN 'established seller (1200 ratings); ' ELSE '' END
    || 'registered business seller; sparse listing, no item specifics; ' || CASE WHEN pk % 13 = 0 THEN 'condition flag: damaged; ' ELSE '' END || 'watches: elevated fake-rate prior' END AS reasons FROM k"""
)
def tick_risk_reasons(spark, sf_dir):
    """Risk score of every listing and the reasons that explain it, in order."""
    return _judged(spark, sf_dir).select("item_id", F.col("risk.score").alias("score"), F.array_join("risk.reasons", "; ").alias("reasons"))


@query(
    f"""SELECT pk, CASE WHEN pk % 4 = 0 THEN 'class' WHEN pk % 4 = 2 AND {_NAME_SQL} IN ('vera-stahl', 'marlon-keel') THEN 'signer' END AS kind,
    CASE WHEN pk % 4 = 0 THEN 'megalodon-tooth' WHEN pk % 4 = 2 AND {_NAME_SQL} IN ('vera-stahl', 'marlon-keel') THEN {_NAME_SQL} END AS k FROM (SELECT p_partkey AS pk FROM part)"""
)
def tick_context(spark, sf_dir):
    """Rollups of listings: class first, then signer; a class without rollup gives none."""
    rows = _titled(_parts(spark, sf_dir), "autographs")
    title = F.when(F.col("pk") % 4 == 0, "Huge Megalodon tooth").when(F.col("pk") % 4 == 1, "Ammonite slab").when(F.col("pk") % 4 == 2, F.concat(_first(), F.lit(" "), _last(), F.lit(" signed print"))).otherwise("plain rock")
    context = spark.createDataFrame(
        [("class", "megalodon-tooth", 240.0), ("signer", "vera-stahl", 90.0), ("signer", "marlon-keel", 70.0)], "kind string, k string, med double"
    ).withColumns({"lo": F.col("med") * 0.5, "hi": F.col("med") * 2, "n": F.lit(9).cast("long"), "last_sale": F.lit("2000-06-01")})
    out = pricing.with_context(rows.withColumn("title", title), context, F.lit("science"))
    return out.select("pk", "context.kind", "context.k")


@query(" UNION ALL ".join(f"SELECT pk, '{name}' AS class FROM (SELECT p_partkey AS pk FROM part) WHERE pk % {len(pricing.CLASSES) + 1} = {i}" for i, (name, _) in enumerate(pricing.CLASSES)) + f" UNION ALL SELECT p_partkey, NULL FROM part WHERE p_partkey % {len(pricing.CLASSES) + 1} = {len(pricing.CLASSES)}")
def tick_classes(spark, sf_dir):
    """Classes of science listings, one title for each class and one that has none."""
    titles = ("T-Rex tooth", "Megalodon find", "mosasaurus jaw", "raptor hand claw", "Ammonite", "big trilobite", "egg of a dinosaur", "Meteorite slice", "Apple-1 board", "apple II plus", "Mac 512k set", "plain rock")
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("pk"))
    title = F.element_at(F.array(*[F.lit(t) for t in titles]), (F.col("pk") % len(titles) + 1).cast("int"))
    return rows.select("pk", pricing.class_of(title).alias("class"))

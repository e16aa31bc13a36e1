"""Depth, rank, risk and tier as Column expressions.

Rows carry the listing (price, shipping_cost, listed_at, aspects, image_url, enriched, seller) and the
matched book row (med, lo, hi, n, n12, last_sale, conf).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyboard import config as C
from tallyboard.functions.text import banded, has, label_of, millis, pattern
from tallyboard.operators import identity as I

#: Title words that destroy value; `partial refund` and `miscut error` don't count.
CONDITION_WORDS = (
    r"\b(damaged|incomplete|partial(?!\s+refund)|missing\b|trimmed|altered|recolou?red|restored|rebacked|creas(?:ed|es|ing)|torn|tear\b|taped|water damage|"
    r"writing on|paper loss|as[- ]is|poor condition|heavily worn|miscut(?! error)|detached|hole punched|glue|residue|cracked|scratch(?:ed|es)?|repaired|"
    r"reprint|replica|damage\b|broken)\b"
)


def condition_flags(title: Column) -> Column:
    """Distinct condition words of a title, lower case, in order."""
    hits = F.regexp_extract_all(F.coalesce(title, F.lit("")), F.lit(pattern(CONDITION_WORDS, True)), F.lit(1))
    return F.array_distinct(F.transform(hits, F.lower))


def has_condition_flag(title: Column) -> Column:
    return has(title, CONDITION_WORDS)


def all_in(price: Column | str = "price", shipping: Column | str = "shipping_cost") -> Column:
    """Price and shipping, unknown shipping as none."""
    return F.col(price) + F.coalesce(F.col(shipping), F.lit(0.0)) if isinstance(price, str) else price + F.coalesce(shipping, F.lit(0.0))


def depth(cost: Column, med: Column) -> Column:
    return 1 - F.try_divide(cost, med)


def evidence_weight(last_sale_ms: Column, n12: Column, now_ms: int) -> Column:
    """Weight of a book row's age and yearly sales; an unknown date counts as old, unknown sales as enough."""
    months = (F.lit(now_ms) - last_sale_ms) / C.MONTH_MS
    age = F.when(months <= 6, 1.0).when(months <= 12, 0.85).otherwise(0.55)
    return age * F.when(n12.isNull(), 1.0).otherwise(F.least(F.lit(1.0), 0.7 + 0.075 * n12))


def fresh_boost(listed_ms: Column, conf: C.Config) -> Column:
    age = F.lit(conf.now_ms) - listed_ms
    return F.when((age >= 0) & (age < conf.fresh_ms), conf.fresh_boost).otherwise(1.0)


def rank(edge: Column, deep: Column, confidence: Column, grade: Column, evidence: Column, fresh: Column) -> Column:
    return edge * deep * label_of(confidence, C.CONFIDENCE_WEIGHT) * label_of(grade, C.RISK_WEIGHT) * evidence * fresh


# --- risk ---------------------------------------------------------------------------------------
#: Authentication language by vertical.
COA = r"\b(coa|c\.o\.a\.|certificate of authenticity|certificate|authenticit)\w*"
AUTH_LANGUAGE = r"\b(coa|c\.o\.a\.|loa|l\.o\.a\.|certificate of authenticity|letter of authenticity|authenticat\w*|certified)\b"
AUTHENTICATORS = ((r"psa\s*/?\s*dna", "PSA/DNA"), (r"\bjsa\b|james spence", "JSA"), (r"beckett|\bbas\b", "Beckett (BAS)"), (r"\bpsa\b", "PSA"), (r"\bsgc\b", "SGC"), (r"roger epperson|\brea\b", "Roger Epperson (REA)"))
PAPERS = r"box\s*(?:and|&|\+|,)?\s*papers|full\s+set|\bpapers\b|warranty\s+card|archive\s+extract|certificate\s+of\s+origin"


def _notes(*parts: Column) -> Column:
    return F.array_compact(F.array(*parts))


def _signals(anchor: Column, grader: Column, cert: Column, notes: Column) -> Column:
    return F.struct(anchor.alias("anchor"), grader.cast("string").alias("grader"), cert.cast("string").alias("cert"), notes.alias("notes"))


def risk_signals(vertical: Column) -> Column:
    """struct(anchor, grader, cert, notes) of a listing in its vertical."""
    none = F.lit(None).cast("string")
    grader, cert = I.card_grader(), I.first_aspect(*I.CERT_NAMES)
    cards = _signals(F.when(grader.isNotNull() & cert.isNotNull(), "slab-claimed").otherwise("raw"), grader, cert, _notes(F.when(grader.isNotNull() & cert.isNull(), "grader claimed without a certification number")))
    p_grader, p_cert = I._pokemon_grade_parts()[0], I._any_aspect(*I.POKEMON_CERTS)
    has_grade = F.concat(*I._pokemon_grade_parts()).isNotNull()
    p_grader = F.when(has_grade, p_grader)
    note = F.when(p_cert.isNotNull(), F.concat(p_grader, F.lit(" cert "), p_cert)).otherwise(F.concat(p_grader, F.lit(" slab, no cert #")))
    monsters = _signals(F.when(has_grade, "slab-claimed").otherwise("raw"), p_grader, p_cert, _notes(F.when(has_grade, note)))
    spread = F.concat_ws(" ", F.col("title"), F.transform(F.coalesce(F.col("aspects"), F.array().cast("array<struct<name:string,value:string>>")), lambda a: F.concat_ws(" ", a["name"], a["value"])))
    coa = has(spread, COA)
    art = _signals(F.when(coa, "papers").otherwise("raw"), none, none, _notes(F.when(has(spread, r"\bsigned\b"), "signed"), F.when(has(spread, r"\bnumbered\b|\b\d+\s*/\s*\d+\b"), "numbered"), F.when(coa, "COA / certificate named"), F.lit("art: verify edition & COA")))
    values = I.aspect_values()
    named = F.coalesce(I.aspect("Authentication"), I.aspect("Certification"), I.aspect("Authentication & Grading"))
    language = (F.coalesce(named, F.lit("")) != "") | has(values, AUTH_LANGUAGE)
    who = I.first_of(values, AUTHENTICATORS)
    backed = language | who.isNotNull()
    autos = _signals(
        F.when(backed, "papers").otherwise("raw"), who, none,
        _notes(
            F.when(who.isNotNull(), F.concat(F.lit("authenticator: "), who)).when(language, "authentication named (unattributed)"),
            F.when(has(values, I.REPRODUCTION), "reprint/autopen/facsimile language present"),
            F.lit("autograph: authentication is the risk"),
            F.when(~backed, "no LOA/COA/authenticator named — treat as unauthenticated"),
        ),
    )
    papers, material = has(values, PAPERS), I.watch_material()
    clocks = _signals(F.when(papers, "papers").otherwise("raw"), none, none, _notes(F.coalesce(F.concat(F.lit("material: "), material), F.lit("material unknown — ref pool spans materials")), F.when(papers, "box/papers language present (unverified)"), F.lit("watch: condition/service state is unpriceable from a listing")))
    shapes = _signals(F.lit("raw"), none, none, _notes(F.when(has(F.col("title"), I.HEDGE), "attribution hedged in title"), F.lit("design: attribution/reproduction is the risk — no slab exists")))
    out = F.when(vertical == "sports-cards", cards)
    for name, signals in (("pokemon", monsters), ("art-editions", art), ("autographs", autos), ("watches", clocks), ("design", shapes)):
        out = out.when(vertical == name, signals)
    return out


def with_cert_verdicts(rows: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Upgrade signals.anchor where the certificate is verified; verdicts: (cert, verified, subject), each cert asked once.

    Only graded verticals have certificates that can be verified.
    """
    known = verdicts.select(F.col("cert").alias("_cert"), F.col("verified").alias("_ok"), F.col("subject").alias("_subject")).dropDuplicates(["_cert"])
    ask = F.when(F.col("vertical").isin(*C.GRADED), F.col("signals.cert"))
    out = rows.withColumn("_ask", ask).join(known, F.col("_ask") == F.col("_cert"), "left")
    note = F.concat(F.lit("PSA cert verified"), F.coalesce(F.concat(F.lit(": "), F.col("_subject")), F.lit("")))
    better = _signals(F.lit("cert-verified"), F.col("signals.grader"), F.col("signals.cert"), F.array_append("signals.notes", note))
    return out.withColumn("signals", F.when(F.coalesce(F.col("_ok"), F.lit(False)), better).otherwise(F.col("signals"))).drop("_ask", "_cert", "_ok", "_subject")


def _plain(x: Column) -> Column:
    """A number as text, without a trailing .0."""
    return F.regexp_replace(x.cast("string"), r"\.0$", "")


def risk_score(vertical: Column, anchor: Column, grader: Column, cert: Column, seller_pct: Column, seller_score: Column, account: Column, n_aspects: Column, enriched: Column, image: Column, flags: Column) -> Column:
    """struct(score, grade, reasons)."""
    kind = F.upper(F.coalesce(account, F.lit("")))
    seller = banded(F.coalesce(seller_pct, F.lit(-1.0)), C.FEEDBACK_POINTS) + banded(F.coalesce(seller_score, F.lit(-1)), C.VOLUME_POINTS) + label_of(kind, C.ACCOUNT_POINTS, 0)
    quality = banded(n_aspects, C.ASPECT_POINTS) + F.when(image.isNotNull() & (image != ""), C.IMAGE_POINTS).otherwise(0) - C.FLAG_PENALTY * F.size(flags)
    quality = F.greatest(F.lit(0), F.least(F.lit(C.QUALITY_MOST), quality))
    prior = label_of(vertical, C.VERTICAL_POINTS, 0)
    score = F.greatest(F.lit(0), F.least(F.lit(100), label_of(anchor, C.ANCHOR_POINTS) + seller + quality + prior))
    grade = F.lit("D")
    for name, least in reversed(C.GRADE_FROM):
        grade = F.when(score >= least, name).otherwise(grade)
    by = F.coalesce(F.concat(F.lit(" ("), grader, F.lit(")")), F.lit(""))
    # fixed values: the wording of the reasons
    said = (
        F.when(anchor == "cert-verified", F.concat(F.lit("cert verified"), by, F.coalesce(F.concat(F.lit(", cert #"), cert), F.lit(""))))
        .when(anchor == "slab-claimed", F.concat(F.lit("slab claimed"), by, F.coalesce(F.concat(F.lit(", cert #"), cert, F.lit(" unverified")), F.lit(", unverified"))))
        .when(anchor == "papers", "papers / LOA named (unverified)")
        .otherwise("raw, no authenticity anchor")
    )
    reasons = [
        said,
        F.when(seller_pct.isNull(), "seller feedback % unknown").when(seller_pct >= 98, F.concat(F.lit("seller "), _plain(seller_pct), F.lit("% feedback"))).when(seller_pct < 95, F.concat(F.lit("low seller feedback "), _plain(seller_pct), F.lit("%"))),
        F.when(seller_score.isNull(), "seller rating count unknown").when(seller_score < 10, F.concat(F.lit("new seller ("), seller_score.cast("string"), F.lit(" ratings)"))).when(seller_score >= 100, F.concat(F.lit("established seller ("), seller_score.cast("string"), F.lit(" ratings)"))),
        F.when(kind == "BUSINESS", "registered business seller"),
        F.when(n_aspects == 0, "sparse listing, no item specifics").when(n_aspects >= 6, "complete item specifics"),
        F.when(~F.coalesce(enriched, F.lit(False)), "not yet enriched (aspects provisional)"),
        F.when(image.isNull() | (image == ""), "no photo / stock image"),
    ]
    tail = F.when(prior >= 10, F.array(F.concat(vertical, F.lit(": low fake-rate prior")))).when(prior <= 4, F.array(F.concat(vertical, F.lit(": elevated fake-rate prior")))).otherwise(F.array().cast("array<string>"))
    listed = F.concat(F.array_compact(F.array(*reasons)), F.transform(flags, lambda f: F.concat(F.lit("condition flag: "), f)), tail)
    return F.struct(score.cast("long").alias("score"), grade.alias("grade"), listed.alias("reasons"))


def cert_verified(reasons: Column) -> Column:
    return F.coalesce(F.exists(reasons, lambda r: r.startswith("cert verified")), F.lit(False))


def tier(deep: Column, confidence: Column, n: Column, n12: Column, grade: Column, verified: Column, ladder: Column, conf: C.Config) -> Column:
    """featured or worth-a-look."""
    evidence = ((confidence == "high") & (n >= conf.featured_n) & (n12.isNull() | (n12 >= conf.featured_n12))) | ((grade == "A") & verified)
    look = ladder | ~evidence | (deep < conf.min_depth) | ((deep > conf.featured_most) & ~verified)
    return F.when(look, "worth-a-look").otherwise("featured")


def goldmine_score(rows: DataFrame, conf: C.Config) -> DataFrame:
    """Book rows worth a query of their own, with score = med x evidence weight."""
    sale = millis(F.col("last_sale"))
    fit = (F.col("conf") != "thin") & (F.col("med") >= conf.goldmine_med) & (F.lit(conf.now_ms) - sale <= conf.goldmine_months * C.MONTH_MS)
    return rows.filter(fit).withColumn("score", F.col("med") * evidence_weight(sale, F.col("n12"), conf.now_ms))



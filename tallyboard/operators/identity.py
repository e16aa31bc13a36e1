"""Identity: from a listing's title and aspects to an exact key, or null.

Every matcher is a Column expression over `title`, `condition` and `aspects`
(array<struct<name, value>>), so identification stays in one generated stage.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyboard.functions.text import blank_to_null, empty_to_null, found, has, let, pattern, slug


def aspect(name: str) -> Column:
    """Value of the first aspect of that name, whatever its case."""
    own = F.filter(F.coalesce(F.col("aspects"), F.array().cast("array<struct<name:string,value:string>>")), lambda a: F.lower(a["name"]) == name.lower())
    return F.get(own, F.lit(0))["value"]


def first_aspect(*names: str) -> Column:
    """First value, trimmed and not blank, over names in order."""
    return F.coalesce(*[blank_to_null(aspect(n)) for n in names])


def first_of(text: Column, rules, otherwise: Column | None = None) -> Column:
    """Label of the first (pattern, label) that text matches."""

    def label_of(t: Column) -> Column:
        out = otherwise if otherwise is not None else F.lit(None).cast("string")
        for regex, label in reversed(rules):
            out = F.when(has(t, regex), F.lit(label)).otherwise(out)
        return out

    return let(text, label_of)


# --- sports cards -------------------------------------------------------------------------------
#: Aspect names, set terms, graders and title noise.
PLAYER_NAMES = ("Player/Athlete", "Player", "Athlete", "Subject")
YEAR_NAMES = ("Season", "Year", "Set Year", "Year Manufactured", "Card Year")
SET_NAMES = ("Set", "Set Name", "Product")
NUMBER_NAMES = ("Card Number", "Card #", "Card No", "Card No.", "Number")
GRADER_NAMES = ("Professional Grader", "Grade Company", "Grader", "Grading Company")
GRADE_NAMES = ("Grade", "Grade Number", "Card Grade", "Numerical Grade")
CERT_NAMES = ("Certification Number", "Cert Number", "Cert #", "Certification #")
SET_ALIASES = {"o-pee-chee": "opc", "o pee chee": "opc"}
SET_TERMS = ("topps chrome", "bowman chrome", "upper deck", "o-pee-chee", "panini prizm", "topps", "bowman", "fleer", "opc", "prizm", "donruss", "score", "select", "panini")
GRADERS = ((r"\b(psa|professional sports authenticator)\b", "PSA"), (r"\b(bgs|bvg|beckett)\b", "BGS"), (r"\bsgc\b", "SGC"), (r"\bcgc\b", "CGC"))
GRADE_NUMBER = r"\b(10|[1-9](?:\.5)?)\b"
TITLE_GRADE = r"\b(PSA|BGS|BVG|SGC|CGC)\s*(10|[1-9](?:\.5)?)\b"
CARD_NOISE = (r"\b(19|20)\d{2}(?:-\d{2})?\b", r"\b(PSA|BGS|BVG|SGC|CGC)\s*\d+(?:\.5)?\b", r"\b(rookie|rc|hof|hall of fame|auto(?:graph)?|refractor|prizm|insert|sp|ssp|gem|mint|mt|nm|card|the)\b")


def card_set(text: Column) -> Column:
    """Canonical form of a set's name."""
    tidy = F.trim(F.regexp_replace(F.lower(text), pattern(r"\s+"), " "))
    return let(tidy, lambda name: reduce(lambda out, kv: F.when(name == kv[0], F.lit(kv[1])).otherwise(out), SET_ALIASES.items(), name))


def _set_hit() -> tuple[Column, Column]:
    """(term, place after it) of the longest known set term in the title."""
    term, end = F.lit(None).cast("string"), F.lit(None).cast("int")
    low = F.lower(F.col("title"))
    for t in sorted(SET_TERMS, key=len):
        inside = F.contains(low, F.lit(t))
        term, end = F.when(inside, F.lit(t)).otherwise(term), F.when(inside, F.instr(low, t) - 1 + len(t)).otherwise(end)
    return term, end


def card_player() -> Column:
    ends = F.struct(_set_hit()[1].alias("set"), F.length(found(F.col("title"), r"(?s)^(.*?)#\s?[A-Za-z0-9]", 1)).alias("hash"))

    def of_title(at: Column) -> Column:
        part = F.substr(F.col("title"), at["set"] + 1, at["hash"] - at["set"])
        for noise in CARD_NOISE:
            part = F.regexp_replace(part, pattern(noise, True), " ")
        return F.when(at["hash"] > at["set"], let(slug(part), lambda name: F.when(F.size(F.split(name, "-")) >= 2, name)))

    return let(first_aspect(*PLAYER_NAMES), lambda named: F.when(named.isNotNull(), slug(named)).otherwise(let(ends, of_title)))


def card_year() -> Column:
    return found(F.coalesce(first_aspect(*YEAR_NAMES), F.col("title")), r"\b(19|20)\d{2}\b")


def card_set_of() -> Column:
    return card_set(F.coalesce(first_aspect(*SET_NAMES), _set_hit()[0]))


def card_number() -> Column:
    return F.coalesce(found(first_aspect(*NUMBER_NAMES), r"#?\s*([A-Za-z0-9]+)", 1), found(F.col("title"), r"#\s?([A-Za-z0-9]+)", 1))


def card_grader() -> Column:
    return F.coalesce(first_of(first_aspect(*GRADER_NAMES), GRADERS), first_of(first_aspect(*GRADE_NAMES), GRADERS), first_of(found(F.col("title"), TITLE_GRADE, 1), GRADERS))


def card_grade() -> Column:
    """Grader and number, or `raw` where either is missing."""
    value = F.coalesce(found(first_aspect(*GRADE_NAMES), GRADE_NUMBER, 1), found(first_aspect(*GRADER_NAMES), GRADE_NUMBER, 1), found(F.col("title"), TITLE_GRADE, 2))
    return F.coalesce(F.concat(card_grader(), value), F.lit("raw"))


def key_of(*parts: Column) -> Column:
    """Parts joined by |; null if any is null or empty."""
    return F.concat(*[x for i, p in enumerate(parts) for x in ((F.lit("|"),) if i else ()) + (empty_to_null(p),)])


def sports_cards() -> Column:
    return key_of(card_player(), card_year(), card_set_of(), card_number(), card_grade())


# --- pokemon ------------------------------------------------------------------------------------
#: Grade and set noise in titles, aspect names.
POKEMON_GRADE = r"\b(PSA|BGS|CGC|SGC)\s*(?:GEM\s*MT|GEM\s*MINT|MINT|NM-?MT\+?|NM|EX-?MT|EX|VG)?\s*(10|[1-9](?:\.5)?)\b"
POKEMON_NOISE = r"\b(pok[eé]mon|holo(?:foil)?|1st edition|shadowless|unlimited|reverse|japanese|english)\b"
POKEMON_CERTS = ("Certification Number", "Certification #", "Cert Number", "Cert #")


def _any_aspect(*names: str) -> Column:
    """First non-empty value over names in order."""
    return F.coalesce(*[empty_to_null(aspect(n)) for n in names])


def pokemon_year() -> Column:
    return F.coalesce(found(F.col("title"), r"\b(?:19|20)\d{2}\b"), found(_any_aspect("Year Manufactured", "Year"), r"\b(?:19|20)\d{2}\b"))


def pokemon_set(text: Column, year: Column) -> Column:
    """First four words between year and # without the noise, joined by hyphens."""
    rest = F.substring_index(F.substr(text, F.position(year, text) + 4), "#", 1)
    words = F.regexp_replace(F.lower(F.regexp_replace(rest, pattern(POKEMON_NOISE, True), " ")), "[^a-z0-9]+", " ")
    return F.array_join(F.slice(F.filter(F.split(words, " "), lambda w: w != ""), 1, 4), "-")


def pokemon_set_of() -> Column:
    own = let(found(F.col("title"), r"\b(?:19|20)\d{2}\b"), lambda year: F.when(year.isNotNull(), empty_to_null(pokemon_set(F.col("title"), year))))
    asked = F.struct(_any_aspect("Set", "Set Name").alias("name"), pokemon_year().alias("year"))
    return F.coalesce(own, let(asked, lambda a: F.when(a["name"].isNotNull() & a["year"].isNotNull(), pokemon_set(F.concat(a["year"], F.lit(" "), a["name"], F.lit(" #")), a["year"]))))


def pokemon_number() -> Column:
    return F.coalesce(found(F.col("title"), r"#([A-Za-z0-9]+)\b", 1), found(_any_aspect("Card Number", "Card No", "Number"), r"([A-Za-z0-9]+)", 1))


def pokemon_edition() -> Column:
    """1st, else shadowless, else unl: a title that names none is unlimited."""
    return F.when(has(F.col("title"), "1st edition"), "1st").when(has(F.col("title"), "shadowless"), "shadowless").otherwise("unl")


def _pokemon_grade_parts() -> tuple[Column, Column]:
    field, company = F.nullif(aspect("Grade"), F.lit("")), F.upper(_any_aspect("Professional Grader", "Grading Company", "Grading Service"))
    bare = found(field, GRADE_NUMBER, 1)
    grader = F.coalesce(found(F.col("title"), POKEMON_GRADE, 1), found(field, POKEMON_GRADE, 1), F.when(bare.isNotNull(), company))
    value = F.when(found(F.col("title"), POKEMON_GRADE, 1).isNotNull(), found(F.col("title"), POKEMON_GRADE, 2)).otherwise(F.coalesce(found(field, POKEMON_GRADE, 2), F.when(company.isNotNull(), bare)))
    return F.upper(grader), value


def pokemon() -> Column:
    grader, value = _pokemon_grade_parts()
    return key_of(pokemon_year(), pokemon_set_of(), pokemon_number(), pokemon_edition(), F.concat(grader, value))


# --- art editions -------------------------------------------------------------------------------
#: Edition words and what is cut from titles.
EDITION_WORD = "print|multiple|edition|poster|lithograph|screenprint|etching"
EDITION_NUMBERING = r"\b\d+\s*/\s*\d+\b"
EDITION_TOKEN = r"\b(ap|pp|hc|tp|ed\.?|edition|numbered|signed)\b"
PAREN_DATE = r"\([^)]*\d{4}[^)]*\)"
SPACED_DASH = r"\s+[-–—:]\s+"


def edition_title(text: Column) -> Column:
    """Normalised artwork title; null under 8 characters."""
    t = F.lower(text)
    for regex in (EDITION_NUMBERING, EDITION_TOKEN, PAREN_DATE):
        t = F.regexp_replace(t, pattern(regex), "")
    t = F.trim(F.regexp_replace(F.regexp_replace(t, "[^a-z0-9 ]+", " "), " +", " "))
    return let(t, lambda normal: F.when(F.length(normal) >= 8, normal))


def _artist(named: Column, parts: Column) -> Column:
    return F.coalesce(blank_to_null(named), F.when(F.size(parts) > 1, blank_to_null(F.get(parts, F.lit(0)))))


def _work(named: Column, parts: Column) -> Column:
    rest = F.when(empty_to_null(named).isNull() & (F.size(parts) > 1), F.trim(F.array_join(F.slice(parts, 2, 1000), " ")))
    return F.coalesce(blank_to_null(F.coalesce(aspect("Title"), aspect("Print Name"))), rest, F.col("title"))


def art_editions() -> Column:
    gate = F.lower(F.concat_ws(" ", *[_any_aspect(n) for n in ("Type", "Medium", "Print Surface", "Format")], F.nullif(F.col("title"), F.lit("")), F.nullif(F.col("condition"), F.lit(""))))
    given = F.struct(aspect("Artist").alias("artist"), F.split(F.col("title"), pattern(SPACED_DASH)).alias("parts"))

    def key(g: Column) -> Column:
        both = F.struct(_artist(g["artist"], g["parts"]).alias("artist"), edition_title(_work(g["artist"], g["parts"])).alias("work"))
        return let(both, lambda b: F.when(b["artist"].isNotNull() & b["work"].isNotNull(), F.concat(slug(b["artist"]), F.lit("|"), slug(b["work"]))))

    return F.when(has(gate, EDITION_WORD, False), let(given, key))


# --- autographs ---------------------------------------------------------------------------------
#: Fixed values: (format, phrase whatever its case, abbreviation in capitals), in order.
FORMATS = (
    ("als", r"autograph(?:ed)? letter,? signed", r"\bALS\b"),
    ("tls", r"typed letter,? signed", r"\bTLS\b"),
    ("ans", r"autograph(?:ed)? note,? signed", r"\bANS\b"),
    ("aqs", r"autograph(?:ed)? (?:quotation|quote|manuscript),? signed", r"\b(?:AQS|AMS|AMQS)\b"),
    ("ds", r"document,? signed|signed document", r"\bDS\b"),
    ("ls", r"letter,? signed|signed letter", r"\bLS\b"),
    ("check", r"signed (?:check|bank check)|check,? signed", None),
    ("sp", r"signed (?:photo(?:graph)?|portrait)|photo(?:graph)?,? signed", r"\bSP\b"),
    ("book", r"signed book|book,? signed|signed (?:first|1st) edition", None),
)
#: Words of copies, words that end a name, and particles inside one.
REPRODUCTION = r"\b(reprint|re-print|reproduction|facsimile|fascimile|autopen|auto-pen|secretarial|pre-?print|photocopy|restrike|re-?strike)\b"
CUT_WORDS = (
    "signed", "autograph", "autographed", "autographs", "signature", "autographe", "typed", "handwritten", "handwrote", "letter", "letters",
    "document", "documents", "note", "notes", "photo", "photos", "photograph", "photographs", "portrait", "quotation", "quote", "manuscript",
    "check", "cheque", "book", "card", "index", "als", "tls", "ans", "aqs", "ams", "amqs", "ds", "ls", "sp", "inscribed", "inscription", "cut",
    "album", "page", "first", "1st", "edition", "psa", "dna", "jsa", "beckett", "bas", "coa", "loa", "authentic", "authenticated", "authentication",
    "certified", "certificate", "certification", "original", "vintage", "rare", "reprint", "reproduction", "facsimile", "autopen",
)
PARTICLES = (
    "de", "van", "von", "der", "den", "del", "della", "di", "da", "du", "la", "le", "el", "bin", "al", "st", "st.", "mac", "mc",
)
NAME_TOKEN = r"^[A-Z][A-Za-z'’.\-]*$"


def autograph_format(title: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, phrase, short in reversed(FORMATS):
        hit = has(title, phrase) if short is None else has(title, phrase) | has(title, short, False)
        out = F.when(hit, F.lit(name)).otherwise(out)
    return out


def _bare(token: Column) -> Column:
    return F.regexp_replace(F.lower(token), "[.,]+$", "")


def signer_of_title(title: Column) -> Column:
    """Leading run of capitalised tokens: particles may stand inside, a cut word or other token ends it."""
    tokens = F.split(F.trim(F.regexp_replace(title, pattern(r"\s+"), " ")), " ")
    start = F.struct(F.array().cast("array<string>").alias("name"), F.lit(True).alias("open"))

    def step(s: Column, t: Column) -> Column:
        particle = _bare(t).isin(*PARTICLES) & (F.size(s["name"]) > 0)
        goes_on = s["open"] & ~_bare(t).isin(*CUT_WORDS) & (t.rlike(NAME_TOKEN) | particle)
        return F.struct(F.when(goes_on, F.array_append(s["name"], t)).otherwise(s["name"]).alias("name"), goes_on.alias("open"))

    run = F.aggregate(tokens, start, step, lambda s: s["name"])

    def without_particles(name: Column) -> Column:
        """Trailing particles fall off: kept up to the last token that is none."""
        last = F.array_max(F.transform(name, lambda t, i: F.when(~_bare(t).isin(*PARTICLES), i + 1).otherwise(0)))
        return F.slice(name, F.lit(1), F.coalesce(last, F.lit(0)))

    return let(let(run, without_particles), lambda name: F.when(F.size(name) >= 2, F.trim(F.regexp_replace(F.array_join(name, " "), "[.,]+$", ""))))


def without_suffix(name: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(name, pattern(r",?\s+(jr|sr|ii|iii|iv)\.?\s*$", True), ""), pattern(r"[.,]+\s*$"), ""))


def signer() -> Column:
    named = blank_to_null(F.coalesce(aspect("Signed By"), aspect("Autographed By")))
    return without_suffix(F.coalesce(let(named, lambda n: F.when(~F.lower(n).isin(*CUT_WORDS), n)), signer_of_title(F.col("title"))))


def aspect_values() -> Column:
    """Title, condition and all aspect values, blank-separated."""
    return F.concat_ws(" ", F.nullif(F.col("title"), F.lit("")), F.nullif(F.col("condition"), F.lit("")), F.transform(F.coalesce(F.col("aspects"), F.array().cast("array<struct<name:string,value:string>>")), lambda a: a["value"]))


def autographs() -> Column:
    kind = F.coalesce(aspect("Original/Reproduction"), aspect("Type"))
    copy = has(aspect_values(), REPRODUCTION) | has(kind, "reproduction|reprint|facsimile|copy")
    return F.when(~copy, key_of(slug(signer()), autograph_format(F.col("title"))))


# --- watches ------------------------------------------------------------------------------------
#: Brands in order, words of copies, and the form of a reference.
BRANDS = ((r"\bpatek\s*philippe\b|\bpatek\b", "patek-philippe"), (r"\baudemars\s*piguet\b", "audemars-piguet"), (r"\brolex\b", "rolex"), (r"\bomega\b", "omega"), (r"\bcartier\b", "cartier"))
REPLICA = r"\b(replica|homage|fake|counterfeit|style of|inspired by)\b"
REFERENCE = r"\b(\d{4,6}(?:[a-z]{1,4})?(?:/\d{1,4}[a-z]?)?)\b"
#: Fixed values, in order; patterns over lower-case text.
MATERIALS = (
    (r"\bplatinum\b", "platinum"),
    (r"two[- ]tone|steel\s*(?:and|&|/)\s*gold|gold\s*(?:and|&|/)\s*steel", "two-tone"),
    (r"\b(?:yellow|rose|pink|white)\s+gold\b|\b18k\b|\b14k\b|\bgold\b", "gold"),
    (r"stainless|\bsteel\b", "steel"),
    (r"\btitanium\b", "titanium"),
)


def watch_brand() -> Column:
    return first_of(F.coalesce(aspect("Brand"), F.col("title")), BRANDS)


def watch_reference() -> Column:
    named = F.lower(F.regexp_replace(blank_to_null(aspect("Reference Number")), pattern(r"\s+"), ""))
    listed = F.filter(F.transform(F.regexp_extract_all(F.col("title"), F.lit(pattern(REFERENCE, True)), F.lit(1)), F.lower), lambda c: ~c.rlike(r"^(19|20)\d{2}$"))
    return F.coalesce(let(named, lambda n: F.when(n.rlike(r"\d"), n)), F.get(listed, F.lit(0)))


def watch_material() -> Column:
    return first_of(F.lower(F.concat_ws(" ", F.nullif(F.col("title"), F.lit("")), F.nullif(F.col("condition"), F.lit("")), _any_aspect("Case Material"), _any_aspect("Band Material"))), MATERIALS)


def watches() -> Column:
    return F.when(~has(F.col("title"), REPLICA), key_of(watch_brand(), watch_reference()))


# --- design -------------------------------------------------------------------------------------
#: Designers, hedging words, and what is no model name.
DESIGNERS = ((r"\bnakashima\b", "george-nakashima"), (r"\beames\b", "charles-eames"), (r"\bprouv[eé]\b", "jean-prouve"), (r"\bjeanneret\b", "pierre-jeanneret"))
HEDGE = r"\b(style of|in the style|after|manner of|attributed|inspired|era|type|reproduction|replica)\b"
CODE_BLOCKED = (
    "no", "ca", "vol", "lot", "est", "circa", "in", "of", "at", "to", "by", "as", "for", "and", "the",
)
MODEL_BLOCKED = (
    "a", "an", "the", "pair", "set", "two", "three", "four", "six", "his", "her", "walnut", "teak", "oak", "rosewood", "pine", "maple", "cherry",
    "burl", "laurel", "custom", "rare", "early", "important", "fine", "exceptional", "monumental", "large", "small", "long", "low", "high", "tall",
    "double", "single", "grand", "occasional", "freeform", "free-form", "upholstered", "illuminated", "unique", "special", "signed", "vintage",
    "original",
)
FORM_NOUNS = "sofa|couch|settee|bench|daybed|stool|ottoman|chair|rocker|table|cabinet|chest|dresser|sideboard|credenza|desk|bed|headboard|lamp|sconce|chandelier|mirror|shelf|shelves|bookcase"


def design_model() -> Column:
    """A letter-digit code, else `model X`, else the word before a furniture noun."""
    t = F.lower(F.coalesce(F.col("title"), F.lit("")))
    code = r"\b([a-z]{1,3})[-. ]?(\d{1,4})[a-z]?\b"
    letters, digits = found(t, code, 1, False), found(t, code, 2, False)
    coded = F.when(~letters.isin(*CODE_BLOCKED) & ~digits.rlike(r"^(19|20)\d\d$"), F.concat(letters, digits))
    numbered = F.replace(found(t, r"\bmodel\s+(?:no\.?\s*)?([a-z0-9-]{1,10})\b", 1, False), F.lit("-"), F.lit(""))
    named = found(t, rf"\b([a-z][a-z-]{{2,}})\s+(?:{FORM_NOUNS})s?\b", 1, False)
    return F.coalesce(coded, numbered, F.when(~named.isin(*MODEL_BLOCKED), named))


def design() -> Column:
    return F.when(~has(F.col("title"), HEDGE), key_of(first_of(F.col("title"), DESIGNERS), design_model()))


# --- registry -----------------------------------------------------------------------------------
MATCHERS = {"sports-cards": sports_cards, "pokemon": pokemon, "art-editions": art_editions, "autographs": autographs, "watches": watches, "design": design}


def identify(listings: DataFrame, order: Column, names: Sequence[str] = tuple(MATCHERS)) -> DataFrame:
    """listings with key and vertical: the first matcher of the row's `order` (array of names) that yields a key.

    names: the matchers that orders may hold; a lane that uses few has a much smaller plan with just these.
    """
    keys = listings.withColumns({f"_key_{name}": F.when(F.array_contains(order, name), MATCHERS[name]()) for name in names})
    options = F.array(*[F.struct(F.array_position(order, name).alias("at"), F.col(f"_key_{name}").alias("key"), F.lit(name).alias("vertical")) for name in names])
    best = F.get(F.array_sort(F.filter(options, lambda o: o["key"].isNotNull())), F.lit(0))
    out = keys.withColumn("_best", best)
    return out.withColumn("key", F.col("_best.key")).withColumn("vertical", F.col("_best.vertical")).drop("_best", *[f"_key_{n}" for n in names])

"""Format-preserving Feistel pseudonyms, with DataFrame functions only.

Candidates are found by pattern, validated, and permuted within their format by a keyed Feistel
network on Z_a x Z_b: each round adds a keyed hash of one half to the other, so the map is a
bijection of the format and equal values get equal pseudonyms in every document. The driver derives a
key for each round from the secret by HMAC; only these are in the plan. They begin with `ROUND_MARK`,
so that `spark.sql.redaction.string.regex` can hide them in plans that are shown or logged.

* payment cards (13-19 digits, Luhn): the payload digits; the check digit is recomputed;
* IBANs (mod 97): the account's letters and digits, each within its class; check digits are recomputed;
* phone numbers in international form, with or without separators: the digits after the country code,
  and numbers with a three-digit area code in brackets: all digits;
* social security numbers (area, group and serial in range): within the valid ones;
* IPv4 addresses: within all 32-bit values;
* calendar dates (Y-M-D, also before a time; D.M.Y, M/D/Y) of 1800-2199: within the 146,097 days of those 400 years;
* e-mail addresses: letters and digits of the local part, each within its class; letters of any script count
  as part of an address, and those of LETTERS are permuted within their run of the alphabet.

Cards and IBANs may stand in a longer run of digit or letter groups: all runs of whole groups are
tested, those that are laid out as cards or have their country's length first, then longer ones. So
are the groups of any candidate that fails its validation. What stays invalid is left as it is, and so
is all other text: among it local phone numbers without brackets or country, extensions, IPv6 addresses,
dates with one-digit days or months, numbers that touch a letter, and letters of scripts not in LETTERS.

Cases: a null text stays null with no values; texts are processed whole, whatever their length (a
candidate is bounded, the search over it is linear in the text). Repeated rows give repeated results,
an empty table an empty one. All other columns, whatever their names, pass through unread; where one
has the name of the new column, the new one gets underscores until it differs.
"""

from __future__ import annotations

import hashlib
import hmac

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
#: What round keys in a plan begin with.
ROUND_MARK = "round-key-"
#: First and last day of the 400-year cycle that dates are permuted in, and two factors of its days.
FIRST_DAY, DAYS, DAY_FACTORS = "1800-01-01", 146_097, (189, 773)

#: Country calling codes, and those whose numbers have 10, 9 or 8 digits after the code.
COUNTRY = r"(?:2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|21[1-368]|2[2346]\d|25[0-8]|29[0179]|35\d|37[0-8]|38[0-35-79]|42[013]|50\d|59\d|67[02-9]|68[0-35-9]|69[0-2]|80[08]|85[02356]|87[0-48]|88[0-368]|96[0-8]|97[0-79]|99[2-68])"
FIXED = {10: "[17]|90|91|52|30", 9: "33|31|34|41|48|61|351|420|421|40|380|27", 8: "45|47|65|852"}
#: Length of an IBAN by country.
IBAN_LENGTHS = {
    **{15: "NO", 16: "BE", 18: "DK FI FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS", 23: "AE GI IL"},
    **{24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "PT", 26: "IS TR", 27: "FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB PL", 29: "BR PS QA UA", 30: "JO KW MU", 31: "MT"},
}
#: Digits in the groups of a printed card number.
CARD_GROUPS = ("4-4-4-4", "4-6-5", "4-4-4-4-3")
#: Most characters of an IBAN, and so most groups of a run.
MOST_GROUPS = 34

#: First code point and number of letters of runs of an alphabet: Latin-1 (both cases, in two runs each), Latin
#: Extended-A, Greek and Cyrillic (both cases), Hebrew, Arabic, Devanagari and Thai consonants, Hiragana, Katakana, Han, Hangul.
LETTERS = (
    (0xC0, 23), (0xD8, 7), (0xE0, 23), (0xF8, 8), (0x100, 128), (0x391, 17), (0x3A3, 7), (0x3B1, 25), (0x410, 32), (0x430, 32), (0x5D0, 27), (0x627, 20), (0x641, 10),
    (0x915, 37), (0xE01, 46), (0x3041, 86), (0x30A1, 90), (0x4E00, 20992), (0xAC00, 11172),
)

_EDGE_BEFORE, _EDGE_AFTER = r"(?<![A-Za-z0-9])", r"(?![A-Za-z0-9])"
_EMAIL = r"(?<![\p{L}\p{N}])[\p{L}\p{N}][\p{L}\p{M}\p{N}._%+\-]{0,63}@(?:[\p{L}\p{M}\p{N}\-]{1,63}\.){1,8}\p{L}[\p{L}\p{M}]{1,23}(?![\p{L}\p{M}\p{N}])"
_SSN = r"\d{3}-\d{2}-\d{4}(?!-)"
_DATE = r"\d{4}-\d{2}-\d{2}|\d{2}\.\d{2}\.\d{4}|\d{2}/\d{2}/\d{4}"
_IPV4 = r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\.\d)"
#: A date that a time or zone follows.
_STAMP = r"\d{4}-\d{2}-\d{2}(?=[Tt]\d{2}|[Zz](?![A-Za-z0-9]))"
#: No other value begins here, so a run of groups goes on.
_ON = rf"(?!{_STAMP}|(?:{_EMAIL}|{_SSN}|{_DATE}|{_IPV4}){_EDGE_AFTER})"
_NO_CARD = r"(?!\d{4}[ \-]\d{4}[ \-]\d{4}[ \-]\d{4}(?!\d)|\d{4}[ \-]\d{6}[ \-]\d{5}(?!\d)|\d{13,19}(?!\d))"
_DIGIT = rf"(?:[ .\-]{_ON}{_NO_CARD})?\(?\d\)?"
#: Pattern of each kind, in the order in which they are tried at a place.
PATTERNS = {
    "email": _EMAIL,
    "iban": rf"[A-Z]{{2}}\d{{2}}[A-Z0-9]*+(?![a-z])(?: {_ON}(?!\d++-\d)[A-Z0-9]++(?![a-z]))*+",
    "phone": "|".join([r"\(\d{3}\) ?\d{3}[ .\-]\d{4}", r"\+\d{1,3}[ .\-]?\(?\d{2,4}\)?[ .\-]?\d{3,4}[ .\-]?\d{3,4}", *(rf"\+(?:{codes})(?:{_DIGIT}){{{n}}}" for n, codes in FIXED.items()), rf"\+{COUNTRY}(?:{_DIGIT}){{5,12}}"]),
    "ssn": _SSN,
    "date": _DATE,
    "ipv4": _IPV4,
    "card": rf"(?=\d(?:[ \-]?\d){{12}})\d++(?![A-Za-z])(?:[ \-]{_ON}\d++(?![A-Za-z]))*+",
}
ANY = f"{_EDGE_BEFORE}(?:{_STAMP}|(?:{'|'.join(PATTERNS.values())}){_EDGE_AFTER})"
KINDS = tuple(PATTERNS)


def round_keys(key: str) -> list[str]:
    """A key for each round, derived from the secret."""
    return [ROUND_MARK + hmac.new(key.encode(), f"round {i}".encode(), hashlib.sha256).hexdigest() for i in range(ROUNDS)]


def _hash(key: str, tweak: Column, step: Column, half: Column) -> Column:
    """Keyed hash of a round as hex."""
    keys = round_keys(key)
    own = F.substr(F.lit("".join(keys)), step * len(keys[0]) + 1, F.lit(len(keys[0])))
    return F.sha2(F.concat_ws("|", own, tweak, half.cast("string")), 256)


def feistel(a: Column, b: Column, size_a: Column, size_b: Column, key: str, tweak: Column, back: bool = False) -> Column:
    """struct(a, b), permuted within Z_size_a x Z_size_b; back inverts it."""

    def number(step: Column, half: Column) -> Column:
        return F.conv(F.substring(_hash(key, tweak, step, half), 1, 15), 16, 10).cast("long")

    def turn(s: Column, step: Column) -> Column:
        sign = -1 if back else 1
        new_a = F.struct(F.pmod(s["a"] + sign * F.pmod(number(step, s["b"]), size_a), size_a).alias("a"), s["b"].alias("b"))
        new_b = F.struct(s["a"].alias("a"), F.pmod(s["b"] + sign * F.pmod(number(step, s["a"]), size_b), size_b).alias("b"))
        return F.when(step % 2 == 0, new_a).otherwise(new_b)

    steps = F.sequence(F.lit(0), F.lit(ROUNDS - 1))
    start = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))
    return F.aggregate(F.reverse(steps) if back else steps, start, turn)


def permute_digits(digits: Column, key: str, kind: str, back: bool = False) -> Column:
    """A digit string of 2 to 36 digits, permuted among those of its length."""
    n = F.length(digits)
    left = F.floor(n / 2).cast("int")
    sizes = F.pow(F.lit(10.0), left).cast("long"), F.pow(F.lit(10.0), n - left).cast("long")
    done = feistel(F.substr(digits, F.lit(1), left), F.substr(digits, left + 1), *sizes, key, F.concat(F.lit(kind), n.cast("string")), back)
    # the pair is built once and read twice
    return F.aggregate(F.array(done), F.lit(""), lambda _, s: F.concat(F.lpad(s["a"].cast("string"), left, "0"), F.lpad(s["b"].cast("string"), n - left, "0")))


def luhn_sum(digits: Column) -> Column:
    """Luhn sum of a digit string whose last digit is the check digit."""
    values = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(2 * c.cast("int") - F.when(c.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(values, F.lit(0), lambda s, x: s + x)


def mod97(digits: Column) -> Column:
    return F.aggregate(F.split(digits, ""), F.lit(0), lambda r, c: (r * 10 + c.cast("int")) % 97)


def _only_digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _laid_out(like: Column, signs: Column, kind: str = "[0-9]") -> Column:
    """signs in the places of like's digits, or other signs of a kind."""
    between = F.split(like, kind)
    return F.array_join(F.zip_with(between, F.split(signs, ""), lambda s, d: F.concat(s, F.coalesce(d, F.lit("")))), "")


def _let(value: Column, then) -> Column:
    """then(value), with value made once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _numbers(signs: Column) -> Column:
    """Capital letters as the numbers from 10 on."""
    return F.array_join(F.transform(F.split(signs, ""), lambda c: F.when(F.ascii(c) > 64, (F.ascii(c) - 55).cast("string")).otherwise(c)), "")


def _card(m: Column, key: str) -> Column:
    digits = _only_digits(m)
    payload = permute_digits(F.substr(digits, F.lit(1), F.length(digits) - 1), key, "card")
    whole = F.aggregate(F.array(payload), F.lit(""), lambda _, p: F.concat(p, F.pmod(-luhn_sum(F.concat(p, F.lit("0"))), F.lit(10)).cast("string")))
    return _laid_out(m, whole)


def _iban(m: Column, key: str) -> Column:
    signs = F.replace(m, F.lit(" "), F.lit(""))
    country, account = F.substring(signs, 1, 2), F.substr(signs, F.lit(5))
    new = F.when(account.rlike("^[0-9]+$"), permute_digits(account, key, "iban")).otherwise(permute_classes(account, key, "iban"))
    whole = F.aggregate(F.array(new), F.lit(""), lambda _, a: F.concat(country, F.lpad((98 - mod97(_numbers(F.concat(a, country, F.lit("00"))))).cast("string"), 2, "0"), a))
    return _laid_out(m, whole, "[A-Z0-9]")


def _valid_run(groups: Column, gaps: Column, whole: Column) -> Column:
    """Best valid run of the first groups: struct(typical, size, groups, kind), or null."""

    def run(k: Column) -> Column:
        own = F.slice(groups, F.lit(1), k)
        return F.struct(k.alias("k"), F.array_join(own, "").alias("signs"), F.array_join(F.slice(gaps, F.lit(1), k - 1), "").alias("gaps"), F.array_join(F.transform(own, lambda g: F.length(g).cast("string")), "-").alias("layout"))

    def judged(r: Column) -> Column:
        n = F.length(r["signs"])
        single = F.length(r["gaps"]) == r["k"] - 1
        card = n.between(13, 19) & single & r["signs"].rlike("^[0-9]+$") & r["gaps"].rlike("^[ -]*$")
        iban = n.between(15, MOST_GROUPS) & single & r["signs"].rlike(r"^[A-Z]{2}\d{2}") & r["gaps"].rlike("^ *$")
        at_home = F.array_contains(F.get(lengths, n - 15), F.substring(r["signs"], 1, 2))
        typical = r["layout"].isin(*CARD_GROUPS) | (r["k"] == 1) | (whole & (r["k"] == F.size(groups)))
        in_order = F.concat(F.substr(r["signs"], F.lit(5)), F.substring(r["signs"], 1, 4))
        is_card = F.when(card, luhn_sum(r["signs"]) % 10 == 0)
        is_iban = F.when(iban, mod97(_numbers(in_order)) == 1)
        return F.when(is_card, F.struct(typical.alias("typical"), n.alias("n"), r["k"].alias("k"), F.lit("card").alias("kind"))).when(
            is_iban, F.struct(F.coalesce(at_home, F.lit(False)).alias("typical"), n.alias("n"), r["k"].alias("k"), F.lit("iban").alias("kind"))
        )

    lengths = F.array(*[F.array(*[F.lit(c) for c in IBAN_LENGTHS.get(n, "--").split()]) for n in range(15, MOST_GROUPS + 1)])
    runs = F.transform(F.sequence(F.lit(1), F.size(groups)), run)
    return F.array_max(F.transform(runs, judged))


def _in_runs(m: Column, key: str) -> Column:
    """struct(text, found): m with the cards and IBANs in its runs of whole groups permuted."""

    def with_groups(s: Column) -> Column:
        def group(g: Column, i: Column) -> Column:
            near = _let(
                F.struct(F.slice(s["groups"], i + 1, F.lit(MOST_GROUPS)).alias("groups"), F.slice(s["gaps"], i + 2, F.lit(MOST_GROUPS - 1)).alias("gaps")),
                lambda w: _valid_run(w["groups"], w["gaps"], (i == 0) & (F.size(w["groups"]) == F.size(s["groups"]))),
            )
            return F.struct(F.length(F.get(s["gaps"], i)).alias("gap"), F.length(g).alias("n"), near.alias("run"))

        return F.transform(s["groups"], group)

    def not_crossed(places: Column) -> Column:
        # a run that is laid out like nothing yields to one that is and begins inside it
        def kept(p: Column, i: Column) -> Column:
            inside = F.slice(places, i + 2, p["run"]["k"] - 1)
            crossed = ~p["run"]["typical"] & F.exists(inside, lambda q: F.coalesce(q["run"]["typical"], F.lit(False)))
            return F.struct(p["gap"].alias("gap"), p["n"].alias("n"), F.when(~crossed, p["run"]).alias("run"))

        return F.transform(places, kept)

    def step(a: Column, p: Column) -> Column:
        at = a["next"] + p["gap"]
        take = (a["skip"] == 0) & p["run"].isNotNull()
        size = p["run"]["n"] + p["run"]["k"] - 1
        taken = F.when(take, F.concat(a["taken"], F.array(F.struct(at.alias("at"), size.alias("size"), p["run"]["kind"].alias("kind"))))).otherwise(a["taken"])
        skip = F.when(take, p["run"]["k"] - 1).otherwise(F.greatest(F.lit(0), a["skip"] - 1))
        return F.struct((at + p["n"]).alias("next"), skip.alias("skip"), taken.alias("taken"))

    def written(runs: Column) -> Column:
        def new(r: Column, i: Column) -> Column:
            before = F.when(i > 0, F.get(runs, i - 1)["at"] + F.get(runs, i - 1)["size"]).otherwise(F.lit(1))
            old = F.substr(m, r["at"], r["size"])
            return F.struct(F.substr(m, before, r["at"] - before).alias("before"), r["kind"].alias("kind"), F.when(r["kind"] == "card", _card(old, key)).otherwise(_iban(old, key)).alias("value"))

        def joined(news: Column) -> Column:
            last = F.get(runs, F.size(runs) - 1)
            text = F.concat(F.array_join(F.transform(news, lambda x: F.concat(x["before"], x["value"])), ""), F.substr(m, last["at"] + last["size"]))
            return F.struct(text.alias("text"), F.transform(news, lambda x: F.struct(x["kind"].alias("kind"), x["value"].alias("value"))).alias("found"))

        return F.when(F.size(runs) > 0, _let(F.transform(runs, new), joined))

    parts = F.struct(F.regexp_extract_all(m, F.lit("[A-Z0-9]+"), F.lit(0)).alias("groups"), F.split(m, "[A-Z0-9]+").alias("gaps"))
    start = F.struct(F.lit(1).alias("next"), F.lit(0).alias("skip"), F.array().cast("array<struct<at:int,size:int,kind:string>>").alias("taken"))
    runs = F.aggregate(_let(_let(parts, with_groups), not_crossed), start, step, lambda a: a["taken"])
    return F.when(F.length(m) > 12, _let(runs, written))


def _phone(m: Column, key: str) -> Column:
    apart = F.regexp_extract(m, r"^\+\d{1,3}(?=[ .\-(])", 0)
    country = F.when(apart != "", apart).otherwise(F.regexp_extract(m, rf"^\+(?:[17]|{COUNTRY})", 0))
    rest = F.substr(m, F.length(country) + 1)
    digits = _only_digits(rest)
    fits = F.when((apart == "") & country.isin("+1", "+7"), F.length(digits) == 10).otherwise(F.length(digits).between(5, 14))
    known = m.startswith("(") | ((country != "") & fits)
    return F.when(known, F.concat(country, _laid_out(rest, permute_digits(digits, key, "phone"))))


def _ssn(m: Column, key: str) -> Column:
    area, group, serial = (F.regexp_extract(m, r"^(\d+)-(\d+)-(\d+)$", i).cast("long") for i in (1, 2, 3))
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    done = feistel(area - 1 - F.when(area > 666, 1).otherwise(0), (group - 1) * 9999 + serial - 1, F.lit(898), F.lit(99 * 9999), key, F.lit("ssn"))

    def text(_: Column, s: Column) -> Column:
        new = s["a"] + 1 + F.when(s["a"] >= 665, 1).otherwise(0)
        parts = ((new, 3), (F.floor(s["b"] / 9999) + 1, 2), (s["b"] % 9999 + 1, 4))
        return F.concat_ws("-", *[F.lpad(x.cast("string"), n, "0") for x, n in parts])

    return F.when(valid, F.aggregate(F.array(done), F.lit(""), text))


def _ipv4(m: Column, key: str) -> Column:
    parts = F.split(m, r"\.")
    at = [parts[i].cast("long") for i in range(4)]
    done = feistel(at[0] * 256 + at[1], at[2] * 256 + at[3], F.lit(65536), F.lit(65536), key, F.lit("ipv4"))

    def text(_: Column, s: Column) -> Column:
        return F.concat_ws(".", *[x.cast("string") for half in ("a", "b") for x in (F.floor(s[half] / 256), s[half] % 256)])

    return F.when(F.forall(parts, lambda p: p.cast("int") <= 255), F.aggregate(F.array(done), F.lit(""), text))


def _day_writer(form: str):
    def text(_: Column, s: Column) -> Column:
        return F.date_format(F.date_add(F.lit(FIRST_DAY).cast("date"), (s["a"] * DAY_FACTORS[1] + s["b"]).cast("int")), form)

    return text


def _date(m: Column, key: str) -> Column:
    out = None
    for shape, form in ((r"^\d{4}-", "yyyy-MM-dd"), (r"^\d{2}\.", "dd.MM.yyyy"), (r"^\d{2}/", "MM/dd/yyyy")):
        # each shape is brought to year-month-day, which the parser checks strictly
        day = m if form == "yyyy-MM-dd" else F.regexp_replace(m, r"^(\d\d)\.(\d\d)\.(\d{4})$", "$3-$2-$1") if "." in form else F.regexp_replace(m, r"^(\d\d)/(\d\d)/(\d{4})$", "$3-$1-$2")
        n = F.date_diff(day.try_cast("date"), F.lit(FIRST_DAY).cast("date"))
        done = feistel(F.floor(n / DAY_FACTORS[1]), n % DAY_FACTORS[1], F.lit(DAY_FACTORS[0]), F.lit(DAY_FACTORS[1]), key, F.lit("date"))
        new = F.aggregate(F.array(done), F.lit(""), _day_writer(form))
        text = F.when(m.rlike(shape) & n.between(0, DAYS - 1), new)
        out = text if out is None else F.coalesce(out, text)
    return out


def permute_classes(text: Column, key: str, kind: str) -> Column:
    """A text with its letters and digits permuted, each within its class."""
    n = F.length(text)
    left = F.floor(n / 2).cast("int")

    def shifted(text: Column, by: Column) -> Column:
        def one(c: Column, i: Column) -> Column:
            add, code = F.conv(F.substr(by, 1 + 2 * (i % 32), F.lit(2)), 16, 10).cast("int"), F.ascii(c)
            low = F.when(code.between(97, 122), 97).when(code.between(65, 90), 65).when(code.between(48, 57), 48)
            plain = F.when(low.isNull(), c).otherwise(F.char(low + (code - low + add) % F.when(low == 48, 10).otherwise(26)))
            other = c
            for first, size in LETTERS:
                new = F.lit(first) + (code - first + add) % size
                other = F.when(code.between(first, first + size - 1), F.decode(F.unhex(F.lpad(F.hex(new), 4, "0")), "UTF-16BE")).otherwise(other)
            return F.when(code < 128, plain).otherwise(other)

        return F.array_join(F.transform(F.split(text, ""), one), "")

    def turn(s: Column, step: Column) -> Column:
        tweak = F.concat(F.lit(kind), n.cast("string"))
        new_a = F.struct(shifted(s["a"], _hash(key, tweak, step, s["b"])).alias("a"), s["b"].alias("b"))
        new_b = F.struct(s["a"].alias("a"), shifted(s["b"], _hash(key, tweak, step, s["a"])).alias("b"))
        return F.when(step % 2 == 0, new_a).otherwise(new_b)

    halves = F.struct(F.substr(text, F.lit(1), left).alias("a"), F.substr(text, left + 1).alias("b"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), halves, turn, lambda s: F.concat(s["a"], s["b"]))


def _email(m: Column, key: str) -> Column:
    local = F.substring_index(m, "@", 1)
    return F.concat(permute_classes(local, key, "email"), F.substr(m, F.length(local) + 1))


_PSEUDONYM = {"email": _email, "phone": _phone, "ssn": _ssn, "date": _date, "ipv4": _ipv4}


def pseudonym(m: Column, key: str) -> Column:
    """struct(text, found) for one candidate: its new text and array<struct<kind, value>> of the values in it."""
    cases = F.when(F.lit(False), F.lit(None).cast("struct<kind:string,value:string>"))
    for k in KINDS:
        own = F.struct(F.lit(k).alias("kind"), _PSEUDONYM[k](m, key).alias("value")) if k in _PSEUDONYM else F.lit(None)
        cases = cases.when(m.rlike(f"^(?:{PATTERNS[k]})$"), own)
    nothing = F.struct(m.alias("text"), F.array().cast("array<struct<kind:string,value:string>>").alias("found"))
    return _let(cases, lambda v: F.when(v["value"].isNotNull(), F.struct(v["value"].alias("text"), F.array(v).alias("found"))).otherwise(F.coalesce(_in_runs(m, key), nothing)))


def pseudonymize(docs: DataFrame, key: str, text_col: str = "text", found_col: str = "pii") -> DataFrame:
    """docs with its text pseudonymised in place and found_col: array<struct<kind, value>> of the new values.

    Where docs has a column of that name, found_col gets underscores until it differs.
    """
    while found_col.lower() in (c.lower() for c in docs.columns):
        found_col += "_"
    text = F.col(text_col)
    maybe = text.rlike("[0-9@]")
    matches = F.when(maybe, F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))
    row = F.struct(*[F.col(c) for c in docs.columns])
    out = docs.select(row.alias("_row"), F.transform(matches, lambda m: F.struct(pseudonym(m, key).alias("new"))).alias("_found"))
    new = F.transform("_found", lambda f: f["new"]["text"])
    between = F.split(F.col("_row")[text_col], ANY)
    changed = F.array_join(F.zip_with(between, new, lambda s, v: F.concat(s, F.coalesce(v, F.lit("")))), "")
    text_now = F.when(F.size("_found") > 0, changed).otherwise(F.col("_row")[text_col])
    kept = F.flatten(F.transform("_found", lambda f: f["new"]["found"]))
    return out.select(*[(text_now if c == text_col else F.col("_row")[c]).alias(c) for c in docs.columns], kept.alias(found_col))

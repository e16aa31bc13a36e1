"""Scalar text, number and time expressions shared by the operators."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_WORD = "[A-Za-z0-9_]"
_EDGE = f"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))"


def pattern(text: str, fold: bool = False) -> str:
    """A regular expression whose word edges and blanks mean what they do in the source's dialect.

    Edges are ASCII ones, blanks include the no-break space; fold ignores case, beyond ASCII too.
    """
    out = text.replace(r"\b", _EDGE).replace(r"[^\s", r"[^\s\x{A0}").replace(r"\s", r"[\s\x{A0}]")
    return ("(?iu)" if fold else "") + out


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once for each row however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def has(text: Column, regex: str, fold: bool = True) -> Column:
    return F.coalesce(text.rlike(pattern(regex, fold)), F.lit(False))


def found(text: Column, regex: str, group: int = 0, fold: bool = True) -> Column:
    """The group's text in the first match; null if there is none."""
    p = pattern(regex, fold)
    return let(text, lambda t: F.when(t.rlike(p), F.regexp_extract(t, p, group)))


def blank_to_null(text: Column) -> Column:
    return empty_to_null(F.regexp_replace(text, r"^[\s\x{A0}]+|[\s\x{A0}]+$", ""))


def empty_to_null(text: Column) -> Column:
    return let(text, lambda t: F.when(t != "", t))


def _folded() -> tuple[dict[str, str], dict[str, str]]:
    """Lower-case characters whose compatibility decomposition has ASCII letters or digits: with just one, and the others.

    The planes that have such characters are the first one and those of styled letters and of enclosed ones.
    """
    one, more = {}, {}
    for point in (*range(0xA0, 0x10000), *range(0x1D400, 0x1D800), *range(0x1F100, 0x1F200)):
        c = chr(point)
        base = "".join(x for x in unicodedata.normalize("NFKD", c) if not 0x300 <= ord(x) <= 0x36F)
        if c == c.lower() and base != c and re.search("[a-z0-9]", base):
            (one if len(base) == 1 else more)[c] = base
    return one, more


def _ranges(points: list[int]) -> str:
    """Ordered code points as the ranges of a character class."""
    starts = [p for i, p in enumerate(points) if i == 0 or points[i - 1] != p - 1]
    ends = [p for i, p in enumerate(points) if i == len(points) - 1 or points[i + 1] != p + 1]
    return "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in zip(starts, ends, strict=True))


FOLD_ONE, FOLD_MORE = _folded()
# a class is tried range after range, so the characters of most texts are told apart by two bounds before that
_POINTS = sorted(map(ord, FOLD_MORE))
_HAS_MORE = rf"[[\x{{{_POINTS[0]:X}}}-\x{{BF}}\x{{100}}-\x{{{_POINTS[-1]:X}}}]&&[{_ranges(_POINTS)}]]"


def _spelled(low: Column) -> Column:
    """Ligatures, fractions and other signs written out; texts without any stay as they are."""
    table = F.create_map(*[F.lit(x) for pair in FOLD_MORE.items() for x in pair])
    parts = F.transform(F.split(low, ""), lambda c: F.when(c.rlike(_HAS_MORE), F.try_element_at(table, c)).otherwise(c))
    return F.when(low.rlike(_HAS_MORE), F.array_join(parts, "")).otherwise(low)


def slug(text: Column) -> Column:
    """Lower case, compatibility characters as plain ones, accents dropped, & as `and`, every other run one hyphen."""
    low = F.translate(let(F.lower(F.coalesce(text, F.lit(""))), _spelled), "".join(FOLD_ONE), "".join(FOLD_ONE.values()))
    plain = F.regexp_replace(F.regexp_replace(low, r"[\x{300}-\x{36F}]", ""), "&", " and ")
    return F.regexp_replace(F.regexp_replace(plain, "[^a-z0-9]+", "-"), "^-+|-+$", "")


def deal_id(item_id: Column) -> Column:
    """djb2 over the characters, modulo 2^32, in base 36."""
    codes = F.transform(F.split(item_id, ""), lambda c: F.ascii(c).cast("long"))
    value = F.aggregate(F.filter(codes, lambda c: c > 0), F.lit(5381).cast("long"), lambda h, c: (h * 33 + c) % 4294967296)
    return F.lower(F.conv(value.cast("string"), 10, 36))


def uri_component(text: Column) -> Column:
    """Percent-encoded as a URI component: the form encoding, but for what that writes differently."""
    out = F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))
    for code, char in (("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(code), F.lit(char))
    return out


def evidence_url(base: str, vertical: Column, key: Column) -> Column:
    return F.concat(F.lit(base.rstrip("/") + "/key/"), vertical, F.lit("/"), uri_component(key))


def half_up(x: Column) -> Column:
    """Rounded half up, towards plus infinity on ties, as long."""
    return F.floor(x + 0.5).cast("long")


def number(text: Column) -> Column:
    """A finite double, else null."""
    x = text.try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x)


def millis(iso: Column) -> Column:
    """Epoch milliseconds of an ISO date or time; null if it can't be parsed."""
    return F.unix_millis(F.try_to_timestamp(iso))


def label_of(value: Column, table: dict, default=None) -> Column:
    """Lookup in a small constant table."""
    out = F.lit(default)
    for key, to in table.items():
        out = F.when(value == key, F.lit(to)).otherwise(out)
    return out


def banded(value: Column, bands, default: int = 0) -> Column:
    """Points of the first band whose bound the value reaches."""
    out = None
    for least, points in bands:
        out = F.when(value >= least, points) if out is None else out.when(value >= least, points)
    return out.otherwise(default)

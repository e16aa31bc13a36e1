"""Read-side formatting as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyboard import config as C
from tallyboard.functions.text import half_up, label_of, millis

NONE = "—"
#: Labels.
VERTICAL_LABELS = {"watches": "Watches", "sports-cards": "Sports Cards", "pokemon": "Pokémon", "art-editions": "Art Editions", "autographs": "Autographs", "design": "Design"}
CONFIDENCE_LABELS = {"high": "High confidence", "medium": "Medium confidence"}
RISK_LABELS = {"A": "Lowest risk", "B": "Low risk", "C": "Moderate risk", "D": "High risk"}
OUTCOME_LABELS = {"live": "Live", "sold": "Sold", "ended": "Ended", "delisted": "Delisted"}


def _known(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x.cast("double"))


def money(x: Column) -> Column:
    """Whole dollars, thousands separated, half away from zero."""
    whole = F.floor(F.abs(x) + 0.5).cast("long")
    return F.when(_known(x), F.concat(F.when((x < 0) & (whole > 0), "-").otherwise(""), F.lit("$"), F.format_number(whole, 0))).otherwise(NONE)


def _tenth(x: Column) -> Column:
    t = half_up(x * 10)
    return F.concat(F.floor(t / 10).cast("string"), F.when(t % 10 == 0, "").otherwise(F.concat(F.lit("."), (t % 10).cast("string"))))


def money_compact(x: Column) -> Column:
    size = F.abs(x)
    return (
        F.when(~_known(x), NONE)
        .when(size >= 1_000_000, F.concat(F.lit("$"), _tenth(x / 1_000_000), F.lit("M")))
        .when(size >= 10_000, F.concat(F.lit("$"), half_up(x / 1000).cast("string"), F.lit("K")))
        .when(size >= 1_000, F.concat(F.lit("$"), _tenth(x / 1000), F.lit("K")))
        .otherwise(money(x))
    )


def depth_pct(x: Column) -> Column:
    return F.concat(half_up(x * 100).cast("string"), F.lit("%"))


def trend_pct(x: Column) -> Column:
    return F.when(_known(x), F.concat(F.when(x > 0, "+").otherwise(""), depth_pct(x)))


def _dated(iso: Column, form: str) -> Column:
    return F.coalesce(F.date_format(F.try_to_timestamp(iso), form), F.lit(NONE))


def short_date(iso: Column) -> Column:
    return _dated(iso, "MMM d, yyyy")


def month_year(iso: Column) -> Column:
    return _dated(iso, "MMM yyyy")


def relative_time(ms: Column, now_ms: Column) -> Column:
    mins = half_up((now_ms - ms) / 60_000)
    hours = half_up(mins / 60)
    return F.when(ms.isNull(), NONE).when(mins < 2, "just now").when(mins < 90, F.concat(mins.cast("string"), F.lit(" min ago"))).when(hours < 48, F.concat(hours.cast("string"), F.lit(" h ago"))).otherwise(F.concat(half_up(hours / 24).cast("string"), F.lit(" d ago")))


def relative_date(ms: Column, now_ms: Column) -> Column:
    days = half_up((now_ms - ms) / C.DAY_MS)
    months = half_up(days / 30)
    return (
        F.when(ms.isNull(), NONE)
        .when(days <= 0, "today")
        .when(days == 1, "yesterday")
        .when(days < 30, F.concat(days.cast("string"), F.lit(" days ago")))
        .when(months < 24, F.concat(months.cast("string"), F.lit(" mo ago")))
        .otherwise(F.concat(half_up(months / 12).cast("string"), F.lit(" yr ago")))
    )


def is_aging(ms: Column, now_ms: Column) -> Column:
    return F.coalesce((now_ms - ms) / C.MONTH_MS > 12, F.lit(False))


def is_board_stale(built: Column, conf: C.Config) -> Column:
    """Older than the limit, or of unknown age."""
    return F.coalesce(F.lit(conf.now_ms) - millis(built) > conf.board_stale_ms, F.lit(True))


def is_book_stale(built: Column, conf: C.Config) -> Column:
    return F.coalesce(F.lit(conf.now_ms) - millis(built) > conf.book_stale_ms, F.lit(True))


def pretty_key(key: Column) -> Column:
    return F.replace(key, F.lit("|"), F.lit(" · "))


def _capitals(text: Column) -> Column:
    """Hyphens to blanks, each word's first letter a capital, the rest as it is."""
    return F.array_join(F.transform(F.split(text, "-"), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2)))), " ")


def key_grade(key: Column) -> Column:
    """Grade at the end of a key as `PSA 9`, or raw; null if there is none."""
    last = F.substring_index(key, "|", -1)
    shape = r"^([A-Za-z]+)(10|[1-9](?:\.5)?)$"
    return F.when(last == "raw", "raw").when(last.rlike(shape), F.concat(F.upper(F.regexp_extract(last, shape, 1)), F.lit(" "), F.regexp_extract(last, shape, 2)))


def context_caption(kind: Column, key: Column) -> Column:
    subject = _capitals(F.substring_index(key, "|", 1))
    tails = {"signer": " signed material", "player-object": " player material", "artist": " — artist market", "class": " — class comps"}
    return F.coalesce(F.concat(subject, label_of(kind, tails)), pretty_key(key))


def lens_label(v: Column) -> Column:
    return F.coalesce(label_of(v, VERTICAL_LABELS), _capitals(v))


def vertical_label(v: Column) -> Column:
    return F.coalesce(label_of(v, VERTICAL_LABELS), v)


def confidence_label(v: Column) -> Column:
    return label_of(v, CONFIDENCE_LABELS, "Thin book")


def risk_label(v: Column) -> Column:
    return label_of(v, RISK_LABELS)


def outcome_label(v: Column) -> Column:
    return F.coalesce(label_of(v, OUTCOME_LABELS), v)


def confidence_dots(v: Column) -> Column:
    return label_of(v, {"high": 4, "medium": 2}, 1)


def grade_note(vertical: Column, key: Column, basis_key: Column) -> Column:
    own, book = key_grade(key), key_grade(F.coalesce(basis_key, key))
    return F.when(vertical.isin(*C.GRADED), F.concat(F.lit("book: "), book, F.lit(" · this listing: "), own))


def countdown(ends_ms: Column, now_ms: Column) -> Column:
    left = ends_ms - now_ms
    mins = F.floor(left / 60_000)
    h, m = F.floor(mins / 60).cast("string"), mins % 60
    return F.when(left.isNull(), "ends soon").when(left <= 0, "ended").when(mins >= 60, F.concat(F.lit("ends in "), h, F.lit("h "), m.cast("string"), F.lit("m"))).otherwise(F.concat(F.lit("ends in "), F.greatest(m, F.lit(1)).cast("string"), F.lit("m")))


def bid_label(bids: Column) -> Column:
    """Number of bids; one or none is marked as no action; unknown says nothing."""
    return F.when(bids.isNotNull(), F.concat(bids.cast("string"), F.when(bids == 1, " bid").otherwise(" bids"), F.when(bids <= 1, " · no action").otherwise("")))


def depth_bar(cost: Column, lo: Column, med: Column, hi: Column) -> Column:
    """struct of the bar's places in percent and which labels it shows."""
    low, high = F.least(cost, lo), F.greatest(hi, med, cost)
    pad = F.greatest(high - low, F.lit(1.0)) * 0.06
    start, span = low - pad, (high + pad) - (low - pad)

    def pct(x: Column) -> Column:
        return (x - start) / span * 100

    ask = pct(cost)
    return F.struct(
        pct(lo).alias("lo"), pct(med).alias("med"), pct(hi).alias("hi"), ask.alias("ask"),
        F.least(ask, pct(med)).alias("gap_left"), F.abs(pct(med) - ask).alias("gap_width"),
        F.when(ask < 14, "left").when(ask > 86, "right").otherwise("center").alias("ask_align"),
        (F.abs(pct(lo) - pct(med)) > 12).alias("show_lo"), (F.abs(pct(hi) - pct(med)) > 12).alias("show_hi"),
    )

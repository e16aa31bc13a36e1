"""The hunt list: validated YAML entries. A malformed list stops the run; a missing one is an empty lane."""

from __future__ import annotations

import math
import re
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

from tallyboard.schemas import HUNT_ENTRY
from tallyboard.sources.listings import _exists

try:
    import yaml
except ImportError:  # the list can also be passed as parsed entries
    yaml = None

FORMS = ("key", "keyPrefix", "q")


def _text(where: str, name: str, value) -> str:
    if not isinstance(value, str) or not value.strip():
        raise ValueError(f"{where}: {name} must be text that is not blank")
    return value.strip()


def _amount(where: str, name: str, value, low: float, high: float, low_open: bool) -> float:
    good = isinstance(value, (int, float)) and not isinstance(value, bool) and math.isfinite(value)
    if not good or value < low or (low_open and value == low) or value >= high:
        raise ValueError(f"{where}: {name} is out of range")
    return float(value)


def entry(raw: dict, place: int, max_depth: float = 0.90) -> tuple:
    """One entry as a row of HUNT_ENTRY; ValueError names the entry and the problem."""
    if not isinstance(raw, dict):
        raise ValueError(f"entry {place}: not a mapping")
    hunt_id = _text(f"entry {place}", "id", raw.get("id"))
    where = f"entry {hunt_id!r}"
    if not re.fullmatch(r"[a-z0-9][a-z0-9-]*", hunt_id):
        raise ValueError(f"{where}: id must be a slug")
    match = raw.get("match")
    if not isinstance(match, dict):
        raise ValueError(f"{where}: match must be a mapping")
    if unknown := set(match) - {*FORMS, "categoryHint"}:
        raise ValueError(f"{where}: unknown match fields {sorted(unknown)}")
    used = [f for f in FORMS if match.get(f) is not None]
    if len(used) != 1:
        raise ValueError(f"{where}: match needs exactly one of {', '.join(FORMS)}")
    if (used == ["q"]) != (match.get("categoryHint") is not None):
        raise ValueError(f"{where}: categoryHint goes with q, and only with it")
    values = {f: _text(where, f"match.{f}", match[f]) for f in (*used, *(["categoryHint"] if used == ["q"] else []))}
    added = str(raw.get("added") or "")
    try:
        datetime.fromisoformat(added)
    except ValueError:
        raise ValueError(f"{where}: added is no date") from None
    for name in ("titleMust", "titleNot"):
        if raw.get(name) is not None:
            try:
                re.compile(raw[name])
            except (re.error, TypeError):
                raise ValueError(f"{where}: {name} is no pattern") from None
    most = None if raw.get("maxAllIn") is None else _amount(where, "maxAllIn", raw["maxAllIn"], 0, math.inf, True)
    depth = None if raw.get("minDepth") is None else _amount(where, "minDepth", raw["minDepth"], 0, max_depth, False)
    note = raw.get("note")
    if note is not None and not isinstance(note, str):
        raise ValueError(f"{where}: note must be text")
    return (hunt_id, place, _text(where, "label", raw.get("label")), _text(where, "vertical", raw.get("vertical")), values.get("key"), values.get("keyPrefix"), values.get("q"), values.get("categoryHint"), most, depth, raw.get("titleMust"), raw.get("titleNot"), note.strip() if note else None, added)


def entries(spark: SparkSession, parsed: list | None) -> DataFrame:
    """Parsed YAML as rows in list order; an empty document is an empty list."""
    if parsed is None:
        parsed = []
    if not isinstance(parsed, list):
        raise ValueError("the hunt list must be a list")
    rows = [entry(raw, i) for i, raw in enumerate(parsed, 1)]
    if len({r[0] for r in rows}) < len(rows):
        raise ValueError("two entries share an id")
    return spark.createDataFrame(rows, HUNT_ENTRY)


def read_hunt(spark: SparkSession, path: str) -> DataFrame:
    """The hunt list at any path that Spark reads; a missing file is an empty list."""
    if not _exists(spark, path):
        return entries(spark, None)
    if yaml is None:
        raise RuntimeError("reading a hunt list needs PyYAML")
    text = spark.read.text(path, wholetext=True).first()
    try:
        parsed = yaml.safe_load(text[0] if text else "")
    except yaml.YAMLError as e:
        raise ValueError(f"the hunt list is no YAML: {e}") from None
    return entries(spark, parsed)

"""All thresholds of the board in one frozen object, and the clock as a parameter."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timezone

HOUR_MS = 3_600_000
DAY_MS = 24 * HOUR_MS
#: A month is 30.44 days throughout.
MONTH_MS = 30.44 * DAY_MS


@dataclass(frozen=True)
class Config:
    """Defaults are the published ones; now_ms is the run's clock, never the wall clock."""

    now_ms: int
    # gates
    min_depth: float = 0.25
    thin_depth: float = 0.40
    ladder_depth: float = 0.35
    max_depth: float = 0.90
    min_edge: float = 50.0
    stale_months: float = 24.0
    closing_window_ms: int = 4 * HOUR_MS
    goldmine_window_ms: int = 72 * HOUR_MS
    closing_depth: float = 0.40
    seller_floor: int = 50
    # scores
    fresh_boost: float = 1.15
    fresh_ms: int = DAY_MS
    featured_n: int = 6
    featured_n12: int = 2
    featured_most: float = 0.60
    # caps
    board_cap: int = 200
    closing_cap: int = 30
    leads_cap: int = 20
    no_book_cap: int = 8
    prefix_cap: int = 8
    lead_ratio: float = 0.5
    # goldmine lane
    goldmine_med: float = 200.0
    goldmine_months: float = 12.0
    goldmine_pool: int = 4000
    # state
    seen_ttl_ms: int = 7 * DAY_MS
    overlap_ms: int = 30 * 60_000
    tick_ms: int = 3 * HOUR_MS
    receipts_per_tick: int = 60
    book_stale_ms: int = 48 * HOUR_MS
    board_stale_ms: int = 6 * HOUR_MS
    batch: int = 20
    carry_calls: int = 15

    @staticmethod
    def at(iso: str, **changes) -> Config:
        """Config whose clock stands at an ISO time (UTC if it names no zone)."""
        t = datetime.fromisoformat(iso)
        t = t if t.tzinfo else t.replace(tzinfo=timezone.utc)
        return Config(int(t.timestamp() * 1000), **changes)


#: Weights of confidence and risk grade in the rank, and points of the risk score.
CONFIDENCE_WEIGHT = {"high": 1.0, "medium": 0.6, "thin": 0.35}
RISK_WEIGHT = {"A": 1.0, "B": 0.85, "C": 0.6, "D": 0.3}
GRADE_FROM = (("A", 80), ("B", 60), ("C", 40))
ANCHOR_POINTS = {"cert-verified": 40, "slab-claimed": 25, "papers": 25, "raw": 5}
FEEDBACK_POINTS = ((99.5, 15), (98.0, 12), (95.0, 8), (90.0, 4))
VOLUME_POINTS = ((1000, 10), (100, 8), (10, 4), (1, 2))
ASPECT_POINTS = ((6, 14), (3, 9), (1, 4))
ACCOUNT_POINTS = {"BUSINESS": 5, "INDIVIDUAL": 2}
IMAGE_POINTS, FLAG_PENALTY, QUALITY_MOST = 6, 8, 20
VERTICAL_POINTS = {"sports-cards": 10, "pokemon": 10, "design": 5, "art-editions": 4, "watches": 4, "autographs": 4}
#: Verticals that every tick reports, and those whose keys end in a grade.
LAUNCH = ("sports-cards", "pokemon", "art-editions", "autographs", "watches")
GRADED = ("sports-cards", "pokemon")

#: The source plan. Order decides which slice keeps an item that several yield.
SLICES = (
    # id, category, lens, matchers in order, lane
    ("cards-slabs", "261328", "sports-cards", ("sports-cards",), "cards"),
    ("cards-raw", "261328", "sports-cards", ("sports-cards",), "cards"),
    ("pokemon", "183454", "pokemon", ("pokemon",), "other"),
    ("watches", "31387", "watches", ("watches",), "other"),
    ("sports-autos", "51", "autographs", ("autographs",), "other"),
    ("ent-autos", "57", "autographs", ("autographs",), "other"),
    ("historical-autos", "14428", "autographs", ("autographs",), "other"),
    ("art-prints", "360", "art-editions", ("art-editions",), "other"),
    ("fossils", "3213", "science", (), "other"),
    ("vintage-computing", "11189", "science", (), "other"),
    ("cards-slabs-closing", "261328", "sports-cards", ("sports-cards",), "auction"),
    ("watches-closing", "31387", "watches", ("watches",), "auction"),
    ("sports-autos-closing", "51", "autographs", ("autographs",), "auction"),
    ("ent-autos-closing", "57", "autographs", ("autographs",), "auction"),
    ("historical-autos-closing", "14428", "autographs", ("autographs",), "auction"),
)

"""Explicit schemas of every input and artifact; absent optional fields read as null."""

from __future__ import annotations

RAW_LISTING = (
    "itemId STRING, legacyItemId STRING, title STRING, price STRUCT<value: STRING, currency: STRING>, currentBidPrice STRUCT<value: STRING, currency: STRING>, "
    "bidCount INT, condition STRING, conditionId STRING, image STRUCT<imageUrl: STRING>, thumbnailImages ARRAY<STRUCT<imageUrl: STRING>>, itemWebUrl STRING, "
    "itemAffiliateWebUrl STRING, seller STRUCT<username: STRING, feedbackPercentage: STRING, feedbackScore: BIGINT, sellerAccountType: STRING>, "
    "shippingOptions ARRAY<STRUCT<shippingCost: STRUCT<value: STRING, currency: STRING>, shippingCostType: STRING>>, itemCreationDate STRING, itemEndDate STRING, "
    "itemGroupType STRING, buyingOptions ARRAY<STRING>, categories ARRAY<STRUCT<categoryId: STRING, categoryName: STRING>>, "
    "localizedAspects ARRAY<STRUCT<name: STRING, type: STRING, value: STRING>>, shortDescription STRING"
)
BOOK_ROW = "k: STRING, v: STRING, med: DOUBLE, lo: DOUBLE, hi: DOUBLE, n: BIGINT, n12: BIGINT, lastSale: STRING, trend: DOUBLE, conf: STRING"
CONTEXT_ROW = "k: STRING, v: STRING, kind: STRING, med: DOUBLE, lo: DOUBLE, hi: DOUBLE, n: BIGINT, n12: BIGINT, lastSale: STRING"
BOOK = f"schema INT, builtAt STRING, rows ARRAY<STRUCT<{BOOK_ROW}>>, gradeLadder STRUCT<base: DOUBLE, rungs: MAP<STRING, DOUBLE>>, context ARRAY<STRUCT<{CONTEXT_ROW}>>"
RECEIPTS = (
    "id STRING, itemId STRING, vertical STRING, key STRING, lane STRING, surfacedAt STRING, depthAtSurface DOUBLE, allInAtSurface DOUBLE, med DOUBLE, conf STRING, "
    "riskGrade STRING, outcome STRING, resolvedAt STRING, finalPrice DOUBLE"
)
HUNT_ENTRY = "hunt_id STRING, hunt_ord INT, label STRING, vertical STRING, key STRING, key_prefix STRING, q STRING, category_hint STRING, max_all_in DOUBLE, min_depth DOUBLE, title_must STRING, title_not STRING, note STRING, added STRING"
CONTEXT_STAMP = "STRUCT<k: STRING, kind: STRING, med: DOUBLE, lo: DOUBLE, hi: DOUBLE, n: BIGINT, lastSale: STRING>"
RISK = "STRUCT<grade: STRING, score: BIGINT, reasons: ARRAY<STRING>>"
DEAL = (
    "id: STRING, itemId: STRING, vertical: STRING, key: STRING, title: STRING, imageUrl: STRING, allIn: DOUBLE, itemPrice: DOUBLE, shipping: DOUBLE, med: DOUBLE, lo: DOUBLE, "
    f"hi: DOUBLE, n: BIGINT, n12: BIGINT, lastSale: STRING, trend: DOUBLE, conf: STRING, depth: DOUBLE, edgeUsd: DOUBLE, risk: {RISK}, rank: DOUBLE, listedAt: STRING, webUrl: STRING, "
    "evidenceUrl: STRING, surfacedAt: STRING, thin: BOOLEAN, basis: STRING, basisKey: STRING, tier: STRING, isNew: BOOLEAN"
)
NO_BOOK = f"huntId: STRING, huntLabel: STRING, noBook: BOOLEAN, id: STRING, itemId: STRING, vertical: STRING, title: STRING, allIn: DOUBLE, itemPrice: DOUBLE, shipping: DOUBLE, listedAt: STRING, surfacedAt: STRING, context: {CONTEXT_STAMP}"
CALL = (
    "id: STRING, itemId: STRING, vertical: STRING, key: STRING, title: STRING, currentBid: DOUBLE, bidCount: BIGINT, endsAt: STRING, shipping: DOUBLE, allInBid: DOUBLE, edgeUsd: DOUBLE, "
    f"med: DOUBLE, lo: DOUBLE, hi: DOUBLE, n: BIGINT, n12: BIGINT, lastSale: STRING, trend: DOUBLE, conf: STRING, bidVsBook: DOUBLE, risk: {RISK}, listedAt: STRING, surfacedAt: STRING"
)
BOARD = (
    f"schema INT, builtAt STRING, bookBuiltAt STRING, deals ARRAY<STRUCT<{DEAL}>>, perVertical MAP<STRING, STRUCT<polled: BIGINT, matched: BIGINT, surfaced: BIGINT>>, "
    f"hunt STRUCT<targets: ARRAY<STRUCT<id: STRING, label: STRING, vertical: STRING, note: STRING, added: STRING>>, deals: ARRAY<STRUCT<{NO_BOOK}>>>, "
    f"leads ARRAY<STRUCT<{NO_BOOK}>>, closing ARRAY<STRUCT<{CALL}>>, "
    "stats STRUCT<calls: MAP<STRING, BIGINT>, bySlice: MAP<STRING, MAP<STRING, BIGINT>>, gateReasons: MAP<STRING, MAP<STRING, BIGINT>>, identified: MAP<STRING, BIGINT>>"
)

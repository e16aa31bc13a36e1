"""Quality rules by compression bands.

zstandard shrinks a whole text and each of its fixed chunks (the last one ends where the text does and
may overlap the one before); compressed over raw size is the ratio. A text of a chunk or more has chunks. A
text is repetitive below and incompressible above the limits of its length's band; so is a chunk,
and a text goes when more than a share of its chunks do. Short texts compress worse, so their limits
are wider, and below the first band there are none.

Cases: a null text counts as one without words and fails the base rules, as does an empty one. Texts
are read whole, whatever their length. Repeated rows give repeated results, an empty table an empty
one. Only id and text are read, so other columns' names never clash.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: (bytes from, lowest ratio, highest ratio) for whole texts, by length.
BANDS = ((0, 0.0, 9.0), (64, 0.25, 1.2), (256, 0.2, 0.9), (1024, 0.16, 0.75), (8192, 0.12, 0.65))
#: Bytes in a chunk, its lowest and highest ratio, and the share of a text's chunks that may miss them.
CHUNK, CHUNK_LOW, CHUNK_HIGH, CHUNK_SHARE = 4096, 0.12, 0.72, 0.3
LEVEL = 3
SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50

_FIELDS = (("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("base_failed", pa.bool_()), ("ratio", pa.float64()), ("n_chunks", pa.int64()), ("n_low_chunks", pa.int64()), ("n_high_chunks", pa.int64()), ("verdict", pa.string()), ("kept", pa.bool_()))


def repeat_words(words: list[bytes]) -> int:
    """Words that lie in 3-word windows found twice or more."""
    if len(words) < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), dtype=np.int64, count=len(words))
    pair = np.unique(ids[:-1] * len(number) + ids[1:], return_inverse=True)[1]
    window = pair[:-1].astype(np.int64) * len(number) + ids[2:]
    _, inverse, count = np.unique(window, return_inverse=True, return_counts=True)
    again = count[inverse] > 1
    covered = np.zeros(len(words), dtype=bool)
    for k in range(3):
        covered[k : k + len(again)] |= again
    return int(covered.sum())


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = text.encode().split()
    lines = [x for x in text.split("\n") if x.strip(" \t\v\f\r")]
    blank = sum(map(text.count, " \t\n\v\f\r"))
    return len(words), len(text) - blank, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeat_words(words)


def band_verdict(data: bytes, shrink: zstandard.ZstdCompressor, bands: Sequence[tuple[int, float, float]], chunk: int) -> tuple[float, int, int, int, str]:
    """Ratio of the whole, numbers of chunks, too low and too high ones, and the verdict."""
    if not data:
        return 0.0, 0, 0, 0, "ok"
    ratio = len(shrink.compress(data)) / len(data)
    _, low, high = max(b for b in bands if b[0] <= len(data))
    starts = [*range(0, len(data) - chunk, chunk), len(data) - chunk] if len(data) >= chunk else []
    parts = [len(shrink.compress(data[i : i + chunk])) / chunk for i in starts]
    lows, highs = sum(r < CHUNK_LOW for r in parts), sum(r > CHUNK_HIGH for r in parts)
    if ratio < low:
        verdict = "repetitive"
    elif ratio > high:
        verdict = "incompressible"
    elif lows > CHUNK_SHARE * len(parts):
        verdict = "repetitive chunks"
    elif highs > CHUNK_SHARE * len(parts):
        verdict = "incompressible chunks"
    else:
        verdict = "ok"
    return ratio, len(parts), lows, highs, verdict


def compression_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bands: Sequence[tuple[int, float, float]] = BANDS, chunk: int = CHUNK) -> DataFrame:
    """One row per document: its id, the base counts, ratios and chunk counts, verdict and kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shrink = zstandard.ZstdCompressor(level=LEVEL)
        for batch in batches:
            rows = []
            for value in batch.column(1):
                text = value.as_py() or ""
                counts = base_counts(text)
                failed = counts[0] < MIN_WORDS or 100 * counts[4] > MAX_REPEAT_PERCENT * counts[0]
                bands_say = band_verdict(text.encode(), shrink, bands, chunk)
                rows.append((*counts, failed, *bands_say, not failed and bands_say[-1] == "ok"))
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(_FIELDS)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, type=t) for c, (_, t) in zip(columns, _FIELDS, strict=True))], ["_id", *(n for n, _ in _FIELDS)])

    kinds = {pa.int64(): "long", pa.bool_(): "boolean", pa.float64(): "double", pa.string(): "string"}
    schema = ", ".join([f"_id {docs.schema[id_col].dataType.simpleString()}", *(f"{n} {kinds[t]}" for n, t in _FIELDS)])
    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text")).mapInArrow(run, schema).withColumnRenamed("_id", id_col)

"""Language identification of whole and mixed texts.

A word is a run of letters. Its script (by code-point ranges) narrows the candidates to languages
that training saw in that script; each candidate scores the word by its letter pairs and triples.
Viterbi over the words, with a penalty for each switch, labels spans; the document's language is
the one whose spans hold most letters, its score their share.

Most texts keep one language throughout. Where no other language gains more than the penalty on any
run of words, the constant path is the best one and the steps are not run.

Cases: a null text, or one without letters, is `und` with score 0 and no spans. If no language was
learned, every text is `und`. Ties go to the language first in order. Repeated rows give repeated
results, an empty table an empty one. A very long text is labelled whole, by itself: a worker holds about
150 bytes for each of its letters. Only id and text are read, so other columns' names never clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyboard.llm.common import slices

#: First and last code point of the blocks of each script; other letters are script 0.
SCRIPTS = (
    ("latin", ((0x41, 0x24F), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xFF21, 0xFF5A))),
    ("greek", ((0x370, 0x3FF), (0x1F00, 0x1FFF))),
    ("cyrillic", ((0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F))),
    ("armenian", ((0x530, 0x58F),)),
    ("hebrew", ((0x590, 0x5FF), (0xFB1D, 0xFB4F))),
    ("arabic", ((0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF))),
    ("devanagari", ((0x900, 0x97F),)),
    ("bengali", ((0x980, 0x9FF),)),
    ("tamil", ((0xB80, 0xBFF),)),
    ("thai", ((0xE00, 0xE7F),)),
    ("georgian", ((0x10A0, 0x10FF), (0x1C90, 0x1CBF))),
    ("hangul", ((0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF))),
    ("kana", ((0x3040, 0x30FF), (0x31F0, 0x31FF), (0xFF66, 0xFF9D))),
    ("han", ((0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x323AF))),
)
#: Buckets of letter pairs and triples together.
BUCKETS = 1 << 16
#: Share of a language's letters that a script needs for the language to be a candidate there.
SCRIPT_SHARE = 0.01
#: Cost of a switch between two words, and the most that one word may speak against a language.
SWITCH, WORD_MOST = 8.0, 4.0
UNKNOWN = "und"
#: More different languages than this are refused: the model must stay small enough to send around.
MOST_LANGUAGES = 500


@lru_cache(maxsize=1)
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """By code point: its lower-case letter (0: no letter) and its script's number."""
    lower = np.zeros(0x110000, dtype=np.uint32)
    for c in range(0x110000):
        if (s := chr(c)).isalpha():
            lower[c] = ord(s.lower()) if len(s.lower()) == 1 else c
    script = np.zeros(0x110000, dtype=np.int8)
    for i, (_, ranges) in enumerate(SCRIPTS, 1):
        for a, b in ranges:
            script[a : b + 1] = i
    return lower, script


@dataclass
class Words:
    """The words of a few texts. Letters of all words stand in `letters`, a 0 before, between and after words."""

    letters: np.ndarray
    place: np.ndarray  # of each letter in letters
    first: np.ndarray  # of each word's letters, in place
    size: np.ndarray  # letters in each word
    text: np.ndarray  # number of each word's text
    begin: np.ndarray  # of each word in its text
    script: np.ndarray


def words_of(texts: list[str | None]) -> Words:
    lower, script = _letters()
    joined = "\n".join(t or "" for t in texts)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    start_of_text = np.concatenate([[0], np.cumsum([len(t or "") + 1 for t in texts])])
    low = lower[points]
    is_letter = low > 0
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]  # the character after a word is its boundary
    at = np.nonzero(keep)[0]
    letters = np.concatenate([[0], low[at], [0]]).astype(np.uint64)
    place = np.nonzero(letters)[0]
    new = letters[place - 1] == 0
    first = np.nonzero(new)[0]
    size = np.diff(np.append(first, len(place)))
    begin = at[place[first] - 1]
    text = np.searchsorted(start_of_text, begin, side="right") - 1
    return Words(letters, place, first, size, text, begin - start_of_text[text], script[points[begin]] if len(begin) else np.zeros(0, dtype=np.int8))


def _grams(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of the pair and of the triple around each letter; a 0 stands for a word's edge."""
    a, b, c = w.letters[w.place - 1], w.letters[w.place], w.letters[w.place + 1]
    k1, k2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
    pair = (b * k1) ^ ((c + np.uint64(1)) * k2)
    triple = (pair ^ (a + np.uint64(7))) * k1
    shift, half = np.uint64(64 - (BUCKETS.bit_length() - 2)), np.uint64(BUCKETS // 2)
    return ((pair * k2) >> shift).astype(np.int64), (((triple * k2) >> shift) + half).astype(np.int64)


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # bucket x language: log probability
    allowed: np.ndarray  # script x language


def learn(docs: DataFrame, lang: Column, text: Column) -> Model:
    """Count pairs, triples and scripts by language over all rows of docs with text and language.

    What the tasks return grows with languages x buckets, both bounded, and is added up by Spark.
    """
    rows = docs.select(lang.cast("string").alias("lang"), text.cast("string").alias("text")).filter("lang IS NOT NULL AND text IS NOT NULL")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in slices(texts):
                w = words_of(texts[a:b])
                if not len(w.first):
                    continue
                pair, triple = _grams(w)
                names = sorted({*langs[a:b]})
                of_text = np.array([names.index(x) for x in langs[a:b]])
                of_letter = np.repeat(of_text[w.text], w.size)
                script = np.repeat(w.script.astype(np.int64), w.size)
                width = BUCKETS + len(SCRIPTS) + 1
                for what in (pair, triple, BUCKETS + script):
                    got = np.bincount(of_letter * width + what, minlength=width * len(names)).reshape(len(names), width)
                    for i, name in enumerate(names):
                        sums[name] = sums[name] + got[i] if name in sums else got[i]
        for name, total in sums.items():
            at = np.nonzero(total)[0]
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), type=pa.string()), pa.array(at, type=pa.int64()), pa.array(total[at], type=pa.int64())], ["lang", "bucket", "n"])

    counted = rows.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    by_lang: dict[str, np.ndarray] = {}
    for row in counted.toLocalIterator():
        if row["lang"] not in by_lang:
            if len(by_lang) == MOST_LANGUAGES:
                raise ValueError(f"more than {MOST_LANGUAGES} languages")
            by_lang[row["lang"]] = np.zeros(BUCKETS + len(SCRIPTS) + 1)
        by_lang[row["lang"]][row["bucket"]] = row["n"]
    names = sorted(by_lang)
    if not names:
        return Model([], np.zeros((BUCKETS, 0), dtype=np.float32), np.zeros((len(SCRIPTS) + 1, 0), dtype=bool))
    table = np.stack([by_lang[n] for n in names])
    grams, scripts = table[:, :BUCKETS], table[:, BUCKETS:]
    used = max(1, int((grams.sum(axis=0) > 0).sum()))
    weights = np.log((grams + 0.5) / (grams.sum(axis=1, keepdims=True) + 0.5 * used))
    share = scripts / np.maximum(1, scripts.sum(axis=1, keepdims=True))
    return Model(names, np.ascontiguousarray(weights.T, dtype=np.float32), np.ascontiguousarray(share.T >= SCRIPT_SHARE))


def word_scores(w: Words, model: Model) -> np.ndarray:
    """word x language: log probability among the candidates of the word's script, at least -WORD_MOST."""
    pair, triple = _grams(w)
    score = np.add.reduceat(model.weights[pair] + model.weights[triple], w.first, axis=0).astype(np.float64) / 2
    allowed = model.allowed[w.script]
    none = ~allowed.any(axis=1)
    score[~allowed & ~none[:, None]] = -np.inf
    score -= score.max(axis=1, keepdims=True)
    score -= np.log(np.exp(score).sum(axis=1, keepdims=True))
    score[none] = -np.log(len(model.languages))
    return np.maximum(score, -WORD_MOST)


def best_path(score: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Language number of each word on the best path (the first among equal ones)."""
    whole = int(score.sum(axis=0).argmax())
    gain = score - score[:, whole : whole + 1]
    run = np.vstack([np.zeros((1, score.shape[1])), gain.cumsum(axis=0)])
    if (run - np.minimum.accumulate(run, axis=0)).max() <= switch:
        return np.full(len(score), whole)
    rows, k = score.tolist(), score.shape[1]
    total, came = rows[0][:], []
    for row in rows[1:]:
        top = max(total)
        best = total.index(top)
        change = top - switch
        back = [i if total[i] >= change else best for i in range(k)]
        total = [max(total[i], change) + row[i] for i in range(k)]
        came.append(back)
    path = [total.index(max(total))]
    for back in reversed(came):
        path.append(back[path[-1]])
    return np.array(path[::-1])


def label(texts: list[str | None], model: Model, switch: float = SWITCH) -> list[tuple[str, float, list[tuple[str, int, int]]]]:
    """(language, score, spans) of each text; a span is (language, first character, character after it)."""
    out: list = [(UNKNOWN, 0.0, [])] * len(texts)
    w = words_of(texts)
    if not len(w.first) or not model.languages:
        return out
    score = word_scores(w, model)
    edges = np.nonzero(np.diff(w.text))[0] + 1
    for a, b in zip([0, *edges], [*edges, len(w.text)], strict=True):
        path = best_path(score[a:b], switch)
        letters = np.bincount(path, weights=w.size[a:b], minlength=len(model.languages))
        turns = [0, *(np.nonzero(np.diff(path))[0] + 1), b - a]
        spans = [(model.languages[path[i]], int(w.begin[a + i]), int(w.begin[a + j - 1] + w.size[a + j - 1])) for i, j in zip(turns, turns[1:])]
        out[w.text[a]] = (model.languages[int(letters.argmax())], float(letters.max() / letters.sum()), spans)
    return out


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", switch: float = SWITCH) -> DataFrame:
    """One row per document: its id, lang_pred, score and spans array<struct<lang, begin, end>>."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    span = pa.list_(pa.struct([("lang", pa.string()), ("begin", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in slices(texts):
                found = label(texts[a:b], sent.value, switch)
                spans = [[{"lang": x, "begin": i, "end": j} for x, i, j in s] for _, _, s in found]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([f[0] for f in found], type=pa.string()), pa.array([f[1] for f in found], type=pa.float64()), pa.array(spans, type=span)], ["_id", "lang_pred", "score", "spans"])

    schema = f"_id {docs.schema[id_col].dataType.simpleString()}, lang_pred string, score double, spans array<struct<lang: string, begin: long, end: long>>"
    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text")).mapInArrow(run, schema).withColumnRenamed("_id", id_col)




def keep_identified(docs: DataFrame, model: Model, least: float, text_col: str = "text", switch: float = SWITCH) -> DataFrame:
    """The rows of docs, all columns as they were, whose text has a language with at least that score."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            for a, b in slices(texts):
                kept = [lang != UNKNOWN and score >= least for lang, score, _ in label(texts[a:b], sent.value, switch)]
                yield batch.slice(a, b - a).filter(pa.array(kept, type=pa.bool_()))

    return docs.mapInArrow(run, docs.schema)

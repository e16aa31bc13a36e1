"""Toxicity by classifier chains.

Categories are predicted in sequence: each has a logistic model over the same text features plus the
probabilities of all earlier categories. In training these come out of fold (each row's from models
that never saw it), so later models meet them as unsure as they will be in use.

A feature is a hashed word, or a hashed piece of 4, 6 or 8 letters of one (word edges count as
letters), weighed by 1 + log of its count, 3 at most. Training takes at most `most_rows` labelled
rows, those first by a hash of their id; for each category it keeps the pieces whose presence differs most between the classes
(chi-square), then fits. Every document is scored over its whole text.

Cases: a null or empty text has no features and gets the probabilities of such a text. Rows without
a label in a category don't train it; a category without both classes is predicted at its training
share. Repeated rows give repeated results, an empty table an empty one, no labels at all
probabilities of 0. A very long text is scored whole, by itself: a worker holds about 150 bytes for each of
its letters. Only named columns are read, so others' names never clash.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyboard.llm.common import discard, mix64, saved, slices
from tallyboard.llm.lang_id import words_of

BUCKETS = 1 << 20
PIECES = (4, 6, 8)
#: Most labelled rows to train on, features by category, folds, and the ridge of the models.
MOST_ROWS, FEATURES, FOLDS, RIDGE = 16_384, 256, 4, 1.0
THRESHOLD = 0.4
_STEP = np.uint64(0x9E3779B97F4A7C15)


def pieces_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, bucket) of every word and piece, repeats included."""
    w = words_of(texts)
    if not len(w.first):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    letters = mix64(w.letters + np.uint64(1))
    letters[w.letters == 0] = np.uint64(0x1234567)
    of_letter = np.repeat(w.text, w.size)
    end = w.place[w.first] + w.size
    text, bucket = [], []

    def put(owner: np.ndarray, code: np.ndarray) -> None:
        text.append(owner)
        bucket.append((mix64(code) >> np.uint64(44)).astype(np.int64))

    last = np.repeat(end, w.size)
    code, k = letters[w.place - 1].copy(), 1
    for n in PIECES:
        # pieces start at each letter's left neighbour and end at the word's right edge at most
        while k < n:
            code = code * _STEP + letters[np.minimum(w.place - 1 + k, len(letters) - 1)]
            k += 1
        fits = w.place - 1 + n - 1 <= last
        put(of_letter[fits], code[fits] + np.uint64(n))
    # a word is the sum of its letters times powers of the step by their place
    power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(int(w.size.max()), _STEP)]))
    inside = np.arange(len(w.place)) - np.repeat(w.first, w.size)
    word = np.add.reduceat(letters[w.place] * power[inside], w.first)
    put(w.text, word + np.uint64(1))
    return np.concatenate(text), np.concatenate(bucket)


@dataclass
class Chain:
    categories: list[str]
    column: np.ndarray  # bucket -> number of a feature, -1: none
    weights: list[np.ndarray]  # by category: intercept, features, earlier probabilities

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """row x category from row x feature."""
        out = np.zeros((len(x), len(self.weights)))
        for i, w in enumerate(self.weights):
            out[:, i] = _sigmoid(w[0] + np.hstack([x, out[:, :i]]) @ w[1:])
        return out

    def counts(self, texts: list[str | None]) -> np.ndarray:
        """row x feature: how often it occurs, 255 at most."""
        text, bucket = pieces_of(texts)
        at = self.column[bucket]
        has = at >= 0
        width = int(self.column.max()) + 1
        found, n = np.unique(text[has] * max(1, width) + at[has], return_counts=True)
        out = np.zeros((len(texts), width), dtype=np.uint8)
        out.reshape(-1)[found] = np.minimum(n, 255)
        return out


def weighed(counts: np.ndarray) -> np.ndarray:
    """Feature values of counts: 0, or 1 + log of the count, 3 at most."""
    table = np.concatenate([[0.0], np.minimum(1 + np.log(np.arange(1, 256)), 3.0)])
    return table[counts]


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = RIDGE, steps: int = 12) -> np.ndarray:
    """Intercept and weights of a ridge logistic model, by Newton steps."""
    share = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.0
    w = np.zeros(x.shape[1] + 1)
    w[0] = np.log(share / (1 - share)) if 0 < share < 1 else -35.0
    if not len(y) or y.min() == y.max():
        return w
    design = np.hstack([np.ones((len(x), 1)), x])
    penalty = np.full(len(w), ridge)
    penalty[0] = 1e-6
    for _ in range(steps):
        p = _sigmoid(design @ w)
        slope = design.T @ (p - y) + penalty * w
        bend = (design * (p * (1 - p))[:, None]).T @ design + np.diag(penalty)
        step = np.linalg.solve(bend, slope)
        w -= step
        if np.abs(step).max() < 1e-5:
            break
    return w


def fit_chain(x: np.ndarray, labels: np.ndarray, fold: np.ndarray, ridge: float = RIDGE) -> list[np.ndarray]:
    """Weights of each category in turn; labels: row x category, nan where unknown."""
    out, earlier = [], np.zeros((len(x), 0))
    for i in range(labels.shape[1]):
        design, y = np.hstack([x, earlier]), labels[:, i]
        known = ~np.isnan(y)
        out.append(fit_logistic(design[known], y[known], ridge))
        if i == labels.shape[1] - 1:
            break  # nothing reads the last category's
        unseen = np.zeros(len(x))
        for f in np.unique(fold):
            w = fit_logistic(design[known & (fold != f)], y[known & (fold != f)], ridge)
            unseen[fold == f] = _sigmoid(w[0] + design[fold == f] @ w[1:])
        earlier = np.hstack([earlier, unseen[:, None]])
    return out


def train(docs: DataFrame, labels: DataFrame, categories: Sequence[tuple[str, Column]], id_col: str = "doc_id", text_col: str = "text", most_rows: int = MOST_ROWS, features: int = FEATURES) -> Chain:
    """Chain over categories, (name, 0/1 column of labels) in order.

    labels has one row per id; of several, one counts. The sample is bounded by most_rows.
    """
    names = [name for name, _ in categories]
    order = F.md5(F.col(id_col).cast("string"))
    values = [F.max(c.cast("double")).alias(f"_y{i}") for i, (_, c) in enumerate(categories)]
    sample = labels.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(*values)
    sample = sample.orderBy(F.md5(F.col("_id").cast("string")), "_id").limit(most_rows)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"), order.alias("_order")).join(F.broadcast(sample), "_id")
    rows = saved(rows.dropDuplicates(["_id"]), "labelled")

    cells = [f"n{i}_{c}" for i in range(len(names)) for c in (0, 1)]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(names)
        sums = np.zeros((k, 2, BUCKETS), dtype=np.int32)
        for batch in batches:
            texts, y = batch.column(0).to_pylist(), [batch.column(1 + i).to_pylist() for i in range(k)]
            for a, b in slices(texts):
                text, bucket = pieces_of(texts[a:b])
                seen = np.unique(text * BUCKETS + bucket)
                text, bucket = seen // BUCKETS, seen % BUCKETS
                for i in range(k):
                    value = np.array([-1 if v is None else int(v > 0) for v in y[i][a:b]])[text]
                    for c in (0, 1):
                        sums[i, c] += np.bincount(bucket[value == c], minlength=BUCKETS).astype(np.int32)
        at = np.nonzero(sums.sum(axis=(0, 1)))[0]
        yield pa.RecordBatch.from_arrays([pa.array(at, type=pa.int64()), *(pa.array(sums[i, c, at], type=pa.int64()) for i in range(k) for c in (0, 1))], ["bucket", *cells])

    ys = [f"_y{i}" for i in range(len(names))]
    counts = rows.select("_text", *ys).mapInArrow(count, ", ".join(["bucket long", *(f"{c} long" for c in cells)])).groupBy("bucket").agg(*[F.sum(c).alias(c) for c in cells])
    counts = saved(counts.filter(" + ".join(cells) + " >= 5"), "pieces")
    whole = rows.agg(*[F.count(F.when(F.col(y) == c, 1)).alias(f"{y}_{c}") for y in ys for c in (0, 1)]).first()
    chosen: set[int] = set()
    for i, y in enumerate(ys):
        t0, t1 = whole[f"{y}_0"], whole[f"{y}_1"]
        if t0 and t1:
            gap = F.col(f"n{i}_1") * float(t0) - F.col(f"n{i}_0") * float(t1)
            both = F.col(f"n{i}_0") + F.col(f"n{i}_1")
            chi = gap * gap / (both * (float(t0 + t1) - both) + 1.0)
            best = counts.filter(both >= 5).orderBy(chi.desc(), "bucket").limit(features)
            chosen |= {r["bucket"] for r in best.collect()}
    column = np.full(BUCKETS, -1, dtype=np.int32)
    column[sorted(chosen)] = np.arange(len(chosen))
    chain = Chain(names, column, [])
    sent = docs.sparkSession.sparkContext.broadcast(chain)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in slices(texts):
                counts = [r.tobytes() for r in sent.value.counts(texts[a:b])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(counts, type=pa.binary()), *(batch.column(2 + i).slice(a, b - a) for i in range(len(ys)))], ["o", "counts", *ys])

    packed = rows.select("_order", "_text", *ys).mapInArrow(encode, ", ".join(["o string", "counts binary", *(f"{y} double" for y in ys)])).collect()
    packed.sort(key=lambda r: r["o"])
    n = len(chosen)
    x = weighed(np.array([np.frombuffer(r["counts"], dtype=np.uint8) for r in packed], dtype=np.uint8).reshape(len(packed), n))
    y = np.array([[np.nan if r[c] is None else float(r[c] > 0) for c in ys] for r in packed], dtype=np.float64).reshape(len(packed), len(ys))
    chain.weights = fit_chain(x, y, np.arange(len(packed)) % FOLDS)
    discard(rows, counts)
    return chain


def predict(docs: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id and p_<category> for each category of the chain."""
    sent = docs.sparkSession.sparkContext.broadcast(chain)
    names = [f"p_{c}" for c in chain.categories]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in slices(texts):
                p = sent.value.probabilities(weighed(sent.value.counts(texts[a:b])))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *(pa.array(p[:, i]) for i in range(len(names)))], ["_id", *names])

    schema = ", ".join([f"_id {docs.schema[id_col].dataType.simpleString()}", *(f"{n} double" for n in names)])
    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text")).mapInArrow(run, schema).withColumnRenamed("_id", id_col)

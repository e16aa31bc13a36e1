"""Compression bands and classifier chains against plain versions that share no code with them."""

import hashlib
import os
import random
from collections import Counter

import numpy as np
import oracle
import pytest
import zstandard
from pyspark.sql import functions as F

from tallyboard.llm import quality, toxicity

SPACE = " \t\n\v\f\r"


def plain_quality(text):
    """All columns but the id, by loops."""
    text = text or ""
    words, word = [], ""
    for c in text + " ":
        if c in SPACE:
            words += [word] if word else []
            word = ""
        else:
            word += c
    seen, again = set(), 0
    for line in text.split("\n"):
        if any(c not in SPACE for c in line):
            again += line in seen
            seen.add(line)
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {i + d for i, w in enumerate(zip(words, words[1:], words[2:])) if windows[w] > 1 for d in range(3)}
    out = {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(c in "#*$%&|<>" for c in text), "n_dup_lines": again, "n_repeat_words": len(covered)}
    out["base_failed"] = len(words) < 50 or 2 * len(covered) > len(words)
    data = text.encode()
    size = lambda b: len(zstandard.ZstdCompressor(level=3).compress(b))
    ratio = size(data) / len(data) if data else 0.0
    n = len(data)
    low, high = (0.12, 0.65) if n >= 8192 else (0.16, 0.75) if n >= 1024 else (0.2, 0.9) if n >= 256 else (0.25, 1.2) if n >= 64 else (0.0, 9.0)
    chunks, at = [], 0
    while n >= 4096 and at < n:
        begin = min(at, n - 4096)
        chunks.append(size(data[begin : begin + 4096]) / 4096)
        at += 4096
    lows, highs = len([c for c in chunks if c < 0.12]), len([c for c in chunks if c > 0.72])
    verdict = "ok"
    if data and ratio < low:
        verdict = "repetitive"
    elif data and ratio > high:
        verdict = "incompressible"
    elif lows > 0.3 * len(chunks):
        verdict = "repetitive chunks"
    elif highs > 0.3 * len(chunks):
        verdict = "incompressible chunks"
    return out | {"ratio": ratio, "n_chunks": len(chunks), "n_low_chunks": lows, "n_high_chunks": highs, "verdict": verdict, "kept": verdict == "ok" and not out["base_failed"]}


def check_quality(docs):
    got = quality.compression_rules(docs).collect()
    text = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    assert len(got) == len(text)
    for r in got:
        assert {k: v for k, v in r.asDict().items() if k != "doc_id"} == plain_quality(text[r["doc_id"]])
    return Counter(r["verdict"] for r in got)


def test_quality_of_odd_texts(spark):
    r = random.Random(21)
    noise = lambda n: "".join(chr(r.randrange(33, 127)) for _ in range(n))
    talk = lambda n: " ".join(r.choice(["sea", "wind", "harbour", "boat", "rope"]) + str(r.randrange(900)) for _ in range(n))
    texts = [None, "", " \n\t", "a", "a b " * 40, "né ü x\x1fy " * 90, noise(63), noise(64), noise(300), noise(4096), talk(700), talk(2000)[:8192], talk(2000)[:8193]]
    texts += [talk(1200)[:8192] + noise(4200), talk(1200)[:4096] + "z" * 8192, "ab" * 30_000, "\n".join(["line one", "line two", "line one ", "line one"] * 30)]
    found = check_quality(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert {"ok", "repetitive", "incompressible"} <= {*found}


@pytest.mark.skipif(not os.path.isdir(oracle.DATA), reason="no test tables")
def test_quality_of_all_documents(spark):
    check_quality(spark.read.parquet(f"{oracle.DATA}/documents.parquet"))


M, STEP = (1 << 64) - 1, 0x9E3779B97F4A7C15


def plain_mix(x):
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & M
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & M
    return x ^ (x >> 31)


def plain_pieces(text):
    """Counts of the buckets of a text's words and pieces."""
    out, word = Counter(), []
    for c in (text or "").lower() + " ":
        if c.isalpha():
            word.append(plain_mix(ord(c) + 1))
        elif word:
            edged = [0x1234567, *word, 0x1234567]
            for n in (4, 6, 8):
                for i in range(len(word)):
                    if i + n <= len(edged):
                        code = 0
                        for x in edged[i : i + n]:
                            code = (code * STEP + x) & M
                        out[plain_mix((code + n) & M) >> 44] += 1
            whole = sum(x * pow(STEP, i, 1 << 64) for i, x in enumerate(word)) & M
            out[plain_mix((whole + 1) & M) >> 44] += 1
            word = []
    return out


def plain_logistic(x, y):
    """Ridge 1 on all but the intercept, by reweighted least squares."""
    x = np.column_stack([np.ones(len(x)), x])
    ridge = np.diag([1e-6] + [1.0] * (x.shape[1] - 1))
    w = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-(x @ w)))
        v = np.maximum(p * (1 - p), 1e-12)
        w = np.linalg.solve(x.T @ (v[:, None] * x) + ridge, x.T @ (v * (x @ w) + y - p))
    return lambda rows: 1 / (1 + np.exp(-(np.column_stack([np.ones(len(rows)), rows]) @ w)))


def plain_chain(texts, labels, features):
    """Probabilities of both categories for every text, from labels (id -> pair of 0, 1 or None)."""
    pieces = {i: plain_pieces(t) for i, t in texts.items()}
    ids = sorted(labels, key=lambda i: hashlib.md5(str(i).encode()).hexdigest())
    chosen = set()
    for c in (0, 1):
        n = [Counter(), Counter()]
        total = [0, 0]
        for i in ids:
            if labels[i][c] is not None:
                n[labels[i][c]].update(pieces[i].keys())
                total[labels[i][c]] += 1
        scored = []
        for b in n[0].keys() | n[1].keys():
            both = n[0][b] + n[1][b]
            if both >= 5:
                gap = n[1][b] * float(total[0]) - n[0][b] * float(total[1])
                scored.append((-(gap * gap / (both * (float(sum(total)) - both) + 1.0)), b))
        chosen |= {b for _, b in sorted(scored)[:features]}
    columns = sorted(chosen)
    row = lambda i: [min(3.0, 1 + np.log(pieces[i][b])) if pieces[i][b] else 0.0 for b in columns]
    everyone = sorted(texts)
    x, every = np.array([row(i) for i in ids]), np.array([row(i) for i in everyone])
    fold = np.arange(len(ids)) % 4
    y0 = np.array([labels[i][0] for i in ids], dtype=float)
    unseen = np.zeros(len(ids))
    for f in range(4):
        unseen[fold == f] = plain_logistic(x[fold != f], y0[fold != f])(x[fold == f])
    known = np.array([labels[i][1] is not None for i in ids])
    y1 = np.array([labels[i][1] or 0 for i in ids], dtype=float)
    first = plain_logistic(x, y0)(every)
    second = plain_logistic(np.column_stack([x, unseen])[known], y1[known])(np.column_stack([every, first]))
    return dict(zip(everyone, zip(first, second)))


def test_toxicity_chain_equals_plain_version(spark):
    r = random.Random(31)
    stock = ["Sturm", "harbour", "élan", "boat", "ropes", "wind-swept", "a1b", "calmly"]
    texts, labels = {}, {}
    for i in range(160):
        poor, bad = int(r.random() < 0.4), int(r.random() < 0.3)
        words = [r.choice(stock) for _ in range(25)] + ["murkily"] * (poor * r.randrange(3)) + ["zurgle"] * (bad * r.randrange(3)) + ["zurgles"] * (poor * bad)
        r.shuffle(words)
        texts[i] = " ".join(words)
        if i < 130:
            labels[i] = (poor, None if i % 17 == 0 else bad)
    texts |= {160: None, 161: "", 162: "zurgle murkily " * 3000}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    table = spark.createDataFrame([(i, *v) for i, v in labels.items()], "doc_id long, poor int, toxic int")
    chain = toxicity.train(docs, table, [("poor", F.col("poor")), ("toxic", F.col("toxic"))], features=12)
    want = plain_chain(texts, labels, 12)
    got = toxicity.predict(docs, chain).collect()
    assert len(got) == len(texts)
    for row in got:
        assert (row["p_poor"], row["p_toxic"]) == pytest.approx(want[row["doc_id"]], abs=1e-5)

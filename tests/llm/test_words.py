"""Spelling variants, BPE by ranks and the source audit against brute force, on small fixtures."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from tallyboard.llm import divergence, fold_bpe, spelling

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
#: Columns that the operators do not read, some named like their own.
SCHEMA = "doc_id long, text string, lang string, source string, word string, n long, _tables int, key int"


def table(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1, 2, 3) for r in rows], SCHEMA).repartition(3)


# --- spelling variants ---------------------------------------------------------------------------
def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 7 and c >= 2}
    out = {}
    for w in n:
        others = [v for v in n if near(w, v)]
        best = min(others, key=lambda v: (-n[v], v), default=None)
        out[w] = (best if best is not None and n[best] >= 10 * n[w] else None, n[w], len(others))
    root = {}
    for w in n:
        last = w
        while out[last][0] is not None:
            last = out[last][0]
        root[w] = last
    return {w: (form, root[w], c, k, n.get(form)) for w, (form, c, k) in out.items()}


def spelled_rows(seed=1):
    r = random.Random(seed)
    stems = ["".join(r.choice("abcdeéÿ") for _ in range(r.randrange(6, 12))) for _ in range(12)]

    def word():
        w = r.choices(stems, weights=[2**-i for i in range(12)])[0]
        for _ in range(r.choices([0, 1, 2, 3], weights=[80, 14, 4, 2])[0]):
            i = r.randrange(len(w) + 1)
            w = r.choice([w[:i] + r.choice("abÉX") + w[i:], w[:i] + w[i + 1 :], w[:i] + r.choice("cdé") + w[i + 1 :]])
        return w

    rows = [(i, " ".join(word() for _ in range(r.randrange(1, 300))), "en", "s") for i in range(120)]
    return [*rows, rows[0], rows[0], (None, "Aaaaaaab Aaaaaaab aaaaaaaab", None, None), (7, None, None, None), (8, "", "", ""), (9, "x" * 5000 + " " + "x" * 5000 + " " + "x" * 4999 + "y", "a", "b")] + [(9, "x" * 5000, "a", "b")] * 3


@pytest.mark.parametrize("group", [spelling.GROUP, 3])
def test_variants(spark, group):
    rows = spelled_rows()
    found = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in spelling.variants(table(spark, rows), group=group).collect()}
    expected = brute_variants([r[:2] for r in rows])
    assert found == expected
    assert any(v[1] != v[0] and v[0] for v in expected.values())


def test_variants_of_nothing(spark):
    assert spelling.variants(table(spark, []).limit(0)).collect() == []
    assert spelling.variants(table(spark, [(1, "short words", None, None)])).collect() == []


def test_automaton_numbers_words():
    r = random.Random(5)
    words = sorted({bytes(r.choice(b"ab\xff") for _ in range(6)) for _ in range(300)})
    automaton = spelling.Automaton(spelling._matrix(np.array(words, dtype=bytes), 6))
    for i, w in enumerate(words):
        state, number = np.zeros(1, dtype=np.int64), 0
        for d, c in enumerate(w):
            on, state, passed = automaton.step(d, state, np.array([c]))
            assert len(on) == 1
            number += int(passed[0])
        assert number == i
    # minimal: no two states of a place lead on to the same words
    rest = {6: {0: frozenset([b""])}}
    for d in range(5, -1, -1):
        first, keys, target, _ = automaton.layers[d]
        rest[d] = {s: frozenset(bytes([keys[k] & 255]) + t for k in range(first[s], first[s + 1]) for t in rest[d + 1][int(target[k])]) for s in range(len(first) - 1)}
        assert len(set(rest[d].values())) == len(rest[d])
    assert rest[0][0] == frozenset(words)


# --- BPE by ranks --------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(VOCABULARY, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    r = random.Random(2)
    odd = [None, "", " ", "\n\n  \t x", "don't we'll 'S", "a" * 700, "=" * 300, "漢字かな交じり文" * 20, "naïve café – “quote”… 🙂🙃", "  x　", "<|endoftext|>", "12345678 ½ ²", "x" * 60 + "é" * 60, "\x1c \x85 ​", "<=258><74>"]
    mixed = ["".join(r.choice("ab éß\n漢🙂1'.,-") for _ in range(r.randrange(400))) for _ in range(60)]
    prose = [" ".join(r.choice(["the", "quick", "naïve", "Unbelievably", "straße", "2024", "anticonstitutionnellement"]) for _ in range(200)) for _ in range(20)]
    return [*odd, *mixed, *prose, prose[0], " ".join(prose) * 8]


@pytest.mark.parametrize("most", [0, 40, fold_bpe.DISTINCT])
def test_rank_bpe_is_the_library(spark, library, most):
    rows = [(i, t, None, None) for i, t in enumerate(texts())]
    out = fold_bpe.encode_decode(table(spark, rows), VOCABULARY, public_tokenizers.PATTERN, outputs=("n_tokens", "ids", "decoded", "ids_sha256", "decoded_sha256"), most=most)
    found = {r["doc_id"]: r for r in out.collect()}
    assert len(found) == len(rows)
    for i, t, *_ in rows:
        ids, got = library.encode_ordinary(t or ""), found[i]
        assert got["ids"] == ids and got["n_tokens"] == len(ids), t
        assert bytes(got["decoded"]) == (t or "").encode()
        assert got["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()


def test_rank_bpe_of_nothing_and_decode(spark, library):
    assert fold_bpe.encode_decode(table(spark, []).limit(0), VOCABULARY, public_tokenizers.PATTERN).collect() == []
    ids = library.encode_ordinary("Zwölf Boxkämpfer 🙂")
    rows = spark.createDataFrame([(1, ids), (2, []), (3, None), (4, [ids[3], 130])], "doc_id long, ids array<int>")
    found = {r["doc_id"]: r["decoded"] for r in fold_bpe.decode(rows, VOCABULARY).collect()}
    assert bytes(found[1]).decode() == "Zwölf Boxkämpfer 🙂" and bytes(found[2]) == b"" and found[3] is None
    assert bytes(found[4]) == library.decode_bytes([ids[3], 130])


def test_ranks_out_of_order_are_refused(tmp_path):
    lines = [(bytes([b]), b) for b in range(256)]
    path = tmp_path / "v.tiktoken"
    path.write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % i for t, i in [*lines, (b"abc", 256), (b"ab", 257)]))
    with pytest.raises(ValueError, match="not reached"):
        fold_bpe.read_ranks(str(path))
    path.write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % i for t, i in lines[1:]))
    with pytest.raises(ValueError, match="every byte"):
        fold_bpe.read_ranks(str(path))


# --- source audit --------------------------------------------------------------------------------
def brute_audit(rows, least, most):
    docs_of, count, groups = defaultdict(set), Counter(), set()
    for i, (_, text, lang, source) in enumerate(rows):
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or ""):
            t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
            docs_of[lang, t].add(i)
            count[lang, source, t] += 1
    out = []
    for lang in {g for g, _ in groups}:
        kept = [t for (g, t), d in docs_of.items() if g == lang and len(d) >= least]
        sources = sorted(s for g, s in groups if g == lang)
        sizes = {s: sum(count[lang, s, t] for t in kept) for s in sources}
        whole = sum(sizes.values())

        def share(c, n, kept=kept):
            return 1 + 10**9 * (c + 5) // (n + 5 * len(kept))

        p = {s: {t: share(count[lang, s, t], sizes[s]) for t in kept} for s in sources}
        q = {t: share(sum(count[lang, s, t] for s in sources), whole) for t in kept}
        for s in sources:
            pairs = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(p[s][t] - q[t], t) for t in kept if count[lang, s, t] and p[s][t] > q[t]]
            for part, found, limit in (("pair", pairs, None), ("term", terms, most)):
                for rank, (value, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode()))[:limit], 1):
                    out.append((lang, s, part, item, value, rank))
    return sorted(out)


def audit_rows():
    r = random.Random(4)
    words = ["Alpha", "beta", "γάμμα", "delta", "épsilon", "zeta", "x", "Ωmega", "漢字", "eta"]
    rows = [(i, " ".join(r.choices(words, weights=[3 if (i + k) % 4 else 1 for k in range(10)], k=r.randrange(60))) + f" only{i} 12 _", r.choice(["en", "de", None]), r.choice(["a", "b", "Ö", "z", None])) for i in range(150)]
    return [*rows, rows[3], rows[3], (None, None, "fr", "a"), (5, "", "fr", "b"), (6, "12 34", "fr", None), (1, "rare words", "es", "only"), (2, "beta " * 3000, "en", "a")]


@pytest.mark.parametrize("least,most,block", [(10, 3, divergence.BLOCK), (2, 50, 2), (1, 4, 1)])
def test_audit(spark, least, most, block):
    rows = audit_rows()
    out = divergence.audit(table(spark, rows), least=least, most=most, block=block)
    assert [(f.name, f.dataType.simpleString()) for f in out.schema] == [("lang", "string"), ("source", "string"), ("part", "string"), ("item", "string"), ("value", "bigint"), ("rank", "int")]
    assert sorted(map(tuple, out.collect())) == brute_audit(rows, least, most)


def test_audit_of_nothing(spark):
    assert divergence.audit(table(spark, []).limit(0)).collect() == []


def test_shares_are_exact(spark):
    counts, below = np.array([0, 1, 10**15 - 6, 10**15 - 6], dtype=np.int64), np.array([5, 11, 10**15, 10**15 + 1], dtype=np.int64)
    expected = [1 + 10**9 * (int(c) + 5) // int(b) for c, b in zip(counts, below, strict=True)]
    assert divergence._shares(counts, below).tolist() == expected
    rows = spark.createDataFrame([(int(c), int(b) - 5) for c, b in zip(counts, below, strict=True)], "c long, n long")
    assert [r[0] for r in rows.select(divergence.share(F.col("c"), F.col("n"), F.lit(1).cast("long"))).collect()] == expected

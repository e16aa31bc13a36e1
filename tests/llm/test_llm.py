"""Operators against brute force, exact round trips and held-out accuracy, on small fixtures."""

import datetime
import hashlib
import hmac
import os
import random
import re
import string
import textwrap

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tallyboard.llm import bpe, exact_dedup, lang_id, licenses, mixing, ngram_join, pii, quality, toxicity, url_filter

SCHEMA = "doc_id long, text string, lang string, source string, fp string, kept boolean, _id int"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(40)) for _ in range(n))


def edited(text: str, seed: int, changes: int) -> str:
    words, r = text.split(), random.Random(seed)
    for _ in range(changes):
        words[r.randrange(len(words))] = f"edit{r.randrange(10**6)}"
    return " ".join(words)


@pytest.fixture(scope="module")
def rows():
    base = [prose(i, 30 + 17 * i % 400) for i in range(40)]
    texts = [*base, *base[:6], *(edited(base[i % 8], i, 1 + i % 9) for i in range(60)), None, "", "   \n", "one two", "One  TWO", "a b c d", "x " * 3000, prose(99, 9000), edited(prose(99, 9000), 5, 40)]
    return [(i, t, "en", f"s{i % 3}" if i % 7 else None, "clash", True, 1) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def brute_components(rows, percent=80, n=5):
    sets = {}
    for row in rows:
        words = [w.decode() for w in re.sub(rb"[A-Z]", lambda m: m[0].lower(), (row[1] or "").encode()).split()]
        sets[row[0]] = {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else ({tuple(words)} if words else set())
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            s, t = sets[a], sets[b]
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


# --- n-gram join --------------------------------------------------------------------------------
@pytest.mark.parametrize("block", [20_000, 3])
def test_join_matches_brute_force(docs, rows, block):
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.near_duplicates(docs, block=block).collect()}
    assert found == brute_components(rows)


def test_join_other_threshold_and_size(docs, rows):
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.near_duplicates(docs, n=3, percent=60).collect()}
    assert found == brute_components(rows, 60, 3)


def test_join_dense_group_of_near_copies(spark):
    base = prose(7, 120)
    rows = [(i, edited(base, i, 1 + i % 6)) for i in range(150)]
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == brute_components(rows)


def test_join_large_dense_group_is_dealt_and_costs_few_verifications(spark, monkeypatch):
    """2,000 near copies of one text in a meeting of many blocks: exact components, about a link a document."""
    base, counts = prose(8, 300), []
    rows = [(i, edited(base, i, 1 + i % 3)) for i in range(2000)] + [(5000 + i, prose(9000 + i, 80)) for i in range(50)]
    verified = ngram_join._verified

    def counted(pairs, *rest):
        out = verified(pairs, *rest)
        counts.append(out.count())
        return out

    monkeypatch.setattr(ngram_join, "_verified", counted)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = {r["doc_id"]: r["component_id"] for r in ngram_join.near_duplicates(df, block=128).collect()}
    assert {found[i] for i in range(2000)} == {0} and all(found[5000 + i] == 5000 + i for i in range(50))
    assert sum(counts) < 10 * len(rows)


def test_join_tells_sets_with_one_fingerprint_apart(docs, rows, monkeypatch):
    whole = ngram_join.fingerprint
    monkeypatch.setattr(ngram_join, "fingerprint", lambda s: (whole(s)[0] % 5 << 40, whole(s)[1]))
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.near_duplicates(docs).collect()}
    assert found == brute_components(rows)


def test_join_empty_nulls_and_repeated_rows(spark, nothing):
    assert ngram_join.near_duplicates(nothing).count() == 0
    df = spark.createDataFrame([(3, "a b c d e f"), (3, "a b c d e f"), (None, "a b c d e f"), (None, None), (5, "")], "doc_id int, text string")
    got = sorted(map(tuple, ngram_join.near_duplicates(df).collect()), key=str)
    assert got == sorted([(3, 2, 3, 3), (3, 2, 3, 3), (None, 2, 3, 3), (None, 0, None, 1), (5, 0, 5, 1)], key=str)


def test_drop_near_duplicates_decides_by_row(spark):
    base = [prose(i, 60) for i in range(8)]
    near = [edited(t, 50 + i, 2) for i, t in enumerate(base)]
    rows = [(1, base[0]), (2, near[0]), (2, base[1]), (2, base[2]), (None, near[1]), (None, base[3]), (None, near[3]), (None, base[4]), (5, base[5]), (5, near[5]), (6, base[6]), (6, base[6]), (None, base[7]), (None, base[7]), (None, None), (None, ""), (7, ""), (7, "")]
    df = spark.createDataFrame([(i, t, n) for n, (i, t) in enumerate(rows)], "doc_id long, text string, n int").repartition(3)
    out = ngram_join.drop_near_duplicates(df)
    assert out.columns == df.columns
    comp = brute_components([(n, t) for n, (_, t) in enumerate(rows)])
    groups = {}
    for n, (i, t) in enumerate(rows):
        groups.setdefault(comp[n][1], []).append((i is None, i or 0, hashlib.sha256((t or "").encode()).hexdigest(), t))
    want = [min(g, key=lambda x: x[:3]) for g in groups.values()]
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "") for r in out.collect()) == sorted((none, i, t or "") for none, i, _, t in want)


def test_join_goes_on_after_a_round_without_pairs(docs, rows, monkeypatch):
    search = ngram_join._search

    def first_finds_nothing(members, percent, most):
        found = search(members, percent, most)
        return found if most else members.select(F.lit(None).cast("long").alias("a"), F.lit(None).cast("long").alias("b"), "meeting").distinct()

    monkeypatch.setattr(ngram_join, "_search", first_finds_nothing)
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.near_duplicates(docs).collect()}
    assert found == brute_components(rows)


def test_search_compares_all_sizes_the_threshold_allows():
    r = np.random.default_rng(3)
    s = np.unique(r.integers(0, 2**63, 4400, dtype=np.uint64))
    sets = [s, s[:1150]]
    units, points = zip(*map(ngram_join.point, sets))
    assert len(points[0]) == 4 * len(points[1])
    q, t, _ = ngram_join.search_cell(list(points), np.array(units), np.array([len(x) for x in sets]), np.arange(2), 25, 0)
    assert {*q.tolist(), *t.tolist()} == {0, 1}


def test_bounds_never_lose_a_pair():
    r = np.random.default_rng(1)
    for n in (3, 200, 5000):
        s = np.unique(r.integers(0, 2**63, n, dtype=np.uint64))
        t = np.unique(np.concatenate([s[: n // 2], r.integers(0, 2**63, 3 * n, dtype=np.uint64)]))
        (u, a), (v, b) = ngram_join.point(s), ngram_join.point(t)
        g = min(len(a), len(b))
        assert np.minimum(ngram_join.folded(a, u, g), ngram_join.folded(b, v, g)).sum() >= len(np.intersect1d(s, t))


def test_tree_finds_the_pairs_of_the_full_scan():
    r = np.random.default_rng(2)
    center = r.poisson(4, (12, 128))
    points = np.concatenate([center + r.integers(0, 2, center.shape) for _ in range(40)]).astype(np.int32)
    sizes, component = points.sum(axis=1), np.arange(len(points)) % 200
    own = np.ones(len(points), dtype=bool)
    tree = ngram_join.CountTree(points, sizes, component, own, 80)
    pairs = {frozenset((a, b)) for a, b in zip(*(x.tolist() for x in tree.pairs()[:2]))}
    full = {frozenset((a, b)) for a, b in zip(*(x.tolist() for x in tree.passing(*np.tril_indices(len(points), -1))[:2]))}
    assert pairs == full and full


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100 + i, 200) for i in range(9)] + [(7, 7)]
    got = dict(map(tuple, ngram_join.components(spark.createDataFrame(edges, "a long, b long").repartition(7)).collect()))
    assert {got[i] for i in range(61)} == {0} and {got[100 + i] for i in range(9)} == {100} == {got[200]}


# --- exact dedup --------------------------------------------------------------------------------
@pytest.mark.parametrize(("capacity", "bits"), [(50_000, 64), (4, 64), (4, 3)])
def test_exact_dedup(docs, rows, capacity, bits):
    norm = {i: re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for i, t, *_ in rows}
    groups = {}
    for i, t in norm.items():
        groups.setdefault(t, []).append(i)
    got = exact_dedup.find_copies(docs, capacity=capacity, address_bits=bits).collect()
    assert len(got) == len(rows)
    for r in got:
        own = groups[norm[r["doc_id"]]]
        assert (r["keep_id"], r["group_size"], r["kept"]) == (min(own), len(own), r["doc_id"] == min(own))
        assert r["text_sha256"] == hashlib.sha256(norm[r["doc_id"]].encode()).hexdigest()
    if bits == 3:
        assert max(r["chain"] for r in got) > 0


def test_directory_splits_overfull_buckets(spark):
    entries = spark.range(3000).select(F.xxhash64("id").alias("address"))
    cells, depth = exact_dedup.directory(entries, capacity=100)
    assert depth > 3
    cell = F.shiftrightunsigned("address", 64 - depth).alias("cell")
    per = entries.select(cell).join(cells, "cell").groupBy("bucket", "depth").count()
    assert per.agg(F.max("count")).first()[0] <= 100 and per.agg(F.sum("count")).first()[0] == 3000
    # a bucket has split only because its parent was overfull
    parents = per.groupBy(F.expr(f"bucket - pmod(bucket, shiftleft(1L, {depth} - depth + 1))").alias("parent"), "depth").agg(F.sum("count").alias("n"), F.count("*").alias("halves"))
    assert parents.filter("halves = 2 AND n <= 100").isEmpty()


def test_hot_text_is_spread_over_pages(spark):
    """A third of all rows hold one text, addresses collide, and ids repeat: pages are merged by bytes."""
    texts = ["hot  text" if i % 3 == 0 else f"text {i % 150}" for i in range(900)]
    df = spark.createDataFrame([(i if i % 50 else None, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, pages string").repartition(5)
    cells, _ = exact_dedup.directory(df.select(exact_dedup._address(F.col("text"), 4).alias("address")), capacity=4)
    assert cells.agg(F.max("pages")).first()[0] > 10
    got = exact_dedup.find_copies(df, capacity=4, address_bits=4).collect()
    want = {}
    for i, t in enumerate(texts):
        want.setdefault(hashlib.sha256(t.replace("  ", " ").encode()).hexdigest(), []).append(i)
    assert len(got) == 900 and sum(r["kept"] for r in got) == len(want) and len({(r["bucket"], r["chain"]) for r in got}) >= len({r["chain"] for r in got}) > 3
    for r in got:
        own = want[r["text_sha256"]]
        assert r["group_size"] == len(own) and r["keep_id"] == min((i for i in own if i % 50), default=None)
        assert r["kept"] == (r["doc_id"] is not None and r["doc_id"] == r["keep_id"]) or r["keep_id"] is None
    left = exact_dedup.drop_copies(df, capacity=4, address_bits=4)
    assert left.columns == df.columns and sorted(str(r["doc_id"]) for r in left.collect()) == sorted(str(r["doc_id"]) for r in got if r["kept"])


def test_exact_dedup_ties_nulls_and_columns(spark, docs, nothing):
    assert exact_dedup.find_copies(nothing).count() == 0 and exact_dedup.drop_copies(nothing).count() == 0
    df = spark.createDataFrame([(2, "a  b", "x"), (2, "a b", "y"), (None, "a\tb", "z"), (None, "q", "z"), (None, "q", "z")], "doc_id int, text string, kept string")
    assert sorted((r["doc_id"], r["kept"]) for r in exact_dedup.find_copies(df).collect() if r["doc_id"]) == [(2, False), (2, True)]
    left = exact_dedup.drop_copies(df)
    assert left.columns == df.columns and sorted(str(r["doc_id"]) for r in left.collect()) == ["2", "None"]
    assert exact_dedup.drop_copies(docs).columns == docs.columns


# --- mixing -------------------------------------------------------------------------------------
def test_mix_targets_and_limits(docs, rows):
    got = mixing.mix(docs, block=5).collect()
    sizes = {i: len((t or "").split()) for i, t, *_ in rows}
    assert {r["doc_id"]: r["size"] for r in got} == sizes
    total = sum(sizes.values())
    by = {}
    for r in got:
        by.setdefault(r["source"], []).append(r)
        assert r["taken"] in (0, r["size"], 2 * r["size"]) and len(r["times"]) == r["repeats"]
        assert all(0 <= t <= 1 for t in r["times"]) and r["times"] == sorted(r["times"])
    assert abs(sum(v[0]["target"] for v in by.values()) - 1.5 * total) < 1e-6 * total
    for v in by.values():
        assert v[0]["target"] <= 2 * v[0]["source_size"] + 1e-9
        assert abs(sum(r["taken"] for r in v) - v[0]["target"]) <= max(r["size"] for r in v)


def test_mix_is_the_same_for_any_blocks(docs):
    one, two = (sorted(map(str, mixing.mix(docs, block=b).collect())) for b in (2, 10_000))
    assert one == two


def test_water_filling(spark):
    df = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 1000), (None, 5)], "source string, size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(df).collect()}
    # weights 3, 1, 2, 3; a and the null source are capped at twice their size
    left = 1.5 * 2015 - 20 - 10
    assert got["a"] == 20 and got[None] == 10 and abs(got["b"] - left / 3) < 1e-6 and abs(got["c"] - 2 * left / 3) < 1e-6


def test_time_inverts_the_integral(spark):
    for knots in mixing.SCHEDULES:
        grid = np.linspace(0, 1, 20001)
        weight = np.interp(grid, [k[0] for k in knots], [k[1] for k in knots])
        done = np.concatenate([[0], np.cumsum((weight[1:] + weight[:-1]) / 2 * np.diff(grid))])
        parts = [0.0, 0.1, 0.37, 0.5, 0.9, 1.0]
        df = spark.createDataFrame([(p,) for p in parts], "p double").select(mixing.time_at(F.col("p"), knots).alias("t"))
        assert np.allclose([r["t"] for r in df.collect()], np.interp(np.array(parts) * done[-1], done, grid), atol=1e-3)


def test_curriculum_repeats_and_orders(docs, nothing):
    taken = {r["doc_id"]: r["repeats"] for r in mixing.mix(docs).collect()}
    out = mixing.curriculum(docs)
    assert out.columns == docs.columns
    seen = {}
    for r in out.collect():
        seen[r["doc_id"]] = seen.get(r["doc_id"], 0) + 1
    assert seen == {k: v for k, v in taken.items() if v}
    assert mixing.mix(nothing).count() == 0 and mixing.curriculum(nothing).count() == 0


def test_mix_repeated_and_null_ids(spark):
    df = spark.createDataFrame([(1, "a b c", "s"), (1, "a b c", "s"), (None, "d e", None), (4, None, "s")], "doc_id long, text string, source string")
    assert mixing.mix(df).count() == 4
    mixing.curriculum(df).collect()


def test_curriculum_gives_each_row_its_own_times(spark):
    rows = [(i % 3 if i % 5 else None, prose(i, 20 + i), f"s{i % 2}", i) for i in range(40)]
    rows += [(*rows[7][:3], 40), (*rows[7][:3], 41), (rows[7][0], rows[7][1], "s9", 42)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n int").repartition(3)
    out = mixing.curriculum(df)
    assert out.columns == df.columns

    def counts(rows):
        seen = {}
        for i, source, digest, n in rows:
            seen.setdefault((i, source, digest), []).append(n)
        return {k: sum(v) for k, v in seen.items() if sum(v)}

    want = counts((r["doc_id"], r["source"], r["digest"], r["repeats"]) for r in mixing.mix(df).collect())
    assert counts((r["doc_id"], r["source"], hashlib.sha256(r["text"].encode()).hexdigest(), 1) for r in out.collect()) == want


# --- language -----------------------------------------------------------------------------------
def corpus(n=300):
    r = random.Random(4)
    parts = {"aa": "ba ko ri tu mena solo".split(), "bb": "sch ung ich ver keit zen".split(), "cc": "дом река лес поле".split()}
    out = []
    for i in range(n):
        lang = ("aa", "bb", "cc")[i % 3]
        out.append((i, " ".join("".join(r.choices(parts[lang], k=2)) for _ in range(40)), lang))
    return out


@pytest.fixture(scope="module")
def model(spark):
    df = spark.createDataFrame(corpus(), "doc_id long, text string, lang string")
    return lang_id.learn(df.filter("doc_id % 4 != 2"), F.col("lang"), F.col("text"))


def test_language_accuracy_and_spans(spark, model):
    held = [r for r in corpus() if r[0] % 4 == 2]
    got = {r["doc_id"]: r for r in lang_id.identify(spark.createDataFrame(held, "doc_id long, text string, lang string"), model).collect()}
    assert sum(got[i]["lang_pred"] == lang for i, _, lang in held) >= 0.98 * len(held)
    mixed = held[0][1] + ". " + held[1][1] + " 123 " + held[2][1]
    spans = lang_id.label([mixed], model)[0][2]
    assert [s[0] for s in spans] == [held[0][2], held[1][2], held[2][2]]
    assert mixed[spans[1][1] : spans[1][2]].split() == held[1][1].split()


def test_best_path_is_viterbi(model):
    r = np.random.default_rng(3)
    for _ in range(60):
        score = -r.exponential(2, (r.integers(1, 7), 3))
        best = max(((sum(score[i, p] for i, p in enumerate(path)) - 2.0 * sum(a != b for a, b in zip(path, path[1:]))) for path in np.ndindex(*[3] * len(score))))
        path = lang_id.best_path(score, 2.0)
        got = score[np.arange(len(score)), path].sum() - 2.0 * (np.diff(path) != 0).sum()
        assert abs(got - best) < 1e-9


def test_language_edge_cases(spark, docs, nothing, model):
    got = [x[:2] for x in lang_id.label([None, "", "12 34 !", "漢字", "дом " * 3, "x" * 200_000], model)]
    assert got[:3] == [("und", 0.0)] * 3 and got[3][0] in model.languages and got[4][0] == "cc"
    assert lang_id.identify(nothing, model).count() == 0
    empty = lang_id.learn(nothing, F.col("lang"), F.col("text"))
    assert lang_id.label(["abc"], empty) == [("und", 0.0, [])]
    kept = lang_id.keep_identified(docs, model, 0.5)
    assert kept.columns == docs.columns and kept.filter("text IS NULL OR text = ''").count() == 0


# --- bpe ----------------------------------------------------------------------------------------
def test_bpe_matches_the_library(docs, rows, nothing):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    got = {r["doc_id"]: r for r in bpe.encode_decode(docs, path, outputs=("n_tokens", "ids", "decoded", "ids_sha256", "decoded_sha256")).collect()}
    for i, t, *_ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        r = got[i]
        assert r["ids"] == ids and r["n_tokens"] == len(ids) and r["decoded"] == (t or "")
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
    assert bpe.encode_decode(nothing, path).count() == 0


def test_bpe_odd_texts():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library, own = Tokenizer.from_file(path), bpe.ByteBpe(open(path, encoding="utf-8").read())
    r = random.Random(6)
    odd = ["<|endoftext|>x<|endoftext|>", " " * 700, "a" * 3000, "ab" * 2000, "👩‍👩‍👧 é́​\x85\xa0", "I'LL we'll\t\r\n  x"]
    odd += ["".join(chr(r.choice([r.randrange(32, 127), r.randrange(160, 0xD7FF), 10, 32])) for _ in range(r.randrange(1, 80))) for _ in range(300)]
    for text, ids in zip(odd, own.encode(odd)):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids and own.decode(ids) == text
    assert own.decode(np.array([own.of_byte[0xFF]])) == "�"


# --- quality ------------------------------------------------------------------------------------
def test_quality_counts(docs, rows, nothing):
    got = {r["doc_id"]: r for r in quality.compression_rules(docs).collect()}
    for i, t, *_ in rows:
        words = (t or "").encode().split()
        windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
        many = {w for w in set(windows) if windows.count(w) > 1} if len(words) < 1000 else None
        r = got[i]
        assert r["n_words"] == len(words) and r["word_chars"] == sum(len(w.decode()) for w in words)
        if many is not None:
            assert r["n_repeat_words"] == len({k + d for k, w in enumerate(windows) if w in many for d in range(3)})
        assert r["base_failed"] == (len(words) < 50 or 100 * r["n_repeat_words"] > 50 * len(words))
        assert not (r["base_failed"] and r["kept"])
    assert quality.compression_rules(nothing).count() == 0


def test_quality_bands(spark):
    r = random.Random(8)
    noise = " ".join("".join(chr(r.randrange(33, 127)) for _ in range(9)) for _ in range(3000))
    lines = "a b\na b\n\n \nc#|$\na b "
    texts = [prose(1, 900), "the same words again " * 500, noise, lines, prose(2, 900) + " " + "x y z " * 8000]
    got = {r["doc_id"]: r for r in quality.compression_rules(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got[0]["kept"] and got[1]["verdict"] == "repetitive" and got[2]["verdict"] == "incompressible" and not got[4]["kept"]
    assert (got[3]["n_dup_lines"], got[3]["n_symbols"]) == (1, 3)


def test_quality_checks_chunks_up_to_the_end(spark):
    r = random.Random(11)
    noise = "".join(chr(r.randrange(33, 127)) for _ in range(4000))
    text, short = prose(3, 900)[:8192] + noise, prose(4, 600)[:4500]
    got = {r["doc_id"]: r for r in quality.compression_rules(spark.createDataFrame([(0, text), (1, short)], "doc_id long, text string")).collect()}
    assert len(text) < 3 * quality.CHUNK and (got[0]["n_chunks"], got[0]["n_high_chunks"], got[0]["verdict"]) == (3, 1, "incompressible chunks")
    assert (got[1]["n_chunks"], got[1]["verdict"]) == (2, "ok")


# --- toxicity -----------------------------------------------------------------------------------
def test_toxicity_learns_from_labels(spark, nothing):
    r = random.Random(9)
    rows, labels = [], []
    for i in range(400):
        words = [r.choice(WORDS) + str(r.randrange(30)) for _ in range(60)]
        bad, poor = i % 5 == 0, i % 3 == 0
        if bad:
            words[r.randrange(60)] = r.choice(["zurgle", "zurglish"])
        if poor:
            words[r.randrange(60)] = "qqqqq"
        rows.append((i, " ".join(words)))
        labels.append((i, int(poor), int(bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    table = spark.createDataFrame(labels[:300], "doc_id long, poor int, toxic int")
    chain = toxicity.train(docs, table, [("poor", F.col("poor")), ("toxic", F.col("toxic"))])
    got = {x["doc_id"]: x for x in toxicity.predict(docs, chain).collect()}
    held = labels[300:]
    assert sum((got[i]["p_toxic"] >= 0.5) == bool(t) for i, _, t in held) >= 0.95 * len(held)
    assert sum((got[i]["p_poor"] >= 0.5) == bool(p) for i, p, _ in held) >= 0.95 * len(held)
    assert len(chain.weights[1]) == len(chain.weights[0]) + 1
    odd = spark.createDataFrame([(1, None), (1, ""), (None, "zurgle " * 5000)], "doc_id long, text string")
    assert toxicity.predict(odd, chain).count() == 3 and toxicity.predict(nothing, chain).count() == 0


def test_toxicity_without_labels(spark, docs):
    table = spark.createDataFrame([], "doc_id long, toxic int")
    chain = toxicity.train(docs, table, [("toxic", F.col("toxic"))])
    assert max(r["p_toxic"] for r in toxicity.predict(docs, chain).collect()) < 1e-6


def test_chain_uses_out_of_fold_probabilities():
    r = np.random.default_rng(5)
    x = (r.random((300, 6)) < 0.4).astype(float)
    first = (x[:, 0] + x[:, 1] > 1).astype(float)
    labels = np.stack([first, first], axis=1)
    w = toxicity.fit_chain(x, labels, np.arange(300) % 4)
    assert w[1].shape == (8,) and w[1][-1] > 0.5


# --- licences -----------------------------------------------------------------------------------
def test_license_rules(spark, nothing):
    s = licenses.SENTENCES
    mit = "\n".join(s[i] for i in ("mit-short-title", "mit-grant", "mit-condition", "mit-warranty"))
    texts = [
        mit, "prose. Released under the MIT License.\nmore prose", "# Licensed under the Apache License, Version 2.0.", "no licence here", None, "",
        s["gpl3-notice"] + "\n" + s["cc-by-nc-notice"] + "\n" + s["gpl3-notice"], s["bsd-redistribution"] + ":\n* " + s["bsd-source"] + "\n* " + s["bsd-binary"], s["mit-warranty"],
    ]
    got = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[i]["licenses"] for i in range(9)] == ["MIT", "MIT", "Apache-2.0", "", "", "", "GPL-3.0,GPL-3.0,CC-BY-NC-4.0", "BSD-2-Clause", ""]
    assert got[0]["n_sentences"] == 4 and got[8]["n_sentences"] == 1
    assert licenses.scan(nothing).count() == 0


def wrapped(text: str, mark: str, end: str = "\n") -> str:
    return end.join(f"{mark}{x}".rstrip() for p in text.split("\n\n") for x in [*textwrap.wrap(p, 60), ""])


def test_license_sentences_wrapped_over_lines(spark):
    s = licenses.SENTENCES
    bsd2 = f"Copyright (c) 2020, A B\n\n{s['bsd-redistribution']}:\n\n1. {s['bsd-source']}\n\n2. {s['bsd-binary']}"
    bsd3 = f"{bsd2}\n\n3. {s['bsd-endorse']}"
    gpl = f"{s['gpl-free']}: {s['gpl3-redistribute']}\n\n{s['gpl-hope']}; without even the implied warranty of FITNESS."
    gpl2 = f"{s['gpl-free']}; {s['gpl2-redistribute']}"
    mit = f"{s['mit-grant']}:\n\n{s['mit-condition']}\n\n{s['mit-warranty']}"
    want = {bsd2: "BSD-2-Clause", bsd3: "BSD-3-Clause", gpl: "GPL-3.0-or-later", gpl2: "GPL-2.0-or-later", mit: "MIT", s["isc-grant"]: "ISC", s["mpl-notice"]: "MPL-2.0", s["unlicense"]: "Unlicense"}
    rows = [(wrapped(t, mark, end), name) for t, name in want.items() for mark in ("", "# ", " * ", "// ") for end in ("\n", "\r\n")]
    # a line of its own stays a sentence, and a blank line parts what is not one sentence
    rows += [("x y\nAll rights reserved", "All-Rights-Reserved"), ("# All rights\n# reserved.", "All-Rights-Reserved"), ("All rights\n\nreserved.", ""), ("# All rights\n#\n# reserved. as is", "")]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string")
    got = {r["doc_id"]: r["licenses"] for r in licenses.scan(df).collect()}
    assert [got[i] for i in range(len(rows))] == [name for _, name in rows]


# --- url filter ---------------------------------------------------------------------------------
def test_url_filter_as_of(spark):
    entries = spark.createDataFrame([(1, "bad.com", "block", "2024-02-01"), (2, "bad.com", "allow", "2024-03-01"), (3, "ok.bad.com", "allow", "2024-01-01"), (4, "x.org/ads", "block", "2024-01-01"), (5, "bad.com", "allow", "2024-02-01")], "entry_id int, key string, action string, d string").withColumn("listed_at", F.col("d").cast("timestamp_ntz"))
    rows = [(1, "http://www.bad.com/a", "2024-01-31"), (2, "HTTP://u@BAD.com:80/", "2024-02-10"), (3, "http://bad.com", "2024-03-01"), (4, "https://ok.bad.com/x", "2024-02-10"), (5, "https://a.x.org/ads/1?q", "2024-02-10"), (6, "https://x.org/adsense", "2024-02-10"), (7, None, "2024-02-10"), (8, "no url", "2024-02-10"), (9, "http://bad.com", None), (1, "http://www.bad.com/a", "2024-02-05")]
    df = spark.createDataFrame(rows, "page_id long, url string, d string").withColumn("at", F.col("d").cast("timestamp_ntz")).withColumn("key", F.lit("clash"))
    entries1 = entries.filter("entry_id != 5")
    got = sorted((r["page_id"], r["allowed"], r["entry_id"]) for r in url_filter.judge(df, entries1, "page_id", "url", "at").fillna({"entry_id": 0}).collect())
    assert got == [(1, False, 1), (1, True, 0), (2, False, 1), (3, True, 2), (4, True, 3), (5, False, 4), (6, True, 0), (7, True, 0), (8, True, 0), (9, True, 0)]
    last = {r["page_id"]: r["allowed"] for r in url_filter.judge(df.filter("page_id = 2"), entries, "page_id", "url", "at").collect()}
    assert last == {2: True}
    assert url_filter.judge(df.limit(0), entries, "page_id", "url", "at").count() == 0
    assert url_filter.judge(df, entries.limit(0), "page_id", "url", "at").filter("allowed").count() == len(rows)


def test_url_filter_keys_of_any_depth(spark):
    host = ".".join("abcdefghij") + ".bad.com"
    entries = spark.createDataFrame([(1, "x.org/1/2/3/4/5/6", "block"), (2, "x.org/1/2", "allow"), (3, host, "block"), (4, "bad.com", "allow")], "entry_id int, key string, action string").withColumn("listed_at", F.lit("2024-01-01").cast("timestamp_ntz"))
    urls = ["http://x.org/1/2/3/4/5/6/7", "http://x.org/1/2/3/4/5/7", f"http://w.{host}/a/b", "http://bad.com/1/2", f"http://{host[2:]}", "http://org/1/2/3/4/5/6"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("at", F.lit("2024-02-01").cast("timestamp_ntz"))
    got = {r["page_id"]: (r["allowed"], r["entry_id"]) for r in url_filter.judge(df, entries, "page_id", "url", "at").collect()}
    assert got == {0: (False, 1), 1: (True, 2), 2: (False, 3), 3: (True, 4), 4: (True, 4), 5: (True, None)}


def test_url_filter_long_list_and_hot_domain(spark):
    """100,000 entries, all captures under one domain, by broadcast and by the dealt shuffle join: the same verdicts."""
    entries = spark.range(100_000).select(F.col("id").cast("int").alias("entry_id"), F.when(F.col("id") < 3, "Hot.example.com./").otherwise(F.concat(F.lit("d"), F.col("id").cast("string"), F.lit(".example"))).alias("key"), F.when(F.col("id") == 1, "allow").otherwise("block").alias("action"), (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(days=(F.col("id") % 300).cast("int"))).alias("listed_at"))
    captures = spark.range(2000).select("id", F.concat(F.lit("http://a.hot.example.com:80/"), F.col("id").cast("string")).alias("url"), (F.lit("2023-12-30 12:00:00").cast("timestamp_ntz") + F.make_dt_interval(days=(F.col("id") % 6).cast("int"))).alias("at"), F.lit(1).alias("_key"))
    one, two = (sorted(map(tuple, url_filter.judge(captures, entries, "id", "url", "at", most_broadcast=m, hot_rows=50).collect())) for m in (10**9, 0))
    assert one == two and len(one) == 2000
    # day 0 and 1 lie before the first entry; then block, allow, block, block
    assert {r[0] % 6: r[3] for r in one} == {0: True, 1: True, 2: False, 3: True, 4: False, 5: False} and {r[5] for r in one} == {None, "hot.example.com"}


def test_url_filter_writes_keys_and_hosts_alike(spark):
    keys = ["Bad.COM", "bad4.com/", "https://User@Path.org:8080//A/b/?q#f", "[2001:DB8::1]", "", None, "com."]
    entries = spark.createDataFrame([(i, k, "block", "2024-01-01") for i, k in enumerate(keys)], "entry_id int, key string, action string, day string").withColumn("listed_at", F.col("day").cast("timestamp_ntz"))
    urls = ["http://bad.com", "https://x.BAD4.com./y", "http://path.org/A/b/c", "http://path.org/a/b", "http://[2001:db8::1]:80/x", "http://[2001:db8::2]/", "http://fine.com", "http://fine.org", None, "no url", "http://path.org/A/b/" + "x" * 300_000]
    captures = spark.createDataFrame([(i, u, "2024-06-01") for i, u in enumerate(urls)], "id int, url string, day string").withColumn("at", F.col("day").cast("timestamp_ntz"))
    got = {r["id"]: (r["allowed"], r["key"]) for r in url_filter.judge(captures, entries, "id", "url", "at").collect()}
    assert got == {0: (False, "bad.com"), 1: (False, "bad4.com"), 2: (False, "path.org/A/b"), 3: (True, None), 4: (False, "[2001:db8::1]"), 5: (True, None), 6: (False, "com"), 7: (True, None), 8: (True, None), 9: (True, None), 10: (False, "path.org/A/b")}


def licence_text(*parts: str) -> str:
    """A licence as its file prints it: paragraphs of known sentences."""
    return "\n\n".join("".join(licenses.SENTENCES.get(p, p) for p in part.split("|")) for part in parts)


LICENCES = {
    "MIT": licence_text("mit-title", "Copyright (c) 2020 A. Nobody", "mit-grant|:", "mit-condition", "mit-warranty"),
    "BSD-3-Clause": licence_text("bsd-redistribution|:", "1. |bsd-source", "2. |bsd-binary", "3. |bsd-endorse"),
    "BSD-2-Clause": licence_text("bsd-redistribution|:", "1. |bsd-source", "2. |bsd-binary"),
    "Apache-2.0": licence_text("apache-header|; |apache-comply| |apache-obtain", "http://www.apache.org/licenses/LICENSE-2.0", "apache-basis| |apache-limits"),
    "GPL-3.0-or-later": licence_text("gpl-free|: |gpl3-redistribute", "gpl-hope|; without even the implied warranty of fitness."),
    "GPL-2.0-or-later": licence_text("gpl-free|; |gpl-redistribute|; |either-2", "gpl-hope|; without more."),
    "LGPL-2.1-or-later": licence_text("lgpl-free|; |lgpl-redistribute|; |either-21"),
    "LGPL-3.0-or-later": licence_text("lgpl-free|; |lgpl-redistribute|; |either-3"),
    "AGPL-3.0-or-later": licence_text("gpl-free|: |agpl3-redistribute"),
    "MPL-2.0": licence_text("mpl-notice| If a copy was not distributed, get one."),
    "Zlib": licence_text("zlib-provided| In no event will anyone be liable.", "zlib-granted|:"),
    "ISC": licence_text("isc-grant"),
}


@pytest.mark.parametrize("lead", ["", "# ", "// ", " * "])
def test_licence_texts_wrapped_at_72_columns(spark, lead):
    def wrapped(text):
        lines = [line for part in text.split("\n\n") for line in [*textwrap.wrap(part, 72 - len(lead)), ""]]
        return "code before\n\n" + "\n".join((lead + x).rstrip() for x in lines) + "\nint main();"

    names = list(LICENCES)
    df = spark.createDataFrame([(i, wrapped(LICENCES[n])) for i, n in enumerate(names)], "doc_id int, text string")
    assert {names[r["doc_id"]]: r["licenses"] for r in licenses.scan(df).collect()} == {n: n for n in names}


def test_licence_versions_long_texts_repeats_and_clashes(spark):
    mpl = licenses.SENTENCES["mpl-notice"]
    cases = [
        (1, mpl.replace("2.0", "1.1"), ""), (2, licenses.SENTENCES["mpl11-notice"], "MPL-1.1"), (3, "This program is free software; " + licenses.SENTENCES["gpl-redistribute"] + "; either version 3 of the License, or (at your option) any later version.", "GPL-3.0-or-later"),
        (4, "This program is free software; " + licenses.SENTENCES["gpl-redistribute"] + "; either version 4 of the License.", ""), (5, "word " * 200_000 + "\n" + mpl + "\n" + "word " * 200_000, "MPL-2.0"), (6, mpl, "MPL-2.0"), (6, mpl, "MPL-2.0"), (None, None, ""),
    ]
    df = spark.createDataFrame([(i, t, "x", "y") for i, t, _ in cases], "doc_id int, text string, _line string, licenses string")
    assert sorted(((r["doc_id"], r["licenses"]) for r in licenses.scan(df).collect()), key=str) == sorted(((i, want) for i, _, want in cases), key=str)


# --- pii ----------------------------------------------------------------------------------------
def luhn(digits: str) -> bool:
    total = sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(int(c) for c in reversed(digits)))
    return total % 10 == 0


def test_pii_formats_and_links(spark, nothing):
    text = "card 4111 1111 1111 1111, not 4111111111111112; mail joe.doe+x9@ex.example.com tel +1 (017) 555-7713 ip 10.0.255.3 not 300.1.1.1 ssn 123-45-6789 not 000-12-3456 on 2024-02-29 not 2023-02-29, 31.12.1999 12/31/1999 iban DE89 3704 0044 0532 0130 00 end"
    df = spark.createDataFrame([(1, text, "a"), (2, None, "b"), (3, "", "c"), (4, "again 4111111111111111 and 2024-02-29", "d")], "doc_id int, text string, _row string")
    got = {r["doc_id"]: r for r in pii.pseudonymize(df, "k").collect()}
    kinds = [v["kind"] for v in got[1]["pii"]]
    assert kinds == ["card", "email", "phone", "ipv4", "ssn", "date", "date", "date", "iban"]
    values = [v["value"] for v in got[1]["pii"]]
    assert luhn(re.sub(r"\D", "", values[0])) and re.fullmatch(r"(\d{4} ){3}\d{4}", values[0])
    bban = re.sub(r"\s", "", values[8])
    assert int("".join(str(int(c, 36)) for c in bban[4:] + bban[:4])) % 97 == 1
    assert values[5:8] != ["2024-02-29", "31.12.1999", "12/31/1999"]
    assert values[6].split(".")[::-1] == [values[7].split("/")[2], values[7].split("/")[0], values[7].split("/")[1]]
    for kept in ("4111111111111112", "300.1.1.1", "000-12-3456", "2023-02-29", "card ", " end"):
        assert kept in got[1]["text"]
    for gone in ("4111 1111", "joe.doe", "555-7713", "10.0.255.3", "123-45-6789", "2024-02-29", "0532"):
        assert gone not in got[1]["text"]
    assert [v["value"] for v in got[4]["pii"]] == [values[0].replace(" ", ""), values[5]]
    assert got[2]["text"] is None and got[3]["text"] == "" and got[3]["pii"] == [] and got[1]["_row"] == "a"
    assert pii.pseudonymize(nothing, "k").count() == 0


def test_pii_valid_values_inside_longer_candidates(spark):
    card, odd = "4111 1111 1111 1111", "5500-0000-0000-0004"
    cases = [
        (f"paid 2 {card}", ["card"], ["paid 2 "]), (f"{card} 12/25", ["card"], [" 12/25"]), (f"{card} 123.", ["card"], [" 123."]), (f"12345 {card} 55", ["card"], ["12345 ", " 55"]),
        (f"{card} {odd} 7", ["card", "card"], [" 7"]), (f"AB12 {card} x", ["card"], ["AB12 "]), (f"AB12 {odd} x", ["card"], ["AB12 "]), (f"{card} 123-45-6789", ["card", "ssn"], []),
        (f"{card} 2020-01-05", ["card", "date"], []), (f"{card} 12ab", ["card"], [" 12ab"]), ("call +14155550123 now", ["phone"], ["call +1", " now"]), ("+33 1 23 45 67 89 2 times", ["phone"], ["+33 ", " 2 times"]),
        ("+33123456789", ["phone"], ["+33"]), ("+49 170 123 45 67", ["phone"], ["+49 "]), ("+91 98765 43210", ["phone"], ["+91 "]), (f"+49 30 123456 {card}", ["phone", "card"], ["+49 "]),
        ("at 2020-01-05T10:00:00Z on", ["date"], ["at ", "T10:00:00Z on"]), ("GB82 WEST 1234 5698 7654 32 THE END", ["iban"], ["GB", " THE END"]), ("NL91ABNA0417164300", ["iban"], ["NL"]),
        ("FR14 2004 1010 0505 0001 3M02 606", ["iban"], ["FR"]), ("IT60X0542811101000000123456,", ["iban"], ["IT"]), (f"BE68 5390 0754 7034 {card}", ["iban", "card"], ["BE"]), ("XX12 ABCD GB82 WEST 1234 5698 7654 32", ["iban"], ["XX12 ABCD GB"]),
        ("AB12 JOHN DOE1@EXAMPLE.COM", ["email"], ["AB12 JOHN ", "@EXAMPLE.COM"]), ("4111 1111 1111 1112 and 2 4111 1111 1111 1112", [], ["4111 1111 1111 1112 and 2 4111 1111 1111 1112"]),
        ("GB82 WEST 1234 5698 7654 33", [], ["GB82 WEST 1234 5698 7654 33"]), ("+2 12 +999123", [], ["+2 12 +999123"]), ("call (555) 123-4567 or (555)123-4567", ["phone", "phone"], ["call (", " or ("]), ("12 34 56 78 " * 3000, None, []),
    ]
    out = pii.pseudonymize(spark.createDataFrame([(i, t) for i, (t, *_) in enumerate(cases)], "doc_id int, text string"), "k").collect()
    got = {r["doc_id"]: r for r in out}
    for i, (text, kinds, left) in enumerate(cases):
        new, values = got[i]["text"], [v["value"] for v in got[i]["pii"]]
        assert kinds is None or [v["kind"] for v in got[i]["pii"]] == kinds, text
        assert len(new) == len(text) and all(x in new for x in left) and all(v in new and v not in text for v in values), (text, new)
        for v in got[i]["pii"]:
            signs = re.sub(r"[ -]", "", v["value"])
            assert v["kind"] != "card" or luhn(signs)
            assert v["kind"] != "iban" or int("".join(str(int(c, 36)) for c in signs[4:] + signs[:4])) % 97 == 1
    once = {v["value"].replace(" ", "") for i in (0, 1, 2, 3, 5, 7) for v in got[i]["pii"] if v["kind"] == "card"}
    assert len(once) == 1


def test_pii_is_a_keyed_bijection(spark):
    df = spark.range(1000).select(F.lpad(F.col("id").cast("string"), 3, "0").alias("d"))
    one = df.select("d", pii.permute_digits(F.col("d"), "k1", "t").alias("p"), pii.permute_digits(F.col("d"), "k2", "t").alias("q"))
    back = one.withColumn("b", pii.permute_digits(F.col("p"), "k1", "t", back=True))
    n, same, equal = back.agg(F.count_distinct("p"), F.count_if(F.col("b") == F.col("d")), F.count_if(F.col("p") == F.col("q"))).first()
    assert n == 1000 and same == 1000 and equal < 20
    days = spark.range(0, 146_097, 13).select(F.date_add(F.lit("1800-01-01").cast("date"), F.col("id").cast("int")).cast("string").alias("text"))
    out = pii.pseudonymize(days, "k").select("text").distinct()
    assert out.count() == days.count() and out.filter(F.col("text").try_cast("date").isNull()).count() == 0


def plain_feistel(a, b, sizes, key, tweak, back):
    """The network written out, from the secret."""
    steps = range(8)
    for step in reversed(steps) if back else steps:
        own = "round-key-" + hmac.new(key.encode(), f"round {step}".encode(), hashlib.sha256).hexdigest()
        add = int(hashlib.sha256(f"{own}|{tweak}|{a if step % 2 else b}".encode()).hexdigest()[:15], 16)
        add = -add if back else add
        a, b = (a, (b + add) % sizes[1]) if step % 2 else ((a + add) % sizes[0], b)
    return a, b


def plain_digits(text, key, kind, back):
    n, left = len(text), len(text) // 2
    a, b = plain_feistel(int(text[:left]), int(text[left:]), (10**left, 10 ** (n - left)), key, f"{kind}{n}", back)
    return f"{a:0{left}d}{b:0{n - left}d}"


def plain_classes(text, key, kind, back):
    left = len(text) // 2
    a, b = text[:left], text[left:]
    for step in reversed(range(8)) if back else range(8):
        own = "round-key-" + hmac.new(key.encode(), f"round {step}".encode(), hashlib.sha256).hexdigest()
        by = bytes.fromhex(hashlib.sha256(f"{own}|{kind}{len(text)}|{a if step % 2 else b}".encode()).hexdigest())

        def moved(half):
            out = ""
            for i, c in enumerate(half):
                low, n = ("a", 26) if c in string.ascii_lowercase else ("A", 26) if c in string.ascii_uppercase else ("0", 10) if c in string.digits else (c, 1)
                out += chr(ord(low) + (ord(c) - ord(low) + (-by[i % 32] if back else by[i % 32])) % n)
            return out

        a, b = (a, moved(b)) if step % 2 else (moved(a), b)
    return a + b


def plain_pseudonym(value, kind, key, back):
    """A value's pseudonym or, back, the value of a pseudonym, in plain Python."""

    def laid_out(signs, like=value, kinds=string.digits):
        it = iter(signs)
        return "".join(next(it) if c in kinds else c for c in like)

    digits = re.sub(r"\D", "", value)
    if kind == "card":
        payload = plain_digits(digits[:-1], key, kind, back)
        return laid_out(payload + next(c for c in string.digits if luhn(payload + c)))
    if kind == "iban":
        signs = value.replace(" ", "")
        account = (plain_digits if signs[4:].isdigit() else plain_classes)(signs[4:], key, kind, back)
        check = 98 - int("".join(str(int(c, 36)) for c in account + signs[:2] + "00")) % 97
        return laid_out(f"{signs[:2]}{check:02d}{account}", value, string.digits + string.ascii_uppercase)
    if kind == "phone":
        country = "" if value[0] == "(" else re.match(r"\+\d{1,3}(?=[ .\-(])", value) or re.match(rf"\+(?:[17]|{pii.COUNTRY})", value)
        start = len(country[0]) if country else 0
        return value[:start] + laid_out(plain_digits(re.sub(r"\D", "", value[start:]), key, kind, back), value[start:])
    if kind == "ssn":
        area, group, serial = map(int, value.split("-"))
        a, b = plain_feistel(area - 1 - (area > 666), (group - 1) * 9999 + serial - 1, (898, 99 * 9999), key, kind, back)
        return f"{a + 1 + (a >= 665):03d}-{b // 9999 + 1:02d}-{b % 9999 + 1:04d}"
    if kind == "ipv4":
        x = [int(v) for v in value.split(".")]
        a, b = plain_feistel(x[0] * 256 + x[1], x[2] * 256 + x[3], (65536, 65536), key, kind, back)
        return f"{a // 256}.{a % 256}.{b // 256}.{b % 256}"
    if kind == "date":
        form = "%Y-%m-%d" if value[4] == "-" else "%d.%m.%Y" if "." in value else "%m/%d/%Y"
        first = datetime.date(1800, 1, 1)
        a, b = plain_feistel(*divmod((datetime.datetime.strptime(value, form).date() - first).days, 773), (189, 773), key, kind, back)
        return (first + datetime.timedelta(a * 773 + b)).strftime(form)
    local, _, host = value.partition("@")
    return f"{plain_classes(local, key, kind, back)}@{host}"


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_pii_of_all_documents_goes_back_by_plain_python(spark):
    """Each pseudonym, taken back by an independent network, restores the document; forward it gives the pseudonym again."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", F.col("text").alias("pii"), F.lit(1).alias("PII_"))
    out = pii.pseudonymize(docs, "secret").collect()
    assert out and {*out[0].asDict()} == {"doc_id", "text", "pii", "PII_", "pii__"}
    total = 0
    for r in out:
        at, back = 0, ""
        for v in r["pii__"]:
            place = r["text"].index(v["value"], at)
            old = plain_pseudonym(v["value"], v["kind"], "secret", True)
            assert plain_pseudonym(old, v["kind"], "secret", False) == v["value"]
            back += r["text"][at:place] + old
            at, total = place + len(v["value"]), total + 1
        assert (None if r["text"] is None else back + r["text"][at:]) == r["pii"]
    assert total > 20
    plan = pii.pseudonymize(docs, "secret")._jdf.queryExecution().toString()
    assert pii.ROUND_MARK in plan and "secret" not in plan


def test_pii_addresses_with_letters_of_any_script(spark):
    """Every place of a letter beyond ASCII: the whole local part is permuted within its classes, one to one, the host stays."""
    base = "maxmuller42"
    odd = [base[:i] + c + base[i + 1 :] for i in range(9) for c in "üßжЖΩ漢"]
    said = ["Max.Müller", "Ünal42", "jürgen.maß", *odd, *("ü" + a + b for a in "abcäö" for b in "xyzж")]
    rows = spark.createDataFrame([(i, f"an {w}@exämple.de, and") for i, w in enumerate(said)], "doc_id long, text string")
    out = {r["doc_id"]: r for r in pii.pseudonymize(rows, "k").collect()}
    new = []
    for i, w in enumerate(said):
        (value,) = out[i]["pii"]
        assert value["kind"] == "email" and out[i]["text"] == f"an {value['value']}, and"
        local, host = value["value"].split("@")
        new.append(local)
        assert host == "exämple.de" and len(local) == len(w) and local != w
        for old, now in zip(w, local, strict=True):
            size = next(((a, n) for a, n in ((48, 10), (65, 26), (97, 26), *pii.LETTERS) if a <= ord(old) < a + n), None)
            assert now == old if size is None else size[0] <= ord(now) < size[0] + size[1]
    assert len({*new}) == len({*said})


@pytest.mark.parametrize("text,found", [
    ("# SPDX-License-Identifier: MIT\nimport os", "MIT"),
    ("// spdx-license-identifier: GPL-2.0-or-later", "GPL-2.0-or-later"),
    ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; version 2 of the License.", "GPL-2.0-only"),
    ("Licensed under the Apache License 2.0", "Apache-2.0"),
    ("GNU GENERAL PUBLIC LICENSE\n Version 3, 29 June 2007\n\n Copyright", "GPL-3.0"),
    ("  Apache License\n  Version 2.0, January 2004\n", "Apache-2.0"),
    ("the Mozilla Public License, v. 1.1", ""),
    ("Mozilla Public License, v. 1.1", "MPL-1.1"),
    ("Version 3, 29 June 2007", ""),
    ("We like the Apache License and version 3 of all.", ""),
    ("MIT License\n\nThe Unlicense\n\nMIT License", "MIT,MIT,Unlicense"),
])
def test_licence_tags_titles_and_versions(spark, text, found):
    rows = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert licenses.scan(rows).first()["licenses"] == found

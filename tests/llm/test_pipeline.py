"""The corpus pipeline against a brute-force version."""

import hashlib
import re

import corpus_pipeline
import public_tokenizers
from test_llm import brute_components, edited, prose

from tallyboard.llm import lang_id, mixing
from tallyboard.llm.queries import QUERIES, language_model

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, extra string"


def test_pipeline_matches_brute_force(spark, tmp_path):
    from tokenizers import Tokenizer

    base = [prose(i, 60 + i) for i in range(60)]
    texts = [*base, *base[:10], *(edited(base[i], i, 2) for i in range(12)), None, "", "123 456", base[3] + "  "]
    rows = [(i, t, "en", f"s{i % 3}" if i % 5 else None, len(t or ""), "x") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, SCHEMA)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r["doc_id"], r["n_tokens"], r["decoded_sha256"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())

    model = language_model(docs)
    kept = [r for r in rows if (x := lang_id.label([r[1]], model)[0])[0] != "und" and x[1] >= corpus_pipeline.MAIN_LANGUAGE]
    seen, unique = set(), []
    for r in kept:
        norm = re.sub(r"[\x20\x09-\x0D]+", " ", r[1])
        if norm not in seen:
            seen.add(norm)
            unique.append(r)
    comp = brute_components(unique)
    alone = [r for r in unique if comp[r[0]][1] == r[0]]
    repeats = {r["doc_id"]: r["repeats"] for r in mixing.mix(spark.createDataFrame(alone, SCHEMA)).collect()}
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = sorted((r[0], len(library.encode(r[1], add_special_tokens=False).ids), hashlib.sha256(r[1].encode()).hexdigest()) for r in alone for _ in range(repeats[r[0]]))
    assert got == want and len(alone) < len(unique) < len(kept) < len(rows)


def test_stages_take_an_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], SCHEMA)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.count() == 0
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))

"""The operators' queries against DuckDB where SQL can express them, on the smallest tables."""

import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
import oracle  # noqa: E402

from tallyboard.llm import queries  # noqa: E402

pytestmark = pytest.mark.skipif(not os.path.isdir(oracle.DATA), reason="no test tables")


@pytest.mark.parametrize("name", queries.ORACLE_SQL)
def test_query(spark, name):
    mine, theirs = oracle.same_rows(queries.QUERIES[name](spark, oracle.DATA), oracle.connect().sql(queries.ORACLE_SQL[name]))
    assert mine == theirs


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{oracle.DATA}/documents.parquet").select("doc_id", "lang")
    rows = queries.op7_language(spark, oracle.DATA).join(docs, "doc_id").filter("held_out AND lang_pred != 'und'").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.95 * len(rows) > 0

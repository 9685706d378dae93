"""Every query outside the text operators gives the rows of its SQL; those without SQL meet stated properties."""

import pytest

from millrace.plans.registry import ORACLES, QUERIES
from tools.compare import compare

FOLDER = "/root/testdata/sf0.001"


def test_all_with_sql(spark):
    assert compare(spark, FOLDER, sorted(ORACLES)) == []


def test_pagerank_is_a_distribution(spark):
    total = QUERIES["ppr_16_iterations"](spark, FOLDER).agg({"score": "sum"}).first()[0]
    assert total == pytest.approx(1, abs=1e-4)


def test_greedy_pack_against_a_loop(spark):
    lines = sorted(tuple(r) for r in spark.read.parquet(f"{FOLDER}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_quantity").collect())
    used, want = {}, set()
    for order, line, size in lines:
        if used.get(order, 0) + size <= 100:
            used[order] = used.get(order, 0) + size
            want.add((order, line))
    assert {(r.l_orderkey, r.l_linenumber) for r in QUERIES["greedy_pack"](spark, FOLDER).collect()} == want


def test_entry_imports_without_text_operators(monkeypatch):
    import sys

    import __spark_entry__

    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    assert "score_bm25" in __spark_entry__.queries()

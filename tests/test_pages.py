"""Pages of text, and the loop of a retrieval benchmark."""

import pytest

from lodestone.engine import Engine
from lodestone.plans import quality, render
from tests.test_structure import SOURCES


@pytest.fixture(scope="module")
def engine(spark):
    long = "def long():\n" + "".join(f"    x{i} = {i}\n" for i in range(80)) + "    return needle\n"
    many = "needle a\nneedle b\nneedle c\npassword = 'hunter2secret' needle\n"
    rows = [*SOURCES, ("pkg/long.py", long), ("docs/many.md", many), *[(f"docs/z{i}.md", "needle\n") for i in range(9)]]
    files = spark.createDataFrame([(i, p, t) for i, (p, t) in enumerate(rows)], "file_id long, path string, text string").cache()
    return Engine.build(spark, files).semantic_index()


def test_pattern_page(engine):
    text = engine.search_text("needle", mode="exact")
    lines = text.splitlines()
    assert lines[0] == "Pattern: 11 files matched:" and lines[-1] == "... 3 more files not shown — refine your query"
    assert "pkg/long.py:  reason: exact token match" in text and "  L1–60:" in lines and "    ... (22 more lines)" in lines
    compact = engine.search_text("needle", mode="exact", context="compact")
    assert "  L1: needle a\n  ... 3 more matches" in compact and "... 6 more files" in compact
    assert "hunter2secret" not in text + compact


def test_no_matches(engine):
    assert engine.search_text("nothing at all here", mode="exact") == "No matches for 'nothing at all here'."


def test_semantic_and_merged_pages(engine):
    text = engine.search_text("needle", mode="semantic", context="compact", top_k=3)
    assert text.startswith("Semantic: 3 matches for 'needle':") and text.count("reason: semantic match") == 3
    merged = engine.search_text("Save", mode="hybrid", top_k=20)
    first, rest = merged.split("\n\nSemantically related (")
    assert first.startswith("Pattern (") and "cs/Store.cs: reason: exact token match" in first
    assert rest.count("reason: semantic match") == 5 and "cs/Store.cs" not in rest
    assert engine.search_text("IStore", mode="symbol").startswith("Symbol: ")


def test_boost_is_named():
    assert render.reason("pattern", 0.3) == "exact token match + recent git activity" and render.reason("semantic", 0.0) == "semantic match"


def test_benchmark(spark, engine):
    query = ("q1", "how is the store saved", "IStore", "IStore", ["cs/IStore.cs", "cs/Store.cs"], ["Shop.Data.IStore"], ["cs/StoreTests.cs"])
    manifest = spark.createDataFrame([query], "id string, query string, exact_query string, symbol_query string, expected_files array<string>, expected_symbols array<string>, expected_tests array<string>")
    results = quality.run(manifest, engine.retrieve, modes=quality.RETRIEVALS).cache()
    got = {r["mode"]: r for r in results.collect()}
    assert set(got) == set(quality.RETRIEVALS)
    assert got["ripgrep"]["recall_at_5"] == got["exact"]["recall_at_5"] == 1.0 and got["ripgrep"]["ranked"] == got["exact"]["ranked"]
    assert got["symbol"]["exact_symbol_recall"] == 1.0 and got["symbol"]["recall_at_1"] == 0.5
    assert got["hybrid_symbols"]["ranked"][0] == "cs/istore.cs" and got["hybrid_symbols"]["exact_symbol_recall"] == 1.0
    assert len(set(got["hybrid"]["ranked"])) == len(got["hybrid"]["ranked"]) <= 10
    total = {r["mode"]: r for r in quality.summary(results).collect()}
    assert all(total[m]["latency_ms_p50"] > 0 and total[m]["returned_tokens_max"] == got[m]["returned_tokens"] for m in got)
    with pytest.raises(ValueError):
        quality.run(manifest, engine.retrieve, modes=["exact"], k=5)
    with pytest.raises(ValueError):
        engine.retrieve({"query": "x"}, "other")

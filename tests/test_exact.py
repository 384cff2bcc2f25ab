"""Exact search against a plain scan."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.functions.text import folded
from lodestone.operators import exact, grams

FILES = [(0, "a.py", "def Alpha():\r\n  café = 'naïve'\n\x00end"), (1, "b.py", "aaaaa\nLONG needle here\n" * 12), (2, "c.py", "É and é\n"), (3, "empty.py", ""), (4, "n.py", None), (5, "z.py", "ALPHA\nBETA")]


def scan(text, needle, case):
    if text is None or not needle:
        return []
    t, n = (text, needle) if case else (folded(text), folded(needle))
    found, at = [], t.find(n)
    while at >= 0:
        line = t.count("\n", 0, at)
        if line not in found:
            found.append(line)
        at = t.find(n, at + 1)
    return [line + 1 for line in found][:10]


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame(FILES, "file_id long, path string, text string").cache()


@pytest.mark.parametrize("needle", ["alpha", "aa", "café", "É", "é", "needle", "\r\n", "\x00", "here\nAAAAA", "a\na", "", "ALPHABETA", "x" * 300, "\n"])
@pytest.mark.parametrize("case", [True, False])
def test_equals_scan(files, needle, case):
    found = {r["file_id"]: [m["line"] for m in r["matches"]] for r in exact.search(files, needle, case_sensitive=case).collect()}
    assert found == {i: hit for i, _, text in FILES if (hit := scan(text, needle, case))}


@pytest.mark.parametrize("needle", ["alpha", "needle", "aa", "Long N", "nowhere"])
def test_pruning_loses_nothing(files, needle):
    plain, pruned = exact.search(files, needle), grams.pruned_search(files, grams.postings(files), needle)
    assert sorted(map(str, plain.collect())) == sorted(map(str, pruned.collect()))


def test_caps(spark):
    files = spark.createDataFrame([(i, f"f{i}", "needle\n" * 1000) for i in range(2)], "file_id long, path string, text string")
    row = exact.search(files, "needle", max_files=1).collect()
    assert len(row) == 1 and [m["line"] for m in row[0]["matches"]] == list(range(1, 11)) and row[0]["total_files"] == 2


def test_empty_table(spark, files):
    assert exact.search(files.limit(0), "x").count() == 0
    assert exact.total_files(files.limit(0), "x").first()["total_files"] == 0


def test_search_has_no_shuffle_of_texts(files):
    plan = exact.matches(files, "needle")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text("ab\nA", max_size=12), min_size=1, max_size=6), st.text("ab\nA", min_size=1, max_size=4), st.booleans())
def test_random(spark, texts, needle, case):
    files = spark.createDataFrame([(i, str(i), t) for i, t in enumerate(texts)], "file_id long, path string, text string")
    found = {r["file_id"]: [m["line"] for m in r["matches"]] for r in exact.search(files, needle, case_sensitive=case).collect()}
    assert found == {i: hit for i, t in enumerate(texts) if (hit := scan(t, needle, case))}


def test_line_end_trimmed(spark):
    row = spark.createDataFrame([(0, "p", "x y \t\x1c\u2003\r\n")], "file_id long, path string, text string")
    assert exact.search(row, "y").first()["matches"][0]["content"] == "x y"
    assert exact.lines(row).select(F.max("line")).first()[0] == 2

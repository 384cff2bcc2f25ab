import re
from collections import defaultdict

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from lodestone.llm import linededup

SCHEMA = "doc_id long, text string, line int, h1 long, _kept string"


def words(line):
    return tuple(w for w in re.split(r"[\x20\x09-\x0D]+", line) if w)


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) <= 1
    if abs(len(a) - len(b)) != 1:
        return False
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows):
    """rows of distinct doc_ids -> {doc_id: kept text}."""
    first = {}
    order = sorted((r for r in rows if r[1] is not None), key=lambda r: (r[0] is None, r[0]))
    for d, text in order:
        for i, line in enumerate(text.split("\n")):
            if words(line):
                first.setdefault(words(line), (d is None, d or 0, i))
    near = {w for w, at in first.items() if len(w) >= 5 and any(len(v) >= 5 and v != w and other < at and one_edit(v, w) for v, other in first.items())}
    out = {d: None for d, t in rows if t is None}
    for d, text in order:
        out[d] = "\n".join(x for i, x in enumerate(text.split("\n")) if not words(x) or (first[words(x)] == (d is None, d or 0, i) and words(x) not in near))
    return out


def run(spark, rows):
    frame = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], SCHEMA).select("doc_id", "text", "line", "h1")
    return {r["doc_id"]: r["kept_text"] for r in linededup.report(frame).collect()}


LINE = "one two three four five six seven eight"
ROWS = [
    (1, f"{LINE}\n\nshort\n{LINE} nine\n"), (2, f"{LINE}\r\nshort \n \nunique words stand here in line two"), (3, "one two THREE four five six seven eight\nshort one"), (4, "two three four five six seven eight"),
    (5, "one two three four five six seven eight nine ten"), (6, ""), (7, None), (None, f"  one\ttwo three  four five six seven eight  \nown line of the null row here"), (8, "x " * 30_000 + "\n" + "x " * 29_999), (9, "\n".join(f"page {i} of the long report on wheat" for i in range(300))),
    (10, "a b c d\na b c e"),
]


def test_equals_brute_force(spark):
    assert run(spark, ROWS) == brute(ROWS)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.lists(st.sampled_from("abc"), min_size=0, max_size=8).map(" ".join), max_size=4).map("\n".join), min_size=1, max_size=8))
def test_random(spark, texts):
    rows = list(enumerate(texts))
    assert run(spark, rows) == brute(rows)


def test_repeated_rows_are_one_document(spark):
    got = run(spark, [(1, LINE), (1, LINE), (2, LINE)])
    assert got == {1: LINE, 2: ""}


def test_empty_and_columns(spark):
    assert run(spark, []) == {}
    frame = spark.createDataFrame([(1, f"{LINE}\n{LINE}", "src", 7)], "doc_id long, text string, source string, n_lines int")
    found, kept, gone, _ = linededup.dedup(frame)
    row = found.first()
    assert row[kept] == LINE and row["n_lines"] == 7 and row[gone] == [1]


def test_keeper(spark):
    _, removed = linededup.removals(spark.createDataFrame([(4, f"zz\n{LINE}"), (9, LINE), (None, LINE)], "doc_id long, text string"))
    assert {(r["keeper_doc"], r["keeper_line"]) for r in removed.collect()} == {(4, 1)}


def test_many_lines_gone(spark):
    text = "\n".join(f"line {i % 40} w w w w{i % 40}" for i in range(400))
    assert run(spark, [(1, text)]) == brute([(1, text)])


@pytest.mark.parametrize(("a", "b", "yes"), [("a b c d e", "a b c d e f", True), ("b c d e f", "a b c d e f", True), ("a b c d e", "b c d e f", False), ("a b c d e", "a x c d e", True), ("a b c d e", "a x c d y", False)])
def test_edit_check(spark, a, b, yes):
    row = spark.createDataFrame([(a.split(), b.split())], "a array<string>, b array<string>")
    from pyspark.sql import functions as F

    assert row.select(linededup._within_one_edit(F.col("a"), F.col("b"))).first()[0] is yes
    assert row.select(linededup._within_one_edit(F.col("b"), F.col("a"))).first()[0] is yes


def test_no_python_in_the_plan(spark):
    counts = defaultdict(int)
    plan = linededup.report(spark.createDataFrame(ROWS, "doc_id long, text string"))._jdf.queryExecution().toString()
    for word in ("Python", "Pandas", "ArrowEval"):
        counts[word] += plan.count(word)
    assert not any(counts.values())

import random
from collections import defaultdict

import duckdb
import pytest

from lodestone.llm import mixing

SCHEMA = "doc_id long, text string, source string, size string, rank int, target int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA)


def fill(sizes):
    """Targets by the contract's own steps: share by weight, stop at twice the size, share the excess again."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (3.0, 1.0, 2.0)[i % 3] for i, s in enumerate(names)}
    got, open_, rest = {}, set(names), 1.5 * sum(sizes.values())
    while open_:
        level = rest / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 2.0 * sizes[s]}
        if not full:
            got |= {s: level * weight[s] for s in open_}
            break
        for s in full:
            got[s] = 2.0 * sizes[s]
            rest -= got[s]
        open_ -= full
    return got


ROWS = [(i, "w " * (i % 50), f"s{i % 7}") for i in range(400)] + [(1000 + i, "hot " * 90, "hot") for i in range(300)] + [(2000, None, None), (2001, "a b", None), (None, "c\x0bd\xa0e", "s1"), (3, "again", "s3"), (3, "again", "s3"), (4000, "", "empty"), (4001, "x " * 30_000, "zz")]


def test_targets_and_taken(spark):
    got = mixing.report(frame(spark, ROWS)).collect()
    assert len(got) == len(ROWS)
    sizes, taken = defaultdict(int), defaultdict(int)
    source = {r[0]: r[2] for r in ROWS}
    for r in got:
        sizes[source[r["doc_id"]]] += r["size"]
        taken[source[r["doc_id"]]] += r["taken"]
        assert 0 <= r["taken"] <= 2 * r["size"]
    want = fill(sizes)
    for r in got:
        s = source[r["doc_id"]]
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(want[s])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 1
    again = mixing.report(frame(spark, ROWS[::-1]).repartition(5)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


@pytest.mark.parametrize("seed", range(6))
def test_targets_of_random_sources(spark, seed):
    rng = random.Random(seed)
    sizes = {f"s{i:02}": rng.choice([0, 1, rng.randrange(50), rng.randrange(10_000)]) for i in range(rng.randrange(1, 25))}
    sized = spark.createDataFrame(list(sizes.items()), "source string, size long")
    got = {r["source"]: r["target"] for r in mixing.targets(sized).collect()}
    assert got == pytest.approx(fill(sizes)) and sum(got.values()) == pytest.approx(1.5 * sum(sizes.values()))


def test_equals_sql(spark):
    data = frame(spark, [r for r in ROWS if r[0] is not None])
    duck = duckdb.connect()
    duck.register("documents", data.toPandas())
    key = lambda r: (r[0], r[1])
    ours = sorted((r["doc_id"], r["size"], r["source_size"], round(r["target"], 6), r["taken"]) for r in mixing.report(data).collect())
    theirs = sorted((a, b, c, round(d, 6), e) for a, b, c, d, e in duck.execute(f"SELECT doc_id, size, source_size, target, taken FROM ({mixing.SQL})").fetchall())
    assert sorted(ours, key=key) == sorted(theirs, key=key)


def test_schedule_is_even(spark):
    docs = spark.createDataFrame([(i, "w " * 200, f"s{i % 3}") for i in range(600)], "doc_id long, text string, source string")
    _, pieces, _ = mixing.mix(docs, block=256)
    goals = mixing.targets(mixing.streams(docs))
    rows = mixing.schedule(spark, goals, block=256).orderBy("slot").collect()
    share = {r["rank"]: r["target"] for r in goals.collect()}
    total = sum(share.values())
    for rank, target in share.items():
        at = [i for i, r in enumerate(rows) if r["rank"] == rank]
        for n in range(50, len(rows) - 10, 50):  # every prefix holds each source nearly by weight
            assert abs(sum(i < n for i in at) - n * target / total) <= 6
    assert sum(r["words"] for r in rows) == pytest.approx(total, abs=3)
    assert pieces.agg({"words": "sum"}).first()[0] == sum(r["words"] for r in rows)
    assert len({(r["rank"], r["turn"]) for r in rows}) == len(rows)


def test_empty(spark):
    assert mixing.report(frame(spark, [])).count() == 0
    assert [r["taken"] for r in mixing.report(frame(spark, [(1, None, "s"), (2, "", None)])).collect()] == [0, 0]

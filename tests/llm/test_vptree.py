import numpy as np
import pytest

from lodestone.llm import vptree

SCHEMA = "vec_id long, embedding array<float>, shard int, dim string"


def brute(rows, k=5):
    good = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = []
    for i, q in good:
        if i % 50 == 0:
            near = sorted((-vptree.cosine(q[None], v[None])[0], j) for j, v in good if j != i and len(v) == len(q))[:k]
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(near)]
    return sorted(out)


def data():
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(8, 16))
    rows = [(i, (centres[i % 8] + 0.3 * rng.normal(size=16)).tolist()) for i in range(600)]
    rows += [(1000 + i, [1.0] * 16) for i in range(150)]  # copies, queries among them
    rows += [(50 * 40, [2.0] * 16), (50 * 41, [0.0] * 16), (50 * 42, None), (50 * 43, []), (50 * 44, [float("nan")] + [1.0] * 15), (50 * 45, [None] + [1.0] * 15), (None, [1.0] * 16), (50 * 46, [1.0, 2.0]), (3001, [2.0, 1.0])]
    rows += [(50 * 47, [1e30] * 16), (50 * 48, [1e-30] * 15 + [0.0])]
    return rows


def run(spark, rows, **options):
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    used = vptree.usable(frame)
    index = vptree.build_index(used, shard_rows=options.pop("shard_rows", 200))
    found = vptree.search(index, used.where("vec_id % 50 = 0"), k=5, query_rows=7, **options)
    return sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in found.collect())


def test_factor_one_is_exact(spark):
    assert run(spark, data()) == brute(data())


def test_tree_shards_are_exact(spark):
    assert run(spark, data(), shard_rows=10_000) == brute(data())


def test_relaxed_recall(spark):
    want, got = brute(data()), run(spark, data(), factor=1.5, shard_rows=10_000)
    assert len({x[:1] + x[2:3] for x in want} & {x[:1] + x[2:3] for x in got}) >= 0.9 * len(want)


def test_few_rows(spark):
    assert run(spark, []) == []
    assert run(spark, [(0, [1.0, 0.0]), (1, [0.0, 1.0])]) == [(0, 1, 1, 0.0)]
    twice = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [0.0, 1.0])]
    assert run(spark, twice) == [(0, 1, 1, 0.0)] * 2


@pytest.mark.parametrize("seed", range(3))
def test_tree_search(seed):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(3000, 8))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    order, nodes, points = vptree.build_tree(v)
    assert sorted(order) == list(range(3000)) and len(nodes) > 50
    at, row = (np.concatenate(x) for x in zip(*vptree.search_tree(v[order], nodes, points, v[:40], 6, 1.0)))
    for i in range(40):
        assert set(order[row[at == i]]) == set(np.argsort(-(v @ v[i]), kind="stable")[:6])


def exact(rows, queries, k=5):
    """(query, rank) -> id, by the operator's own cosine of every pair."""
    ids, v = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], dtype=np.float64)
    out = {}
    for q in queries:
        at = int(np.flatnonzero(ids == q)[0])
        score = vptree.cosine(np.repeat(v[at : at + 1], len(v), axis=0), v)
        order = [i for i in np.lexsort((ids, -score)) if ids[i] != q][:k]
        out |= {(q, n + 1): (int(ids[i]), float(score[i])) for n, i in enumerate(order)}
    return out


@pytest.mark.parametrize("kind", ["proportional", "last bit", "slight", "huge"])
def test_ties_and_near_ties_equal_brute_force(spark, kind):
    rng = np.random.default_rng(12)
    v = rng.normal(size=(300, 16)).astype(np.float32)
    if kind == "proportional":  # every cosine among the first 31 is 1.0
        v[:31] = v[0] * (2.0 ** rng.permutation(31))[:, None]
    elif kind == "last bit":
        v[:] = v[0]
        v[np.arange(300), rng.integers(0, 16, 300)] = np.nextafter(v[0, rng.integers(0, 16, 300)], np.float32(9))
    elif kind == "slight":
        v = v[0] + (rng.normal(size=(300, 16)) * 10.0 ** rng.integers(-9, -2, (300, 1))).astype(np.float32)
    else:
        v = (v.astype(np.float64) * 1e200).tolist()
    rows = [(i, [float(x) for x in row]) for i, row in enumerate(v)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in vptree.report(frame).collect()}
    assert got == exact(rows, range(0, 300, 50))
    if kind == "proportional":
        assert [got[0, n][0] for n in range(1, 6)] == [1, 2, 3, 4, 5]

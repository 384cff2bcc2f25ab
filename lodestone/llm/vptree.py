"""Nearest neighbours by cosine through vantage-point trees, one for each shard of the vectors.

Unit vectors make the cosine order that of Euclidean distance, which obeys the triangle inequality. A tree node parts its
vectors by their distance to a vantage point; a side is passed over if the least distance that the inequality allows for
it, times `factor`, exceeds the distance of the worst neighbour so far. Factor 1 is exact; higher factors pass over more.
Equal vectors are held once, with all their ids, so a group of copies costs one comparison. First descents find how
near the k-th neighbour is, the last one every vector that is as near but for a proven rounding error; scores of all of
those are computed from the original vectors, in double precision, dimension by dimension, and decide with the ids. So
ties and near ties cost time, but are told apart as brute force does.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components take no part, nor do null ids;
queries are compared with vectors of their own dimension; repeated rows are candidates each, but never for their own id;
ties go to the smaller id; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stored

SHARD, QUERIES, LEAF, FACTOR = 16384, 16384, 64, 1.0
PAIRS = 200_000  # scored at once


def rounding(dim: int) -> float:
    """More than the cosine of two vectors by a matrix product of unit vectors and the one by sums can differ: either
    takes dim products and sums for the numerator, as many for each norm and a few more steps, each off by 2^-53 at most."""
    return (8 * dim + 64) * 2.0**-53


def usable(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, v (doubles), dim, uid of the vectors that take part."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).where(finite & F.exists("v", lambda x: x != 0))
    return rows.select("vec_id", "v", F.size("v").alias("dim"), F.monotonically_increasing_id().alias("uid"))


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    flat = column.combine_chunks()
    flat = flat.flatten() if isinstance(flat, pa.ListArray) else pa.concat_arrays([c.flatten() for c in column.chunks])
    return flat.to_numpy(zero_copy_only=False).reshape(-1, dim)


def _unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=1, keepdims=True)  # squares of large or small numbers stay finite
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def build_tree(unit: np.ndarray, *, leaf: int = LEAF, seed: int = 7) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, nodes, vantage points). Rows of nodes: first, last, vantage (-1 in leaves), split distance, greatest inside, least outside, inside, outside node."""
    order, nodes, rng = np.arange(len(unit)), [], np.random.default_rng(seed)

    def grow(a: int, b: int) -> int:
        me = len(nodes)
        nodes.append([a, b, -1, 0.0, 0.0, 0.0, -1, -1])
        if b - a <= leaf:
            return me
        part = unit[order[a:b]]
        picks = rng.integers(0, b - a, 5)
        far = np.sqrt(np.maximum(2 - 2 * part @ part[picks].T, 0))
        best = int(far.std(axis=0).argmax())  # the point that tells the others best apart
        d = far[:, best]
        middle = float(np.median(d))
        inside = d <= middle
        if inside.all():
            inside = d < middle
        if not inside.any() or inside.all():
            return me
        vantage = unit[order[a + picks[best]]].copy()
        own = order[a:b].copy()
        cut = a + int(inside.sum())
        order[a:cut], order[cut:b] = own[inside], own[~inside]
        points.append(vantage)
        nodes[me][2:6] = [len(points) - 1, middle, float(d[inside].max()), float(d[~inside].min())]
        nodes[me][6] = grow(a, cut)
        nodes[me][7] = grow(cut, b)
        return me

    points: list[np.ndarray] = []
    grow(0, len(unit))
    return order, np.array(nodes, dtype=np.float64), np.array(points).reshape(-1, unit.shape[1])


def search_tree(unit: np.ndarray, nodes: np.ndarray, points: np.ndarray, queries: np.ndarray, k: int, factor: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of places in `queries` and `unit` (in tree order): all but for `factor` that may be among a query's k nearest."""
    error = rounding(unit.shape[1])
    slack = 4 * np.sqrt(2 * error)  # of the distances in one comparison: near zero a root makes the error large
    far = np.full(len(queries), np.inf)  # a square that the k-th nearest doesn't exceed

    def leaves(ask) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
        """(queries, first row, squares) of each leaf, once for all queries that `ask` sends there."""
        stack = [(0, np.arange(len(queries)))]
        while stack:
            node, q = stack.pop()
            a, b, vantage = int(nodes[node, 0]), int(nodes[node, 1]), int(nodes[node, 2])
            if not len(q):
                continue
            if vantage < 0:
                for at in range(a, b, 256):
                    yield q, at, np.maximum(2 - 2 * queries[q] @ unit[at : min(at + 256, b)].T, 0)
                continue
            d = np.sqrt(np.maximum(2 - 2 * queries[q] @ points[vantage], 0))
            to_inside, to_outside = ask(q, d, *nodes[node, 3:6])
            stack += [(int(nodes[node, 7]), q[to_outside]), (int(nodes[node, 6]), q[to_inside])]

    def own_side(q, d, split, greatest, least):
        return d <= split, d > split

    def within_reach(q, d, split, greatest, least):
        reach = np.sqrt(far[q])
        return (d - greatest - slack) * factor <= reach, (least - d - slack) * factor <= reach

    # One leaf gives a first reach; all leaves within reach then the true one, all within that what is asked for.
    for ask in (own_side, within_reach):
        nearest = np.full((len(queries), k), np.inf)
        for q, _, square in leaves(ask):
            nearest[q] = np.sort(np.partition(np.concatenate([nearest[q], square], axis=1), k - 1, axis=1)[:, :k], axis=1)
            far[q] = np.minimum(far[q], nearest[q, -1])
    far += 4 * error  # cosines of twice the error less
    for q, at, square in leaves(within_reach):
        i, j = np.nonzero(square <= far[q, None])
        yield q[i], at + j


def _scaled(v: np.ndarray) -> np.ndarray:
    """Rows times powers of two, which changes no cosine but keeps the squares of large or small numbers finite."""
    return np.ldexp(v, -np.frexp(np.abs(v).max(axis=1, keepdims=True))[1])


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of paired rows, by sums in the order of dimensions."""
    a, b = _scaled(a), _scaled(b)
    dot, aa, bb = np.zeros(len(a)), np.zeros(len(a)), np.zeros(len(a))
    for j in range(a.shape[1]):
        dot += a[:, j] * b[:, j]
        aa += a[:, j] * a[:, j]
        bb += b[:, j] * b[:, j]
    return dot / (np.sqrt(aa) * np.sqrt(bb))


def _best(at: np.ndarray, score: np.ndarray, vec: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first k of each query, by score, then id."""
    order = np.lexsort((vec, -score, at))
    at, score, vec = at[order], score[order], vec[order]
    keep = np.arange(len(at)) - np.searchsorted(at, at) < k
    return at[keep], score[keep], vec[keep]


_INDEX = "dim int, shard long, ids binary, sizes binary, vectors binary, nodes binary, points binary"


def build_index(rows: DataFrame, *, shard_rows: int = SHARD) -> DataFrame:
    """A row for each shard: its distinct vectors in tree order, the ids of each (sorted), and the tree. Every row is indexed."""
    counts = {r["dim"]: r["n"] for r in rows.groupBy("dim").agg(F.count("*").alias("n")).collect()}  # one row a dimension
    shards = F.lit(1)
    for dim, n in counts.items():
        shards = F.when(F.col("dim") == dim, -(-n // shard_rows)).otherwise(shards)
    sharded = rows.withColumn("shard", F.pmod(F.xxhash64("uid"), shards).cast("long"))

    def build(group: pa.Table) -> pa.Table:
        dim, ids = group["dim"][0].as_py(), group["vec_id"].to_numpy()
        v = _matrix(group["v"], dim)
        order = np.lexsort((ids, *v.T[::-1]))  # equal vectors side by side, their ids ascending
        v, ids = v[order], ids[order]
        new = np.concatenate(([True], (v[1:] != v[:-1]).any(axis=1)))
        starts = np.flatnonzero(new)
        sizes = np.diff(np.append(starts, len(v)))
        tree, nodes, points = build_tree(_unit(v[starts]))
        ids = np.concatenate([ids[starts[i] : starts[i] + sizes[i]] for i in tree])
        parts = (ids.astype(np.int64), sizes[tree].astype(np.int64), v[starts[tree]], nodes, points)
        names = [x.split()[0] for x in _INDEX.split(", ")]
        return pa.Table.from_arrays([pa.array([dim], pa.int32()), pa.array([group["shard"][0].as_py()], pa.int64()), *[pa.array([x.tobytes()], pa.binary()) for x in parts]], names)

    return sharded.groupBy("dim", "shard").applyInArrow(build, _INDEX)


def search(index: DataFrame, queries: DataFrame, *, k: int, factor: float = FACTOR, query_rows: int = QUERIES) -> DataFrame:
    """query_uid, query_id, rank, vec_id, score: the k nearest of each query, other ids only.

    Queries go in blocks against every shard; a task holds one shard and one block, both of a
    bounded size. So every vector is copied once for each block of queries, and every query once for each shard: the
    stated query set against all rows, whose work and copies grow with their product. A shard gives its best k of a
    query, and the best k of those are the result.
    """
    total = max(queries.count(), 1)
    blocks = -(-total // query_rows)
    trees = index.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"))
    asked = queries.select("uid", "vec_id", "v", "dim", F.pmod(F.xxhash64("uid"), F.lit(blocks)).cast("long").alias("block"))
    last = index.groupBy("dim").agg(F.max("shard").alias("last"))  # one row a dimension
    asked = asked.join(last, "dim").select("*", F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("shard")).drop("last")
    schema = "query_uid long, query_id long, vec_id long, score double"

    def run(tree: pa.Table, block: pa.Table) -> pa.Table:
        names = ["query_uid", "query_id", "vec_id", "score"]
        none = pa.Table.from_arrays([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.float64())], names)
        if not tree.num_rows or not block.num_rows:
            return none
        dim = tree["dim"][0].as_py()
        ids, sizes, v, nodes, points = (np.frombuffer(tree[c][0].as_py(), t) for c, t in (("ids", np.int64), ("sizes", np.int64), ("vectors", np.float64), ("nodes", np.float64), ("points", np.float64)))
        v, points, nodes = v.reshape(-1, dim), points.reshape(-1, dim), nodes.reshape(-1, 8)
        starts = np.cumsum(sizes) - sizes
        q, q_ids, q_uids = _matrix(block["v"], dim), block["vec_id"].to_numpy(), block["uid"].to_numpy()
        best = np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64)
        held: list[tuple[np.ndarray, np.ndarray]] = []
        n_held = 0

        def settle() -> None:
            nonlocal best
            at, row = (np.concatenate(x) for x in zip(*held))
            held.clear()
            for i in range(0, len(at), PAIRS):
                a, r = at[i : i + PAIRS], row[i : i + PAIRS]
                score = cosine(q[a], v[r])
                # Of equal vectors the first k + 1 ids do, as one of them may be the query's own.
                many = np.minimum(sizes[r], k + 1)
                nth = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                a, score, vec = np.repeat(a, many), np.repeat(score, many), ids[np.repeat(starts[r], many) + nth]
                other = vec != q_ids[a]
                best = _best(*(np.concatenate(x) for x in zip(best, (a[other], score[other], vec[other]))), k)

        for pairs in search_tree(_unit(v), nodes, points, _unit(q), k + 1, factor):
            held.append(pairs)
            n_held += len(pairs[0])
            if n_held > PAIRS:
                settle()
                n_held = 0
        if held:
            settle()
        at, score, vec = best
        return pa.Table.from_arrays([pa.array(q_uids[at]), pa.array(q_ids[at]), pa.array(vec), pa.array(score)], names)

    found = trees.groupBy("dim", "shard", "block").cogroup(asked.groupBy("dim", "shard", "block")).applyInArrow(run, schema)
    best = Window.partitionBy("query_uid").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best).cast("int")).where(F.col("rank") <= k).select("query_uid", "query_id", "rank", "vec_id", "score")


def report(vectors: DataFrame, *, k: int = 5, every: int = 50, factor: float = FACTOR) -> DataFrame:
    """query_id, rank, vec_id, score for queries whose vec_id is divisible by `every`, against all rows."""
    rows = stored(usable(vectors), "vectors")
    index = stored(build_index(rows), "vp-index")
    return search(index, rows.where(F.col("vec_id") % every == 0), k=k, factor=factor).drop("query_uid")


#: Brute force. Sums run in the order of dimensions, as the operator's do.
SQL = r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
n AS (SELECT *, sqrt(list_reduce(list_transform(e, lambda x: x * x), lambda a, b: a + b)) AS norm FROM v),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         list_reduce(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]), lambda a, b: a + b) / (q.norm * c.norm) AS score
  FROM n q JOIN n c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""

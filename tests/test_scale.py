"""Operators that deal groups out by ranges, folders with hidden names, and checks of a catalogue, against plain Python."""

import math
import random

import pytest

from lodestone.engine import Engine
from lodestone.functions.stats import quantiles
from lodestone.operators import semantic
from lodestone.plans import trajectory
from lodestone.sources import corpus

RULES = {"median": ("median", 0.5), "p95": ("nearest", 0.95), "cut": ("cut", 0.95), "rank": ("rank", 0.95)}


def brute(values):
    v = sorted(x for x in values if x is not None)
    if not v:
        return (None,) * 4
    n = len(v)
    return ((v[(n - 1) // 2] + v[n // 2]) / 2, v[round((n - 1) * 0.95)], v[min(int(n * 0.95), n - 1)], v[math.ceil(n * 0.95) - 1])


def test_quantiles(spark):
    draw = random.Random(5)
    groups = {"hot": [draw.choice([None, 1.0, 2.0, draw.random()]) for _ in range(3000)], None: [3.0, 1.0, 2.0], "nulls": [None, None], "one": [7.0], "ties": [4.0] * 50}
    rows = [(g, v) for g, values in groups.items() for v in values]
    draw.shuffle(rows)
    found = quantiles(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", RULES)
    assert {r["g"]: tuple(r[k] for k in RULES) for r in found.collect()} == {g: brute(v) for g, v in groups.items()}


def test_quantiles_of_nothing(spark):
    assert quantiles(spark.createDataFrame([], "g string, v double"), ["g"], "v", RULES).count() == 0


def test_schedule(spark):
    tasks = spark.createDataFrame([(f"t{i}", i) for i in range(40)], "task_id string, place int")
    want = [(f"t{i}", m, r) for r in range(2) for i in range(40) for m in (["a", "b"] if (i + r) % 2 == 0 else ["b", "a"])]
    got = trajectory.schedule(tasks, ["a", "b"], 2).orderBy("nth").collect()
    assert [(r["task_id"], r["mode"], r["repetition"]) for r in got] == want and [r["nth"] for r in got] == list(range(1, 161))
    mixed = [trajectory.schedule(tasks, ["a", "b"], 2, order="random", seed=3).orderBy("nth").collect() for _ in range(2)]
    assert mixed[0] == mixed[1] and sorted((r["task_id"], r["mode"], r["repetition"]) for r in mixed[0]) == sorted(want)


def test_batch_search_in_blocks(spark):
    draw = random.Random(2)
    vectors = {i: [draw.gauss(0, 1) for _ in range(6)] for i in range(120)}
    table = spark.createDataFrame([(i, v) for i, v in vectors.items()], "vec_id long, embedding array<double>")
    asked = table.where("vec_id % 4 = 0").selectExpr("vec_id as query_id", "embedding as q")
    cosine = lambda a, b: sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))
    want = {q: [i for _, i in sorted((-round(cosine(vectors[q], v), 12), i) for i, v in vectors.items())[:3]] for q in vectors if q % 4 == 0}
    for block in (7, 1000):
        got = semantic.batch_top_k(table, asked, 3, block=block).orderBy("query_id", "rank").collect()
        assert {q: [r["vec_id"] for r in got if r["query_id"] == q] for q in want} == want


def test_capped_chunks(spark):
    rows = [(i, f"p{i // 3}", 1 + i % 3, "x") for i in range(12)]
    chunks = spark.createDataFrame(rows[::-1], "file_id long, path string, start_line int, text string")
    got = semantic.capped(chunks, 4).orderBy("file_id").collect()
    assert [r["path"] for r in got] == sorted(r[1] for r in sorted(rows, key=lambda r: (r[1], r[2]))[:4]) and all(r["chunks_capped"] for r in got)
    assert semantic.capped(chunks, 12).where("not chunks_capped").count() == 12


@pytest.fixture()
def folder(tmp_path):
    files = {
        "a.py": "import b\n", "pkg/__init__.py": "X = 1\n", "pkg/_private.py": "y = 2\n", "pkg/[id].ts": "let needle = 1\n", "pkg/deep/c.PY": "needle\n", ".github/w.yml": "on: push\n", ".env.local": "K=v\n",
        "pkg/empty.py": "", "_e.py": "", "node_modules/m.js": "needle\n", "pkg/dist/d.js": "needle\n", "image.png": "x", "big.py": "z" * 3000,
    }
    for name, content in files.items():
        (tmp_path / "c" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "c" / name).write_text(content)
    return tmp_path / "c", files


def test_folder_with_hidden_names(spark, folder):
    root, files = folder
    want = {n for n in files if not n.startswith("node_modules") and "dist" not in n and n not in ("image.png", "big.py")}
    got = corpus.read_folder(spark, str(root), env_files=True, max_bytes=2000).collect()
    assert {r["path"]: bytes(r["content"]).decode() for r in got} == {n: files[n] for n in want}
    assert len(got) == len(want) and all(r["size"] == len(files[r["path"]]) and r["mtime"] is not None for r in got)
    assert ".env.local" not in {r["path"] for r in corpus.read_folder(spark, str(root)).collect()}
    assert corpus.read_folder(spark, str(root), keep_empty=False).where("size = 0").count() == 0
    assert corpus.skipped(spark, str(root), max_bytes=2000).first()["skipped"] == 1


def test_folder_without_files(spark, tmp_path):
    (tmp_path / "none" / "node_modules").mkdir(parents=True)
    assert corpus.read_folder(spark, str(tmp_path / "none")).count() == 0


def test_index_of_a_package(spark, folder):
    engine = Engine.index(spark, str(folder[0]))
    assert {r["path"] for r in engine.search("needle").collect()} == {"pkg/[id].ts", "pkg/deep/c.PY"}


def test_catalogue(spark):
    files = spark.createDataFrame([(i, n) for i, n in enumerate([5, 0, 7, 3])], "file_id long, size long")
    space, size = corpus.packed(files), 18
    chunks = corpus.chunk_table(size, 8, spark)
    assert corpus.checked_catalogue(space, chunks, corpus_bytes=size, chunk=8).count() == 4
    bad = lambda s, c, **k: {r["check"] for r in corpus.faults(s, c, **{"corpus_bytes": size, "chunk": 8, **k}).where("bad <> 0").collect()}
    assert bad(space.where("file_id <> 1"), chunks) == {"file ids"} and bad(space.unionByName(space.where("file_id = 1")), chunks) == {"file ids"}
    assert bad(space.withColumn("offset", -space["offset"] - 1), chunks) == {"file records"}
    assert bad(space, chunks, corpus_bytes=17) == {"files beyond the corpus", "chunks beyond the corpus"} and bad(space, chunks.where("chunk_id < 2")) == {"chunk coverage"}
    assert bad(space, chunks.withColumn("valid_length", chunks["valid_length"] * 0)) == {"chunks beyond the corpus"}
    with pytest.raises(ValueError, match="chunk coverage"):
        corpus.checked_catalogue(space, chunks.where("chunk_id > 0"), corpus_bytes=size, chunk=8)

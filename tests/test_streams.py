"""Streams, stores and JSON sources."""

import json

import pytest
from pyspark.sql import functions as F

from lodestone.plans import quality, trajectory
from lodestone.sources import records
from lodestone.sources.store import Store, append_replace, fingerprint
from lodestone.streaming import changes


def test_follow_equals_rebuild(spark, tmp_path):
    store, source = Store(spark, str(tmp_path / "store")), tmp_path / "log"
    start = spark.createDataFrame([("a", 1), ("b", 2)], "path string, v int")
    store.write("files", start, "start")
    log = [("a", 10, 1, False), ("a", 11, 2, False), ("b", 0, 3, True), ("c", 5, 4, False)]
    for i, row in enumerate(log):
        spark.createDataFrame([row], "path string, v int, ts long, deleted boolean").coalesce(1).write.mode("append").parquet(str(source))
    stream = spark.readStream.schema("path string, v int, ts long, deleted boolean").option("maxFilesPerTrigger", 4).parquet(str(source))
    changes.follow(stream, store, "files", checkpoint=str(tmp_path / "cp"), trigger={"availableNow": True}).awaitTermination(120)
    assert sorted((r["path"], r["v"]) for r in store.read("files").collect()) == [("a", 11), ("c", 5)]


def test_debounce_stream(spark, tmp_path):
    rows = [("k", f"2024-01-01 00:00:0{s}") for s in (0, 1, 5)] + [("z", "2024-01-01 01:00:00")]
    events = spark.createDataFrame(rows, "key string, ts string").withColumn("ts", F.to_timestamp("ts"))
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("key string, ts timestamp").parquet(str(tmp_path / "in"))
    query = changes.debounced(stream).writeStream.format("memory").queryName("bursts").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = sorted((r["key"], r["events"]) for r in spark.table("bursts").collect())
    assert got == [("k", 1), ("k", 2)]
    batch = sorted((r["key"], r["events"]) for r in changes.debounced(events).collect())
    assert batch == [("k", 1), ("k", 2), ("z", 1)]


def test_store_versions(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    assert store.read("t") is None
    store.write("t", spark.range(3), "one")
    store.write("t", spark.range(5), "two")
    assert store.read("t", fingerprint_="two").count() == 5 and store.read("t", fingerprint_="one") is None and store.read("t", version=2) is None
    (tmp_path / "t.current-000000003").write_text("{")  # a pointer that isn't valid is passed over
    assert store.read("t").count() == 5
    store.invalidate("t")
    assert store.read("t") is None
    store.write("t", spark.range(7), "three")
    assert store.read("t").count() == 7 and sum(not x.name.startswith(".") for x in tmp_path.glob("*t.current-*")) == 2


def test_command_operations(spark):
    from pyspark.sql import functions as F

    commands = {"dotnet build x": ["test"], "findstr a b.cs": ["search"], "ls | Select-String x": ["search"], "bat a.py": ["file_read"], "Set-Content a 1": ["edit"], "cp a b": ["other"], "git grep x && cat y": ["search", "file_read"]}
    got = spark.createDataFrame([(c,) for c in commands], "c string").select("c", records.operations(F.col("c")).alias("o")).collect()
    assert {r["c"]: r["o"] for r in got} == commands


def test_fingerprint_follows_content(spark):
    make = lambda rows: fingerprint(spark.createDataFrame(rows, "path string, content string")).first()[0]
    a = make([("x", "1"), ("y", "2")])
    assert a == make([("y", "2"), ("x", "1")]) and a != make([("x", "1"), ("y", "3")]) and a == make([("x", "1"), ("y", "2"), ("empty", "")])
    assert append_replace(spark.createDataFrame([("/r/a",), ("/r2/b",)], "path string"), spark.createDataFrame([("/r/c",)], "path string"), "/r").count() == 2


def test_manifest(spark, tmp_path):
    good = {"schema_version": 1, "name": "m", "repository": "r", "queries": [{"id": "q", "query": "x", "expected_files": [" a ", ""]}]}
    (tmp_path / "m.json").write_text(json.dumps(good, indent=1))
    assert records.manifest(spark, str(tmp_path / "m.json")).first()["expected_files"] == ["a"]
    for bad in ({**good, "schema_version": 9}, {**good, "queries": good["queries"] * 2}):
        (tmp_path / "b.json").write_text(json.dumps(bad))
        with pytest.raises(Exception, match="version|distinct"):
            records.manifest(spark, str(tmp_path / "b.json")).collect()


def test_tasks_and_runs(spark, tmp_path):
    task = {"id": "t", "repository": "r", "base_commit": "c", "relevant_files": ["a"], "validation": [{"argv": ["x"], "timeout_seconds": 5}]}
    (tmp_path / "t.json").write_text(json.dumps({"schema_version": 1, "tasks": [task]}))
    assert records.tasks(spark, str(tmp_path / "t.json")).first()["id"] == "t"
    (tmp_path / "r.jsonl").write_text('\n{"schema_version": 2, "identity": {"mode": "a"}}\n')
    assert records.runs(spark, str(tmp_path / "r.jsonl"), version=2).first()["identity"]["mode"] == "a"


def test_trajectory(spark):
    rows = [("r", 0, '{"type": "tool_call", "elapsed_ms": 1}'), ("r", 1, "not json"), ("s", 0, '{"type": "final", "elapsed_ms": 2}')]
    got = records.trajectory(spark.createDataFrame(rows, "run_id string, sequence long, value string")).orderBy("run_id", "sequence").collect()
    assert [(r["run_id"], r["type"]) for r in got] == [("r", "tool_call"), ("r", "tool_result"), ("r", "final"), ("s", "final")]
    assert got[1]["category"] == "warning"


def test_agent_events(spark):
    item = '{"type": "item.%s", "item": {"id": "i1", "type": "command_execution", "command": "cat src/a.py", "aggregated_output": "abcd"}}'
    rows = [("r", 0, item % "started"), ("r", 1, item % "completed"), ("r", 2, '{"type": "turn.completed", "usage": {"input_tokens": 5}}'), ("r", 3, "?")]
    got = records.normalized_agent_events(spark.createDataFrame(rows, "run_id string, sequence long, value string")).orderBy("sequence").collect()
    assert [r["type"] for r in got] == ["tool_call", "tool_result", "usage", "final"]
    assert got[0]["operations"] == ["file_read"] and got[0]["file_paths"] == ["src/a.py"] and got[1]["result_size_bytes"] == 4 and got[2]["token_usage"] == {"input_tokens": 5}


def _usage(spark, rows):
    df = spark.createDataFrame([("r", i, "usage", u, s) for i, (u, s) in enumerate(rows)], "run_id string, sequence long, type string, token_usage map<string,long>, usage_semantics string")
    return trajectory.usage(df).first()


def test_usage(spark):
    one = {"input_tokens": 5, "output_tokens": 2}
    assert _usage(spark, [(one, None)])["total_tokens"] == 7
    assert _usage(spark, [(one, "delta"), (one, "delta")])["input_tokens"] == 10
    assert _usage(spark, [(one, "cumulative"), ({"input_tokens": 9}, "cumulative")])["input_tokens"] == 9
    assert _usage(spark, [(one, "cumulative"), ({"input_tokens": 3}, "cumulative")])["usage_error"] == "cumulative input_tokens decreased"
    assert not _usage(spark, [(one, None), (one, None)])["usage_valid"]


def test_reduction(spark):
    rows = [("b1", "base", "t", True, True, None, 11.0), ("o1", "other", "t", True, True, None, 6.0)]
    runs = spark.createDataFrame(rows, "run_id string, mode string, task_id string, success boolean, eligible boolean, validation_passed boolean, reads double")
    assert trajectory.reductions(runs, ["reads"], "base", "other", ["task_id"]).first()["reduction_pct"] == 45.455
    lone = runs.unionByName(runs.limit(1).withColumn("run_id", F.lit("b2")))
    assert trajectory.reductions(lone, ["reads"], "base", "other", ["task_id"]).first()["reduction_pct"] is None
    assert "45.455" in trajectory.markdown(trajectory.by_mode(runs), trajectory.reductions(runs, ["reads"], "base", "other", ["task_id"]))


def test_quality(spark):
    row = [(["a", "b", "c"], ["S"], [], ["b", "x"], ["S"], [])]
    got = quality.scores(spark.createDataFrame(row, "ranked array<string>, symbols array<string>, tests array<string>, expected_files array<string>, expected_symbols array<string>, expected_tests array<string>")).first()
    assert (got["recall_at_1"], got["recall_at_5"], got["precision_at_5"], got["mean_reciprocal_rank"], got["exact_symbol_recall"], got["related_test_recall"]) == (0.0, 0.5, 0.2, 0.5, 1.0, None)
    now = spark.createDataFrame([("m", "recall_at_1", 0.4), ("m", "returned_tokens_max", 1200.0)], "mode string, metric string, value double")
    before = spark.createDataFrame([("m", "recall_at_1", 0.5), ("m", "returned_tokens_max", 1000.0)], "mode string, metric string, value double")
    kinds = [r["kind"] for r in quality.compare(now, before, max_increase_pct={"returned_tokens_max": 10}, max_returned_tokens=1024).orderBy("kind").collect()]
    assert kinds == ["output_budget", "quality_drop", "resource_increase"] and not quality.gate(now, before)

"""Agent trajectories and runs: token usage, exploration metrics, aggregation over runs, paired comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.stats import with_quantiles
from ..tables import stored

TOKENS = ["input_tokens", "output_tokens", "cached_input_tokens", "reasoning_tokens", "total_tokens"]


def usage(events: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """run_id, the five token counts, usage_semantics, usage_valid, usage_error.

    Deltas are summed, cumulative counts must not fall and the last one holds, a single event needs no semantics; else
    the usage is invalid and all counts are null. A total that is missing is input plus output. Null isn't zero.
    """
    rows = events.where("type = 'usage'").select("run_id", "sequence", F.coalesce("usage_semantics", F.lit("")).alias("s"), *[F.col("token_usage")[k].alias(k) for k in TOKENS])
    order = Window.partitionBy("run_id").orderBy("sequence").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.select("*", *[(F.col(k) < F.last(k, ignorenulls=True).over(order)).alias(f"{k}_fell") for k in TOKENS])
    per = rows.groupBy("run_id").agg(
        F.count("*").alias("n"), F.min("s").alias("lo"), F.max("s").alias("hi"),
        *[F.sum(k).alias(f"{k}_sum") for k in TOKENS], *[F.max_by(k, F.when(F.col(k).isNotNull(), F.col("sequence"))).alias(f"{k}_last") for k in TOKENS],
        *[F.coalesce(F.max(f"{k}_fell"), F.lit(False)).alias(f"{k}_fell") for k in TOKENS],
    )
    kind = F.when((F.col("n") == 1) & (F.col("hi") == ""), "single-event").when((F.col("lo") == F.col("hi")) & F.col("lo").isin("delta", "cumulative"), F.col("lo")).otherwise("invalid")
    per = per.withColumn("kind", kind)
    fell = F.coalesce(*[F.when((F.col("kind") == "cumulative") & F.col(f"{k}_fell"), F.lit(f"cumulative {k} decreased")) for k in TOKENS])
    error = F.when(F.col("kind") == "invalid", F.lit("multiple usage events require one explicit, consistent delta or cumulative semantic")).otherwise(fell)
    per = per.withColumn("usage_error", error)
    valid = F.col("usage_error").isNull()
    value = {k: F.when(valid, F.when(F.col("kind") == "delta", F.col(f"{k}_sum")).otherwise(F.col(f"{k}_last"))) for k in TOKENS}
    value["total_tokens"] = F.coalesce(value["total_tokens"], value["input_tokens"] + value["output_tokens"])
    found = per.select("run_id", *[value[k].alias(k) for k in TOKENS], F.when(valid, F.col("kind")).otherwise("invalid").alias("usage_semantics"), valid.alias("usage_valid"), "usage_error")
    if runs is None:
        return found
    return runs.select("run_id").distinct().join(found, "run_id", "left").withColumn("usage_valid", F.coalesce("usage_valid", F.lit(True)))


def exploration(events: DataFrame, relevant: DataFrame) -> DataFrame:
    """One row a run: file reads, searches, calls, context tokens and first times. relevant(run_id, relevant_files).

    events have `operations` (array) beside category; all of it is one aggregation over a run's events.
    """
    e = events.join(relevant, "run_id", "left").withColumn("_relevant", F.transform(F.coalesce("relevant_files", F.array().cast("array<string>")), lambda p: F.lower(p)))
    paths = F.coalesce("file_paths", F.array().cast("array<string>"))
    lower = F.transform(paths, lambda p: F.lower(p))

    def does(what: str) -> Column:
        return F.coalesce(F.col("category") == what, F.lit(False)) | F.coalesce(F.array_contains("operations", F.lit(what)), F.lit(False))

    call, result = F.col("type") == "tool_call", F.col("type") == "tool_result"
    hit = F.arrays_overlap(lower, F.col("_relevant"))
    edit = F.coalesce(F.col("category") == "edit", F.lit(False))

    def first(condition: Column) -> Column:
        return F.round(F.min_by("elapsed_ms", F.when(F.coalesce(condition, F.lit(False)), F.col("sequence"))), 3)

    size = F.coalesce("result_size_bytes", F.lit(0))
    per = e.groupBy("run_id").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.when(call & does("file_read"), paths))))).alias("files_read"),
        F.coalesce(F.sum(F.when(call & does("file_read"), F.size(paths))), F.lit(0)).alias("total_file_reads"),
        F.first("_relevant").alias("_relevant"), F.count_if(call & does("search")).alias("search_operations"), F.count_if(call).alias("total_tool_calls"),
        F.ceil(F.sum(F.when(result & does("file_read"), size).otherwise(0)) / 4).alias("repository_context_tokens_estimate"),
        F.round(F.max("elapsed_ms"), 3).alias("duration_ms"), first(hit).alias("time_to_first_relevant_file_ms"),
        first((F.col("milestone") == "likely_implementation") | (edit & hit)).alias("time_to_first_likely_implementation_ms"),
        first((F.col("milestone") == "first_patch") | edit).alias("time_to_first_patch_ms"),
    )
    known = F.size("_relevant") > 0
    off = F.filter("files_read", lambda p: ~F.array_contains("_relevant", F.lower(p)))
    return per.select(
        "run_id", "files_read", F.size("files_read").alias("unique_files_read"), "total_file_reads", F.when(known, off).alias("irrelevant_files_inspected"), F.when(known, F.size(off)).alias("irrelevant_file_count"),
        "search_operations", "total_tool_calls", "repository_context_tokens_estimate", "duration_ms", "time_to_first_relevant_file_ms", "time_to_first_likely_implementation_ms", "time_to_first_patch_ms",
        F.when(F.col("time_to_first_patch_ms").isNotNull(), F.col("duration_ms")).alias("time_to_final_patch_ms"),
    )


def patch(changes: DataFrame, expected: Column) -> DataFrame:
    """changes(run_id, path, insertions, deletions) by run: sums, recall of expected files (null without any), unexpected ones."""
    per = changes.groupBy("run_id").agg(F.array_sort(F.collect_set(F.translate("path", "\\", "/"))).alias("changed_files"), F.sum("insertions").alias("insertions"), F.sum("deletions").alias("deletions"))
    want, got = F.array_distinct(F.transform(expected, lambda p: F.lower(p))), F.array_distinct(F.transform("changed_files", lambda p: F.lower(p)))
    return per.select("*", F.round(F.when(F.size(want) > 0, F.size(F.array_intersect(want, got)) / F.size(want)), 6).alias("expected_file_recall"), F.when(F.size(want) > 0, F.array_sort(F.array_except(got, want))).otherwise(F.array().cast("array<string>")).alias("unexpected_changed_files"))


def statistics(values: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """count, mean, p50 (the median), p95 (at rank ceil(0.95 n)), min, max by group, three digits; groups without a value have count 0 and nulls."""
    v = F.col(value)
    plain = (F.count(v).alias("n"), F.avg(v).alias("mean"), F.min(v).alias("min"), F.max(v).alias("max"))
    found = with_quantiles(values, by, value, {"p50": ("median", 0.5), "p95": ("rank", 0.95)}, *plain)
    return found.select(*by, "n", *[F.round(c, 3).alias(c) for c in ("mean", "p50", "p95", "min", "max")])


def per_success(runs: DataFrame, metrics: list[str]) -> DataFrame:
    """mode, metric and its statistics over the successful runs that may be compared: what a solved task takes."""
    won = runs.where(F.coalesce("eligible", F.lit(True)) & F.coalesce("success", F.lit(False)))
    return statistics(long(won, metrics), ["mode", "metric"])


def long(runs: DataFrame, metrics: list[str]) -> DataFrame:
    """run_id, mode, task_id, success, metric, value."""
    keys = ["run_id", "mode", "task_id", "success"]
    return runs.select(*keys, *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot(keys, metrics, "metric", "value")


def by_mode(runs: DataFrame) -> DataFrame:
    """mode, runs, eligible, tasks, successes and rates; of runs that may be compared."""
    eligible = F.coalesce("eligible", F.lit(True))
    known = eligible & F.col("validation_passed").isNotNull()
    return runs.groupBy("mode").agg(
        F.count("*").alias("runs"), F.count_if(eligible).alias("eligible_runs"), F.countDistinct("task_id").alias("tasks"), F.countDistinct(F.when(eligible, F.col("task_id"))).alias("eligible_tasks"),
        F.count_if(eligible & F.col("success")).alias("successes"), F.round(F.count_if(eligible & F.col("success")) / F.nullif(F.count_if(eligible), F.lit(0)), 6).alias("success_rate"),
        F.count_if(known & F.col("validation_passed")).alias("validation_passes"), F.count_if(known).alias("validation_runs"),
        F.round(F.count_if(known & F.col("validation_passed")) / F.nullif(F.count_if(known), F.lit(0)), 6).alias("validation_pass_rate"),
    )


def by_task(runs: DataFrame, baseline: str, other: str) -> DataFrame:
    """task_id, both modes' success rates, regressed."""
    eligible = runs.where(F.coalesce("eligible", F.lit(True)))
    rate = lambda mode: F.round(F.avg(F.when(F.col("mode") == mode, F.col("success").cast("int"))), 6)
    per = eligible.groupBy("task_id").agg(rate(baseline).alias("baseline_rate"), rate(other).alias("other_rate"))
    return per.withColumn("regressed", F.coalesce(F.col("other_rate") < F.col("baseline_rate"), F.lit(False)))


def by_task_and_mode(runs: DataFrame, modes: list[str]) -> DataFrame:
    """task_id, mode, runs, successes, success_rate, validation_passes of every task in every mode; without runs that may be compared zeros and a null rate."""
    ok = F.coalesce("eligible", F.lit(True)) & F.col("mode").isin(modes)
    each = runs.select("task_id", F.when(ok, F.col("mode")).alias("_mode"), "success", "validation_passed", F.explode(F.array(*map(F.lit, modes))).alias("mode"))
    own = F.coalesce(F.col("_mode") == F.col("mode"), F.lit(False))
    n, won = F.count_if(own), F.count_if(own & F.coalesce("success", F.lit(False)))
    return each.groupBy("task_id", "mode").agg(n.alias("runs"), won.alias("successes"), F.round(won / F.nullif(n, F.lit(0)), 6).alias("success_rate"), F.count_if(own & F.coalesce("validation_passed", F.lit(False))).alias("validation_passes"))


def paired(runs: DataFrame, baseline: str, other: str, identity: list[str]) -> DataFrame:
    """One row: paired_configuration, whether both modes hold the same multiset of identities, and any at all."""
    eligible = runs.where(F.coalesce("eligible", F.lit(True)))
    signature = F.sha2(F.to_json(F.struct(*identity), {"ignoreNullFields": "false"}), 256)
    balance = F.sum(F.when(F.col("mode") == baseline, 1).when(F.col("mode") == other, -1).otherwise(0))
    per = eligible.where(F.col("mode").isin(baseline, other)).groupBy(signature.alias("s")).agg(balance.alias("balance"), F.count_if(F.col("mode") == baseline).alias("n"))
    return per.agg((F.coalesce(F.sum("n"), F.lit(0)) > 0).alias("_any"), F.coalesce(F.max(F.abs("balance")), F.lit(0)).alias("_off")).select((F.col("_any") & (F.col("_off") == 0)).alias("paired_configuration"))


def reductions(runs: DataFrame, metrics: list[str], baseline: str, other: str, identity: list[str]) -> DataFrame:
    """metric, reduction_pct: of the other mode's mean against the baseline's; null unless the runs are paired and every one has the metric."""
    eligible = runs.where(F.coalesce("eligible", F.lit(True)))
    of = lambda f, mode: f(F.when(F.col("mode") == mode, F.col("value")))
    per = long(eligible, metrics).groupBy("metric").agg(
        F.round(of(F.avg, baseline), 3).alias("b"), F.round(of(F.avg, other), 3).alias("o"), of(F.count, baseline).alias("nb"), of(F.count, other).alias("no"),
        F.count_if(F.col("mode") == baseline).alias("rb"), F.count_if(F.col("mode") == other).alias("ro"),
    )
    whole = F.col("paired_configuration") & (F.col("nb") == F.col("rb")) & (F.col("no") == F.col("ro")) & (F.col("nb") > 0) & (F.col("no") > 0) & (F.col("b") != 0)
    one = paired(runs, baseline, other, identity)  # one row
    return per.join(F.broadcast(one)).select("metric", F.round(F.when(whole, 100 * (F.col("b") - F.col("o")) / F.col("b")), 3).alias("reduction_pct"))


def fell(events: DataFrame, value: str, *, by: str = "run_id", order: str = "sequence") -> DataFrame:
    """by, fell: how often a cumulative value is below the one before it."""
    w = Window.partitionBy(by).orderBy(order)
    return events.withColumn("_before", F.lag(value).over(w)).groupBy(by).agg(F.count_if(F.col(value) < F.col("_before")).alias("fell"))


def capped(events: DataFrame, *, max_calls: int, timeout_ms: float) -> DataFrame:
    """Events up to a run's limits: those after the timeout, and those from the call beyond the limit on, are left out."""
    calls = F.sum((F.col("type") == "tool_call").cast("int")).over(Window.partitionBy("run_id").orderBy("sequence").rowsBetween(Window.unboundedPreceding, 0))
    return events.withColumn("_calls", calls).where((F.col("_calls") <= max_calls) & (F.coalesce("elapsed_ms", F.lit(0.0)) <= timeout_ms)).drop("_calls")


def markdown(modes: DataFrame, changes: DataFrame) -> str:
    """A report of aggregates: one row a mode and a metric."""
    out = ["| mode | runs | successes | success rate |", "| --- | --- | --- | --- |"]
    out += [f"| {r['mode']} | {r['runs']} | {r['successes']} | {r['success_rate']} |" for r in modes.orderBy("mode").collect()]
    out += ["", "| metric | reduction % |", "| --- | --- |"]
    out += [f"| {r['metric']} | {r['reduction_pct']} |" for r in changes.orderBy("metric").collect()]
    return "\n".join(out)


def schedule(tasks: DataFrame, modes: list[str], repetitions: int, *, order: str = "alternating", seed: int = 0) -> DataFrame:
    """nth, task_id, mode, repetition of tasks(task_id, place): modes turn round at every other task and repetition.

    order "random" sorts by a seeded hash, so it is the same on every run and cluster.
    """
    each = tasks.select("task_id", "place", F.explode(F.sequence(F.lit(0), F.lit(repetitions - 1))).alias("repetition"))
    forward = F.array(*map(F.lit, modes))
    turned = F.when((F.col("place") + F.col("repetition")) % 2 == 1, F.reverse(forward)).otherwise(forward) if order == "alternating" else forward
    rows = each.select("task_id", "place", "repetition", F.posexplode(turned).alias("slot", "mode"))
    key = [F.xxhash64("task_id", "mode", "repetition", F.lit(seed)), F.col("task_id"), F.col("mode"), F.col("repetition")] if order == "random" else [F.col("repetition"), F.col("place"), F.col("slot"), F.col("task_id")]
    names = [f"_k{i}" for i in range(len(key))]
    rows = rows.select("task_id", "mode", "repetition", *[k.alias(n) for k, n in zip(key, names)])
    # Ranges are stored so that their bounds are drawn once, then counted; only a range is ordered in one task.
    ranged = stored(rows.repartitionByRange(*names).withColumn("_part", F.spark_partition_id()), "schedule")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = ranged.groupBy("_part").agg(F.count("*").alias("n")).select("_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_base"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*names))
    return ranged.withColumn("_own", own).join(F.broadcast(base), "_part").select((F.col("_base") + F.col("_own")).cast("int").alias("nth"), "task_id", "mode", "repetition")  # base: a row a range

"""Retrieval quality: scores of ranked results, their means, and comparison with a baseline."""

from __future__ import annotations

import math
import time
from collections.abc import Callable
from statistics import median

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import normal
from ..functions.stats import with_quantiles

METRICS = ["recall_at_1", "recall_at_5", "recall_at_10", "precision_at_5", "mean_reciprocal_rank", "exact_symbol_recall", "related_test_recall"]


def _recall(expected: Column, ranked: Column, k: int) -> Column:
    hits = F.size(F.array_intersect(expected, F.slice(ranked, 1, k)))
    return F.when(F.size(expected) == 0, F.lit(1.0)).otherwise(hits / F.size(expected))


def _set_recall(expected: Column, found: Column) -> Column:
    """Null where nothing is expected: that isn't zero."""
    return F.when(F.size(expected) > 0, F.size(F.array_intersect(expected, found)) / F.size(expected))


def paths(values: str | Column) -> Column:
    """Normalised and distinct, in their order."""
    values = F.col(values) if isinstance(values, str) else values
    return F.filter(F.array_distinct(F.transform(values, lambda p: normal(p))), lambda p: p != "")


def scores(results: DataFrame) -> DataFrame:
    """results(…, ranked, symbols, tests, expected_files, expected_symbols, expected_tests) with the metrics, rounded to six digits."""
    expected, ranked = F.array_distinct("expected_files"), F.array_distinct("ranked")
    first = F.array_min(F.filter(F.transform(expected, lambda e: F.array_position(ranked, e)), lambda p: p > 0))
    found = {
        "recall_at_1": _recall(expected, ranked, 1), "recall_at_5": _recall(expected, ranked, 5), "recall_at_10": _recall(expected, ranked, 10),
        "precision_at_5": F.size(F.array_intersect(expected, F.slice(ranked, 1, 5))) / F.lit(5), "mean_reciprocal_rank": F.coalesce(F.lit(1.0) / first, F.lit(0.0)),
        "exact_symbol_recall": _set_recall(F.array_distinct("expected_symbols"), F.col("symbols")), "related_test_recall": _set_recall(F.array_distinct("expected_tests"), F.col("tests")),
    }
    return results.select("*", *[F.round(v, 6).alias(k) for k, v in found.items()])


def means(scored: DataFrame, by: list[str]) -> DataFrame:
    """Means by mode over what isn't null."""
    return scored.groupBy(*by).agg(*[F.round(F.avg(m), 6).alias(m) for m in METRICS])


def resources(runs: DataFrame, by: list[str], *, latency: str = "latency_ms", returned: str = "returned_tokens") -> DataFrame:
    """latency p50 (the median) and p95 (by nearest rank), and mean and largest number of returned tokens."""
    found = with_quantiles(runs, by, latency, {"p50": ("median", 0.5), "p95": ("nearest", 0.95)}, F.avg(returned).alias("mean"), F.max(returned).alias("returned_tokens_max"))
    return found.select(*by, F.round("p50", 3).alias("latency_ms_p50"), F.round("p95", 3).alias("latency_ms_p95"), F.round("mean", 3).alias("returned_tokens_mean"), "returned_tokens_max")


#: The ways of retrieval that a benchmark compares.
RETRIEVALS = ["ripgrep", "exact", "symbol", "semantic", "hybrid", "hybrid_symbols", "hybrid_dependencies"]
_RESULT = "query_id string, mode string, ranked array<string>, symbols array<string>, tests array<string>, latency_ms double, returned_tokens long, expected_files array<string>, expected_symbols array<string>, expected_tests array<string>"


def run(manifest: DataFrame, search: Callable[[dict, str, int], DataFrame], *, modes: list[str], k: int = 10, iterations: int = 1) -> DataFrame:
    """query_id, mode, what was expected and found, latency_ms (the median of the iterations), returned_tokens and all scores.

    search(query, mode, k) gives a page (file, symbol, test, ord) of one query of a manifest. A benchmark's queries are a
    short stated list, each is a Spark job of its own to be timed, so the driver goes through them.
    """
    if k < 10 or iterations < 1 or not modes:
        raise ValueError("a benchmark needs k of 10 or more, an iteration and a mode")
    rows = []
    for mode in modes:
        for q in manifest.toLocalIterator():
            took = []
            for _ in range(iterations):
                began = time.perf_counter()
                page = search(q.asDict(), mode, k).orderBy("ord").collect()
                took.append((time.perf_counter() - began) * 1000)
            tokens = math.ceil(sum(len(str(v).encode()) + 4 for r in page for v in r if v is not None) / 4)
            lists = ([r[c] for r in page if r[c] is not None] for c in ("file", "symbol", "test"))
            rows.append((q["id"], mode, *lists, round(median(took), 3), tokens, *(q[c] or [] for c in ("expected_files", "expected_symbols", "expected_tests"))))
    found = manifest.sparkSession.createDataFrame(rows, _RESULT)
    return scores(found.select("query_id", "mode", *[paths(c).alias(c) for c in ("ranked", "tests", "expected_files", "expected_tests")], *[F.array_distinct(F.transform(c, lambda x: F.lower(F.trim(x)))).alias(c) for c in ("symbols", "expected_symbols")], "latency_ms", "returned_tokens"))


def summary(results: DataFrame) -> DataFrame:
    """A row a mode: means of the scores, and what the mode took."""
    return means(results, ["mode"]).join(resources(results, ["mode"]), "mode")


def long(table: DataFrame, metrics: list[str], by: str = "mode") -> DataFrame:
    """mode, metric, value."""
    return table.unpivot([by], metrics, "metric", "value")


def compare(current: DataFrame, baseline: DataFrame, *, max_drop: float = 0.0, max_increase_pct: dict[str, float] | None = None, max_returned_tokens: int | None = None) -> DataFrame:
    """Regressions: mode, metric, baseline, current, kind, increase_pct, from long tables (mode, metric, value). Only modes in both count.

    A quality metric may drop by max_drop; a resource may grow by its percentage, if given and its baseline is above zero.
    """
    both = current.withColumnRenamed("value", "current").join(baseline.withColumnRenamed("value", "baseline"), ["mode", "metric"])
    none = F.lit(None).cast("double")
    drop = both.where(F.col("metric").isin(METRICS) & (F.col("baseline") - F.col("current") > max_drop))
    rows = drop.select("mode", "metric", "baseline", "current", F.lit("quality_drop").alias("kind"), none.alias("increase_pct"))
    pct = (F.col("current") - F.col("baseline")) / F.col("baseline") * 100
    for metric, limit in (max_increase_pct or {}).items():
        grown = both.where((F.col("metric") == metric) & (F.col("baseline") > 0)).where(pct > limit)
        rows = rows.unionByName(grown.select("mode", "metric", "baseline", "current", F.lit("resource_increase").alias("kind"), F.round(pct, 3).alias("increase_pct")))
    if max_returned_tokens is not None:
        over = both.where((F.col("metric") == "returned_tokens_max") & (F.col("current") > max_returned_tokens))
        rows = rows.unionByName(over.select("mode", "metric", none.alias("baseline"), "current", F.lit("output_budget").alias("kind"), none.alias("increase_pct")))
    return rows.orderBy("mode", "metric")


def gate(current: DataFrame, baseline: DataFrame, *, max_drop: float = 0.0, max_token_increase_pct: float = 10.0, max_returned_tokens: int = 1024) -> bool:
    """Whether nothing regressed beyond the gate's limits."""
    return compare(current, baseline, max_drop=max_drop, max_increase_pct={"returned_tokens_max": max_token_increase_pct}, max_returned_tokens=max_returned_tokens).isEmpty()


def timings(samples: DataFrame, by: list[str], seconds: str) -> DataFrame:
    """p50 (the median), p95 and p99 (by nearest rank) and min in milliseconds."""
    ms = samples.select(*by, (F.col(seconds) * 1000).alias("_ms"))
    found = with_quantiles(ms, by, "_ms", {"p50": ("median", 0.5), "p95": ("nearest", 0.95), "p99": ("nearest", 0.99)}, F.min("_ms").alias("min"))
    return found.select(*by, *[F.round(c, 3).alias(c) for c in ("p50", "p95", "p99", "min")])

"""Unified search: routing of requests, merging of engines' hits, related files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.paths import is_configuration, is_test
from ..functions.text import is_natural_language

MODES, INTENTS = ("auto", "exact", "pattern", "semantic", "hybrid", "symbol", "path"), ("locate", "understand", "modify", "debug", "audit")
#: Warnings of the routing.
WARNINGS = {
    "symbol": "Symbol index is not ready; using exact pattern search.",
    "path": "Dedicated path search is not available yet; using exact pattern search.",
    "fallback": "Semantic index is not ready; using exact pattern search.",
    "semantic": "Semantic index is not ready.",
    "hybrid": "Semantic index is not ready; hybrid search will use exact results only.",
}
#: Files, lines a file and expansion by context mode.
CONTEXTS = {"compact": (5, 1, False), "normal": (8, 2, True), "full": (8, 2, True)}


def route(query: str | Column, mode: str | Column, intent: str | Column, semantic_ready: Column, symbol_ready: Column) -> tuple[Column, Column]:
    """(effective mode, warning) of requests that are rows. Unknown modes and intents raise an error."""
    query, mode, intent = (F.col(x) if isinstance(x, str) else x for x in (query, mode, intent))
    mode, intent = F.lower(F.trim(F.coalesce(F.nullif(mode, F.lit("")), F.lit("auto")))), F.lower(F.trim(F.coalesce(F.nullif(intent, F.lit("")), F.lit("understand"))))
    deep = intent.isin("modify", "debug")
    meant = deep | F.coalesce(is_natural_language(query), F.lit(False))
    auto = F.when(deep & semantic_ready, "hybrid").when(meant & semantic_ready, "semantic").otherwise("pattern")
    wrong = F.raise_error(F.concat(F.lit("unsupported mode or intent: "), mode, F.lit(", "), intent)).cast("string")
    effective = (
        F.when(~mode.isin(*MODES) | ~intent.isin(*INTENTS), wrong)
        .when(mode.isin("exact", "path"), "pattern")
        .when(mode == "symbol", F.when(symbol_ready, "symbol").otherwise("pattern"))
        .when(mode == "auto", auto)
        .otherwise(mode)
    )
    warning = (
        F.when((mode == "symbol") & ~symbol_ready, WARNINGS["symbol"])
        .when(mode == "path", WARNINGS["path"])
        .when((mode == "auto") & meant & ~semantic_ready, WARNINGS["fallback"])
        .when((mode == "semantic") & ~semantic_ready, WARNINGS["semantic"])
        .when((mode == "hybrid") & ~semantic_ready, WARNINGS["hybrid"])
    )
    return effective, warning


def route_one(spark, query: str, mode: str = "auto", intent: str = "understand", *, semantic_ready: bool = False, symbol_ready: bool = False) -> tuple[str, str | None]:
    """The same for one request, by the same expressions."""
    effective, warning = route(F.lit(query), F.lit(mode), F.lit(intent), F.lit(semantic_ready), F.lit(symbol_ready))
    return tuple(spark.range(1).select(effective.alias("e"), warning.alias("w")).first())


def pattern_hits(matched: DataFrame, *, context: str = "normal") -> DataFrame:
    """Files' matches as hits: the first lines of the first files after the boost's order; score 1 + boost."""
    files, lines, _ = CONTEXTS[context]
    first = matched.orderBy(F.col("git_boost").desc(), "file_id").limit(files)
    rows = first.select(F.col("path").alias("file"), "git_boost", "file_id", F.explode(F.slice("matches", 1, lines)).alias("m"))
    return rows.select("file", F.col("m.line").alias("line_start"), F.col("m.line").alias("line_end"), F.round(1 + F.col("git_boost"), 4).alias("score"), F.col("m.content").alias("snippet"), F.lit("pattern").alias("engine"), "file_id")


def hybrid(pattern: DataFrame, semantic: DataFrame, *, file: str = "file") -> DataFrame:
    """Pattern hits, then semantic hits in files without one: `source` tells which, and scores aren't compared."""
    rest = semantic.join(pattern.select(file).distinct(), file, "left_anti")
    return pattern.withColumn("source", F.lit(0)).unionByName(rest.withColumn("source", F.lit(1)), allowMissingColumns=True)


def first_by(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """Of rows with equal keys the first."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def primary(hits: DataFrame, *, file: str = "file") -> DataFrame:
    """Hits outside tests and configuration, or all where there are none. hits are few (a result page); whether there are is one row."""
    marked = hits.withColumn("_primary", ~(is_test(file) | is_configuration(file)))
    any_ = marked.agg(F.coalesce(F.max("_primary"), F.lit(False)).alias("_any"))
    return marked.join(F.broadcast(any_)).where("_primary or not _any").drop("_primary", "_any")


def related(hits: DataFrame, primary_hits: DataFrame, graph: DataFrame, *, file: str = "file", order: str = "ord", tests: bool = True, dependencies: bool = True, files: int = 5) -> DataFrame:
    """relation, file, reason, hops: configuration and tests among the hits, and neighbours in the graph of the first primary files."""
    rows = hits.where(is_configuration(file)).select(F.lit("configuration").alias("relation"), F.col(file).alias("file"), F.lit("configuration-like path matched the query").alias("reason"), F.lit(None).cast("int").alias("hops"), F.col(order).cast("long").alias("ord"))
    if tests:
        rows = rows.unionByName(hits.where(is_test(file)).select(F.lit("tests").alias("relation"), F.col(file).alias("file"), F.lit("test-like path matched the query").alias("reason"), F.lit(None).cast("int").alias("hops"), F.col(order).cast("long").alias("ord")))
    if dependencies:
        first = primary_hits.groupBy(F.col(file).alias("of")).agg(F.min(order).alias("ord")).orderBy("ord").limit(files)
        out = graph.join(F.broadcast(first), graph["src"] == first["of"]).select(F.lit("dependencies").alias("relation"), F.col("dst").alias("file"), F.lit("direct import of a primary result").alias("reason"), F.lit(None).cast("int").alias("hops"), F.col("ord").cast("long").alias("ord"))
        in_ = graph.join(F.broadcast(first), graph["dst"] == first["of"]).select(F.lit("callers").alias("relation"), F.col("src").alias("file"), F.coalesce("reason", F.lit("direct importer of a primary result")).alias("reason"), F.lit(1).alias("hops"), F.col("ord").cast("long").alias("ord"))
        rows = rows.unionByName(out).unionByName(in_)
    return first_by(rows, ["relation", "file"], ["ord", "reason"])


def symbols_first(symbol_hits: DataFrame, other_hits: DataFrame, k: int, *, file: str = "file", order: str = "ord") -> DataFrame:
    """Symbol hits, then the others; a file once, by its first hit; k files. Ranks are pruned before they meet."""
    both = symbol_hits.select(F.lower(file).alias("_key"), file, order, F.lit(0).alias("source")).unionByName(other_hits.select(F.lower(file).alias("_key"), file, order, F.lit(1).alias("source")))
    return first_by(both.where("_key <> ''"), ["_key"], ["source", order]).drop("_key").orderBy("source", order).limit(k)

"""Scan for a catalogue of signals: literal needles, grouped by category."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import fold, folded, line_end_trimmed, snippet

#: Id, category, label, confidence, needles.
CATALOGUE = [
    ("legacy-web-config", "legacy-dotnet", "web.config present", "high", ["web.config"]),
    ("legacy-global-asax", "legacy-dotnet", "Global.asax present", "high", ["Global.asax"]),
    ("legacy-packages-config", "legacy-dotnet", "packages.config present", "high", ["packages.config"]),
    ("legacy-system-web", "legacy-dotnet", "System.Web usage", "medium", ["System.Web"]),
    ("legacy-system-web-mvc", "legacy-dotnet", "System.Web.Mvc usage", "medium", ["System.Web.Mvc"]),
    ("legacy-app-start", "legacy-dotnet", "App_Start directory", "high", ["App_Start"]),
    ("appsettings-json", "config", "appsettings.json present", "high", ["appsettings.json"]),
    ("connection-strings", "config", "connectionStrings usage", "medium", ["connectionStrings"]),
    ("app-config", "config", "app.config present", "high", ["app.config"]),
    ("sql-connection", "sql", "SqlConnection usage", "high", ["SqlConnection"]),
    ("raw-sql-execute", "sql", "Raw SQL execution", "medium", ["ExecuteSql", "ExecuteSqlRaw", "FromSqlRaw", "FromSql"]),
    ("sql-command", "sql", "SqlCommand usage", "high", ["SqlCommand"]),
    ("sync-over-async-result", "async-risk", ".Result (sync-over-async)", "medium", [".Result"]),
    ("sync-over-async-wait", "async-risk", ".Wait() (sync-over-async)", "medium", [".Wait()"]),
    ("broad-catch-exception", "exception-risk", "catch (Exception) usage", "medium", ["catch (Exception"]),
    ("empty-catch-candidate", "exception-risk", "catch block candidate", "low", ["catch {"]),
    ("add-singleton", "di", "AddSingleton usage", "high", ["AddSingleton"]),
    ("add-scoped", "di", "AddScoped usage", "high", ["AddScoped"]),
    ("add-transient", "di", "AddTransient usage", "high", ["AddTransient"]),
    ("service-locator-getservice", "di", "GetService (service locator)", "medium", ["GetService"]),
    ("service-locator-getrequiredservice", "di", "GetRequiredService (service locator)", "medium", ["GetRequiredService"]),
    ("test-project", "tests", "Test project present", "medium", [".Tests", "xunit", "NUnit", "MSTest"]),
]
TOP, TOP_LIMIT, TOTAL, SNIPPET, SHORT_SNIPPET = 10, 20, 200, 300, 160


def catalogue(spark: SparkSession, entries=CATALOGUE) -> DataFrame:
    rows = [(i, *e) for i, e in enumerate(entries)]
    return spark.createDataFrame(rows, "ord int, id string, category string, label string, confidence string, queries array<string>")


def scan(files: DataFrame, entries=CATALOGUE, *, categories: list[str] | None = None, top_k: int = TOP, compact: bool = False, per_file: int = 10, max_files: int = 50, text_col: str = "text") -> DataFrame:
    """ord, id, category, file_id, path, line, content: each signal's first top_k lines.

    A signal's needles are searched in turn, each over its first max_files files with per_file lines; a line counts once
    for a signal. One pass over the texts tests every needle; the ranks then prune before they shuffle.
    """
    chosen = [(i, e) for i, e in enumerate(entries) if categories is None or e[1] in categories]
    needles = [(i, e[0], e[1], q, folded(text)) for i, e in chosen for q, text in enumerate(e[4])]
    if not needles:
        return files.sparkSession.createDataFrame([], "ord int, id string, category string, file_id long, path string, line int, content string")
    table = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(n).alias("id"), F.lit(c).alias("category"), F.lit(q).alias("q"), F.lit(t).alias("needle")) for i, n, c, q, t in needles])
    text = F.coalesce(F.col(text_col), F.lit(""))
    present = F.filter(table, lambda n: F.contains(F.col("folded"), n["needle"]))
    rows = files.select("file_id", "path", text.alias("text"), fold(text).alias("folded")).withColumn("present", present).where(F.size("present") > 0)
    rows = rows.select("file_id", "path", F.split("text", "\n", -1).alias("lines"), F.split("folded", "\n", -1).alias("search"), F.explode("present").alias("n"))
    hit = F.transform("search", lambda x, i: F.when(F.contains(x, F.col("n.needle")), F.struct(i.alias("i"), F.get("lines", i).alias("content"))))
    places = F.slice(F.filter(hit, lambda h: h.isNotNull()), 1, per_file)
    # From here on a row holds its few matching lines only, not its file.
    rows = rows.select("file_id", "path", "n", places.alias("places")).where(F.size("places") > 0)
    first_files = Window.partitionBy("n.ord", "n.q").orderBy("file_id")
    rows = rows.withColumn("nth", F.row_number().over(first_files)).where(F.col("nth") <= max_files)
    rows = rows.select("n.ord", "n.id", "n.category", "n.q", "file_id", "path", F.inline("places"))
    rows = rows.withColumn("once", F.row_number().over(Window.partitionBy("ord", "file_id", "i").orderBy("q"))).where("once = 1")
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("ord").orderBy("q", "file_id", "i"))).where(F.col("rank") <= min(top_k, TOP_LIMIT))
    shown = snippet(line_end_trimmed(F.col("content")), SHORT_SNIPPET if compact else SNIPPET)
    return ranked.select("ord", "id", "category", "rank", "file_id", "path", (F.col("i") + 1).alias("line"), shown.alias("content"))


def capped(found: DataFrame, total: int = TOTAL) -> DataFrame:
    """The first `total` matches over all signals in catalogue order. At most TOP_LIMIT rows a signal come in."""
    return found.withColumn("n", F.row_number().over(Window.orderBy("ord", "rank"))).where(F.col("n") <= total).drop("n")


def by_category(found: DataFrame) -> DataFrame:
    """category, signals, matches."""
    return found.groupBy("category").agg(F.countDistinct("id").alias("signals"), F.count("*").alias("matches"))

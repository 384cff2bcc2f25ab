"""JSON sources: benchmark manifests, evaluation tasks, runs and trajectories, each with a declared schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import redact
from ..schemas import TRAJECTORY

QUERIES = "id string, query string, exact_query string, symbol_query string, expected_files array<string>, expected_symbols array<string>, expected_tests array<string>"
MANIFEST = f"schema_version int, name string, repository string, queries array<struct<{', '.join(x.replace(' ', ': ', 1) for x in QUERIES.split(', '))}>>"
TASK = (
    "id: string, repository: string, base_commit: string, description: string, language: string, category: string, relevant_files: array<string>, "
    "expected_changed_files: array<string>, validation: array<struct<argv: array<string>, timeout_seconds: int>>"
)
RUN = (
    "schema_version int, identity struct<task_id: string, mode: string, run_id: string, task_definition_hash: string, repository: string, resolved_commit: string, model: string, runner: string, runner_config: string>, "
    "outcome struct<success: boolean, eligible_for_success_comparison: boolean, validation_passed: boolean>, "
    "tokens map<string, double>, exploration map<string, double>, timing map<string, double>, patch map<string, double>"
)
EVENT = "type string, elapsed_ms double, tool string, category string, arguments map<string,string>, result_size_bytes long, file_paths array<string>, token_usage map<string,long>, usage_semantics string, milestone string, data map<string,string>"


def tidied(values: Column) -> Column:
    """Strings of a list without surrounding blanks, empty ones left out."""
    return F.filter(F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != "")


def checked(rows: DataFrame, good: Column, message: str) -> DataFrame:
    """rows; reading one that isn't good raises an error."""
    return rows.where(F.when(good, True).otherwise(F.raise_error(F.lit(message)).cast("boolean")))


def _unique(rows: DataFrame, key: str, message: str) -> DataFrame:
    n = F.count("*").over(Window.partitionBy(key))
    return checked(rows.withColumn("_n", n), (F.col("_n") == 1) & (F.coalesce(F.trim(F.col(key)), F.lit("")) != ""), message).drop("_n")


def manifest(spark: SparkSession, path: str, *, version: int = 1) -> DataFrame:
    """One row for each query of a benchmark manifest. Other versions, missing ids and repeated ids are errors."""
    rows = checked(spark.read.schema(MANIFEST).option("multiLine", True).json(path), F.col("schema_version") == version, "unknown manifest version")
    rows = rows.select("name", "repository", F.inline("queries"))
    for c in ("expected_files", "expected_symbols", "expected_tests"):
        rows = rows.withColumn(c, tidied(F.col(c)))
    return _unique(rows, "id", "query ids must be present and distinct")


def tasks(spark: SparkSession, path: str, *, version: int = 1) -> DataFrame:
    """One row for each evaluation task, validated likewise; every validation command has words and a positive time limit."""
    rows = checked(spark.read.schema(f"schema_version int, tasks array<struct<{TASK}>>").option("multiLine", True).json(path), F.col("schema_version") == version, "unknown task version")
    rows = rows.select(F.inline("tasks"))
    commands = F.forall(F.coalesce("validation", F.array().cast("array<struct<argv:array<string>,timeout_seconds:int>>")), lambda v: (F.size(v["argv"]) > 0) & F.coalesce(v["timeout_seconds"] > 0, F.lit(True)))
    rows = checked(rows, commands & F.col("base_commit").isNotNull() & F.col("repository").isNotNull(), "a task lacks its repository, commit or commands")
    return _unique(rows.withColumn("relevant_files", tidied(F.col("relevant_files"))).withColumn("expected_changed_files", tidied(F.col("expected_changed_files"))), "id", "task ids must be present and distinct")


def runs(spark: SparkSession, path: str, *, version: int = 1) -> DataFrame:
    """Run records by line; blank lines are passed over, another version is an error."""
    return checked(spark.read.schema(RUN).json(path), F.col("schema_version") == version, "unknown run version")


def trajectory(lines: DataFrame) -> DataFrame:
    """Events from lines(run_id, sequence, value): a line that isn't JSON becomes a warning, and a run without a good final event gets one."""
    parsed = F.from_json("value", EVENT + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    rows = lines.where(F.trim("value") != "").select("run_id", "sequence", parsed.alias("e"), "value")
    bad = F.col("e._bad").isNotNull() | F.col("e").isNull() | F.col("e.type").isNull()
    warning = F.from_json(F.lit('{"type": "tool_result", "category": "warning", "elapsed_ms": 0}'), EVENT)
    event = F.when(bad, warning.withField("data", F.create_map(F.lit("warning"), F.substring("value", 1, 200)))).otherwise(F.col("e").dropFields("_bad"))
    rows = rows.select("run_id", "sequence", event.alias("e")).select("run_id", "sequence", "e.*")
    last = rows.groupBy("run_id").agg(F.max("sequence").alias("sequence"), F.max("elapsed_ms").alias("elapsed_ms"), F.max((F.col("type") == "final").cast("int")).alias("ended"))
    final = last.where("ended = 0").select("run_id", (F.col("sequence") + 1).alias("sequence"), F.lit("final").alias("type"), "elapsed_ms", F.create_map(F.lit("status"), F.lit("missing final event")).alias("data"))
    names = [x.split()[0] for x in TRAJECTORY.split(", ")]
    return rows.unionByName(final, allowMissingColumns=True).select(*[n for n in names])


#: Keys whose values are never kept.
SECRET_KEYS = ["authorization", "api_key", "apikey", "password", "secret", "token"]


def sanitized(arguments: Column) -> Column:
    """A map without its secrets: values of secret keys are replaced, others redacted."""
    return F.transform_values(arguments, lambda k, v: F.when(F.lower(k).isin(SECRET_KEYS), F.lit("[REDACTED]")).otherwise(redact(v)))


def append_json(rows: DataFrame, path: str) -> None:
    """Adds rows to a folder of JSON lines, as one commit; columns are sorted by name."""
    rows.select(*sorted(rows.columns)).write.mode("append").json(path)


#: What tells a command's operations, in lower case, and a path within a text.
OPERATIONS = [
    ("test", r"\b(dotnet\s+(?:test|build|run)|pytest|npm\s+test)\b"),
    ("search", r"\b(rg|grep|findstr|select-string)\b|\bgit\s+grep\b"),
    ("file_read", r"\b(get-content|cat|type|head|tail|bat)\b|\bsed\s+-n\b"),
    ("edit", r"\b(apply_patch|set-content|add-content)\b"),
]
PATHS = r"""(?<![A-Za-z0-9_])([A-Za-z]:[\\/][^\s"']+|(?:[A-Za-z0-9_.-]+[\\/])+[A-Za-z0-9_.?*-]+|[A-Za-z0-9_.-]+\.(?:cs|csproj|sln|json|toml|ya?ml|md|py))"""


def operations(command: Column) -> Column:
    """What a shell command does, one label or more: a test, a search, a file read, an edit, else other."""
    low = F.lower(command)
    found = F.array_compact(F.array(*[F.when(F.rlike(low, F.lit(p)), F.lit(name)) for name, p in OPERATIONS]))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("other")))


def normalized_agent_events(lines: DataFrame) -> DataFrame:
    """Events of an agent's JSON stream, lines(run_id, sequence, value), as trajectory rows: an item's start is a call, its end a result, a turn's end usage or the final event.

    An item that only ends gives both; whether its start was seen comes from a window over the item.
    """
    item = "id: string, type: string, command: string, aggregated_output: string, exit_code: int, text: string, tool: string, server: string, status: string, changes: array<struct<path: string, kind: string>>"
    schema = f"type string, item struct<{item}>, usage map<string, long>, elapsed_ms double"
    rows = lines.select("run_id", "sequence", F.from_json("value", schema).alias("e")).where("e is not null")
    rows = rows.select("run_id", "sequence", "e.*")
    seen = F.max((F.col("type") == "item.started").cast("int")).over(Window.partitionBy("run_id", "item.id").orderBy("sequence").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_seen", F.when(F.col("item.id").isNotNull(), F.coalesce(seen, F.lit(0))))
    ops = operations(F.coalesce("item.command", F.lit("")))
    category = F.when(F.col("item.type") == "file_change", "edit").when(F.col("item.type") == "command_execution", F.get(ops, F.lit(0))).otherwise(F.coalesce("item.type", F.lit("other")))
    paths = F.coalesce(F.transform("item.changes", lambda c: c["path"]), F.regexp_extract_all(F.coalesce("item.command", F.lit("")), F.lit(PATHS), F.lit(1)))
    tool = F.coalesce("item.tool", "item.type")
    none = F.lit(None)

    def event(type_: str, size: Column = none, usage: Column = none) -> Column:
        return F.struct(F.lit(type_).alias("type"), size.cast("long").alias("result_size_bytes"), usage.cast("map<string,bigint>").alias("token_usage"))

    call, result = event("tool_call"), event("tool_result", F.octet_length(F.coalesce("item.aggregated_output", "item.text", F.lit(""))))
    acts = F.coalesce(~F.col("item.type").isin("agent_message", "reasoning", "todo_list"), F.lit(False))
    out = (
        F.when((F.col("type") == "item.started") & acts, F.array(call))
        .when((F.col("type") == "item.completed") & acts, F.when(F.col("_seen") == 1, F.array(result)).otherwise(F.array(call, result)))
        .when(F.col("type") == "turn.completed", F.array(event("usage", usage=F.col("usage")), event("final")))
        .when(F.col("type").isin("turn.failed", "error"), F.array(event("final")))
    )
    rows = rows.select("run_id", "sequence", "elapsed_ms", tool.alias("tool"), category.alias("category"), ops.alias("operations"), paths.alias("file_paths"), F.posexplode(out).alias("_nth", "x"))
    return rows.select("run_id", (F.col("sequence") * 2 + F.col("_nth")).alias("sequence"), "x.type", "elapsed_ms", "tool", "category", "operations", "x.result_size_bytes", "file_paths", "x.token_usage")


def existing_paths(events: DataFrame, files: DataFrame) -> DataFrame:
    """events with file_paths cut down to those that exist in files(path); the order stays."""
    each = events.select("run_id", "sequence", F.posexplode(F.array_distinct("file_paths")).alias("nth", "path")).join(files.select("path").distinct(), "path", "left_semi")
    kept = each.groupBy("run_id", "sequence").agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "path"))), lambda x: x["path"]).alias("_kept"))
    return events.join(kept, ["run_id", "sequence"], "left").withColumn("file_paths", F.coalesce("_kept", F.array().cast("array<string>"))).drop("_kept")

"""File changes as a stream: debounced, then merged into tables by micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.paths import extension, is_skipped

QUIET = "2 seconds"


def debounced(events: DataFrame, *, key: str = "key", time: str = "ts", quiet: str = QUIET, watermark: str | None = None) -> DataFrame:
    """key, start, end, events: a row for each burst of a key that `quiet` without an event ends.

    The same for tables and streams; a stream emits a burst when the watermark has passed its end.
    """
    rows = events.withColumn(time, F.col(time).cast("timestamp"))
    if events.isStreaming:
        rows = rows.withWatermark(time, watermark or quiet)
    found = rows.groupBy(F.session_window(time, quiet), key).agg(F.count("*").alias("events"))
    return found.select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "events")


def routed(changes: DataFrame, routes: dict[str, list[str]], folders: list[str]) -> DataFrame:
    """changes(path, ...) with `indexes`, those that take a file's extension; files in skipped folders go."""
    ext = extension("path")
    wanted = F.array_compact(F.array(*[F.when(ext.isin(e), F.lit(name)) for name, e in routes.items()]))
    return changes.where(~is_skipped("path", folders)).withColumn("indexes", wanted).where(F.size("indexes") > 0)


def latest(changes: DataFrame, *, key: str = "path", time: str = "ts") -> DataFrame:
    """A file's last change of a batch."""
    return changes.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.col(time).desc()))).where("_n = 1").drop("_n")


def merged(table: DataFrame, changes: DataFrame, *, key: str = "path", deleted: str = "deleted") -> DataFrame:
    """table after the changes: rows of changed keys are replaced, those of deleted ones go. Equal to a rebuild."""
    new = changes.where(~F.coalesce(F.col(deleted), F.lit(False))).select(*table.columns)
    return table.join(changes.select(key).distinct(), key, "left_anti").select(*table.columns).unionByName(new)


def derived(table: DataFrame, files: DataFrame, changes: DataFrame, build, *, key: str = "path") -> DataFrame:
    """A derived table (lines, chunks, postings, symbols) after changes: rows of changed files are built again from `files`."""
    touched = changes.select(key).distinct()
    return table.join(touched, key, "left_anti").select(*table.columns).unionByName(build(files.join(touched, key, "left_semi")).select(*table.columns))


def follow(changes: DataFrame, store, name: str, *, checkpoint: str, trigger: dict | None = None):
    """Starts a query that merges each micro-batch into a stored table. Versions carry the batch id, so a repeated batch writes the same."""

    def apply(batch: DataFrame, batch_id: int) -> None:
        table = store.read(name)
        if table is None:
            raise ValueError(f"there is no table {name} to follow changes on")
        if store.current(name)["fingerprint"] != f"batch-{batch_id}":
            store.write(name, merged(table, latest(batch)), f"batch-{batch_id}")

    writer = changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()

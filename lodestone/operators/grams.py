"""Trigram postings, and candidate pruning that loses no match."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import fold, folded
from . import exact


def postings(files: DataFrame, *, text_col: str = "text", key: str = "file_id") -> DataFrame:
    """gram, file_id: distinct trigrams of each file, with A to Z folded. Distinctness is settled within the row, so nothing is shuffled."""
    grams = F.array_distinct(F.regexp_extract_all(fold(F.col(text_col)), F.lit("(?s)(?=(.{3}))"), F.lit(1)))
    return files.select(F.explode(grams).alias("gram"), key)


def gram_lists(table: DataFrame, *, key: str = "file_id") -> DataFrame:
    """gram, n, files: each gram's sorted posting list. For stores whose lists are read whole; searches use the long table."""
    return table.groupBy("gram").agg(F.count("*").alias("n"), F.array_sort(F.collect_set(key)).alias("files"))


def candidates(table: DataFrame, needle: str, *, key: str = "file_id") -> DataFrame | None:
    """The files that may hold the needle by its first trigram; None (all files) for needles of under three characters."""
    first = folded(needle)[:3]
    return table.where(F.col("gram") == first).select(key) if len(first) == 3 else None


def pruned_search(files: DataFrame, table: DataFrame, needle: str, **options) -> DataFrame:
    """exact.search over candidates only."""
    chosen = candidates(table, needle)
    return exact.search(files if chosen is None else files.join(chosen, "file_id", "left_semi"), needle, **options)


def write(table: DataFrame, path: str) -> None:
    """Sorted by gram over range partitions, so that a search for one gram reads few row groups."""
    table.repartitionByRange("gram").sortWithinPartitions("gram").write.mode("overwrite").parquet(path)


def invalid(table: DataFrame, *, key: str = "file_id") -> DataFrame:
    """One row: problems, how many postings are null, not three characters long, or repeated."""
    per = table.groupBy("gram", key).agg(F.count("*").alias("n"))
    bad = F.col("gram").isNull() | F.col(key).isNull() | (F.length("gram") != 3) | (F.col("n") > 1)
    return per.agg(F.count_if(bad).alias("problems"))

"""Exact substring search over files, without a shuffle of lines.

A file is one row, so its lines are an array and all per-file work (which lines match, the first ten of them) happens
within the row: no explode, no window, no shuffle. Across files only a count and a top-n by file order remain.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fold, folded, line_end_trimmed

PER_FILE, FILES = 10, 50


def text_of(content: Column) -> Column:
    """Bytes as text; invalid sequences become U+FFFD."""
    return F.call_function("make_valid_utf8", content.cast("string"))


def matching_lines(text: Column, needle: str, *, case_sensitive: bool = False) -> Column:
    """array<struct<line, content>> of all lines in which the needle begins. Case is that of A to Z only.

    A needle with line ends begins in a line whose end is its first part, is followed by lines equal to the middle
    parts, and ends at the beginning of a line.
    """
    shown = F.split(text, "\n", -1)
    searched = shown if case_sensitive else F.split(fold(text), "\n", -1)
    parts = (needle if case_sensitive else folded(needle)).split("\n")
    # Lines that follow lie beside each line, so no expression within the loop takes the text apart again.
    columns = [shown.alias("content"), searched.alias("s0"), *[F.slice(searched, F.lit(k + 1), F.size(searched)).alias(f"s{k}") for k in range(1, len(parts))]]

    def hit(x: Column) -> Column:
        if len(parts) == 1:
            return F.contains(x["s0"], F.lit(parts[0]))
        found = F.endswith(x["s0"], F.lit(parts[0])) & F.coalesce(F.startswith(x[f"s{len(parts) - 1}"], F.lit(parts[-1])), F.lit(False))
        for k, part in enumerate(parts[1:-1], 1):
            found = found & F.coalesce(x[f"s{k}"] == part, F.lit(False))
        return found

    marked = F.transform(F.arrays_zip(*columns), lambda x, i: F.when(hit(x), F.struct((i + 1).alias("line"), x["content"].alias("content"))))
    return F.filter(marked, lambda m: m.isNotNull())


def _contains(text: Column, needle: str, case_sensitive: bool) -> Column:
    if case_sensitive:
        return F.contains(text, F.lit(needle))
    return F.rlike(text, F.lit("(?i)" + re.escape(needle)))  # regards A to Z only, and copies no text


def matches(files: DataFrame, needle: str, *, case_sensitive: bool = False, per_file: int = PER_FILE, text_col: str = "text") -> DataFrame:
    """files' columns but the text, with `matches`: the first lines of each file that match. The empty needle finds nothing."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    hits = files.where(F.lit(needle != "") & _contains(text, needle, case_sensitive))
    found = F.transform(F.slice(matching_lines(text, needle, case_sensitive=case_sensitive), 1, per_file), lambda m: F.struct(m["line"].alias("line"), line_end_trimmed(m["content"]).alias("content")))
    return hits.select(*[c for c in files.columns if c != text_col], found.alias("matches"))


def total_files(files: DataFrame, needle: str, *, case_sensitive: bool = False, text_col: str = "text") -> DataFrame:
    """One row: total_files, how many files hold the needle, before any limit."""
    return files.where(F.lit(needle != "") & _contains(F.coalesce(F.col(text_col), F.lit("")), needle, case_sensitive)).agg(F.count("*").alias("total_files"))


def search(files: DataFrame, needle: str, *, case_sensitive: bool = False, max_files: int = FILES, per_file: int = PER_FILE, text_col: str = "text") -> DataFrame:
    """file_id, path, matches, total_files of the first files in file order. Only those files are taken apart into lines."""
    hits = files.where(F.lit(needle != "") & _contains(F.coalesce(F.col(text_col), F.lit("")), needle, case_sensitive)).orderBy("file_id").limit(max_files)
    found = matches(hits, needle, case_sensitive=case_sensitive, per_file=per_file, text_col=text_col)
    return found.join(F.broadcast(total_files(files, needle, case_sensitive=case_sensitive, text_col=text_col)))  # one row


def lines(files: DataFrame, *, text_col: str = "text") -> DataFrame:
    """A row for each line, split at line feeds only; a text that ends with one has an empty last line."""
    return files.select("file_id", "path", F.posexplode(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1)).alias("line", "content")).withColumn("line", F.col("line") + 1)


def line_at(newlines: Column, offset: Column) -> Column:
    """The 1-based line of an offset from the sorted offsets of line feeds before which it may lie."""
    return F.size(F.filter(newlines, lambda x: x < offset)) + 1

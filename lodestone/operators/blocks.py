"""Blocks around a line, and skeletons of files: grammar work, done in Python in Arrow batches."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .symbols import blanked

WINDOW = 20
_OPENING = re.compile(r"\b[A-Za-z_]\w*\b[^{};=]*\{")


def _python(text: str) -> list[tuple[int, int, int]]:
    """(first line with decorators, line of the body's begin, last line) of every function and class; none if it can't be parsed."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return []
    kinds = (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)
    return [(min([n.lineno, *(d.lineno for d in n.decorator_list)]), n.body[0].lineno, n.end_lineno) for n in ast.walk(tree) if isinstance(n, kinds)]


def _braces(text: str) -> list[tuple[int, int, int]]:
    """The same for code with braces: from the words before an opening brace to its partner."""
    code, partner, open_ = blanked(text), {}, []
    for m in re.finditer(r"[{}]", code):
        if m.group() == "{":
            open_.append(m.start())
        elif open_:
            partner[open_.pop()] = m.start()
    line = lambda at: text.count("\n", 0, at) + 1
    return [(line(m.start()), line(m.end()), line(partner[m.end() - 1])) for m in _OPENING.finditer(code) if m.end() - 1 in partner]


def bounds(path: str, text: str, line: int) -> tuple[int, int] | None:
    """First and last line of the innermost block that holds a line; None for other languages or without one."""
    found = _python(text) if path.lower().endswith(".py") else _braces(text) if path.lower().endswith(".cs") else []
    around = [(a, b) for a, _, b in found if a <= line <= b]
    return min(around, key=lambda x: x[1] - x[0], default=None)


def skeleton(path: str, text: str, keep: list[int]) -> str | None:
    """A file with the bodies of functions folded, but for those that hold one of the lines to keep; None without a parser."""
    if not path.lower().endswith(".py"):
        return None
    lines = text.split("\n")
    folds = sorted((first, last) for _, first, last in _functions(text) if last - first >= 1 and not any(first <= k <= last for k in keep))
    out, at = [], 1
    for first, last in folds:
        if first < at:
            continue
        indent = re.match(r"\s*", lines[first - 1]).group()
        out += lines[at - 1 : first - 1] + [f"{indent}...  # {last - first + 1} line(s)"]
        at = last + 1
    return "\n".join(out + lines[at - 1 :])


def _functions(text: str) -> list[tuple[int, int, int]]:
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return []
    return [(n.lineno, n.body[0].lineno, n.end_lineno) for n in ast.walk(tree) if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef))]


def read(places: DataFrame, files: DataFrame, *, window: int = WINDOW, text_col: str = "text") -> DataFrame:
    """places(path, line) with start_line, end_line and block: the block around each, or `window` lines on either side."""
    rows = places.join(files.select("path", F.col(text_col).alias("text")), "path").select("path", "line", "text")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for path, line, text in zip(part["path"], part["line"], part["text"]):
                lines = (text or "").splitlines(keepends=True)
                a, b = bounds(path, text or "", line) or (max(1, line - window), min(len(lines), line + window))
                out.append((path, line, a, b, "".join(lines[a - 1 : b])))
            yield pd.DataFrame(out, columns=["path", "line", "start_line", "end_line", "block"])

    return rows.mapInPandas(run, "path string, line int, start_line int, end_line int, block string")


def skeletons(files: DataFrame, keep: DataFrame | None = None, *, text_col: str = "text") -> DataFrame:
    """path, skeleton; keep(path, line) are lines whose functions stay whole."""
    rows = files.select("path", F.col(text_col).alias("text"))
    if keep is None:
        rows = rows.withColumn("keep", F.array().cast("array<int>"))
    else:
        lists = keep.groupBy("path").agg(F.collect_list(F.col("line").cast("int")).alias("keep"))
        rows = rows.join(lists, "path", "left").withColumn("keep", F.coalesce("keep", F.array().cast("array<int>")))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame({"path": part["path"], "skeleton": [skeleton(p, t or "", list(k)) for p, t, k in zip(part["path"], part["text"], part["keep"])]})

    return rows.mapInPandas(run, "path string, skeleton string")


def excerpt(lines: DataFrame, *, start: int = 1, end: int = 80, limit: int = 6000) -> DataFrame:
    """path, excerpt from lines(path, line, content): at most 120 lines and `limit` characters."""
    last = max(start, min(end, start + 119))
    chosen = lines.where(F.col("line").between(max(1, start), last))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "content"))), lambda x: x["content"]), "\n")
    return chosen.groupBy("path").agg(F.substring(text, 1, limit).alias("excerpt"))

"""Result pages as text. Every page is cut to its context's limits, and redacted, before it is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import redact
from ..operators import blocks
from ..operators.fusion import CONTEXTS

#: Lines of a block that are shown, and semantic files of a merged page by context.
BLOCK_LINES, MERGED = 60, {"compact": 3, "normal": 5, "full": 5}
#: Characters of a snippet in a semantic page and in a merged one, by context.
SNIPPETS = {"compact": (160, 160), "normal": (300, 600), "full": (300, 600)}


def reason(kind: str, boost: float | None) -> str:
    """Why a row was found."""
    return {"pattern": "exact token match", "semantic": "semantic match"}[kind] + (" + recent git activity" if boost else "")


def _blocks(places: DataFrame, files: DataFrame) -> dict[tuple[str, int], tuple[str, int, int]]:
    """(path, line) -> (block, first line, last line) of a page's places, cut to the lines that are shown."""
    found = {}
    for r in blocks.read(places, files).withColumn("block", redact("block")).collect():
        lines, n = r["block"].splitlines(), r["end_line"] - r["start_line"] + 1
        if lines and n > BLOCK_LINES:
            lines = [*lines[:BLOCK_LINES], f"... ({n - BLOCK_LINES} more lines)"]
        if lines:
            found[r["path"], r["line"]] = ("\n".join(lines), r["start_line"], min(r["end_line"], r["start_line"] + BLOCK_LINES - 1))
    return found


def _indented(text: str, by: int) -> list[str]:
    return [" " * by + line for line in text.splitlines()]


def _page(hits: DataFrame, context: str) -> list:
    """The first files of an exact search in the boost's order, their lines redacted."""
    lines = F.transform("matches", lambda m: F.struct(m["line"].alias("line"), redact(m["content"]).alias("content")))
    return hits.orderBy(F.col("git_boost").desc(), "file_id").limit(CONTEXTS[context][0]).select("path", "git_boost", "total_files", lines.alias("matches")).collect()


def _more(shown: int, total: int, words: str) -> list[str]:
    return [f"\n... {total - shown} {words}"] if total > shown else []


def pattern(hits: DataFrame, files: DataFrame, *, context: str = "normal") -> str | None:
    """Files of an exact search (with git_boost) and the blocks around their lines, a block once; None without any."""
    _, most, expand = CONTEXTS[context]
    page = _page(hits, context)
    if not page:
        return None
    around = {}
    if expand:
        places = [(r["path"], m["line"]) for r in page for m in r["matches"][:most]]
        around = _blocks(hits.sparkSession.createDataFrame(places, "path string, line int"), files)
    out = [f"Pattern: {page[0]['total_files']} files matched:"]
    for r in page:
        out.append(f"\n{r['path']}:  reason: {reason('pattern', r['git_boost'])}")
        shown, seen = r["matches"][:most], set()
        for m in shown:
            block = around.get((r["path"], m["line"]))
            if block is None:
                out.append(f"  {m['line']}: {m['content']}" if expand else f"  L{m['line']}: {m['content'][:160]}")
            elif block[1:] not in seen:
                seen.add(block[1:])
                out += [f"  L{block[1]}–{block[2]}:", *_indented(block[0], 4)]
        if not expand and len(r["matches"]) > len(shown):
            out.append(f"  ... {len(r['matches']) - len(shown)} more matches")
    return "\n".join(out + _more(len(page), page[0]["total_files"], "more files not shown — refine your query"))


def _semantic_rows(hits: DataFrame) -> list:
    """A page of chunks (path, start_line, end_line, text, score, git_boost), best first."""
    rows = hits.withColumn("total", F.round(F.col("score") + F.col("git_boost"), 4)).withColumn("text", redact("text"))
    return rows.orderBy(F.col("total").desc(), "path", "start_line").collect()


def semantic(hits: DataFrame, files: DataFrame, query: str, *, context: str = "normal") -> str | None:
    """Chunks of a semantic search (with git_boost), each as the block around its first line or as a snippet; None without any."""
    page = _semantic_rows(hits)
    if not page:
        return None
    around = {}
    if CONTEXTS[context][2]:
        around = _blocks(hits.sparkSession.createDataFrame([(r["path"], r["start_line"]) for r in page], "path string, line int").distinct(), files)
    out = [f"Semantic: {len(page)} matches for '{query}':"]
    for r in page:
        text, first, last = around.get((r["path"], r["start_line"]), (None, r["start_line"], r["end_line"]))
        out.append(f"\n[{r['total']}] {r['path']} L{first}–{last}: reason: {reason('semantic', r['git_boost'])}")
        out += [r["text"][: SNIPPETS[context][0]]] if text is None else _indented(text, 2)
    return "\n".join(out)


def hybrid(hits: DataFrame, chunks: DataFrame, *, context: str = "normal") -> str | None:
    """Files of an exact search, then chunks in files without a match; scores aren't compared. None without any."""
    most, page = CONTEXTS[context][1], _page(hits, context)
    rest = _semantic_rows(chunks.join(hits.select("path"), "path", "left_anti"))
    out = []
    if page:
        out.append(f"Pattern ({page[0]['total_files']} files matched):")
        for r in page:
            out.append(f"\n{r['path']}: reason: {reason('pattern', r['git_boost'])}")
            out += [f"  {m['line']}: {m['content']}" for m in r["matches"][:most]]
            out += [f"  ... {len(r['matches']) - most} more matches"] if len(r["matches"]) > most else []
        out += _more(len(page), page[0]["total_files"], "more files — refine your query")
    if rest:
        out += [""] if out else []
        out.append(f"Semantically related ({len(rest)} files not in pattern results):")
        for r in rest[: MERGED[context]]:
            out += [f"\n[{r['total']}] {r['path']} L{r['start_line']}–{r['end_line']}: reason: {reason('semantic', r['git_boost'])}", r["text"][: SNIPPETS[context][1]]]
    return "\n".join(out) or None

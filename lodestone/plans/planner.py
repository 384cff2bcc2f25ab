"""Plans of a change: evidence of every kind, ordered and fitted to a token budget.

Evidence of many requests goes through together: candidates carry a request_id, each request's are sorted into one array
and folded once. A request's array is bounded before that by keeping what could be chosen, see `bounded`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.paths import PLAN_SKIPPED_FOLDERS, is_plan_configuration, is_skipped, is_test, name
from ..functions.text import redact, tokens
from ..operators import exact
from ..operators import symbols as symbol_queries

#: Sections in their order, and those in which a change is likely.
SECTIONS = ["primary_implementation", "parent_context", "direct_callers", "direct_dependencies", "implementations_overrides", "configuration_documentation", "tests_coverage", "git_changes"]
LIKELY = ["primary_implementation", "implementations_overrides", "configuration_documentation", "tests_coverage"]
#: Tokens of a plan's head and of each item's frame, least room for a cut item, room kept free in it.
HEAD, FRAME, LEAST_ROOM, MARGIN = 48, 12, 64, 16

_ITEM = "section string, path string, line_start int, title string, reason string, content string, confidence double, symbol_id string, tokens int, truncated boolean, fate string"


def ordered(candidates: DataFrame) -> DataFrame:
    """Candidates with their place (ord) in their request's plan; repeated evidence (section, path, line, symbol) once.

    Section, priority, confidence, boost, path, line, title: an exact symbol outranks any recency.
    """
    rank = F.array_position(F.array(*map(F.lit, SECTIONS)), F.col("section"))
    order = [rank, F.col("priority"), F.col("confidence").desc(), F.col("git_boost").desc(), F.lower("path"), F.col("line_start"), F.col("title")]
    once = candidates.withColumn("_n", F.row_number().over(Window.partitionBy("request_id", "section", "path", "line_start", "symbol_id").orderBy(*order))).where("_n = 1").drop("_n")
    return once.withColumn("ord", F.row_number().over(Window.partitionBy("request_id").orderBy(*order)))


def allocate(candidates: DataFrame, requests: DataFrame) -> DataFrame:
    """request_id, ord, ... fate of every candidate: "kept", "top_k limit" or "token budget", with tokens and truncated.

    requests: request_id, request, top_k, budget. A fold over the request's ordered candidates, in one expression:
    the room left after each decides over the next, so no running sum could say it.
    """
    cost = tokens(F.concat("title", "reason", "content")) + FRAME
    row = F.struct("ord", "section", "path", "line_start", "title", "reason", "content", "confidence", "symbol_id", cost.alias("tokens"))
    lists = ordered(candidates).groupBy("request_id").agg(F.array_sort(F.collect_list(row)).alias("all"))
    given = requests.join(lists, "request_id").withColumn("start", tokens("request") + HEAD)
    out = f"array<struct<ord: int, {', '.join(x.replace(' ', ': ', 1) for x in _ITEM.split(', '))}>>"
    counts = F.transform(F.array(*map(F.lit, SECTIONS)), lambda s: F.lit(0))
    start = F.struct(F.col("start").alias("used"), counts.alias("counts"), F.array().cast(out).alias("items"))

    def step(acc: Column, c: Column) -> Column:
        section = F.array_position(F.array(*map(F.lit, SECTIONS)), c["section"]).cast("int")
        full = F.element_at(acc["counts"], section) >= F.col("top_k")
        room = F.col("budget") - acc["used"]
        over = c["tokens"] > room
        cut = over & (c["section"] == SECTIONS[0]) & (room >= LEAST_ROOM) & (F.length(c["content"]) > 0)
        content = F.when(cut, F.substring(c["content"], F.lit(1), F.greatest(F.lit(1), (room - MARGIN) * 4))).otherwise(c["content"])
        cut_cost = F.least(room, tokens(F.concat(c["title"], c["reason"], content)) + FRAME)
        spent = F.when(~full & cut, cut_cost).otherwise(c["tokens"]).cast("int")
        fate = F.when(full, "top_k limit").when(over & ~cut, "token budget").otherwise("kept")
        kept = fate == "kept"
        item = F.struct(
            c["ord"].alias("ord"), c["section"].alias("section"), c["path"].alias("path"), c["line_start"].alias("line_start"), c["title"].alias("title"), c["reason"].alias("reason"),
            F.when(kept, content).otherwise(c["content"]).alias("content"), c["confidence"].alias("confidence"), c["symbol_id"].alias("symbol_id"), spent.alias("tokens"), (kept & cut).alias("truncated"), fate.alias("fate"),
        )
        counted = F.transform(acc["counts"], lambda n, i: n + F.when(kept & (i + 1 == section), 1).otherwise(0))
        return F.struct((acc["used"] + F.when(kept, spent).otherwise(0)).cast("int").alias("used"), counted.alias("counts"), F.concat(acc["items"], F.array(item)).cast(out).alias("items"))

    folded = given.select("request_id", F.aggregate("all", start, step).alias("plan"))
    return folded.select("request_id", F.col("plan.used").alias("tokens_used"), F.inline("plan.items"))


def bounded(candidates: DataFrame, per_section: int = 200) -> DataFrame:
    """The candidates that a plan with up to 50 items a section can come to, in the order of a plan: for requests with much evidence."""
    rank = F.row_number().over(Window.partitionBy("request_id", "section").orderBy("priority", F.col("confidence").desc(), F.col("git_boost").desc(), F.lower("path"), "line_start", "title"))
    return candidates.withColumn("_n", rank).where(F.col("_n") <= per_section).drop("_n")


def _candidate(rows: DataFrame, section: str, /, **columns) -> DataFrame:
    base = {
        "request_id": F.col("request_id"), "section": F.lit(section), "path": F.col("path"), "line_start": F.lit(1), "line_end": F.lit(80), "title": name("path"), "reason": F.lit(""),
        "content": F.lit(""), "confidence": F.lit(1.0), "priority": F.lit(2), "git_boost": F.coalesce(F.col("git_boost"), F.lit(0.0)) if "git_boost" in rows.columns else F.lit(0.0), "symbol_id": F.lit(None).cast("string"),
    }
    base |= columns
    return rows.select(*[v.alias(k) for k, v in base.items()])


def excerpt(text: Column, first: Column, last: Column, limit: int = 6000) -> Column:
    lines = F.split(text, "\n", -1)
    n = F.least(last, first + 119) - first + 1
    return F.substring(redact(F.array_join(F.slice(lines, F.greatest(F.lit(1), first), F.greatest(n, F.lit(0))), "\n")), 1, limit)


def pattern_candidates(files: DataFrame, terms: list[str], *, request_id: int = 0, top_k: int = 8) -> DataFrame:
    """Two lines of each of the first top_k files of the first six terms; a line once, for its first term."""
    found = None
    for rank, term in enumerate(terms[:6]):
        one = exact.search(files, term, max_files=top_k).select("path", F.explode(F.slice("matches", 1, 2)).alias("m"), F.lit(rank).alias("rank"), F.lit(term).alias("term"))
        found = one if found is None else found.unionByName(one)
    first = found.withColumn("_n", F.row_number().over(Window.partitionBy("path", "m.line").orderBy("rank"))).where("_n = 1").withColumn("request_id", F.lit(request_id))
    return _candidate(
        first, SECTIONS[0], line_start=F.col("m.line"), line_end=F.col("m.line"), reason=F.concat(F.lit("exact text match for "), "term"), content=F.substring(redact(F.col("m.content")), 1, 2000),
        confidence=F.lit(0.95), priority=F.lit(1) + F.col("rank"),
    )


def semantic_candidates(hits: DataFrame, *, request_id: int = 0) -> DataFrame:
    """hits(path, start_line, end_line, text, score)."""
    return _candidate(hits.withColumn("request_id", F.lit(request_id)), SECTIONS[0], line_start=F.col("start_line"), line_end=F.col("end_line"), reason=F.lit("semantic match"), content=F.substring(redact("text"), 1, 4000), confidence=F.col("score"), priority=F.lit(2))


def symbol_candidates(symbols: DataFrame, files: DataFrame, terms: list[str], *, request_id: int = 0, top_k: int = 8) -> tuple[DataFrame, list[str]]:
    """(candidates, ids of the seeds). Declarations before namespaces and modules; partial matches only while nothing else is found.

    At most eight terms with at most top_k small rows each come to the driver.
    """
    seeds: dict[str, tuple[float, int]] = {}
    for term in terms:
        rows = symbol_queries.find(symbols, term, k=top_k).select("id", "match", "kind").collect()
        solid = [r for r in rows if r["kind"] not in ("module", "namespace")] or rows
        for r in solid:
            if r["id"] not in seeds and len(seeds) < top_k and (r["match"] == 0 or not seeds):
                seeds[r["id"]] = (1.0, 0) if r["match"] == 0 else (0.90, 1)
    spark = symbols.sparkSession
    chosen = spark.createDataFrame([(k, *v) for k, v in seeds.items()], "id string, _confidence double, _priority int")
    return from_symbols(symbols.join(F.broadcast(chosen), "id"), files, SECTIONS[0], request_id=request_id, reason=F.lit("symbol declaration"), confidence=F.col("_confidence"), priority=F.col("_priority")), list(seeds)


def from_symbols(rows: DataFrame, files: DataFrame, section: str, *, request_id: int, reason: Column, confidence: Column, priority: Column) -> DataFrame:
    """Symbols as candidates, with their source as content."""
    found = rows.join(files.select(F.col("path").alias("file_path"), "text"), "file_path", "left").withColumn("path", F.col("file_path")).withColumn("request_id", F.lit(request_id))
    return _candidate(
        found, section, line_start=F.col("line_start"), line_end=F.col("line_end"), title=F.concat_ws(" ", "kind", "qualified_name"), reason=reason, content=F.coalesce(excerpt(F.col("text"), F.col("line_start"), F.col("line_end")), F.lit("")),
        confidence=confidence, priority=priority, symbol_id=F.col("id"),
    )


def parent_candidates(symbols: DataFrame, files: DataFrame, seeds: list[str], *, request_id: int = 0) -> DataFrame:
    parents = symbols.where(F.col("id").isin(seeds)).select(F.col("parent_symbol_id").alias("id")).where("id is not null").distinct()
    return from_symbols(symbols.join(parents, "id"), files, "parent_context", request_id=request_id, reason=F.lit("parent of a primary symbol"), confidence=F.lit(0.98), priority=F.lit(0))


def relation_candidates(symbols: DataFrame, edges: DataFrame, files: DataFrame, seeds: list[str], *, request_id: int = 0) -> DataFrame:
    """Callers, implementations and overrides, tests and configuration of the seeds, each symbol once a section by its surest relation."""
    section = F.when(F.col("kind") == "calls", "direct_callers").when(F.col("kind").isin("implements", "inherits", "overrides"), "implementations_overrides").when(F.col("kind") == "configured_by", "configuration_documentation")
    towards = edges.where(F.col("target_symbol_id").isin(seeds)).select(section.alias("section"), F.col("source_symbol_id").alias("id"), "confidence", F.col("kind").alias("relation"))
    tested = edges.where((F.col("kind") == "tested_by") & F.col("source_symbol_id").isin(seeds)).select(F.lit("tests_coverage").alias("section"), F.col("target_symbol_id").alias("id"), "confidence", F.col("kind").alias("relation"))
    best = towards.where("section is not null").unionByName(tested).groupBy("section", "id").agg(F.max("confidence").alias("_confidence"), F.min("relation").alias("_relation"))
    found = None
    for s in ("direct_callers", "implementations_overrides", "configuration_documentation", "tests_coverage"):
        one = from_symbols(symbols.join(best.where(F.col("section") == s).drop("section"), "id"), files, s, request_id=request_id, reason=F.concat_ws(" ", F.lit("relation"), "_relation"), confidence=F.col("_confidence"), priority=F.lit(1))
        found = one if found is None else found.unionByName(one)
    return found


def dependency_candidates(graph: DataFrame, files: DataFrame, primary: DataFrame, *, request_id: int = 0, top_k: int = 8) -> DataFrame:
    """Direct imports and direct importers of the primary files (a page of paths), with the head of each file."""
    out = graph.join(F.broadcast(primary.select(F.col("path").alias("src"))), "src").select(F.col("dst").alias("path"), F.lit(0.90).alias("c"), F.lit("direct import of a primary file").alias("r"), F.col("src").alias("of"))
    out = out.withColumn("_n", F.row_number().over(Window.partitionBy("of").orderBy("path"))).where(F.col("_n") <= top_k).drop("_n")
    in_ = graph.join(F.broadcast(primary.select(F.col("path").alias("dst"))), "dst").select(F.col("src").alias("path"), F.lit(0.88).alias("c"), F.coalesce("reason", F.lit("direct importer of a primary file")).alias("r"), F.col("dst").alias("of"))
    heads = files.select("path", excerpt(F.col("text"), F.lit(1), F.lit(80)).alias("head"))
    both = out.withColumn("s", F.lit("direct_dependencies")).unionByName(in_.withColumn("s", F.lit("direct_callers"))).join(heads, "path", "left").withColumn("request_id", F.lit(request_id))
    return _candidate(both, "", section=F.col("s"), reason=F.col("r"), content=F.coalesce("head", F.lit("")), confidence=F.col("c"))


def configuration_candidates(candidates: DataFrame) -> DataFrame:
    return _candidate(candidates.where(is_plan_configuration("path") & ~is_skipped("path", PLAN_SKIPPED_FOLDERS)), "configuration_documentation", line_start=F.col("line_start"), line_end=F.col("line_end"), reason=F.lit("configuration or documentation matched the request"), content=F.col("content"), confidence=F.col("confidence"), priority=F.lit(1))


def test_candidates(candidates: DataFrame) -> DataFrame:
    return _candidate(candidates.where(is_test("path")), "tests_coverage", line_start=F.col("line_start"), line_end=F.col("line_end"), reason=F.lit("test path matched the request"), content=F.col("content"), confidence=F.col("confidence"), priority=F.lit(1))


def git_candidates(candidates: DataFrame) -> DataFrame:
    return _candidate(candidates.where("git_boost > 0"), "git_changes", line_start=F.col("line_start"), line_end=F.col("line_end"), reason=F.lit("recently changed"), content=F.col("content"), confidence=F.least(F.lit(1.0), F.lit(0.6) + F.col("git_boost")), priority=F.lit(3))


def summary(plan: DataFrame, *, dependency_ready: bool = True, symbol_ready: bool = True, semantic_ready: bool = True) -> DataFrame:
    """One row a request: tokens_used, inspection_order, likely_change_set, risks, unknowns."""
    kept = F.col("fate") == "kept"
    paths = F.array_sort(F.collect_list(F.when(kept & (F.col("path") != ""), F.struct("ord", "path", "section"))))
    found = plan.groupBy("request_id").agg(
        F.max("tokens_used").alias("tokens_used"), paths.alias("p"), F.coalesce(F.max(kept & (F.col("section") == SECTIONS[0])), F.lit(False)).alias("has_primary"),
        F.coalesce(F.max(kept & (F.col("section") == "tests_coverage")), F.lit(False)).alias("has_tests"), F.coalesce(F.max(kept & (F.col("confidence") < 0.70)), F.lit(False)).alias("weak"), F.max(~kept).alias("left_out"),
    )
    risks = F.array_compact(F.array(
        F.when(~F.col("has_primary"), F.lit("No primary implementation fit the context bundle.")), F.when(~F.col("has_tests"), F.lit("No related tests were identified; coverage may be missing.")),
        F.when(F.col("weak"), F.lit("Some relationships are heuristic and below 0.70 confidence.")), F.when(F.col("left_out"), F.lit("The token budget omitted relevant context; inspect omissions before editing.")),
    ))
    missing = [(dependency_ready, "Dependency graph is unavailable."), (symbol_ready, "Symbol index is unavailable."), (semantic_ready, "Semantic index is unavailable.")]
    unknowns = F.array(*[F.lit(text) for ready, text in missing if not ready]).cast("array<string>")
    return found.select(
        "request_id", "tokens_used", F.array_distinct(F.transform("p", lambda x: x["path"])).alias("inspection_order"),
        F.array_distinct(F.transform(F.filter("p", lambda x: x["section"].isin(LIKELY)), lambda x: x["path"])).alias("likely_change_set"), risks.alias("risks"), unknowns.alias("unknowns"),
    )


def markdown(plan: DataFrame) -> str:
    """One request's plan as text; a plan is bounded by its budget."""
    out = ["# Change plan"]
    for section in SECTIONS:
        rows = plan.where((F.col("section") == section) & (F.col("fate") == "kept")).orderBy("ord").collect()
        if rows:
            out.append(f"\n## {section.replace('_', ' ').capitalize()}")
        for r in rows:
            out.append(f"\n### {r['title']} ({r['path']}:{r['line_start']})\n{r['reason']} (confidence {r['confidence']:.2f})\n\n```\n{r['content']}\n```")
    return "\n".join(out)

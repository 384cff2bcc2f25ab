"""One object for all tools: the tables of a corpus and a method for each query on them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .functions.paths import DEPENDENCY_EXTENSIONS, SEMANTIC_EXTENSIONS, extension, under_roots
from .functions.text import query_terms, redact
from .operators import blocks, exact, fusion, graph, grams, recency, semantic, signals, symbols
from .plans import planner, render
from .sources import corpus
from .tables import stored


@dataclass
class Engine:
    """files: file_id, path, text (and what else there is). The other tables may be absent; searches then fall back with a warning."""

    spark: SparkSession
    files: DataFrame
    postings: DataFrame | None = None
    chunks: DataFrame | None = None
    edges: DataFrame | None = None
    symbol_table: DataFrame | None = None
    symbol_edges: DataFrame | None = None
    state: DataFrame | None = None

    # What the derived tables are made of, so that a change of a file reads that file only.
    found_imports: DataFrame | None = None
    csharp_names: DataFrame | None = None
    raw_relations: DataFrame | None = None
    aliases: dict[str, list[str]] | None = None
    embed: Callable[[DataFrame], DataFrame] | None = None

    @classmethod
    def index(cls, spark: SparkSession, root: str, **options) -> Engine:
        """Reads a folder and builds every table but the vectors, each stored once."""
        files = corpus.read_folder(spark, root, **options).withColumn("text", exact.text_of(F.col("content"))).drop("content")
        return cls.build(spark, stored(corpus.numbered(files), "files"), corpus.script_aliases(spark, root))

    @classmethod
    def build(cls, spark: SparkSession, files: DataFrame, aliases: dict[str, list[str]] | None = None) -> Engine:
        engine = cls(spark, files, aliases=aliases)
        engine.postings = stored(grams.postings(files), "postings")
        code = _dependencies(files)
        engine.found_imports, engine.csharp_names = stored(graph.imports(code), "imports"), stored(graph.csharp_names(code), "names")
        engine.edges = stored(graph.edges_of(engine.found_imports, engine.csharp_names, code, aliases), "edges")
        found, raw = symbols.extract(files)
        engine.symbol_table, engine.raw_relations = stored(found, "symbols"), stored(raw, "raw-relations")
        engine.symbol_edges = stored(symbols.resolve(engine.symbol_table, engine.raw_relations), "relations")
        return engine

    def semantic_index(self, embed=semantic.hashed_vectors) -> Engine:
        """Chunks with vectors by a function from chunk rows to chunk rows with `embedding`."""
        self.chunks, self.embed = stored(embed(semantic.chunks(_meaning(self.files))), "chunks"), embed
        return self

    def add_directory(self, root: str, **options) -> Engine:
        """The corpus with another folder's files; paths and aliases are kept apart by that folder's name. A folder of that name is replaced."""
        more = corpus.read_folder(self.spark, root, **options).withColumn("text", exact.text_of(F.col("content"))).drop("content")
        prefix = root.rstrip("/").rsplit("/", 1)[-1]
        more = more.withColumn("path", F.concat(F.lit(prefix + "/"), "path"))
        aliases = dict(self.aliases or {})
        for name, roots in corpus.script_aliases(self.spark, root).items():
            aliases[name] = [*aliases.get(name, []), *[f"{prefix}/{r}".rstrip("/") for r in roots]]
        old = self.files.where(F.startswith("path", F.lit(prefix + "/"))).select("path").join(more.select("path"), "path", "left_anti")
        changed = more.select("path", "text").unionByName(old.withColumn("text", F.lit(None).cast("string")))
        return self.update_files(changed, aliases=aliases or None)

    def update_file(self, path: str, text: str | None) -> Engine:
        """The corpus after one file's change (null text: deletion)."""
        return self.update_files(self.spark.createDataFrame([(path, text)], "path string, text string"))

    def update_files(self, changed: DataFrame, *, aliases: dict[str, list[str]] | None = None) -> Engine:
        """The corpus after the files in changed(path, text) were written or (null text) deleted.

        Only those are read again: their rows in each table are replaced, then edges and relations are resolved from the
        tables. A file keeps its id; new ones come after all others, by path, until the next build.
        """
        changed = stored(changed, "changed")
        gone, now = changed.select("path"), changed.where("text is not null")
        ids = self.files.select("path", "file_id").join(gone, "path", "left_semi")
        last = self.files.agg(F.coalesce(F.max("file_id"), F.lit(-1)).alias("n")).first()["n"]
        fresh = corpus.numbered(now.join(ids, "path", "left_anti")).withColumn("file_id", (F.col("file_id") + last + 1).cast("long"))
        now = stored(now.join(ids, "path").select("file_id", "path", "text").unionByName(fresh.select("file_id", "path", "text")), "changed-files")
        code = _dependencies(now)

        def replaced(table: DataFrame, new: DataFrame, by: str, name: str) -> DataFrame:
            return stored(table.join(gone.select(F.col("path").alias(by)), by, "left_anti").select(*table.columns).unionByName(new, allowMissingColumns=True), name)

        files = replaced(self.files, now, "path", "files")
        engine = replace(self, files=files, aliases=self.aliases if aliases is None else aliases)
        engine.postings = stored(self.postings.join(ids.select("file_id"), "file_id", "left_anti").unionByName(grams.postings(now)), "postings")
        engine.found_imports = replaced(self.found_imports, graph.imports(code), "src", "imports")
        engine.csharp_names = replaced(self.csharp_names, graph.csharp_names(code), "path", "names")
        engine.edges = stored(graph.edges_of(engine.found_imports, engine.csharp_names, _dependencies(files), engine.aliases), "edges")
        found, raw = symbols.updated(self.symbol_table, self.raw_relations, changed)
        engine.symbol_table, engine.raw_relations = stored(found, "symbols"), stored(raw, "raw-relations")
        engine.symbol_edges = stored(symbols.resolve(engine.symbol_table, engine.raw_relations), "relations")
        if self.chunks is not None:
            engine.chunks = replaced(self.chunks, self.embed(semantic.chunks(_meaning(now))), "path", "chunks")
        return engine

    def clear_index(self) -> None:
        self.postings = self.chunks = self.edges = self.symbol_table = self.symbol_edges = None
        self.found_imports = self.csharp_names = self.raw_relations = None

    # -- search ---------------------------------------------------------------------------------------------------

    def search(self, needle: str, **options) -> DataFrame:
        """Exact search, over candidates where there are postings."""
        return grams.pruned_search(self.files, self.postings, needle, **options) if self.postings is not None else exact.search(self.files, needle, **options)

    def semantic_search(self, query: str, k: int = 10) -> DataFrame:
        vector = self.embed(self.spark.createDataFrame([(query,)], "text string")).first()["embedding"]
        return semantic.top_k(self.chunks.withColumn("chunk", F.concat_ws(":", "path", "start_line")), vector, k, id_col="chunk")

    def search_code(self, query: str, *, top_k: int = 5, mode: str = "auto", context: str = "normal", intent: str = "understand", dependencies: bool = False, tests: bool = False, roots: list[str] | None = None) -> dict:
        """Routes, searches, merges and expands: mode, warning, results, primary_results, related_files (DataFrames)."""
        effective, warning = fusion.route_one(self.spark, query, mode, intent, semantic_ready=self.chunks is not None, symbol_ready=self.symbol_table is not None)
        dependencies, tests = dependencies or intent in ("modify", "debug"), tests or intent in ("modify", "debug")
        found = self._hits(query, effective, top_k, context).where(under_roots("file", roots or []))
        found = stored(found, "hits")  # a page of results, read several times below
        first = fusion.primary(found)
        none = self.spark.createDataFrame([], "src string, dst string, reason string")
        related = fusion.related(found, first, self.edges if self.edges is not None else none, tests=tests, dependencies=dependencies and self.edges is not None)
        return {"mode": effective, "warning": warning, "results": found.orderBy("ord"), "primary_results": first.orderBy("ord"), "related_files": related}

    def search_text(self, query: str, *, top_k: int = 5, mode: str = "auto", context: str = "normal", intent: str = "understand") -> str:
        """What search_code finds, as a page of text."""
        effective, warning = fusion.route_one(self.spark, query, mode, intent, semantic_ready=self.chunks is not None, symbol_ready=self.symbol_table is not None)
        if effective == "symbol":
            rows = self._hits(query, "symbol", top_k, context).orderBy("ord").collect()
            text = "\n".join([f"Symbol: {len(rows)} matches for '{query}':", *[f"\n{r['file']} L{r['line_start']}–{r['line_end']}\n  {r['snippet']}" for r in rows]]) if rows else None
        else:
            exact_ = stored(self._boosted(self.search(query)), "hits") if effective in ("pattern", "hybrid") or self.chunks is None else None
            chunks = self._boosted(self.semantic_search(query, top_k)) if effective != "pattern" and self.chunks is not None else None
            if chunks is None:
                text = render.pattern(exact_, self.files, context=context)
            else:
                text = render.semantic(chunks, self.files, query, context=context) if exact_ is None else render.hybrid(exact_, chunks, context=context)
        return "\n\n".join(x for x in (warning, text or f"No matches for '{query}'.") if x)

    def retrieve(self, query: dict, mode: str, k: int = 10) -> DataFrame:
        """file, symbol, test, ord: a page for a benchmark's query (query, exact_query, symbol_query) by one of quality.RETRIEVALS.

        "ripgrep" is a scan of all files without an index.
        """
        text, exact_ = query["query"], query.get("exact_query") or query["query"]
        named, none = query.get("symbol_query") or exact_, F.lit(None).cast("string")
        if mode == "ripgrep":
            return exact.search(self.files, exact_, max_files=k).select(F.col("path").alias("file"), none.alias("symbol"), none.alias("test"), F.col("file_id").alias("ord"))
        symbol_page = symbols.find(self.symbol_table, named, k=k).select(F.col("file_path").alias("file"), F.col("qualified_name").alias("symbol"), F.struct("match", F.lower("qualified_name"), "file_path", "line_start").alias("key")) if mode in ("symbol", "hybrid_symbols") else None
        if mode == "symbol":
            return fusion_ord(symbol_page.withColumn("test", none), ["file", "symbol", "test"], ["key"])
        if mode not in ("exact", "semantic", "hybrid", "hybrid_symbols", "hybrid_dependencies"):
            raise ValueError(f"unknown way of retrieval: {mode}")
        deep = mode == "hybrid_dependencies"
        found = self.search_code(exact_ if mode == "exact" else text, top_k=k, mode="hybrid" if mode.startswith("hybrid") else mode, dependencies=deep, tests=deep)
        page = fusion.first_by(found["results"].select("file", "ord"), ["file"], ["ord"])
        if mode == "hybrid_symbols":
            own = fusion_ord(symbol_page, ["file", "symbol"], ["key"])
            merged = fusion.symbols_first(own.select("file", "ord"), page, k)
            names = fusion.first_by(own, ["file"], ["ord"]).select("file", "symbol")
            return fusion_ord(merged.join(names, "file", "left").withColumn("test", none), ["file", "symbol", "test"], ["source", "ord"])
        page = page.orderBy("ord").limit(k).select("file", none.alias("symbol"), none.alias("test"), "ord")
        if deep:
            tests = found["related_files"].where("relation = 'tests'").select(none.alias("file"), none.alias("symbol"), F.col("file").alias("test"), (F.col("ord") + 1_000_000).alias("ord"))
            page = page.unionByName(tests)
        return page

    def _hits(self, query: str, mode: str, k: int, context: str) -> DataFrame:
        columns = ["file", "line_start", "line_end", "score", "snippet", "engine"]
        if mode == "symbol":
            rows = symbols.find(self.symbol_table, query, k=k).select(F.col("file_path").alias("file"), "line_start", "line_end", F.lit(1.0).alias("score"), F.substring(redact("signature"), 1, 300).alias("snippet"), F.lit("symbol").alias("engine"), F.struct("match", F.lower("qualified_name"), "file_path", "line_start").alias("key"))
            return fusion_ord(rows, columns, ["key"])
        pattern = self._boosted(self.search(query))
        hits = fusion.pattern_hits(pattern, context=context)
        if mode == "pattern" or self.chunks is None:
            return fusion_ord(hits.withColumn("key", F.struct(-F.col("score"), F.col("file_id"), F.col("line_start"))), columns, ["key"])
        meaning = self._boosted(self.semantic_search(query, k)).withColumn("score", F.round(F.col("score") + F.col("git_boost"), 4))
        meaning = semantic.hits(meaning, compact=context == "compact").select(F.col("path").alias("file"), F.col("start_line").alias("line_start"), F.col("end_line").alias("line_end"), "score", "snippet", "engine", "file_id")
        rows = meaning.withColumn("source", F.lit(1)) if mode == "semantic" else fusion.hybrid(hits, meaning)
        return fusion_ord(rows.withColumn("key", F.struct("source", -F.col("score"), "file_id", "line_start")), columns, ["key"])

    def _boosted(self, rows: DataFrame) -> DataFrame:
        return recency.boosted(rows, self.state, F.current_timestamp()) if self.state is not None else rows.withColumn("git_boost", F.lit(0.0))

    def scan_signals(self, **options) -> DataFrame:
        return signals.scan(self.files, **options)

    # -- structure ------------------------------------------------------------------------------------------------

    def find_symbol(self, query: str, **options) -> DataFrame:
        return symbols.find(self.symbol_table, query, **options)

    def find_references(self, query: str, **options) -> DataFrame:
        return symbols.references(self.symbol_table, self.symbol_edges, query, **options)

    def find_callers(self, query: str, **options) -> DataFrame:
        return symbols.callers(self.symbol_table, self.symbol_edges, query, **options)

    def find_callees(self, query: str, **options) -> DataFrame:
        return symbols.callees(self.symbol_table, self.symbol_edges, query, **options)

    def find_implementations(self, query: str, **options) -> DataFrame:
        return symbols.implementations(self.symbol_table, self.symbol_edges, query, **options)

    def find_tests(self, query: str, **options) -> DataFrame:
        return symbols.tests(self.symbol_table, self.symbol_edges, query, **options)

    def explain_impact(self, query: str) -> DataFrame:
        return symbols.explain(self.symbol_table, self.symbol_edges, query)

    def dep_imports(self, path: str) -> DataFrame:
        return graph.direct_imports(self.edges, path)

    def dep_impact(self, path: str, *, max_hops: int = graph.MAX_HOPS) -> DataFrame:
        return graph.impact(self.edges, path, max_hops=max_hops)

    def read_block(self, path: str, line: int) -> DataFrame:
        return blocks.read(self.spark.createDataFrame([(path, line)], "path string, line int"), self.files)

    def skeleton(self, path: str, lines: list[int] | None = None) -> DataFrame:
        keep = self.spark.createDataFrame([(path, n) for n in lines or []], "path string, line int")
        return blocks.skeletons(self.files.where(F.col("path") == path), keep)

    def stats(self) -> DataFrame:
        """One row: files, bytes, chunks, edges, symbols, relations; null for a table that isn't there."""
        row = corpus.statistics(self.files.withColumn("size", F.octet_length("text")))
        for name, table in (("chunks", self.chunks), ("edges", self.edges), ("symbols", self.symbol_table), ("relations", self.symbol_edges)):
            one = table.agg(F.count("*").alias(name)) if table is not None else self.spark.createDataFrame([(None,)], f"{name} long")
            row = row.join(F.broadcast(one))  # one row
        return row

    # -- plans ----------------------------------------------------------------------------------------------------

    def plan_change(self, request: str, *, top_k: int = 8, budget: int = 6000) -> tuple[DataFrame, DataFrame]:
        """(plan, summary) of one request."""
        request = (request or "").strip()
        if not request or not 1 <= top_k <= 50 or not 256 <= budget <= 100_000:
            raise ValueError("a plan needs a request, top_k from 1 to 50 and a budget from 256 to 100000")
        terms = self.spark.range(1).select(query_terms(F.lit(request)).alias("t")).first()["t"]
        pattern = self._boosted(stored(planner.pattern_candidates(self.files, terms, top_k=top_k).drop("git_boost"), "plan-text"))
        found, seeds = pattern, []
        if self.symbol_table is not None:
            own, seeds = planner.symbol_candidates(self.symbol_table, self.files, terms, top_k=top_k)
            found = found.unionByName(self._boosted(own.drop("git_boost")))
        if self.chunks is not None:
            found = found.unionByName(self._boosted(planner.semantic_candidates(self.semantic_search(request, top_k)).drop("git_boost")))
        first = stored(planner.ordered(found).where(F.col("section") == planner.SECTIONS[0]).groupBy("path").agg(F.min("ord").alias("o")).orderBy("o").limit(top_k).select("path"), "plan-primary")
        parts = [found, planner.configuration_candidates(pattern), planner.test_candidates(pattern), planner.git_candidates(found)]
        if seeds:
            parts += [self._boosted(p.drop("git_boost")) for p in (planner.parent_candidates(self.symbol_table, self.files, seeds), planner.relation_candidates(self.symbol_table, self.symbol_edges, self.files, seeds))]
        if self.edges is not None:
            parts.append(self._boosted(planner.dependency_candidates(self.edges, self.files, first, top_k=top_k).drop("git_boost")))
        all_ = parts[0]
        for p in parts[1:]:
            all_ = all_.unionByName(p)
        requests = self.spark.createDataFrame([(0, request, top_k, budget)], "request_id int, request string, top_k int, budget int")
        plan = stored(planner.allocate(planner.bounded(all_), requests), "plan")
        return plan, planner.summary(plan, dependency_ready=self.edges is not None, symbol_ready=self.symbol_table is not None, semantic_ready=self.chunks is not None)


def _dependencies(files: DataFrame) -> DataFrame:
    return files.where((F.octet_length("text") > 0) & extension("path").isin(DEPENDENCY_EXTENSIONS))


def _meaning(files: DataFrame) -> DataFrame:
    return files.where(extension("path").isin(SEMANTIC_EXTENSIONS) & (F.octet_length("text") > 0))


def fusion_ord(rows: DataFrame, columns: list[str], order: list[str]) -> DataFrame:
    """A page of hits with its order as `ord`. The window's one task holds that page only."""
    return rows.select(*columns, F.row_number().over(Window.orderBy(*order)).cast("long").alias("ord"))

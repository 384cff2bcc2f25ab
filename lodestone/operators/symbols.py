"""Symbols of C# sources and the typed relations between them.

Declarations are read file by file in Python (a grammar, not a relation); all that follows, resolving names to symbols
and every query, is relational.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import digest_id
from ..schemas import RAW_SYMBOL_EDGES, SYMBOLS

#: Kinds, confidences with provenance, preferred kinds of a relation's target, and declaration patterns.
TYPES = ["class", "struct", "interface", "enum", "record"]
CONFIDENCE = {
    "using-directive": 1.00, "implements": 0.86, "inherits": 0.78, "override-modifier": 0.91, "signature-type": 0.82, "property-type": 0.88,
    "field-type": 0.88, "new-expression": 0.93, "call-shape": 0.58, "aspnet-di-registration": 0.97,
}
PREFERRED = {
    "imports": ["namespace"], "implements": ["interface"], "inherits": TYPES, "overrides": ["method"], "references": TYPES,
    "instantiates": ["class", "struct", "record"], "calls": ["method", "constructor", "endpoint", "test"], "configured_by": TYPES,
}
NOT_CALLED = {"if", "for", "foreach", "while", "switch", "catch", "lock", "using", "new"}
_MODS = r"(?P<mods>(?:(?:public|private|protected|internal|static|abstract|sealed|partial|readonly|virtual|override|async|extern|unsafe|new|required|const)\s+)*)"
_ATTRS = r"(?P<attrs>(?:\[[^\]\n]+\][ \t]*\n[ \t]*)*)"
_TYPE_NAME, _NAME = r"[A-Za-z_][\w.<>,?\[\]]*", r"[A-Za-z_]\w*"
_PATTERNS = {
    "namespace": re.compile(rf"(?m)^\s*namespace\s+({_NAME}(?:\.{_NAME})*)"),
    "using": re.compile(rf"(?m)^\s*using\s+(?:static\s+)?(?:{_NAME}\s*=\s*)?({_NAME}(?:\.{_NAME})*)\s*;"),
    "type": re.compile(rf"(?m)^[ \t]*{_ATTRS}{_MODS}(?P<kind>class|struct|interface|enum|record)\s+(?P<name>{_NAME})(?:\s*<[^>{{;\n]+>)?(?:\s*:\s*(?P<bases>[^\{{;\n]+))?"),
    "method": re.compile(rf"(?m)^[ \t]*{_ATTRS}{_MODS}(?P<type>{_TYPE_NAME})\s+(?P<name>{_NAME})\s*\((?P<params>[^)]*)\)\s*(?P<tail>\{{|=>|;)"),
    "property": re.compile(rf"(?m)^[ \t]*{_MODS}(?P<type>{_TYPE_NAME})\s+(?P<name>{_NAME})\s*\{{"),
    "field": re.compile(rf"(?m)^[ \t]*{_MODS}(?P<type>{_TYPE_NAME})\s+(?P<name>{_NAME})(?:\s*=\s*[^;\n]+)?\s*;"),
    "test": re.compile(r"\[(?:Fact|Theory|Test|TestMethod)\b"),
    "endpoint": re.compile(r"\[Http(?:Get|Post|Put|Delete|Patch|Head|Options)\b"),
    "creation": re.compile(rf"\bnew\s+({_NAME})\s*\("),
    "call": re.compile(rf"(?:\b{_NAME}\s*\.)?\b({_NAME})\s*\("),
    "accessor": re.compile(r"\b(?:get|set|init)\s*(?:;|\{)"),
    "registration": re.compile(rf"\bAdd(?:Scoped|Transient|Singleton)\s*<\s*({_NAME})\s*,\s*({_NAME})\s*>"),
    "capital": re.compile(r"\b[A-Z][A-Za-z0-9_]*\b"),
}
PARSER, PARSER_VERSION = "csharp-heuristic", "2"

_QUIET = re.compile(r"""//[^\n]*|/\*.*?(?:\*/|\Z)|@"(?:[^"]|"")*(?:"|\Z)|"(?:\\.|[^"\\])*(?:"|\Z)|'(?:\\.|[^'\\])*(?:'|\Z)""", re.S)


def blanked(text: str) -> str:
    """The text with comments and literals as spaces; offsets and line feeds stay."""
    return _QUIET.sub(lambda m: re.sub(r"[^\n]", " ", m.group()), text)


def _id(*parts: str) -> str:
    return "sym:" + hashlib.sha256("\x1f".join(parts).encode()).hexdigest()[:24]


class Source:
    """One file: its code without comments, the partner and depth of every brace, and what has been found."""

    def __init__(self, path: str, text: str):
        self.path, self.text, self.code = path, text, blanked(text)
        self.lines = [m.start() for m in re.finditer("\n", text)]
        self.partner, self.places, self.depths, open_ = {}, [], [], []
        for m in re.finditer(r"[{}]", self.code):
            if m.group() == "{":
                open_.append(m.start())
            elif open_:
                self.partner[open_.pop()] = m.start()
            self.places.append(m.start())
            self.depths.append((self.depths[-1] if self.depths else 0) + (1 if m.group() == "{" else -1))
        self.symbols: dict[str, dict] = {}
        self.edges: list[dict] = []

    def line(self, at: int) -> int:
        return bisect_right(self.lines, at - 1) + 1

    def close(self, brace: int) -> int:
        return self.partner.get(brace, len(self.code) - 1)

    def depth(self, at: int) -> int:
        i = bisect_right(self.places, at - 1)
        return self.depths[i - 1] if i else 0

    def add(self, kind: str, name: str, qualified: str, first: int, last: int, parent: str | None, *, key: str = "", signature: str = "", visibility: str = "private", mods: list[str] | None = None) -> str:
        id_ = _id("csharp", self.path, qualified, kind, key)
        row = dict(id=id_, name=name, qualified_name=qualified, kind=kind, language="csharp", file_path=self.path, line_start=first, line_end=last, parent_symbol_id=parent, signature=signature, visibility=visibility, modifiers=mods or [], parser=PARSER, parser_version=PARSER_VERSION)
        self.symbols[id_] = {**row, "ord": self.symbols[id_]["ord"] if id_ in self.symbols else len(self.symbols)}
        return id_

    def relate(self, kind: str, source: str, target: str, at: int, provenance: str, confidence: float | None = None) -> None:
        self.edges.append(dict(kind=kind, source_symbol_id=source, target_name=target, file_path=self.path, line=self.line(at), confidence=CONFIDENCE[provenance] if confidence is None else confidence, provenance=provenance, ord=len(self.edges)))

    def read(self) -> Source:
        named = _PATTERNS["namespace"].search(self.code)
        space = named.group(1) if named else ""
        space_id = self.add("namespace", space.rpartition(".")[2], space, self.line(named.start()), self.line(named.end()), None, visibility="public") if named else None
        module = re.sub(r"\.[^.]*$", "", self.path.replace("\\", "/").rpartition("/")[2])
        module_id = self.add("module", module, f"{space}.{module}#module" if space else f"{module}#module", 1, len(self.lines) + 1, space_id, visibility="internal")
        for m in _PATTERNS["using"].finditer(self.code):
            self.relate("imports", module_id, m.group(1), m.start(), "using-directive")
        for m in _PATTERNS["type"].finditer(self.code):
            brace = self.code.find("{", m.end())
            if brace >= 0 and ";" not in self.code[m.end() : brace]:
                self._type(m, brace, space, space_id or module_id)
        for m in _PATTERNS["registration"].finditer(self.code):
            self.relate("configured_by", module_id, m.group(2), m.start(), "aspnet-di-registration")
        return self

    def _type(self, m: re.Match, brace: int, space: str, parent: str) -> None:
        name, kind, mods = m["name"], m["kind"], m["mods"].split()
        qualified, end = (f"{space}.{name}" if space else name), self.close(brace)
        id_ = self.add(kind, name, qualified, self.line(m.start()), self.line(end), parent, signature=self.text[m.start() : brace].strip(), visibility=_visibility(mods, "internal"), mods=mods)
        for base in (m["bases"] or "").split(","):
            words = re.sub(r"<.*>", "", base).split()
            if words:
                target = words[-1].rpartition(".")[2]
                relation = "implements" if target.startswith("I") else "inherits"
                self.relate(relation, id_, target, m.start(), "declaration", CONFIDENCE[relation])
        start, inner = brace + 1, self.depth(brace) + 1
        body = self.code[start:end]
        built = re.compile(rf"(?m)^[ \t]*{_ATTRS}{_MODS}{re.escape(name)}\s*\((?P<params>[^)]*)\)\s*(?P<tail>\{{|=>|;)")
        members = sorted([(x.start(), 0, x) for x in built.finditer(body)] + [(x.start(), 1, x) for x in _PATTERNS["method"].finditer(body)], key=lambda x: x[:2])
        seen = set()
        for at, is_method, x in members:
            label = x["name"] if is_method else name
            if self.depth(start + at) == inner and (at, label) not in seen:
                seen.add((at, label))
                self._member(x, start, label, bool(is_method), name, qualified, kind, id_)
        for what in ("property", "field"):
            for x in _PATTERNS[what].finditer(body):
                if self.depth(start + x.start()) == inner:
                    self._value(x, what, start, qualified, id_)

    def _member(self, x: re.Match, start: int, label: str, method: bool, owner: str, qualified: str, owner_kind: str, parent: str) -> None:
        at, end = start + x.start(), start + x.end()
        mods, params, signature = x["mods"].split(), " ".join(x["params"].split()), self.text[at:end].strip()
        kind = "test" if _PATTERNS["test"].search(x["attrs"] or "") else "method" if method else "constructor"
        if x["tail"] == "{":
            end = self.close(end - 1)
        own = f"{qualified}.{label}"
        seen = dict(signature=signature, mods=mods, key=params)
        id_ = self.add(kind, label, own, self.line(at), self.line(end), parent, visibility=_visibility(mods, "public" if owner_kind == "interface" else "private"), **seen)
        if "override" in mods:
            self.relate("overrides", id_, label, at, "override-modifier")
        for target in dict.fromkeys(_PATTERNS["capital"].findall(x["params"] + (" " + x["type"] if method else ""))):
            if target != owner:
                self.relate("references", id_, target, at, "signature-type")
        if _PATTERNS["endpoint"].search(x["attrs"] or ""):
            self.add("endpoint", label, f"{own}#endpoint", self.line(at), self.line(end), id_, visibility=_visibility(mods, "public"), **seen)
        code = self.code[at : end + 1]
        for m in _PATTERNS["creation"].finditer(code):
            self.relate("instantiates", id_, m.group(1), at + m.start(), "new-expression")
        for m in _PATTERNS["call"].finditer(code):
            if m.group(1) not in NOT_CALLED and m.group(1) != label:
                self.relate("calls", id_, m.group(1), at + m.start(), "call-shape")

    def _value(self, x: re.Match, what: str, start: int, qualified: str, parent: str) -> None:
        at, end, mods = start + x.start(), start + x.end(), x["mods"].split()
        if what == "property":
            close = self.close(end - 1)
            if not _PATTERNS["accessor"].search(self.code[end:close]):
                return
            last = close
        else:
            what, last = ("constant" if "const" in mods else "field"), end
        id_ = self.add(what, x["name"], f"{qualified}.{x['name']}", self.line(at), self.line(last), parent, key=x["type"], signature=self.text[at:end].strip(), visibility=_visibility(mods, "private"), mods=mods)
        self.relate("references", id_, x["type"].partition("<")[0], at, "property-type" if what == "property" else "field-type")


def _visibility(mods: list[str], default: str) -> str:
    return next((v for v in ("public", "protected", "internal", "private") if v in mods), default)


def extract(files: DataFrame, *, text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(symbols, raw relations) of all .cs files. `ord` numbers them within the file."""
    rows = files.where(F.lower("path").endswith(".cs")).select("path", F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(parts: Iterator[pd.DataFrame], what: str) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in (SYMBOLS if what == "symbols" else RAW_SYMBOL_EDGES).split(", ")]
        for part in parts:
            found = []
            for path, text in zip(part["path"], part["text"]):
                source = Source(path, text).read()
                found += source.symbols.values() if what == "symbols" else source.edges
            yield pd.DataFrame(found, columns=names)

    return rows.mapInPandas(lambda p: run(p, "symbols"), SYMBOLS), rows.mapInPandas(lambda p: run(p, "edges"), RAW_SYMBOL_EDGES)


def resolve(symbols: DataFrame, raw: DataFrame) -> DataFrame:
    """Relations with their targets: of the symbols of that name or qualified name, other than the source, the first of
    a preferred kind, else the first; none keeps a null target. Relations inside tests also give tested_by, turned round.

    Of each name and kind only the first two symbols can be a target (the second where the first is the source itself),
    so a name that many symbols share meets its relations with a few rows.
    """
    named = symbols.select(F.explode(F.array_distinct(F.array(F.lower("name"), F.lower("qualified_name")))).alias("_key"), F.col("id").alias("target_symbol_id"), F.col("kind").alias("_kind"), F.struct("file_path", "ord").alias("_ord"))
    named = named.withColumn("_n", F.row_number().over(Window.partitionBy("_key", "_kind").orderBy("_ord"))).where("_n <= 2").drop("_n")
    wanted = F.create_map(*[x for k, v in PREFERRED.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    keyed = raw.withColumn("_row", F.struct("file_path", "ord")).withColumn("_key", F.lower("target_name"))
    found = keyed.join(named, "_key").where(F.col("target_symbol_id") != F.col("source_symbol_id"))
    rank = F.struct((~F.coalesce(F.array_contains(wanted[F.col("kind")], F.col("_kind")), F.lit(False))).alias("other"), "_ord")
    target = found.groupBy("_row").agg(F.min_by("target_symbol_id", rank).alias("target_symbol_id"))
    edges = keyed.join(target, "_row", "left")
    edges = edges.withColumn("id", digest_id("edge", "kind", "source_symbol_id", "target_symbol_id", "target_name", "file_path", "line"))
    edges = edges.withColumn("_n", F.row_number().over(Window.partitionBy("id").orderBy("_row"))).where("_n = 1")
    names = ["id", "kind", "source_symbol_id", "target_symbol_id", "target_name", "file_path", "line", "confidence", "provenance", "ord"]
    edges = edges.select(*names)
    source = symbols.select(F.col("id").alias("source_symbol_id"), F.col("name").alias("_test"), F.col("kind").alias("_test_kind")).where("_test_kind = 'test'")
    known = symbols.select(F.col("id").alias("target_symbol_id"))
    tested = edges.where(F.col("kind").isin("calls", "instantiates", "references")).join(source, "source_symbol_id").join(known, "target_symbol_id", "left_semi")
    tested = tested.select(
        digest_id("edge", F.lit("tested_by"), "target_symbol_id", "source_symbol_id", "_test", "file_path", "line").alias("id"), F.lit("tested_by").alias("kind"),
        F.col("target_symbol_id").alias("source_symbol_id"), F.col("source_symbol_id").alias("target_symbol_id"), F.col("_test").alias("target_name"),
        "file_path", "line", F.least(F.lit(0.9), "confidence").alias("confidence"), F.concat(F.lit("test-"), "provenance").alias("provenance"), "ord",
    )
    tested = tested.withColumn("_n", F.row_number().over(Window.partitionBy("id").orderBy("file_path", "ord"))).where("_n = 1").drop("_n")
    return edges.unionByName(tested).withColumn("parser", F.lit(PARSER)).withColumn("parser_version", F.lit(PARSER_VERSION))


def find(symbols: DataFrame, query: str, *, kind: str | None = None, k: int = 20) -> DataFrame:
    """Symbols by name: equal, then beginning with the query or ending in .query, then containing it."""
    needle = query.strip().lower()
    name, full = F.lower("name"), F.lower("qualified_name")
    match = F.when((name == needle) | (full == needle), 0).when(name.startswith(needle) | full.endswith("." + needle), 1).when(name.contains(needle) | full.contains(needle), 2)
    found = symbols.withColumn("match", match).where(F.lit(needle != "") & F.col("match").isNotNull())
    found = found.where(F.col("kind") == kind) if kind else found
    return found.orderBy("match", full, "file_path", "line_start").limit(max(1, min(k, 100)))


def _targets(symbols: DataFrame, query: str) -> tuple[DataFrame, DataFrame]:
    """(ids, names) that a query means: of up to 100 symbols, and its own last part."""
    found = find(symbols, query, k=100)
    own = symbols.sparkSession.createDataFrame([(query.strip().lower().rpartition(".")[2],)], "_name string")
    return found.select(F.col("id").alias("_id"), "kind"), found.select(F.lower("name").alias("_name")).unionByName(own).distinct()


def _pointing(edges: DataFrame, ids: DataFrame, names: DataFrame) -> DataFrame:
    """Relations to one of the ids or by one of the names: two semi-joins instead of a condition with `or`."""
    by_id = edges.join(ids, edges["target_symbol_id"] == ids["_id"], "left_semi")
    return by_id.unionByName(edges.join(names, F.lower(edges["target_name"]) == names["_name"], "left_semi")).dropDuplicates(["id"])


def _ends(symbols: DataFrame, prefix: str) -> DataFrame:
    return symbols.select(F.col("id").alias(f"{prefix}_symbol_id"), F.col("name").alias(f"{prefix}_name_"), F.col("qualified_name").alias(prefix), F.col("file_path").alias(f"{prefix}_file"), F.col("line_start").alias(f"{prefix}_line"), F.col("kind").alias(f"{prefix}_kind"))


def references(symbols: DataFrame, edges: DataFrame, query: str, *, kinds: list[str] | None = None, k: int = 50) -> DataFrame:
    """Relations to what a query means, with source and (where known) target; by confidence, file and line."""
    ids, names = _targets(symbols, query)
    found = edges.where(F.col("kind").isin(kinds)) if kinds else edges
    found = _pointing(found, ids, names).join(_ends(symbols, "source"), "source_symbol_id").join(_ends(symbols, "target"), "target_symbol_id", "left")
    return found.orderBy(F.col("confidence").desc(), "source_file", "line", "ord").limit(max(1, min(k, 200)))


def callers(symbols: DataFrame, edges: DataFrame, query: str, *, k: int = 50) -> DataFrame:
    return references(symbols, edges, query, kinds=["calls"], k=k)


def callees(symbols: DataFrame, edges: DataFrame, query: str, *, k: int = 50) -> DataFrame:
    ids = find(symbols, query, k=100).select(F.col("id").alias("source_symbol_id"))
    found = edges.where("kind = 'calls'").join(ids, "source_symbol_id", "left_semi").join(_ends(symbols, "source"), "source_symbol_id").join(_ends(symbols, "target"), "target_symbol_id", "left")
    return found.orderBy(F.col("confidence").desc(), F.lower("target_name"), "line", "ord").limit(max(1, min(k, 200)))


def implementations(symbols: DataFrame, edges: DataFrame, query: str, *, k: int = 20) -> DataFrame:
    """Types that implement or inherit what a query means, each once by its first such relation."""
    ids, names = _targets(symbols, query)
    found = _pointing(edges.where(F.col("kind").isin("implements", "inherits")), ids.where(F.col("kind").isin(TYPES)), names)
    found = found.withColumn("_n", F.row_number().over(Window.partitionBy("source_symbol_id").orderBy("file_path", "ord"))).where("_n = 1").drop("_n")
    return found.join(_ends(symbols, "source"), "source_symbol_id").orderBy("source", "source_file").limit(max(1, min(k, 100)))


def tests(symbols: DataFrame, edges: DataFrame, query: str, *, k: int = 50) -> DataFrame:
    """Tests of what a query means, each once."""
    ids, names = _targets(symbols, query)
    own = edges.where("kind = 'tested_by'").join(_ends(symbols, "source"), "source_symbol_id")
    by_id = own.join(ids, own["source_symbol_id"] == ids["_id"], "left_semi")
    found = by_id.unionByName(own.join(names, F.lower(own["source_name_"]) == names["_name"], "left_semi")).dropDuplicates(["id"])
    found = found.withColumn("_n", F.row_number().over(Window.partitionBy("target_symbol_id").orderBy("file_path", "ord"))).where("_n = 1").drop("_n")
    return found.join(_ends(symbols, "target"), "target_symbol_id").orderBy("target_file", "target_line").limit(max(1, min(k, 200)))


def explain(symbols: DataFrame, edges: DataFrame, query: str) -> DataFrame:
    """relation, n: how many references, callers, callees, implementations, tests and configurations a query's symbols have."""
    parts = [("references", references(symbols, edges, query, k=200)), ("callers", callers(symbols, edges, query, k=200)), ("callees", callees(symbols, edges, query, k=200)), ("implementations", implementations(symbols, edges, query, k=100)), ("tests", tests(symbols, edges, query, k=200)), ("configurations", references(symbols, edges, query, kinds=["configured_by"], k=200))]
    rows = None
    for name, part in parts:
        one = part.agg(F.count("*").alias("n")).select(F.lit(name).alias("relation"), "n")
        rows = one if rows is None else rows.unionByName(one)
    return rows


def listing(symbols: DataFrame) -> DataFrame:
    return symbols.orderBy("file_path", "line_start", "kind")


def updated(symbols: DataFrame, raw: DataFrame, changed: DataFrame, *, text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Symbols and raw relations after the files in changed(path, text) were read again; a null text is a deleted file."""
    paths = changed.select(F.col("path").alias("file_path"))
    new_symbols, new_raw = extract(changed.where(F.col(text_col).isNotNull()), text_col=text_col)
    return new_symbols.unionByName(symbols.join(paths, "file_path", "left_anti")), new_raw.unionByName(raw.join(paths, "file_path", "left_anti"))

"""Dependency graph: imports, their resolution to files, and reverse closures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.paths import collapsed, extension, folder
from ..tables import stored

_JS = r"""(?:import\s+(?:.*?\s+from\s+)?|require\s*\(\s*)['"]([^'"]+)['"]"""
#: Import patterns by extension. That of Python's `import` takes white space, and with it the lines that follow.
IMPORTS = {
    ".py": [r"(?mU)^\s*from\s+([\w.]+)\s+import", r"(?mU)^\s*import\s+([\w.,\s]+)"],
    ".js": [_JS], ".ts": [_JS], ".tsx": [_JS], ".jsx": [_JS],
    ".go": [r'"([^"]+)"'],
    ".rs": [r"(?mU)^\s*(?:use|mod)\s+([\w:]+)"],
    ".java": [r"(?mU)^\s*import\s+(?:static\s+)?([\w.]+)(?:\.\*)?;"],
    ".cs": [r"(?mU)^\s*(?:global\s+)?using\s+(?:static\s+)?(?:\w+\s*=\s*)?([\w.]+);"],
    ".rb": [r"""(?mU)^\s*require(?:_relative)?\s+['"]([^'"]+)['"]"""],
}
#: Extensions and index files tried for a script's import, in this order.
SCRIPTS = [".js", ".ts", ".tsx", ".jsx"]
TRIED, INDEXES = [".ts", ".tsx", ".js", ".jsx"], ["index.ts", "index.tsx", "index.js", "index.jsx"]
DOTTED = [".py", ".java", ".cs", ".rs"]
_CS_TYPE = r"\b(?:public|private|protected|internal|sealed|abstract|static|partial|readonly|file|\s)*(class|interface|record|struct|enum)\s+(\w+)(?:\s*:\s*([^{;\n]+))?"
MAX_HOPS = 20


def imports(files: DataFrame, *, text_col: str = "text") -> DataFrame:
    """src, nth, raw, reason: what each file imports, as written, in the order of patterns and places."""
    ext, text = extension("path"), F.coalesce(F.col(text_col), F.lit(""))
    found = F.array().cast("array<string>")
    for e, patterns in IMPORTS.items():
        listed = F.concat(*[F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in patterns])
        found = F.when(ext == e, listed).otherwise(found)
    parts = F.flatten(F.transform(found, lambda x: F.transform(F.split(x, ","), lambda y: F.regexp_replace(y, r"(?U)^\s+|\s+$", ""))))
    rows = files.where(ext.isin(list(IMPORTS))).select(F.col("path").alias("src"), F.posexplode(parts).alias("nth", "raw"))
    e = extension("src")
    reason = F.when(e.isin(".py", *SCRIPTS), F.concat(F.lit("imports module "), "raw")).when(e == ".cs", F.concat(F.lit("imports namespace "), "raw")).otherwise(F.lit("heuristic dependency edge"))
    return rows.withColumn("reason", reason)


def _script_candidates(base: Column) -> Column:
    bare = F.regexp_replace(base, r"\.js$", "")
    return F.array(*[F.concat(base, F.lit(e)) for e in TRIED], *[F.concat(bare, F.lit(e)) for e in TRIED], *[F.concat(base, F.lit("/" + i)) for i in INDEXES], base)


def resolve(found: DataFrame, files: DataFrame, aliases: dict[str, list[str]] | None = None) -> DataFrame:
    """found(src, nth, raw, ...) with dst: the file that an import means, for those that mean one.

    Candidate paths are exploded with their priority and joined by equality; the first that exists is taken. Names with
    dots mean any file whose path ends with them (without regard to a separator): joined by the end of the file's name,
    then compared whole, the smallest path taken. aliases: prefix -> roots, "" for bare imports.
    """
    e, raw = extension("src"), F.col("raw")
    script = e.isin(SCRIPTS)
    local = F.rlike(raw, F.lit(r"^[./]"))
    base = collapsed(F.when(F.startswith(raw, F.lit("/")), raw).otherwise(F.concat_ws("/", F.nullif(folder("src"), F.lit("")), raw)))
    tried = F.when(local, F.when(script, _script_candidates(base)).otherwise(F.array(base)))
    if aliases:
        options = []
        for prefix in sorted((p for p in aliases if p), key=len, reverse=True):
            rest = F.substring(raw, len(prefix) + 1, 10**6)
            fits = (raw == prefix) | F.startswith(raw, F.lit(prefix + "/"))
            options += [F.when(fits, _script_candidates(collapsed(F.concat(F.lit(root), rest)))).otherwise(F.array().cast("array<string>")) for root in aliases[prefix]]
        options += [_script_candidates(collapsed(F.concat(F.lit(root + "/"), raw))) for root in aliases.get("", [])]
        tried = F.coalesce(tried, F.when(script, F.concat(*options)))
    keyed = found.withColumn("_id", F.struct("src", "nth")).withColumn("_ext", e).withColumn("_local", local)
    paths = files.select(F.col("path").alias("dst"))
    exact = keyed.select("_id", F.posexplode(tried).alias("priority", "dst")).join(paths, "dst")
    exact = exact.groupBy("_id").agg(F.min_by("dst", "priority").alias("dst"))
    name = F.substring_index("dst", "/", -1)
    ends = paths.select("dst", name.alias("_name")).select("dst", F.explode(F.transform(F.sequence(F.lit(1), F.length("_name")), lambda i: F.substring(F.col("_name"), i, F.length("_name")))).alias("end"))
    dotted = keyed.where(~F.col("_local") & F.col("_ext").isin(DOTTED)).select("_id", F.concat(F.translate("raw", ".", "/"), "_ext").alias("as_path"))
    dotted = dotted.withColumn("end", F.substring_index("as_path", "/", -1)).join(ends, "end").where(F.endswith("dst", F.col("as_path")))
    dotted = dotted.groupBy("_id").agg(F.min("dst").alias("dst"))
    both = exact.withColumn("p", F.lit(0)).unionByName(dotted.withColumn("p", F.lit(1))).groupBy("_id").agg(F.min_by("dst", "p").alias("dst"))
    return keyed.join(both, "_id").drop("_id", "_ext", "_local")


def csharp_names(files: DataFrame, *, text_col: str = "text") -> DataFrame:
    """path, usings, namespaces, types, interfaces, base_types of C# files: sorted and distinct."""
    text = F.coalesce(F.col(text_col), F.lit(""))

    def every(pattern: str, group: int) -> Column:
        return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))

    pattern = "(?mU)" + _CS_TYPE
    kinds, names, bases = every(pattern, 1), every(pattern, 2), every(pattern, 3)
    interfaces = F.filter(F.zip_with(kinds, names, lambda k, n: F.when(k == "interface", n)), lambda x: x.isNotNull())
    base_names = F.flatten(F.transform(F.filter(bases, lambda b: b != ""), lambda b: F.split(b, ",")))
    base_names = F.transform(base_names, lambda b: F.trim(F.substring_index(F.substring_index(F.trim(b), ".", -1), "<", 1)))

    def tidy(values: Column) -> Column:
        return F.array_sort(F.array_distinct(values))

    return files.where(extension("path") == ".cs").select(
        "path", tidy(every(IMPORTS[".cs"][0], 1)).alias("usings"), tidy(every(r"(?U)\bnamespace\s+([\w.]+)", 1)).alias("namespaces"),
        tidy(names).alias("types"), tidy(interfaces).alias("interfaces"), tidy(base_names).alias("base_types"),
        F.array_distinct(every(r"(?U)\w+", 0)).alias("words"),
    )


def csharp_edges(names: DataFrame) -> DataFrame:
    """src, dst, reason from namespaces and base types; a base type's reason outranks a namespace's.

    Type references are found by joining the words of a file with the types of the other, not by searching each text for each type.
    """
    sources = names.select(F.col("path").alias("src"), "usings", "base_types", "words")
    spaces = names.select(F.col("path").alias("dst"), F.explode("namespaces").alias("name"), "types", "interfaces")
    used = sources.select("src", "base_types", "words", F.explode("usings").alias("name")).join(spaces, "name").where("src <> dst")
    named = F.get(F.array_sort(F.array_intersect("types", "words")), F.lit(0))
    kind = F.when(F.array_contains("base_types", F.col("t")), F.when(F.array_contains("interfaces", F.col("t")), F.lit("implements interface ")).otherwise(F.lit("inherits from "))).otherwise(F.lit("references type "))
    used = used.withColumn("t", named).select("src", "dst", F.when(F.col("t").isNull(), F.concat(F.lit("imports namespace "), "name")).otherwise(F.concat(kind, "t")).alias("reason"), F.lit(1).alias("p"), F.col("name").alias("by"))
    types = names.select(F.col("path").alias("dst"), F.explode("types").alias("name"), "interfaces")
    bases = sources.select("src", F.explode("base_types").alias("name")).join(types, "name").where("src <> dst")
    bases = bases.select("src", "dst", F.concat(F.when(F.array_contains("interfaces", F.col("name")), F.lit("implements interface ")).otherwise(F.lit("inherits from ")), "name").alias("reason"), F.lit(2).alias("p"), F.col("name").alias("by"))
    # Later names overwrite earlier ones.
    return used.unionByName(bases).groupBy("src", "dst").agg(F.max_by("reason", F.struct("p", "by")).alias("reason"))


def edges(files: DataFrame, aliases: dict[str, list[str]] | None = None, *, text_col: str = "text") -> DataFrame:
    """src, dst, reason of all files: one edge a pair, without loops."""
    return edges_of(imports(files, text_col=text_col), csharp_names(files, text_col=text_col), files, aliases)


def edges_of(found: DataFrame, names: DataFrame, files: DataFrame, aliases: dict[str, list[str]] | None = None) -> DataFrame:
    """The same from imports(), csharp_names() and the files' paths: after a change only the changed files' texts are read."""
    plain = resolve(found, files, aliases).where("src <> dst")
    plain = plain.groupBy("src", "dst").agg(F.min_by("reason", "nth").alias("reason")).withColumn("p", F.lit(0))
    sharp = csharp_edges(names).withColumn("p", F.lit(1))
    return plain.unionByName(sharp).groupBy("src", "dst").agg(F.max_by("reason", "p").alias("reason"))


def direct_imports(graph: DataFrame, path: str) -> DataFrame:
    return graph.where(F.col("src") == path).select("dst", "reason")


def closure(graph: DataFrame, targets: DataFrame, *, max_hops: int = MAX_HOPS) -> DataFrame:
    """source, file, hops: for every source in targets(source) the files that depend on it, with the fewest steps.

    A frontier a step, kept apart from what was reached before; each step is stored in the shared folder, so plans stay
    short and lost executors cost one step. Cycles end by themselves.
    """
    back = graph.where("src <> dst").select(F.col("dst").alias("file"), F.col("src").alias("next")).distinct()
    front = stored(targets.select("source", F.col("source").alias("file"), F.lit(0).alias("hops")).distinct(), "closure")
    reached = front
    for hop in range(1, max_hops + 1):
        step = front.join(back, "file").select("source", F.col("next").alias("file")).distinct()
        front = stored(step.join(reached.select("source", "file"), ["source", "file"], "left_anti").select("source", "file", F.lit(hop).alias("hops")), "closure")
        if front.isEmpty():
            break
        reached = reached.unionByName(front)
    return reached.where("hops > 0")


def impact(graph: DataFrame, path: str, *, max_hops: int = MAX_HOPS) -> DataFrame:
    """file, hops, reason: who depends on a file; the reason is known for direct importers only."""
    targets = graph.sparkSession.createDataFrame([(path,)], "source string")
    found = closure(graph, targets, max_hops=max_hops)
    direct = graph.where(F.col("dst") == path).select(F.col("src").alias("file"), F.col("reason"))
    direct = direct.groupBy("file").agg(F.min("reason").alias("reason"))
    return found.join(direct, "file", "left").select("file", "hops", F.when(F.col("hops") == 1, F.col("reason")).alias("reason")).orderBy("hops", "file")


def blast_radius(found: DataFrame) -> DataFrame:
    """file, hops: over several sources the fewest steps to any; sources themselves are left out."""
    least = found.groupBy("file").agg(F.min("hops").alias("hops"))
    return least.join(found.select(F.col("source").alias("file")).distinct(), "file", "left_anti")


def by_hop(found: DataFrame, shown: int = 20) -> DataFrame:
    """hops, file, n: the first files of each step, with the step's size. The size is a join of sums, so no step meets in one task."""
    sizes = found.groupBy("hops").agg(F.count("*").alias("n"))
    first = found.withColumn("rank", F.row_number().over(Window.partitionBy("hops").orderBy("file"))).where(F.col("rank") <= shown)
    return first.join(sizes, "hops").select("hops", "rank", "file", "n")

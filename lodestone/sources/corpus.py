"""Files of a folder as a table, and the packed address space over them."""

from __future__ import annotations

import json
import re
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.paths import EXACT_EXTENSIONS, SKIPPED_FOLDERS, extension, is_skipped
from ..tables import shared_dir, stored

MAX_BYTES = 5 * 1024 * 1024


def read_folder(spark: SparkSession, root: str, *, extensions: list[str] = EXACT_EXTENSIONS, max_bytes: int = MAX_BYTES, folders: list[str] = SKIPPED_FOLDERS, env_files: bool = False, keep_empty: bool = True) -> DataFrame:
    """path (below the root), size, mtime, content of the files to index.

    Folders to skip aren't entered, and only names of wanted kinds are listed. Spark's binaryFile reads on the executors, but
    passes over empty files and every name that begins with a dot or an underscore (.env, __init__.py, .github): empty ones
    come from the listing, hidden ones are first copied, as streams, under plain names to the shared folder.
    """
    wanted = [*extensions, ".env"] if env_files else list(extensions)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(root)
    system = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    base = system.makeQualified(hadoop).toString().rstrip("/") + "/"
    whole, found = _walk(system, hadoop, set(folders))
    empty, hidden = [], []
    for status in found:
        path, size, time = status.getPath(), status.getLen(), status.getModificationTime() / 1000
        name = path.toString()[len(base) :].lstrip("/")
        if size == 0:
            empty.append((name, 0, time))
        elif size <= max_bytes and any(step[0] in "._" for step in name.split("/")) and (name.lower().endswith(tuple(wanted)) or "/.env" in "/" + name.lower()):
            hidden.append((path, name, size, time))
    globs = ["*" + "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in e) for e in extensions]
    columns = [F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), "content"]
    if whole:
        rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "{" + ",".join(globs) + "}").load(whole)
        rows = rows.select(F.expr(f"substring(path, {len(base) + 1})").alias("path"), *columns)
        # Listings write file:///a as file:/a; either prefix is taken off.
        rows = rows.withColumn("path", F.regexp_replace(F.col("path"), r"^/+", ""))
    else:
        rows = spark.createDataFrame([], "path string, size long, mtime timestamp, content binary")
    if hidden:
        folder = f"{shared_dir(spark)}/lodestone-hidden-{uuid.uuid4().hex}"
        target = spark._jvm.org.apache.hadoop.fs.Path(folder)
        store, copied = target.getFileSystem(spark._jsc.hadoopConfiguration()), []
        for i, (path, name, size, time) in enumerate(hidden):
            spark._jvm.org.apache.hadoop.fs.FileUtil.copy(system, path, store, spark._jvm.org.apache.hadoop.fs.Path(folder, f"n{i}"), False, spark._jsc.hadoopConfiguration())
            copied.append((f"n{i}", name, size, time))
        names = spark.createDataFrame(copied, "_n string, path string, size long, t double").withColumn("mtime", F.timestamp_seconds("t"))
        contents = spark.read.format("binaryFile").load(folder).select(F.substring_index("path", "/", -1).alias("_n"), "content")
        rows = rows.unionByName(contents.join(names, "_n").select("path", "size", "mtime", "content"))
    if keep_empty:
        rest = spark.createDataFrame(empty, "path string, size long, t double").select("path", "size", F.timestamp_seconds("t").alias("mtime"), F.lit(b"").alias("content"))
        rows = rows.unionByName(rest)
    return rows.where(extension("path").isin(wanted) & (F.col("size") <= max_bytes) & ~is_skipped("path", folders))


def _walk(system, root, folders: set[str]) -> tuple[list[str], list]:
    """(paths that Spark may list as a whole, statuses that need a look: empty files, and those that a listing by Spark hides).

    A folder with nothing to skip below it is one path; otherwise its parts are.
    """
    statuses: list = []

    def hides(name: str) -> bool:
        return name.startswith((".", "_"))

    def literal(path) -> str:
        return re.sub(r"([\[\]{}*?\\])", r"\\\1", path.toString())  # Spark takes paths for patterns

    def enter(folder, below_hidden: bool) -> tuple[bool, list[str]]:
        clean, parts = True, []
        for status in system.listStatus(folder):
            name = status.getPath().getName()
            if status.isDirectory():
                if name.lower() in folders:
                    clean = False
                    continue
                inner, found = enter(status.getPath(), below_hidden or hides(name))
                if not hides(name):
                    clean = clean and inner
                    parts += found
            elif below_hidden or hides(name) or status.getLen() == 0:
                statuses.append(status)
            else:
                parts.append(literal(status.getPath()))
        return clean, ([literal(folder)] if clean and parts else parts)

    return enter(root, False)[1], statuses


def skipped(spark: SparkSession, root: str, **options) -> DataFrame:
    """One row: skipped, how many files of wanted kinds were too large."""
    limit = options.pop("max_bytes", MAX_BYTES)
    return read_folder(spark, root, max_bytes=2**62, **options).agg(F.count_if(F.col("size") > limit).alias("skipped"))


def numbered(files: DataFrame) -> DataFrame:
    """files (of distinct paths) with file_id, the place in path order from 0.

    Paths alone are dealt out by ranges, which are stored so that their bounds are drawn once; ranges are counted, and
    only a range is ordered in one task.
    """
    ranged = stored(files.select("path").repartitionByRange("path").withColumn("_part", F.spark_partition_id()), "path-ranges")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = ranged.groupBy("_part").agg(F.count("*").alias("n")).select("_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_base"))
    own = ranged.withColumn("_own", F.row_number().over(Window.partitionBy("_part").orderBy("path")) - 1)
    ids = own.join(base, "_part").select("path", (F.col("_base") + F.col("_own")).alias("file_id"))
    return files.join(ids, "path")


def packed(files: DataFrame, *, size: str = "size") -> DataFrame:
    """file_id, offset, length, end: places in one address space with a byte between files.

    The running sum is made in two levels, within runs of 1024 ids and over the runs.
    """
    rows = files.select("file_id", F.col(size).cast("long").alias("length")).withColumn("_run", F.floor(F.col("file_id") / 1024))
    sums = rows.groupBy("_run").agg(F.sum(F.col("length") + 1).alias("n"))
    base = sums.select("_run", F.coalesce(F.sum("n").over(Window.orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    within = Window.partitionBy("_run").orderBy("file_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_own", F.coalesce(F.sum(F.col("length") + 1).over(within), F.lit(0))).join(base, "_run")
    offset = F.col("_base") + F.col("_own")
    return rows.select("file_id", offset.alias("offset"), "length", (offset + F.col("length")).alias("end"))


def chunk_table(corpus_bytes: int, chunk: int, spark: SparkSession) -> DataFrame:
    """chunk_id, offset, valid_length of fixed-size chunks."""
    n = max(-(-corpus_bytes // chunk), 0)
    return spark.range(n).select(F.col("id").alias("chunk_id"), (F.col("id") * chunk).alias("offset"), F.least(F.lit(chunk), F.lit(corpus_bytes) - F.col("id") * chunk).cast("long").alias("valid_length"))


def located(hits: DataFrame, space: DataFrame, *, length: int) -> DataFrame:
    """hits(position) with file_id and place in the file; hits that reach beyond their file are dropped.

    An as-of join without a range condition: files' starts and hits are merged by place within runs of the address
    space, and each run begins with the last file before it.
    """
    run = 1 << 20
    starts = space.select(F.col("offset").alias("at"), F.lit(0).alias("hit"), F.struct("file_id", "offset", "end").alias("file"))
    spread = starts.withColumn("run", F.explode(F.sequence(F.floor(F.col("at") / run), F.floor(F.col("file.end") / run))))
    spread = spread.withColumn("at", F.greatest("at", F.col("run") * run))
    asked = hits.select(F.col("position").alias("at"), F.lit(1).alias("hit"), F.lit(None).cast("struct<file_id:bigint,offset:bigint,end:bigint>").alias("file")).withColumn("run", F.floor(F.col("at") / run))
    merged = spread.unionByName(asked).withColumn("file", F.last("file", ignorenulls=True).over(Window.partitionBy("run").orderBy("at", "hit")))
    found = merged.where((F.col("hit") == 1) & (F.col("at") + length <= F.col("file.end")))
    return found.select(F.col("at").alias("position"), "file.file_id", (F.col("at") - F.col("file.offset")).alias("in_file"))


def statistics(files: DataFrame, *, size: str = "size") -> DataFrame:
    """One row: files, source_bytes, corpus_bytes (with the bytes between files), largest."""
    n, total = F.count("*"), F.coalesce(F.sum(size), F.lit(0))
    return files.agg(n.alias("files"), total.alias("source_bytes"), (total + F.greatest(n - 1, F.lit(0))).alias("corpus_bytes"), F.max(size).alias("largest"))


def script_aliases(spark: SparkSession, folder: str) -> dict[str, list[str]]:
    """Alias roots of a script project's configuration, relative to its folder; files that aren't valid are passed over. "" holds the base."""
    found: dict[str, list[str]] = {}
    for name in ("tsconfig.json", "jsconfig.json", "tsconfig.base.json"):
        try:
            row = spark.read.text(f"{folder.rstrip('/')}/{name}", wholetext=True).first()
            options = json.loads(row["value"]).get("compilerOptions", {})
        except (AnalysisException, TypeError, ValueError, AttributeError):
            continue
        base = str(options.get("baseUrl", ".")).strip("./")
        join = lambda t, base=base: "/".join(x for x in (base, t.rstrip("/*").lstrip("./")) if x)
        for pattern, targets in (options.get("paths") or {}).items():
            if key := pattern.rstrip("/*"):
                found[key] = [join(t) for t in targets]
        if base not in found.setdefault("", []):
            found[""].append(base)
    return found


def faults(space: DataFrame, chunks: DataFrame, *, corpus_bytes: int, chunk: int) -> DataFrame:
    """check, bad: what is wrong with a packed catalogue, by kind; all zero if it may be used.

    space(file_id, offset, length), chunks(chunk_id, offset, valid_length). Files: ids that aren't whole from 0 on (or are
    null or repeat), negative places, ends beyond the corpus. Chunks: a size below one, ids or places that don't follow,
    ends beyond the corpus, a number that doesn't cover it. One pass over either table.
    """
    n = lambda condition: F.count_if(F.coalesce(condition, F.lit(True)))
    end = F.col("offset") + F.col("length")
    files = space.agg(
        F.greatest(F.count("*") - F.countDistinct("file_id"), F.coalesce(F.max("file_id"), F.lit(-1)) + 1 - F.count("*"), n(F.col("file_id") < 0)).alias("file ids"),
        n((F.col("offset") < 0) | (F.col("length") < 0)).alias("file records"), n(end > corpus_bytes).alias("files beyond the corpus"),
    )
    parts = chunks.agg(
        F.lit(int(chunk <= 0)).cast("long").alias("chunk size"), n((F.col("offset") != F.col("chunk_id") * chunk) | (F.col("chunk_id") < 0)).alias("chunk records"),
        n((F.col("valid_length") <= 0) | (F.col("offset") + F.col("valid_length") > corpus_bytes)).alias("chunks beyond the corpus"),
        F.greatest(F.abs(F.count("*") - -(-corpus_bytes // max(chunk, 1))), F.count("*") - F.countDistinct("chunk_id")).alias("chunk coverage"),
    )
    names = [*files.columns, *parts.columns]
    return files.join(F.broadcast(parts)).select(F.posexplode(F.array(*[F.struct(F.lit(c).alias("check"), F.col(f"`{c}`").cast("long").alias("bad")) for c in names])).alias("_n", "c")).select("c.*")  # one row each


def checked_catalogue(space: DataFrame, chunks: DataFrame, **sizes: int) -> DataFrame:
    """space, after an error if anything is wrong with the catalogue."""
    if wrong := [r["check"] for r in faults(space, chunks, **sizes).where("bad <> 0").collect()]:  # seven rows at most
        raise ValueError("invalid catalogue: " + ", ".join(wrong))
    return space

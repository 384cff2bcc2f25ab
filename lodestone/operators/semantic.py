"""Overlapping line chunks, and cosine search over their vectors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.stats import dot, normalized
from ..functions.text import redact
from ..tables import stored

CHUNK, OVERLAP, MAX_CHUNKS = 40, 8, 500_000
#: What ends a line of a chunk: CR LF, LF, CR, VT, FF, FS, GS, RS, NEL, LS, PS.
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def chunks(files: DataFrame, *, size: int = CHUNK, overlap: int = OVERLAP, text_col: str = "text") -> DataFrame:
    """file_id, path, start_line, end_line, text: windows of lines, blank ones left out. All within the file's row."""
    parts = F.split(F.coalesce(F.col(text_col), F.lit("")), LINE_END, -1)
    ended = F.element_at(parts, -1) == ""
    lines = F.when(ended, F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)
    step = size - overlap
    rows = files.select("file_id", "path", lines.alias("lines")).withColumn("n", F.size("lines")).where("n > 0")
    last = F.when(F.col("n") <= size, F.lit(0)).otherwise(F.ceil((F.col("n") - size) / step)).cast("int")
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), last)).alias("k"))
    start = F.col("k") * step
    rows = rows.select("file_id", "path", (start + 1).alias("start_line"), F.least(start + size, "n").alias("end_line"), F.array_join(F.slice("lines", start + 1, F.lit(size)), "\n").alias("text"))
    return rows.where(F.rlike("text", F.lit(r"(?U)[^\s\x1c-\x1f\x85]")))


def capped(chunked: DataFrame, limit: int = MAX_CHUNKS) -> DataFrame:
    """The first chunks in path, line and file order, with a flag if some were left out.

    Only the keys of the first ones meet in one task, without texts; the last key cuts all rows. Chunks of one key stay together.
    """
    key = F.struct("path", "start_line", "file_id")
    first = chunked.select(key.alias("k")).orderBy("k").limit(limit)
    last = first.agg(F.max("k").alias("_last")).join(chunked.agg((F.count("*") > limit).alias("chunks_capped")))  # one row each
    return chunked.join(F.broadcast(last)).where(key <= F.col("_last")).drop("_last")


def top_k(vectors: DataFrame, query: list[float], k: int = 10, *, id_col: str = "vec_id", vector_col: str = "embedding", digits: int = 4) -> DataFrame:
    """The k rows of the highest cosine, ties by id; score rounded. Each task keeps k rows, so k rows a task are merged."""
    q = F.array(*[F.lit(float(x)) for x in query])
    v = F.col(vector_col)
    score = dot(v, q) / (F.sqrt(dot(v, v)) * F.sqrt(dot(q, q)))
    rows = vectors.where(v.isNotNull() & (F.size(v) == len(query))).withColumn("_exact", score)
    return rows.orderBy(F.col("_exact").desc_nulls_last(), id_col).limit(k).withColumn("score", F.round("_exact", digits)).drop("_exact", vector_col)


#: Blocks of queries in one search at most, each a branch of its plan.
MAX_BLOCKS = 256


def batch_top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, *, id_col: str = "vec_id", vector_col: str = "embedding", block: int = 1000, digits: int = 4) -> DataFrame:
    """query_id, rank, id, score for a stated set of queries (query_id, q), in blocks: about `block` queries are sent to all vectors at once.

    A block is dealt out by hash, so its size is counted before it is broadcast and halved until it fits. Each task
    keeps k rows a query before they are shuffled. Ids of queries are distinct; too many in all are an error.
    """
    queries = stored(queries.select("query_id", normalized("q").alias("_q")), "queries")
    blocks = 1
    while True:
        dealt = queries.withColumn("_block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)))
        most = dealt.groupBy("_block").count().agg(F.max("count").alias("n")).first()["n"] or 0
        if most <= block:
            break
        if blocks >= MAX_BLOCKS:
            raise ValueError(f"more than {block} queries of one id, or about {MAX_BLOCKS * block} in all; search them in several calls")
        blocks *= 2
    unit = vectors.select(id_col, normalized(F.col(vector_col)).alias("_v"))
    order = Window.partitionBy("query_id").orderBy(F.col("_exact").desc(), id_col)
    found = []
    for i in range(blocks):
        pairs = unit.join(F.broadcast(dealt.where(F.col("_block") == i))).select("query_id", id_col, dot("_v", "_q").alias("_exact"))
        found.append(pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", id_col, F.round("_exact", digits).alias("score")))
    return reduce(DataFrame.unionByName, found)


def hashed_vectors(texts: DataFrame, *, dims: int = 64, text_col: str = "text") -> DataFrame:
    """A deterministic stand-in for a model: counts of hashed words, scaled to length one. texts' columns with `embedding`."""
    words = F.filter(F.split(F.lower(F.coalesce(F.col(text_col), F.lit(""))), r"[^\p{L}\p{N}_]+"), lambda w: w != "")
    places = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(dims)))
    counts = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda d: F.size(F.filter(places, lambda p: p == d)).cast("double"))
    return texts.withColumn("embedding", normalized(counts).cast("array<float>"))


def hits(found: DataFrame, *, compact: bool = False) -> DataFrame:
    """Chunk rows of a search as hits: snippet of 160 (compact) or 600 characters, redacted."""
    return found.withColumn("snippet", F.substring(redact("text"), 1, 160 if compact else 600)).withColumn("reason", F.lit("semantic match")).withColumn("engine", F.lit("semantic"))

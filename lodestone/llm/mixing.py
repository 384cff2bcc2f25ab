"""Mixing of sources to target weights by a low-discrepancy schedule, in DataFrame functions.

Every source is a stream of words: its documents in a shuffled order (by hash), cut into blocks of equal numbers of
words. Slots of the mix are the points of the golden-ratio sequence; a point falls into one source's share of the
cumulative targets, so every stretch of the mix holds the sources nearly by weight. The r-th slot of a source takes its
r-th block, a second pass beginning where the stream ends. A source's schedule ends at its target: its last block is cut.

Defined cases: a null text has size 0 and is never taken; a null source is a source of its own, last; repeated rows are
documents of their own; an empty table gives an empty mix; sources without words have target 0; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, stored

WEIGHTS = (3.0, 1.0, 2.0)  # by source in code-point order, repeating
BUDGET, REPEATS, BLOCK = 1.5, 2, 1024
#: Golden ratio's fraction of 2^32. slot * PHI mod 2^32 is exact in 64 bits and uniform over every 2^32 slots.
PHI, RING, CELLS = 2654435769, 2**32, 4096
RUN = 4096  # slots whose ranks are counted in one window


def targets(sized: DataFrame, *, weights=WEIGHTS, budget: float = BUDGET, repeats: int = REPEATS) -> DataFrame:
    """A row for each source: key, source_size, target. The windows run over one row a source.

    Water filling: sources reach their limits in the order of limit / weight; those before the first one that the rest
    of the budget doesn't fill are full, the others share what is left by weight. A row's level supposes that all
    before it are full, so the first open row has the true one, and later rows a lower one.
    """
    each = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    w = Window.orderBy(F.col("source").asc_nulls_last())
    each = each.withColumn("rank", F.row_number().over(w))
    each = each.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.col("rank") - 1) % len(weights) + 1).cast("int")))
    every = Window.partitionBy(F.lit(0))
    each = each.withColumn("limit", F.col("source_size") * F.lit(float(repeats))).withColumn("total", F.sum("source_size").over(every) * F.lit(budget))
    order = Window.orderBy(F.col("limit") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    used = F.coalesce(F.sum("limit").over(order), F.lit(0.0))
    open_ = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(order), F.lit(0.0))
    each = each.withColumn("level", (F.col("total") - used) / open_)
    each = each.withColumn("full", F.col("limit") <= F.col("level") * F.col("weight"))
    level = F.coalesce(F.max(F.when(~F.col("full"), F.col("level"))).over(every), F.lit(0.0))
    return each.select("source", "rank", "source_size", F.when(F.col("full"), F.col("limit")).otherwise(level * F.col("weight")).alias("target"))


def streams(docs: DataFrame, *, text_col: str = "text", bucket_rows: int = 100_000) -> DataFrame:
    """doc_id, source, size, uid and `start`, the words of the source's stream before the document.

    A running sum in two levels, so that no source meets in one task: sums by source and bucket (a range of the order
    key), then a window within each bucket. There are as many buckets as keep one near `bucket_rows` rows; the order is the key's.
    """
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    sized = stored(docs.select("doc_id", "source", size.alias("size"), key.alias("key"), F.monotonically_increasing_id().alias("uid")), "mix-sizes")
    buckets = max(256, -(-sized.count() // bucket_rows))
    sized = sized.withColumn("bucket", F.floor(F.conv(F.substring("key", 1, 7), 16, 10).cast("long") * buckets / 2**28).cast("long"))
    sums = sized.groupBy("source", "bucket").agg(F.sum("size").alias("n"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("source").alias("b_source"), F.col("bucket").alias("b_bucket"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size", "uid").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn("own", F.coalesce(F.sum("size").over(within), F.lit(0)))
    placed = placed.join(sums, placed["source"].eqNullSafe(sums["b_source"]) & (placed["bucket"] == sums["b_bucket"]))
    return placed.select("uid", "doc_id", "source", "size", (F.col("base") + F.col("own")).alias("start"))


def schedule(spark: SparkSession, goals: DataFrame, *, block: int = BLOCK, repeats: int = REPEATS) -> DataFrame:
    """The mix: slot, rank (of its source), pass, block, words (taken from the block's start).

    Slots that the sequence gives a source beyond its target are left out, those it lacks follow at the end.
    """
    goals = goals.withColumn("words", F.least(F.round("target").cast("long"), F.col("source_size") * repeats)).where("words > 0")
    per_pass = F.ceil(F.col("source_size") / F.lit(block)).cast("long")
    whole, rest = F.floor(F.col("words") / F.col("source_size")).cast("long"), F.col("words") % F.col("source_size")
    goals = goals.withColumn("per_pass", per_pass).withColumn("need", whole * per_pass + F.ceil(rest / F.lit(block)).cast("long"))
    shares = Window.orderBy("rank")
    every = Window.partitionBy(F.lit(0))
    upper = F.floor(F.sum("need").over(shares) / F.sum("need").over(every) * F.lit(RING)).cast("long")
    goals = goals.withColumn("hi", upper).withColumn("lo", F.coalesce(F.lag("hi").over(shares), F.lit(0)))
    goals = stored(goals, "mix-goals")
    slots = int(goals.agg(F.coalesce(F.sum("need"), F.lit(0)).alias("n")).first()["n"])
    width = RING // CELLS
    cells = goals.where("hi > lo").withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor((F.col("hi") - 1) / width))))
    cells = cells.select("cell", "rank", "lo", "hi")
    # slot = high * 2^16 + low keeps the product below 2^63
    high, low = F.floor(F.col("id") / 65536), F.col("id") % 65536
    point = (low * F.lit(PHI) + (high % 65536 * F.lit(PHI)) % 65536 * 65536) % F.lit(RING)
    points = spark.range(0, slots).select(F.col("id").alias("slot"), F.floor(F.col("id") / RUN).alias("run"), point.alias("point"))
    points = points.withColumn("cell", F.floor(F.col("point") / width))
    drawn = points.join(cells, "cell").where("point >= lo and point < hi").select("slot", "run", "rank")
    counts = drawn.groupBy("rank", "run").agg(F.count("*").alias("n"))
    before = Window.partitionBy("rank").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("rank", "run", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    drawn = drawn.withColumn("own", F.row_number().over(Window.partitionBy("rank", "run").orderBy("slot")) - 1)
    drawn = drawn.join(counts, ["rank", "run"]).select("slot", "rank", (F.col("base") + F.col("own")).alias("turn"))
    given = drawn.groupBy("rank").agg(F.count("*").alias("given"))
    late = goals.join(given, "rank", "left").withColumn("given", F.coalesce("given", F.lit(0))).where("given < need")
    late = late.select(F.lit(slots).alias("slot"), "rank", F.explode(F.sequence("given", F.col("need") - 1)).alias("turn"))
    all_ = drawn.unionByName(late).join(goals.select("rank", "words", "need", "per_pass", "source_size"), "rank").where("turn < need")
    pass_, at = F.floor(F.col("turn") / F.col("per_pass")).cast("long"), F.col("turn") % F.col("per_pass")
    all_ = all_.withColumn("pass", pass_).withColumn("block", at)
    left = F.col("words") - F.col("pass") * F.col("source_size") - F.col("block") * block
    return all_.select("slot", "rank", "turn", "pass", "block", F.least(left, F.lit(block), F.col("source_size") - F.col("block") * block).alias("words"))


def mix(docs: DataFrame, *, block: int = BLOCK, weights=WEIGHTS, budget: float = BUDGET, repeats: int = REPEATS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, segments, goals): every document with its place in its source's stream; every piece of a document that a slot takes
    (slot, pass, block, uid, at: its first word in the document, words); every source with its target."""
    placed = stored(streams(docs), "mix-streams")
    goals = stored(targets(placed, weights=weights, budget=budget, repeats=repeats), "mix-targets")
    ranks = goals.select(F.col("source").alias("g_source"), "rank", "source_size", "target")
    placed = placed.join(F.broadcast(ranks) if goals.count() <= 10_000 else ranks, F.col("source").eqNullSafe(F.col("g_source"))).drop("g_source")
    blocks = placed.where("size > 0").select("uid", "rank", "start", "size", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block))).alias("block"))
    taken = blocks.join(schedule(docs.sparkSession, goals, block=block, repeats=repeats), ["rank", "block"])
    first = F.greatest(F.col("start"), F.col("block") * block)
    last = F.least(F.col("start") + F.col("size"), F.col("block") * block + F.col("words"))
    taken = taken.select("slot", "pass", "block", "uid", (first - F.col("start")).alias("at"), (last - first).alias("words")).where("words > 0")
    return placed, taken, goals


def report(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken for every document."""
    placed, taken, _ = mix(docs)
    sums = taken.groupBy("uid").agg(F.sum("words").alias("taken"))
    return placed.join(sums, "uid", "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


#: The same rows: a mix takes a stream's first words, up to the target, going round at its end.
SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS key FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM sized GROUP BY source),
weighed AS (
  SELECT *, [3.0::DOUBLE, 1.0, 2.0][1 + (rank - 1) % 3] AS weight, source_size * 2.0::DOUBLE AS lim, sum(source_size) OVER () * 1.5::DOUBLE AS total FROM sources),
levels AS (
  SELECT *, (total - coalesce(sum(lim) OVER (ORDER BY lim / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
            / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY lim / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)) AS level FROM weighed),
goals AS (
  SELECT source, source_size, CASE WHEN lim <= level * weight THEN lim ELSE coalesce(max(level) FILTER (lim > level * weight) OVER (), 0.0) * weight END AS target FROM levels),
placed AS (
  SELECT s.doc_id, s.size, g.source_size, g.target, least(CAST(round(g.target) AS BIGINT), 2 * g.source_size) AS words,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a
  FROM sized s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(greatest(0, least(a + size, words) - least(a, words)) + greatest(0, least(a + size, words - source_size) - least(a, greatest(words - source_size, 0))) AS BIGINT) AS taken
FROM placed
"""

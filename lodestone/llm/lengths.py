"""Token counts through the exact length histogram.

Documents are aggregated by encoded length; suffix sums over the histogram answer, for every context limit, how many
documents are cut, how many tokens remain and which quantile the limit is. The histogram has a row for each distinct
length, so it is bounded by the longest document and not by the corpus.

Defined cases: a null or empty text has length 0; repeated rows count each; an empty table gives an empty histogram;
further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stored
from .tokens import encoder


def histogram(docs: DataFrame, tokenizer: str, *, text_col: str = "text") -> DataFrame:
    """length, docs. Each task sends one row for each length that it meets; the result is stored, as texts are encoded once only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, int] = {}
        count = encoder(tokenizer).count
        for batch in batches:
            for text in batch.column(0):
                n = count(text.as_py())
                counts[n] = counts.get(n, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int64()), pa.array(list(counts.values()), pa.int64())], ["length", "docs"])

    partial = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "length long, docs long")
    return stored(partial.groupBy("length").agg(F.sum("docs").alias("docs")), "length-histogram")


def limits(counts: DataFrame, *, stride: int = 4096) -> DataFrame:
    """The histogram with suffix sums: each row is also the answer for its length as context limit.

    A limit between two lengths differs only in kept_tokens, by docs_over for each token. The sums run in two levels,
    within runs of `stride` lengths and over the runs, so that no task sorts a whole long histogram.
    """
    run = counts.withColumn("run", F.floor(F.col("length") / stride)).withColumn("tokens", F.col("length") * F.col("docs"))
    sums = run.groupBy("run").agg(F.sum("docs").alias("d"), F.sum("tokens").alias("t"))
    up = Window.orderBy(F.col("run").desc()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(0))
    sums = sums.select(
        F.col("run").alias("of"), *[F.coalesce(F.sum(c).over(up), F.lit(0)).alias(f"{c}_above") for c in "dt"], *[F.sum(c).over(every).alias(f"{c}_all") for c in "dt"]
    )
    down = Window.partitionBy("run").orderBy(F.col("length").desc()).rowsBetween(Window.unboundedPreceding, 0)
    within = run.select("*", F.sum("docs").over(down).alias("d_in"), F.sum("tokens").over(down).alias("t_in"))
    found = within.join(sums, within["run"] == sums["of"])
    at_least, tokens_at_least = F.col("d_above") + F.col("d_in"), F.col("t_above") + F.col("t_in")
    over = at_least - F.col("docs")
    return found.select(
        "length", "docs",
        at_least.alias("docs_at_least"), tokens_at_least.alias("tokens_at_least"),
        over.alias("docs_over"), F.col("d_all").alias("total_docs"), F.col("t_all").alias("total_tokens"),
        (F.col("t_all") - tokens_at_least + F.col("tokens") + over * F.col("length")).alias("kept_tokens"),
        ((F.col("d_all") - over) / F.col("d_all")).alias("quantile"),
    )


def at(answers: DataFrame, limit: int) -> dict:
    """docs_over, kept_tokens and lost_tokens for any context limit, from limits()' rows."""
    total = answers.agg(F.coalesce(F.max("total_tokens"), F.lit(0)).alias("t")).first()["t"]
    row = answers.where(F.col("length") > limit).agg(F.coalesce(F.sum("docs"), F.lit(0)).alias("d"), F.coalesce(F.sum(F.col("docs") * (F.col("length") - limit)), F.lit(0)).alias("lost")).first()
    return {"docs_over": row["d"], "kept_tokens": total - row["lost"], "lost_tokens": row["lost"]}


def quantile(answers: DataFrame, q: float) -> int | None:
    """The smallest length that at least a share q of the documents doesn't exceed."""
    return answers.where(F.col("quantile") >= q).agg(F.min("length").alias("n")).first()["n"]

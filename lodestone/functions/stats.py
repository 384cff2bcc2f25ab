"""Statistics with the three percentile rules that reports use, and vector products."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..tables import stored
from .text import col


#: Places, from 0, of a share of n sorted values: by nearest rank (halves to even), by cutting, and by rank ceil(n * share).
PLACES: dict[str, Callable[[Column, float], Column]] = {
    "nearest": lambda n, share: F.rint((n - 1) * F.lit(share)).cast("long"),
    "cut": lambda n, share: F.least(F.floor(n * F.lit(share)), n - 1),
    "rank": lambda n, share: F.greatest(F.ceil(n * F.lit(share)) - 1, F.lit(0)),
}


def quantiles(rows: DataFrame, by: list[str], value: str, wanted: dict[str, tuple[str, float]]) -> DataFrame:
    """by and, for each name in wanted, the group's value at that place (rule, share); rule "median" is the mean of the middle two.

    Exact, and no task holds a group: equal values are counted first, the counts are dealt out by ranges of group and
    value (stored, so that bounds are drawn once), ranges are summed, and running sums are made within a range only.
    Nulls don't count; groups of nulls alone have nulls; null groups are groups.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_value")).agg(F.count("*").alias("_n"))
    ranged = stored(counts.repartitionByRange(*by, "_value").withColumn("_part", F.spark_partition_id()), "value-ranges")
    group = Window.partitionBy(*by)
    sums = ranged.groupBy(*by, "_part").agg(F.sum("_n").alias("_sum"))
    sums = sums.select(*[F.col(c).alias(f"_g_{c}") for c in by], F.col("_part").alias("_g_part"), (F.sum("_sum").over(group.orderBy("_part")) - F.col("_sum")).alias("_before"), F.sum("_sum").over(group).alias("_total"))
    within = Window.partitionBy(*by, "_part").orderBy("_value").rowsBetween(Window.unboundedPreceding, 0)
    same = reduce(lambda a, b: a & b, [ranged[c].eqNullSafe(sums[f"_g_{c}"]) for c in by], ranged["_part"] == sums["_g_part"])
    placed = ranged.withColumn("_own", F.sum("_n").over(within)).join(sums, same).withColumn("_end", F.col("_before") + F.col("_own"))
    found = {}
    for name, (rule, share) in wanted.items():
        n = F.col("_total")
        places = [F.floor((n - 1) / 2), F.floor(n / 2)] if rule == "median" else [PLACES[rule](n, share)]
        at = [F.max(F.when((p < F.col("_end")) & (p >= F.col("_end") - F.col("_n")), F.col("_value"))) for p in places]
        found[name] = (at[0] + at[1]) / 2 if rule == "median" else at[0]
    got = placed.groupBy(*by).agg(*[v.alias(k) for k, v in found.items()])
    none = rows.groupBy(*by).agg(F.count(value).alias("_n")).where("_n = 0").drop("_n")
    return got.unionByName(none, allowMissingColumns=True)


def with_quantiles(rows: DataFrame, by: list[str], value: str, wanted: dict[str, tuple[str, float]], *sums: Column) -> DataFrame:
    """Quantiles and plain aggregates by group; null groups are groups."""
    found, plain = quantiles(rows, by, value, wanted), rows.groupBy(*[F.col(c).alias(f"_p_{c}") for c in by]).agg(*sums)
    same = F.lit(True)
    for c in by:
        same = same & found[c].eqNullSafe(plain[f"_p_{c}"])
    return found.join(plain, same).drop(*[f"_p_{c}" for c in by])


def dot(a: str | Column, b: str | Column) -> Column:
    """In double precision, in the order of dimensions."""
    pairs = F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def normalized(v: str | Column) -> Column:
    v = col(v)
    length = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: x / F.when(length > 0, length).otherwise(F.lit(1.0)))

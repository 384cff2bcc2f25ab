"""What the operators of this package share: stored tables, skewed joins, empty results."""

from __future__ import annotations

import ctypes
import sys

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, StringType, StructField

from ..tables import shared_dir, stored  # noqa: F401

#: Separators of words in every operator: space and the bytes 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


#: Bytes of a side that may be broadcast, counted before it is.
BROADCAST = 64 << 20


def _bytes(field: StructField) -> Column:
    """Bytes that a value takes at most in a row in memory."""
    if isinstance(field.dataType, ArrayType):
        return F.coalesce(F.size(field.name), F.lit(0)) * 8 + 32
    if isinstance(field.dataType, (StringType, BinaryType)):
        return F.coalesce(F.octet_length(field.name), F.lit(0)) + 16
    return F.lit(32)


def if_small(df: DataFrame, most: int = BROADCAST) -> DataFrame:
    """df, stored, and to be broadcast if its rows take at most `most` bytes; beyond, joins with it shuffle. Columns: numbers, texts and arrays of numbers."""
    df = stored(df, "side")
    size = sum((_bytes(f) for f in df.schema), F.lit(16)).cast("long")
    return F.broadcast(df) if (df.agg(F.sum(size).alias("n")).first()["n"] or 0) <= most else df


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, with as many underscores before them as keeps them apart from df's columns."""
    taken, line = {c.lower() for c in df.columns}, ""
    while any((line + n).lower() in taken for n in names):
        line += "_"
    return [line + n for n in names]


def columns_of(df: DataFrame) -> list[Column]:
    """df's columns, whatever their names."""
    return [df["`" + c.replace("`", "``") + "`"] for c in df.columns]


def release() -> None:
    """Gives back what Arrow and the C library hold for later: a worker lives on after its task."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not every C library has it
        if trim:
            trim(0)


def hot_join(rows: DataFrame, classes: DataFrame, keys: list[str], count: str, spread: Column, share: int = 1000) -> DataFrame:
    """rows left-joined to classes (one row a key), however many rows one key holds.

    classes[count] says how many rows a key has. Keys with more than 1/share of all rows are at most `share` in number,
    so those classes are broadcast (a proven bound); their rows get a scattered key in the shuffled join of the rest.
    keys must not be null in classes; rows with null keys find nothing.
    """
    values = [c for c in classes.columns if c not in keys]
    total = classes.agg(F.coalesce(F.sum(count), F.lit(0)).alias("n")).first()["n"]
    least = max(int(total) // share, 1000)
    heavy = classes.where(F.col(count) > least).select(*[F.col(k).alias(f"_h_{k}") for k in keys], F.struct(*values).alias("_heavy"))
    light = classes.where(F.col(count) <= least).select(F.lit(0).cast("long").alias("_l_scatter"), *[F.col(k).alias(f"_l_{k}") for k in keys], F.struct(*values).alias("_light"))
    both = rows.join(F.broadcast(heavy), [rows[k] == heavy[f"_h_{k}"] for k in keys], "left").drop(*[f"_h_{k}" for k in keys])
    lone = F.col("_heavy").isNotNull() | F.greatest(*[F.col(k).isNull().cast("int") for k in keys], F.lit(0)).cast("boolean")
    both = both.withColumn("_scatter", F.when(lone, F.lit(1) + F.abs(F.xxhash64(spread) % 1_000_000)).otherwise(F.lit(0)).cast("long"))
    both = both.join(light, [both["_scatter"] == light["_l_scatter"], *[both[k] == light[f"_l_{k}"] for k in keys]], "left")
    return both.select(*[both[c] for c in rows.columns], *[F.coalesce(F.col(f"_heavy.{v}"), F.col(f"_light.{v}")).alias(v) for v in values])

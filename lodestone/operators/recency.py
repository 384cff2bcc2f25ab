"""Recency of files as a boost of their ranks."""

from __future__ import annotations

import subprocess

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Boosts for uncommitted changes, for the last 20 commits, for the last hour, and their limit.
MODIFIED, RECENT, TOUCHED, CAP, COMMITS, WINDOW_S = 0.30, 0.15, 0.10, 0.40, 20, 3600


def boost(modified: Column, recent: Column, age_s: Column) -> Column:
    """Uncommitted changes outrank recent commits, a touch within the hour adds to either. Nulls count as no."""
    base = F.when(F.coalesce(modified, F.lit(False)), MODIFIED).when(F.coalesce(recent, F.lit(False)), RECENT).otherwise(0.0)
    return F.least(F.lit(CAP), base + F.when(F.coalesce(age_s <= WINDOW_S, F.lit(False)), TOUCHED).otherwise(0.0))


def boosted(hits: DataFrame, state: DataFrame, as_of: Column, *, path: str = "path") -> DataFrame:
    """hits with git_boost, from state(path, modified, recent, mtime) as of a given time."""
    age = F.unix_timestamp(as_of) - F.unix_timestamp("mtime")
    known = state.select(F.col("path").alias("_path"), boost(F.col("modified"), F.col("recent"), age).alias("git_boost"))
    return hits.join(known, hits[path] == known["_path"], "left").drop("_path").withColumn("git_boost", F.coalesce("git_boost", F.lit(0.0)))


def reranked(hits: DataFrame) -> DataFrame:
    """After the boost: by boost, equal ones in their former order (ord)."""
    return hits.orderBy(F.col("git_boost").desc(), "ord")


def changed_paths(root: str, *arguments: str, timeout: float = 8) -> list[str]:
    """Names that git lists; none if git fails or takes too long. Driver-side: a repository is a local thing."""
    try:
        done = subprocess.run(["git", "diff", "--name-only", *arguments], cwd=root, capture_output=True, text=True, timeout=timeout)
    except (OSError, subprocess.TimeoutExpired):
        return []
    return [x for x in done.stdout.splitlines() if x] if done.returncode == 0 else []


def state_of(spark: SparkSession, root: str) -> DataFrame:
    """path, modified, recent of a working copy."""
    modified, recent = set(changed_paths(root, "HEAD")), set(changed_paths(root, f"HEAD~{COMMITS}", "HEAD"))
    rows = [(p, p in modified, p in recent) for p in sorted(modified | recent)]
    return spark.createDataFrame(rows, "path string, modified boolean, recent boolean").withColumn("mtime", F.lit(None).cast("timestamp"))

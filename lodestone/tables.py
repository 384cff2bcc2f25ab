"""Tables in the folder that all executors share: intermediate results and versioned stores."""

from __future__ import annotations

import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset and driver and executors are one process (as in tests) a folder of our own, which becomes the setting's value."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith(("local[", "local*")) and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="lodestone-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Seconds between collections of the driver's garbage at least, and when the last one was.
COLLECT_S, _collected = 5.0, 0.0


def _collect(spark: SparkSession) -> None:
    """Spark removes the shuffle files and broadcasts of finished steps when the driver's JVM finds that nothing refers to
    them. That JVM has memory to spare and seldom looks, so jobs of many stored steps ask for it."""
    global _collected
    if time.monotonic() - _collected > COLLECT_S:
        spark._jvm.System.gc()
        _collected = time.monotonic()


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written once as Parquet to the shared folder and read back.

    Cuts lineage as checkpoint() does, but columnar and compressed, and a lost executor costs nothing of it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lodestone-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _collect(spark)
    return spark.read.schema(df.schema).parquet(path)

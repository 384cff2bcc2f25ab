"""Content-addressed, versioned tables: a new version becomes current by one small file."""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def file_rows(files: DataFrame, *, content: str = "content") -> DataFrame:
    """path, size, digest; empty files don't count."""
    return files.where(F.octet_length(content) > 0).select("path", F.octet_length(content).cast("long").alias("size"), F.sha2(F.col(content).cast("binary"), 256).alias("digest"))


def fingerprint(files: DataFrame, settings: dict | None = None, *, content: str = "content") -> DataFrame:
    """One row: fingerprint, a SHA-256 that changes with any path, size or content, and with the settings, but not with times.

    Files are hashed where they are; their rows are digested by ranges of paths, and only the ranges' digests are joined.
    """
    rows = file_rows(files, content=content).withColumn("row", F.concat_ws(":", "path", "size", "digest"))
    # A prefix of the path's hash parts the rows alike at every size and on every cluster.
    parts = rows.groupBy(F.substring(F.sha2("path", 256), 1, 3).alias("part")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("row")), "\n"), 256).alias("d"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "d"))), lambda x: F.concat(x["part"], x["d"])), "\n")
    return parts.agg(F.sha2(F.concat(F.lit(json.dumps(settings or {}, sort_keys=True, separators=(",", ":")) + "\n"), whole), 256).alias("fingerprint"))


def address(name: str, fingerprint_: str, version: int) -> str:
    """Where a table of a given content lies."""
    return f"{name}-v{version}-{hashlib.sha256(f'{name}:{version}:{fingerprint_}'.encode()).hexdigest()[:16]}"


class Store:
    """Tables below one root that Spark reaches by any of its file systems."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _pointers(self, name: str) -> list[tuple[int, str]]:
        """(number, path) of a table's pointers, the latest first."""
        pattern, system = self._path(f"{name}.current-*")
        found = [str(x.getPath()) for x in system.globStatus(pattern) or []]
        return sorted(((int(x.rpartition("-")[2]), x) for x in found if x.rpartition("-")[2].isdigit()), reverse=True)

    def current(self, name: str) -> dict | None:
        """What the latest valid pointer of a table says, None without one."""
        for _, path in self._pointers(name):
            try:
                found = json.loads(self.spark.read.text(path).first()["value"])
            except (TypeError, ValueError):
                continue
            return found if found["path"] else None
        return None

    def _point(self, name: str, says: dict) -> None:
        """A pointer of the next number: a draft is renamed, so that it is there whole or not at all, and no other is touched before."""
        old = self._pointers(name)
        draft, system = self._path(f"{name}.draft-{uuid.uuid4().hex}")
        out = system.create(draft, False)
        out.write(bytearray(json.dumps(says, sort_keys=True).encode()))
        out.close()
        if not system.rename(draft, self._path(f"{name}.current-{(old[0][0] if old else 0) + 1:09d}")[0]):
            raise RuntimeError(f"{name}: another writer was first")
        for _, path in old[1:]:  # the one before stays for its readers
            system.delete(self._path(path.rpartition("/")[2])[0], False)

    def write(self, name: str, table: DataFrame, fingerprint_: str, *, version: int = 1, partition_by: list[str] | None = None) -> str:
        """Writes a version beside the others, then turns the pointer. A failed write leaves the old version current."""
        place = f"{self.root}/{address(name, fingerprint_, version)}"
        writer = table.write.mode("overwrite")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(place)
        self._point(name, {"path": place, "fingerprint": fingerprint_, "version": version})
        return place

    def read(self, name: str, *, fingerprint_: str | None = None, version: int = 1) -> DataFrame | None:
        """The current table, None if there is none of that content and version."""
        found = self.current(name)
        if not found or found["version"] != version or (fingerprint_ is not None and found["fingerprint"] != fingerprint_):
            return None
        return self.spark.read.parquet(found["path"])

    def invalidate(self, name: str) -> None:
        self._point(name, {"path": None, "fingerprint": None, "version": None})


def append_replace(table: DataFrame, new: DataFrame, root: str, *, path: str = "path") -> DataFrame:
    """table without what lies below root, with new: the separator counts, so /r doesn't take /r2 along."""
    root = root.rstrip("/")
    return table.where(~((F.col(path) == root) | F.startswith(F.col(path), F.lit(root + "/")))).unionByName(new)


def merge(tables: list[DataFrame]) -> DataFrame:
    """Tables of several roots as one."""
    found = tables[0]
    for t in tables[1:]:
        found = found.unionByName(t)
    return found

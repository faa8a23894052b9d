"""Results as versioned folders with a pointer that is written last: a reader sees the old or the new version whole, also on
object stores, where a folder cannot be renamed in one step."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession

POINTER = "_current"


class Folder:
    """A result's folder on any file system that Spark can reach."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._path(f"{self.path}/{name}")

    def pointer(self) -> dict[str, Any] | None:
        """What the pointer names, None before the first version."""
        at = self._at(POINTER)
        if not self._files.exists(at):
            return None
        stream = self._files.open(at)
        try:
            size = self._files.getFileStatus(at).getLen()
            return json.loads(bytes(stream.readNBytes(int(size))).decode())
        finally:
            stream.close()

    def point(self, content: dict[str, Any]) -> None:
        """Move the pointer: one small object, replaced in one write."""
        stream = self._files.create(self._at(POINTER), True)
        stream.write(bytearray(json.dumps(content).encode()))
        stream.close()

    def drop(self, name: str) -> None:
        self._files.delete(self._at(name), True)


def publish(df: DataFrame, path: str, columns: Sequence[str] | None = None, keep: int = 1) -> None:
    """Write a new version and then point at it. A write that fails leaves the pointer, and so the result, as it was. The
    last `keep` versions before it stay, for readers that have already begun."""
    folder = Folder(df.sparkSession, path)
    before = folder.pointer() or {"version": None, "older": []}
    name = f"v-{uuid.uuid4().hex}"
    try:
        (df.select(*columns) if columns else df).write.parquet(f"{folder.path}/{name}")
    except Exception:
        folder.drop(name)
        raise
    older = ([before["version"]] if before["version"] else []) + before["older"]
    folder.point({"version": name, "older": older[:keep]})
    for old in older[keep:]:
        folder.drop(old)


def read_published(spark: SparkSession, path: str) -> DataFrame:
    """The version the pointer names."""
    at = Folder(spark, path).pointer()
    if at is None:
        raise FileNotFoundError(f"nothing is published at {path}")
    return spark.read.parquet(f"{path.rstrip('/')}/{at['version']}")

"""Exports that appear as a whole.

An export is several jobs (records, metadata, statistics).  They write to a folder beside the
target, whose name Spark's readers skip, and one rename makes the export visible.  What fails or is killed
before leaves the target as it was.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession


class Folders:
    """Files below a path of any file system that Spark knows."""

    def __init__(self, spark: SparkSession, path: str):
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self.root = self._path(path)
        self._system = self.root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def exists(self, path: str) -> bool:
        return self._system.exists(self._path(path))

    def delete(self, path: str) -> None:
        self._system.delete(self._path(path), True)

    def move(self, source: str, target: str) -> None:
        parent = self._path(target).getParent()
        if parent is not None:
            self._system.mkdirs(parent)
        if not self._system.rename(self._path(source), self._path(target)):
            raise OSError(f"could not rename {source} to {target}")

    def files(self, path: str) -> list[tuple[str, int]]:
        """Data files directly below a folder with their sizes, by name."""
        found = [(f.getPath().toString(), f.getLen()) for f in self._system.listStatus(self._path(path)) if f.isFile()]
        return sorted((p, n) for p, n in found if not p.rpartition("/")[2].startswith(("_", ".")))


@contextmanager
def one_commit(spark: SparkSession, path: str) -> Iterator[str]:
    """The folder to write to; it becomes `path`, in place of what was there, when the block ends well."""
    folder, _, name = path.rstrip("/").rpartition("/")
    staging = f"{folder}/_{name}-{uuid.uuid4().hex}" if folder or path.startswith("/") else f"_{name}-{uuid.uuid4().hex}"
    folders = Folders(spark, path)
    try:
        yield staging
        if folders.exists(path):
            folders.delete(path)
        folders.move(staging, path)
    finally:
        if folders.exists(staging):
            folders.delete(staging)

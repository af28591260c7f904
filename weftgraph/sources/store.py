"""Snapshots of the tables. A manifest names, for each table of a version, the folder that holds it."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import TABLES

MANIFEST = "_VERSION."


class Store:
    """Works on any file system that Spark's Hadoop client reaches. A commit writes the tables that it is given and takes
    the others' folders over from the version before. Its manifest appears under its own name by a rename, so a reader
    sees the version before or the whole new one, and the newest manifest is the current version. Folders that the two
    newest manifests don't name are deleted."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def _names(self) -> list[str]:
        root = self._path("")
        return [f.getPath().getName() for f in self._fs.listStatus(root)] if self._fs.exists(root) else []

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(name))

    def versions(self) -> list[int]:
        return sorted(int(n.removeprefix(MANIFEST)) for n in self._names() if n.startswith(MANIFEST) and n.removeprefix(MANIFEST).isdigit())

    def version(self) -> int:
        """0 before the first commit."""
        return max(self.versions(), default=0)

    def manifest(self, version: int) -> dict[str, str]:
        if version == 0:
            return {}
        stream = self._fs.open(self._path(f"{MANIFEST}{version}"))
        try:
            return json.loads(stream.readLine())
        finally:
            stream.close()

    def read(self, table: str, version: int | None = None) -> DataFrame:
        folder = self.manifest(self.version() if version is None else version).get(table)
        if folder is None:
            return self.spark.createDataFrame([], TABLES[table])
        return self.spark.read.schema(TABLES[table]).parquet(f"{self.root}/{folder}")

    def metadata(self, key: str) -> str | None:
        found = self.read("metadata").where(F.col("key") == key).first()
        return found["value"] if found else None

    def set_metadata(self, key: str, value: str) -> int:
        kept = self.read("metadata").where(F.col("key") != key)
        return self.commit({"metadata": kept.unionByName(self.spark.createDataFrame([(key, value)], TABLES["metadata"]))})

    def commit(self, tables: dict[str, DataFrame]) -> int:
        """Writes the given tables as the next version; others are carried over without being read."""
        new = self.version() + 1
        manifest = self.manifest(new - 1)
        for name, df in tables.items():
            manifest[name] = f"{name}/{new}-{uuid.uuid4().hex[:8]}"
            df.select(*TABLES[name].fieldNames()).write.parquet(f"{self.root}/{manifest[name]}")
        draft = self._path(f"_draft-{uuid.uuid4().hex}")
        out = self._fs.create(draft, True)
        out.writeBytes(json.dumps(manifest) + "\n")
        out.close()
        if not self._fs.rename(draft, self._path(f"{MANIFEST}{new}")):
            raise RuntimeError(f"version {new} was written by another process")
        self._clean(new)
        return new

    def _clean(self, newest: int) -> None:
        kept = {f for v in self.versions() if v >= newest - 1 for f in self.manifest(v).values()}
        for v in self.versions():
            if v < newest - 1:
                for name, folder in self.manifest(v).items():
                    if name in TABLES and folder not in kept:
                        self._fs.delete(self._path(folder), True)
                        self._fs.delete(self._path(f"fulltext/{folder.replace('/', '-')}"), True)
                self._fs.delete(self._path(f"{MANIFEST}{v}"), False)


class MemoryStore:
    """The same calls over tables that are kept as DataFrames, for tests and for sessions that leave nothing behind.
    Tables are cached, at two replicas, so that they need not be computed from sources that have changed since."""

    def __init__(self, spark: SparkSession, root: str = ""):
        self.spark, self.root = spark, root
        self._versions: list[dict[str, DataFrame]] = [{}]

    def version(self) -> int:
        return len(self._versions) - 1

    def read(self, table: str, version: int | None = None) -> DataFrame:
        held = self._versions[-1 if version is None else version]
        return held[table] if table in held else self.spark.createDataFrame([], TABLES[table])

    metadata = Store.metadata
    set_metadata = Store.set_metadata

    def commit(self, tables: dict[str, DataFrame]) -> int:
        from pyspark import StorageLevel

        new = dict(self._versions[-1])
        for name, df in tables.items():
            new[name] = df.select(*TABLES[name].fieldNames()).persist(StorageLevel.MEMORY_AND_DISK_2)
            new[name].count()
        self._versions.append(new)
        return self.version()

"""Named tables below a warehouse folder, in namespaces, replaced by write-then-swap."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tidemark.operators.bars import latest


class Warehouse:
    """Tables as ``root/namespace/name/version``, a pointer file naming the current version.

    A new version is written whole before the pointer moves, and the pointer is replaced by
    renaming a finished file over it, so a table can be rebuilt from itself and a failure at
    any moment leaves one whole version in place. Old versions stay for DataFrames that still
    read them until ``vacuum`` is called. Works on any file system that Spark can write.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _current(self, name: str, namespace: str) -> str | None:
        fs, p = self._fs(f"{self.root}/{namespace}/{name}/CURRENT")
        if not fs.exists(p):
            return None
        with_text = fs.open(p)
        try:
            return bytes(with_text.readAllBytes()).decode().strip()
        finally:
            with_text.close()

    def exists(self, name: str, namespace: str = "main") -> bool:
        return self._current(name, namespace) is not None

    def read(self, name: str, namespace: str = "main") -> DataFrame:
        version = self._current(name, namespace)
        if version is None:
            raise KeyError(f"{namespace}.{name}")
        return self.spark.read.parquet(f"{self.root}/{namespace}/{name}/{version}")

    def _point(self, base: str, version: str) -> None:
        fs, fresh = self._fs(f"{base}/CURRENT-{uuid.uuid4().hex}")
        out = fs.create(fresh, False)
        out.write(bytearray(version.encode()))
        out.close()
        sc = self.spark.sparkContext
        kind = sc._jvm.org.apache.hadoop.fs.Options.Rename
        how = sc._gateway.new_array(kind, 1)
        how[0] = kind.OVERWRITE
        sc._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), sc._jsc.hadoopConfiguration()).rename(fs.makeQualified(fresh), fs.makeQualified(self._fs(f"{base}/CURRENT")[1]), how)

    def save(self, df: DataFrame, name: str, namespace: str = "main", view: bool = False) -> DataFrame:
        """Replace the table; with ``view`` it can be named in SQL as well."""
        version, base = f"v-{uuid.uuid4().hex}", f"{self.root}/{namespace}/{name}"
        df.write.parquet(f"{base}/{version}")
        self._point(base, version)
        result = self.read(name, namespace)
        if view:
            result.createOrReplaceTempView(name)
        return result

    def append(self, df: DataFrame, name: str, namespace: str = "main") -> None:
        """Add rows to the current version, which is made by the first call."""
        version = self._current(name, namespace)
        if version is None:
            self.save(df, name, namespace)
        else:
            df.write.mode("append").parquet(f"{self.root}/{namespace}/{name}/{version}")

    def vacuum(self, name: str, namespace: str = "main") -> int:
        """Delete all versions but the current one; nothing may still read them. Gives their number."""
        base, current = f"{self.root}/{namespace}/{name}", self._current(name, namespace)
        fs, p = self._fs(base)
        old = [x.getPath() for x in fs.listStatus(p) if x.getPath().getName() not in (current, "CURRENT")] if current else []
        for x in old:
            fs.delete(x, True)
        return len(old)

    def drop(self, name: str, namespace: str = "main") -> None:
        fs, p = self._fs(f"{self.root}/{namespace}/{name}")
        fs.delete(p, True)


def backup(warehouse: Warehouse, names: list[str], namespace: str, path: str) -> None:
    for n in names:
        if warehouse.exists(n, namespace):
            warehouse.read(n, namespace).write.mode("overwrite").parquet(f"{path}/{n}")


def restore(warehouse: Warehouse, name: str, namespace: str, path: str, keys: list[str], newest: list[str]) -> DataFrame:
    """Table from a backup, the newest row of each key."""
    return warehouse.save(latest(warehouse.spark.read.parquet(f"{path}/{name}"), keys, newest), name, namespace)

"""A folder of named cubes and stacks as Parquet tables.

A cube is one table; a stack is partitioned by its pair or date, so one slice is one folder that a filter prunes to.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Store:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def path(self, name: str, subswath: int | None = None) -> str:
        return f"{self.folder}/{name}" if subswath is None else f"{self.folder}/F{subswath}_{name}"

    def exists(self, name: str) -> bool:
        fs, p = self._fs(self.path(name))
        return fs.exists(p)

    def names(self, pattern: str = "*") -> list[str]:
        fs, p = self._fs(f"{self.folder}/{pattern}")
        return sorted(s.getPath().getName() for s in fs.globStatus(p) or [])

    # cubes

    def open_cube(self, name: str) -> DataFrame:
        if not self.exists(name):
            raise FileNotFoundError(self.path(name))
        return self.spark.read.parquet(self.path(name))

    def save_cube(self, data: DataFrame, name: str, compression: str = "zstd") -> None:
        data.write.mode("overwrite").option("compression", compression).parquet(self.path(name))

    def sync_cube(self, data: DataFrame, name: str) -> DataFrame:
        """Save, then open: what follows starts from the files."""
        self.save_cube(data, name)
        return self.open_cube(name)

    def delete_cube(self, name: str) -> None:
        fs, p = self._fs(self.path(name))
        fs.delete(p, True)

    # stacks

    def open_stack(self, name: str, keys: list[str] | None = None, key: str = "pair") -> DataFrame:
        out = self.open_cube(name)
        return out if keys is None else out.filter(F.col(key).isin(*keys))

    def save_stack(self, data: DataFrame, name: str, key: str = "pair", compression: str = "zstd", axis: str = "y") -> None:
        """One folder for each slice; only the slices that ``data`` holds are replaced.

        Tasks take ranges of (key, axis), so a slice of any size is several tasks' and several files', and a small one a few.
        """
        order = [key, axis] if axis in data.columns else [key]
        data.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", compression).partitionBy(key).parquet(self.path(name))

    def sync_stack(self, data: DataFrame, name: str, key: str = "pair") -> DataFrame:
        self.save_stack(data, name, key)
        return self.open_stack(name)

    def missing_slices(self, wanted: DataFrame, name: str, key: str = "pair") -> DataFrame:
        """Keys of ``wanted`` that the stack doesn't hold yet, to go on where a run ended."""
        return wanted if not self.exists(name) else wanted.join(self.open_cube(name).select(key).distinct(), key, "left_anti")

    def delete_stack(self, name: str) -> None:
        self.delete_cube(name)

    # small documents: settings and catalogs as JSON

    def write_json(self, name: str, value: object) -> None:
        self.spark.createDataFrame([(json.dumps(value, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(self.path(name))

    def read_json(self, name: str) -> object:
        return json.loads("\n".join(r.value for r in self.spark.read.text(self.path(name)).collect()))

    def register(self, name: str, path: str) -> None:
        """Remember where a height model or land mask lies; it must be readable."""
        self.spark.read.parquet(path).schema  # noqa: B018
        self.write_json(f"_registered_{name}", {"path": path})

    def registered(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.read_json(f"_registered_{name}")["path"])

    def copy_to(self, other: Store, names: list[str], move: bool = False) -> None:
        """Copy (or move) tables to another store."""
        for n in names:
            self.spark.read.parquet(self.path(n)).write.mode("overwrite").parquet(other.path(n))
            if move:
                self.delete_cube(n)

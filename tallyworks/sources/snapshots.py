"""Tables of snapshots: Parquet that loads change bucket by bucket, with a manifest that is committed last.

    path/data/<load>-<attempt>/bucket=K/...   rows of the buckets that a load has written
    path/manifests/version=N/...              a row a bucket: which folder has it, and the load's name

A load reads the buckets of the keys that it changes, writes them anew into a folder of its own, and then
writes the next manifest.  Readers take the last manifest, so they see a load whole or not at all; what a
load that was cut off has written is in no manifest.  A load whose name is in a manifest has been done
and is skipped, so a load can be run again.  Tasks that are lost while the rows are written are run again
by Spark into the same folder.  One writer at a time: a manifest that is there already is an error.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import loads, reports

#: Buckets of a table.
BUCKETS = 64
_MANIFEST = "version long, load string, bucket int, folder string"


class Snapshots:
    """A table of columns ``schema`` under ``path``, in buckets of a hash of ``keys`` (null keys are a key)."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], schema: str, buckets: int = BUCKETS):
        self.spark, self.path, self.keys, self.schema, self.buckets = spark, path.rstrip("/"), keys, schema, buckets

    def manifests(self) -> DataFrame:
        """Rows (version, load, bucket, folder) of all versions; bucket is null in the row that only names a load."""
        try:
            return self.spark.read.schema(_MANIFEST).json(f"{self.path}/manifests")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], _MANIFEST)

    def version(self) -> int:
        """The last version; 0 before the first load."""
        return self.manifests().agg(F.max("version")).first()[0] or 0

    def _folders(self, version: int | None) -> dict[int, str]:
        at = self.version() if version is None else version
        return {r["bucket"]: r["folder"] for r in self.manifests().filter((F.col("version") == at) & F.col("bucket").isNotNull()).collect()}  # a row a bucket

    def _read(self, folders: dict[int, str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        paths = [f"{self.path}/data/{folder}/bucket={k}" for k, folder in sorted(folders.items())]
        return self.spark.read.schema(self.schema).parquet(*paths)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the last one if none is named."""
        return self._read(self._folders(version))

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*[F.col(k) for k in self.keys]), F.lit(self.buckets)).cast("int")

    def load(self, name: str, changed: DataFrame, merged: Callable[[DataFrame], DataFrame]) -> int:
        """The version after the load: ``merged`` of the rows in the buckets of ``changed`` keys takes their place."""
        log = self.manifests()
        if not log.filter(F.col("load") == name).isEmpty():
            return self.version()
        version, folders = self.version(), self._folders(None)
        touched = sorted(r[0] for r in changed.select(self._bucket().alias("bucket")).distinct().collect())
        folder = f"{name}-{uuid.uuid4().hex}"
        rows = merged(self._read({k: folders[k] for k in touched if k in folders})).withColumn("bucket", self._bucket())
        self.write(rows, folder)
        own = {r[0] for r in self.spark.read.parquet(f"{self.path}/data/{folder}").select("bucket").distinct().collect()} if touched else set()
        if own - set(touched):
            raise ValueError(f"load {name} has rows of keys that it doesn't change")
        now = {k: f for k, f in folders.items() if k not in touched} | dict.fromkeys(own, folder)
        self.commit(version + 1, name, now)
        return version + 1

    def write(self, rows: DataFrame, folder: str) -> None:
        rows.repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/data/{folder}")

    def commit(self, version: int, name: str, folders: dict[int, str]) -> None:
        """Write the manifest of a version: the load exists from here on."""
        rows = [(version, name, None, None), *((version, name, k, f) for k, f in folders.items())]
        self.spark.createDataFrame(rows, _MANIFEST).coalesce(1).write.mode("errorifexists").json(f"{self.path}/manifests/version={version}")

    def upsert(self, name: str, incoming: DataFrame) -> int:
        """Rows of equal keys are overwritten, others added."""
        return self.load(name, incoming, lambda old: reports.upsert(old, incoming, self.keys))

    def replace(self, name: str, incoming: DataFrame, kept: list[str]) -> int:
        """As upsert of a table with one key, but ``kept`` columns of a row that was there stay."""
        return self.load(name, incoming, lambda old: reports.replace_by_key(old, incoming, self.keys[0], kept))

    def replace_children(self, name: str, incoming: DataFrame, parents: DataFrame) -> int:
        """All rows of the ``parents`` keys give way to ``incoming``; a parent without new rows loses its own."""
        return self.load(name, parents, lambda old: loads.children_replaced(old, incoming, parents, self.keys[0]))

    def append(self, name: str, rows: DataFrame) -> int:
        """Rows are added, as an audit's."""
        return self.load(name, rows, lambda old: old.unionByName(rows.select(*old.columns)))

    def roll_back(self, name: str, version: int) -> int:
        """The next version has what ``version`` had."""
        now = self.version() + 1
        self.commit(now, name, self._folders(version))
        return now

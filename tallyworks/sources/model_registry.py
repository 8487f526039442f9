"""A registry of models: each is saved under a folder of its own, and a manifest that is written last says which ones count.

    path/models/<family>-<id>            a saved pipeline
    path/manifests/version=N/...         a row a family: its error, its folder, and what the retraining decided

A retraining that is cut off before its manifest leaves the registry as it was.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.models import deployment

_MANIFEST = "version long, family string, mape double, folder string, deployed boolean, reason string, old_mape double, new_mape double"


class Registry:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def manifests(self) -> DataFrame:
        """All versions, a row a family: (version, family, mape, folder) as they are, and how the last decision about it came out."""
        try:
            return self.spark.read.schema(_MANIFEST).json(f"{self.path}/manifests")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], _MANIFEST)

    def version(self) -> int:
        return self.manifests().agg(F.max("version")).first()[0] or 0

    def current(self, version: int | None = None) -> dict[str, dict]:
        """family to its row in a version, the last one if none is named."""
        at = self.version() if version is None else version
        return {r["family"]: r.asDict() for r in self.manifests().filter(F.col("version") == at).collect()}  # a row a family

    def decided(self, mapes: dict[str, float]) -> DataFrame:
        """What a retraining with these errors would deploy (``models.deployment``); nothing is written."""
        new = self.spark.createDataFrame(sorted(mapes.items()), "family string, mape double")
        old = self.manifests().filter((F.col("version") == self.version()) & F.col("mape").isNotNull()).select("family", "mape")
        return deployment(new, old)

    def retrained(self, trained: dict[str, tuple[PipelineModel, float]], dry_run: bool = False) -> DataFrame:
        """Decide about each family's new model and error, save those that are deployed, and switch to them; a dry run only decides."""
        decisions = self.decided({family: mape for family, (_, mape) in trained.items()})
        if dry_run:
            return decisions
        now = self.current()
        rows = {f: (r["mape"], r["folder"], False, r["reason"], r["old_mape"], r["new_mape"]) for f, r in now.items()}
        for d in decisions.collect():  # a row a family
            family, folder = d["family"], None
            if d["deploy"]:
                folder = f"{family}-{uuid.uuid4().hex}"
                trained[family][0].write().save(f"{self.path}/models/{folder}")
            own = now.get(family)
            rows[family] = (d["new_mape"], folder, True, d["reason"], d["old_mape"], d["new_mape"]) if d["deploy"] else (own["mape"], own["folder"], False, d["reason"], d["old_mape"], d["new_mape"])
        self.commit(self.version() + 1, rows)
        return decisions

    def commit(self, version: int, rows: dict[str, tuple]) -> None:
        """Write the manifest of a version: its models count from here on."""
        out = self.spark.createDataFrame([(version, family, *row) for family, row in sorted(rows.items())], _MANIFEST)
        out.coalesce(1).write.mode("errorifexists").json(f"{self.path}/manifests/version={version}")

    def load(self, family: str, version: int | None = None) -> PipelineModel:
        return PipelineModel.load(f"{self.path}/models/{self.current(version)[family]['folder']}")

    def roll_back(self, version: int) -> int:
        """The next version has the models of ``version``."""
        now = self.version() + 1
        self.commit(now, {f: (r["mape"], r["folder"], False, f"back to version {version}", r["old_mape"], r["new_mape"]) for f, r in self.current(version).items()})
        return now

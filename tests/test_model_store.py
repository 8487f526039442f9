"""The model registry, and boosting with Huber loss against squared loss on data with outliers."""

import random

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from tallyworks.operators import huber, models
from tallyworks.sources.model_registry import Registry


def table(spark, n=60):
    rows = [(f"s{i}", ["ACT", "AWP"][i % 2], float(i % 10), 1, 1.0, 2, i % 3, 0, 0, 0, 0.3, 5.0 + 20 * (i % 2) + (i % 10)) for i in range(n)]
    names = "scope_id string, scope_type string, log_area double, has_rate int, rate_ratio double, scope_count long, tier int, is_healthcare int, is_education int, is_church int, markup double, target double"
    return spark.createDataFrame(rows, names)


def test_models_are_deployed_refused_and_rolled_back(spark, tmp_path, monkeypatch):
    r, t = Registry(spark, f"file://{tmp_path}/models"), table(spark)
    one, two, three = (models.pipeline(trees=k, depth=3).fit(t) for k in (2, 3, 4))
    said = lambda model: sorted((x["scope_id"], x["predicted"]) for x in model.transform(t).select("scope_id", "predicted").collect())
    assert {x["family"]: x["deploy"] for x in r.retrained({"cost": (one, 20.0)}, dry_run=True).collect()} == {"cost": True}
    assert r.version() == 0 and not (tmp_path / "models").exists()
    r.retrained({"cost": (one, 20.0), "labour": (one, 60.0)})
    assert r.version() == 1 and said(r.load("cost")) == said(one)
    out = {x["family"]: (x["deploy"], x["reason"]) for x in r.retrained({"cost": (two, 20.9), "labour": (two, 63.1)}).collect()}
    assert out == {"cost": (True, "within tolerance"), "labour": (False, "worse than before")}
    assert said(r.load("cost")) == said(two) and said(r.load("labour")) == said(one)
    assert r.current()["labour"]["mape"] == 60.0 and r.current()["labour"]["new_mape"] == 63.1

    def cut(*_):
        raise OSError("the driver is gone")

    with monkeypatch.context() as m:
        m.setattr(Registry, "commit", cut)
        with pytest.raises(OSError, match="gone"):
            r.retrained({"cost": (three, 1.0)})
    assert r.version() == 2 and said(r.load("cost")) == said(two)
    assert r.roll_back(1) == 3 and said(r.load("cost")) == said(one) and r.current()["cost"]["mape"] == 20.0
    assert said(r.load("cost", 2)) == said(two)


def test_huber_is_nearer_than_squared_loss_where_there_are_outliers(spark):
    rng = random.Random(7)
    rows = []
    for k in range(500):
        x, z = rng.uniform(0, 10), rng.choice(["a", "b"])
        y = 0.3 + 0.02 * x + (0.1 if z == "b" else 0.0) + rng.gauss(0, 0.01)
        rows.append((k, x, z, y, y if k % 12 else y + rng.choice([30.0, 60.0])))
    df = spark.createDataFrame(rows, "id int, x double, z string, clean double, y double").cache()
    model = huber.fitted(df, "y", ["x", "type_index"], "id", rounds=40, step=0.2, depth=3, indexed="z")
    own = model.transform(df).select("clean", "predicted").collect()
    error = np.mean([abs(r["clean"] - r["predicted"]) for r in own])
    numbered = df.withColumn("n", (F.col("z") == "b").cast("double"))
    squared = GBTRegressor(featuresCol="v", labelCol="y", maxIter=40, stepSize=0.2, maxDepth=3, minInstancesPerNode=5, subsamplingRate=0.8, seed=42)
    v = VectorAssembler(inputCols=["x", "n"], outputCol="v").transform(numbered)
    other = np.mean([abs(r["clean"] - r["prediction"]) for r in squared.fit(v).transform(v).select("clean", "prediction").collect()])
    assert error < 0.05 and error < other / 10
    staged = model.transform(df, staged_from=20)
    assert staged.filter("spread < 0 or spread is null").count() == 0


def test_a_huber_leaf_is_the_median_and_what_is_off_it_cut(spark):
    values = [1.0, 2.0, 3.0, 4.0, 100.0]
    df = spark.createDataFrame([(k, 0.0, v) for k, v in enumerate(values)], "id int, x double, y double")
    model = huber.fitted(df, "y", ["x"], "id", rounds=1, step=1.0, sample=1.0)
    off = np.array(values) - 3.0
    width = sorted(abs(off))[4]
    want = 3.0 + np.median(off) + np.mean(np.clip(off - np.median(off), -width, width))
    assert model.start == 3.0 and model.transform(df).first()["predicted"] == pytest.approx(want)

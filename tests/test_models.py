import pytest
from pyspark.sql import functions as F

from tallyworks.operators import models


def table(spark, n=120):
    rows = [(f"s{i}", ["ACT", "AWP"][i % 2], float(i % 10), 1, 1.0, 2, i % 3, 0, 0, 0, 0.3, 5.0 + 20 * (i % 2) + (i % 10)) for i in range(n)]
    names = "scope_id string, scope_type string, log_area double, has_rate int, rate_ratio double, scope_count long, tier int, is_healthcare int, is_education int, is_church int, markup double, target double"
    return spark.createDataFrame(rows, names)


def test_cross_validation_learns_and_covers_each_row(spark):
    out = models.cross_validated(table(spark), trees=10, depth=5)
    assert out.select("scope_id").distinct().count() == out.count() == 120
    overall = models.error_report(out).filter("scope_type is null").first()
    assert overall["r2"] > 0.8
    assert overall["mape"] < 20


def test_too_few_rows_are_refused(spark):
    with pytest.raises(ValueError, match="too few"):
        models.cross_validated(table(spark, 4))


def test_prediction_interval_and_importances(spark):
    t = table(spark)
    model = models.pipeline(trees=5, depth=4).fit(t)
    rows = models.predict(model, t, 2.0).collect()
    assert all(r["low"] <= r["cost_per_sf"] <= r["high"] and r["cost_per_sf"] >= models.FLOOR for r in rows)
    got = models.importances(model, spark).collect()
    assert got[0]["feature"] == "type_index" or got[0]["importance"] >= got[-1]["importance"]
    assert abs(sum(r["importance"] for r in got) - 1) < 1e-6


def test_deployment(spark):
    new = spark.createDataFrame([("a", 10.0), ("b", 10.5), ("c", 11.0)], "family string, mape double")
    old = spark.createDataFrame([("b", 10.0), ("c", 10.0)], "family string, mape double")
    assert {r["family"]: r["deploy"] for r in models.deployment(new, old).collect()} == {"a": True, "b": True, "c": False}
    assert models.deployment(new.filter(F.lit(False)), old).count() == 0


def test_kinds_are_chosen_for_each_type_in_one_tuned_fit(spark):
    t = table(spark).unionByName(table(spark, 8).withColumn("scope_type", F.lit("rare")).withColumn("scope_id", F.concat(F.lit("r"), "scope_id")))
    own, report = models.models_chosen(t, trees={"forest": 5, "boosted": 5}, depth=4)
    assert set(own) == {"general", "ACT", "AWP"}
    rows = report.collect()
    assert len(rows) == 6 and all(sum(r["chosen"] for r in rows if r["family"] == f) == 1 for f in own)
    for f in own:
        errors = {r["kind"]: r["mape"] for r in rows if r["family"] == f}
        assert next(r["kind"] for r in rows if r["family"] == f and r["chosen"]) == min(errors, key=lambda k: (errors[k], k))
    assert own["ACT"].transform(t).filter("predicted is null").count() == 0


def test_tuned_folds_give_the_errors_of_folds_one_by_one(spark):
    t = table(spark, 60)
    _, errors = models.tuned(t, {"forest": 5}, 4)
    plain = models.cross_validated(t, trees=5, depth=4, k=3)
    each = plain.groupBy("fold").agg(F.avg(F.abs(F.col("predicted") - F.col("target")) / F.col("target")).alias("e")).agg(F.avg("e")).first()[0]
    assert errors["forest"] == pytest.approx(each, abs=0.02)  # trees depend on how rows are dealt


@pytest.mark.parametrize("fit", [lambda t: models.cross_validated(t, trees=2, depth=2, k=2).count(), lambda t: models.models_chosen(t, trees={"forest": 2}, depth=2), lambda t: models.best_model(t, trees=2, depth=2)], ids=["m2", "m1 by type", "m1 choice"])
def test_features_are_worked_out_once(spark, fit):
    seen = spark.sparkContext.accumulator(0)

    def same(x):
        seen.add(1)
        return x

    fit(table(spark, 40).withColumn("log_area", F.udf(same, "double")("log_area")))
    assert seen.value == 40


def test_trees_of_an_interval_are_worked_out_once(spark):
    rows = table(spark, 40).withColumn("man_days", F.col("log_area") + 1).withColumn("rate_ratio", F.lit(1.0)).withColumn("has_area", F.lit(1))
    out = models.labour_intervals(models.labour_model(rows, 2), rows)
    assert out.count() == 40 and any("/trees-" in f for f in out.inputFiles())


def test_each_round_of_boosting_is_held(spark, monkeypatch):
    from tallyworks.operators import huber

    held, fit = [], huber.DecisionTreeRegressor.fit
    monkeypatch.setattr(huber.DecisionTreeRegressor, "fit", lambda self, df, *a: held.append("InMemory" in df._jdf.queryExecution().executedPlan().toString()) or fit(self, df, *a))
    rows = table(spark, 40)
    model = huber.fitted(rows, "target", ["log_area", "tier"], "scope_id", rounds=3)
    assert held == [True] * 3 and model.transform(rows).filter("predicted is null").count() == 0
    assert spark.sparkContext._jsc.getPersistentRDDs().isEmpty()

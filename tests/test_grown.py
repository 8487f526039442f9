"""Trees over counted rows, against brute force, MLlib's own models and the rows one by one."""

import random

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from tallyworks.operators import grown, huber, model_features, models
from tallyworks.plans import overview_queries
from tallyworks.plans.tables import domain

SF = "/root/testdata/sf0.001"


def table(spark, n=300):
    rng = random.Random(3)
    rows = []
    for i in range(n):
        kind, x, z = rng.choice(["b", "a", "c"]), float(rng.randrange(100)), float(rng.randrange(3))
        rows.append((f"s{i}", kind, x, z, {"a": 50.0, "b": 5.0, "c": 40.0}[kind] + (x > 70) * 3 + rng.random()))
    return spark.createDataFrame(rows, "scope_id string, scope_type string, x double, z double, y double")


def one(found, **given):
    return grown.trained(found, [grown.Fit(None, "boosted", 1, 1, sample=1.0, **given)])[0][0]


def jobs_of(spark, name, run):
    spark.sparkContext.setJobGroup(name, name)
    run()
    spark.sparkContext._jsc.clearJobGroup()
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))


def test_a_split_is_the_best_one_and_types_split_by_their_mean(spark):
    t = table(spark)
    rows = t.toPandas()
    model = one(grown.counted(t, F.col("y"), ["x", "type_index", "z"]))
    first = rows["scope_type"] == "b"  # in the order of names b is between the others
    want = np.where(first, rows["y"][first].mean(), rows["y"][~first].mean())
    got = model.transform(t).toPandas()
    assert np.allclose(got.set_index("scope_id").loc[rows["scope_id"], "predicted"], want)
    by_number = one(grown.counted(t.filter("scope_type = 'a'"), F.col("y"), ["x", "z"]))
    own = rows[rows["scope_type"] == "a"]
    best = max((sum(len(p) * p["y"].mean() ** 2 for p in (own[own["x"] <= cut], own[own["x"] > cut])), cut) for cut in by_number.edges[0])[1]
    want = {s: p["y"].mean() for p in (own[own["x"] <= best], own[own["x"] > best]) for s in p["scope_id"]}
    assert all(r["predicted"] == pytest.approx(want[r["scope_id"]]) for r in by_number.transform(t.filter("scope_type = 'a'")).collect())


def test_equal_rows_count_as_so_many(spark):
    t = table(spark, 80)
    many = t.withColumn("k", F.explode(F.sequence(F.lit(1), F.when(F.col("x") > 50, 9).otherwise(2))))
    found = grown.counted(many, F.col("y"), ["x", "type_index"])
    assert found.rows.count() == 80 and found.rows.agg(F.sum(F.col("n")[0])).first()[0] == many.count()
    model = one(found, least=20)
    assert model.rows[0][0] == many.count() and model.value[0][0] == pytest.approx(many.agg(F.avg("y")).first()[0])
    drawn = grown._Draw(np.array([5, 1, 3]), grown.Fit(None, "forest", 1, 1))
    rng = np.random.default_rng(0)
    assert np.allclose(np.mean([drawn(rng) for _ in range(4000)], axis=0), [5, 1, 3], atol=0.2)
    drawn = grown._Draw(np.array([5, 1, 3]), grown.Fit(None, "boosted", 1, 1))
    assert np.allclose(np.mean([drawn(rng) for _ in range(4000)], axis=0), [4, 0.8, 2.4], atol=0.1)


def test_markups_are_fitted_in_few_jobs_and_outliers_pull_nothing(spark):
    rng = random.Random(7)
    rows = []
    for k in range(500):
        x, z = rng.uniform(0, 10), rng.choice(["a", "b"])
        y = 0.3 + 0.02 * x + (0.1 if z == "b" else 0.0) + rng.gauss(0, 0.01)
        rows.append((str(k), z, x, y, y if k % 12 else y + rng.choice([30.0, 60.0])))
    df = spark.createDataFrame(rows, "scope_id string, scope_type string, log_area double, clean double, markup_pct double")
    df = df.select("*", *[F.lit(0).alias(c) for c in models.MARKUP_FEATURES if c not in ("type_index", "log_area")])
    held = []
    assert jobs_of(spark, "markups", lambda: held.append(models.markup_model(df, trees=60))) < 30
    own = held[0].transform(df, staged_from=30).collect()
    assert len(held[0].rounds) == 60 and np.mean([abs(r["clean"] - r["predicted"]) for r in own]) < 0.05 and min(r["spread"] for r in own) >= 0
    plain = huber.fitted(df, "markup_pct", models.MARKUP_FEATURES, "scope_id", rounds=5, step=0.2, depth=3, indexed="scope_type").transform(df).agg(F.avg("predicted")).first()[0]
    found = grown.trained(grown.counted(df, F.col("markup_pct"), models.MARKUP_FEATURES), [grown.Fit(None, "huber", 5, 3, least=5, step=0.2)])[0][0]
    assert found.transform(df).agg(F.avg("predicted")).first()[0] == pytest.approx(plain, abs=0.01)


def test_too_many_counted_rows_are_left_to_spark(spark, monkeypatch):
    df = table(spark, 40).select("scope_id", "scope_type", F.col("x").alias("log_area"), (F.col("y") / 100).alias("markup_pct"), *[F.lit(0).alias(c) for c in models.MARKUP_FEATURES if c not in ("type_index", "log_area")])
    monkeypatch.setattr(grown, "MOST", 10)
    assert isinstance(models.markup_model(df, trees=1), huber.Huber)


def test_the_query_of_markups_learns_all_trees(spark, monkeypatch):
    held, real = [], models.markup_intervals
    monkeypatch.setattr(models, "markup_intervals", lambda model, rows: held.append(len(model.rounds)) or real(model, rows))
    overview_queries._markups(domain(spark, SF, "scopes"), domain(spark, SF, "projects")).collect()
    assert held == [300]


def test_a_model_is_written_as_one_of_mllib(spark, tmp_path):
    t = table(spark, 120).select("scope_id", "scope_type", F.col("x").alias("log_area"), F.col("y").alias("target"), *[F.col("z").alias(c) if c == "tier" else F.lit(0).alias(c) for c in models.FEATURES if c not in ("type_index", "log_area")])
    fits = [grown.Fit(None, kind, 4, 3) for kind in ("forest", "boosted")]
    for fit, (model, _) in zip(fits, grown.trained(grown.counted(t, F.col("target"), models.FEATURES), fits), strict=True):
        model.write().save(f"file://{tmp_path}/{fit.kind}")
        other = PipelineModel.load(f"file://{tmp_path}/{fit.kind}").transform(t).select("scope_id", F.col("predicted").alias("theirs"))
        assert model.transform(t).join(other, "scope_id").filter("abs(predicted - theirs) > 1e-9").count() == 0 and other.count() == 120
        assert models.importances(model, spark).first()["feature"] == "type_index"


def test_the_query_of_labour_learns_all_trees_and_reads_each_text_once(spark, monkeypatch):
    held, real = [], models.labour_intervals
    monkeypatch.setattr(models, "labour_intervals", lambda model, rows: held.append(len(model.rounds)) or real(model, rows))
    assert overview_queries._days(domain(spark, SF, "scopes")).count() > 0 and held == [300]
    plan = model_features.labour_features(domain(spark, SF, "scopes"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("concat_ws") == 1


def features(spark):
    return table(spark, 90).select("scope_id", "scope_type", F.col("x").alias("log_area"), F.col("y").alias("target"), *[F.col("z").alias(c) if c == "tier" else F.lit(0).alias(c) for c in models.FEATURES if c not in ("type_index", "log_area")])


@pytest.mark.parametrize("name, run", [("m1 by type", lambda t: models.models_chosen(t, trees={"forest": 6, "boosted": 6}, depth=3)), ("m1 choice", lambda t: models.best_model(t, trees=6, depth=3)), ("m2", lambda t: models.cross_validated(t, trees=6, depth=3).count())])
def test_all_folds_and_kinds_are_a_few_jobs(spark, name, run):
    t = features(spark)
    t.count()
    assert jobs_of(spark, name, lambda: run(t)) < 35


def test_errors_are_those_of_the_rows_held_out(spark):
    t = features(spark)
    found = grown.counted(t, F.col("target"), models.FEATURES, lot=models._fold(3), lots=3)
    model, error = grown.trained(found, [grown.Fit(None, "boosted", 5, 3, learnt=(0, 2), held=(1,))])[0]
    want = model.transform(t.filter(models._fold(3) == 1)).agg(F.avg(F.abs(F.greatest("predicted", F.lit(models.FLOOR)) - F.col("target")) / F.col("target"))).first()[0]
    assert error == pytest.approx(want)
    said = models.cross_validated(t, trees=5, depth=3, k=3)
    alone = grown.trained(found, [grown.Fit(None, "forest", 5, 3, 2, learnt=(0, 2))])[0][0]
    both = said.filter("fold = 1").join(alone.transform(t).select("scope_id", F.col("predicted").alias("p")), "scope_id")
    assert said.count() == 90 and both.agg(F.avg(F.abs(F.col("p") - F.col("predicted")))).first()[0] < 2


def test_the_queries_of_cost_models_learn_all_trees(spark, monkeypatch):
    class Seen(Exception):
        pass

    def seen(found, fits):
        raise Seen({(f.kind, f.trees, f.depth) for f in fits}, len(fits))

    monkeypatch.setattr(grown, "trained", seen)
    with pytest.raises(Seen) as e:
        overview_queries._families(domain(spark, SF, "scopes"), domain(spark, SF, "projects"))
    assert e.value.args == ({("forest", 200, 6), ("boosted", 300, 6)}, 64)

"""Cost models: folds, errors, predictions with an interval, importances, and the choice to deploy.

Trees are grown over counted rows, a fit a task (``grown``); where there are more of these than a task may hold,
by Spark over the whole table.  The driver gets trees and metrics only.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import grown
from .grown import Fit, Grown
from .huber import Huber, fitted
from .ranges import kept

FEATURES = ["log_area", "has_rate", "rate_ratio", "scope_count", "tier", "is_healthcare", "is_education", "is_church", "markup", "type_index"]
#: Rows below which there is no model, and a lower bound of predictions.
LEAST_ROWS, FLOOR = 5, grown.FLOOR
#: Rows of a leaf by the kind of model.
LEAST = {"forest": 2, "boosted": 1}
#: Share by which a new model's error may exceed the old one's.
TOLERANCE = 0.05


def training_table(features: DataFrame, scopes: DataFrame) -> DataFrame:
    """Features with the target, total cost a square foot."""
    target = F.when(F.col("square_footage") > 0, F.col("total") / F.col("square_footage"))
    return features.join(scopes.select("scope_id", target.alias("target")), "scope_id").filter("target > 0")


def pipeline(kind: str = "forest", trees: int = 50, depth: int = 6) -> Pipeline:
    common = {"featuresCol": "vector", "labelCol": "target", "predictionCol": "predicted", "seed": 42, "maxDepth": depth}
    model = RandomForestRegressor(numTrees=trees, minInstancesPerNode=2, featureSubsetStrategy="all", **common) if kind == "forest" else GBTRegressor(maxIter=trees, stepSize=0.05, subsamplingRate=0.8, **common)
    index = StringIndexer(inputCol="scope_type", outputCol="type_index", stringOrderType="alphabetAsc", handleInvalid="keep")
    return Pipeline(stages=[index, VectorAssembler(inputCols=FEATURES, outputCol="vector"), model])


class Mape(Evaluator):
    """Mean absolute error as a share of the target: what the kinds of model are chosen by."""

    def _evaluate(self, dataset: DataFrame) -> float:
        return float(dataset.agg(F.avg(F.abs(F.greatest("predicted", F.lit(FLOOR)) - F.col("target")) / F.col("target"))).first()[0] or 0.0)

    def isLargerBetter(self) -> bool:
        return False


def _fold(k: int, key: str = "scope_id") -> Column:
    return F.pmod(F.xxhash64(key, F.lit(42)), F.lit(k)).cast("int")


def tuned(table: DataFrame, trees: dict[str, int], depth: int = 6, k: int = 3, parallel: int = 4) -> tuple[Grown | PipelineModel, dict[str, float]]:
    """The best of the kinds in ``trees`` (kind: how many), fitted on the whole table, and each kind's mean error over k folds; folds are a hash of the key."""
    found = grown.counted(table, F.col("target"), FEATURES, lot=_fold(k), lots=k)
    if found is None:
        return _tuned_by_rows(table, trees, depth, k, parallel)
    return _chosen(found, [None], trees, depth, k)[None]


def _chosen(found: grown.Counted, families: list[str | None], trees: dict[str, int], depth: int, k: int) -> dict[str | None, tuple[Grown, dict[str, float]]]:
    """Each family's better kind, fitted on all its rows, and the kinds' mean errors over k folds: all fits of all families in one job."""
    lots, kinds = tuple(range(k)), sorted(trees)
    named = [(family, kind, fold) for family in families for kind in kinds for fold in (*lots, None)]
    fits = [Fit(family, kind, trees[kind], depth, LEAST[kind], learnt=tuple(i for i in lots if i != fold), held=() if fold is None else (fold,)) for family, kind, fold in named]
    done = dict(zip(named, grown.trained(found, fits), strict=True))
    out = {}
    for family in families:
        errors = {kind: sum(done[family, kind, fold][1] for fold in lots) / k for kind in kinds}
        out[family] = done[family, min(errors, key=lambda kind: (errors[kind], kind)), None][0], errors
    return out


def _tuned_by_rows(table: DataFrame, trees: dict[str, int], depth: int, k: int, parallel: int) -> tuple[PipelineModel, dict[str, float]]:
    """As ``tuned``, by MLlib: all kinds and folds side by side over vectors that are made once."""
    index = StringIndexer(inputCol="scope_type", outputCol="type_index", stringOrderType="alphabetAsc", handleInvalid="keep")
    prepare = Pipeline(stages=[index, VectorAssembler(inputCols=FEATURES, outputCol="vector")]).fit(table)
    dealt = kept(prepare.transform(table).select("scope_id", "target", "vector", _fold(k).alias("fold")), "vectors")
    choice, kinds = Pipeline(stages=[]), sorted(trees)
    grid = [{choice.stages: [pipeline(kind, trees[kind], depth).getStages()[-1]]} for kind in kinds]
    found = CrossValidator(estimator=choice, estimatorParamMaps=grid, evaluator=Mape(), numFolds=k, foldCol="fold", parallelism=parallel).fit(dealt.persist())
    dealt.unpersist()
    return PipelineModel([*prepare.stages, *found.bestModel.stages]), dict(zip(kinds, map(float, found.avgMetrics), strict=True))


def models_chosen(table: DataFrame, least: int = 10, trees: dict[str, int] | None = None, depth: int = 6, parallel: int = 4, k: int = 3) -> tuple[dict[str, Grown | PipelineModel], DataFrame]:
    """A model for each scope type of ``least`` rows or more and one over all (``general``): the kind of lower error in three folds.

    The second result has a row a family and kind: (family, kind, n, mape, chosen).
    """
    sizes = {"forest": 200, "boosted": 300} if trees is None else trees
    table = kept(table, "training")  # features are worked out once, not for each family
    counts = {r["scope_type"]: r["n"] for r in table.groupBy("scope_type").agg(F.count("*").alias("n")).filter((F.col("n") >= least) & F.col("scope_type").isNotNull()).collect()}  # a row a type
    found = grown.counted(table, F.col("target"), FEATURES, lot=_fold(k), lots=k)
    if found is None:
        done = {family: _tuned_by_rows(table if family is None else table.filter(F.col("scope_type") == family), sizes, depth, k, parallel) for family in [None, *sorted(counts)]}
    else:
        done = _chosen(found, [None, *sorted(counts)], sizes, depth, k)
    own, rows = {}, []
    for family, (model, errors) in done.items():
        name = family or "general"
        own[name], best = model, min(errors, key=lambda kind: (errors[kind], kind))
        rows += [(name, kind, counts.get(family, sum(counts.values())), error, kind == best) for kind, error in sorted(errors.items())]
    return own, table.sparkSession.createDataFrame(rows, "family string, kind string, n long, mape double, chosen boolean")


def best_model(table: DataFrame, trees: int = 50, depth: int = 6) -> tuple[str, Grown | PipelineModel, DataFrame]:
    """The kind of lower 3-fold error, forest or boosted trees, fitted on four fifths (on all below ten rows), and both errors: (kind, mape).

    The held-out fifth is a hash of the key; ``holdout`` gives its rows.
    """
    table = kept(table, "training")  # features are worked out once, not for each fit
    rows = table.count()
    if rows < LEAST_ROWS:
        raise ValueError(f"{rows} rows are too few to learn from")
    k = min(3, rows)
    aside = F.lit(0) if rows < 10 else holdout("scope_id").cast("int")
    found = grown.counted(table, F.col("target"), FEATURES, lot=2 * _fold(k) + aside, lots=2 * k)
    if found is None:
        _, scores = _tuned_by_rows(table, {"forest": trees, "boosted": trees}, depth, k, parallel=4)
        kind = min(scores, key=lambda k: (scores[k], k))
        model = pipeline(kind, trees, depth).fit(table if rows < 10 else table.filter(~holdout("scope_id")))
    else:
        fit = lambda kind, learnt, held=(): Fit(None, kind, trees, depth, LEAST[kind], learnt=learnt, held=held)
        folds = [(kind, fold) for kind in ("boosted", "forest") for fold in range(k)]
        fits = [fit(kind, tuple(i for i in range(2 * k) if i // 2 != fold), (2 * fold, 2 * fold + 1)) for kind, fold in folds]
        errors = {kf: error for kf, (_, error) in zip(folds, grown.trained(found, fits), strict=True)}
        scores = {kind: sum(errors[kind, fold] for fold in range(k)) / k for kind in ("boosted", "forest")}
        kind = min(scores, key=lambda k: (scores[k], k))
        model = grown.trained(found, [fit(kind, tuple(range(0, 2 * k, 2)))])[0][0]
    return kind, model, table.sparkSession.createDataFrame(sorted(scores.items()), "kind string, mape double")


def holdout(key: str) -> Column:
    """A fifth of the rows, by a hash."""
    return F.pmod(F.xxhash64(key, F.lit(42)), F.lit(5)) == 0


def models_by_type(table: DataFrame, least: int = 10, trees: int = 50, depth: int = 6) -> dict[str, PipelineModel]:
    """A model for each scope type of ``least`` rows or more, and one over all (``general``)."""
    counts = {r["scope_type"]: r["n"] for r in table.groupBy("scope_type").agg(F.count("*").alias("n")).filter(F.col("n") >= least).collect()}  # a row a type
    found = {kind: pipeline("forest", trees, depth).fit(table.filter(F.col("scope_type") == kind)) for kind in sorted(counts)}
    return found | {"general": pipeline("forest", 2 * trees, depth).fit(table)}


# Bounds of markups and man-days.
MARKUP_RANGE, MARKUP_MARGIN, LEAST_DAYS, LEAST_LOW = (0.10, 1.00), 0.05, 0.25, 0.1
MARKUP_FEATURES = ["type_index", "log_area", "scope_count", "is_healthcare", "is_education", "is_church", "rate_ratio", "has_cost"]
LABOUR_FEATURES = ["type_index", "log_area", "tier", "rate_ratio", "scope_count", "has_area"]


def _indexed(inputs: list[str], model) -> Pipeline:
    index = StringIndexer(inputCol="scope_type", outputCol="type_index", stringOrderType="alphabetAsc", handleInvalid="keep")
    return Pipeline(stages=[index, VectorAssembler(inputCols=inputs, outputCol="vector"), model])


def markup_model(features: DataFrame, trees: int = 300) -> Grown | Huber:
    """Boosted trees with Huber loss on the markup (H4's features)."""
    found = grown.counted(features, F.col("markup_pct"), MARKUP_FEATURES)
    if found is not None:
        return grown.trained(found, [Fit(None, "huber", trees, 4, least=5, step=0.05, sample=0.8)])[0][0]
    return fitted(features, "markup_pct", MARKUP_FEATURES, "scope_id", rounds=trees, step=0.05, depth=4, least=5, sample=0.8, indexed="scope_type")


def labour_model(features: DataFrame, trees: int = 300) -> Grown | PipelineModel:
    """A forest on the logarithm of man-days (H4's features)."""
    found = grown.counted(features.filter("man_days > 0"), F.log1p("man_days"), LABOUR_FEATURES)
    if found is not None:
        return grown.trained(found, [Fit(None, "forest", trees, 8, least=3, tried=-int(-(len(LABOUR_FEATURES) ** 0.5) // 1))])[0][0]
    model = RandomForestRegressor(featuresCol="vector", labelCol="log_days", predictionCol="predicted", seed=42, numTrees=trees, maxDepth=8, minInstancesPerNode=3, featureSubsetStrategy="sqrt")
    return _indexed(LABOUR_FEATURES, model).fit(features.filter("man_days > 0").withColumn("log_days", F.log1p("man_days")))


def _over_trees(model: Grown | PipelineModel, rows: DataFrame) -> DataFrame:
    """``rows`` with ``mean`` and ``spread`` of the predictions of a forest's trees."""
    if isinstance(model, Grown):
        return model.transform(rows, staged_from=0).withColumnRenamed("predicted", "mean")
    trees = model.stages[-1].trees
    rows = PipelineModel(model.stages[:-1]).transform(rows).withColumns({"s1": F.lit(0.0), "s2": F.lit(0.0)})
    for tree in trees:
        rows = tree.copy().setPredictionCol("one").transform(rows)
        rows = rows.select(*[c for c in rows.columns if c not in ("one", "s1", "s2")], (F.col("s1") + F.col("one")).alias("s1"), (F.col("s2") + F.col("one") * F.col("one")).alias("s2"))
    mean = F.col("s1") / len(trees)
    return rows.withColumn("mean", mean).withColumn("spread", F.sqrt(F.greatest(F.col("s2") / len(trees) - mean * mean, F.lit(0.0))))


def markup_intervals(model: Grown | Huber, features: DataFrame) -> DataFrame:
    """Predicted markups, held to their range, with an interval of 1.96 deviations of the late stages, 0.05 at least."""
    rows = model.transform(features, staged_from=len(model.rounds) // 2)
    held = lambda v: F.greatest(F.least(v, F.lit(MARKUP_RANGE[1])), F.lit(MARKUP_RANGE[0]))
    margin = F.greatest(F.col("spread") * 1.96, F.lit(MARKUP_MARGIN))
    at = held(F.col("predicted"))
    return rows.select("scope_id", "scope_type", "markup_pct", F.round(at, 4).alias("predicted"), F.round(held(at - margin), 4).alias("low"), F.round(held(at + margin), 4).alias("high"))


def labour_intervals(model: Grown | PipelineModel, features: DataFrame) -> DataFrame:
    """Predicted man-days with an interval of 1.28 deviations: of the trees, or half those of the residuals in training, if greater."""
    rows = kept(_over_trees(model, features).select("scope_id", "scope_type", "man_days", "log_area", "mean", "spread"), "trees")  # read twice
    residual = float(rows.agg(F.coalesce(F.stddev_pop(F.log1p("man_days") - F.col("mean")), F.lit(0.0))).first()[0])
    half = F.greatest(F.col("spread"), F.lit(residual * 0.5)) * 1.28
    days = F.greatest(F.expm1("mean"), F.lit(LEAST_DAYS))
    low, high = F.greatest(F.expm1(F.greatest(F.col("mean") - half, F.lit(0.0))), F.lit(LEAST_LOW)), F.expm1(F.col("mean") + half)
    per = F.when(F.col("log_area") > 0, F.round(days / (F.expm1("log_area") / 1000), 3))
    return rows.select("scope_id", "scope_type", "man_days", F.round(days, 2).alias("predicted"), F.round(low, 2).alias("low"), F.round(high, 2).alias("high"), per.alias("days_per_1000_sf"))


def interval_report(rows: DataFrame, actual: str, least: float = 0.0) -> DataFrame:
    """By scope type: rows, means, error in percent (of the greater of the actual value and ``least``), and how many fall inside their interval."""
    error = F.abs(F.col("predicted") - F.col(actual)) / F.greatest(F.col(actual), F.lit(least))
    known = rows.filter(F.col(actual) > 0)
    return known.groupBy("scope_type").agg(F.count("*").alias("n"), F.round(F.avg(actual), 4).alias("mean_actual"), F.round(F.avg("predicted"), 4).alias("mean_predicted"), F.round(F.avg(error) * 100, 2).alias("mape"), F.round(F.avg(F.col(actual).between(F.col("low"), F.col("high")).cast("int")) * 100, 1).alias("inside_pct"))


def folds_of(rows: int) -> int:
    return 5 if rows >= 30 else 3 if rows >= 10 else rows


def cross_validated(table: DataFrame, key: str = "scope_id", kind: str = "forest", trees: int = 50, depth: int = 6, k: int | None = None) -> DataFrame:
    """Each row's prediction by the model of the other folds: (key, scope_type, fold, target, predicted).

    Folds are a hash of the key, so they are the same in each run and on any number of machines.
    """
    table = kept(table, "training")  # features are worked out once, not for each fold
    rows = table.count()
    if rows < LEAST_ROWS:
        raise ValueError(f"{rows} rows are too few to learn from")
    k = k or folds_of(rows)
    found = grown.counted(table, F.col("target"), FEATURES, lot=_fold(k, key), lots=k)
    dealt = table.withColumn("fold", F.pmod(F.xxhash64(key, F.lit(42)), F.lit(k)))
    if found is not None:
        fits = [Fit(None, kind, trees, depth, LEAST[kind], learnt=tuple(i for i in range(k) if i != fold)) for fold in range(k)]
        said = grown.predictions([model for model, _ in grown.trained(found, fits)], dealt, F.col("fold"))
        return said.select(key, "scope_type", "fold", "target", F.greatest("predicted", F.lit(FLOOR)).alias("predicted"))
    out: DataFrame | None = None
    for fold in range(k):
        model = pipeline(kind, trees, depth).fit(dealt.filter(F.col("fold") != fold))
        part = model.transform(dealt.filter(F.col("fold") == fold)).select(key, "scope_type", "fold", "target", F.greatest("predicted", F.lit(FLOOR)).alias("predicted"))
        out = part if out is None else out.unionByName(part)
    return out  # type: ignore[return-value]


def error_report(predictions: DataFrame) -> DataFrame:
    """Rows, means, MAPE and R2 by scope type, and over all (scope_type null)."""
    error = F.abs(F.col("predicted") - F.col("target")) / F.col("target")
    left, whole = F.sum(F.pow(F.col("target") - F.col("predicted"), 2)), F.var_pop("target") * F.count("*")
    out = predictions.rollup("scope_type").agg(F.count("*").alias("n"), F.round(F.avg("target"), 4).alias("mean_actual"), F.round(F.avg("predicted"), 4).alias("mean_predicted"), F.round(F.avg(error) * 100, 2).alias("mape"), F.round(1 - left / F.nullif(whole, F.lit(0.0)), 4).alias("r2"))
    return out


def spread(predictions: DataFrame) -> float:
    """Half the width of a prediction's interval: 1.5 deviations of the absolute residuals."""
    return float(predictions.agg(F.coalesce(F.stddev_pop(F.abs(F.col("target") - F.col("predicted"))), F.lit(0.0))).first()[0]) * 1.5


def predict(model: Grown | PipelineModel, features: DataFrame, half_width: float) -> DataFrame:
    rows = model.transform(features).withColumn("cost_per_sf", F.greatest("predicted", F.lit(FLOOR)))
    return rows.select("scope_id", "cost_per_sf", F.greatest(F.col("cost_per_sf") - half_width, F.lit(0.0)).alias("low"), (F.col("cost_per_sf") + half_width).alias("high"))


def importances(model: Grown | PipelineModel, spark) -> DataFrame:
    values = model.stages[-1].featureImportances.toArray().tolist()
    return spark.createDataFrame(list(zip(FEATURES, values, strict=True)), "feature string, importance double").orderBy(F.desc("importance"), "feature")


def deployment(metrics: DataFrame, manifest: DataFrame) -> DataFrame:
    """Which new models (family, mape) replace those of the manifest (family, mape): those without a predecessor, or not worse by more than the tolerance."""
    old = manifest.select("family", F.col("mape").alias("old_mape"))
    rows = metrics.select("family", F.col("mape").alias("new_mape")).join(old, "family", "left")
    deploy = F.col("old_mape").isNull() | (F.col("new_mape") <= F.col("old_mape") * (1 + TOLERANCE))
    reason = F.when(F.col("old_mape").isNull(), "no model before").when(deploy, "within tolerance").otherwise("worse than before")
    return rows.select("family", "old_mape", "new_mape", deploy.alias("deploy"), reason.alias("reason"))

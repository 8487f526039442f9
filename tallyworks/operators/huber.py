"""Boosted regression trees with Huber loss, over MLlib's tree.

The start is the median.  A round's width is a quantile of the absolute residuals; a tree is grown on the
residuals cut to the width, over a hash sample of the rows; then each leaf's value is worked out anew over all
its residuals: their median, and the mean of what they are off it, cut to the width.  So single rows that
are far off pull neither the tree nor a leaf.  A round is a tree fit and two aggregations over the table;
the driver gets the tree and a value a leaf.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.feature import StringIndexer, StringIndexerModel, VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressionModel, DecisionTreeRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranges import kept

#: Quantile of the absolute residuals beyond which they are cut, and its accuracy.
ALPHA, ACCURACY = 0.9, 10_000
#: Rounds after which the table of running predictions, of which each round's is held, is written anew, so that plans stay short.
WRITE = 10


@dataclass
class Huber:
    """A fitted model: the start, and for each round a tree and its leaves' values (by leaf number, step size included)."""

    inputs: list[str]
    index: StringIndexerModel | None
    start: float
    rounds: list[tuple[DecisionTreeRegressionModel, dict[float, float]]]

    def vectors(self, rows: DataFrame) -> DataFrame:
        rows = self.index.transform(rows) if self.index else rows
        return VectorAssembler(inputCols=self.inputs, outputCol="vector").transform(rows)

    def transform(self, rows: DataFrame, staged_from: int | None = None) -> DataFrame:
        """``rows`` with ``predicted``; with ``staged_from`` also ``spread``, the deviation of the running predictions from that round on."""
        columns = rows.columns
        out = self.vectors(rows).withColumns({"run_": F.lit(self.start), "s1_": F.lit(0.0), "s2_": F.lit(0.0)})
        n = 0
        for k, (tree, values) in enumerate(self.rounds):
            out = _leaf(tree, out).withColumn("run_", F.col("run_") + _value(values))
            if staged_from is not None and k >= staged_from:
                n += 1
                out = out.withColumns({"s1_": F.col("s1_") + F.col("run_"), "s2_": F.col("s2_") + F.col("run_") * F.col("run_")})
            out = out.select(*columns, "vector", "run_", "s1_", "s2_")
        mean = F.col("s1_") / max(n, 1)
        spread = [F.sqrt(F.greatest(F.col("s2_") / max(n, 1) - mean * mean, F.lit(0.0))).alias("spread")] if staged_from is not None else []
        return out.select(*columns, F.col("run_").alias("predicted"), *spread)


def _leaf(tree: DecisionTreeRegressionModel, rows: DataFrame) -> DataFrame:
    return tree.setLeafCol("leaf_").setPredictionCol("tree_").setFeaturesCol("vector").transform(rows)


def _value(values: dict[float, float]) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in sorted(values.items()) for x in kv]), F.col("leaf_")), F.lit(0.0))


def fitted(table: DataFrame, target: str, inputs: list[str], key: str, rounds: int = 300, step: float = 0.05, depth: int = 4, least: int = 5, sample: float = 0.8, indexed: str | None = None) -> Huber:
    """Learns ``target`` (rows with null are left out) from ``inputs``; ``indexed`` is a text column whose number is the input ``type_index``."""
    rows = table.filter(F.col(target).isNotNull())
    index = StringIndexer(inputCol=indexed, outputCol="type_index", stringOrderType="alphabetAsc", handleInvalid="keep").fit(rows) if indexed else None
    start = rows.agg(F.percentile_approx(target, 0.5, ACCURACY)).first()[0]
    if start is None:
        raise ValueError("no rows to learn from")
    model = Huber(inputs, index, float(start), [])
    own = model.vectors(rows).select(F.col(key).alias("key_"), "vector", F.col(target).cast("double").alias("y_"), F.lit(model.start).alias("run_"))
    own = kept(own, "boosting").persist()
    for k in range(rounds):
        off = F.col("y_") - F.col("run_")
        width = float(own.agg(F.percentile_approx(F.abs(off), ALPHA, ACCURACY)).first()[0])
        cut = own.withColumn("cut_", F.greatest(F.least(off, F.lit(width)), F.lit(-width)))
        part = cut.filter(F.pmod(F.xxhash64("key_", F.lit(k)), F.lit(1_000)) < int(1_000 * sample))
        tree = DecisionTreeRegressor(featuresCol="vector", labelCol="cut_", maxDepth=depth, minInstancesPerNode=least, seed=42).fit(part if not part.isEmpty() else cut)
        placed = _leaf(tree, own).select("key_", "vector", "y_", "run_", "leaf_").persist()
        away = placed.withColumn("off_", off)
        middle = away.groupBy("leaf_").agg(F.percentile_approx("off_", 0.5, ACCURACY).alias("m_"))  # a row a leaf
        rest = away.join(F.broadcast(middle), "leaf_").withColumn("d_", F.col("off_") - F.col("m_"))
        found = rest.groupBy("leaf_").agg((F.first("m_") + F.avg(F.greatest(F.least("d_", F.lit(width)), F.lit(-width)))).alias("value")).collect()
        values = {float(r["leaf_"]): step * float(r["value"]) for r in found}
        model.rounds.append((tree, values))
        ahead = placed.withColumn("run_", F.col("run_") + _value(values)).select("key_", "vector", "y_", "run_")
        ahead = (kept(ahead, "boosting") if k % WRITE == WRITE - 1 else ahead).persist()
        ahead.count()  # worked out while the round before is held
        placed.unpersist()
        own.unpersist()
        own = ahead
    own.unpersist()
    return model

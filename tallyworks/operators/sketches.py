"""Trends and statistics from stored sketches: each month's rows are read once, periods merge what months have stored.

A row of the stored table is a month and a scope type.  It holds counts and exact sums, a HyperLogLog sketch of
the projects (error about 1.04 / sqrt(2^LOG_K), 1.6 %) and KLL sketches of costs and markups (rank error about
1.3 % at K).  Months of other periods, and months that come later, are merged without the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.classify import SCOPE_TYPES
from .prices import TREND_TYPES, TREND_YEARS

#: Logarithm of the registers of a distinct count, and the size of a quantile sketch.
LOG_K, K = 12, 200
_VALUES = ("cost", "markup")


def monthly(scopes: DataFrame, projects: DataFrame) -> DataFrame:
    """(month, scope_type, n, projects, n_cost, sum_cost, least_cost, most_cost, costs, ... of markups): the stored table; month is null without a date."""
    dated = projects.select("project_id", F.trunc("quote_date", "month").alias("month"))
    rows = scopes.select("project_id", "scope_type", F.when(F.col("cost_per_unit") > 0, F.col("cost_per_unit").cast("double")).alias("cost"), F.col("markup_pct").cast("double").alias("markup"))
    rows = rows.join(dated, "project_id", "left")
    stats = [f(v).alias(f"{n}_{v}") for v in _VALUES for n, f in (("n", F.count), ("sum", F.sum), ("least", F.min), ("most", F.max))]
    sketches = [F.kll_sketch_agg_double(v, F.lit(K)).alias(f"{v}s") for v in _VALUES]
    priced = F.when(F.col("cost").isNotNull(), F.col("project_id"))
    return rows.groupBy("month", "scope_type").agg(F.count("*").alias("n"), F.hll_sketch_agg(priced, F.lit(LOG_K)).alias("projects"), *stats, *sketches)


def merged(stored: DataFrame, keys: list[str]) -> DataFrame:
    """The stored rows of each group of ``keys`` as one."""
    stats = [f(f"{n}_{v}").alias(f"{n}_{v}") for v in _VALUES for n, f in (("n", F.sum), ("sum", F.sum), ("least", F.min), ("most", F.max))]
    return stored.groupBy(*keys).agg(F.sum("n").alias("n"), F.hll_union_agg("projects").alias("projects"), *stats, *[F.kll_merge_agg_double(f"{v}s").alias(f"{v}s") for v in _VALUES])


def trends(stored: DataFrame, bucket: str = "year") -> DataFrame:
    """``prices.cost_trends`` from the stored table: exact means, projects by sketch."""
    label = {"year": F.year("month").cast("string"), "quarter": F.concat(F.year("month").cast("string"), F.lit(" Q"), F.quarter("month").cast("string")), "month": F.date_format("month", "MMM ''yy")}[bucket]
    rows = stored.filter(F.year("month").between(*TREND_YEARS) & F.col("scope_type").isin(TREND_TYPES) & (F.col("n_cost") > 0)).withColumn("date", label)
    cells = merged(rows, ["date", "scope_type"]).select("date", "scope_type", (F.col("sum_cost") / F.col("n_cost")).alias("mean"), F.hll_sketch_estimate("projects").alias("projects"))
    return cells.groupBy("date").agg(F.max("projects").alias("project_count"), *[F.round(F.max(F.when(F.col("scope_type") == t, F.col("mean"))), 2).alias(t.lower()) for t in TREND_TYPES])


def type_statistics(stored: DataFrame) -> DataFrame:
    """Count, mean, median by sketch and ends of costs and markups of each listed type, also of those without rows."""
    half = lambda v: F.round(F.when(F.col(f"n_{v}") > 0, F.kll_sketch_get_quantile_double(f"{v}s", F.lit(0.5))), 4)
    columns = [c for v in _VALUES for c in (F.col(f"n_{v}"), F.round(F.col(f"sum_{v}") / F.col(f"n_{v}"), 4).alias(f"mean_{v}"), half(v).alias(f"median_{v}"), F.round(f"least_{v}", 4).alias(f"least_{v}"), F.round(f"most_{v}", 4).alias(f"most_{v}"))]
    stats = merged(stored, ["scope_type"]).select("scope_type", *columns)
    types = stored.sparkSession.createDataFrame([(t,) for t in SCOPE_TYPES], "scope_type string")
    return F.broadcast(types).join(stats, "scope_type", "left").withColumns({f"n_{v}": F.coalesce(f"n_{v}", F.lit(0)) for v in _VALUES})

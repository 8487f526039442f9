"""Estimates, their confidence, comparables, and how they compare with what was spent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.parse import cents, exact

# Fixed values.
COST_PER_SF = {"ACT": 6.50, "AWP": 18.00, "AP": 22.00, "FW": 14.00, "WW": 45.00, "Baffles": 30.00, "RPG": 55.00, "SM": 12.00}
MARKUP = {"ACT": 0.30, "AWP": 0.35, "AP": 0.35, "FW": 0.35, "WW": 0.45, "Baffles": 0.40, "RPG": 0.50, "SM": 0.40}
DAYS_PER_1000_SF = {"ACT": 0.70, "AWP": 1.80, "AP": 2.00, "FW": 1.50, "WW": 3.00, "Baffles": 2.50, "RPG": 4.00, "SM": 1.00}
DEFAULTS = (12.00, 0.33, 1.20)
ACCURACY, GENERAL_ACCURACY = {"ACT": 0.87, "AWP": 0.82, "FW": 0.79}, 0.73
RATE, TAX, LEAST_CONFIDENCE = 725.0, 0.075, 0.3


def _of(table: dict[str, float], kind: Column, default: float) -> Column:
    out = F.when(F.lit(False), default)
    for name, value in table.items():
        out = out.when(kind == name, value)
    return out.otherwise(default)


def price_suggestions(plan_scopes: DataFrame) -> DataFrame:
    """(plan_id, scope_type, area_sf, confidence, ...) to priced scopes; scopes without area or of low confidence go.

    What models said (``model_cost``, ``model_markup``, ``model_days``, where there are such columns and
    values) comes before the rules of thumb.  Tax is on the material before markup.
    """
    rows = plan_scopes.filter((F.col("area_sf") > 0) & (F.col("confidence") >= LEAST_CONFIDENCE))
    cost, markup, days = (_of(t, F.col("scope_type"), d) for t, d in zip((COST_PER_SF, MARKUP, DAYS_PER_1000_SF), DEFAULTS, strict=True))
    by_model = lambda c, other: F.coalesce(c, other) if c in rows.columns else other
    rows = rows.withColumn("cost_per_sf", by_model("model_cost", cost)).withColumn("markup", by_model("model_markup", markup)).withColumn("man_days", by_model("model_days", F.col("area_sf") / 1000 * days))
    rows = rows.withColumn("material_cost", F.col("area_sf") * (F.col("cost_per_sf") / (1 + F.col("markup")))).withColumn("labour_cost", F.col("man_days") * RATE)
    total = F.col("material_cost") * (1 + F.col("markup")) + F.col("labour_cost") + F.col("material_cost") * TAX
    return rows.withColumn("total", total)


def scope_confidence(plan: Column, kind: Column, area: Column) -> Column:
    penalty = F.when((area < 100) | (area > 50_000), 0.85).otherwise(1.0)
    return plan * 0.6 + F.lit(0.4) * _of(ACCURACY, F.upper(kind), GENERAL_ACCURACY) * penalty


def project_estimates(plan_scopes: DataFrame) -> DataFrame:
    """Totals, man-days, area and area-weighted confidence of each plan."""
    rows = price_suggestions(plan_scopes).withColumn("own", scope_confidence(F.col("confidence"), F.col("scope_type"), F.col("area_sf")))
    weighed = F.sum(exact(F.col("own") * F.col("area_sf")))  # exact, so that the order of rows decides no last digit
    return rows.groupBy("plan_id").agg(F.count("*").alias("scopes"), cents(F.sum(exact(F.col("total")))).alias("total"), F.round(F.sum(exact(F.col("man_days"))), 4).cast("double").alias("man_days"), F.round(F.sum("area_sf"), 2).alias("area_sf"), F.round(weighed.cast("double") / F.sum(exact(F.col("area_sf"))).cast("double"), 4).alias("confidence"))


def similarity(kind: Column, area: Column, cost: Column, other_kind: Column, other_area: Column, other_cost: Column) -> Column:
    """Type 0.5, area 0.3 by log ratio, cost 0.2 by relative difference; without costs the first two count for all.  Sizes that aren't positive match nothing."""
    same = F.when(kind == other_kind, 1.0).otherwise(0.0)
    size = F.when((area > 0) & (other_area > 0), 1 / (1 + F.abs(F.log(area / other_area)))).otherwise(0.0)
    price = F.when(other_cost > 0, 1 / (1 + F.abs(cost - other_cost) / other_cost)).otherwise(0.0)
    base = same * 0.5 + size * 0.3
    return F.when(cost.isNotNull() & other_cost.isNotNull(), base + price * 0.2).otherwise(base / 0.8)


def accuracy(estimates: DataFrame) -> DataFrame:
    """Mean absolute and mean signed error against what was spent, in percent."""
    rows = estimates.filter("actual_total_cost > 0 and total_estimate is not null")
    error = (F.col("total_estimate") - F.col("actual_total_cost")) * 100 / F.col("actual_total_cost")
    return rows.agg(F.count("*").alias("n"), F.round(F.avg(F.abs(error)), 2).alias("mape"), F.round(F.avg(error), 2).alias("bias"))


def variance(estimates: DataFrame) -> DataFrame:
    actual = F.nullif(F.col("actual_total_cost"), F.lit(0.0))
    return estimates.select("estimate_id", "status", F.round((actual - F.col("total_estimate")) * 100 / actual, 2).alias("variance_pct"))


def quote_numbers(estimates: DataFrame, prefix: str = "CA") -> DataFrame:
    """Numbers PREFIX-YYYY-NNNN by year, in order of date and id.

    Rows of a year are counted by month first, so no task holds a year.
    """
    rows = estimates.select("estimate_id", "created_on", F.year("created_on").alias("year"), F.month("created_on").alias("month"))
    months = rows.groupBy("year", "month").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("year").orderBy("month").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.row_number().over(Window.partitionBy("year", "month").orderBy("created_on", "estimate_id"))
    rows = rows.withColumn("k", inside).join(F.broadcast(months.withColumn("before", before).drop("n")), ["year", "month"])
    return rows.select("estimate_id", F.format_string(f"{prefix}-%d-%04d", "year", (F.col("before") + F.col("k")).cast("long")).alias("quote_number"))


def build_up(scopes: DataFrame, scrap: float = 0.05) -> DataFrame:
    """Lines of each project's build-up by type, and a project's total (line null); tax is on material and markup."""
    lines = _lines(scrap)
    sums = scopes.groupBy("project_id").agg(*[F.sum(exact(v)).alias(n) for n, v in lines])  # a row a project, then a row a line
    none = F.lit(0).cast("decimal(30,8)")
    some = F.coalesce(*[n for n, _ in lines]).isNotNull()
    total = F.when(some, sum((F.coalesce(F.col(n), none) for n, _ in lines[1:]), F.coalesce(F.col(lines[0][0]), none)))
    parts = [F.struct(F.lit(n).alias("line"), cents(F.col(n)).alias("amount")) for n, _ in lines] + [F.struct(F.lit(None).cast("string").alias("line"), cents(total).alias("amount"))]
    return sums.select("project_id", F.explode(F.array(*parts)).alias("x")).select("project_id", "x.line", "x.amount")


def _lines(scrap: float) -> list[tuple[str, Column]]:
    material = F.col("material_cost") * (1 + scrap)
    markup = material * F.coalesce("markup_pct", F.lit(0.0))
    return [("material", material), ("markup", markup), ("labour", F.col("labor_price")), ("tax", (material + markup) * 0.06)]


def universal_price(scopes: DataFrame) -> DataFrame:
    """Price under each tax rule: flat 6 percent, 7.5 percent, none, and the county surtax with its ceiling."""
    base = F.col("material_cost") * (1 + F.coalesce("markup_pct", F.lit(0.0)))
    taxes = {"flat": base * 0.06, "high": base * 0.075, "none": F.lit(0.0), "county": base * 0.06 + F.least(base * 0.015, F.lit(5000.0))}
    rows = scopes.groupBy("project_id").agg(*[cents(F.sum(exact(base + F.col("labor_price") + t))).alias(f"price_{n}") for n, t in taxes.items()])
    return rows

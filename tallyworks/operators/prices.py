"""Price index, trends, vendor prices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import parse, rates
from ..functions.classify import SCOPE_TYPES
from .quantiles import medians

# Fixed values.
TREND_TYPES, TREND_YEARS = ["ACT", "AWP", "FW", "SM"], (2020, 2026)
BENCHMARKS = {"ACT": (1.57, 9.44), "AWP": (21.0, 34.0), "AP": (5.0, 35.0), "Baffles": (10.0, 150.0), "FW": (3.0, 15.0), "SM": (1.0, 20.0), "WW": (14.0, 45.0), "RPG": (5.0, 100.0), "Other": (0.5, 200.0)}
BOUNDS = {"ACT": (0.80, 20.0), "AWP": (5.0, 60.0), "AP": (2.0, 80.0), "Baffles": (5.0, 200.0), "FW": (1.0, 25.0), "SM": (0.5, 50.0), "WW": (5.0, 80.0), "RPG": (3.0, 300.0), "Other": (0.5, 300.0)}
SUMMARY_SPLIT = "2025-07-01"


def by_type(table: dict[str, tuple[float, float]], kind: Column, i: int, default: float) -> Column:
    out = F.when(F.lit(False), default)
    for name, pair in table.items():
        out = out.when(kind == name, pair[i])
    return out.otherwise(default)


def cost_trends(scopes: DataFrame, projects: DataFrame, bucket: str = "year") -> DataFrame:
    """Mean cost a unit by period, one column a scope type, and the most projects of a type; ordered by the label."""
    month = F.date_format("quote_date", "MMM ''yy")
    label = {"year": F.year("quote_date").cast("string"), "quarter": F.concat(F.year("quote_date").cast("string"), F.lit(" Q"), F.quarter("quote_date").cast("string")), "month": month}[bucket]
    dated = projects.filter(F.year("quote_date").between(*TREND_YEARS)).select("project_id", label.alias("date"))
    rows = scopes.filter((F.col("cost_per_unit") > 0) & F.col("scope_type").isin(TREND_TYPES)).select("project_id", "scope_type", "cost_per_unit").join(dated, "project_id")
    cells = rows.groupBy("date", "scope_type").agg(F.avg("cost_per_unit").alias("mean"), F.countDistinct("project_id").alias("n"))
    return cells.groupBy("date").agg(F.max("n").alias("project_count"), *[F.round(F.max(F.when(F.col("scope_type") == t, F.col("mean"))), 2).alias(t.lower()) for t in TREND_TYPES])


def scope_distribution(scopes: DataFrame, approx: bool = False) -> DataFrame:
    """Counts, means, medians and ranges of cost and markup by type; medians are exact unless ``approx``."""
    columns = ("cost_per_unit", "markup_pct")
    stats = [f(c).alias(f"{n}_{c}") for c in columns for n, f in (("avg", lambda c: F.round(F.avg(c), 4)), ("min", lambda c: F.round(F.min(c), 4)), ("max", lambda c: F.round(F.max(c), 4)))]
    if approx:
        return scopes.groupBy("scope_type").agg(F.count("*").alias("n"), *stats, *[F.round(F.percentile_approx(c, 0.5), 4).alias(f"median_{c}") for c in columns])
    return with_medians(scopes.groupBy("scope_type").agg(F.count("*").alias("n"), *stats), scopes, ["scope_type"], {f"median_{c}": F.col(c) for c in columns})


def with_medians(stats: DataFrame, rows: DataFrame, keys: list[str], values: dict[str, Column]) -> DataFrame:
    """``stats``, a row for each group, with the medians of ``rows``, rounded to four places."""
    own = medians(rows, keys, values).select(*[F.col(k).alias(f"{k}_of") for k in keys], *[F.round(v, 4).alias(v) for v in values])
    return stats.join(own, [F.col(k).eqNullSafe(F.col(f"{k}_of")) for k in keys], "left").drop(*[f"{k}_of" for k in keys])


def type_statistics(scopes: DataFrame) -> DataFrame:
    """Statistics of cost for each listed type, also those without rows; one value has deviation 0."""
    cost = F.when(F.col("cost_per_unit") > 0, F.col("cost_per_unit"))
    stats = scopes.groupBy("scope_type").agg(F.count(cost).alias("n"), F.round(F.avg(cost), 4).alias("mean"), F.round(F.stddev_samp(cost), 4).alias("std"), F.round(F.sum("square_footage"), 2).alias("area"))
    stats = with_medians(stats, scopes, ["scope_type"], {"median": cost})
    types = scopes.sparkSession.createDataFrame([(t,) for t in SCOPE_TYPES], "scope_type string")
    out = F.broadcast(types).join(stats, "scope_type", "left")
    return out.select("scope_type", F.coalesce("n", F.lit(0)).alias("n"), "mean", "median", F.when(F.col("n") > 0, F.coalesce("std", F.lit(0.0))).alias("std"), "area")


def coverage(scopes: DataFrame, projects: DataFrame) -> DataFrame:
    rows = scopes.join(projects.select("project_id", "quote_date"), "project_id", "left")
    fields = {"dated": "quote_date", "cost": "cost_per_unit", "man_days": "man_days", "rate": "daily_labor_rate"}
    counts = [F.count(c).alias(f"with_{n}") for n, c in fields.items()]
    one = rows.agg(F.count("*").alias("total"), *counts)
    return one.select("total", *[f"with_{n}" for n in fields], *[F.when(F.col("total") > 0, F.round(F.col(f"with_{n}") * 100.0 / F.col("total"), 1)).otherwise(0.0).alias(f"pct_{n}") for n in fields])


def era_analysis(scopes: DataFrame) -> DataFrame:
    """Costs by band of the labour rate: a row for each band and type, and one for each band alone (scope_type null)."""
    rows = scopes.filter((F.col("daily_labor_rate") > 0) & (F.col("cost_per_unit") > 0)).select(rates.era(F.col("daily_labor_rate")).alias("era"), "scope_type", "cost_per_unit")
    out = rows.rollup("era", "scope_type").agg(F.grouping_id().alias("g"), F.count("*").alias("n"), F.round(F.avg("cost_per_unit"), 4).alias("mean")).filter("g < 3")
    cost = {"median": F.col("cost_per_unit")}
    parts = [with_medians(out.filter("g = 0"), rows, ["era", "scope_type"], cost), with_medians(out.filter("g = 1"), rows, ["era"], cost)]
    return parts[0].unionByName(parts[1]).select("era", "scope_type", "n", "mean", "median")


def normalised(scopes: DataFrame) -> DataFrame:
    """Each scope at the present labour rate, with prices a square foot and the reasons why it is out of bounds."""
    labour = rates.normal_labour(F.col("man_days"), F.col("daily_labor_rate"), F.col("labor_price"))
    rows = scopes.withColumn("normal_labour", labour).withColumn("factor", rates.labour_factor(F.col("daily_labor_rate")))
    rows = rows.withColumn("normal_total", F.when(F.col("normal_labour").isNotNull() & F.col("material_price").isNotNull(), F.col("material_price") + F.col("normal_labour") + F.col("material_price") * 0.06).otherwise(F.col("total")))
    area = F.when(F.col("square_footage") > 0, F.col("square_footage"))
    low, high = (by_type(BOUNDS, F.col("scope_type"), i, (0.5, 300.0)[i]) for i in (0, 1))
    reasons = F.array_compact(F.array(F.when(F.col("cost_per_unit") < low, "cost below"), F.when(F.col("cost_per_unit") > high, "cost above"), F.when(~F.col("markup_pct").between(-0.20, 2.50), "markup")))
    return rows.select("scope_id", "scope_type", "factor", "normal_labour", parse.cents(parse.exact(F.col("normal_total"))).alias("normal_total"), parse.to_places(F.nullif(F.col("normal_labour"), F.lit(0.0)) / area, 4).alias("labour_per_sf"), parse.to_places(F.nullif(F.col("normal_total"), F.lit(0.0)) / area, 4).alias("price_per_sf"), F.array_join(reasons, "; ").alias("reasons"))


def labour_impact(scopes: DataFrame) -> DataFrame:
    """Labour a square foot by type, as it was and at the present rate."""
    rows = scopes.filter("square_footage > 0 and labor_price > 0 and daily_labor_rate > 0")
    own = rates.normal_labour(F.col("man_days"), F.col("daily_labor_rate"), F.col("labor_price"))
    return rows.groupBy("scope_type").agg(F.count("*").alias("n"), F.round(F.avg(rates.labour_factor(F.col("daily_labor_rate"))), 4).alias("factor"), F.round(F.avg(F.col("labor_price") / F.col("square_footage")), 4).alias("labour_per_sf"), F.round(F.avg(own / F.col("square_footage")), 4).alias("normal_per_sf"))


def benchmark_flags(scopes: DataFrame) -> DataFrame:
    """Where a cost stands to its type's benchmark range."""
    low, high = (by_type(BENCHMARKS, F.col("scope_type"), i, (0.5, 200.0)[i]) for i in (0, 1))
    cost = F.col("cost_per_unit")
    flag = F.when(cost < low * 0.5, "far below").when(cost < low, "below").when(cost > high * 2, "far above").when(cost > high, "above").otherwise("in range")
    return scopes.filter(cost > 0).groupBy("scope_type", flag.alias("flag")).agg(F.count("*").alias("n"))


def priced_items(items: DataFrame) -> DataFrame:
    """Items with a cost that can be read, keyed by product, unit and vendor."""
    rows = items.withColumn("unit_cost", parse.money(F.col("unit_cost_text"), strict=True).cast("double")).filter("unit_cost > 0 and quote_date is not null")
    return rows.withColumn("product_key", F.substring(F.lower(F.trim("product")), 1, 80)).withColumn("unit_key", F.upper(F.trim("unit"))).withColumn("vendor_key", F.coalesce("vendor", F.lit("Unknown")))


def price_alerts(items: DataFrame, threshold: float = 10.0) -> DataFrame:
    """Consecutive prices of a product, unit and vendor that differ by ``threshold`` percent or more; same-day rows go by quote and line."""
    w = Window.partitionBy("product_key", "unit_key", "vendor_key").orderBy("quote_date", "quote_id", "line_no", "part_id", "unit_cost")
    rows = priced_items(items).withColumn("old_cost", F.lag("unit_cost").over(w)).withColumn("old_date", F.lag("quote_date").over(w))
    change = F.round((F.col("unit_cost") - F.col("old_cost")) * 100 / F.col("old_cost"), 1)
    return rows.withColumn("pct", change).filter(F.abs("pct") >= threshold).select("product_key", "unit_key", "vendor_key", "old_date", "quote_date", "old_cost", "unit_cost", "pct")


def vendor_totals(items: DataFrame) -> DataFrame:
    """Quotes with their totals: one row a quote and vendor."""
    return items.groupBy("quote_id", "vendor").agg(F.sum("item_total").alias("total"), F.min("quote_date").alias("quote_date"), F.count("*").alias("items"))


def vendor_summary(items: DataFrame) -> DataFrame:
    """Quotes, totals, products and dates of each vendor; quotes without one are Unknown."""
    name = F.coalesce("vendor", F.lit("Unknown"))
    quotes = vendor_totals(items).groupBy(name.alias("vendor")).agg(F.count("*").alias("quotes"), F.round(F.avg("total"), 2).alias("avg_total"), F.round(F.min("total"), 2).alias("min_total"), F.round(F.max("total"), 2).alias("max_total"), F.sum("items").alias("items"), F.min("quote_date").alias("first_date"), F.max("quote_date").alias("last_date"))
    products = items.groupBy(name.alias("vendor")).agg(F.array_join(F.slice(F.sort_array(F.collect_set("product")), 1, 10), "|").alias("products"))
    return quotes.join(products, "vendor")


def vendor_price_summary(items: DataFrame, limit: int = 10) -> DataFrame:
    """Vendors of three quotes or more: mean total before and since the split, change and alert; the ``limit`` with most quotes."""
    return summary_of_totals(vendor_totals(items), limit)


def summary_of_totals(totals: DataFrame, limit: int = 10) -> DataFrame:
    """``vendor_price_summary`` from the totals of quotes."""
    recent = F.col("quote_date") >= F.lit(SUMMARY_SPLIT).cast("date")
    rows = totals.filter("vendor is not null and total > 0").groupBy("vendor").agg(F.count("*").alias("quotes"), F.avg(F.when(~recent, F.col("total"))).alias("baseline"), F.avg(F.when(recent, F.col("total"))).alias("recent"))
    pct = F.round((F.col("recent") - F.col("baseline")) * 100 / F.col("baseline"), 1)
    rows = rows.filter("quotes >= 3").withColumn("pct", pct).orderBy(F.desc("quotes"), "vendor").limit(limit)
    return rows.select("vendor", "quotes", parse.to_places(F.col("baseline"), 2).alias("baseline"), parse.to_places(F.col("recent"), 2).alias("recent"), "pct", F.coalesce(F.abs("pct") > 15, F.lit(False)).alias("alert"))

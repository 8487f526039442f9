"""Joins, features, reports and loads over domain tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import classify
from ..functions.parse import cents, exact, to_places
from .prices import with_medians
from .quantiles import medians

# Fixed values.
RATE, TYPICAL_MARKUP = 725.0, 0.30


def scopes_with_projects(scopes: DataFrame, projects: DataFrame) -> DataFrame:
    """Scopes with man-days and a markup in (0, 1], each with its project and the count of all the project's scopes."""
    counts = scopes.groupBy("project_id").agg(F.count("*").alias("scope_count"))
    rows = scopes.filter("man_days > 0 and markup_pct > 0 and markup_pct <= 1")
    return rows.join(projects.select("project_id", "project_type", "gc_name"), "project_id").join(counts, "project_id").select("scope_id", "project_id", "project_type", "gc_name", "scope_count")


def projects_with_type(projects: DataFrame, scopes: DataFrame, kind: str) -> DataFrame:
    own = scopes.filter(F.lower("scope_type") == kind.lower()).select("project_id")
    return projects.join(own, "project_id", "left_semi").select("project_id", "name")


def project_roll_up(projects: DataFrame, scopes: DataFrame) -> DataFrame:
    """Types, cost, area and mean cost of each project; all null if it has no scopes."""
    own = scopes.groupBy("project_id").agg(F.array_join(F.sort_array(F.collect_set("scope_type")), ",").alias("types"), cents(F.sum(exact(F.col("total")))).alias("total"), F.round(F.sum("square_footage"), 2).alias("area"), to_places(F.avg("cost_per_unit"), 4).alias("cost_per_unit"))
    return projects.select("project_id", "status").join(own, "project_id", "left")


def dashboard(projects: DataFrame, scopes: DataFrame, estimates: DataFrame) -> DataFrame:
    """One row: projects, estimates not exported (null status isn't counted), mean ACT cost in (0, 50), all area."""
    a = projects.agg(F.count("*").alias("projects"))
    b = estimates.agg(F.count_if(F.col("status") != "exported").alias("open_estimates"))
    act = (F.col("scope_type") == "ACT") & (F.col("cost_per_unit") > 0) & (F.col("cost_per_unit") < 50)
    c = scopes.agg(F.round(F.avg(F.when(act, F.col("cost_per_unit"))), 2).alias("act_cost"), F.round(F.sum("square_footage"), 0).alias("area"))
    return a.join(b, F.lit(True)).join(c, F.lit(True))  # three rows of one


def status_distribution(projects: DataFrame) -> DataFrame:
    rows = projects.groupBy("status").agg(F.count("*").alias("n"))
    return rows.join(F.broadcast(rows.agg(F.sum("n").alias("all"))), F.lit(True)).select("status", "n", F.round(F.col("n") * 100.0 / F.col("all"), 1).alias("pct"))


def readiness(scopes: DataFrame, least: int = 20) -> DataFrame:
    ready = F.col("cost_per_unit").isNotNull() & (F.col("square_footage") > 0) & F.col("markup_pct").isNotNull()
    return scopes.groupBy("scope_type").agg(F.count_if(ready).alias("ready"), (F.count_if(ready) > least).alias("trainable"))


def labour_analysis(scopes: DataFrame) -> DataFrame:
    """Man-days against area by type: medians, correlation and the fit of their logarithms."""
    rows = scopes.filter("man_days > 0 and square_footage > 0")
    x, y = F.log1p("square_footage"), F.log1p("man_days")
    stats = rows.groupBy("scope_type").agg(F.count("*").alias("n"), F.round(F.max("man_days"), 4).alias("most"), F.round(F.corr(x, y), 4).alias("log_corr"), F.round(F.regr_slope(y, x), 4).alias("slope"), F.round(F.regr_intercept(y, x), 4).alias("intercept"))
    return with_medians(stats, rows, ["scope_type"], {"median": F.col("man_days")})


def features(scopes: DataFrame, projects: DataFrame) -> DataFrame:
    """The model's features of each scope; missing area and markup are the type's median, then the column's after that, then a constant."""
    counts = scopes.groupBy("project_id").agg(F.count("*").alias("scope_count"))
    flags = classify.building_flags(F.col("name"), F.col("gc_name"))
    known = projects.select("project_id", "name", "gc_name")
    rows = scopes.join(known, "project_id").join(counts, "project_id")
    rows = rows.withColumn("log_area", F.when(F.col("square_footage") > 0, F.log1p("square_footage")))
    by_type = medians(scopes.filter("scope_type is not null"), ["scope_type"], {"type_markup": F.col("markup_pct")})
    area = medians(scopes, [], {"mid_area": F.when(F.col("square_footage") > 0, F.log1p("square_footage"))})
    rows = rows.join(by_type, "scope_type", "left").join(area, F.lit(True), "left")  # area is one row
    return rows.select(
        "scope_id",
        "scope_type",
        F.round(F.coalesce("log_area", "mid_area", F.lit(0.0)), 4).alias("log_area"),
        F.col("daily_labor_rate").isNotNull().cast("int").alias("has_rate"),
        F.round(F.coalesce(F.col("daily_labor_rate") / RATE, F.lit(1.0)), 4).alias("rate_ratio"),
        "scope_count",
        classify.product_tier(F.col("product_name")).alias("tier"),
        *[v.cast("int").alias(k) for k, v in flags.items()],
        F.round(F.coalesce("markup_pct", "type_markup", F.lit(TYPICAL_MARKUP)), 4).alias("markup"),
        F.round(F.when(F.col("square_footage") > 0, F.col("man_days") / F.col("square_footage")), 6).alias("days_per_sf"),
    )


def incremental(incoming: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """Rows of ``incoming`` whose key isn't loaded yet."""
    return incoming.join(existing.select(key), key, "left_anti").select(*incoming.columns)


def replace_by_key(existing: DataFrame, incoming: DataFrame, key: str, kept: list[str]) -> DataFrame:
    """``existing`` with the rows of ``incoming`` in place of those of equal key; columns ``kept`` of a replaced row stay."""
    old = existing.select(F.col(key).alias("key_"), *[F.col(c).alias(f"{c}_old") for c in kept], F.lit(True).alias("old_"))
    new = incoming.join(old, F.col(key) == F.col("key_"), "left")
    new = new.select(*[F.when(F.col("old_"), F.col(f"{c}_old")).otherwise(F.col(c)).alias(c) if c in kept else F.col(c) for c in existing.columns])
    return incremental(existing, incoming, key).unionByName(new)


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Union of both by ``keys``, null equal to null; values of ``incoming`` win."""
    values = [c for c in existing.columns if c not in keys]
    old = existing.select(*keys, *[F.col(c).alias(f"{c}_old") for c in values], F.lit(True).alias("in_old"))
    new = incoming.select(*[F.col(k).alias(f"{k}_new") for k in keys], *[F.col(c).alias(f"{c}_new") for c in values], F.lit(True).alias("in_new"))
    on = [F.col(k).eqNullSafe(F.col(f"{k}_new")) for k in keys]
    both = old.join(new, on, "full")
    return both.select(*[F.coalesce(f"{k}_new", k).alias(k) for k in keys], *[F.when(F.col("in_new"), F.col(f"{c}_new")).otherwise(F.col(f"{c}_old")).alias(c) for c in values])


def preferred_vendors(items: DataFrame, categories: dict[str, list[str]], n: int = 5) -> DataFrame:
    """The n vendors with most items in each category; an item may be in several; ties go by name."""
    low = F.lower("product")
    hits = F.array_compact(F.array(*[F.when(classify.contains_any(low, words), name) for name, words in categories.items()]))
    counts = items.filter("vendor is not null").select("vendor", F.explode(hits).alias("category")).groupBy("category", "vendor").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("category").orderBy(F.desc("n"), "vendor"))
    return counts.withColumn("rank", rank).filter(F.col("rank") <= n)


def price_history(items: DataFrame, product: str) -> DataFrame:
    """Priced rows of a product whose name holds a text, by date, nulls last."""
    from .prices import priced_items

    rows = priced_items(items).filter(F.contains(F.lower("product"), F.lit(product.lower())))
    return rows.select("product", "vendor", "quote_date", "unit_cost", "quote_id", "line_no").orderBy(F.asc_nulls_last("quote_date"), "quote_id", "line_no")


def contractor_names(projects: DataFrame) -> DataFrame:
    return projects.filter("gc_name is not null").select("gc_name").distinct().orderBy("gc_name")

"""Corrections and roll-ups of scopes, projects and estimates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.parse import cents, exact, to_places
from .estimates import RATE


def unnested(quotes: DataFrame, projects: DataFrame) -> DataFrame:
    """A row for each item of quotes (quote_id, project_id, vendor, items); quotes without items go, unknown projects are null."""
    rows = quotes.filter(F.size("items") > 0).select("quote_id", "project_id", "vendor", F.explode("items").alias("i")).select("quote_id", "project_id", "vendor", "i.*")
    return rows.join(projects.select("project_id", "status"), "project_id", "left")


def reclassified(scopes: DataFrame, overrides: DataFrame) -> DataFrame:
    """Counts by type before and after (scope_id, new_type) is applied where it differs."""
    both = scopes.select("scope_id", "scope_type").join(overrides, "scope_id", "left").withColumn("after", F.coalesce("new_type", "scope_type"))
    sides = both.select(F.explode(F.array(F.struct(F.col("scope_type").alias("t"), F.lit(1).alias("b"), F.lit(0).alias("a")), F.struct(F.col("after").alias("t"), F.lit(0).alias("b"), F.lit(1).alias("a")))).alias("x"))
    return sides.groupBy(F.col("x.t").alias("scope_type")).agg(F.sum("x.b").alias("before"), F.sum("x.a").alias("after"))


def dates_filled(projects: DataFrame, found: DataFrame) -> DataFrame:
    """Projects whose date the earliest found one (project_id, found_date) fills or changes."""
    first = found.groupBy("project_id").agg(F.min("found_date").alias("found_date"))
    rows = projects.select("project_id", F.col("quote_date").alias("old_date")).join(first, "project_id")
    return rows.filter(~F.col("old_date").eqNullSafe(F.col("found_date")))


def estimate_roll_up(estimates: DataFrame, scopes: DataFrame) -> DataFrame:
    own = scopes.groupBy(F.col("project_id").alias("estimate_id")).agg(F.sum("square_footage").alias("area"), F.sum("man_days").alias("days"))
    rows = estimates.select("estimate_id", "total_estimate").join(own, "estimate_id", "left")
    return rows.select("estimate_id", F.round("area", 2).alias("area"), F.round(F.when(F.col("days") > 0, F.col("days")), 4).alias("man_days"), to_places(F.when(F.col("area") > 0, F.col("total_estimate") / F.col("area")), 4).alias("cost_per_sf"))


def readiness_flags(estimates: DataFrame, scopes: DataFrame) -> DataFrame:
    own = scopes.groupBy(F.col("project_id").alias("estimate_id")).agg(F.bool_or(F.coalesce(F.col("square_footage") > 0, F.lit(False))).alias("has_area"), F.countDistinct("scope_type").alias("types"))
    rows = estimates.select("estimate_id", "status").join(own, "estimate_id", "left")
    return rows.select("estimate_id", F.coalesce("has_area", F.lit(False)).alias("has_area"), F.coalesce("types", F.lit(0)).alias("types"), F.coalesce(F.col("status").isin("reviewed", "finalized", "exported"), F.lit(False)).alias("reviewed"))


def retrain_trigger(estimates: DataFrame, since: str, least: int = 5, new: int = 3) -> DataFrame:
    """Whether enough actuals, and enough since the last training, are there."""
    has = F.col("actual_total_cost").isNotNull()
    one = estimates.agg(F.count_if(has).alias("actuals"), F.count_if(has & (F.col("created_on") >= F.lit(since).cast("date"))).alias("fresh"))
    reason = F.when(F.col("actuals") < least, "too few actuals").when(F.col("fresh") < new, "too few new actuals").otherwise("retrain")
    return one.select("actuals", "fresh", (reason == "retrain").alias("retrain"), reason.alias("reason"))


def page(projects: DataFrame, contains: str, years: tuple[int, int], offset: int, limit: int) -> DataFrame:
    """A page of projects, newest first: a top-k, so nothing but the page is sorted whole."""
    rows = projects.filter(F.contains(F.lower("name"), F.lit(contains.lower())) & F.year("quote_date").between(*years))
    return rows.orderBy(F.desc("created_on"), "project_id").select("project_id", "name", "quote_date").offset(offset).limit(limit)


def first_seen(items: DataFrame, cap: int = 5) -> DataFrame:
    """Each vendor's first ``cap`` distinct products in order of first sight."""
    first = items.filter("vendor is not null").groupBy("vendor", "product").agg(F.min(F.struct("quote_date", "quote_id", "line_no", "product")).alias("at"))
    rank = F.row_number().over(Window.partitionBy("vendor").orderBy("at"))
    rows = first.withColumn("k", rank).filter(F.col("k") <= cap)
    return rows.groupBy("vendor").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "product"))), lambda x: x["product"]), "|").alias("products"))


def edited(scopes: DataFrame, patch: DataFrame) -> DataFrame:
    """Project totals after a sparse patch (scope_id, new_markup, new_days); labour and total anew, without tax."""
    rows = scopes.join(patch, "scope_id", "left").withColumn("markup", F.coalesce("new_markup", "markup_pct", F.lit(0.0))).withColumn("days", F.coalesce("new_days", "man_days"))
    total = F.col("material_cost") * (1 + F.col("markup")) + F.col("days") * F.coalesce("daily_labor_rate", F.lit(RATE))
    return rows.groupBy("project_id").agg(cents(F.sum(exact(total))).alias("total"))


def training_rows(scopes: DataFrame, bounds: dict[str, tuple[float, float]]) -> DataFrame:
    """Rows that a cost model may learn from, by type: a positive target inside three times the type's bounds; SM and Other are left out."""
    keep = F.lit(False)
    for kind, (low, high) in bounds.items():
        if kind not in ("SM", "Other"):
            keep = keep | ((F.col("scope_type") == kind) & F.col("target").between(low, 3 * high))
    rows = scopes.withColumn("target", F.when(F.col("square_footage") > 0, F.col("total") / F.col("square_footage"))).filter(F.col("target") > 0).filter(keep)
    return rows.groupBy("scope_type").agg(F.count("*").alias("n"), F.round(F.avg("target"), 4).alias("mean"))

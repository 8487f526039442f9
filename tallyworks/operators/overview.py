"""Overviews of the whole data set, of its parts, and of models; their sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import rates
from ..functions.classify import SCOPE_TYPES
from ..functions.parse import cents, exact
from .quantiles import medians


def dataset_overview(tables: dict[str, DataFrame], projects: DataFrame, scopes: DataFrame, linked: Column) -> DataFrame:
    """Rows (measure, value): the size of each table, the range of quote dates, and the share of scopes that are linked to a product."""
    counts = None
    for name, rows in tables.items():
        one = rows.agg(F.count("*").cast("string").alias("value")).select(F.lit(f"rows of {name}").alias("measure"), "value")
        counts = one if counts is None else counts.unionByName(one)
    dates = projects.agg(F.min("quote_date").cast("string").alias("a"), F.max("quote_date").cast("string").alias("b"))
    share = scopes.agg(F.count_if(linked).alias("n"), F.count("*").alias("of"))
    more = [
        dates.select(F.lit("first quote").alias("measure"), F.col("a").alias("value")),
        dates.select(F.lit("last quote").alias("measure"), F.col("b").alias("value")),
        share.select(F.lit("percent linked").alias("measure"), F.round(F.col("n") * 100.0 / F.col("of"), 1).cast("string").alias("value")),
    ]
    for rows in more:
        counts = counts.unionByName(rows)
    return counts


def template_counts(headers: DataFrame, totals: DataFrame) -> DataFrame:
    """Quotes by template, with how many have a number and a total."""
    rows = headers.join(totals.select("doc_id", F.col("grand_total").alias("total")), "doc_id", "left")
    return rows.groupBy(F.coalesce("template", F.lit("Unknown")).alias("template")).agg(F.count("*").alias("quotes"), F.count("number").alias("numbered"), F.count("total").alias("with_total"))


def _stats(name: str, v: Column) -> list[Column]:
    deviation = F.when(F.count(v) > 0, F.coalesce(F.stddev_samp(v), F.lit(0.0)))
    return [F.count(v).alias(f"{name}_n"), F.round(F.avg(v), 4).alias(f"{name}_mean"), F.round(deviation, 4).alias(f"{name}_std"), F.round(F.min(v), 4).alias(f"{name}_min"), F.round(F.max(v), 4).alias(f"{name}_max")]


def type_measures() -> dict[str, Column]:
    """What is described of each scope type."""
    ratio = F.when((F.col("man_days") > 0) & (F.col("square_footage") > 0), F.col("man_days") / F.col("square_footage") * 1000)
    return {"cost": F.col("cost_per_unit"), "markup": F.col("markup_pct") * 100, "days": F.col("man_days"), "area": F.col("square_footage"), "rate": F.col("daily_labor_rate"), "days_per_1000": ratio}


def type_ranges(scopes: DataFrame) -> DataFrame:
    """Count, mean, median, deviation, least and greatest of each measure (a row each) of each listed type, also those without rows."""
    measures = type_measures()
    flat = scopes.groupBy("scope_type").agg(*[c for name, v in measures.items() for c in _stats(name, v)])
    mid = medians(scopes, ["scope_type"], measures).select(F.col("scope_type").alias("of_type"), *[F.col(n).alias(f"{n}_median") for n in measures])
    types = scopes.sparkSession.createDataFrame([(t,) for t in SCOPE_TYPES], "scope_type string")
    rows = F.broadcast(types).join(flat, "scope_type", "left").join(F.broadcast(mid), F.col("scope_type") == F.col("of_type"), "left")
    parts = [F.struct(F.lit(name).alias("measure"), F.coalesce(f"{name}_n", F.lit(0)).alias("n"), F.col(f"{name}_mean").alias("mean"), F.round(f"{name}_median", 4).alias("median"), F.col(f"{name}_std").alias("std"), F.col(f"{name}_min").alias("least"), F.col(f"{name}_max").alias("most")) for name in measures]
    return rows.select("scope_type", F.explode(F.array(*parts)).alias("x")).select("scope_type", "x.*")


def era_ranges(scopes: DataFrame) -> DataFrame:
    """For every listed band of the labour rate, also empty ones: scopes with a rate, and what their costs were."""
    rows = scopes.filter("daily_labor_rate > 0").select(rates.era(F.col("daily_labor_rate")).alias("era"), F.when(F.col("cost_per_unit") > 0, F.col("cost_per_unit")).alias("cost"))
    flat = rows.groupBy("era").agg(F.count("*").alias("scopes"), *_stats("cost", F.col("cost")))
    mid = medians(rows, ["era"], {"median": F.col("cost")}).select(F.col("era").alias("of_era"), F.round("median", 4).alias("cost_median"))
    eras = scopes.sparkSession.createDataFrame([(t,) for _, _, t in rates.ERAS], "era string")
    out = F.broadcast(eras).join(flat, "era", "left").join(F.broadcast(mid), F.col("era") == F.col("of_era"), "left")
    return out.select("era", F.coalesce("scopes", F.lit(0)).alias("scopes"), F.coalesce("cost_n", F.lit(0)).alias("cost_n"), "cost_mean", "cost_median", "cost_std", "cost_min", "cost_max")


def labour_ranges(scopes: DataFrame, extreme: float = 100.0) -> DataFrame:
    """Man-days by type: counts, mean, median, range, those with an area, extreme ones, and how they go with area."""
    rows = scopes.filter("man_days is not null")
    sized = F.col("square_footage") > 0
    flat = rows.groupBy("scope_type").agg(F.count("*").alias("n"), F.round(F.avg("man_days"), 4).alias("mean"), F.round(F.min("man_days"), 4).alias("least"), F.round(F.max("man_days"), 4).alias("most"), F.count("square_footage").alias("sized"), F.count_if(F.col("man_days") > extreme).alias("extreme"), F.round(F.corr(F.when(sized, F.col("square_footage")), F.when(sized, F.col("man_days"))), 4).alias("linear_corr"))
    mid = medians(rows, ["scope_type"], {"median": F.col("man_days")}).select(F.col("scope_type").alias("of_type"), F.round("median", 4).alias("median"))
    return flat.join(F.broadcast(mid), F.col("scope_type") == F.col("of_type")).drop("of_type")


def vendor_freight(quotes: DataFrame) -> DataFrame:
    """Of quotes (vendor, total, freight): mean freight, and freight in percent of the totals of quotes that state both."""
    both = F.col("freight").isNotNull() & (F.col("total") > 0)
    rows = quotes.groupBy(F.coalesce("vendor", F.lit("Unknown")).alias("vendor")).agg(F.round(F.avg("freight"), 2).alias("avg_freight"), F.sum(F.when(both, exact(F.col("freight")))).alias("f"), F.sum(F.when(both, exact(F.col("total")))).alias("t"), F.count("*").alias("quotes"))
    return rows.select("vendor", "quotes", "avg_freight", F.round(F.col("f").cast("double") * 100 / F.col("t").cast("double"), 1).alias("freight_pct"))


def vendor_products(items: DataFrame, n: int = 10) -> DataFrame:
    """How many distinct products each vendor has, and the first ``n`` by name; ranked after equal ones are combined, so no vendor's products are collected."""
    own = items.select(F.coalesce("vendor", F.lit("Unknown")).alias("vendor"), "product").distinct()
    rank = F.row_number().over(Window.partitionBy("vendor").orderBy("product"))
    first = own.withColumn("k", rank).filter(F.col("k") <= n).groupBy("vendor").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "product"))), lambda x: x["product"]), "|").alias("products"))
    return own.groupBy("vendor").agg(F.count("*").alias("distinct_products")).join(first, "vendor")


def portfolio(roll_up: DataFrame) -> DataFrame:
    """Projects, those with a total, the mean cost a unit over projects, and the value of all (from ``project_roll_up``)."""
    return roll_up.agg(F.count("*").alias("projects"), F.count("total").alias("priced"), F.round(F.avg("cost_per_unit"), 4).alias("avg_cost"), cents(F.sum(exact(F.col("total")))).alias("value"))


def grand_totals(estimates: DataFrame, items: DataFrame) -> DataFrame:
    """Estimates' totals with their additional items (estimate_id, item_type, amount)."""
    own = items.groupBy("estimate_id").agg(F.sum(exact(F.col("amount"))).alias("more"))
    rows = estimates.select("estimate_id", exact(F.col("total_estimate")).alias("t")).join(own, "estimate_id", "left")
    none = F.lit(0).cast("decimal(38,8)")
    return rows.select("estimate_id", cents(F.coalesce("more", none)).alias("additional"), cents(F.coalesce("t", none) + F.coalesce("more", none)).alias("grand_total"))


def unmatched_products(scopes: DataFrame, known: DataFrame, limit: int = 10) -> DataFrame:
    """The product names of most scopes among those that no product (name) has."""
    names = scopes.filter("product_name is not null").groupBy("product_name").agg(F.count("*").alias("n"))
    own = known.select(F.lower(F.trim("name")).alias("key")).distinct()
    return names.join(own, F.lower(F.trim("product_name")) == F.col("key"), "left_anti").orderBy(F.desc("n"), "product_name").limit(limit)


def unknown_products(scopes: DataFrame, known: DataFrame, cap: int = 5) -> DataFrame:
    """Estimates' products that aren't in the catalog: how many distinct ones, and the first by name."""
    own = scopes.filter("product_name is not null").select(F.col("project_id").alias("estimate_id"), "product_name").distinct()
    rest = own.join(known.select(F.lower(F.trim("name")).alias("key")).distinct(), F.lower(F.trim("product_name")) == F.col("key"), "left_anti")
    return rest.groupBy("estimate_id").agg(F.count("*").alias("unknown"), F.array_join(F.slice(F.array_sort(F.collect_set("product_name")), 1, cap), "|").alias("products"))


def gates(estimates: DataFrame, scopes: DataFrame, least: float = 0.5) -> DataFrame:
    """Whether an estimate may be reviewed (a scope has an area), finalised (a scope is accepted: sure enough, or adjusted by hand) and exported (both, and a total)."""
    accepted = F.coalesce(F.col("adjusted"), F.lit(False)) | F.coalesce(F.col("confidence") >= least, F.lit(False))
    own = scopes.groupBy("estimate_id").agg(F.bool_or(F.coalesce(F.col("square_footage") > 0, F.lit(False))).alias("area"), F.bool_or(accepted).alias("accepted"))
    rows = estimates.select("estimate_id", "total_estimate").join(own, "estimate_id", "left")
    area, good = F.coalesce("area", F.lit(False)), F.coalesce("accepted", F.lit(False))
    return rows.select("estimate_id", area.alias("may_review"), good.alias("may_finalise"), (area & good & F.coalesce(F.col("total_estimate") > 0, F.lit(False))).alias("may_export"))


def accuracy_by_type(estimates: DataFrame, scopes: DataFrame) -> DataFrame:
    """Scopes by type of estimates with an actual cost; each type carries the overall error, since scopes have no actuals."""
    rows = estimates.filter("actual_total_cost > 0 and total_estimate is not null")
    overall = rows.agg(F.round(F.avg(F.abs(F.col("actual_total_cost") - F.col("total_estimate")) * 100 / F.col("actual_total_cost")), 2).alias("mape"))
    counts = scopes.filter("scope_type is not null").join(rows.select(F.col("estimate_id").alias("project_id")), "project_id", "left_semi").groupBy("scope_type").agg(F.count("*").alias("n"))
    return counts.join(F.broadcast(overall), F.lit(True))


def page_total(projects: DataFrame, scopes: DataFrame, contains: str, years: tuple[int, int], kind: str) -> DataFrame:
    """How many projects a listing has in all, and the newest of them, filtered by name, years and a scope type."""
    own = scopes.filter(F.lower("scope_type") == kind.lower()).select("project_id")
    rows = projects.filter(F.contains(F.lower("name"), F.lit(contains.lower())) & F.year("quote_date").between(*years)).join(own, "project_id", "left_semi")
    return rows.agg(F.count("*").alias("total"), F.max("created_on").alias("newest"))


def price_messages(summary: DataFrame) -> DataFrame:
    """``vendor_price_summary`` with a message for those that alert."""
    way = F.when(F.col("pct") > 0, "up").otherwise("down")
    text = F.concat(F.col("vendor"), F.lit(" is "), way, F.lit(" "), F.format_string("%.1f%%", F.abs("pct")), F.lit(" since the baseline"))
    return summary.select("vendor", "quotes", "baseline", "recent", "pct", "alert", F.when(F.col("alert"), text).alias("message"))


def model_status(manifest: DataFrame) -> DataFrame:
    """Models (family, mape, r2, rows, trained_on), a row a training, as shown: the last result of each family, its error in percent, and how many trainings there were."""
    last = F.max(F.struct("trained_on", "mape", "r2", "rows")).alias("x")
    rows = manifest.groupBy("family").agg(last, F.count("*").alias("trainings"))
    return rows.select("family", "trainings", F.col("x.trained_on").alias("trained_on"), F.round(F.col("x.mape") * 100, 2).alias("mape_pct"), F.round("x.r2", 4).alias("r2"), F.col("x.rows").alias("rows"))


def manifest_upserted(manifest: DataFrame, decided: DataFrame, metrics: DataFrame) -> DataFrame:
    """The manifest (family, mape) after the families that ``deployment`` lets through took their new error."""
    new = metrics.join(decided.filter("deploy").select("family"), "family", "left_semi").select("family", "mape", F.lit(True).alias("replaced"))
    return manifest.join(new.select("family"), "family", "left_anti").select("family", "mape", F.lit(False).alias("replaced")).unionByName(new)


def save_training_table(table: DataFrame, path: str) -> None:
    """As Parquet, a folder for each scope type; what was there is replaced."""
    table.write.mode("overwrite").partitionBy("scope_type").parquet(path)


def load_training_table(spark: SparkSession, path: str) -> DataFrame:
    """The saved table; an error if there is none."""
    return spark.read.parquet(path)


def save_report(sections: dict[str, DataFrame], path: str) -> None:
    """Each section of a report, such as a review queue or a price index, as a JSON data set of its own."""
    for name, rows in sections.items():
        rows.write.mode("overwrite").json(f"{path}/{name}")

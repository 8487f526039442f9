"""Extraction results, vendor quotes and plan results as JSON files, and the product catalog.

Each reader has an explicit schema, keeps documents that can't be read apart and counts them; only the
catalog must be whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import backfill_date

SCOPE = "struct<scope_type:string,tag:string,product_name:string,square_footage:string,cost_per_sf:string,material_cost:string,markup_pct:string,material_price:string,man_days:string,labor_price:string,sales_tax:string,total:string>"
BUILD_UP = f"success boolean, error string, project struct<project_name:string,folder_name:string,source_file:string,grand_total:string,scopes:array<{SCOPE}>,additional_costs:array<struct<cost_type:string,description:string,amount:string,notes:string>>>"
VENDOR = "success boolean, quote struct<vendor_name:string,quote_number:string,quote_date:string,freight:string,sales_tax:string,grand_total:string,items:array<struct<product:string,sku:string,quantity:string,unit:string,unit_cost:string,total:string,notes:string>>>"
PLAN = "source_file string, success boolean, extraction_confidence double, total_area_sf string, scope_suggestions array<struct<scope_type:string,scope_tag:string,area_sf:string,length_lf:string,product_hint:string,confidence:double,source:string,rooms:array<string>>>"
OWN_QUOTE = "success boolean, error string, quote struct<quote_number:string,quote_date:string,client_name:string,gc_name:string,template_type:string,grand_total:string,line_items:array<struct<quantity:string,item_type:string,description:string,cost_per_unit:string,total:string>>>"
CATALOG = "canonical_name string, manufacturer string, category string, aliases array<string>"
#: Files that stand beside plan results and aren't any.
RESERVED = ["summary.json", "estimate.json"]


def documents(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(readable, unreadable) documents of all JSON files under a path, each with its file's name and path."""
    rows = spark.read.schema(f"{schema}, _corrupt_record string").option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(path)
    plain = lambda c: F.url_decode(F.replace(F.col(c), F.lit("+"), F.lit("%2B")))  # noqa: E731  paths come as URLs, in which a plus is a plus
    rows = rows.select("*", plain("_metadata.file_name").alias("file_name"), plain("_metadata.file_path").alias("file_path"))
    good = rows.filter(F.col("_corrupt_record").isNull()).drop("_corrupt_record")
    # A file that can't be read has no field; naming one keeps Spark from pruning all but the corrupt text.
    return good, rows.filter(F.col("_corrupt_record").isNotNull() & F.col("success").isNull()).select("file_name", "file_path")


def build_ups(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Projects, scopes and costs of successful results; failed and unreadable ones by file name."""
    rows, bad = documents(spark, path, BUILD_UP)
    good = rows.filter("success and project is not null")
    amount = lambda c: F.col(c).try_cast("decimal(18,4)")
    scopes = good.select("project.folder_name", F.posexplode("project.scopes").alias("position", "s")).select("folder_name", "position", "s.*")
    numbers = ["square_footage", "cost_per_sf", "material_cost", "markup_pct", "material_price", "man_days", "labor_price", "sales_tax", "total"]
    costs = good.select("project.folder_name", F.explode("project.additional_costs").alias("c")).select("folder_name", "c.*")
    return {
        "projects": good.select("project.project_name", "project.folder_name", "project.source_file", F.col("project.grand_total").try_cast("decimal(18,4)").alias("grand_total")),
        "scopes": scopes.withColumns({n: amount(n) for n in numbers}),
        "costs": costs.withColumn("amount", amount("amount")),
        "failed": rows.filter("not coalesce(success, false)").select("file_name").unionByName(bad.select("file_name")),
    }


def vendor_quotes(spark: SparkSession, path: str) -> DataFrame:
    """Successful vendor quotes; the project's folder is the file's name before the first ``__``."""
    rows, _ = documents(spark, path, VENDOR)
    folder = F.when(F.contains("file_name", F.lit("__")), F.substring_index("file_name", "__", 1))
    return rows.filter("success").select(folder.alias("folder_name"), "file_name", "quote.*")


def own_quotes(spark: SparkSession, path: str) -> DataFrame:
    """Successful quotes of one's own with the file they come from and their date; a date that can't be read is null."""
    rows, _ = documents(spark, path, OWN_QUOTE)
    good = rows.filter("success and quote is not null").select(F.col("file_name").alias("source_file"), "quote.*")
    return good.withColumn("dated", backfill_date(F.col("quote_date"))).withColumn("grand_total", F.col("grand_total").try_cast("decimal(18,4)"))


def plan_results(spark: SparkSession, path: str, project: str | None = None) -> DataFrame:
    """Plan results with the project that their folder names, filtered by a part of its name."""
    rows, _ = documents(spark, path, PLAN)
    rows = rows.filter(~F.col("file_name").isin(RESERVED)).withColumn("project", F.regexp_extract("file_path", r"/plans/([^/]+)/[^/]+\.json$", 1))
    return rows.filter(F.contains(F.lower("project"), F.lit(project.lower()))) if project else rows


def catalog(spark: SparkSession, path: str) -> DataFrame:
    """The product catalog, one JSON array; a missing or bad file is an error."""
    return spark.read.schema(CATALOG).option("multiLine", True).option("mode", "FAILFAST").json(path)

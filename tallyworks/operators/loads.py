"""Loads that replace or link by key, bulk edits, and reports of batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.parse import cents, exact, money, slug, to_places
from .estimates import LEAST_CONFIDENCE, RATE

# Patterns (Java) of who a quote is for.
CLIENT_FILE, STEM = r"(?i)^Quote\s+[0-9A-Za-z\-]+\s*-\s*(.+)$", r"^(.*?)(?:\.[^.]*)?$"
CLIENT = r"(?:Prepared for:|Prepared For:|ATTENTION:|Attention:)\s*([^\n]*\S)"
ADDRESS = r"(?i)(?:Project\s+Address|Project|Job\s+Address)\s*[:\-]\s*([^\n]+(?:\n[^\n]+)?)"
CONTRACTOR, CONTACT = r"(?i)(?:General\s+Contractor|GC|Contractor)\s*[:\-]\s*([^\n]+)", r"(?i)(?:Contact|Attn|Attention|Representative)\s*[:\-]\s*([^\n]+)"
TOKENS_IN = 0.8


def children_replaced(existing: DataFrame, incoming: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows of ``existing`` whose key wasn't loaded, and all of ``incoming``: a loaded parent without children loses its own."""
    return existing.join(keys.select(key).distinct(), key, "left_anti").select(*existing.columns).unionByName(incoming.select(*existing.columns))


def audit_rows(existing: DataFrame, results: DataFrame) -> DataFrame:
    """The audit (folder, good, loaded_on) with a row for each result, failed ones too."""
    return existing.unionByName(results.select(*existing.columns))


def quotes_linked(quotes: DataFrame, vendors: DataFrame, projects: DataFrame) -> DataFrame:
    """Quotes (quote_id, vendor, folder) with vendor_id by name and project_id by folder; null where there is none such."""
    who = vendors.select(F.col("name").alias("vendor_"), "vendor_id")
    where = projects.select(F.lower("folder").alias("folder_"), "project_id")
    rows = quotes.join(who, F.trim("vendor") == F.col("vendor_"), "left").join(where, F.lower("folder") == F.col("folder_"), "left")
    return rows.select("quote_id", "vendor_id", "project_id")


def parties(docs: DataFrame) -> DataFrame:
    """Client (by the file's name, else a label), address, contractor and contact of quotes (doc_id, file_name, text)."""
    group = lambda c, p: F.nullif(F.trim(F.regexp_extract(c, p, 1)), F.lit(""))
    client = F.coalesce(group(F.regexp_extract("file_name", STEM, 1), CLIENT_FILE), group("text", CLIENT))
    lines = F.filter(F.transform(F.split(F.regexp_extract("text", ADDRESS, 1), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return docs.select("doc_id", client.alias("client"), F.nullif(F.array_join(lines, " | "), F.lit("")).alias("address"), group("text", CONTRACTOR).alias("contractor"), group("text", CONTACT).alias("contact"))


def bulk_edited(scopes: DataFrame, patch: DataFrame, gone: DataFrame) -> DataFrame:
    """Scopes after a sparse patch (scope_id, new_area, new_markup, new_days, new_cost) and deletions: labour anew where days change, material where a cost is given, totals without tax."""
    rows = scopes.join(gone.select("scope_id"), "scope_id", "left_anti").join(patch, "scope_id", "left")
    area, days = F.coalesce("new_area", "square_footage"), F.coalesce("new_days", "man_days")
    labour = F.when(F.col("new_days").isNotNull(), days * F.coalesce(F.nullif("daily_labor_rate", F.lit(0.0)), F.lit(RATE))).otherwise(F.col("labor_price"))
    material = F.when(F.col("new_cost").isNotNull() & (area != 0), area * F.col("new_cost")).otherwise(F.coalesce("material_cost", F.lit(0.0)))
    total = material * (1 + F.coalesce("new_markup", "markup_pct", F.lit(0.0))) + F.coalesce(labour, F.lit(0.0))
    return rows.select("scope_id", "project_id", area.alias("square_footage"), to_places(labour, 2).alias("labor_price"), to_places(material, 2).alias("material_cost"), to_places(total, 2).alias("total"))


def labour_by_formula(scopes: DataFrame, hours: Column, base: Column, multiplier: Column) -> DataFrame:
    """Labour as days x hours x base rate x multiplier, and the day's rate that this makes."""
    rate = hours * base * multiplier
    return scopes.select("scope_id", to_places(rate, 2).alias("day_rate"), to_places(F.col("man_days") * rate, 2).alias("labour"))


def vendor_history(items: DataFrame, product: str, vendor: str | None = None) -> DataFrame:
    """Rows of a product whose name holds a text, of vendors whose name holds another, by date; costs that can't be read are null."""
    rows = items.filter(F.contains(F.lower("product"), F.lit(product.lower())))
    rows = rows.filter(F.contains(F.lower("vendor"), F.lit(vendor.lower()))) if vendor else rows
    cost = money(F.col("unit_cost_text"), strict=True).cast("double")
    return rows.select("product", "vendor", "quote_date", cost.alias("unit_cost"), "quote_id", "line_no").orderBy(F.asc_nulls_last("quote_date"), "quote_id", "line_no")


def numbers_continued(quotes: DataFrame, prior: DataFrame, prefix: str = "CA") -> DataFrame:
    """Numbers PREFIX-YYYY-NNNN of new quotes (quote_id, created_on), going on after a year's count (year, n).  Rows of a year are counted by month first, so no task holds a year."""
    rows = quotes.select("quote_id", "created_on", F.year("created_on").alias("year"), F.month("created_on").alias("month"))
    months = rows.groupBy("year", "month").agg(F.count("*").alias("m"))
    before = F.coalesce(F.sum("m").over(Window.partitionBy("year").orderBy("month").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = months.withColumn("before", before).join(prior, "year", "left").select("year", "month", (F.col("before") + F.coalesce("n", F.lit(0))).alias("first"))
    inside = F.row_number().over(Window.partitionBy("year", "month").orderBy("created_on", "quote_id"))
    rows = rows.withColumn("k", inside).join(first, ["year", "month"])
    return rows.select("quote_id", F.format_string(f"{prefix}-%d-%04d", "year", (F.col("first") + F.col("k")).cast("long")).alias("quote_number"))


def plan_notes(plan_scopes: DataFrame, plan_areas: DataFrame) -> DataFrame:
    """Of each plan: scopes, those without area and those too unsure, the area (the plan's own if no scope has one), and a note."""
    sized = F.col("area_sf") > 0
    unsure = ~F.coalesce(F.col("confidence") >= LEAST_CONFIDENCE, F.lit(False))
    sums = plan_scopes.groupBy("plan_id").agg(F.count("*").alias("scopes"), F.count_if(~F.coalesce(sized, F.lit(False))).alias("unsized"), F.count_if(unsure).alias("unsure"), F.sum(F.when(sized & ~unsure, exact(F.col("area_sf")))).alias("own"))
    rows = sums.join(plan_areas.select("plan_id", F.col("area_sf").alias("plan_area")), "plan_id", "left")
    note = F.concat_ws("; ", F.when(F.col("unsized") > 0, F.concat(F.col("unsized").cast("string"), F.lit(" without area"))), F.when(F.col("unsure") > 0, F.concat(F.col("unsure").cast("string"), F.lit(" too unsure"))), F.when(F.col("own").isNull() & F.col("plan_area").isNotNull(), "area of the plan"))
    return rows.select("plan_id", "scopes", "unsized", "unsure", F.coalesce(cents(F.col("own")), F.round("plan_area", 2)).alias("area_sf"), note.alias("note"))


def batch_costs(results: DataFrame, input_price: float, output_price: float) -> DataFrame:
    """By vendor and method of extraction (vendor, method, good, tokens): results, successes, tokens, and what they cost, four fifths being input."""
    total = F.sum("tokens")
    taken = F.floor(total * TOKENS_IN)
    cost = taken * input_price + (total - taken) * output_price
    rows = results.groupBy(F.coalesce("vendor", F.lit("unknown")).alias("vendor"), "method").agg(F.count("*").alias("results"), F.count_if("good").alias("good"), total.alias("tokens"), to_places(cost, 6).alias("cost"))
    return rows.withColumn("success_pct", F.round(F.col("good") * 100.0 / F.col("results"), 1))


def vendor_slugs(items: DataFrame) -> DataFrame:
    return items.filter("vendor is not null").select("vendor", slug(F.col("vendor")).alias("slug")).distinct()

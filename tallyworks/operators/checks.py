"""Validation of scopes and projects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.parse import to_places

# Fixed values.
AREA_TYPES = ["ACT", "AWP", "FW", "WW", "RPG"]
COST_RANGES = {"ACT": (1.57, 9.44), "AWP": (21.0, 34.0), "WW": (20.0, 45.0), "FW": (3.0, 5.0)}
MARKUP_WARNING, MARKUP_ERROR, TOLERANCE = (0.15, 0.75), (0.10, 1.00), 0.02


def off_by(a: Column, b: Column) -> Column:
    """Difference over the greater size, 1 at least; null if a side is."""
    return F.when(a.isNotNull() & b.isNotNull(), F.abs(a - b) / F.greatest(F.abs(a), F.abs(b), F.lit(1.0)))


def shown_money(amount: Column) -> Column:
    return F.concat(F.lit("$"), F.format_number(to_places(amount, 2), 2))


def shown_share(share: Column) -> Column:
    return F.format_string("%.1f%%", to_places(share * 100, 1))


def _texts(scopes_field: str, issue_type: str, severity: str) -> tuple[Column, Column]:
    """What a rule expected and what it found."""
    c = F.col
    if issue_type == "math_mismatch":
        sums = {
            "total": sum((F.coalesce(c(n), F.lit(0.0)) for n in ("labor_price", "sales_tax")), F.coalesce(c("material_price"), F.lit(0.0))),
            "material_price": c("material_cost") * (1 + c("markup_pct")),
            "material_cost": c("square_footage") * c("cost_per_unit"),
        }
        return shown_money(sums[scopes_field]), shown_money(c(scopes_field))
    if scopes_field == "markup_pct":
        low, high = MARKUP_ERROR if severity == "error" else MARKUP_WARNING
        return F.lit(f"{low:.0%} to {high:.0%}"), shown_share(c("markup_pct"))
    if scopes_field == "cost_per_sf":
        expected = F.lit(None).cast("string")
        for kind, (low, high) in COST_RANGES.items():
            expected = F.when(c("scope_type") == kind, f"${low:.2f} to ${high:.2f}").otherwise(expected)
        return expected, shown_money(c("cost_per_unit"))
    fixed = {"square_footage": "> 0", "total": "> 0", "sales_tax": ">= 0", "man_days": "> 0"}[scopes_field]
    return F.lit(fixed), F.coalesce(shown_money(c(scopes_field)), F.lit("none"))


def scope_issues(scopes: DataFrame, texts: bool = False) -> DataFrame:
    """(project_id, scope_id, field, issue_type, severity): a row for each rule that a scope breaks; with ``texts`` also what was expected and found, and a message."""
    c = F.col
    zero = lambda n: F.coalesce(c(n), F.lit(0.0))
    outside = lambda v, r: (v < r[0]) | (v > r[1])
    cost = F.lit(False)
    for kind, r in COST_RANGES.items():
        cost = cost | ((c("scope_type") == kind) & outside(c("cost_per_unit"), r))
    parts = c("material_price").isNotNull() | c("labor_price").isNotNull() | c("sales_tax").isNotNull()
    rules = [
        ("square_footage", "missing_required", "error", c("scope_type").isin(AREA_TYPES) & c("cost_per_unit").isNotNull() & (F.coalesce("square_footage", F.lit(0.0)) <= 0)),
        ("markup_pct", "out_of_range", "error", outside(c("markup_pct"), MARKUP_ERROR)),
        ("markup_pct", "out_of_range", "warning", ~outside(c("markup_pct"), MARKUP_ERROR) & outside(c("markup_pct"), MARKUP_WARNING)),
        ("cost_per_sf", "suspicious", "warning", (c("cost_per_unit") > 0) & cost),
        ("total", "out_of_range", "error", c("total") <= 0),
        ("sales_tax", "out_of_range", "error", c("sales_tax") < 0),
        ("total", "math_mismatch", "warning", (c("total") != 0) & parts & (off_by(zero("material_price") + zero("labor_price") + zero("sales_tax"), c("total")) > TOLERANCE)),
        ("material_price", "math_mismatch", "warning", (c("material_price") != 0) & (off_by(c("material_cost") * (1 + c("markup_pct")), c("material_price")) > TOLERANCE / 2)),
        ("material_cost", "math_mismatch", "warning", (c("material_cost") != 0) & (off_by(c("square_footage") * c("cost_per_unit"), c("material_cost")) > TOLERANCE / 2)),
        ("man_days", "missing_required", "warning", (c("labor_price") > 0) & c("man_days").isNull()),
    ]
    issues = F.array_compact(F.array(*[F.when(test, F.struct(F.lit(f).alias("field"), F.lit(t).alias("issue_type"), F.lit(s).alias("severity"), *_named(f, t, s, texts))) for f, t, s, test in rules]))
    return scopes.select("project_id", "scope_id", F.inline(issues))


def _named(field: str, issue_type: str, severity: str, texts: bool) -> list[Column]:
    if not texts:
        return []
    expected, actual = _texts(field, issue_type, severity)
    return [expected.alias("expected"), actual.alias("actual"), F.concat(F.lit(f"{field}: expected "), expected, F.lit(", found "), actual).alias("message")]


def project_issues(projects: DataFrame, scopes: DataFrame) -> DataFrame:
    """(project_id, field, issue_type, severity) of projects (project_id, grand_total): no scopes, scopes without a type, and a grand total that the scopes don't sum to."""
    own = scopes.groupBy("project_id").agg(F.count("*").alias("scopes"), F.count_if(F.trim(F.coalesce("scope_type", F.lit(""))) == "").alias("untyped"), F.sum("total").alias("sum"))
    rows = projects.select("project_id", "grand_total").join(own, "project_id", "left")
    wrong = (F.col("grand_total") != 0) & (off_by(F.col("sum"), F.col("grand_total")) > TOLERANCE)
    issue = lambda f, t, s: F.struct(F.lit(f).alias("field"), F.lit(t).alias("issue_type"), F.lit(s).alias("severity"))
    untyped = F.array_repeat(issue("scope_type", "missing_required", "warning"), F.coalesce(F.col("untyped"), F.lit(0)).cast("int"))
    issues = F.concat(F.array_compact(F.array(F.when(F.col("scopes").isNull(), issue("scopes", "missing_required", "error")), F.when(wrong, issue("grand_total", "math_mismatch", "warning")))), untyped)
    return rows.select("project_id", F.inline(issues))


def project_reports(projects: DataFrame, scopes: DataFrame) -> DataFrame:
    """Of each project (project_id, grand_total): scopes, valid ones, errors, warnings, confidence and a summary; its own issues count too."""
    found = scope_issues(scopes)
    bad = found.filter("severity = 'error'").select("project_id", "scope_id").distinct().groupBy("project_id").agg(F.count("*").alias("bad"))
    own = scopes.groupBy("project_id").agg(F.count("*").alias("scopes"))
    counted = found.select("project_id", "severity").unionByName(project_issues(projects, scopes).select("project_id", "severity"))
    counts = counted.groupBy("project_id").agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))
    rows = projects.select("project_id")
    for part in (own, bad, counts):
        rows = rows.join(part, "project_id", "left")
    rows = rows.na.fill(0).withColumn("valid_scopes", F.col("scopes") - F.col("bad"))
    score = F.greatest(F.lit(0.0), F.lit(1.0) - F.col("errors") * 0.2 - F.col("warnings") * 0.05)
    percent = F.format_string("%.0f%%", F.round(score.cast("decimal(10,6)") * 100, 0).cast("double"))
    good = F.concat(F.lit("valid, "), F.col("scopes").cast("string"), F.lit(" scopes, confidence "), percent)
    other = F.concat(F.col("valid_scopes").cast("string"), F.lit("/"), F.col("scopes").cast("string"), F.lit(" scopes valid, "), F.col("errors").cast("string"), F.lit(" errors, "), F.col("warnings").cast("string"), F.lit(" warnings, confidence "), percent)
    return rows.select("project_id", "scopes", "valid_scopes", "errors", "warnings", F.round(score, 4).alias("confidence"), F.when(F.col("errors") == 0, good).otherwise(other).alias("summary"))


def common_issues(projects: DataFrame, scopes: DataFrame, limit: int = 10) -> DataFrame:
    """The most frequent issues of scopes and projects."""
    every = scope_issues(scopes).select("field", "issue_type", "severity").unionByName(project_issues(projects, scopes).select("field", "issue_type", "severity"))
    return every.groupBy("field", "issue_type", "severity").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "field", "issue_type", "severity").limit(limit)


def markup_outliers(scopes: DataFrame, above: float = 1.0, limit: int = 5) -> DataFrame:
    """Scopes with a markup above a share (100 percent), the greatest first."""
    return scopes.filter(F.col("markup_pct") > above).select("scope_id", "project_id", "scope_type", "markup_pct").orderBy(F.desc("markup_pct"), "scope_id").limit(limit)


def worst_projects(scopes: DataFrame, limit: int = 5) -> DataFrame:
    """The projects with most issues."""
    return scope_issues(scopes).groupBy("project_id").agg(F.count("*").alias("issues"), F.count_if(F.col("severity") == "error").alias("errors")).orderBy(F.desc("issues"), "project_id").limit(limit)


def project_validation(projects: DataFrame, scopes: DataFrame) -> DataFrame:
    """Issues, validity and confidence of each project; one without scopes has an error of its own."""
    own = scopes.groupBy("project_id").agg(F.count("*").alias("scopes"))
    found = scope_issues(scopes).groupBy("project_id").agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))
    rows = projects.select("project_id").join(own, "project_id", "left").join(found, "project_id", "left").na.fill(0)
    rows = rows.withColumn("errors", F.col("errors") + F.when(F.col("scopes") == 0, 1).otherwise(0))
    score = F.greatest(F.lit(0.0), F.lit(1.0) - F.col("errors") * 0.2 - F.col("warnings") * 0.05)
    return rows.select("project_id", "scopes", "errors", "warnings", (F.col("errors") == 0).alias("valid"), F.round(score, 4).alias("confidence"))


def batch_report(projects: DataFrame, scopes: DataFrame) -> DataFrame:
    return project_validation(projects, scopes).agg(F.count("*").alias("projects"), F.count_if("valid").alias("valid"), F.count_if(F.col("errors") > 0).alias("with_errors"), F.count_if((F.col("errors") == 0) & (F.col("warnings") > 0)).alias("warning_only"), F.sum("scopes").alias("scopes"))


def top_issues(scopes: DataFrame, limit: int = 10) -> DataFrame:
    return scope_issues(scopes).groupBy("field", "issue_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "field", "issue_type").limit(limit)


def field_population(scopes: DataFrame, fields: list[str]) -> DataFrame:
    """Filled and missing counts of fields, a row each, from one aggregate."""
    one = scopes.agg(F.count("*").alias("total"), *[F.count(f).alias(f) for f in fields])
    rows = one.select("total", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("filled")) for f in fields])).alias("x")).select("x.field", "x.filled", "total")
    return rows.select("field", "filled", (F.col("total") - F.col("filled")).alias("missing"), F.round(F.col("filled") * 100.0 / F.col("total"), 1).alias("pct"))

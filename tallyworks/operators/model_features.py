"""Features of the cost, markup and labour models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import classify
from ..functions.parse import to_places
from ..functions.text import labour_text, labour_tier
from .quantiles import medians
from .ranges import kept, small
from .reports import RATE, TYPICAL_MARKUP

# Fixed values.
MARKUP_RATE = 700.0


def _flags(rows: DataFrame) -> dict[str, Column]:
    """Flags of the building: a known project type decides, keywords where it is missing or other."""
    kind = F.lower(F.trim(F.coalesce("project_type", F.lit(""))))
    known = kind.isin([k for k in classify.PROJECT_TYPE_INDEX if k != "other"])
    by_type = {"is_healthcare": "healthcare", "is_education": "education", "is_church": "worship"}
    return {k: F.when(known, kind == by_type[k]).otherwise(v) for k, v in classify.building_flags(F.col("name"), F.col("gc_name")).items()}


def type_index(scopes: DataFrame) -> DataFrame:
    """(scope_type, type_index): the present types numbered by name; a row a type."""
    kinds = scopes.select(F.coalesce("scope_type", F.lit("Other")).alias("scope_type")).distinct()
    return kinds.withColumn("type_index", F.row_number().over(Window.orderBy("scope_type")) - 1)


def training_features(scopes: DataFrame, projects: DataFrame) -> DataFrame:
    """All features and both targets of each scope.

    A missing markup is its type's median (over rows that name a type), else 0.30.  Missing man-days and
    material a square foot are their type's median, then the median of the column as that left it, then
    0; a missing area is the median of all.
    """
    counts = scopes.groupBy("project_id").agg(F.count("*").alias("scope_count"))
    kind = F.lower(F.trim(F.coalesce("project_type", F.lit(""))))
    index = F.lit(0)
    for name, n in classify.PROJECT_TYPE_INDEX.items():
        index = F.when(kind == name, n).otherwise(index)
    # Names are searched once a project, not once a scope, and after a join, which deals projects over all tasks.
    own_projects = projects.select("project_id", "name", "gc_name", "project_type").join(counts, "project_id")
    own_projects = own_projects.select("project_id", "scope_count", *[v.cast("int").alias(k) for k, v in _flags(own_projects).items()], index.alias("project_index"))
    rows = scopes.join(own_projects, "project_id")
    rows = rows.withColumn("raw_type", F.col("scope_type")).withColumn("scope_type", F.coalesce("scope_type", F.lit("Other")))
    area = F.when(F.col("square_footage") > 0, F.col("square_footage"))
    material = F.coalesce(F.nullif("material_cost", F.lit(0.0)), F.nullif("material_price", F.lit(0.0)))
    rows = rows.select(
        "scope_id",
        "scope_type",
        "raw_type",
        F.log1p(area).alias("log_area"),
        (F.col("daily_labor_rate") > 0).alias("rated"),
        F.when(F.col("daily_labor_rate") > 0, F.col("daily_labor_rate") / RATE).otherwise(1.0).alias("rate_ratio"),
        "scope_count",
        classify.product_tier(F.col("product_name")).alias("tier"),
        "is_healthcare",
        "is_education",
        "is_church",
        "project_index",
        "markup_pct",
        to_places(F.nullif("man_days", F.lit(0.0)) / area, 6).alias("days_per_sf"),
        to_places(material / area, 4).alias("material_per_sf"),
        to_places(F.nullif("total", F.lit(0.0)) / area, 4).alias("target_total"),
        F.col("cost_per_unit").alias("target_material"),
    )
    rows = kept(rows, "features")
    # The values are counted in one pass over the rows; all medians come from the counts.
    said = F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("double").alias("v")) for c in ("log_area", "markup_pct", "days_per_sf", "material_per_sf")])
    counted = kept(rows.select("raw_type", F.explode(said).alias("x")).groupBy("raw_type", "x").agg(F.count("*").alias("n")).select("raw_type", F.coalesce("raw_type", F.lit("Other")).alias("scope_type"), "x.*", "n"), "values")
    of = lambda c, v="v": F.when(F.col("c") == c, F.col(v))
    markup = medians(counted.filter("raw_type is not null"), ["raw_type"], {"type_markup": of("markup_pct")}, times="n")
    own = small(kept(medians(counted, ["scope_type"], {"type_days": of("days_per_sf"), "type_material": of("material_per_sf")}, times="n"), "medians"))
    filled_ = counted.join(own, "scope_type", "left")
    every = medians(filled_, [], {"mid_area": of("log_area"), "mid_days": F.coalesce(of("days_per_sf"), of("days_per_sf", "type_days")), "mid_material": F.coalesce(of("material_per_sf"), of("material_per_sf", "type_material"))}, times="n")
    rows = rows.join(small(kept(type_index(scopes), "kinds")), "scope_type").join(own, "scope_type", "left").join(small(kept(markup, "medians")), "raw_type", "left")
    rows = rows.withColumn("days_per_sf", F.coalesce("days_per_sf", "type_days")).withColumn("material_per_sf", F.coalesce("material_per_sf", "type_material"))
    rows = rows.join(F.broadcast(every), F.lit(True), "left")  # one row
    filled = lambda c, mid, places: to_places(F.coalesce(c, mid, F.lit(0.0)), places).alias(c)
    return rows.select(
        "scope_id", "scope_type", "type_index", filled("log_area", "mid_area", 4), F.coalesce(F.col("rated").cast("int"), F.lit(0)).alias("has_rate"), to_places(F.col("rate_ratio"), 4).alias("rate_ratio"), "scope_count", "tier", "is_healthcare", "is_education", "is_church", "project_index",
        to_places(F.coalesce("markup_pct", "type_markup", F.lit(TYPICAL_MARKUP)), 4).alias("markup"), filled("days_per_sf", "mid_days", 6), filled("material_per_sf", "mid_material", 4), "target_total", to_places(F.col("target_material"), 4).alias("target_material"),
    )


def markup_features(scopes: DataFrame, projects: DataFrame) -> DataFrame:
    """The markup model's features; a missing rate counts 0, as the model was specified."""
    counts = scopes.groupBy("project_id").agg(F.count("*").alias("scope_count"))
    rows = scopes.join(projects.select("project_id", "name", "gc_name"), "project_id").join(counts, "project_id")
    flags = classify.markup_flags(F.col("name"), F.col("gc_name"))
    return rows.select(
        "scope_id", "scope_type", F.round(F.log1p(F.coalesce("square_footage", F.lit(0.0))), 4).alias("log_area"), "scope_count", *[v.cast("int").alias(k) for k, v in flags.items()],
        F.round(F.coalesce("daily_labor_rate", F.lit(0.0)) / MARKUP_RATE, 4).alias("rate_ratio"), F.coalesce((F.col("cost_per_unit") > 0).cast("int"), F.lit(0)).alias("has_cost"), "markup_pct",
    )


def labour_features(scopes: DataFrame) -> DataFrame:
    """The labour model's features; a missing or zero rate is the present one."""
    counts = scopes.groupBy("project_id").agg(F.count("*").alias("scope_count"))
    # The text is a column and the tier is worked out before the join: one step with all of it is too long to be compiled.
    own = scopes.withColumn("text_", labour_text(F.col("product_name"), F.col("scope_type")))
    own = own.select("scope_id", "project_id", "scope_type", "square_footage", "daily_labor_rate", "man_days", labour_tier(F.col("product_name"), F.col("scope_type"), F.col("text_")).alias("tier"))
    rows = own.join(counts, "project_id")
    area = F.coalesce("square_footage", F.lit(0.0))
    rate = F.coalesce(F.nullif("daily_labor_rate", F.lit(0.0)), F.lit(RATE))
    return rows.select("scope_id", "scope_type", F.round(F.log1p(area), 4).alias("log_area"), "tier", F.round(rate / RATE, 4).alias("rate_ratio"), "scope_count", (area > 0).cast("int").alias("has_area"), "man_days")

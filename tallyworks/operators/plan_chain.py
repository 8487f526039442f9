"""From the texts and marks of plans to priced estimates, in one job: suggestions, merged, priced, with their confidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import estimates, plan_pages, plan_rooms

#: Order in which suggestions of a plan are merged.
ORDER = ["tag", "colour", "section", "keyword", "ceiling", "room"]


def suggestions(pages: DataFrame, marks: DataFrame, room_marks: DataFrame | None = None) -> DataFrame:
    """(plan_id, seq, scope_type, scope_tag, area_sf, confidence, product_hint, room) of what marks, texts and, with ``room_marks`` (as rooms and ceilings take marks), rooms and ceilings suggest."""
    none = F.lit(None).cast("string")
    rows = plan_pages.suggested(pages, marks).select("plan_id", "scope_type", "tag", "area_sf", none.alias("product"), "confidence", "source", none.alias("room"))
    if room_marks is not None:
        rows = rows.unionByName(plan_rooms.suggested(plan_rooms.rooms(pages, room_marks), plan_rooms.ceilings(pages, room_marks)))
    seq = F.struct(F.array_position(F.array(*map(F.lit, ORDER)), F.col("source")).alias("rank"), F.coalesce("tag", F.lit("")).alias("tag"), "scope_type", "area_sf", "product", "room")
    return rows.select("plan_id", seq.alias("seq"), "scope_type", F.col("tag").alias("scope_tag"), F.col("area_sf").cast("double").alias("area_sf"), "confidence", F.col("product").alias("product_hint"), "room")


def estimated_plans(pages: DataFrame, marks: DataFrame, room_marks: DataFrame | None = None) -> DataFrame:
    """(plan_id, scopes, total, man_days, area_sf, confidence, plan_confidence) of each plan with a scope that can be priced."""
    spark = pages.sparkSession
    # Dealt by plan once, for windows, tags and sums alike, and to a fixed number: small partitions put together again made a task's sorts as large as they may get.
    dealt = suggestions(pages, marks, room_marks).repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), "plan_id")
    scopes = plan_pages.merged(dealt)
    return estimates.project_estimates(scopes).join(plan_pages.plan_confidence(pages, marks).withColumnRenamed("confidence", "plan_confidence"), "plan_id")

"""Queries of as-of, interval and nearest-row joins, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import comparables, schedules
from .registry import add

# --- labour rates by vendor: a step for each day on which a vendor had a first line ---
_STEPS = "SELECT vendor, quote_date AS begins, CAST(max(400 + part_id % 400) AS DOUBLE) AS rate FROM quote_items WHERE line_no = 1 AND part_id % 5 <> 0 GROUP BY 1, 2"
_AT = "CASE WHEN part_id % 23 <> 0 THEN quote_date END"
add(
    "f19_rates_in_force", ["quote_items"],
    lambda q: schedules.rates_in_force(q.selectExpr("quote_id", "line_no", "part_id", "vendor", f"{_AT} AS dated"), q.filter("line_no = 1 and part_id % 5 <> 0").groupBy("vendor", F.col("quote_date").alias("begins")).agg(F.max(400 + F.col("part_id") % 400).alias("rate")), ["vendor"], "dated"),
    f"WITH s AS ({_STEPS}), r AS (SELECT quote_id, line_no, part_id, vendor, {_AT} AS dated, coalesce(vendor, '') AS v FROM quote_items), k AS (SELECT coalesce(vendor, '') AS v, begins, rate FROM s), e AS (SELECT v, min_by(rate, begins) AS f, max_by(rate, begins) AS l FROM k GROUP BY 1)"
    " SELECT quote_id, line_no, part_id, vendor, dated, coalesce(x.rate, CASE WHEN dated IS NULL THEN l ELSE f END, 725.0) AS rate FROM r ASOF LEFT JOIN k AS x ON r.v = x.v AND r.dated >= x.begins LEFT JOIN e ON r.v = e.v",
)

# --- cost bands by type: overlapping, some of them open ---
_BANDS = "SELECT scope_type, 'band ' || (project_id % 40) AS label, CASE WHEN project_id % 40 % 10 <> 0 THEN min(cost_per_unit) END AS low, CASE WHEN project_id % 40 % 10 <> 1 THEN max(cost_per_unit) END AS high FROM scopes WHERE square_footage > 4000 GROUP BY scope_type, project_id % 40"
add(
    "f20_bands", ["scopes"],
    lambda s: schedules.banded(
        s.select(F.col("scope_id").alias("row_id"), "scope_type", "cost_per_unit"),
        s.filter("square_footage > 4000").groupBy("scope_type", (F.col("project_id") % 40).alias("b")).agg(F.min("cost_per_unit").alias("a"), F.max("cost_per_unit").alias("z")).selectExpr("scope_type", "'band ' || b AS label", "CASE WHEN b % 10 <> 0 THEN a END AS low", "CASE WHEN b % 10 <> 1 THEN z END AS high"),
        ["scope_type"], "cost_per_unit", "no band",
    ).groupBy("scope_type", "label").agg(F.count("*").alias("n"), F.round(F.min("cost_per_unit"), 4).alias("least")),
    f"SELECT s.scope_type, coalesce(b.label, 'no band') AS label, count(*) AS n, round(min(cost_per_unit), 4) AS least FROM scopes s LEFT JOIN ({_BANDS}) b ON s.scope_type = b.scope_type AND (b.low IS NULL OR s.cost_per_unit >= b.low) AND (b.high IS NULL OR s.cost_per_unit < b.high) GROUP BY 1, 2",
)

# --- a target for each type and markup, all in one pass ---
_SCORE = "(CASE WHEN s.scope_type = t.kind THEN CAST(0.5 AS DOUBLE) ELSE 0 END + CASE WHEN s.square_footage > 0 AND area > 0 THEN CAST(0.3 AS DOUBLE) / (1 + abs(ln(area / s.square_footage))) ELSE 0 END)"
_ID = "scope_type || ' ' || coalesce(CAST(CAST(round(markup_pct * 100) AS INT) AS STRING), 'none')"
_TARGETS = f"SELECT {_ID} AS target_id, min(scope_type) AS kind, CAST(avg(square_footage) AS DOUBLE) AS area, CASE WHEN min(markup_pct) > 0.1 THEN round(avg(cost_per_unit), 2) END AS cost FROM scopes GROUP BY 1"


def _targets(scopes: DataFrame) -> DataFrame:
    """Types and markups as targets: mean area, and mean cost where the markup is above a tenth."""
    sums = scopes.groupBy(F.expr(_ID).alias("target_id"), F.col("scope_type").alias("kind")).agg(F.avg("square_footage").alias("area"), F.round(F.avg("cost_per_unit"), 2).alias("cost"), F.min("markup_pct").alias("m"))
    return sums.select("target_id", "kind", "area", F.when(F.col("m") > 0.1, F.col("cost")).alias("cost"))


add(
    "w3_markup_comparables", ["scopes"], lambda s: comparables.comparable_projects(_targets(s), s),
    f"SELECT target_id, rank, project_id, score FROM (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY score DESC, project_id) AS rank FROM (SELECT target_id, project_id, round(max(CASE WHEN cost IS NULL OR NOT coalesce(cost_per_unit > 0, false) THEN {_SCORE} / CAST(0.8 AS DOUBLE) ELSE {_SCORE} + CAST(0.2 AS DOUBLE) / (1 + abs(cost - cost_per_unit) / cost_per_unit) END), 6) AS score FROM scopes s, ({_TARGETS}) t WHERE s.square_footage > 0 GROUP BY 1, 2)) WHERE rank <= 3",
)
add(
    "w4_markup_comparables", ["scopes"], lambda s: comparables.comparable_scopes(_targets(s), s),
    f"SELECT target_id, rank, scope_id, score FROM (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY score DESC, scope_id) AS rank FROM (SELECT target_id, scope_id, round({_SCORE} / CAST(0.8 AS DOUBLE), 6) AS score FROM scopes s, ({_TARGETS}) t WHERE s.square_footage IS NOT NULL)) WHERE rank <= 5",
)

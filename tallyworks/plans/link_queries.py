"""Queries of links between names, files and documents, and of summaries, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import comparables, links
from .registry import add

_CLIENT = "CASE WHEN project_id % 12 = 0 THEN name || ' annex' WHEN project_id % 5 = 0 THEN regexp_replace(name, ' [0-9]+$', '') WHEN project_id % 7 = 0 THEN '' ELSE gc_name END"
add("j4_cross_referenced", ["projects"], lambda p: links.cross_referenced(p.selectExpr("project_id AS quote_id", f"{_CLIENT} AS client"), p), f"WITH c AS (SELECT project_id, lower(trim(coalesce({_CLIENT}, ''))) AS client FROM projects), n AS (SELECT DISTINCT lower(trim(name)) AS name FROM projects), hit AS (SELECT client FROM (SELECT DISTINCT client FROM c) d WHERE EXISTS (SELECT 1 FROM n WHERE contains(n.name, d.client) OR contains(d.client, n.name))) SELECT project_id AS quote_id FROM c WHERE client IN (SELECT client FROM hit)")
_TERM = "split(product, ' ')[1]"
add(
    "j5_known_products", ["scopes", "quote_items"], lambda s, q: links.known_products(s, q.selectExpr(f"CASE WHEN length(product) % 3 = 0 THEN {_TERM} ELSE product || ' of ' || unit END AS term")),
    "SELECT product_name, EXISTS (SELECT 1 FROM (SELECT DISTINCT lower(CASE WHEN length(product) % 3 = 0 THEN split_part(product, ' ', 2) ELSE product || ' of ' || unit END) AS term FROM quote_items) t WHERE term <> '' AND (contains(lower(product_name), term) OR contains(term, lower(product_name)))) AS known FROM (SELECT DISTINCT product_name FROM scopes)",
)
_HINTS = "CASE WHEN status = 'draft' THEN 'Hospital; palm' WHEN status = 'reviewed' THEN 'church;CHURCH;arena' WHEN status = 'exported' THEN 'zoo' ELSE '7;; office ' END"
add(
    "j6_hinted_projects", ["estimates", "projects"], lambda e, p: links.hinted_projects(e.selectExpr("estimate_id AS target_id", f"{_HINTS} AS hints"), p),
    "WITH h AS (SELECT DISTINCT status, trim(lower(x)) AS hint FROM (SELECT status, unnest(string_split(" + _HINTS + ", ';')) AS x FROM (SELECT DISTINCT status FROM estimates)) WHERE trim(x) <> ''), r AS (SELECT status, project_id, row_number() OVER (PARTITION BY status ORDER BY project_id) AS rank FROM (SELECT DISTINCT h.status, project_id FROM h JOIN projects p ON contains(lower(p.name), h.hint))) SELECT estimate_id AS target_id, project_id, rank FROM estimates e JOIN r ON e.status IS NOT DISTINCT FROM r.status WHERE rank <= 5",
)
_FILES = "CASE WHEN line_no % 4 = 0 THEN 'json' WHEN line_no % 4 = 1 THEN 'pdf' WHEN line_no % 4 = 2 THEN 'name' ELSE 'sheet' END"
_ORDER = ["json", "pdf", "name", "sheet"]
add(
    "j9_dates_by_priority", ["projects", "quote_items"], lambda p, q: links.dates_by_priority(p, q.selectExpr("project_id", f"{_FILES} AS kind", "quote_date AS dated"), _ORDER),
    "SELECT project_id, coalesce(own, " + ", ".join(_ORDER) + ") AS dated, CASE WHEN own IS NOT NULL THEN 'own' " + " ".join(f"WHEN {k} IS NOT NULL THEN '{k}'" for k in _ORDER) + " ELSE 'none' END AS source FROM (SELECT project_id, nullif(quote_date, DATE '2024-02-29') AS own FROM projects) LEFT JOIN (SELECT project_id, "
    + ", ".join(f"min(quote_date) FILTER ({_FILES} = '{k}') AS {k}" for k in _ORDER) + " FROM quote_items GROUP BY 1) USING (project_id)",
)
_EXPECT = "SELECT project_id, min(scope_type) AS kind, max(product_name) AS product, max(square_footage) AS area, CAST(0.3 AS DOUBLE) AS markup FROM scopes GROUP BY project_id"
add(
    "j10_audit", ["scopes"], lambda s: links.audited(s.groupBy("project_id").agg(F.min("scope_type").alias("kind"), F.max("product_name").alias("product"), F.max("square_footage").alias("area"), F.lit(0.3).alias("markup")), s),
    f"SELECT project_id, scope_id, coalesce(abs(square_footage - area) <= area * CAST(0.01 AS DOUBLE), false) AS area_ok, coalesce(round(abs(markup_pct - markup), 6) <= 0.02, false) AS markup_ok FROM (SELECT e.project_id, scope_id, square_footage, area, markup_pct, markup, row_number() OVER (PARTITION BY e.project_id ORDER BY contains(lower(product_name), lower(product)) DESC NULLS LAST, scope_id) AS r FROM ({_EXPECT}) e JOIN scopes s ON e.project_id = s.project_id AND e.kind = s.scope_type) WHERE r = 1",
)
_IDS = ["estimate_id", "estimate_id + 1", "estimate_id", "estimate_id + 4", "estimate_id * 2", "estimate_id + 9", "estimate_id + 12"]
add(
    "j11_comparables_described", ["estimates", "projects", "scopes"], lambda e, p, s: links.comparables_described(e.selectExpr("estimate_id", f"array({', '.join(_IDS)}) AS ids"), p, s),
    "WITH i AS (SELECT estimate_id, id, min(k) AS k FROM (SELECT estimate_id, unnest([" + ", ".join(_IDS) + f"]) AS id, unnest(range({len(_IDS)})) AS k FROM estimates) GROUP BY 1, 2), j AS (SELECT *, row_number() OVER (PARTITION BY estimate_id ORDER BY k) AS position FROM i) SELECT estimate_id, position, p.project_id, p.name, year(p.quote_date) AS year, scope_type FROM j JOIN projects p ON j.id = p.project_id LEFT JOIN (SELECT project_id, min_by(scope_type, scope_id) AS scope_type FROM scopes GROUP BY 1) s ON s.project_id = p.project_id WHERE position <= 5",
)
add("a9_quote_coverage", ["quote_items"], links.quote_coverage, "SELECT vendor, count(*) AS quotes, CAST(round(sum(v), 2) AS DOUBLE) AS value FROM (SELECT vendor, quote_id, sum(CAST(item_total AS DECIMAL(20,8))) AS v FROM quote_items GROUP BY 1, 2) GROUP BY 1")
_ITEMS = "SELECT project_id AS estimate_id, trim(unit) AS item_type, item_total AS amount FROM quote_items"
add("a19_additional_totals", ["quote_items"], lambda q: links.additional_totals(q.selectExpr("project_id AS estimate_id", "trim(unit) AS item_type", "item_total AS amount")), f"SELECT estimate_id, item_type, GROUPING(item_type) AS g, CAST(round(sum(CAST(amount AS DECIMAL(20,8))), 2) AS DOUBLE) AS amount FROM ({_ITEMS}) GROUP BY GROUPING SETS ((estimate_id), (estimate_id, item_type))")
add(
    "a23_load_outcomes", ["quote_items", "estimates", "projects"],
    lambda q, e, p: links.load_outcomes(q.selectExpr("quote_id AS key", "project_id", "unit_cost_text <> 'call' AS good"), e.filter("status = 'draft'").selectExpr("estimate_id * 1000 + 1 AS key"), p.filter("status <> 'quoted'")),
    "SELECT CASE WHEN unit_cost_text = 'call' THEN 'failed' WHEN quote_id IN (SELECT estimate_id * 1000 + 1 FROM estimates WHERE status = 'draft') THEN 'skipped' WHEN project_id NOT IN (SELECT project_id FROM projects WHERE status <> 'quoted') THEN 'no project' ELSE 'loaded' END AS outcome, count(*) AS n FROM quote_items GROUP BY 1",
)
add("s11_vendors_upserted", ["quote_items"], lambda q: links.vendors_upserted(q.filter("vendor is not null and line_no = 7 and quantity > 48").groupBy(F.col("vendor").alias("name")).agg(F.lit("old").alias("vendor_id")), q), "SELECT name, CASE WHEN old THEN 'old' ELSE sha256(name)[1:16] END AS vendor_id, NOT old AS added FROM (SELECT vendor AS name, bool_or(line_no = 7 AND quantity > 48) AS old FROM quote_items WHERE vendor IS NOT NULL GROUP BY 1)")
_SIM = "(CASE WHEN s.scope_type = t.kind THEN CAST(0.5 AS DOUBLE) ELSE 0 END + CASE WHEN square_footage > 0 THEN CAST(0.3 AS DOUBLE) / (1 + abs(ln(area / square_footage))) ELSE 0 END) / CAST(0.8 AS DOUBLE)"
add(
    "w4_comparable_scopes", ["scopes"], lambda s: comparables.comparable_scopes(s.groupBy(F.col("scope_type").alias("kind")).agg(F.percentile("square_footage", 0.5).alias("area")).withColumn("target_id", F.col("kind")), s),
    f"SELECT target_id, rank, scope_id, score FROM (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY score DESC, scope_id) AS rank FROM (SELECT kind AS target_id, scope_id, round({_SIM}, 6) AS score FROM scopes s, (SELECT scope_type AS kind, quantile_cont(square_footage, 0.5) AS area FROM scopes GROUP BY 1) t WHERE square_footage IS NOT NULL)) WHERE rank <= 5",
)
_PLAN = ["project_id AS plan_id", "scope_id", "scope_type", "square_footage AS area_sf", "man_days / CAST(13.7 AS DOUBLE) AS confidence"]
_OF = "CASE upper(scope_type) WHEN 'ACT' THEN CAST(0.87 AS DOUBLE) WHEN 'AWP' THEN 0.82 WHEN 'FW' THEN 0.79 ELSE 0.73 END"
_SUMS = f"(SELECT project_id AS plan_id, CAST(0.6 AS DOUBLE) * max(c) + CAST(0.4 AS DOUBLE) * sum({_OF} * coalesce(square_footage, 1)) / sum(coalesce(square_footage, 1)) AS score, max(c) AS plan, count(*) FILTER (c < 0.5) AS low, count(*) FILTER (upper(scope_type) NOT IN ('ACT', 'AWP', 'FW')) AS general, count(square_footage) AS sized FROM (SELECT *, man_days / CAST(13.7 AS DOUBLE) AS c FROM scopes) GROUP BY 1)"
add("z5_plan_reports", ["scopes"], lambda s: links.plan_reports(s.selectExpr(*_PLAN)), f"SELECT plan_id, round(score, 4) AS score, CASE WHEN score >= 0.75 THEN 'high' WHEN score >= 0.5 THEN 'medium' ELSE 'low' END AS level, concat_ws('; ', CASE WHEN plan < 0.6 THEN 'text only' END, CASE WHEN plan = 1 THEN 'marked areas' END, CASE WHEN low > 0 THEN 'low confidence' END, CASE WHEN general > 0 THEN 'general model' END, CASE WHEN sized = 0 THEN 'no area' END) AS flags, CASE WHEN score >= 0.75 THEN 'ready' WHEN score >= 0.5 THEN 'review scopes' ELSE 'mark areas' END AS advice FROM {_SUMS}")

"""Queries of loads, edits and reports of batches, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import classify, parse, text
from ..operators import links, loads
from .registry import add

# --- scalar functions on inputs that meet every branch ---
add("f2_backfill_dates", ["raw_fields"], lambda r: r.select("row_id", text.backfill_date(F.col("date_text")).alias("dated")), "SELECT row_id, nullif(CAST(CASE row_id % 7 WHEN 0 THEN try_strptime(date_text, '%Y-%m-%d') WHEN 2 THEN try_strptime(date_text, '%m/%d/%y') WHEN 1 THEN try_strptime(date_text, '%m/%d/%Y') WHEN 6 THEN try_strptime(date_text, '%m/%d/%Y') END AS DATE), DATE '2024-02-29') AS dated FROM raw_fields")
_DATED = "CASE WHEN project_id % 3 = 0 THEN 'x ' || month(created_on) || '.' || day(created_on) || '.2' || (project_id % 10) || ' b.xlsx' WHEN project_id % 3 = 1 THEN 'bid (' || month(created_on) || '.31.25).pdf' ELSE 'v1.2.3.4.24 none' END"
add("f7_name_dates", ["projects"], lambda p: p.selectExpr("project_id", f"{_DATED} AS n").select("project_id", parse.name_date(F.col("n")).alias("dated")), "SELECT project_id, CASE WHEN project_id % 3 = 0 AND project_id % 10 <= 7 THEN CAST(try_strptime('202' || (project_id % 10) || '-' || month(created_on) || '-' || day(created_on), '%Y-%m-%d') AS DATE) WHEN project_id % 3 = 1 THEN CAST(try_strptime('2025-' || month(created_on) || '-31', '%Y-%m-%d') AS DATE) END AS dated FROM projects")
_NAMED = "CASE project_id % 6 WHEN 0 THEN 'Curved WOOD panel' WHEN 1 THEN 'Fine Fissured tile' WHEN 2 THEN 'Tegular 2x2' WHEN 3 THEN 'Economy board' WHEN 4 THEN NULL ELSE 'Budget dune' END"
add("f10_named_tiers", ["projects"], lambda p: p.selectExpr("project_id", f"{_NAMED} AS n").select("project_id", classify.product_tier(F.col("n")).alias("tier")), "SELECT project_id, CASE project_id % 6 WHEN 0 THEN 3 WHEN 1 THEN 2 WHEN 2 THEN 1 WHEN 3 THEN 0 WHEN 4 THEN 1 ELSE 2 END AS tier FROM projects")
_PATH = "CASE project_id % 9 WHEN 0 THEN '/j/Job/build up.xlsx' WHEN 1 THEN '/j/Job/~$build up.xlsx' WHEN 2 THEN '/j/Job/Quote 0' || project_id || '.pdf' WHEN 3 THEN '/j/Job/Armstrong order.pdf' WHEN 4 THEN '/j/Job/RCP level 2.pdf' WHEN 5 THEN '/j/Archive/build up.xlsx' WHEN 6 THEN '/j/Job/vendor quote.xlsx' WHEN 7 THEN '/j/Job/signed floor plan.pdf' ELSE '/j/Job/notes.txt' END"
add("s8_every_path_kind", ["projects"], lambda p: p.selectExpr("project_id", f"{_PATH} AS path").select("project_id", text.path_kind(F.col("path")).alias("kind")), "SELECT project_id, CASE project_id % 9 WHEN 0 THEN 'build_up' WHEN 2 THEN 'own_quote' WHEN 3 THEN 'vendor_quote' WHEN 4 THEN 'drawing' END AS kind FROM projects")

# --- loads ---
_CHILD = ["scope_id", "project_id", "scope_type"]
add("s9_children_replaced", ["scopes", "projects"], lambda s, p: loads.children_replaced(s.select(*_CHILD), s.filter("project_id % 4 = 0 and markup_pct < 0.3").withColumn("scope_type", F.lit("reloaded")), p.filter("project_id % 4 = 0"), "project_id"), "SELECT scope_id, project_id, CASE WHEN project_id % 4 = 0 THEN 'reloaded' ELSE scope_type END AS scope_type FROM scopes WHERE project_id % 4 <> 0 OR markup_pct < 0.3")
_FOLDER = "CASE WHEN project_id % 5 = 0 THEN 'no such job' ELSE upper('job ' || project_id) END"
add(
    "s11_quotes_linked", ["quote_items", "projects"],
    lambda q, p: loads.quotes_linked(q.selectExpr("quote_id", "vendor", f"{_FOLDER} AS folder").distinct(), q.filter("vendor is not null and part_id % 2 = 0").select(F.col("vendor").alias("name"), F.sha2("vendor", 256).alias("vendor_id")).distinct(), p.selectExpr("project_id", "'Job ' || project_id AS folder")),
    f"SELECT quote_id, v.vendor_id, p.project_id FROM (SELECT DISTINCT quote_id, vendor, {_FOLDER} AS folder FROM quote_items) q LEFT JOIN (SELECT DISTINCT vendor, sha256(vendor) AS vendor_id FROM quote_items WHERE vendor IS NOT NULL AND part_id % 2 = 0) v ON q.vendor = v.vendor LEFT JOIN projects p ON q.folder = 'JOB ' || p.project_id",
)
_WHO = "CASE project_id % 4 WHEN 0 THEN 'Quote ' || project_id || '-R1 - ' || name || '.pdf' ELSE 'scan.pdf' END"
_SAYS = "CASE project_id % 4 WHEN 1 THEN 'Prepared for:' || chr(10) || '  ' || name || chr(10) ELSE '' END || CASE project_id % 3 WHEN 0 THEN 'Project Address: 12 Main St' || chr(10) || 'Tampa, FL' || chr(10) WHEN 1 THEN 'Job Address - 7 Oak Rd' ELSE 'none' END || chr(10) || CASE project_id % 5 WHEN 0 THEN 'GC: ' || coalesce(gc_name, '?') || chr(10) || 'Attn: Kim ' WHEN 1 THEN 'General Contractor - Acme ' ELSE '' END"
add(
    "x1_quote_parties", ["projects"], lambda p: loads.parties(p.selectExpr("project_id AS doc_id", f"{_WHO} AS file_name", f"{_SAYS} AS text")),
    "SELECT project_id AS doc_id, CASE WHEN project_id % 4 < 2 THEN name END AS client, CASE project_id % 3 WHEN 0 THEN '12 Main St | Tampa, FL' WHEN 1 THEN CASE WHEN project_id % 5 = 0 THEN '7 Oak Rd | GC: ' || coalesce(gc_name, '?') WHEN project_id % 5 = 1 THEN '7 Oak Rd | General Contractor - Acme' ELSE '7 Oak Rd' END END AS address, CASE project_id % 5 WHEN 0 THEN coalesce(gc_name, '?') WHEN 1 THEN 'Acme' END AS contractor, CASE WHEN project_id % 5 = 0 THEN 'Kim' END AS contact FROM projects",
)

# --- edits and prices ---
_D = lambda x: f"CAST(round(CAST({x} AS DECIMAL(20,8)), 2) AS DOUBLE)"
_PATCH = lambda s: s.filter("project_id % 5 = 0").select("scope_id", F.when(F.col("square_footage").isNull(), 500.0).alias("new_area"), F.lit(0.25).alias("new_markup"), F.when(F.col("man_days") > 5, 3.0).alias("new_days"), F.when(F.col("markup_pct") > 0.2, 7.5).alias("new_cost"))
_ON = "project_id % 5 = 0"
_A = f"(CASE WHEN {_ON} AND square_footage IS NULL THEN 500 ELSE square_footage END)"
_L = f"(CASE WHEN {_ON} AND man_days > 5 THEN 3 * coalesce(nullif(daily_labor_rate, 0), 725) ELSE labor_price END)"
_M = f"(CASE WHEN {_ON} AND markup_pct > 0.2 THEN {_A} * 7.5 ELSE material_cost END)"
add("z7_bulk_edited", ["scopes"], lambda s: loads.bulk_edited(s, _PATCH(s), s.filter("project_id % 7 = 0 and markup_pct is null")), f"SELECT scope_id, project_id, {_A} AS square_footage, {_D(_L)} AS labor_price, {_D(_M)} AS material_cost, {_D(f'{_M} * (1 + CASE WHEN {_ON} THEN CAST(0.25 AS DOUBLE) ELSE coalesce(markup_pct, 0) END) + coalesce({_L}, 0)')} AS total FROM scopes WHERE NOT (project_id % 7 = 0 AND markup_pct IS NULL)")
add("z9_labour_price", ["scopes"], lambda s: loads.labour_by_formula(s, F.when(F.col("daily_labor_rate") > 700, 10.0).otherwise(8.0), F.when(F.col("daily_labor_rate") > 700, 50.0).otherwise(45.0), F.lit(1.45)), f"SELECT scope_id, CASE WHEN daily_labor_rate > 700 THEN 725.0 ELSE 522.0 END AS day_rate, {_D('man_days * CASE WHEN daily_labor_rate > 700 THEN 725 ELSE 522 END')} AS labour FROM scopes")
add("w2_vendor_history", ["quote_items"], lambda q: loads.vendor_history(q, "blue", "supplier"), "SELECT product, vendor, quote_date, CAST(TRY_CAST(replace(unit_cost_text, '$', '') AS DECIMAL(18,4)) AS DOUBLE) AS unit_cost, quote_id, line_no FROM quote_items WHERE contains(lower(product), 'blue') AND contains(lower(vendor), 'supplier')")
add("w6_numbers_continued", ["estimates"], lambda e: loads.numbers_continued(e.filter("status is not null").select(F.col("estimate_id").alias("quote_id"), "created_on"), e.filter("status is null").groupBy(F.year("created_on").alias("year")).agg(F.count("*").alias("n"))), "SELECT estimate_id AS quote_id, printf('CA-%d-%04d', year(created_on), coalesce(n, 0) + row_number() OVER (PARTITION BY year(created_on) ORDER BY created_on, estimate_id)) AS quote_number FROM estimates LEFT JOIN (SELECT year(created_on) AS y, count(*) AS n FROM estimates WHERE status IS NULL GROUP BY 1) ON y = year(created_on) WHERE status IS NOT NULL")
_PLAN = lambda s: s.select(F.col("project_id").alias("plan_id"), F.col("square_footage").alias("area_sf"), (F.col("man_days") / 13.7).alias("confidence"))
_SURE = "coalesce(man_days / CAST(13.7 AS DOUBLE) >= 0.3, false)"
add(
    "z3_plan_notes", ["scopes", "estimates"], lambda s, e: loads.plan_notes(_PLAN(s), e.filter("estimate_id % 2 = 0").select(F.col("estimate_id").alias("plan_id"), F.col("total_estimate").alias("area_sf"))),
    f"SELECT project_id AS plan_id, n AS scopes, u AS unsized, w AS unsure, coalesce(own, CASE WHEN project_id % 2 = 0 THEN round(total_estimate, 2) END) AS area_sf, concat_ws('; ', CASE WHEN u > 0 THEN u || ' without area' END, CASE WHEN w > 0 THEN w || ' too unsure' END, CASE WHEN own IS NULL AND project_id % 2 = 0 AND total_estimate IS NOT NULL THEN 'area of the plan' END) AS note FROM (SELECT project_id, count(*) AS n, count(*) FILTER (NOT coalesce(square_footage > 0, false)) AS u, count(*) FILTER (NOT {_SURE}) AS w, CAST(round(sum(CAST(square_footage AS DECIMAL(20,8))) FILTER (square_footage > 0 AND {_SURE}), 2) AS DOUBLE) AS own FROM scopes GROUP BY 1) LEFT JOIN estimates ON estimate_id = project_id",
)
_RESULTS = lambda q: q.select("vendor", F.when(F.col("part_id") % 4 == 0, "vision").otherwise("text").alias("method"), (F.col("part_id") % 23 != 0).alias("good"), F.col("part_id").alias("tokens"))
add("x16_batch_costs", ["quote_items"], lambda q: loads.batch_costs(_RESULTS(q), 0.000003, 0.000015), "SELECT *, round(good * 100.0 / results, 1) AS success_pct FROM (SELECT coalesce(vendor, 'unknown') AS vendor, CASE WHEN part_id % 4 = 0 THEN 'vision' ELSE 'text' END AS method, count(*) AS results, count(*) FILTER (part_id % 23 <> 0) AS good, CAST(sum(part_id) AS BIGINT) AS tokens, CAST(round(CAST(floor(sum(part_id) * CAST(0.8 AS DOUBLE)) * CAST(0.000003 AS DOUBLE) + (sum(part_id) - floor(sum(part_id) * CAST(0.8 AS DOUBLE))) * CAST(0.000015 AS DOUBLE) AS DECIMAL(20,8)), 6) AS DOUBLE) AS cost FROM quote_items GROUP BY 1, 2)")

_FORMATS = "CASE WHEN project_id % 3 = 0 THEN 'B' ELSE 'A' END AS format"
add(
    "j10_audited_in_full", ["scopes", "projects"], lambda s, p: links.audited_in_full(s.selectExpr("scope_id AS expected_id", "project_id", "scope_type AS kind", "CASE WHEN man_days > 5 THEN substr(product_name, 1, 4) END AS product", "CASE WHEN man_days > 3 THEN square_footage * CAST(1.008 AS DOUBLE) END AS area", "CASE WHEN markup_pct > 0.1 THEN markup_pct + CAST(0.01 AS DOUBLE) END AS markup", "CASE WHEN man_days > 8 THEN 'B' END AS format"), s, p.selectExpr("project_id", _FORMATS)),
    "SELECT expected_id, scope_id, product_ok, area_ok, markup_ok, format_ok, coalesce(product_ok, true) AND coalesce(area_ok, true) AND coalesce(markup_ok, true) AND coalesce(format_ok, true) AS passed FROM (SELECT expected_id, scope_id, CASE WHEN product IS NOT NULL THEN coalesce(prefers, false) END AS product_ok, CASE WHEN area IS NOT NULL THEN coalesce(abs(square_footage - area) <= area * CAST(0.01 AS DOUBLE), false) END AS area_ok, CASE WHEN markup IS NOT NULL THEN coalesce(round(abs(markup_pct - markup), 6) <= 0.02, false) END AS markup_ok, CASE WHEN wanted IS NOT NULL THEN coalesce((project_id % 3 = 0) = (wanted = 'B'), false) END AS format_ok FROM (SELECT *, row_number() OVER (PARTITION BY expected_id ORDER BY prefers DESC NULLS LAST, scope_id) AS r FROM (SELECT e.scope_id AS expected_id, e.project_id, e.product, e.area, e.markup, e.wanted, s.scope_id, s.square_footage, s.markup_pct, contains(lower(s.product_name), lower(e.product)) AS prefers FROM (SELECT scope_id, project_id, scope_type, CASE WHEN man_days > 5 THEN substr(product_name, 1, 4) END AS product, CASE WHEN man_days > 3 THEN square_footage * CAST(1.008 AS DOUBLE) END AS area, CASE WHEN markup_pct > 0.1 THEN markup_pct + CAST(0.01 AS DOUBLE) END AS markup, CASE WHEN man_days > 8 THEN 'B' END AS wanted FROM scopes) e JOIN scopes s ON s.project_id = e.project_id AND s.scope_type = e.scope_type)) WHERE r = 1)",
)

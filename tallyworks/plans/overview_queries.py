"""Queries of overviews, validation texts and models' features, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import classify, rates, text
from ..functions.parse import to_places
from ..operators import checks, estimates, model_features, models, overview, prices, quotes, reports
from ..operators.ranges import kept
from .document_queries import _TEMPLATE, _TOTAL, _group
from .registry import add

_M = lambda x: f"('$' || format('{{:,.2f}}', CAST(round(CAST({x} AS DECIMAL(20,8)), 2) AS DOUBLE)))"
_OFF = lambda a, b: f"abs({a} - {b}) / greatest(abs({a}), abs({b}), 1)"
_PARTS = "(coalesce(material_price, 0) + coalesce(labor_price, 0) + coalesce(sales_tax, 0))"
_SHARE = "(format('{:.1f}', CAST(round(CAST(markup_pct * 100 AS DECIMAL(20,8)), 1) AS DOUBLE)) || '%')"
_RANGE = "CASE scope_type " + " ".join(f"WHEN '{k}' THEN '${a:.2f} to ${b:.2f}'" for k, (a, b) in checks.COST_RANGES.items()) + " END"
_COSTLY = "cost_per_unit > 0 AND (" + " OR ".join(f"scope_type = '{k}' AND (cost_per_unit < {a} OR cost_per_unit > {b})" for k, (a, b) in checks.COST_RANGES.items()) + ")"
_TEXTS = [
    ("square_footage", "error", "scope_type IN ('ACT','AWP','FW','WW','RPG') AND cost_per_unit IS NOT NULL AND coalesce(square_footage, 0) <= 0", "'> 0'", f"coalesce({_M('square_footage')}, 'none')"),
    ("markup_pct", "error", "markup_pct < 0.10 OR markup_pct > 1.00", "'10% to 100%'", _SHARE),
    ("markup_pct", "warning", "markup_pct BETWEEN 0.10 AND 1.00 AND (markup_pct < 0.15 OR markup_pct > 0.75)", "'15% to 75%'", _SHARE),
    ("cost_per_sf", "warning", _COSTLY, _RANGE, _M("cost_per_unit")),
    ("total", "error", "total <= 0", "'> 0'", _M("total")),
    ("sales_tax", "error", "sales_tax < 0", "'>= 0'", _M("sales_tax")),
    ("total", "warning", f"total <> 0 AND {_OFF(_PARTS, 'total')} > 0.02", _M(_PARTS), _M("total")),
    ("material_price", "warning", f"material_price <> 0 AND {_OFF('(material_cost * (1 + markup_pct))', 'material_price')} > 0.01", _M("material_cost * (1 + markup_pct)"), _M("material_price")),
    ("material_cost", "warning", f"material_cost <> 0 AND {_OFF('(square_footage * cost_per_unit)', 'material_cost')} > 0.01", _M("square_footage * cost_per_unit"), _M("material_cost")),
    ("man_days", "warning", "labor_price > 0 AND man_days IS NULL", "'> 0'", f"coalesce({_M('man_days')}, 'none')"),
]
add(
    "q1_issue_texts", ["scopes"], lambda s: checks.scope_issues(s, texts=True).select("scope_id", "field", "severity", "expected", "actual", "message"),
    "SELECT scope_id, field, severity, expected, actual, field || ': expected ' || expected || ', found ' || actual AS message FROM (" + " UNION ALL ".join(f"SELECT scope_id, '{f}' AS field, '{s}' AS severity, {e} AS expected, {a} AS actual FROM scopes WHERE {w}" for f, s, w, e, a in _TEXTS) + ")",
)
_OWN = lambda e: e.select(F.col("estimate_id").alias("project_id"), F.col("total_estimate").alias("grand_total"))
_P_ISSUES = "(SELECT project_id, 'grand_total' AS field, 'math_mismatch' AS issue_type, 'warning' AS severity FROM (SELECT project_id, sum(total) AS t FROM scopes GROUP BY 1) JOIN estimates e ON e.estimate_id = project_id WHERE total_estimate <> 0 AND " + _OFF("t", "total_estimate") + " > 0.02 UNION ALL SELECT estimate_id, 'scopes', 'missing_required', 'error' FROM estimates WHERE estimate_id NOT IN (SELECT project_id FROM scopes))"
add("q2_project_issues", ["estimates", "scopes"], lambda e, s: checks.project_issues(_OWN(e), s), f"SELECT * FROM {_P_ISSUES}")
_TYPES = {"square_footage": "missing_required", "cost_per_sf": "suspicious", "man_days": "missing_required", "material_price": "math_mismatch", "material_cost": "math_mismatch", "sales_tax": "out_of_range", "markup_pct": "out_of_range"}
_ALL = "(" + " UNION ALL ".join(f"SELECT project_id, scope_id, '{f}' AS field, '{_TYPES.get(f) or ('out_of_range' if s == 'error' else 'math_mismatch')}' AS issue_type, '{s}' AS severity FROM scopes WHERE {w}" for f, s, w, _, _ in _TEXTS) + ")"
_COUNTS = f"(SELECT e.estimate_id AS project_id, coalesce(n, 0) AS scopes, coalesce(n, 0) - coalesce(bad, 0) AS valid_scopes, coalesce(errors, 0) AS errors, coalesce(warnings, 0) AS warnings FROM estimates e LEFT JOIN (SELECT project_id, count(*) AS n FROM scopes GROUP BY 1) a ON e.estimate_id = a.project_id LEFT JOIN (SELECT project_id, count(DISTINCT scope_id) AS bad FROM {_ALL} WHERE severity = 'error' GROUP BY 1) b ON e.estimate_id = b.project_id LEFT JOIN (SELECT project_id, count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings FROM (SELECT project_id, severity FROM {_ALL} UNION ALL SELECT project_id, severity FROM {_P_ISSUES}) GROUP BY 1) c ON e.estimate_id = c.project_id)"
_CONF = "greatest(0, 1 - errors * CAST(0.2 AS DOUBLE) - warnings * CAST(0.05 AS DOUBLE))"
_PCT = f"(format('{{:.0f}}', CAST(round(CAST({_CONF} AS DECIMAL(10,6)) * 100, 0) AS DOUBLE)) || '%')"
add(
    "q2_project_reports", ["estimates", "scopes"], lambda e, s: checks.project_reports(_OWN(e), s),
    f"SELECT project_id, scopes, valid_scopes, errors, warnings, round({_CONF}, 4) AS confidence, CASE WHEN errors = 0 THEN 'valid, ' || scopes || ' scopes, confidence ' || {_PCT} ELSE valid_scopes || '/' || scopes || ' scopes valid, ' || errors || ' errors, ' || warnings || ' warnings, confidence ' || {_PCT} END AS summary FROM {_COUNTS}",
)
add("q3_common_issues", ["estimates", "scopes"], lambda e, s: checks.common_issues(_OWN(e), s), f"SELECT field, issue_type, severity, count(*) AS n FROM (SELECT field, issue_type, severity FROM {_ALL} UNION ALL SELECT field, issue_type, severity FROM {_P_ISSUES}) GROUP BY 1, 2, 3 ORDER BY n DESC, field, issue_type, severity LIMIT 10")
add("a8_markup_outliers", ["scopes"], lambda s: checks.markup_outliers(s, 0.45), "SELECT scope_id, project_id, scope_type, markup_pct FROM scopes WHERE markup_pct > 0.45 ORDER BY markup_pct DESC, scope_id LIMIT 5")
add("a8_worst_projects", ["scopes"], checks.worst_projects, f"SELECT project_id, count(*) AS issues, count(*) FILTER (severity = 'error') AS errors FROM {_ALL} GROUP BY 1 ORDER BY issues DESC, project_id LIMIT 5")

# --- classification ---
_KIND = "CASE WHEN part_id % 5 = 0 THEN ' P&P Bond' WHEN part_id % 5 = 1 THEN 'punch' WHEN part_id % 5 = 2 THEN 'Setup/Unload ' WHEN part_id % 5 = 3 THEN 'flights' ELSE product END"
add("f5_cost_type", ["quote_items"], lambda q: q.selectExpr(f"{_KIND} AS raw").select(classify.cost_type(F.col("raw")).alias("cost_type")).groupBy("cost_type").agg(F.count("*").alias("n")), "SELECT CASE part_id % 5 WHEN 0 THEN 'bond' WHEN 1 THEN 'punch_list' WHEN 2 THEN 'setup_unload' WHEN 3 THEN 'travel_flights' ELSE 'other' END AS cost_type, count(*) AS n FROM quote_items GROUP BY 1")
_HAS = lambda words: "(" + " OR ".join(f"contains(lower(concat_ws(' ', coalesce(name, ''), coalesce(gc_name, ''))), '{w}')" for w in words) + ")"
add("f12_markup_flags", ["projects"], lambda p: p.select("project_id", *[v.cast("int").alias(k) for k, v in classify.markup_flags(F.col("name"), F.col("gc_name")).items()]), f"SELECT project_id, CAST({_HAS(classify.MARKUP_HEALTHCARE)} AS INT) AS is_healthcare, CAST({_HAS(classify.MARKUP_EDUCATION)} AS INT) AS is_education, CAST({_HAS(classify.MARKUP_CHURCH)} AS INT) AS is_church FROM projects")
add("f15_confidence_badges", ["suggestions"], lambda s: s.select((F.col("confidence") * F.col("area_sf") / 500).alias("c")).filter("c is not null").groupBy(classify.confidence_level(F.col("c")).alias("level"), classify.confidence_badge(F.col("c")).alias("badge")).agg(F.count("*").alias("n")), "SELECT CASE WHEN c >= 0.75 THEN 'high' WHEN c >= 0.5 THEN 'medium' ELSE 'low' END AS level, CASE WHEN c >= 0.8 THEN 'high' WHEN c >= 0.5 THEN 'medium' ELSE 'low' END || ' (' || format('{:.0f}', CAST(round_even(CAST(c AS DECIMAL(12,8)) * 100, 0) AS DOUBLE)) || '%)' AS badge, count(*) AS n FROM (SELECT confidence * area_sf / 500 AS c FROM suggestions) WHERE c IS NOT NULL GROUP BY 1, 2")

# --- overviews ---
add(
    "a7_overview", ["projects", "scopes", "quote_items", "estimates"], lambda p, s, q, e: overview.dataset_overview({"projects": p, "scopes": s, "quote_items": q, "estimates": e}, p, s, F.contains("product_name", F.lit("a"))),
    " UNION ALL ".join(f"SELECT 'rows of {t}' AS measure, CAST(count(*) AS VARCHAR) AS value FROM {t}" for t in ("projects", "scopes", "quote_items", "estimates")) + " UNION ALL SELECT 'first quote', CAST(min(quote_date) AS VARCHAR) FROM projects UNION ALL SELECT 'last quote', CAST(max(quote_date) AS VARCHAR) FROM projects UNION ALL SELECT 'percent linked', CAST(round(count(*) FILTER (contains(product_name, 'a')) * 100.0 / count(*), 1) AS VARCHAR) FROM scopes",
)
add("a9_template_counts", ["quote_texts"], lambda t: overview.template_counts(quotes.headers(t), quotes.totals(t)), f"SELECT coalesce(template, 'Unknown') AS template, count(*) AS quotes, count(number) AS numbered, count(total) AS with_total FROM (SELECT {_TEMPLATE} AS template, {_group('text', quotes.NUMBER)} AS number, {_TOTAL} AS total FROM quote_texts) GROUP BY 1")
_W = {"cost": "cost_per_unit", "markup": "markup_pct * 100", "days": "man_days", "area": "square_footage", "rate": "daily_labor_rate", "days_per_1000": "CASE WHEN man_days > 0 AND square_footage > 0 THEN man_days / square_footage * 1000 END"}
_LONG = " UNION ALL ".join(f"SELECT scope_type, '{n}' AS measure, CAST({x} AS DOUBLE) AS v FROM scopes" for n, x in _W.items())
add(
    "a12_type_ranges", ["scopes"], overview.type_ranges,
    "SELECT t.scope_type, t.measure, coalesce(n, 0) AS n, mean, median, std, least, most FROM (SELECT scope_type, measure FROM (SELECT unnest(['" + "','".join(classify.SCOPE_TYPES) + "']) AS scope_type), (SELECT unnest(['" + "','".join(_W) + f"']) AS measure)) t LEFT JOIN (SELECT scope_type, measure, count(v) AS n, round(avg(v), 4) AS mean, round(quantile_cont(v, 0.5), 4) AS median, CASE WHEN count(v) > 0 THEN round(coalesce(stddev_samp(v), 0), 4) END AS std, round(min(v), 4) AS least, round(max(v), 4) AS most FROM ({_LONG}) GROUP BY 1, 2) s ON t.scope_type = s.scope_type AND t.measure = s.measure",
)
_ERA = "CASE " + " ".join(f"WHEN daily_labor_rate >= {a} AND daily_labor_rate < {b} THEN '{t}'" for a, b, t in rates.ERAS) + " END"
add("a14_era_ranges", ["scopes"], overview.era_ranges, "SELECT t.era, coalesce(scopes, 0) AS scopes, coalesce(cost_n, 0) AS cost_n, cost_mean, cost_median, cost_std, cost_min, cost_max FROM (SELECT unnest(['" + "','".join(t for _, _, t in rates.ERAS) + f"']) AS era) t LEFT JOIN (SELECT era, count(*) AS scopes, count(c) AS cost_n, round(avg(c), 4) AS cost_mean, round(quantile_cont(c, 0.5), 4) AS cost_median, round(stddev_samp(c), 4) AS cost_std, round(min(c), 4) AS cost_min, round(max(c), 4) AS cost_max FROM (SELECT {_ERA} AS era, CASE WHEN cost_per_unit > 0 THEN cost_per_unit END AS c FROM scopes WHERE daily_labor_rate > 0) GROUP BY 1) s ON t.era = s.era")
add("a21_labour_ranges", ["scopes"], lambda s: overview.labour_ranges(s, 10.0), "SELECT scope_type, count(*) AS n, round(avg(man_days), 4) AS mean, round(min(man_days), 4) AS least, round(max(man_days), 4) AS most, count(square_footage) AS sized, count(*) FILTER (man_days > 10) AS extreme, round(corr(square_footage, man_days) FILTER (square_footage > 0), 4) AS linear_corr, round(quantile_cont(man_days, 0.5), 4) AS median FROM scopes WHERE man_days IS NOT NULL GROUP BY 1")
_QUOTES = lambda q: q.groupBy("quote_id", "vendor").agg(F.sum("item_total").alias("total"), F.sum(F.when(F.col("part_id") % 2 == 0, F.col("quantity"))).alias("freight"))
add("a10_vendor_freight", ["quote_items"], lambda q: overview.vendor_freight(_QUOTES(q)), "SELECT coalesce(vendor, 'Unknown') AS vendor, count(*) AS quotes, round(avg(f), 2) AS avg_freight, round(CAST(sum(CAST(f AS DECIMAL(20,8))) FILTER (f IS NOT NULL AND t > 0) AS DOUBLE) * 100 / CAST(sum(CAST(t AS DECIMAL(20,8))) FILTER (f IS NOT NULL AND t > 0) AS DOUBLE), 1) AS freight_pct FROM (SELECT quote_id, vendor, sum(item_total) AS t, sum(quantity) FILTER (part_id % 2 = 0) AS f FROM quote_items GROUP BY 1, 2) GROUP BY 1")
add("a10_vendor_products", ["quote_items"], overview.vendor_products, "SELECT coalesce(vendor, 'Unknown') AS vendor, count(DISTINCT product) AS distinct_products, array_to_string(list_sort(list(DISTINCT product))[1:10], '|') AS products FROM quote_items GROUP BY 1")
add("a16_portfolio", ["projects", "scopes"], lambda p, s: overview.portfolio(reports.project_roll_up(p, s)), "SELECT count(*) AS projects, count(total) AS priced, round(avg(c), 4) AS avg_cost, CAST(round(sum(CAST(total AS DECIMAL(20,8))), 2) AS DOUBLE) AS value FROM projects LEFT JOIN (SELECT project_id, CAST(round(sum(CAST(total AS DECIMAL(20,8))), 2) AS DOUBLE) AS total, CAST(round(CAST(avg(cost_per_unit) AS DECIMAL(20,8)), 4) AS DOUBLE) AS c FROM scopes GROUP BY 1) USING (project_id)")
_EXTRA = lambda q: q.select(F.col("project_id").alias("estimate_id"), F.col("unit").alias("item_type"), F.col("quantity").alias("amount"))
add("a19_grand_totals", ["estimates", "quote_items"], lambda e, q: overview.grand_totals(e, _EXTRA(q)), "SELECT estimate_id, CAST(coalesce(m, 0) AS DOUBLE) AS additional, CAST(round(coalesce(CAST(total_estimate AS DECIMAL(20,8)), 0) + coalesce(m, 0), 2) AS DOUBLE) AS grand_total FROM estimates LEFT JOIN (SELECT project_id, round(sum(CAST(quantity AS DECIMAL(20,8))), 2) AS m FROM quote_items GROUP BY 1) ON project_id = estimate_id")
_KNOWN = lambda q: q.filter("vendor is not null and unit = 'sf'").select(F.col("product").alias("name"))
_NOT = "lower(product_name) NOT IN (SELECT lower(product) FROM quote_items WHERE vendor IS NOT NULL AND unit = 'sf' AND quantity < 2)"
_FEW = lambda q: q.filter("vendor is not null and unit = 'sf' and quantity < 2").select(F.col("product").alias("name"))
add("w9_unmatched_products", ["scopes", "quote_items"], lambda s, q: overview.unmatched_products(s, _FEW(q)), f"SELECT product_name, count(*) AS n FROM scopes WHERE {_NOT} GROUP BY 1 ORDER BY n DESC, product_name LIMIT 10")
add("a17_unknown_products", ["scopes", "quote_items"], lambda s, q: overview.unknown_products(s, _FEW(q)), f"SELECT project_id AS estimate_id, count(DISTINCT product_name) AS unknown, array_to_string(list_sort(list(DISTINCT product_name))[1:5], '|') AS products FROM scopes WHERE {_NOT} GROUP BY 1")
_JUDGED = lambda s: s.select(F.col("project_id").alias("estimate_id"), "square_footage", (F.col("man_days") / 13.7).alias("confidence"), (F.col("daily_labor_rate") > 700).alias("adjusted"))
add("a18_gates", ["estimates", "scopes"], lambda e, s: overview.gates(e, _JUDGED(s)), "SELECT estimate_id, coalesce(a, false) AS may_review, coalesce(g, false) AS may_finalise, coalesce(a, false) AND coalesce(g, false) AND coalesce(total_estimate > 0, false) AS may_export FROM estimates LEFT JOIN (SELECT project_id, bool_or(coalesce(square_footage > 0, false)) AS a, bool_or(coalesce(daily_labor_rate > 700, false) OR coalesce(man_days / CAST(13.7 AS DOUBLE) >= 0.5, false)) AS g FROM scopes GROUP BY 1) ON project_id = estimate_id")
add("a3_accuracy_by_type", ["estimates", "scopes"], overview.accuracy_by_type, "SELECT scope_type, count(*) AS n, (SELECT round(avg(abs(actual_total_cost - total_estimate) * 100 / actual_total_cost), 2) FROM estimates WHERE actual_total_cost > 0 AND total_estimate IS NOT NULL) AS mape FROM scopes WHERE scope_type IS NOT NULL AND project_id IN (SELECT estimate_id FROM estimates WHERE actual_total_cost > 0 AND total_estimate IS NOT NULL) GROUP BY 1")
add("w7_page_total", ["projects", "scopes"], lambda p, s: overview.page_total(p, s, "hospital", (2021, 2024), "act"), "SELECT count(*) AS total, max(created_on) AS newest FROM projects WHERE contains(lower(name), 'hospital') AND year(quote_date) BETWEEN 2021 AND 2024 AND project_id IN (SELECT project_id FROM scopes WHERE lower(scope_type) = 'act')")
_VPS = "(SELECT vendor, quotes, baseline, recent, round((recent - baseline) * 100 / baseline, 1) AS pct FROM (SELECT vendor, count(*) AS quotes, avg(total) FILTER (quote_date < DATE '2025-07-01') AS baseline, avg(total) FILTER (quote_date >= DATE '2025-07-01') AS recent FROM (SELECT quote_id, vendor, sum(item_total) AS total, min(quote_date) AS quote_date FROM quote_items GROUP BY 1, 2) WHERE vendor IS NOT NULL AND total > 0 GROUP BY 1 HAVING count(*) >= 3 ORDER BY quotes DESC, vendor LIMIT 10))"
add("a11_price_messages", ["quote_items"], lambda q: overview.price_messages(prices.vendor_price_summary(q)), f"SELECT vendor, quotes, round(baseline, 2) AS baseline, round(recent, 2) AS recent, pct, coalesce(abs(pct) > 15, false) AS alert, CASE WHEN abs(pct) > 15 THEN 'vendor is ' || CASE WHEN pct > 0 THEN 'up' ELSE 'down' END || ' ' || format('{{:.1f}}', abs(pct)) || '% since the baseline' END AS message FROM {_VPS}".replace("'vendor is '", "vendor || ' is '"))
_RUNS = lambda e: e.filter("actual_total_cost > 0 and status is not null").groupBy(F.col("status").alias("family"), F.year("created_on").alias("trained_on")).agg(F.avg(F.abs(F.col("total_estimate") - F.col("actual_total_cost")) / F.col("actual_total_cost")).alias("mape"), F.corr("total_estimate", "actual_total_cost").alias("r2"), F.count("*").alias("rows"))
add("m9_model_status", ["estimates"], lambda e: overview.model_status(_RUNS(e)), "SELECT family, trainings, trained_on, round(mape * 100, 2) AS mape_pct, round(r2, 4) AS r2, rows FROM (SELECT *, count(*) OVER (PARTITION BY family) AS trainings, row_number() OVER (PARTITION BY family ORDER BY trained_on DESC) AS k FROM (SELECT status AS family, year(created_on) AS trained_on, avg(abs(total_estimate - actual_total_cost) / actual_total_cost) AS mape, corr(total_estimate, actual_total_cost) AS r2, count(*) AS rows FROM estimates WHERE actual_total_cost > 0 AND status IS NOT NULL GROUP BY 1, 2)) WHERE k = 1")

# --- features and models ---
_TIER = "CASE " + " ".join("WHEN (" + " OR ".join(f"contains(lower(product_name), '{w}')" for w in words) + f") THEN {t}" for t, words in classify.TIER_KEYWORDS.items()) + " ELSE 1 END"
_K = "lower(trim(coalesce(project_type, '')))"
_KNOWN_TYPE = f"{_K} IN (" + ", ".join(f"'{k}'" for k in classify.PROJECT_TYPE_INDEX if k != "other") + ")"
_FLAG = lambda kind, words: f"CAST(CASE WHEN {_KNOWN_TYPE} THEN {_K} = '{kind}' ELSE {_HAS(words)} END AS INT)"
_INDEX = f"CASE {_K} " + " ".join(f"WHEN '{k}' THEN {n}" for k, n in classify.PROJECT_TYPE_INDEX.items()) + " ELSE 0 END"
_RAW = f"""(SELECT scope_id, scope_type, dense_rank() OVER (ORDER BY scope_type) - 1 AS type_index, CASE WHEN square_footage > 0 THEN ln(1 + square_footage) END AS log_area, CAST(coalesce(daily_labor_rate > 0, false) AS INT) AS has_rate,
    CASE WHEN daily_labor_rate > 0 THEN daily_labor_rate / 725 ELSE 1 END AS rate_ratio, count(*) OVER (PARTITION BY s.project_id) AS scope_count, {_TIER} AS tier, {_FLAG('healthcare', classify.HEALTHCARE)} AS is_healthcare, {_FLAG('education', classify.EDUCATION)} AS is_education, {_FLAG('worship', classify.CHURCH)} AS is_church, {_INDEX} AS project_index,
    markup_pct, CAST(round(CAST(CASE WHEN square_footage > 0 THEN nullif(man_days, 0) / square_footage END AS DECIMAL(20,8)), 6) AS DOUBLE) AS d, CAST(round(CAST(CASE WHEN square_footage > 0 THEN coalesce(nullif(material_cost, 0), nullif(material_price, 0)) / square_footage END AS DECIMAL(20,8)), 4) AS DOUBLE) AS m, CAST(round(CAST(CASE WHEN square_footage > 0 THEN nullif(total, 0) / square_footage END AS DECIMAL(20,8)), 4) AS DOUBLE) AS target_total, cost_per_unit
    FROM scopes s JOIN projects p USING (project_id))"""
_FILLED = f"(SELECT r.*, coalesce(d, td) AS d1, coalesce(m, tm) AS m1, tk FROM {_RAW} r LEFT JOIN (SELECT scope_type, quantile_cont(d, 0.5) AS td, quantile_cont(m, 0.5) AS tm, quantile_cont(markup_pct, 0.5) AS tk FROM {_RAW} GROUP BY 1) t USING (scope_type))"
add(
    "h1_training_features", ["scopes", "projects"], model_features.training_features,
    f"SELECT scope_id, scope_type, CAST(type_index AS INT) AS type_index, CAST(round(CAST(coalesce(log_area, (SELECT quantile_cont(log_area, 0.5) FROM {_RAW}), 0) AS DECIMAL(20,8)), 4) AS DOUBLE) AS log_area, has_rate, CAST(round(CAST(rate_ratio AS DECIMAL(20,8)), 4) AS DOUBLE) AS rate_ratio, scope_count, tier, is_healthcare, is_education, is_church, project_index, CAST(round(CAST(coalesce(markup_pct, tk, 0.30) AS DECIMAL(20,8)), 4) AS DOUBLE) AS markup, CAST(round(CAST(coalesce(d1, (SELECT quantile_cont(d1, 0.5) FROM {_FILLED}), 0) AS DECIMAL(20,8)), 6) AS DOUBLE) AS days_per_sf, CAST(round(CAST(coalesce(m1, (SELECT quantile_cont(m1, 0.5) FROM {_FILLED}), 0) AS DECIMAL(20,8)), 4) AS DOUBLE) AS material_per_sf, target_total, CAST(round(CAST(cost_per_unit AS DECIMAL(20,8)), 4) AS DOUBLE) AS target_material FROM {_FILLED}",
)
add("h4_markup_features", ["scopes", "projects"], model_features.markup_features, f"SELECT scope_id, scope_type, round(ln(1 + coalesce(square_footage, 0)), 4) AS log_area, count(*) OVER (PARTITION BY s.project_id) AS scope_count, CAST({_HAS(classify.MARKUP_HEALTHCARE)} AS INT) AS is_healthcare, CAST({_HAS(classify.MARKUP_EDUCATION)} AS INT) AS is_education, CAST({_HAS(classify.MARKUP_CHURCH)} AS INT) AS is_church, round(coalesce(daily_labor_rate, 0) / 700, 4) AS rate_ratio, CAST(coalesce(cost_per_unit > 0, false) AS INT) AS has_cost, markup_pct FROM scopes s JOIN projects p USING (project_id)")
_BOTH = "lower(concat_ws(' ', nullif(product_name, ''), nullif(scope_type, '')))"
_LTIER = f"CASE WHEN {_BOTH} = '' THEN 0 " + " ".join("WHEN (" + " OR ".join(f"contains({_BOTH}, '{w}')" for w in words) + f") THEN {t}" for t, words in text.LABOUR_TIER_KEYWORDS.items()) + " " + " ".join(f"WHEN scope_type = '{k}' THEN {t}" for k, t in text.LABOUR_TIER_BY_TYPE.items()) + " ELSE 1 END"
add("h4_labour_features", ["scopes"], model_features.labour_features, f"SELECT scope_id, scope_type, round(ln(1 + coalesce(square_footage, 0)), 4) AS log_area, {_LTIER} AS tier, round(coalesce(nullif(daily_labor_rate, 0), 725) / 725, 4) AS rate_ratio, count(*) OVER (PARTITION BY project_id) AS scope_count, CAST(coalesce(square_footage, 0) > 0 AS INT) AS has_area, man_days FROM scopes")


def _markups(s, p):
    rows = kept(model_features.markup_features(s, p), "features")
    return models.interval_report(models.markup_intervals(models.markup_model(rows), rows), "markup_pct")


def _days(s):
    rows = kept(model_features.labour_features(s), "features")
    return models.interval_report(models.labour_intervals(models.labour_model(rows), rows), "man_days", 0.5)


add("m5_markup_intervals", ["scopes", "projects"], _markups, None)
add("m6_labour_intervals", ["scopes"], _days, None)
_MODELLED = lambda s: s.select(F.col("project_id").alias("plan_id"), "scope_type", F.col("square_footage").alias("area_sf"), (F.col("man_days") / 13.7).alias("confidence"), "scope_id", F.when(F.col("daily_labor_rate") > 500, F.col("cost_per_unit")).alias("model_cost"), F.col("markup_pct").alias("model_markup"), F.when(F.col("daily_labor_rate") > 530, F.col("man_days")).alias("model_days"))
_HEUR = lambda table, default: "CASE scope_type " + " ".join(f"WHEN '{k}' THEN CAST({v} AS DOUBLE)" for k, v in table.items()) + f" ELSE CAST({default} AS DOUBLE) END"
add(
    "z1_model_prices", ["scopes"], lambda s: estimates.price_suggestions(_MODELLED(s)).select("scope_id", to_places(F.col("material_cost"), 4).alias("material_cost"), to_places(F.col("labour_cost"), 4).alias("labour_cost"), to_places(F.col("total"), 4).alias("total")),
    f"SELECT scope_id, CAST(round(CAST(mat AS DECIMAL(20,8)), 4) AS DOUBLE) AS material_cost, CAST(round(CAST(md * 725 AS DECIMAL(20,8)), 4) AS DOUBLE) AS labour_cost, CAST(round(CAST(mat * (1 + m) + md * 725 + mat * CAST(0.075 AS DOUBLE) AS DECIMAL(20,8)), 4) AS DOUBLE) AS total FROM (SELECT *, a * (c / (1 + m)) AS mat FROM (SELECT scope_id, square_footage AS a, coalesce(CASE WHEN daily_labor_rate > 500 THEN cost_per_unit END, {_HEUR(estimates.COST_PER_SF, 12.0)}) AS c, coalesce(markup_pct, {_HEUR(estimates.MARKUP, 0.33)}) AS m, coalesce(CASE WHEN daily_labor_rate > 530 THEN man_days END, square_footage / 1000 * {_HEUR(estimates.DAYS_PER_1000_SF, 1.2)}) AS md FROM scopes WHERE square_footage > 0 AND man_days / CAST(13.7 AS DOUBLE) >= 0.3))",
)

_ERR = lambda e, where: e.filter(f"actual_total_cost > 0 and status is not null and {where}").groupBy(F.col("status").alias("family")).agg(to_places(F.avg(F.abs(F.col("total_estimate") - F.col("actual_total_cost")) / F.col("actual_total_cost")), 6).alias("mape"))
_ERR_SQL = lambda where: f"(SELECT status AS family, CAST(round(CAST(avg(abs(total_estimate - actual_total_cost) / actual_total_cost) AS DECIMAL(20,8)), 6) AS DOUBLE) AS mape FROM estimates WHERE actual_total_cost > 0 AND status IS NOT NULL AND {where} GROUP BY 1)"


def _manifest(e):
    new, old = _ERR(e, "created_on >= date'1998-01-01' and status <> 'exported'"), _ERR(e, "created_on < date'1998-01-01' and status <> 'draft'")
    return overview.manifest_upserted(old, models.deployment(new, old), new)


add("m8_manifest_upserted", ["estimates"], _manifest, f"SELECT coalesce(n.family, o.family) AS family, CASE WHEN n.family IS NOT NULL AND (o.family IS NULL OR n.mape <= o.mape * CAST(1.05 AS DOUBLE)) THEN n.mape ELSE o.mape END AS mape, n.family IS NOT NULL AND (o.family IS NULL OR n.mape <= o.mape * CAST(1.05 AS DOUBLE)) AS replaced FROM {_ERR_SQL('created_on >= DATE ' + repr('1998-01-01') + ' AND status <> ' + repr('exported'))} n FULL JOIN {_ERR_SQL('created_on < DATE ' + repr('1998-01-01') + ' AND status <> ' + repr('draft'))} o ON n.family = o.family")


def _choice(s, p):
    table = models.training_table(reports.features(s, p), s).filter("scope_type not in ('SM', 'Other')")
    return models.best_model(table)[2]


add("m1_model_choice", ["scopes", "projects"], _choice, None)


def _families(s, p):
    """A row a type and kind, of 200 trees of a forest and 300 boosted ones."""
    table = models.training_table(reports.features(s, p), s).filter("scope_type not in ('SM', 'Other')")
    return models.models_chosen(table)[1]


add("m1_models_by_type", ["scopes", "projects"], _families, None)

"""One query an operator over the domain tables, and its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import classify, parse, rates
from ..operators import checks, comparables, edits, estimates, links, models, plan_chain, prices, products, reports
from . import document_queries, link_queries, load_queries, overview_queries, range_queries, room_queries, state_queries  # noqa: F401  (they register their own)
from .registry import FOUND, Query, add as _add

#: Year that dates without one belong to, in the queries.
AS_OF = 2025
CATEGORIES = {"metals": ["steel", "tin", "copper", "nickel", "brass"], "small": ["small", "mini"], "blue": ["blue", "azure", "navy"]}


def _case(table: dict, column: str, default: object, i: int | None = None) -> str:
    pick = lambda v: v if i is None else v[i]
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN CAST({pick(v)} AS DOUBLE)" for k, v in table.items()) + f" ELSE CAST({default} AS DOUBLE) END"


def _any(column: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({column}, '{w}')" for w in words) + ")"


# --- scalar functions ---
_D = "TRY_CAST(lpad({y}, 4, '0') || '-' || lpad({m}, 2, '0') || '-' || lpad({d}, 2, '0') AS DATE)"
_US, _NAME = r"^(\d{1,2})/(\d{1,2})(?:/(\d{2,4}))?$", r"^([A-Za-z]+)\s+(\d{1,2})(?:[\s,]+(\d{4}))?$"
_rx = lambda r, i: f"regexp_extract(date_text, '{r}', {i})"
_US_YEAR = f"CASE WHEN {_rx(_US, 3)} = '' THEN '{AS_OF}' WHEN length({_rx(_US, 3)}) = 2 THEN '20' || {_rx(_US, 3)} ELSE {_rx(_US, 3)} END"
_MONTH = "CAST(list_position(['jan','feb','mar','apr','may','jun','jul','aug','sep','oct','nov','dec'], lower(" + _rx(_NAME, 1) + "[1:3])) AS VARCHAR)"
_add(
    "f1_loose_date", ["raw_fields"], lambda r: r.select("row_id", parse.loose_date(F.col("date_text"), AS_OF).alias("parsed")),
    "SELECT row_id, CASE WHEN date_text = 'TBD' THEN NULL WHEN regexp_matches(date_text, '^\\d{4}-') THEN TRY_CAST(date_text AS DATE) "
    f"WHEN regexp_matches(date_text, '{_US}') THEN " + _D.format(y=f"({_US_YEAR})", m=_rx(_US, 1), d=_rx(_US, 2))
    + f" ELSE " + _D.format(y=f"CASE WHEN {_rx(_NAME, 3)} = '' THEN '{AS_OF}' ELSE {_rx(_NAME, 3)} END", m=_MONTH, d=_rx(_NAME, 2)) + " END AS parsed FROM raw_fields",
)
_add(
    "f4_money", ["raw_fields"], lambda r: r.select("row_id", parse.money(F.col("money_text")).cast("double").alias("amount"), parse.money(F.col("money_text"), strict=True).cast("double").alias("strict_amount")),
    r"""SELECT row_id, CAST(TRY_CAST(regexp_replace(regexp_replace(regexp_replace(money_text, '/\s*[A-Za-z]+\.?$', ''), '[$,%\s]', '', 'g'), '^\((.*)\)$', '-\1') AS DECIMAL(18,4)) AS DOUBLE) AS amount,
        CAST(TRY_CAST(regexp_replace(money_text, '[$,\s]', '', 'g') AS DECIMAL(18,4)) AS DOUBLE) AS strict_amount FROM raw_fields""",
)
_add("f5_scope_type", ["raw_fields"], lambda r: r.select("row_id", classify.scope_type(F.col("type_text")).alias("scope_type")), "SELECT row_id, CASE lower(trim(type_text)) WHEN 'act' THEN 'ACT' WHEN 'baffle' THEN 'Baffles' WHEN 'ww' THEN 'WW' WHEN 'rpg' THEN 'RPG' ELSE 'Other' END AS scope_type FROM raw_fields")
_add("f6_project_folder", ["raw_fields"], lambda r: r.select("row_id", parse.project_folder(F.col("path")).alias("folder")), r"SELECT row_id, nullif(regexp_extract(path, '\+ITBs/(?:\+\+Archive/)?([^/]+)', 1), '') AS folder FROM raw_fields")
_add("f7_name_date", ["raw_fields"], lambda r: r.select("row_id", parse.name_date(F.col("path")).alias("dated")), "SELECT row_id, CASE WHEN path LIKE '%3.14.24%' THEN DATE '2024-03-14' END AS dated FROM raw_fields")
_add("f9_vendor_slug", ["quote_items"], lambda q: q.select(parse.slug(F.col("vendor")).alias("slug")).distinct(), "SELECT DISTINCT replace(replace(replace(lower(trim(vendor)), ' ', '_'), ',', ''), '.', '') AS slug FROM quote_items")
_TIER = "CASE " + " ".join(f"WHEN {_any('lower(product_name)', w)} THEN {t}" for t, w in classify.TIER_KEYWORDS.items()) + " ELSE 1 END"
_add("f10_product_tier", ["scopes"], lambda s: s.groupBy(classify.product_tier(F.col("product_name")).alias("tier")).agg(F.count("*").alias("n")), f"SELECT {_TIER} AS tier, count(*) AS n FROM scopes GROUP BY 1")
_BOTH = "lower(concat_ws(' ', coalesce(name, ''), coalesce(gc_name, '')))"
_add("f12_building_flags", ["projects"], lambda p: p.select("project_id", *[v.cast("int").alias(k) for k, v in classify.building_flags(F.col("name"), F.col("gc_name")).items()]), f"SELECT project_id, CAST({_any(_BOTH, classify.HEALTHCARE)} AS INT) AS is_healthcare, CAST({_any(_BOTH, classify.EDUCATION)} AS INT) AS is_education, CAST({_any(_BOTH, classify.CHURCH)} AS INT) AS is_church FROM projects")
_add("f17_feet", ["raw_fields"], lambda r: r.select("row_id", F.round(parse.feet(F.col("length_text")), 4).alias("feet")), """SELECT row_id, round(CASE WHEN length_text = 'NTS' THEN NULL WHEN length_text LIKE '%-6"' THEN CAST(split_part(length_text, chr(39), 1) AS DOUBLE) + 0.5 WHEN length_text LIKE '%"' THEN CAST(replace(length_text, '"', '') AS DOUBLE) / 12 ELSE CAST(replace(length_text, chr(39), '') AS DOUBLE) END, 4) AS feet FROM raw_fields""")
_RATE_ON = "CASE WHEN quote_date IS NULL THEN 725.0 " + " ".join(f"WHEN quote_date >= DATE '{d}' THEN {r}" for d, r in reversed(rates.SCHEDULE)) + " ELSE 486.0 END"
_add("f19_rate_on", ["projects"], lambda p: p.select("project_id", rates.rate_on(F.col("quote_date")).alias("rate")), f"SELECT project_id, CAST({_RATE_ON} AS DOUBLE) AS rate FROM projects")
_ERA = "CASE " + " ".join(f"WHEN daily_labor_rate >= {a} AND daily_labor_rate < {b} THEN '{t}'" for a, b, t in rates.ERAS) + " ELSE 'Era Unknown' END"
_add("f20_era", ["scopes"], lambda s: s.groupBy(rates.era(F.col("daily_labor_rate")).alias("era")).agg(F.count("*").alias("n")), f"SELECT {_ERA} AS era, count(*) AS n FROM scopes GROUP BY 1")

# --- joins and loads ---
_add("j1_scopes_with_projects", ["scopes", "projects"], reports.scopes_with_projects, "SELECT s.scope_id, s.project_id, p.project_type, p.gc_name, c.n AS scope_count FROM scopes s JOIN projects p USING (project_id) JOIN (SELECT project_id, count(*) AS n FROM scopes GROUP BY 1) c USING (project_id) WHERE man_days > 0 AND markup_pct > 0 AND markup_pct <= 1")
_add("j3_projects_with_type", ["projects", "scopes"], lambda p, s: reports.projects_with_type(p, s, "act"), "SELECT project_id, name FROM projects WHERE project_id IN (SELECT project_id FROM scopes WHERE lower(scope_type) = 'act')")
_add("s9_replace_by_key", ["projects"], lambda p: reports.replace_by_key(p.filter("project_id % 3 <> 0"), p.filter("project_id % 2 = 0").withColumn("status", F.lit("reloaded")).withColumn("name", F.upper("name")), "project_id", ["status"]).select("project_id", "name", "status"), "SELECT project_id, CASE WHEN project_id % 2 = 0 THEN upper(name) ELSE name END AS name, CASE WHEN project_id % 2 = 0 AND project_id % 3 = 0 THEN 'reloaded' ELSE status END AS status FROM projects WHERE project_id % 3 <> 0 OR project_id % 2 = 0")
_add("s10_incremental", ["projects"], lambda p: reports.incremental(p, p.filter("status = 'completed'"), "project_id").select("project_id"), "SELECT project_id FROM projects WHERE status <> 'completed'")
_add("s12_upsert", ["quote_items"], lambda q: reports.upsert(q.filter("line_no % 2 = 0").groupBy("vendor", "product").agg(F.max("part_id").alias("v")), q.filter("line_no % 3 = 0").groupBy("vendor", "product").agg(F.min("part_id").alias("v")), ["vendor", "product"]), "SELECT coalesce(n.vendor, o.vendor) AS vendor, coalesce(n.product, o.product) AS product, CASE WHEN n.product IS NOT NULL THEN n.v ELSE o.v END AS v FROM (SELECT vendor, product, max(part_id) AS v FROM quote_items WHERE line_no % 2 = 0 GROUP BY 1, 2) o FULL JOIN (SELECT vendor, product, min(part_id) AS v FROM quote_items WHERE line_no % 3 = 0 GROUP BY 1, 2) n ON o.vendor IS NOT DISTINCT FROM n.vendor AND o.product = n.product")

# --- prices ---
for _bucket, _label in (("year", "CAST(year(quote_date) AS VARCHAR)"), ("quarter", "CAST(year(quote_date) AS VARCHAR) || ' Q' || CAST(quarter(quote_date) AS VARCHAR)"), ("month", "strftime(quote_date, '%b ''%y')")):
    _add(
        f"a1_cost_trends_{_bucket}", ["scopes", "projects"], lambda s, p, b=_bucket: prices.cost_trends(s, p, b),
        f"SELECT date, max(n) AS project_count, " + ", ".join(f"round(max(mean) FILTER (scope_type = '{t}'), 2) AS {t.lower()}" for t in prices.TREND_TYPES)
        + f" FROM (SELECT {_label} AS date, scope_type, avg(cost_per_unit) AS mean, count(DISTINCT project_id) AS n FROM scopes JOIN projects USING (project_id) WHERE cost_per_unit > 0 AND scope_type IN ('ACT','AWP','FW','SM') AND year(quote_date) BETWEEN 2020 AND 2026 GROUP BY 1, 2) GROUP BY 1",
    )
_add("a4_scope_distribution", ["scopes"], prices.scope_distribution, "SELECT scope_type, count(*) AS n, " + ", ".join(f"round({f}, 4) AS {n}_{c}" for c in ("cost_per_unit", "markup_pct") for n, f in (("avg", f"avg({c})"), ("median", f"quantile_cont({c}, 0.5)"), ("min", f"min({c})"), ("max", f"max({c})"))) + " FROM scopes GROUP BY 1")
_add("a12_type_statistics", ["scopes"], prices.type_statistics, "SELECT t.scope_type, coalesce(n, 0) AS n, mean, median, CASE WHEN n > 0 THEN coalesce(std, 0) END AS std, area FROM (SELECT unnest(['" + "','".join(classify.SCOPE_TYPES) + "']) AS scope_type) t LEFT JOIN (SELECT scope_type, count(cost_per_unit) AS n, round(avg(cost_per_unit), 4) AS mean, round(quantile_cont(cost_per_unit, 0.5), 4) AS median, round(stddev_samp(cost_per_unit), 4) AS std, round(sum(square_footage), 2) AS area FROM scopes GROUP BY 1) s USING (scope_type)")
_add("a13_coverage", ["scopes", "projects"], prices.coverage, "SELECT total, with_dated, with_cost, with_man_days, with_rate, round(with_dated * 100.0 / total, 1) AS pct_dated, round(with_cost * 100.0 / total, 1) AS pct_cost, round(with_man_days * 100.0 / total, 1) AS pct_man_days, round(with_rate * 100.0 / total, 1) AS pct_rate FROM (SELECT count(*) AS total, count(quote_date) AS with_dated, count(cost_per_unit) AS with_cost, count(man_days) AS with_man_days, count(daily_labor_rate) AS with_rate FROM scopes LEFT JOIN projects USING (project_id))")
_add("a14_era_analysis", ["scopes"], prices.era_analysis, f"SELECT era, scope_type, count(*) AS n, round(avg(cost_per_unit), 4) AS mean, round(quantile_cont(cost_per_unit, 0.5), 4) AS median FROM (SELECT {_ERA} AS era, scope_type, cost_per_unit FROM scopes WHERE daily_labor_rate > 0 AND cost_per_unit > 0) GROUP BY GROUPING SETS ((era), (era, scope_type))")
_NL = "CASE WHEN man_days > 0 THEN man_days * 725 WHEN labor_price IS NOT NULL AND daily_labor_rate > 0 THEN labor_price * (725 / daily_labor_rate) END"
_LOW, _HIGH = (_case(prices.BOUNDS, "scope_type", (0.5, 300.0)[i], i) for i in (0, 1))
_add(
    "n3_normalised", ["scopes"], prices.normalised,
    f"""SELECT scope_id, scope_type, round(725 / daily_labor_rate, 4) AS factor, round(nl, 2) AS normal_labour, CAST(round(CAST(nt AS DECIMAL(20,8)), 2) AS DOUBLE) AS normal_total, CAST(round(CAST(nl / square_footage AS DECIMAL(20,8)), 4) AS DOUBLE) AS labour_per_sf, CAST(round(CAST(nt / square_footage AS DECIMAL(20,8)), 4) AS DOUBLE) AS price_per_sf,
        concat_ws('; ', CASE WHEN cost_per_unit < {_LOW} THEN 'cost below' END, CASE WHEN cost_per_unit > {_HIGH} THEN 'cost above' END, CASE WHEN NOT markup_pct BETWEEN -0.20 AND 2.50 THEN 'markup' END) AS reasons
        FROM (SELECT *, {_NL} AS nl, material_price + {_NL} + material_price * CAST(0.06 AS DOUBLE) AS nt FROM scopes)""",
)
_add("a15_labour_impact", ["scopes"], prices.labour_impact, f"SELECT scope_type, count(*) AS n, round(avg(round(725 / daily_labor_rate, 4)), 4) AS factor, round(avg(labor_price / square_footage), 4) AS labour_per_sf, round(avg(({_NL}) / square_footage), 4) AS normal_per_sf FROM scopes WHERE square_footage > 0 AND labor_price > 0 AND daily_labor_rate > 0 GROUP BY 1")
_BL, _BH = (_case(prices.BENCHMARKS, "scope_type", (0.5, 200.0)[i], i) for i in (0, 1))
_add("q4_benchmark_flags", ["scopes"], prices.benchmark_flags, f"SELECT scope_type, CASE WHEN cost_per_unit < {_BL} * 0.5 THEN 'far below' WHEN cost_per_unit < {_BL} THEN 'below' WHEN cost_per_unit > {_BH} * 2 THEN 'far above' WHEN cost_per_unit > {_BH} THEN 'above' ELSE 'in range' END AS flag, count(*) AS n FROM scopes WHERE cost_per_unit > 0 GROUP BY 1, 2")
_PRICED = "(SELECT *, CAST(TRY_CAST(replace(unit_cost_text, '$', '') AS DECIMAL(18,4)) AS DOUBLE) AS unit_cost, lower(trim(product))[1:80] AS product_key, upper(trim(unit)) AS unit_key, coalesce(vendor, 'Unknown') AS vendor_key FROM quote_items)"
_add("w1_price_alerts", ["quote_items"], prices.price_alerts, f"SELECT product_key, unit_key, vendor_key, old_date, quote_date, old_cost, unit_cost, pct FROM (SELECT *, round((unit_cost - old_cost) * 100 / old_cost, 1) AS pct FROM (SELECT *, lag(unit_cost) OVER w AS old_cost, lag(quote_date) OVER w AS old_date FROM {_PRICED} WHERE unit_cost > 0 WINDOW w AS (PARTITION BY product_key, unit_key, vendor_key ORDER BY quote_date, quote_id, line_no, part_id, unit_cost))) WHERE abs(pct) >= 10")
_add("w2_price_history", ["quote_items"], lambda q: reports.price_history(q, "a"), f"SELECT product, vendor, quote_date, unit_cost, quote_id, line_no FROM {_PRICED} WHERE unit_cost > 0 AND contains(lower(product), 'a')")
_TOTALS = "(SELECT quote_id, vendor, sum(item_total) AS total, min(quote_date) AS quote_date, count(*) AS items FROM quote_items GROUP BY 1, 2)"
_add("a10_vendor_summary", ["quote_items"], prices.vendor_summary, f"SELECT a.vendor, quotes, avg_total, min_total, max_total, items, first_date, last_date, products FROM (SELECT coalesce(vendor, 'Unknown') AS vendor, count(*) AS quotes, round(avg(total), 2) AS avg_total, round(min(total), 2) AS min_total, round(max(total), 2) AS max_total, CAST(sum(items) AS BIGINT) AS items, min(quote_date) AS first_date, max(quote_date) AS last_date FROM {_TOTALS} GROUP BY 1) a JOIN (SELECT coalesce(vendor, 'Unknown') AS vendor, array_to_string(list_sort(list(DISTINCT product))[1:10], '|') AS products FROM quote_items GROUP BY 1) b USING (vendor)")
_add("a11_vendor_price_summary", ["quote_items"], prices.vendor_price_summary, f"SELECT vendor, quotes, CAST(round(CAST(baseline AS DECIMAL(20,8)), 2) AS DOUBLE) AS baseline, CAST(round(CAST(recent AS DECIMAL(20,8)), 2) AS DOUBLE) AS recent, round((recent - baseline) * 100 / baseline, 1) AS pct, coalesce(abs(round((recent - baseline) * 100 / baseline, 1)) > 15, false) AS alert FROM (SELECT vendor, count(*) AS quotes, avg(total) FILTER (quote_date < DATE '2025-07-01') AS baseline, avg(total) FILTER (quote_date >= DATE '2025-07-01') AS recent FROM {_TOTALS} WHERE vendor IS NOT NULL AND total > 0 GROUP BY 1 HAVING count(*) >= 3 ORDER BY quotes DESC, vendor LIMIT 10)")
_CAT = "(" + " UNION ALL ".join(f"SELECT vendor, '{c}' AS category FROM quote_items WHERE vendor IS NOT NULL AND {_any('lower(product)', w)}" for c, w in CATEGORIES.items()) + ")"
_add("a20_preferred_vendors", ["quote_items"], lambda q: reports.preferred_vendors(q, CATEGORIES), f"SELECT category, vendor, n, rank FROM (SELECT category, vendor, n, row_number() OVER (PARTITION BY category ORDER BY n DESC, vendor) AS rank FROM (SELECT category, vendor, count(*) AS n FROM {_CAT} GROUP BY 1, 2)) WHERE rank <= 5")

# --- quality ---
_OFF = lambda a, b: f"abs({a} - {b}) / greatest(abs({a}), abs({b}), 1)"
_RULES = [
    ("square_footage", "missing_required", "error", "scope_type IN ('ACT','AWP','FW','WW','RPG') AND cost_per_unit IS NOT NULL AND coalesce(square_footage, 0) <= 0"),
    ("markup_pct", "out_of_range", "error", "markup_pct < 0.10 OR markup_pct > 1.00"),
    ("markup_pct", "out_of_range", "warning", "markup_pct BETWEEN 0.10 AND 1.00 AND (markup_pct < 0.15 OR markup_pct > 0.75)"),
    ("cost_per_sf", "suspicious", "warning", "cost_per_unit > 0 AND (" + " OR ".join(f"scope_type = '{k}' AND (cost_per_unit < {a} OR cost_per_unit > {b})" for k, (a, b) in checks.COST_RANGES.items()) + ")"),
    ("total", "out_of_range", "error", "total <= 0"),
    ("sales_tax", "out_of_range", "error", "sales_tax < 0"),
    ("total", "math_mismatch", "warning", "total <> 0 AND " + _OFF("(coalesce(material_price, 0) + coalesce(labor_price, 0) + coalesce(sales_tax, 0))", "total") + " > 0.02"),
    ("material_price", "math_mismatch", "warning", "material_price <> 0 AND " + _OFF("(material_cost * (1 + markup_pct))", "material_price") + " > 0.01"),
    ("material_cost", "math_mismatch", "warning", "material_cost <> 0 AND " + _OFF("(square_footage * cost_per_unit)", "material_cost") + " > 0.01"),
    ("man_days", "missing_required", "warning", "labor_price > 0 AND man_days IS NULL"),
]
_ISSUES = "(" + " UNION ALL ".join(f"SELECT project_id, scope_id, '{f}' AS field, '{t}' AS issue_type, '{s}' AS severity FROM scopes WHERE {w}" for f, t, s, w in _RULES) + ")"
_VALID = f"(SELECT project_id, coalesce(n, 0) AS scopes, coalesce(e, 0) + CASE WHEN n IS NULL THEN 1 ELSE 0 END AS errors, coalesce(w, 0) AS warnings FROM projects LEFT JOIN (SELECT project_id, count(*) AS n FROM scopes GROUP BY 1) a USING (project_id) LEFT JOIN (SELECT project_id, count(*) FILTER (severity = 'error') AS e, count(*) FILTER (severity = 'warning') AS w FROM {_ISSUES} GROUP BY 1) b USING (project_id))"
_add("q1_scope_issues", ["scopes"], checks.scope_issues, f"SELECT * FROM {_ISSUES}")
_add("q2_project_validation", ["projects", "scopes"], checks.project_validation, f"SELECT project_id, scopes, errors, warnings, errors = 0 AS valid, round(greatest(0, 1 - errors * CAST(0.2 AS DOUBLE) - warnings * CAST(0.05 AS DOUBLE)), 4) AS confidence FROM {_VALID}")
_add("q3_batch_report", ["projects", "scopes"], checks.batch_report, f"SELECT count(*) AS projects, count(*) FILTER (errors = 0) AS valid, count(*) FILTER (errors > 0) AS with_errors, count(*) FILTER (errors = 0 AND warnings > 0) AS warning_only, CAST(sum(scopes) AS BIGINT) AS scopes FROM {_VALID}")
_add("w9_top_issues", ["scopes"], checks.top_issues, f"SELECT field, issue_type, count(*) AS n FROM {_ISSUES} GROUP BY 1, 2 ORDER BY n DESC, field, issue_type LIMIT 10")
_add("a8_issue_tally", ["projects", "scopes"], lambda p, s: links.issue_tally(p, checks.scope_issues(s)), f"SELECT CASE WHEN e > 0 THEN 'error' WHEN n > 0 THEN 'warning' ELSE 'none' END AS worst, count(*) AS projects, CAST(sum(coalesce(n, 0)) AS BIGINT) AS issues FROM projects LEFT JOIN (SELECT project_id, count(*) AS n, count(*) FILTER (severity = 'error') AS e FROM {_ISSUES} GROUP BY 1) USING (project_id) GROUP BY 1")
_FIELDS = ["square_footage", "cost_per_unit", "markup_pct", "man_days", "daily_labor_rate", "product_name"]
_add("a5_field_population", ["scopes"], lambda s: checks.field_population(s, _FIELDS), " UNION ALL ".join(f"SELECT '{f}' AS field, count({f}) AS filled, count(*) - count({f}) AS missing, round(count({f}) * 100.0 / count(*), 1) AS pct FROM scopes" for f in _FIELDS))

# --- reports and features ---
_add("a2_dashboard", ["projects", "scopes", "estimates"], reports.dashboard, "SELECT (SELECT count(*) FROM projects) AS projects, (SELECT count(*) FROM estimates WHERE status <> 'exported') AS open_estimates, round(avg(cost_per_unit) FILTER (scope_type = 'ACT' AND cost_per_unit > 0 AND cost_per_unit < 50), 2) AS act_cost, round(sum(square_footage), 0) AS area FROM scopes")
_add("a3_accuracy", ["estimates"], estimates.accuracy, "SELECT count(*) AS n, round(avg(abs((total_estimate - actual_total_cost) * 100 / actual_total_cost)), 2) AS mape, round(avg((total_estimate - actual_total_cost) * 100 / actual_total_cost), 2) AS bias FROM estimates WHERE actual_total_cost > 0 AND total_estimate IS NOT NULL")
_add("a6_readiness", ["scopes"], reports.readiness, "SELECT scope_type, count(*) FILTER (cost_per_unit IS NOT NULL AND square_footage > 0 AND markup_pct IS NOT NULL) AS ready, count(*) FILTER (cost_per_unit IS NOT NULL AND square_footage > 0 AND markup_pct IS NOT NULL) > 20 AS trainable FROM scopes GROUP BY 1")
_add("a7_status_distribution", ["projects"], reports.status_distribution, "SELECT status, count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM projects), 1) AS pct FROM projects GROUP BY 1")
_add("a16_project_roll_up", ["projects", "scopes"], reports.project_roll_up, "SELECT project_id, status, types, total, area, cost_per_unit FROM projects LEFT JOIN (SELECT project_id, array_to_string(list_sort(list(DISTINCT scope_type)), ',') AS types, CAST(round(sum(CAST(total AS DECIMAL(20,8))), 2) AS DOUBLE) AS total, round(sum(square_footage), 2) AS area, CAST(round(CAST(avg(cost_per_unit) AS DECIMAL(20,8)), 4) AS DOUBLE) AS cost_per_unit FROM scopes GROUP BY 1) s USING (project_id)")
_add("a21_labour_analysis", ["scopes"], reports.labour_analysis, "SELECT scope_type, count(*) AS n, round(quantile_cont(man_days, 0.5), 4) AS median, round(max(man_days), 4) AS most, round(corr(ln(1 + square_footage), ln(1 + man_days)), 4) AS log_corr, round(regr_slope(ln(1 + man_days), ln(1 + square_footage)), 4) AS slope, round(regr_intercept(ln(1 + man_days), ln(1 + square_footage)), 4) AS intercept FROM scopes WHERE man_days > 0 AND square_footage > 0 GROUP BY 1")
_add(
    "h1_features", ["scopes", "projects"], reports.features,
    f"""SELECT scope_id, s.scope_type, round(coalesce(CASE WHEN square_footage > 0 THEN ln(1 + square_footage) END, (SELECT quantile_cont(ln(1 + square_footage), 0.5) FROM scopes WHERE square_footage > 0)), 4) AS log_area,
        CAST(daily_labor_rate IS NOT NULL AS INT) AS has_rate, round(coalesce(daily_labor_rate / 725, 1), 4) AS rate_ratio, c.n AS scope_count, {_TIER} AS tier,
        CAST({_any(_BOTH, classify.HEALTHCARE)} AS INT) AS is_healthcare, CAST({_any(_BOTH, classify.EDUCATION)} AS INT) AS is_education, CAST({_any(_BOTH, classify.CHURCH)} AS INT) AS is_church,
        round(coalesce(markup_pct, m.med, 0.30), 4) AS markup, round(CASE WHEN square_footage > 0 THEN man_days / square_footage END, 6) AS days_per_sf
        FROM scopes s JOIN projects p USING (project_id) JOIN (SELECT project_id, count(*) AS n FROM scopes GROUP BY 1) c USING (project_id) LEFT JOIN (SELECT scope_type, quantile_cont(markup_pct, 0.5) AS med FROM scopes GROUP BY 1) m ON s.scope_type = m.scope_type""",
)
_add("w8_contractor_names", ["projects"], reports.contractor_names, "SELECT DISTINCT gc_name FROM projects WHERE gc_name IS NOT NULL")
_add("w6_quote_numbers", ["estimates"], estimates.quote_numbers, "SELECT estimate_id, printf('CA-%d-%04d', year(created_on), row_number() OVER (PARTITION BY year(created_on) ORDER BY created_on, estimate_id)) AS quote_number FROM estimates")

# --- estimates ---
_PLAN = lambda s: s.select(F.col("project_id").alias("plan_id"), "scope_type", F.col("square_footage").alias("area_sf"), (F.col("man_days") / 13.7).alias("confidence"), "scope_id")
_PRICE = f"(SELECT *, area_sf / 1000 * md AS man_days, area_sf * (c / (1 + m)) AS mat FROM (SELECT project_id AS plan_id, scope_id, scope_type, square_footage AS area_sf, man_days / CAST(13.7 AS DOUBLE) AS confidence, {_case(estimates.COST_PER_SF, 'scope_type', 12.0)} AS c, {_case(estimates.MARKUP, 'scope_type', 0.33)} AS m, {_case(estimates.DAYS_PER_1000_SF, 'scope_type', 1.2)} AS md FROM scopes) WHERE area_sf > 0 AND confidence >= 0.3)"
_TOTAL = "(mat * (1 + m) + man_days * 725 + mat * CAST(0.075 AS DOUBLE))"
_add("z1_price_suggestions", ["scopes"], lambda s: estimates.price_suggestions(_PLAN(s)).select("scope_id", F.round("material_cost", 4).alias("material_cost"), F.round("labour_cost", 4).alias("labour_cost"), F.round("total", 4).alias("total")), f"SELECT scope_id, round(mat, 4) AS material_cost, round(man_days * 725, 4) AS labour_cost, round({_TOTAL}, 4) AS total FROM {_PRICE}")
_CONF = f"(confidence * CAST(0.6 AS DOUBLE) + CAST(0.4 AS DOUBLE) * {_case(estimates.ACCURACY, 'upper(scope_type)', 0.73)} * CASE WHEN area_sf < 100 OR area_sf > 50000 THEN CAST(0.85 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END)"
_add("z3_project_estimates", ["scopes"], lambda s: estimates.project_estimates(_PLAN(s)), f"SELECT plan_id, count(*) AS scopes, CAST(round(sum(CAST({_TOTAL} AS DECIMAL(20,8))), 2) AS DOUBLE) AS total, CAST(round(sum(CAST(man_days AS DECIMAL(20,8))), 4) AS DOUBLE) AS man_days, round(sum(area_sf), 2) AS area_sf, round(sum({_CONF} * area_sf) / sum(area_sf), 4) AS confidence FROM {_PRICE} GROUP BY 1")
_SUGGESTED = f"(SELECT plan_id, scope_type, tag, area_sf, confidence FROM {document_queries._FROM_MARKS} WHERE scope_type IS NOT NULL UNION ALL SELECT plan_id, scope_type, NULL, NULL, confidence FROM {document_queries._SAID} WHERE scope_type IS NOT NULL)"
_MERGED = f"(SELECT plan_id, min(scope_type) AS scope_type, max(confidence) AS confidence, sum(area_sf) AS area_sf FROM (SELECT *, coalesce(tag, 'row ' || row_number() OVER ()) AS one FROM {_SUGGESTED}) GROUP BY plan_id, one)"
_CHAINED = f"(SELECT *, area_sf / 1000 * md AS man_days, area_sf * (c / (1 + m)) AS mat FROM (SELECT *, {_case(estimates.COST_PER_SF, 'scope_type', 12.0)} AS c, {_case(estimates.MARKUP, 'scope_type', 0.33)} AS m, {_case(estimates.DAYS_PER_1000_SF, 'scope_type', 1.2)} AS md FROM {_MERGED}) WHERE area_sf > 0 AND confidence >= 0.3)"
_add(
    "z3_estimated_plans", ["plan_pages", "plan_marks"], plan_chain.estimated_plans,
    f"SELECT plan_id, scopes, total, man_days, area_sf, confidence, plan_confidence FROM (SELECT plan_id, count(*) AS scopes, CAST(round(sum(CAST({_TOTAL} AS DECIMAL(20,8))), 2) AS DOUBLE) AS total, CAST(round(sum(CAST(man_days AS DECIMAL(20,8))), 4) AS DOUBLE) AS man_days, round(sum(area_sf), 2) AS area_sf, round(sum({_CONF} * area_sf) / sum(area_sf), 4) AS confidence FROM {_CHAINED} GROUP BY 1) JOIN (SELECT plan_id, confidence AS plan_confidence FROM ({document_queries.PLAN_CONFIDENCE})) USING (plan_id)",
)
_SIM = "(CASE WHEN s.scope_type = t.scope_type THEN CAST(0.5 AS DOUBLE) ELSE 0 END + CAST(0.3 AS DOUBLE) / (1 + abs(ln(t.a / square_footage))))"
_add(
    "w3_comparable_projects", ["scopes"],
    lambda s: comparables.comparable_projects(s.groupBy("scope_type").agg(F.percentile("square_footage", 0.5).alias("area"), F.percentile("cost_per_unit", 0.5).alias("cost")).select(F.col("scope_type").alias("target_id"), F.col("scope_type").alias("kind"), "area", "cost"), s),
    f"SELECT target_id, rank, project_id, score FROM (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY score DESC, project_id) AS rank FROM (SELECT t.scope_type AS target_id, project_id, round(max({_SIM} + CAST(0.2 AS DOUBLE) / (1 + abs(t.k - cost_per_unit) / cost_per_unit)), 6) AS score FROM scopes s, (SELECT scope_type, quantile_cont(square_footage, 0.5) AS a, quantile_cont(cost_per_unit, 0.5) AS k FROM scopes GROUP BY 1) t WHERE square_footage > 0 GROUP BY 1, 2)) WHERE rank <= 3",
)
_MAT = "(material_cost * CAST(1.05 AS DOUBLE))"
_LINES = f"(SELECT project_id, 'material' AS line, {_MAT} AS amount FROM scopes UNION ALL SELECT project_id, 'markup', {_MAT} * coalesce(markup_pct, 0) FROM scopes UNION ALL SELECT project_id, 'labour', labor_price FROM scopes UNION ALL SELECT project_id, 'tax', ({_MAT} + {_MAT} * coalesce(markup_pct, 0)) * CAST(0.06 AS DOUBLE) FROM scopes)"
_add("z8_build_up", ["scopes"], estimates.build_up, f"SELECT project_id, line, CAST(round(sum(CAST(amount AS DECIMAL(20,8))), 2) AS DOUBLE) AS amount FROM {_LINES} GROUP BY GROUPING SETS ((project_id), (project_id, line))")
_BASE = "(material_cost * (1 + coalesce(markup_pct, 0)))"
_add("z9_universal_price", ["scopes"], estimates.universal_price, "SELECT project_id, " + ", ".join(f"CAST(round(sum(CAST({_BASE} + labor_price + {t} AS DECIMAL(20,8))), 2) AS DOUBLE) AS price_{n}" for n, t in (("flat", f"{_BASE} * CAST(0.06 AS DOUBLE)"), ("high", f"{_BASE} * CAST(0.075 AS DOUBLE)"), ("none", "0"), ("county", f"{_BASE} * CAST(0.06 AS DOUBLE) + least({_BASE} * CAST(0.015 AS DOUBLE), 5000)"))) + " FROM scopes GROUP BY 1")
_add("z11_variance", ["estimates"], estimates.variance, "SELECT estimate_id, status, round((actual_total_cost - total_estimate) * 100 / nullif(actual_total_cost, 0), 2) AS variance_pct FROM estimates")
_add(
    "z6_estimates_merged", ["scopes", "projects"], lambda s, p: links.estimates_merged(_PLAN(s), p.selectExpr("project_id AS plan_id", "CAST(floor(project_id / 4) AS BIGINT) AS project_id")),
    f"SELECT CAST(floor(plan_id / 4) AS BIGINT) AS project_id, CAST(round(sum(total), 2) AS DOUBLE) AS total, round(max(confidence), 4) AS confidence, string_agg(CAST(plan_id AS VARCHAR), ',' ORDER BY plan_id) AS plans FROM (SELECT plan_id, sum(CAST({_TOTAL} AS DECIMAL(20,8))) AS total, max(confidence) AS confidence FROM {_PRICE} GROUP BY 1) GROUP BY 1",
)
_add("z10_batch_summary", ["scopes"], lambda s: links.batch_summary(_PLAN(s)), f"SELECT plans, scopes, unsure, priced, total, confidence FROM (SELECT count(DISTINCT project_id) AS plans, count(*) AS scopes, count(*) FILTER (man_days / CAST(13.7 AS DOUBLE) < 0.3) AS unsure FROM scopes), (SELECT count(*) AS priced, CAST(round(sum(CAST({_TOTAL} AS DECIMAL(20,8))), 2) AS DOUBLE) AS total, round(avg(confidence), 4) AS confidence FROM {_PRICE})")


# --- corrections and roll-ups ---
_ITEM = ["product", "unit", "quantity", "line_no", "part_id"]
_add("j2_unnested_items", ["quote_items", "projects"], lambda q, p: edits.unnested(q.groupBy("quote_id", "project_id", "vendor").agg(F.collect_list(F.struct(*_ITEM)).alias("items")), p.filter("project_id % 4 <> 0")), "SELECT q.quote_id, q.project_id, q.vendor, product, unit, quantity, line_no, part_id, p.status FROM quote_items q LEFT JOIN projects p ON q.project_id = p.project_id AND p.project_id % 4 <> 0")
_add("j7_reclassified", ["scopes"], lambda s: edits.reclassified(s, s.filter("markup_pct is null").select("scope_id", F.lit("Other").alias("new_type"))), "SELECT scope_type, CAST(sum(b) AS BIGINT) AS before, CAST(sum(a) AS BIGINT) AS after FROM (SELECT scope_type, 1 AS b, 0 AS a FROM scopes UNION ALL SELECT CASE WHEN markup_pct IS NULL THEN 'Other' ELSE scope_type END, 0, 1 FROM scopes) GROUP BY 1")
_add("j8_dates_filled", ["projects", "quote_items"], lambda p, q: edits.dates_filled(p, q.select("project_id", F.col("quote_date").alias("found_date"))), "SELECT p.project_id, p.quote_date AS old_date, f.found_date FROM projects p JOIN (SELECT project_id, min(quote_date) AS found_date FROM quote_items GROUP BY 1) f USING (project_id) WHERE p.quote_date IS DISTINCT FROM f.found_date")
_add("a17_estimate_roll_up", ["estimates", "scopes"], edits.estimate_roll_up, "SELECT e.estimate_id, round(area, 2) AS area, round(CASE WHEN days > 0 THEN days END, 4) AS man_days, CAST(round(CAST(CASE WHEN area > 0 THEN total_estimate / area END AS DECIMAL(20,8)), 4) AS DOUBLE) AS cost_per_sf FROM estimates e LEFT JOIN (SELECT project_id, sum(square_footage) AS area, sum(man_days) AS days FROM scopes GROUP BY 1) s ON e.estimate_id = s.project_id")
_add("a18_readiness_flags", ["estimates", "scopes"], edits.readiness_flags, "SELECT e.estimate_id, coalesce(has_area, false) AS has_area, coalesce(types, 0) AS types, coalesce(status IN ('reviewed', 'finalized', 'exported'), false) AS reviewed FROM estimates e LEFT JOIN (SELECT project_id, bool_or(coalesce(square_footage > 0, false)) AS has_area, count(DISTINCT scope_type) AS types FROM scopes GROUP BY 1) s ON e.estimate_id = s.project_id")
_add("a22_retrain_trigger", ["estimates"], lambda e: edits.retrain_trigger(e, "2001-01-01"), "SELECT actuals, fresh, reason = 'retrain' AS retrain, reason FROM (SELECT *, CASE WHEN actuals < 5 THEN 'too few actuals' WHEN fresh < 3 THEN 'too few new actuals' ELSE 'retrain' END AS reason FROM (SELECT count(actual_total_cost) AS actuals, count(actual_total_cost) FILTER (created_on >= DATE '2001-01-01') AS fresh FROM estimates))")
_add("w5_nearest_area", ["scopes"], lambda s: comparables.nearest_area(s, s.groupBy(F.col("scope_type").alias("kind")).agg(F.percentile("square_footage", 0.5).alias("area"))), "SELECT kind, project_id, off, rank FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY off, project_id) AS rank FROM (SELECT s.scope_type AS kind, project_id, min(abs(square_footage - m)) AS off FROM scopes s JOIN (SELECT scope_type, quantile_cont(square_footage, 0.5) AS m FROM scopes GROUP BY 1) t USING (scope_type) WHERE square_footage > 0 GROUP BY 1, 2)) WHERE rank <= 3")
_add("w7_page", ["projects"], lambda p: edits.page(p, "HOSPITAL", (2021, 2024), 20, 20), "SELECT project_id, name, quote_date FROM projects WHERE contains(lower(name), 'hospital') AND year(quote_date) BETWEEN 2021 AND 2024 ORDER BY created_on DESC, project_id LIMIT 20 OFFSET 20")
_add("w10_first_seen", ["quote_items"], edits.first_seen, "SELECT vendor, string_agg(product, '|' ORDER BY k) AS products FROM (SELECT vendor, product, row_number() OVER (PARTITION BY vendor ORDER BY seen) AS k FROM (SELECT vendor, product, min((quote_date, quote_id, line_no, product)) AS seen FROM quote_items WHERE vendor IS NOT NULL GROUP BY 1, 2)) WHERE k <= 5 GROUP BY 1")
_add("z7_edited", ["scopes"], lambda s: edits.edited(s, s.filter("project_id % 5 = 0").select("scope_id", F.lit(0.25).alias("new_markup"), F.when(F.col("square_footage").isNull(), 3.0).alias("new_days"))), "SELECT project_id, CAST(round(sum(CAST(material_cost * (1 + CASE WHEN project_id % 5 = 0 THEN CAST(0.25 AS DOUBLE) ELSE coalesce(markup_pct, 0) END) + CASE WHEN project_id % 5 = 0 AND square_footage IS NULL THEN 3 ELSE man_days END * coalesce(daily_labor_rate, 725) AS DECIMAL(20,8))), 2) AS DOUBLE) AS total FROM scopes GROUP BY 1")
_KEEP = " OR ".join(f"(scope_type = '{k}' AND t BETWEEN {a} AND {3 * b})" for k, (a, b) in prices.BOUNDS.items() if k not in ("SM", "Other"))
_add("h3_training_rows", ["scopes"], lambda s: edits.training_rows(s, prices.BOUNDS), f"SELECT scope_type, count(*) AS n, round(avg(t), 4) AS mean FROM (SELECT scope_type, total / square_footage AS t FROM scopes WHERE square_footage > 0) WHERE t > 0 AND ({_KEEP}) GROUP BY 1")
_TYPO = lambda: F.when(F.col("part_id") % 3 == 0, F.upper("product")).when(F.col("part_id") % 3 == 1, F.concat(F.col("product"), F.lit("x"))).otherwise(F.reverse("product"))
_add("n1_product_names", ["quote_items"], lambda q: products.match(q.select(_TYPO().alias("name")), q.groupBy("product").agg(F.min("part_id").alias("position")).select(F.col("product").alias("alias"), F.col("product").alias("canonical"), "position")), None)
_add("n4_linked_products", ["quote_items"], lambda q: products.linked(q.select(_TYPO().alias("name")), q.groupBy("product").agg(F.min("part_id").alias("position")).select(F.col("product").alias("alias"), F.col("product").alias("canonical"), "position")), None)

_ALIASES = lambda q: q.groupBy("product").agg(F.min("part_id").alias("position")).select(F.col("product").alias("alias"), F.col("product").alias("canonical"), "position")
_SPELT = "CASE part_id % 3 WHEN 0 THEN upper(product) WHEN 1 THEN product || 'x' ELSE 'zq ' || product || ' yw' END"
_LIKE = "CASE part_id % 3 WHEN 0 THEN 1.0 WHEN 1 THEN round(200.0 * length(product) / (2 * length(product) + 1) / 100, 4) ELSE round(200.0 * length(product) / (2 * length(product) + 6) / 100, 4) END"
_add("n1_spelt_names", ["quote_items"], lambda q: products.match(q.selectExpr(f"{_SPELT} AS name"), _ALIASES(q)), f"SELECT DISTINCT {_SPELT} AS name, CASE WHEN {_LIKE} >= 0.75 THEN product END AS canonical, CASE WHEN {_LIKE} >= 0.75 THEN CAST({_LIKE} AS DOUBLE) END AS score FROM quote_items")
_LINKED = "CASE part_id % 3 WHEN 0 THEN upper(product) || ' on wall' WHEN 1 THEN 'qqqq zzzz ON ' || product ELSE 'wwwww' END"
_add("n4_match_rate", ["quote_items"], lambda q: products.match_rate(products.linked(q.selectExpr(f"{_LINKED} AS name"), _ALIASES(q))), f"SELECT count(*) AS names, count(*) FILTER (name <> 'wwwww') AS linked, round(count(*) FILTER (name <> 'wwwww') * 100.0 / count(*), 1) AS pct FROM (SELECT DISTINCT {_LINKED} AS name FROM quote_items)")


# --- models ---
_add("m2_cross_validation", ["scopes", "projects"], lambda s, p: models.error_report(models.cross_validated(models.training_table(reports.features(s, p), s).filter("scope_type not in ('SM', 'Other')"))), None)
_add(
    "m8_deployment", ["estimates"],
    lambda e: models.deployment(*[e.filter(f"actual_total_cost > 0 and status is not null and {w}").groupBy(F.col("status").alias("family")).agg(parse.to_places(F.avg(F.abs(F.col("total_estimate") - F.col("actual_total_cost")) / F.col("actual_total_cost")), 6).alias("mape")) for w in ("created_on >= date'1998-01-01'", "created_on < date'1998-01-01' and status <> 'draft'")]),
    "SELECT n.family, o.mape AS old_mape, n.mape AS new_mape, o.mape IS NULL OR n.mape <= o.mape * CAST(1.05 AS DOUBLE) AS deploy, CASE WHEN o.mape IS NULL THEN 'no model before' WHEN n.mape <= o.mape * CAST(1.05 AS DOUBLE) THEN 'within tolerance' ELSE 'worse than before' END AS reason FROM "
    + " LEFT JOIN ".join(f"(SELECT status AS family, CAST(round(CAST(avg(abs(total_estimate - actual_total_cost) / actual_total_cost) AS DECIMAL(20,8)), 6) AS DOUBLE) AS mape FROM estimates WHERE actual_total_cost > 0 AND status IS NOT NULL AND {w} GROUP BY 1) {t}" for t, w in (("n", "created_on >= DATE '1998-01-01'"), ("o", "created_on < DATE '1998-01-01' AND status <> 'draft'"))) + " USING (family)",
)


state_queries.share_sql("w1_alerts_of_batches", "w1_price_alerts")
state_queries.share_sql("a11_summary_of_batches", "a11_vendor_price_summary")


def queries() -> dict[str, Query]:
    return {name: run for name, (run, _) in FOUND.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in FOUND.items() if sql}

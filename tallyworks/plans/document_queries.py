"""Queries over the texts of quotes and plans, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import classify, text
from ..operators import plan_pages, quotes
from .registry import add, quoted


def _group(c: str, pattern: str, i: int = 1) -> str:
    return f"nullif(regexp_extract({c}, {quoted(pattern)}, {i}), '')"


def _first(c: str, patterns: list[str]) -> str:
    return "coalesce(" + ", ".join(_group(c, p) for p in patterns) + ", NULL)"


def _amount(c: str) -> str:
    return f"CAST(TRY_CAST(replace({c}, ',', '') AS DECIMAL(18,4)) AS DOUBLE)"


def _chain(pairs: list[tuple[str, str]], other: str = "NULL") -> str:
    return "CASE " + " ".join(f"WHEN {w} THEN {t}" for w, t in pairs) + f" ELSE {other} END"


# --- quotes ---
_TEMPLATE = _chain([(f"contains(upper(text), {quoted(w)})", quoted(t)) for w, t in quotes.TEMPLATES.items()] + [(f"{_group('text', quotes.NUMBER)} IS NOT NULL", "'T-004A'")])
add("x1_quote_headers", ["quote_texts"], quotes.headers, f"SELECT doc_id, {_group('text', quotes.NUMBER)} AS number, {_group(f'regexp_extract(text, {quoted(quotes.NUMBER)}, 1)', '-(R[0-9]+)$')} AS revision, {_first('text', quotes.DATES)} AS dated, {_TEMPLATE} AS template, upper({_first('text', quotes.TERMS)}) AS terms FROM quote_texts")
_TAIL = f"regexp_extract(regexp_replace(regexp_extract(text, {quoted(quotes.BEFORE_NUMBER)}, 1), '[^\\n]*$', ''), {quoted(quotes.LAST_LINES)}, 1)"
_TOTAL = _amount(f"coalesce({_first('text', quotes.TOTALS)}, list_extract(regexp_extract_all({_TAIL}, {quoted(quotes.AMOUNT_LINE)}, 1), -1))")
_SUB = lambda w: _amount(f"regexp_extract(list_filter(string_split(text, chr(10)), lambda x: contains(upper(x), '{w}') AND contains(upper(x), 'SUBTOTAL') AND regexp_matches(x, {quoted(quotes.AMOUNT)}))[1], {quoted(quotes.AMOUNT)}, 1)")
add("x2_quote_totals", ["quote_texts"], quotes.totals, f"SELECT doc_id, {_SUB('MATERIAL')} AS material, {_SUB('LABOR')} AS labour, {_SUB('TAX')} AS tax, {_TOTAL} AS grand_total FROM quote_texts")
_SECTION = f"coalesce({_first('text', quotes.SECTIONS)}, '')"
_ROWS = f"(SELECT doc_id, string_split({_SECTION}, chr(10)) AS lines FROM quote_texts)"
_PICKED = f"(SELECT doc_id, len(s) > 0 AS good, CASE WHEN len(s) > 0 THEN s ELSE l END AS picked FROM (SELECT doc_id, list_filter(lines, lambda x: regexp_matches(x, {quoted(quotes.STRICT)})) AS s, list_filter(lines, lambda x: regexp_matches(x, {quoted(quotes.LOOSE)})) AS l FROM {_ROWS}))"
_P = lambda i: f"CASE WHEN good THEN regexp_extract(line, {quoted(quotes.STRICT)}, {i}) ELSE regexp_extract(line, {quoted(quotes.LOOSE)}, {i}) END"
add(
    "x3_quote_items", ["quote_texts"], quotes.items,
    f"SELECT doc_id, CAST(position AS INT) AS position, CAST({_P(1)} AS DOUBLE) AS quantity, CASE WHEN good THEN upper({_P(2)}) ELSE {_P(2)} END AS item_type, trim({_P(3)}) AS description, {_amount(_P(4))} AS unit_cost, {_amount(_P(5))} AS total FROM (SELECT doc_id, good, unnest(picked) AS line, unnest(range(1, len(picked) + 1)) AS position FROM {_PICKED})",
)
_ANY = f"len(list_filter(string_split({_SECTION}, chr(10)), lambda x: regexp_matches(x, {quoted(quotes.STRICT)}) OR regexp_matches(x, {quoted(quotes.LOOSE)}))) > 0"
add("x4_quote_confidence", ["quote_texts"], quotes.confidence, f"SELECT doc_id, CAST(CASE WHEN {_group('text', quotes.NUMBER)} IS NOT NULL THEN 30 ELSE 0 END + CASE WHEN {_first('text', quotes.DATES)} IS NOT NULL THEN 20 ELSE 0 END + CASE WHEN {_TOTAL} <> 0 THEN 30 ELSE 0 END + CASE WHEN {_ANY} THEN 20 ELSE 0 END AS DOUBLE) / 100 AS confidence FROM quote_texts")
_KEYS = sorted(text.VENDORS, key=lambda k: -len(k))
_VENDOR = lambda c, f: _chain([(f"contains(lower({p}), {quoted(k.lower())})", quoted(text.VENDORS[k])) for p in (f"({c})[1:500]", f) for k in _KEYS])
_NUMBERS = ", ".join(f"CASE WHEN NOT regexp_matches(regexp_extract(text, {quoted(p)}, 1), '[a-z]{{5,}}') THEN {_group('text', p)} END" for p in quotes.VENDOR_NUMBERS)
_HAS = f"len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, {quoted(quotes.VENDOR_ROW)}))) > 0"
_LABELLED = {n: _amount(_group("text", quotes.after_label(ls))) for n, ls in quotes.LABELS.items()}
add(
    "x5_vendor_fields", ["vendor_texts"], quotes.vendor_fields,
    f"SELECT doc_id, {_VENDOR('text', 'file_name')} AS vendor, coalesce({_NUMBERS}) AS number, {_first('text', quotes.VENDOR_DATES)} AS dated, {_group('text', quotes.LEAD_TIME)} AS lead_time, " + ", ".join(f"{v} AS {n}" for n, v in _LABELLED.items())
    + f", CAST(CASE WHEN length(text) < 50 THEN 0.1 WHEN NOT {_HAS} THEN 0.3 WHEN {_LABELLED['grand_total']} IS NOT NULL THEN 0.75 ELSE 0.5 END AS DOUBLE) AS confidence FROM vendor_texts",
)
_V = lambda i: f"regexp_extract(line, {quoted(quotes.VENDOR_ROW)}, {i})"
add("x6_vendor_items", ["vendor_texts"], quotes.vendor_items, f"SELECT doc_id, CAST(position AS INT) AS position, nullif({_V(1)}, '') AS sku, trim({_V(2)}) AS product, CAST({_V(3)} AS DOUBLE) AS quantity, upper({_V(4)}) AS unit, {_amount(_V(5))} AS unit_cost, {_amount(_V(6))} AS total FROM (SELECT doc_id, unnest(picked) AS line, unnest(range(1, len(picked) + 1)) AS position FROM (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, {quoted(quotes.VENDOR_ROW)})) AS picked FROM vendor_texts))")
_RATES = f"(SELECT count(*) AS quotes, count({_group('text', quotes.NUMBER)}) AS number, count({_first('text', quotes.DATES)}) AS dated, count({_TOTAL}) AS grand_total FROM quote_texts)"
add("x16_field_rates", ["quote_texts"], quotes.field_rates, " UNION ALL ".join(f"SELECT '{c}' AS field, {c} AS found, quotes, round({c} * 100.0 / quotes, 1) AS pct, round({c} * 100.0 / quotes, 1) >= 95 AS accepted FROM {_RATES}" for c in ("number", "dated", "grand_total")))

# --- scalar functions of texts ---
add("f8_vendor", ["vendor_texts"], lambda v: v.groupBy(text.vendor(F.col("text"), F.col("file_name")).alias("vendor")).agg(F.count("*").alias("n")), f"SELECT {_VENDOR('text', 'file_name')} AS vendor, count(*) AS n FROM vendor_texts GROUP BY 1")
_HEIGHT = lambda i: f"CAST({_group('text', text.HEIGHT, i)} AS INT)"
_GRIDS = "CASE regexp_replace(lower(g), '\\s+', '', 'g') " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in text.GRIDS.items()) + " ELSE lower(g) END"
add(
    "f18_heights_and_grids", ["plan_pages"], lambda p: p.select("o_orderkey", text.height(F.col("text")).alias("height"), text.grid(F.col("text")).alias("grid")),
    f"SELECT o_orderkey, CASE WHEN h1 IS NOT NULL THEN printf('%d''-%d\"', h1, h2) WHEN h3 IS NOT NULL THEN printf('%d''-0\"', h3) WHEN h4 IS NOT NULL THEN printf('%d''-%d\"', h4 // 12, h4 % 12) END AS height, {_GRIDS} AS grid FROM (SELECT o_orderkey, {_HEIGHT(1)} AS h1, {_HEIGHT(2)} AS h2, {_HEIGHT(3)} AS h3, {_HEIGHT(4)} AS h4, {_group('text', text.GRID)} AS g FROM plan_pages)",
)
_COLOUR = "CASE colour WHEN '#ff0000' THEN 'ACT' WHEN '#0000ff' THEN 'AWP' WHEN '#00ff00' THEN 'FW' WHEN '#ffa500' THEN 'Baffles' END"
add("f16_colour_scope", ["plan_marks"], lambda m: m.select("mark_id", classify.colour_scope(F.col("colour")).alias("hint")), f"SELECT mark_id, {_COLOUR} AS hint FROM plan_marks")
_L = "lower(concat_ws(' ', product_name, scope_type))"
_TIERS = _chain([("(" + " OR ".join(f"contains({_L}, '{w}')" for w in ws) + ")", str(t)) for t, ws in text.LABOUR_TIER_KEYWORDS.items()] + [(f"scope_type = '{k}'", str(t)) for k, t in text.LABOUR_TIER_BY_TYPE.items()], "1")
add("f11_labour_tier", ["scopes"], lambda s: s.groupBy("scope_type", text.labour_tier(F.col("product_name"), F.col("scope_type")).alias("tier")).agg(F.count("*").alias("n")), f"SELECT scope_type, {_TIERS} AS tier, count(*) AS n FROM scopes GROUP BY 1, 2")
_RULES = "[" + ", ".join(f"{{'kind': '{k}', 'word': '{w}'}}" for k, ws in text.PROJECT_TYPE_KEYWORDS.items() for w in ws) + "]"
_KIND = lambda c: f"list_filter({_RULES}, lambda r: contains(lower(coalesce({c}, '')), r.word))[1]"
_TYPED = f"(SELECT *, CASE WHEN a IS NOT NULL THEN a.kind WHEN b IS NOT NULL THEN b.kind ELSE 'other' END AS kind, CASE WHEN a IS NOT NULL THEN 'name: ' || a.word WHEN b IS NOT NULL THEN 'contractor: ' || b.word ELSE 'no keyword' END AS reason FROM (SELECT project_id, project_type, {_KIND('name')} AS a, {_KIND('gc_name')} AS b FROM projects))"
add("f13_project_type", ["projects"], lambda p: p.select("project_id", text.project_type(F.col("name"), F.col("gc_name")).alias("t")).select("project_id", "t.kind", "t.reason"), f"SELECT project_id, kind, reason FROM {_TYPED}")
add("f14_types_filled", ["projects"], lambda p: p.select(F.col("project_type").isNull().alias("filled"), F.coalesce("project_type", text.project_type(F.col("name"), F.col("gc_name"))["kind"]).alias("kind")).groupBy("filled", "kind").agg(F.count("*").alias("n")), f"SELECT project_type IS NULL AS filled, coalesce(project_type, kind) AS kind, count(*) AS n FROM {_TYPED} GROUP BY 1, 2")
_AS = "TRY_CAST(lpad({y}, 4, '0') || '-' || lpad({m}, 2, '0') || '-' || lpad({d}, 2, '0') AS DATE)"
_G = lambda p, i: f"regexp_extract(date_text, {quoted(p)}, {i})"
_M = f"CAST(list_position(['jan','feb','mar','apr','may','jun','jul','aug','sep','oct','nov','dec'], lower({_G(text.NAME_DATE, 1)})) AS VARCHAR)"
_DATED = "coalesce(" + ", ".join([_AS.format(y=_G(text.US_DATE, 3), m=_G(text.US_DATE, 1), d=_G(text.US_DATE, 2)), _AS.format(y=f"('20' || {_G(text.US_SHORT, 3)})", m=_G(text.US_SHORT, 1), d=_G(text.US_SHORT, 2)), _AS.format(y=_G(text.ISO_DATE, 1), m=_G(text.ISO_DATE, 2), d=_G(text.ISO_DATE, 3)), _AS.format(y=_G(text.NAME_DATE, 3), m=_M, d=_G(text.NAME_DATE, 2))]) + ")"
add("f2_back_fill_date", ["raw_fields"], lambda r: r.select("row_id", text.document_date(F.col("date_text")).alias("dated")), f"SELECT row_id, nullif({_DATED}, DATE '2024-02-29') AS dated FROM raw_fields")
add("f3_vendor_date", ["raw_fields"], lambda r: r.select("row_id", text.document_date(F.col("date_text"), placeholder=False).alias("dated")), f"SELECT row_id, {_DATED} AS dated FROM raw_fields")
_R = lambda p: f"regexp_matches(path, {quoted(p)})"
_PATH = _chain([(_R(r"(^|/)~\$"), "NULL"), (f"NOT {_R(text.ARCHIVED)} AND {_R('(?i)[.]xlsx$')} AND NOT {_R(text.NOT_BUILD_UP)}", "'build_up'"), (_R(text.OWN_QUOTE), "'own_quote'"), (f"NOT {_R(text.ARCHIVED)} AND {_R(text.VENDOR_FILE)}", "'vendor_quote'"), (f"{_R(text.DRAWING_FILE)} AND NOT {_R(text.NOT_DRAWING)}", "'drawing'")])
add("s8_path_kinds", ["raw_fields"], lambda r: r.groupBy(text.path_kind(F.col("path")).alias("kind")).agg(F.count("*").alias("n")), f"SELECT {_PATH} AS kind, count(*) AS n FROM raw_fields GROUP BY 1")

# --- plans ---
_T = "regexp_replace(text, '^\\s+|\\s+$', '', 'g')"
_PAGE = _chain([("page_no = 1", "'cover'")] + [("(" + " OR ".join(f"contains(upper(text), '{w}')" for w in ws) + ")", f"'{k}'") for k, ws in plan_pages.PAGE_KINDS.items()], "'unknown'")
add("x7_page_kinds", ["plan_pages"], plan_pages.classified, f"SELECT plan_id, page_no, {_PAGE} AS kind, length({_T}) > 50 AS rich, CAST(CASE WHEN {_T} = '' THEN 0 ELSE len(regexp_split_to_array({_T}, '\\s+')) END AS INT) AS words, regexp_matches({_T}, {quoted(plan_pages.DIMENSION)}) AS dimensions FROM plan_pages")
_MARKS = f"(SELECT *, CASE WHEN area_sf <> 0 THEN 'polygon' WHEN length_lf <> 0 THEN 'measurement' ELSE 'text' END AS kind FROM (SELECT plan_id, page_no, mark_id, colour, coalesce(nullif(content, ''), nullif(subject, ''), title, '')[1:200] AS label, {_amount(_group('content', plan_pages.AREA))} AS area_sf, {_amount(_group('content', plan_pages.LENGTH))} AS length_lf FROM plan_marks))"
add("x8_parsed_marks", ["plan_marks"], plan_pages.parsed_marks, f"SELECT * FROM {_MARKS}")
_FEET = lambda c: f"CASE WHEN {c} LIKE '%\"' THEN CAST(split_part({c}, chr(39), 1) AS DOUBLE) + CAST(regexp_extract({c}, '([0-9.]+)\"$', 1) AS DOUBLE) / 12 ELSE CAST(replace({c}, chr(39), '') AS DOUBLE) END"
_LABELS = f"(SELECT plan_id, sum(a) AS l, count(*) AS n FROM (SELECT DISTINCT plan_id, a FROM (SELECT plan_id, TRY_CAST(replace(unnest(regexp_extract_all(text, {quoted(plan_pages.AREA_LABEL)}, 1)), ',', '') AS DECIMAL(18,4)) AS a FROM plan_pages) WHERE a BETWEEN 10 AND 500000) GROUP BY 1)"
_SIDES = f"(SELECT plan_id, sum(round(CAST(a * b AS DECIMAL(18,4)), 2)) AS s FROM (SELECT plan_id, {_FEET('trim(x)')} AS a, {_FEET('trim(y)')} AS b FROM (SELECT plan_id, unnest(regexp_extract_all(text, {quoted(plan_pages.SIDES)}, 1)) AS x, unnest(regexp_extract_all(text, {quoted(plan_pages.SIDES)}, 2)) AS y FROM plan_pages)) WHERE a BETWEEN 4 AND 500 AND b BETWEEN 4 AND 500 AND a * b >= 20 GROUP BY 1)"
add(
    "x12_plan_areas", ["plan_pages", "plan_marks"], plan_pages.areas,
    "SELECT plan_id, CASE WHEN m > 0 THEN 'marks' WHEN n > 0 THEN 'labels' WHEN s > 0 THEN 'sides' ELSE 'none' END AS source, CASE WHEN m > 0 THEN m WHEN n > 0 THEN CAST(l AS DOUBLE) WHEN s > 0 THEN CAST(s AS DOUBLE) END AS area_sf, CAST(CASE WHEN m > 0 THEN 0.95 WHEN n > 1 THEN 0.7 WHEN n > 0 THEN 0.6 WHEN s > 0 THEN 0.4 ELSE 0 END AS DOUBLE) AS confidence "
    f"FROM (SELECT plan_id FROM plan_pages UNION SELECT plan_id FROM {_MARKS} WHERE area_sf IS NOT NULL) LEFT JOIN (SELECT plan_id, CAST(sum(CAST(area_sf AS DECIMAL(18,4))) AS DOUBLE) AS m FROM {_MARKS} GROUP BY 1) USING (plan_id) LEFT JOIN {_LABELS} USING (plan_id) LEFT JOIN {_SIDES} USING (plan_id)",
)
_TAGGED = f"(SELECT *, CASE WHEN kind <> 'text' THEN {_group('label', plan_pages.TAG)} END AS tag FROM {_MARKS} WHERE label <> '')"
_ALIAS = "CASE split_part(tag, '-', 1) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in plan_pages.TYPE_ALIASES.items()) + " ELSE split_part(tag, '-', 1) END"
_FROM_MARKS = f"(SELECT plan_id, CASE WHEN tag IS NOT NULL THEN {_ALIAS} ELSE {_COLOUR} END AS scope_type, tag, area_sf, length_lf, CAST(CASE WHEN tag IS NOT NULL THEN 0.95 ELSE 0.7 END AS DOUBLE) AS confidence, CASE WHEN tag IS NOT NULL THEN 'tag' ELSE 'colour' END AS source FROM {_TAGGED})"
_IN_SECTION = "CASE regexp_replace(d, '[^0-9]', '', 'g') " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in plan_pages.SECTIONS.items()) + " END"
_SAID = f"(SELECT DISTINCT plan_id, {_IN_SECTION} AS scope_type, CAST(0.65 AS DOUBLE) AS confidence, 'section' AS source FROM (SELECT plan_id, unnest(regexp_extract_all(text, {quoted(plan_pages.SECTION)}, 1)) AS d FROM plan_pages)" + "".join(f" UNION ALL SELECT DISTINCT plan_id, '{k}', CAST(0.5 AS DOUBLE), 'keyword' FROM plan_pages WHERE regexp_matches(text, {quoted(p)})" for k, p in plan_pages.KEYWORDS.items()) + ")"
add("x13_suggested_scopes", ["plan_pages", "plan_marks"], plan_pages.suggested, f"SELECT * FROM {_FROM_MARKS} WHERE scope_type IS NOT NULL UNION ALL SELECT plan_id, scope_type, NULL, NULL, NULL, confidence, source FROM {_SAID} WHERE scope_type IS NOT NULL")
_NUMBERED = "(SELECT *, coalesce(scope_tag, scope_type || '-' || CAST(top + k AS VARCHAR)) AS tag FROM (SELECT *, coalesce(max(CAST(split_part(scope_tag, '-', 2) AS INT)) OVER (PARTITION BY plan_id, scope_type), 0) AS top, row_number() OVER (PARTITION BY plan_id, scope_type, scope_tag IS NULL ORDER BY seq) AS k FROM suggestions))"
add(
    "x14_merged_suggestions", ["suggestions"], plan_pages.merged,
    f"SELECT a.plan_id, a.tag, scope_type, confidence, area_sf, product, rooms FROM (SELECT plan_id, tag, min_by(scope_type, seq) AS scope_type, max(confidence) AS confidence, sum(area_sf) AS area_sf, min_by(product_hint, seq) FILTER (product_hint IS NOT NULL) AS product FROM {_NUMBERED} GROUP BY 1, 2) a JOIN (SELECT plan_id, tag, string_agg(room, '|' ORDER BY seen) AS rooms FROM (SELECT plan_id, tag, room, min(seq) AS seen FROM {_NUMBERED} GROUP BY 1, 2, 3) GROUP BY 1, 2) b ON a.plan_id = b.plan_id AND a.tag = b.tag",
)
PLAN_CONFIDENCE = f"SELECT plan_id, CAST(CASE WHEN bool_or(m) THEN 1 WHEN bool_or(r) THEN 0.6 ELSE 0.3 END AS DOUBLE) AS confidence FROM (SELECT plan_id, false AS m, length(trim(text)) > 50 AS r FROM plan_pages UNION ALL SELECT plan_id, kind = 'polygon', false FROM {_MARKS}) GROUP BY 1"
add("x15_plan_confidence", ["plan_pages", "plan_marks"], plan_pages.plan_confidence, PLAN_CONFIDENCE)

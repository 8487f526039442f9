"""Queries of loads that commit, files by their metadata, and state that batches are merged into, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import increments, sketches
from ..operators.ranges import kept, shared_folder
from ..sources import project_files
from ..sources.snapshots import Snapshots
from .registry import FOUND, add


def _table(some: DataFrame, name: str, keys: list[str], schema: str) -> Snapshots:
    return Snapshots(some.sparkSession, f"{shared_folder(some.sparkSession)}/{name}-{uuid.uuid4().hex}", keys, schema, buckets=16)


# --- loads ---
_JOB = "CASE WHEN project_id % 20 = 0 THEN NULL ELSE 'Job ' || project_id END"


def _projects(p: DataFrame) -> DataFrame:
    """All projects are loaded, then those that are no longer bidding again with other values; a name and a status that were there stay."""
    rows = p.selectExpr(f"{_JOB} AS folder", "project_id AS id", "status", "gc_name").filter("folder is not null")
    again = rows.filter("status <> 'bidding'").withColumns({"id": -F.col("id"), "status": F.lit("reloaded"), "gc_name": F.concat(F.coalesce("gc_name", F.lit("none")), F.lit(" anew"))})
    t = _table(p, "projects", ["folder"], "folder string, id long, status string, gc_name string")
    t.upsert("first", rows)
    t.replace("second", again, ["id", "status"])
    t.replace("second", again.withColumn("gc_name", F.lit("never")), ["id", "status"])  # a load that has been done is skipped
    return t.read()


add("s9_projects_committed", ["projects"], _projects, f"SELECT {_JOB} AS folder, project_id AS id, status, CASE WHEN status <> 'bidding' THEN coalesce(gc_name, 'none') || ' anew' ELSE gc_name END AS gc_name FROM projects WHERE project_id % 20 <> 0")


def _children(s: DataFrame, p: DataFrame) -> DataFrame:
    """Scopes are loaded; then projects that are completed get theirs anew, without those of a high markup."""
    own = ["scope_id", "project_id", "scope_type"]
    t = _table(s, "scopes", ["project_id"], "scope_id string, project_id long, scope_type string")
    t.append("first", s.select(*own))
    done = p.filter("status = 'completed'").select("project_id")
    t.replace_children("second", s.filter("markup_pct < 0.3").join(done, "project_id", "left_semi").select("scope_id", "project_id", F.lit("reloaded").alias("scope_type")), done)
    return t.read()


add("s9_children_committed", ["scopes", "projects"], _children, "SELECT scope_id, s.project_id, CASE WHEN status = 'completed' THEN 'reloaded' ELSE scope_type END AS scope_type FROM scopes s JOIN projects p ON s.project_id = p.project_id WHERE status <> 'completed' OR markup_pct < 0.3")


def _products(q: DataFrame) -> DataFrame:
    """Products by name and unit, null unit equal to null: old prices, then those of 2025 and later."""
    rows = q.withColumn("unit", F.when(F.trim("unit") != "EA", F.col("unit"))).groupBy("product", "unit", (F.year("quote_date") >= 2025).alias("late")).agg(F.max("item_total").alias("price"))
    t = _table(q, "products", ["product", "unit"], "product string, unit string, price double")
    t.upsert("old", rows.filter("not late").select("product", "unit", "price"))
    t.upsert("new", rows.filter("late").select("product", "unit", "price"))
    return t.read()


add("s12_products_committed", ["quote_items"], _products, "SELECT product, CASE WHEN trim(unit) <> 'EA' THEN unit END AS unit, coalesce(max(item_total) FILTER (year(quote_date) >= 2025), max(item_total)) AS price FROM quote_items GROUP BY 1, 2")

# --- files ---
_FOLDER = "CASE WHEN project_id % 11 = 0 THEN '  ' WHEN project_id % 3 = 0 THEN 'Job ' || project_id || ' ' ELSE 'Job ' || project_id END"
_DISK = "CASE WHEN project_id % 4 = 0 THEN '+' ELSE '' END || 'Job ' || project_id"
_NAME = "CASE line_no WHEN 1 THEN 'Plan.pdf' WHEN 2 THEN 'Quote 12.pdf' WHEN 3 THEN 'Buildup ' || month(quote_date) || '.' || day(quote_date) || '.' || (year(quote_date) % 100) || '.xlsx' WHEN 4 THEN 'Buildup.XLSX' WHEN 5 THEN '~$Buildup.xlsx' WHEN 6 THEN 'b 13_31_2025.xlsx' ELSE 'quotes/old.pdf' END"
_FILES = f"SELECT '/itb/' || {_DISK} || '/' || {_NAME} AS path, CAST(quote_date AS TIMESTAMP) AS modified FROM quote_items WHERE part_id % 3 > 0 OR line_no > 3"
_QUOTED = "CASE WHEN month(quote_date) = 2 THEN DATE '2024-02-29' ELSE quote_date END"
_SAID = f"SELECT 'Job ' || project_id AS folder, {_QUOTED} AS dated FROM quote_items WHERE line_no = 7"
_OWN = "CASE WHEN status = 'bidding' THEN NULL WHEN status = 'quoted' THEN DATE '2024-02-29' ELSE quote_date END"
_WHO = "SELECT 'Job ' || project_id AS folder, CASE WHEN length(name) % 2 = 0 THEN ' ' || name || ' ' ELSE '' END AS gc_name FROM projects"


def _enriched(p: DataFrame, q: DataFrame) -> DataFrame:
    # Files and quotes are both made of the items, projects and contractors of the projects: each is joined once.
    q, p = kept(q.select("project_id", "part_id", "line_no", "quote_date"), "items"), kept(p.select("project_id", "name", "status", "quote_date", "gc_name"), "projects")
    files = q.filter("part_id % 3 > 0 or line_no > 3").selectExpr(f"'/itb/' || {_DISK} || '/' || {_NAME} AS path", "CAST(quote_date AS TIMESTAMP) AS modified")
    said = q.filter("line_no = 7").selectExpr("'Job ' || project_id AS folder", f"{_QUOTED} AS dated")
    who = p.selectExpr("'Job ' || project_id AS folder", "CASE WHEN length(name) % 2 = 0 THEN ' ' || name || ' ' ELSE '' END AS gc_name")
    return project_files.enriched(p.selectExpr("project_id", f"{_FOLDER} AS folder", f"{_OWN} AS quote_date", "gc_name"), said, project_files.in_folders(files, "/itb"), who)


_PARTS = r"(\d{1,2})[._](\d{1,2})[._](\d{2,4})"
_RX = lambda i: f"TRY_CAST(regexp_extract(name, '{_PARTS}', {i}) AS INT)"
_YEAR = f"CASE WHEN {_RX(3)} < 100 THEN {_RX(3)} + 2000 ELSE {_RX(3)} END"
_CHAIN = f"""WITH f AS (SELECT split_part(path, '/', 3) AS folder, split_part(path, '/', 4) AS name, CAST(modified AS DATE) AS day FROM ({_FILES}) WHERE len(string_split(path, '/')) = 4),
    d AS (SELECT folder, min(day) FILTER (lower(name) LIKE 'quote%.pdf') AS quote_pdf_mtime,
        min(CASE WHEN {_YEAR} BETWEEN 2019 AND 2027 THEN TRY_CAST(printf('%04d-%02d-%02d', {_YEAR}, {_RX(1)}, {_RX(2)}) AS DATE) END) FILTER (lower(name) LIKE '%.xlsx' AND regexp_matches(name, '{_PARTS}')) AS xlsx_filename_date,
        min(day) FILTER (lower(name) LIKE '%.xlsx' AND NOT regexp_matches(name, '{_PARTS}')) AS xlsx_mtime FROM f WHERE name NOT LIKE '~$%' AND name NOT LIKE '.%' GROUP BY 1),
    j AS (SELECT folder, min(dated) AS quotes_json FROM ({_SAID}) WHERE dated <> DATE '2024-02-29' GROUP BY 1),
    p AS (SELECT project_id, nullif(trim({_FOLDER}), '') AS folder, {_OWN} AS own, gc_name, name FROM projects),
    c AS (SELECT folder, min(trim(gc_name)) AS gc FROM ({_WHO}) WHERE trim(gc_name) <> '' GROUP BY 1),
    a AS (SELECT p.*, quotes_json, CASE WHEN x.folder IS NOT NULL THEN x.quote_pdf_mtime ELSE y.quote_pdf_mtime END AS q, CASE WHEN x.folder IS NOT NULL THEN x.xlsx_filename_date ELSE y.xlsx_filename_date END AS n, CASE WHEN x.folder IS NOT NULL THEN x.xlsx_mtime ELSE y.xlsx_mtime END AS m, gc, own IS NOT NULL AND own <> DATE '2024-02-29' AS real
        FROM p LEFT JOIN j ON j.folder = p.folder LEFT JOIN d AS x ON x.folder = p.folder LEFT JOIN d AS y ON y.folder = '+' || p.folder LEFT JOIN c ON c.folder = p.folder),
    b AS (SELECT *, CASE WHEN folder IS NULL OR real THEN NULL WHEN quotes_json IS NOT NULL THEN 'quotes_json' WHEN q IS NOT NULL THEN 'quote_pdf_mtime' WHEN n IS NOT NULL THEN 'xlsx_filename_date' WHEN m IS NOT NULL THEN 'xlsx_mtime' END AS source FROM a),
    e AS (SELECT project_id, CASE WHEN source IS NULL THEN own ELSE coalesce(quotes_json, q, n, m) END AS quote_date, source AS date_source,
        CASE WHEN folder IS NULL THEN NULL WHEN real THEN 'already_real' WHEN source IS NOT NULL AND own IS NOT NULL THEN 'bogus_replaced' WHEN source = 'quotes_json' THEN 'null_filled_quotes' WHEN source IS NOT NULL THEN 'null_filled_files' WHEN own IS NOT NULL THEN 'bogus_kept' ELSE 'null_unfilled' END AS date_outcome,
        CASE WHEN folder IS NULL THEN gc_name ELSE coalesce(gc_name, gc) END AS gc_name, CASE WHEN folder IS NULL THEN NULL WHEN gc_name IS NOT NULL THEN 'gc_skipped' WHEN gc IS NOT NULL THEN 'gc_updated' END AS gc_outcome FROM b)"""
add("j9_dates_from_files", ["projects", "quote_items"], _enriched, f"{_CHAIN} SELECT * FROM e")
add("j9_outcomes", ["projects", "quote_items"], lambda p, q: project_files.outcomes(_enriched(p, q)), f"{_CHAIN} SELECT outcome, count(*) AS n FROM (SELECT date_outcome AS outcome FROM e UNION ALL SELECT gc_outcome FROM e) WHERE outcome IS NOT NULL GROUP BY 1")


# --- state ---
def _by_year(q: DataFrame) -> list[DataFrame]:
    year = F.year("quote_date")
    return [q.filter(year <= 2022), q.filter(year.between(2023, 2024)), q.filter(year > 2024)]


# The same rows as one run over the whole history gives.
add("w1_alerts_of_batches", ["quote_items"], lambda q: increments.alerts_of_batches(_by_year(q)), None)
add("a11_summary_of_batches", ["quote_items"], lambda q: increments.summary_of_batches(_by_year(q)), None)


def share_sql(name: str, other: str) -> None:
    """The SQL of a query that must give another's rows."""
    FOUND[name] = (FOUND[name][0], FOUND[other][1])


def _stored(s: DataFrame, p: DataFrame) -> DataFrame:
    """Months until 2023 are stored, then the later ones are added."""
    late = F.year("quote_date") > 2023
    return kept(sketches.monthly(s, p.filter(~late)).filter("month is not null"), "months").unionByName(kept(sketches.monthly(s, p.filter(late)).filter("month is not null"), "months"))


add("a1_trends_of_sketches", ["scopes", "projects"], lambda s, p: sketches.trends(_stored(s, p), "quarter"), None)
add("a12_statistics_of_sketches", ["scopes", "projects"], lambda s, p: sketches.type_statistics(kept(sketches.monthly(s, p), "months")), None)

"""Domain tables over the driver's tables, as SQL that Spark and DuckDB both read.

Each text is one common table expression; NULLs, outliers, typos and totals that don't add up are put
in by rules on keys, so every operator has something to find.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SOURCES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem"]

# A scope's id holds the quantity, without which one row of sf0.001 would have another's.
TABLES: dict[str, tuple[list[str], str]] = {
    "projects": (
        ["orders", "customer"],
        """
        SELECT o.o_orderkey AS project_id,
          CASE WHEN o.o_orderkey % 12 = 0 THEN 'St Mary Hospital Tower' WHEN o.o_orderkey % 12 = 1 THEN 'Lincoln Elementary School'
               WHEN o.o_orderkey % 12 = 2 THEN 'Grace Community Church' WHEN o.o_orderkey % 12 = 3 THEN 'Harbor Hotel Renovation'
               WHEN o.o_orderkey % 12 = 4 THEN 'Orange County Courthouse' WHEN o.o_orderkey % 12 = 5 THEN 'Summit Office Park'
               WHEN o.o_orderkey % 12 = 6 THEN 'Palm Apartments' WHEN o.o_orderkey % 12 = 7 THEN 'City Arena'
               WHEN o.o_orderkey % 12 = 8 THEN 'Riverside Retail Center' WHEN o.o_orderkey % 12 = 9 THEN 'State University Library'
               WHEN o.o_orderkey % 12 = 10 THEN 'Industrial Warehouse' ELSE 'Plain Build' END || ' ' || CAST(o.o_orderkey AS STRING) AS name,
          CASE WHEN o.o_custkey % 10 = 0 THEN NULL ELSE c.c_name END AS gc_name,
          CASE WHEN c.c_mktsegment = 'BUILDING' THEN 'commercial_office' WHEN c.c_mktsegment = 'MACHINERY' THEN 'industrial'
               WHEN c.c_mktsegment = 'HOUSEHOLD' THEN 'residential' WHEN c.c_mktsegment = 'FURNITURE' THEN 'hospitality' ELSE NULL END AS project_type,
          CASE WHEN o.o_orderkey % 17 = 0 THEN NULL ELSE CAST(o.o_orderdate + INTERVAL '300' MONTH AS DATE) END AS quote_date,
          CASE WHEN o.o_orderstatus = 'F' THEN 'completed' WHEN o.o_orderstatus = 'O' THEN 'bidding' ELSE 'quoted' END AS status,
          CAST(o.o_orderdate AS DATE) AS created_on
        FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey""",
    ),
    "scopes": (
        ["lineitem", "part"],
        """
        SELECT scope_id, project_id, scope_type, product_name, square_footage, cost_per_unit, markup_pct, man_days, daily_labor_rate,
          material_cost, material_cost * (1 + COALESCE(markup_pct, 0)) AS material_price,
          man_days * COALESCE(daily_labor_rate, 725) AS labor_price, material_cost * CAST(0.06 AS DOUBLE) AS sales_tax,
          (material_cost * (1 + COALESCE(markup_pct, 0)) + man_days * COALESCE(daily_labor_rate, 725) + material_cost * CAST(0.06 AS DOUBLE)) * CASE WHEN part_id % 13 = 0 THEN CAST(1.05 AS DOUBLE) ELSE CAST(1.0 AS DOUBLE) END AS total
        FROM (
          SELECT CAST(l.l_orderkey AS STRING) || '-' || CAST(l.l_linenumber AS STRING) || '-' || CAST(l.l_partkey AS STRING) || '-' || CAST(l.l_suppkey AS STRING) || '-' || CAST(CAST(l.l_quantity AS INT) AS STRING) AS scope_id,
            l.l_orderkey AS project_id, l.l_partkey AS part_id,
            CASE WHEN l.l_partkey % 50 = 0 THEN 'AP' WHEN l.l_partkey % 50 = 1 THEN 'RPG' WHEN l.l_partkey % 50 = 2 THEN 'Other'
                 WHEN p.p_partkey % 6 = 0 THEN 'ACT' WHEN p.p_partkey % 6 = 1 THEN 'AWP' WHEN p.p_partkey % 6 = 2 THEN 'FW'
                 WHEN p.p_partkey % 6 = 3 THEN 'SM' WHEN p.p_partkey % 6 = 4 THEN 'Baffles' ELSE 'WW' END AS scope_type,
            p.p_name AS product_name,
            CASE WHEN l.l_partkey % 11 = 0 THEN NULL ELSE l.l_quantity * 100 END AS square_footage,
            l.l_extendedprice / (l.l_quantity * 100) AS cost_per_unit,
            CASE WHEN l.l_linenumber = 7 THEN NULL ELSE l.l_discount * 5 END AS markup_pct,
            l.l_quantity / 4 AS man_days,
            CASE WHEN l.l_linenumber = 1 THEN CAST(486.0 AS DOUBLE) WHEN l.l_linenumber = 2 THEN CAST(504.0 AS DOUBLE) WHEN l.l_linenumber = 3 THEN CAST(522.0 AS DOUBLE) WHEN l.l_linenumber = 4 THEN 540.0
                 WHEN l.l_linenumber = 5 THEN CAST(558.0 AS DOUBLE) WHEN l.l_linenumber = 6 THEN CAST(725.0 AS DOUBLE) ELSE NULL END AS daily_labor_rate,
            l.l_extendedprice AS material_cost
          FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey) s""",
    ),
    "quote_items": (
        ["lineitem", "supplier", "part"],
        """
        SELECT l.l_orderkey * 1000 + l.l_suppkey % 1000 AS quote_id, l.l_orderkey AS project_id,
          CASE WHEN l.l_suppkey % 19 = 0 THEN NULL ELSE s.s_name END AS vendor,
          CAST(l.l_shipdate + INTERVAL '300' MONTH AS DATE) AS quote_date, p.p_name AS product,
          CASE WHEN l.l_linenumber % 2 = 0 THEN 'sf' ELSE ' EA' END AS unit, l.l_quantity AS quantity,
          CASE WHEN l.l_partkey % 23 = 0 THEN 'call' ELSE '$' || CAST(CAST(FLOOR(l.l_extendedprice / l.l_quantity) AS BIGINT) AS STRING) END AS unit_cost_text,
          l.l_extendedprice AS item_total, l.l_partkey AS part_id, l.l_linenumber AS line_no
        FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey JOIN part p ON l.l_partkey = p.p_partkey""",
    ),
    "raw_fields": (
        ["orders"],
        """
        SELECT o_orderkey AS row_id,
          CASE WHEN o_orderkey % 7 = 0 THEN CAST(CAST(o_orderdate AS DATE) AS STRING)
               WHEN o_orderkey % 7 = 1 THEN CAST(month(o_orderdate) AS STRING) || '/' || CAST(day(o_orderdate) AS STRING) || '/' || CAST(year(o_orderdate) AS STRING)
               WHEN o_orderkey % 7 = 2 THEN CAST(month(o_orderdate) AS STRING) || '/' || CAST(day(o_orderdate) AS STRING) || '/24'
               WHEN o_orderkey % 7 = 3 THEN 'Sept ' || CAST(day(o_orderdate) AS STRING) || ', 2024'
               WHEN o_orderkey % 7 = 4 THEN 'January ' || CAST(day(o_orderdate) AS STRING)
               WHEN o_orderkey % 7 = 5 THEN 'TBD' ELSE CAST(month(o_orderdate) AS STRING) || '/31/2025' END AS date_text,
          CASE WHEN o_orderkey % 5 = 0 THEN '$' || CAST(o_custkey AS STRING) || ',000.50' WHEN o_orderkey % 5 = 1 THEN '(' || CAST(o_custkey AS STRING) || '.25)'
               WHEN o_orderkey % 5 = 2 THEN CAST(o_custkey AS STRING) || '/SF' WHEN o_orderkey % 5 = 3 THEN '12.5%' ELSE 'call' END AS money_text,
          CASE WHEN o_orderkey % 4 = 0 THEN CAST(o_custkey % 90 AS STRING) || chr(39) || '-6"' WHEN o_orderkey % 4 = 1 THEN CAST(o_custkey % 90 AS STRING) || '"'
               WHEN o_orderkey % 4 = 2 THEN CAST(o_custkey % 90 AS STRING) || '.5' || chr(39) ELSE 'NTS' END AS length_text,
          CASE WHEN o_orderkey % 3 = 0 THEN '/share/+ITBs/++Archive/Job ' || CAST(o_custkey AS STRING) || '/quote.pdf' WHEN o_orderkey % 3 = 1 THEN '/share/+ITBs/Job ' || CAST(o_custkey AS STRING) || '/buildup 3.14.24.xlsx' ELSE '/share/misc/x 13.1.24.pdf' END AS path,
          CASE WHEN o_orderkey % 6 = 0 THEN ' act ' WHEN o_orderkey % 6 = 1 THEN 'Baffle' WHEN o_orderkey % 6 = 2 THEN 'WW' WHEN o_orderkey % 6 = 3 THEN 'curtain' WHEN o_orderkey % 6 = 4 THEN NULL ELSE 'rpg' END AS type_text
        FROM orders o """,
    ),
    "estimates": (
        ["orders", "lineitem"],
        """
        SELECT o.o_orderkey AS estimate_id,
          CASE WHEN o.o_orderpriority LIKE '1%' THEN 'exported' WHEN o.o_orderpriority LIKE '2%' THEN 'finalized' WHEN o.o_orderpriority LIKE '3%' THEN 'reviewed'
               WHEN o.o_orderpriority LIKE '4%' THEN 'draft' ELSE NULL END AS status,
          o.o_totalprice AS total_estimate, CASE WHEN o.o_orderkey % 3 = 0 THEN a.actual ELSE NULL END AS actual_total_cost,
          CAST(o.o_orderdate AS DATE) AS created_on
        FROM orders o LEFT JOIN (SELECT l_orderkey, ROUND(SUM(l_extendedprice), 2) AS actual FROM lineitem GROUP BY l_orderkey) a ON o.o_orderkey = a.l_orderkey""",
    ),
    "quote_texts": (
        ["orders"],
        """
        SELECT o_orderkey AS doc_id, 'Order ' || CAST(o_orderkey AS STRING) || CASE WHEN o_orderkey % 3 = 0 THEN ' MDC.pdf' ELSE '.pdf' END AS file_name,
          'Acme Interiors, 12 Main Street' || chr(10)
          || CASE WHEN o_orderkey % 4 = 0 THEN 'Quote Date: January ' || CAST(day(o_orderdate) AS STRING) || ', 2024' WHEN o_orderkey % 4 = 1 THEN '0' || CAST(o_orderkey % 9 + 1 AS STRING) || '/15/2024'
                  WHEN o_orderkey % 4 = 2 THEN 'issued Jul ' || CAST(day(o_orderdate) AS STRING) || ' 2023' ELSE 'undated' END || chr(10)
          || CASE WHEN o_orderkey % 7 = 0 THEN 'ACOUSTIC PANEL FAB & INSTALL' WHEN o_orderkey % 7 = 1 THEN 'Sound Masking' ELSE 'Ceilings' END || chr(10)
          || CASE WHEN o_orderkey % 11 = 0 THEN 'no table' ELSE 'QTY TYPE DESCRIPTION COST PER UNIT TOTAL' END || chr(10)
          || CASE WHEN o_orderkey % 6 = 0 THEN '1 lot! Odd work 1,250.00 1,250.00' ELSE CAST(o_custkey % 90 + 1 AS STRING) || ' act-1 Dune panel $' || CAST(o_custkey % 7 + 1 AS STRING) || '.50 $' || CAST(o_custkey % 9 + 1 AS STRING) || ',045.00' || chr(10) || '24 AWP-1 Wall panel, fabric 850.00 20,400.00' END || chr(10)
          || 'Material Subtotal: $38,' || CAST(100 + o_custkey % 800 AS STRING) || '.00' || chr(10) || CASE WHEN o_orderkey % 2 = 0 THEN 'Labor Subtotal $14,000.00' || chr(10) ELSE '' END
          || CASE WHEN o_orderkey % 5 = 0 THEN 'GRAND TOTAL  $54,' || CAST(100 + o_custkey % 800 AS STRING) || '.00' WHEN o_orderkey % 5 = 1 THEN 'Grand Total' || chr(10) || chr(10) || '$7,' || CAST(100 + o_custkey % 800 AS STRING) || '.25'
                  WHEN o_orderkey % 5 = 2 THEN '$' || CAST(o_custkey % 800 AS STRING) || '.75' || chr(10) || chr(10) || 'Total' WHEN o_orderkey % 5 = 3 THEN '12.00' || chr(10) || '$' || CAST(o_custkey % 800 AS STRING) || '.10' || chr(10) || 'Bill to' ELSE 'no sum' END || chr(10)
          || CASE WHEN o_orderkey % 13 = 0 THEN 'unnumbered' ELSE 'QUOTE #: ' || CAST(10000 + o_custkey % 80000 AS STRING) || CASE WHEN o_orderkey % 3 = 0 THEN '-R2' ELSE '' END END || chr(10)
          || CASE WHEN o_orderkey % 5 = 0 THEN 'Milestone Billing' WHEN o_orderkey % 5 = 1 THEN '50% down / balance net 15' WHEN o_orderkey % 5 = 2 THEN 'Net 45' ELSE 'cash' END AS text
        FROM orders o """,
    ),
    "vendor_texts": (
        ["lineitem", "supplier", "part"],
        """
        SELECT CAST(l.l_orderkey AS STRING) || '-' || CAST(l.l_linenumber AS STRING) || '-' || CAST(l.l_partkey AS STRING) || '-' || CAST(l.l_suppkey AS STRING) AS doc_id,
          CASE WHEN l.l_suppkey % 4 = 0 THEN 'armstrong list.pdf' ELSE 'list.pdf' END AS file_name,
          CASE WHEN l.l_partkey % 17 = 0 THEN 'scan' ELSE CASE WHEN l.l_suppkey % 4 = 1 THEN 'Foundation Building and FBM' WHEN l.l_suppkey % 4 = 2 THEN 'MDC, Texas' ELSE 'Supply house' END || chr(10)
          || 'Invoice #INV-' || CAST(1000 + l.l_suppkey AS STRING) || chr(10) || CASE WHEN l.l_linenumber % 2 = 0 THEN '3/5/24' ELSE 'March 5, 2024' END || chr(10)
          || CASE WHEN l.l_linenumber % 3 = 0 THEN 'Lead time 2-3 weeks' ELSE 'stock' END || chr(10)
          || CASE WHEN l.l_linenumber = 5 THEN 'as agreed' ELSE CASE WHEN l.l_partkey % 2 = 0 THEN '24-1234 ' ELSE '' END || 'Panel ' || replace(p.p_name, '.', '') || ' ' || CAST(CAST(l.l_quantity AS INT) AS STRING) || ' ctn $42.50 $1,040.00' END || chr(10)
          || 'Freight: $225.00' || chr(10) || CASE WHEN l.l_linenumber = 4 THEN '' ELSE 'Grand Total: $3,' || CAST(100 + l.l_partkey % 800 AS STRING) || '.00' END END AS text
        FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey JOIN part p ON l.l_partkey = p.p_partkey""",
    ),
    "plan_pages": (
        ["orders"],
        """
        SELECT CAST(FLOOR(o_orderkey / 4) AS BIGINT) AS plan_id, o_orderkey, CAST(o_orderkey % 4 + 1 AS BIGINT) AS page_no,
          CASE WHEN o_orderkey % 29 = 0 THEN ' raster ' WHEN o_custkey % 5 = 0 THEN 'REFLECTED CEILING PLAN' || chr(10) || 'OPEN OFFICE ' || CAST(o_custkey AS STRING) || ' SF' || chr(10) || 'CEILING AT 9' || chr(39) || '-6" AFF, ACT-1 24X48 GRID'
               WHEN o_custkey % 5 = 1 THEN 'Level 2 Floor Plan' || chr(10) || 'Room 12' || chr(39) || '-6" x 18' || chr(39) || '-0" and tile 2x4, corridor 8 x ' || CAST(o_custkey % 60 AS STRING) || chr(10) || 'see details on other sheets'
               WHEN o_custkey % 5 = 2 THEN 'NORTH ELEVATION of the main stair' || chr(10) || '1,' || CAST(100 + o_custkey % 800 AS STRING) || '.50 sq. ft. of panels, 1,' || CAST(100 + o_custkey % 800 AS STRING) || '.50 SF again'
               WHEN o_custkey % 5 = 3 THEN 'Finish Schedule' || chr(10) || 'sound masking and FW panels by others; section 09 84 00' ELSE 'General notes without any number that a reader could use here' END AS text
        FROM orders o """,
    ),
    "room_pages": (
        ["orders"],
        """
        SELECT o_orderkey AS plan_id, CAST(1 AS BIGINT) AS page_no,
          CASE WHEN o_orderkey % 6 = 0 THEN 'ROOM ' || CAST(100 + o_custkey % 900 AS STRING) || ' - CONFERENCE ROOM' || chr(10) || 'CEILING AT 9' || chr(39) || '-6" AFF, ACT-1 24X48 GRID'
               WHEN o_orderkey % 6 = 1 THEN 'ROOM NO. ' || CAST(100 + o_custkey % 900 AS STRING) || chr(10) || 'MECHANICAL' || chr(10) || 'EXPOSED STRUCTURE 12 FT'
               WHEN o_orderkey % 6 = 2 THEN CAST(100 + o_custkey % 900 AS STRING) || ' - LAB' || chr(10) || 'ACT ARMSTRONG DUNE 2X4 AFF'
               WHEN o_orderkey % 6 = 3 THEN CAST(100 + o_custkey % 900 AS STRING) || '  OFFICE SUITE  VCT  PAINT  ACT-2' || chr(10) || 'ROOM ' || CAST(100 + o_custkey % 900 AS STRING) || ' - AGAIN'
               WHEN o_orderkey % 6 = 4 THEN 'SPACE AT LOBBY WITH GWB 108"' ELSE 'nothing of note' END || chr(10)
          || 'see general notes' || chr(10) || 'see general notes' || chr(10) || 'see general notes' || chr(10) || 'see general notes' || chr(10) || 'see general notes' || chr(10) || 'see general notes' || chr(10) || 'see general notes' || chr(10)
          || CASE WHEN o_orderkey % 7 = 0 THEN 'FABRIC WALL - 450 SF' WHEN o_orderkey % 7 = 1 THEN 'AWP-1 - 2,' || CAST(100 + o_custkey % 900 AS STRING) || ' SF OF MAHARAM' WHEN o_orderkey % 7 = 2 THEN 'WAINSCOT - ' || CAST(o_custkey % 90 + 10 AS STRING) || ' LF @ 36"'
                  WHEN o_orderkey % 7 = 3 THEN 'CHAIR RAIL @ 48"' WHEN o_orderkey % 7 = 4 THEN 'FW-2: ' || CAST(o_custkey % 9 + 2 AS STRING) || ' PANELS 4' || chr(39) || 'x8' || chr(39) || ', FW-2 again' ELSE 'walls by others' END AS text
        FROM orders o """,
    ),
    "room_marks": (
        ["lineitem"],
        """
        SELECT l_orderkey AS plan_id, CAST(1 AS BIGINT) AS page_no, CAST(l_linenumber AS STRING) || '-' || CAST(l_partkey AS STRING) || '-' || CAST(l_suppkey AS STRING) AS mark_id,
          CASE WHEN l_partkey % 4 = 0 THEN 'ACT-1 - 1,' || CAST(100 + l_partkey % 900 AS STRING) || ' SF' WHEN l_partkey % 4 = 1 THEN 'AWP-' || CAST(l_linenumber AS STRING) || ' see detail' ELSE 'a cloud' END AS label, l_quantity AS area_sf
        FROM lineitem l """,
    ),
    "plan_marks": (
        ["lineitem"],
        """
        SELECT CAST(FLOOR(l_orderkey / 4) AS BIGINT) AS plan_id, CAST(l_orderkey % 4 + 1 AS BIGINT) AS page_no,
          CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) || '-' || CAST(l_partkey AS STRING) || '-' || CAST(l_suppkey AS STRING) AS mark_id,
          CASE WHEN FLOOR(l_orderkey / 4) % 3 = 1 THEN NULL WHEN l_partkey % 5 = 0 THEN 'ACT-' || CAST(l_linenumber AS STRING) || chr(10) || 'Area: 1,' || CAST(100 + l_partkey % 800 AS STRING) || '.25 sq ft' WHEN l_partkey % 5 = 1 THEN 'AWP-2 Length: ' || CAST(l_linenumber * 10 AS STRING) || '.5 LF'
               WHEN l_partkey % 5 = 2 THEN 'Area ' || CAST(l_linenumber * 100 AS STRING) || ' SF' ELSE NULL END AS content,
          CASE WHEN l_partkey % 5 = 3 THEN 'check this' ELSE NULL END AS subject, CASE WHEN FLOOR(l_orderkey / 4) % 3 = 1 THEN NULL ELSE 'reviewer' END AS title,
          CASE WHEN l_suppkey % 6 = 0 THEN '#ff0000' WHEN l_suppkey % 6 = 1 THEN '#0000ff' WHEN l_suppkey % 6 = 2 THEN '#00ff00' WHEN l_suppkey % 6 = 3 THEN '#ffa500' WHEN l_suppkey % 6 = 4 THEN '#ffff00' ELSE 'red' END AS colour
        FROM lineitem l """,
    ),
    "suggestions": (
        ["lineitem"],
        """
        SELECT l_orderkey AS plan_id, CAST(l_linenumber AS BIGINT) * 100000000000000 + l_partkey * 100000000 + l_suppkey * 100 + CAST(l_quantity AS BIGINT) AS seq,
          CASE WHEN l_partkey % 4 = 0 THEN 'ACT' WHEN l_partkey % 4 = 1 THEN 'AWP' WHEN l_partkey % 4 = 2 THEN 'FW' ELSE 'Baffles' END AS scope_type,
          CASE WHEN l_suppkey % 3 = 0 AND l_partkey % 4 = 0 THEN 'ACT-' || CAST(l_linenumber % 3 + 1 AS STRING) WHEN l_suppkey % 3 = 0 AND l_partkey % 4 = 1 THEN 'AWP-' || CAST(l_linenumber % 2 + 1 AS STRING) ELSE NULL END AS scope_tag,
          CASE WHEN l_partkey % 7 = 0 THEN NULL ELSE l_quantity * 10 END AS area_sf, CASE WHEN l_linenumber % 3 = 0 THEN CAST(0.95 AS DOUBLE) WHEN l_linenumber % 3 = 1 THEN CAST(0.7 AS DOUBLE) ELSE CAST(0.5 AS DOUBLE) END AS confidence,
          CASE WHEN l_partkey % 3 = 0 THEN NULL ELSE 'part ' || CAST(l_partkey AS STRING) END AS product_hint, 'room ' || CAST(l_suppkey % 5 AS STRING) AS room
        FROM lineitem l """,
    ),
}


def domain(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A domain table; only its own sources are registered, each under a name of its own session view."""
    sources, text = TABLES[name]
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in sources}
    for t in sorted(frames, key=len, reverse=True):
        text = text.replace(f"FROM {t} ", f"FROM {{{t}}} ").replace(f"JOIN {t} ", f"JOIN {{{t}}} ")
    return spark.sql(text, **frames)


def oracle(body: str, *names: str) -> str:
    """``body`` over the domain tables it names."""
    return "WITH " + ", ".join(f"{n} AS ({TABLES[n][1]})" for n in names) + " " + body

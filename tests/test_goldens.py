"""Values that the operators must give, from known cases."""

import pytest
from pyspark.sql import functions as F

from tallyworks.functions import classify, text
from tallyworks.operators import checks, comparables, estimates, plan_chain, plan_rooms, prices, quantiles


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_similarity(spark):
    score = lambda *v: one(spark, estimates.similarity(*[F.lit(x) for x in v]))
    assert score("ACT", 1000.0, 12.0, "ACT", 1000.0, 12.0) == pytest.approx(1)
    assert score("ACT", 1000.0, None, "ACT", 1000.0, None) == pytest.approx(1)
    assert score("ACT", 1000.0, 12.0, "AWP", 1000.0, 12.0) < 0.6
    assert score("ACT", 100.0, 0.0, "AWP", 1000.0, None) == pytest.approx(0.3 * 0.3028 / 0.8, abs=1e-4)


def test_comparables(spark):
    scopes = spark.createDataFrame([("p1", "ACT", 1000.0, 12.0), ("p2", "ACT", 950.0, 11.5), ("p3", "AWP", 500.0, 20.0), ("p4", "ACT", 800.0, 13.0), ("p5", "FW", 300.0, 15.0)], "project_id string, scope_type string, square_footage double, cost_per_unit double")
    target = spark.createDataFrame([("t", "ACT", 1000.0, 12.0), ("u", "FW", 300.0, 15.0)], "target_id string, kind string, area double, cost double")
    got = {(r["target_id"], r["rank"]): r["project_id"] for r in comparables.comparable_projects(target, scopes).collect()}
    assert [got["t", k] for k in (1, 2, 3)] == ["p1", "p2", "p4"]
    assert got["u", 1] == "p5"
    assert len(got) == 6


def test_clean_scope_and_confidence(spark):
    columns = "project_id int, scope_id int, scope_type string, square_footage double, cost_per_unit double, material_cost double, markup_pct double, material_price double, man_days double, labor_price double, sales_tax double, total double"
    clean = (1, 1, "ACT", 2000.0, 2.5, 5000.0, 0.30, 6500.0, 3.0, 1566.0, 390.0, 8456.0)
    wrong = (2, 2, "ACT", None, 2.5, 5000.0, 1.30, 6500.0, None, 1566.0, -1.0, 8456.0)
    scopes = spark.createDataFrame([clean, wrong], columns)
    found = checks.scope_issues(scopes, texts=True).collect()
    assert {(r["scope_id"], r["field"], r["severity"]) for r in found} == {(2, "square_footage", "error"), (2, "markup_pct", "error"), (2, "sales_tax", "error"), (2, "total", "warning"), (2, "material_price", "warning"), (2, "man_days", "warning")} - {(2, "total", "warning")} | ({(2, "total", "warning")} if abs(6500 + 1566 - 1 - 8456) / 8456 > 0.02 else set())
    assert next(r for r in found if r["field"] == "markup_pct")["message"] == "markup_pct: expected 10% to 100%, found 130.0%"
    projects = spark.createDataFrame([(1, 8456.0), (2, 9000.0), (3, None)], "project_id int, grand_total double")
    got = {r["project_id"]: r for r in checks.project_reports(projects, scopes).collect()}
    assert got[1]["summary"] == "valid, 1 scopes, confidence 100%"
    assert (got[3]["errors"], got[3]["confidence"]) == (1, 0.8)
    assert (got[2]["valid_scopes"], got[2]["errors"]) == (0, 3)


def test_vendor_price_summary(spark):
    rows = []
    for vendor, baseline, recent, quotes in (("up", 10000, 12000, 6), ("flat", 10000, 10500, 4), ("edge", 10000, 11500, 5), ("few", 10000, 12000, 2)):
        for k in range(quotes):
            rows.append((k, vendor, float(baseline if k % 2 else recent), "2025-01-05" if k % 2 else "2025-08-05"))
    items = spark.createDataFrame(rows, "quote_id int, vendor string, item_total double, d string").select("quote_id", "vendor", "item_total", F.col("d").cast("date").alias("quote_date"))
    got = {r["vendor"]: (r["pct"], r["alert"]) for r in prices.vendor_price_summary(items).collect()}
    assert got == {"up": (20.0, True), "flat": (5.0, False), "edge": (15.0, False)}


def test_dates_and_labels(spark):
    date = lambda raw: (lambda v: v and str(v))(one(spark, text.backfill_date(F.lit(raw))))
    assert [date(r) for r in ("3/14/2024", "3/14/24", "3/14/70", "2024-03-14", "March 14, 2024", "Mar 14, 2024", "March 14 2024")] == ["2024-03-14", "2024-03-14", "1970-03-14", *["2024-03-14"] * 4]
    assert [date(r) for r in ("Mar 14 2024", "Sept 4, 2024", "2/30/2024", "2024-02-29", "TBD", "")] == [None] * 6
    assert one(spark, classify.confidence_badge(F.lit(0.87))) == "high (87%)"
    assert one(spark, classify.cost_type(F.lit(" P&P Bond"))) == "bond"


def test_rooms_ceilings_and_walls(spark):
    pages = spark.createDataFrame(
        [("p", 1, "ROOM 101 - CONFERENCE ROOM\nCLG HT 9'-0\" AFF\nACT-1\n\n\n\n102 - STORAGE\n103   LAB   VCT   PAINT   GWB\n103 - AGAIN"), ("p", 2, "ACT ARMSTRONG DUNE 24X48 GRID 108\"\nAWP-1 - 2,300 SF\nAWP-1 again\n\n\n\nEXPOSED STRUCTURE"), ("p", 3, None), ("p", 4, "")],
        "plan_id string, page_no int, text string",
    )
    marks = spark.createDataFrame([("p", 1, "m1", "ACT-1 - 2,450 SF", None), ("p", 1, "m2", "FW-2", 10.0), ("p", 1, "m3", None, 5.0)], "plan_id string, page_no int, mark_id string, label string, area_sf double")
    rooms = {(r["number"], r["room"]): r for r in plan_rooms.rooms(pages, marks).collect()}
    assert (rooms["101", "CONFERENCE ROOM"]["ceiling_height"], rooms["101", "CONFERENCE ROOM"]["tag"]) == ("9'-0\"", "ACT-1")
    assert ("102", "STORAGE") in rooms
    assert ("103", "AGAIN") in rooms  # a numbered line comes before a finish row
    assert rooms[None, "ACT-1 - 2,450 SF"]["area_sf"] == 2450
    found = {(r["page_no"], r["ceiling"], r["tag"]): r for r in plan_rooms.ceilings(pages, marks).collect()}
    act = found[2, "ACT", "AWP-1"]
    assert (act["product"], act["grid"], act["ceiling_height"]) == ("ARMSTRONG DUNE", "2x4", "9'-0\"")
    assert (2, "Exposed Structure", None) in found
    assert (1, "FW", "FW-2") in found
    walls = plan_rooms.walls(pages).collect()
    assert [(r["kind"], r["tag"], r["area_sf"]) for r in walls] == [("AWP", "AWP-1", 2300.0)]


def test_medians_are_exact(spark):
    import random
    import statistics

    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, rng.gauss(0, 1), 3.0, rng.randint(0, 9) * 1e6])) for _ in range(3000)] + [("c", None), ("d", 5.0)]
    got = {r["k"]: r["m"] for r in quantiles.medians(spark.createDataFrame(rows, "k string, v double"), ["k"], {"m": F.col("v")}).collect()}
    for k in ("a", "b", None, "d"):
        assert got[k] == pytest.approx(statistics.median([v for c, v in rows if c == k and v is not None]))
    assert "c" not in got


def test_walls_have_the_room_near_them(spark):
    pages = spark.createDataFrame([(1, 1, "LOBBY NORTH\nFABRIC WALL - 450 SF\nnotes"), (1, 2, "AWP-1 - 225 SF\nsee ROOM NO. 204A"), (1, 3, "WAINSCOT - 40 LF @ 36 OFFICE 12\nROOM 7"), (1, 4, "x\nROOM 9\n1\n2\n3\nFW-2 here")], "plan_id int, page_no int, text string")
    got = {r["page_no"]: r["location"] for r in plan_rooms.walls(pages).collect()}
    assert got == {1: "LOBBY NORTH", 2: "ROOM NO. 204A", 3: "OFFICE 12", 4: None}


@pytest.mark.parametrize("most", [None, 0])
def test_medians_with_an_outlier_and_over_ranges(spark, most):
    import statistics

    rows = [(k, v) for k in ("a", None) for v in [*map(float, range(501)), 1e15, -1e15, None]] + [("b", 3.0)] * 7 + [("b", 1.0)] * 7 + [("c", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    got = {r["k"]: r["m"] for r in quantiles.medians(df, ["k"], {"m": F.col("v")}, most).collect()}
    assert got == {k: statistics.median([v for c, v in rows if c == k and v is not None]) for k in ("a", None, "b")}


def test_three_marked_scopes_of_a_plan_are_priced_and_the_text_only_ones_go(spark):
    areas = (568.87, 378.18, 648.33)
    marks = [("p", 2, f"m{k}", f"AWP-{k + 1}\nArea: {a} sq ft", None, "reviewer", "#ff0000") for k, a in enumerate(areas)]
    pages = [("p", 1, "COVER"), ("p", 2, "REFLECTED CEILING PLAN with sound masking and FW panels, section 09 84 00 and ACT tile by others"), ("q", 1, "Finish Schedule with sound masking of the whole second floor, no areas given here")]
    p = spark.createDataFrame(pages, "plan_id string, page_no long, text string")
    m = spark.createDataFrame(marks, "plan_id string, page_no long, mark_id string, content string, subject string, title string, colour string")
    rm = spark.createDataFrame([("p", 2, "m9", "a cloud", 5.0)], "plan_id string, page_no long, mark_id string, label string, area_sf double")
    assert plan_chain.suggestions(p, m).filter("area_sf is null").count() >= 3
    for row_marks in (None, rm):
        rows = plan_chain.estimated_plans(p, m, row_marks).collect()
        assert [(r["plan_id"], r["scopes"], r["area_sf"], r["plan_confidence"]) for r in rows] == [("p", 3, 1595.38, 1.0)]
        assert abs(rows[0]["total"] - 32394.19) < 0.1 and abs(rows[0]["man_days"] - 2.8717) < 1e-3

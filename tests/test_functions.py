import datetime

import pytest
from pyspark.sql import functions as F

from tallyworks.functions import classify, parse, rates
from tallyworks.operators import comparables, estimates


def one(spark, column, **values):
    kinds = {str: "string", float: "double", int: "long", type(None): "string"}
    schema = ", ".join(f"{k} {kinds[type(v)]}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("text", "want"),
    [("2025-05-28", (2025, 5, 28)), ("9/26", (2026, 9, 26)), ("9/26/25", (2025, 9, 26)), ("Sept 3", (2026, 9, 3)), ("Sep 3 2025", (2025, 9, 3)), ("2/30/2024", None), ("tbd", None), ("", None), (None, None), ("soon", None)],
)
def test_loose_date(spark, text, want):
    assert one(spark, parse.loose_date(F.col("t"), 2026), t=text) == (want and datetime.date(*want))


@pytest.mark.parametrize(("text", "want"), [("$1,234.50", 1234.5), ("(12)", -12.0), ("3.25/SF", 3.25), ("12.5%", 12.5), ("call", None), (None, None)])
def test_money(spark, text, want):
    assert one(spark, parse.money(F.col("t")).cast("double"), t=text) == want


@pytest.mark.parametrize(("text", "want"), [("45'-6\"", 45.5), ('18"', 1.5), ("45.5'", 45.5), ("12", 12.0), ("NTS", None)])
def test_feet(spark, text, want):
    assert one(spark, parse.feet(F.col("t")), t=text) == want


@pytest.mark.parametrize(("rate", "want"), [(486.0, "Era 1"), (490.0, "Era 2"), (725.0, "Era 7"), (10_000.0, "Era Unknown")])
def test_era(spark, rate, want):
    assert one(spark, rates.era(F.col("r")), r=rate).startswith(want)


def test_rate_in_force(spark):
    df = spark.createDataFrame([(datetime.date(2019, 1, 1),), (datetime.date(2024, 4, 1),), (None,)], "d date")
    assert [r["v"] for r in df.select(rates.rate_on(F.col("d")).alias("v")).collect()] == [486.0, 540.0, 725.0]


def test_labour_is_man_days_first(spark):
    df = spark.createDataFrame([(2.0, 486.0, 1.0), (None, 362.5, 100.0), (None, None, 5.0)], "m double, r double, l double")
    assert [r["v"] for r in df.select(rates.normal_labour(F.col("m"), F.col("r"), F.col("l")).alias("v")).collect()] == [1450.0, 200.0, None]


@pytest.mark.parametrize(("name", "want"), [("Dune on Suprafine", 2), ("WoodWorks panel", 3), ("Cirrus", 1), ("budget tile", 0), ("thing", 1), (None, 1)])
def test_tier(spark, name, want):
    assert one(spark, classify.product_tier(F.col("n")), n=name) == want


@pytest.mark.parametrize(("raw", "want"), [(" act ", "ACT"), ("Baffle", "Baffles"), ("x", "Other"), (None, "Other")])
def test_scope_type(spark, raw, want):
    assert one(spark, classify.scope_type(F.col("t")), t=raw) == want


def test_comparables_of_a_small_set(spark):
    scopes = spark.createDataFrame([(1, "ACT", 1000.0, 12.0), (2, "ACT", 950.0, 11.5), (3, "AWP", 500.0, 20.0), (4, "ACT", 800.0, 13.0), (5, "FW", 300.0, 15.0), (1, "ACT", 900.0, 12.0)], "project_id long, scope_type string, square_footage double, cost_per_unit double")
    targets = spark.createDataFrame([("t", "ACT", 1000.0, 12.0)], "target_id string, kind string, area double, cost double")
    rows = comparables.comparable_projects(targets, scopes).orderBy("rank").collect()
    assert [r["project_id"] for r in rows] == [1, 2, 4]
    assert rows[0]["score"] == 1.0


def test_three_plan_scopes(spark):
    plan = spark.createDataFrame([("p", "AWP", a, 0.95) for a in (568.87, 378.18, 648.33)] + [("p", "AWP", None, 0.95), ("p", "ACT", 100.0, 0.2)], "plan_id string, scope_type string, area_sf double, confidence double")
    row = estimates.project_estimates(plan).first()
    assert (row["scopes"], row["area_sf"]) == (3, 1595.38)
    assert abs(row["total"] - 32394.19) < 0.1
    assert abs(row["man_days"] - 2.8717) < 1e-3

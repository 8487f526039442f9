import json

import pytest
from pyspark.errors import AnalysisException

from tallyworks.operators import overview
from tallyworks.sources import json_documents as j


def put(folder, name, text):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text if isinstance(text, str) else json.dumps(text))


def test_build_ups(spark, tmp_path):
    put(tmp_path, "a.json", {"success": True, "project": {"folder_name": "Job 1", "grand_total": "100.50", "scopes": [{"scope_type": "ACT", "total": "60"}, {"scope_type": "AWP", "total": "call"}], "additional_costs": [{"cost_type": "bond", "amount": "5"}]}})
    put(tmp_path, "b.json", {"success": False, "error": "no sheet"})
    put(tmp_path, "c.json", "{ not json")
    got = j.build_ups(spark, str(tmp_path))
    assert [(r["folder_name"], float(r["grand_total"])) for r in got["projects"].collect()] == [("Job 1", 100.5)]
    assert [r["total"] and float(r["total"]) for r in got["scopes"].orderBy("position").collect()] == [60.0, None]
    assert float(got["costs"].first()["amount"]) == 5.0
    assert sorted(r["file_name"] for r in got["failed"].collect()) == ["b.json", "c.json"]


def test_vendor_quotes_take_the_folder_from_the_name(spark, tmp_path):
    for name in ("Job 1__quote.json", "loose.json"):
        put(tmp_path, name, {"success": True, "quote": {"vendor_name": "V", "items": [{"product": "tile", "unit_cost": "$1"}]}})
    assert {r["file_name"]: r["folder_name"] for r in j.vendor_quotes(spark, str(tmp_path)).collect()} == {"Job 1__quote.json": "Job 1", "loose.json": None}


def test_plan_results(spark, tmp_path):
    for name in ("plans/Tower A/x.json", "plans/Tower B/y.json", "plans/Tower A/summary.json"):
        put(tmp_path, name, {"success": True, "scope_suggestions": [{"scope_type": "ACT", "area_sf": "10"}]})
    put(tmp_path, "plans/Tower A/bad.json", "[")
    assert sorted(r["file_name"] for r in j.plan_results(spark, str(tmp_path)).collect()) == ["x.json", "y.json"]
    assert [r["file_name"] for r in j.plan_results(spark, str(tmp_path), "tower b").collect()] == ["y.json"]


def test_catalog_must_be_whole(spark, tmp_path):
    put(tmp_path, "catalog.json", [{"canonical_name": "Armstrong Dune", "aliases": ["dune"]}])
    assert j.catalog(spark, str(tmp_path / "catalog.json")).count() == 1
    with pytest.raises(AnalysisException):
        j.catalog(spark, str(tmp_path / "none.json"))


def test_own_quotes_have_their_file_and_date(spark, tmp_path):
    put(tmp_path, "Quote 05906.json", {"success": True, "quote": {"quote_number": "05906", "quote_date": "3/14/2024", "grand_total": "12.50", "line_items": []}})
    put(tmp_path, "bad date.json", {"success": True, "quote": {"quote_date": "soon"}})
    put(tmp_path, "failed.json", {"success": False})
    got = {r["source_file"]: (r["dated"] and str(r["dated"]), r["grand_total"] and float(r["grand_total"])) for r in j.own_quotes(spark, str(tmp_path)).collect()}
    assert got == {"Quote 05906.json": ("2024-03-14", 12.5), "bad date.json": (None, None)}


def test_training_table_and_reports_come_back(spark, tmp_path):
    table = spark.createDataFrame([(1, "ACT", 2.5), (2, "AWP", None)], "scope_id int, scope_type string, target double")
    overview.save_training_table(table, f"{tmp_path}/table")
    overview.save_training_table(table, f"{tmp_path}/table")
    assert sorted(map(tuple, overview.load_training_table(spark, f"{tmp_path}/table").select(*table.columns).collect())) == [(1, "ACT", 2.5), (2, "AWP", None)]
    with pytest.raises(AnalysisException):
        overview.load_training_table(spark, f"{tmp_path}/none")
    overview.save_report({"queue": table, "index": table.filter("scope_id > 1")}, f"{tmp_path}/report")
    assert [spark.read.json(f"{tmp_path}/report/{name}").count() for name in ("queue", "index")] == [2, 1]

"""Loads that are cut off or run twice, files by their metadata, batches against one run, sketches against exact values."""

import datetime
import os

import pytest
from pyspark.sql import functions as F

from tallyworks.operators import increments, prices, sketches
from tallyworks.plans.tables import domain
from tallyworks.sources import project_files
from tallyworks.sources.snapshots import Snapshots

SF = "/root/testdata/sf0.001"
SCHEMA = "folder string, id long, status string"


def table(spark, tmp_path):
    return Snapshots(spark, f"file://{tmp_path}/t", ["folder"], SCHEMA, buckets=8)


def rows(spark, *values):
    return spark.createDataFrame(list(values), SCHEMA)


def held(df):
    return sorted((r["folder"] or "", r["id"], r["status"]) for r in df.collect())


def test_a_load_cut_off_before_its_manifest_changes_nothing(spark, tmp_path, monkeypatch):
    t = table(spark, tmp_path)
    assert held(t.read()) == [] and t.version() == 0
    t.upsert("one", rows(spark, ("a", 1, "x"), ("b", 2, "x"), (None, 3, "x")))

    def cut(*_):
        raise OSError("executor and driver are gone")

    with monkeypatch.context() as m:
        m.setattr(Snapshots, "commit", cut)
        with pytest.raises(OSError, match="gone"):
            t.upsert("two", rows(spark, ("b", 9, "y"), ("c", 4, "y")))
    assert held(t.read()) == [("", 3, "x"), ("a", 1, "x"), ("b", 2, "x")] and t.version() == 1
    assert t.upsert("two", rows(spark, ("b", 9, "y"), ("c", 4, "y"))) == 2
    assert held(t.read()) == [("", 3, "x"), ("a", 1, "x"), ("b", 9, "y"), ("c", 4, "y")]


def test_a_load_done_twice_is_done_once(spark, tmp_path):
    t = table(spark, tmp_path)
    for _ in range(2):
        assert t.append("one", rows(spark, ("a", 1, "x"), ("a", 1, "x"))) == 1
    assert held(t.read()) == [("a", 1, "x"), ("a", 1, "x")]


def test_only_buckets_of_changed_keys_are_written(spark, tmp_path):
    t = table(spark, tmp_path)
    t.upsert("one", rows(spark, *((f"job {k}", k, "x") for k in range(200))))
    before = {r["bucket"]: r["folder"] for r in t.manifests().filter("version = 1 and bucket is not null").collect()}
    t.upsert("two", rows(spark, ("job 7", 7, "y")))
    after = {r["bucket"]: r["folder"] for r in t.manifests().filter("version = 2 and bucket is not null").collect()}
    assert sum(before[k] != after[k] for k in before) == 1 and len(before) == 8
    assert len(os.listdir(tmp_path / "t/data")) == 2
    assert t.read(1).filter("status = 'y'").count() == 0 and t.read().filter("status = 'y'").count() == 1
    assert t.roll_back("back", 1) == 3 and held(t.read()) == held(t.read(1))


def test_replaced_rows_keep_columns_and_children_go(spark, tmp_path):
    t = table(spark, tmp_path)
    t.upsert("one", rows(spark, ("a", 1, "old"), ("b", 2, "old")))
    t.replace("two", rows(spark, ("a", 7, "new"), ("c", 8, "new")), ["id"])
    assert held(t.read()) == [("a", 1, "new"), ("b", 2, "old"), ("c", 8, "new")]
    t.replace_children("three", rows(spark, ("c", 1, "child"), ("c", 2, "child")), spark.createDataFrame([("a",), ("c",)], "folder string"))
    assert held(t.read()) == [("b", 2, "old"), ("c", 1, "child"), ("c", 2, "child")]
    with pytest.raises(ValueError, match="doesn't change"):
        t.load("four", rows(spark, ("a", 1, "x")), lambda old: rows(spark, *((f"z{k}", k, "x") for k in range(40))))
    assert t.version() == 3


def tree(root, *files):
    for name, day in files:
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"content")
        at = datetime.datetime.fromisoformat(f"{day}T12:00:00+00:00").timestamp()
        os.utime(path, (at, at))


def test_dates_from_a_folder_tree(spark, tmp_path):
    tree(
        tmp_path / "itb", ("Alpha/Quote 1.pdf", "2024-05-02"), ("Alpha/quote 2.PDF", "2024-03-01"), ("Alpha/Buildup 1.2.24.xlsx", "2020-01-01"), ("+Beta/Buildup 8.27.25.xlsx", "2021-01-01"), ("+Beta/Plan.pdf", "2021-01-01"),
        ("Gamma/Buildup.xlsx", "2023-07-07"), ("Gamma/~$Buildup.xlsx", "2019-07-07"), ("Delta/b 13_31_2025.xlsx", "2023-01-01"), ("Delta/deep/Quote 1.pdf", "2023-01-01"), ("Eta/Quote 9.pdf", "2023-02-02"), ("+Eta/Quote 9.pdf", "2022-02-02"), ("top.xlsx", "2020-01-01"),
    )
    listed = project_files.listed(spark, f"file://{tmp_path}/itb")
    assert "content" not in listed.columns and listed.count() == 12
    files = project_files.in_folders(listed, f"{tmp_path}/itb")
    day = datetime.date
    projects = [(1, "Alpha", None, None), (2, "Beta", day(2024, 2, 29), "has"), (3, " Gamma ", None, None), (4, "Delta", None, None), (5, "Zeta", day(2024, 2, 29), None), (6, "Alpha", day(2022, 1, 1), None), (7, " ", None, None), (8, "Eta", None, None), (9, "Iota", None, None)]
    quotes = [("Iota", day(2024, 2, 29)), ("Iota", day(2023, 3, 3)), ("Iota", None), ("Gamma", None)]
    done = project_files.enriched(spark.createDataFrame(projects, "project_id int, folder string, quote_date date, gc_name string"), spark.createDataFrame(quotes, "folder string, dated date"), files, spark.createDataFrame([("Alpha", " Acme "), ("Beta", "Other"), ("Gamma", " ")], "folder string, gc_name string"))
    got = {r["project_id"]: (r["quote_date"] and str(r["quote_date"]), r["date_source"], r["gc_name"]) for r in done.collect()}
    assert got == {
        1: ("2024-03-01", "quote_pdf_mtime", "Acme"), 2: ("2025-08-27", "xlsx_filename_date", "has"), 3: ("2023-07-07", "xlsx_mtime", None), 4: (None, None, None), 5: ("2024-02-29", None, None),
        6: ("2022-01-01", None, "Acme"), 7: (None, None, None), 8: ("2023-02-02", "quote_pdf_mtime", None), 9: ("2023-03-03", "quotes_json", None),
    }
    counts = {r["outcome"]: r["n"] for r in project_files.outcomes(done).collect()}
    assert counts == {"null_filled_files": 3, "bogus_replaced": 1, "null_unfilled": 1, "bogus_kept": 1, "already_real": 1, "null_filled_quotes": 1, "gc_updated": 2, "gc_skipped": 1}


def test_documents_of_a_folder_tree_and_no_content_is_read(spark, tmp_path):
    tree(tmp_path, ("Job/build up.xlsx", "2024-01-01"), ("Job/~$build up.xlsx", "2024-01-01"), ("Job/Quote 07.pdf", "2024-01-01"), ("Job/Archive/build up.xlsx", "2024-01-01"), ("Job/notes.txt", "2024-01-01"))
    listed = project_files.listed(spark, f"file://{tmp_path}")
    got = {(r["path"].rsplit("/", 1)[1], r["kind"], r["folder"]) for r in project_files.documents(listed).collect()}
    assert got == {("build up.xlsx", "build_up", "Job"), ("Quote 07.pdf", "own_quote", "Job")}
    assert "content" not in listed._jdf.queryExecution().executedPlan().toString()


def test_batches_give_the_alerts_of_one_run_and_late_rows_are_told(spark):
    items = domain(spark, SF, "quote_items")
    year = F.year("quote_date")
    batches = [items.filter(year <= 2022), items.filter(year == 2023), items.filter(year > 2023)]
    key = lambda df: sorted(map(str, df.collect()))
    assert key(increments.alerts_of_batches(batches)) == key(prices.price_alerts(items))
    state = increments.last_prices(items)
    alerts, late = increments.batch_alerts(batches[1], state)
    assert alerts.count() == 0 and late.count() == prices.priced_items(batches[1]).count()
    again = increments.merged_prices(state, increments.last_prices(batches[1]))
    assert key(again) == key(state)


def test_sketches_stay_within_their_errors(spark, tmp_path):
    scopes, projects = (domain(spark, "/root/testdata/sf0.01", t) for t in ("scopes", "projects"))
    late = F.year("quote_date") > 2023
    path = f"file://{tmp_path}/months"
    sketches.monthly(scopes, projects.filter(~late)).filter("month is not null").write.partitionBy("month").parquet(path)
    first = {p for p in os.listdir(tmp_path / "months") if p.startswith("month=")}
    sketches.monthly(scopes, projects.filter(late)).filter("month is not null").write.mode("append").partitionBy("month").parquet(path)  # new months; old ones aren't read
    assert first < set(os.listdir(tmp_path / "months"))
    stored = spark.read.parquet(path)
    for bucket in ("year", "quarter", "month"):
        exact = {r["date"]: r for r in prices.cost_trends(scopes, projects, bucket).collect()}
        approx = {r["date"]: r for r in sketches.trends(stored, bucket).collect()}
        assert exact.keys() == approx.keys()
        for k, r in exact.items():
            assert approx[k]["project_count"] == pytest.approx(r["project_count"], rel=0.05, abs=1)
            assert all(approx[k][c] == r[c] or approx[k][c] == pytest.approx(r[c], abs=0.02) for c in ("act", "awp", "fw", "sm"))
    whole = sketches.monthly(scopes, projects)
    costs = scopes.filter("cost_per_unit > 0")
    for r in sketches.type_statistics(whole).filter("n_cost > 0").collect():
        own = costs.filter(F.col("scope_type") == r["scope_type"])
        below = own.filter(F.col("cost_per_unit") < r["median_cost"]).count() / own.count()
        assert r["n_cost"] == own.count() and abs(below - 0.5) < 0.03

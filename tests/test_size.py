"""What makes work grow faster than its input: few tasks, or the same rows worked out again."""

from pyspark.sql import functions as F

from tallyworks.operators import comparables, estimates, increments, links, model_features, plan_chain, plan_pages, plan_rooms, products, quantiles, quotes, schedules
from tallyworks.plans import range_queries
from tallyworks.plans.tables import domain
from tallyworks.sources import project_files

PAGES, MARKS = "plan_id string, page_no int, text string", "plan_id string, page_no int, mark_id string, label string, area_sf double"


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_lines_of_pages_are_read_once_for_ceilings(spark):
    pages = spark.createDataFrame([("p", 1, "ACT-1 9'-0\" AFF\nnone\nnone\nnone\nnone\nGWB\nnone\nnone\nnone\nnone\nACT ACT-1"), ("p", 2, "ACT-2")], PAGES).coalesce(1)
    marks = spark.createDataFrame([("p", 1, "m1", "ACT-1 - 2,450 SF", None), ("p", 1, "m2", "FW-2", 10.0), ("p", 2, "m3", "ACT-1 - 10 SF", 1.0)], MARKS)
    found = plan_rooms.ceilings(pages, marks)
    assert _plan(found).count("Generate inline") == 1
    got = sorted((r["page_no"], r["tag"] or "", r["ceiling"], r["area_sf"]) for r in found.collect())
    assert got == [(1, "", "GWB", None), (1, "ACT-1", "ACT", None), (1, "FW-2", "FW", 10.0), (2, "ACT-1", "ACT", 10.0), (2, "ACT-2", "ACT", None)]


def test_rooms_of_one_file_are_many_tasks_and_prefixes_are_looked_up_once(spark):
    pages = spark.createDataFrame([("p", k, f"ROOM 10{k} - LAB\nACT-1") for k in range(8)], PAGES).coalesce(1)
    marks = spark.createDataFrame([("p", 1, "m1", "CLOUD-1 see detail", None), ("p", 1, "m2", "FW-2", 10.0), ("p", 2, "m3", "WOOD-12", 1.0)], MARKS)
    rooms = plan_rooms.rooms(pages, marks)
    assert rooms.filter("found < 5").rdd.getNumPartitions() >= 4
    found = plan_rooms.suggested(rooms, plan_rooms.ceilings(pages, marks).limit(0))
    assert _plan(found).count("regexp_extract(upper(tag") < 10
    marked = sorted((r["scope_type"], r["tag"]) for r in found.filter("area_sf is not null").collect())
    assert marked == [("FW", "FW-2"), ("WW", "WOOD-12")]


def test_training_features_are_written_once_and_counted_values_have_medians(spark):
    sf = "/root/testdata/sf0.001"
    plan = _plan(model_features.training_features(domain(spark, sf, "scopes"), domain(spark, sf, "projects")))
    assert "contains" not in plan.lower() and plan.count("Join Inner, (project_id") == 0
    rows = spark.createDataFrame([("a", 1.0, 3), ("a", 5.0, 2), ("a", 9.0, 1), ("b", 2.0, 1), ("b", 4.0, 1), ("b", None, 5)], "k string, v double, n long")
    for most in (None, 0):
        got = {r["k"]: r["m"] for r in quantiles.medians(rows, ["k"], {"m": F.col("v")}, most, times="n").collect()}
        assert got == {"a": 3.0, "b": 3.0}


def test_few_bands_are_met_without_a_table_of_pairs(spark, monkeypatch):
    rows = spark.createDataFrame([(k, "ab"[k % 2] if k % 5 else None, None if k == 7 else float(k)) for k in range(20)], "row_id int, kind string, cost double")
    bands = spark.createDataFrame([("a", None, 6.0, "low"), ("a", 4.0, None, "high"), ("b", 3.0, 11.0, "mid"), (None, 0.0, 9.0, "none"), ("b", 5.0, 5.0, "empty")], "kind string, low double, high double, label string")
    found = schedules.banded(rows, bands, ["kind"], "cost", "no band")
    assert "banded" not in "".join(found.inputFiles())
    few = sorted((r["row_id"], r["label"]) for r in found.collect())
    monkeypatch.setattr(schedules, "FEW_BANDS", 0)
    assert few == sorted((r["row_id"], r["label"]) for r in schedules.banded(rows, bands, ["kind"], "cost", "no band").collect())


def test_hinted_projects_are_ranked_once_for_equal_hints(spark, monkeypatch):
    targets = spark.createDataFrame([(1, "Arena; park"), (2, "arena;park"), (3, ";; "), (4, None), (5, "hotel"), (5, "arena"), (6, "zoo")], "target_id int, hints string")
    projects = spark.createDataFrame([(k, f"{'Arena' if k % 2 else 'Hotel'} Park {k}") for k in range(12)], "project_id int, name string")
    found = links.hinted_projects(targets, projects)
    assert "Window" not in _plan(found)
    want = [(t, p, p + 1) for t in (1, 2, 5) for p in range(5)]
    assert sorted((r["target_id"], r["project_id"], r["rank"]) for r in found.collect()) == want
    monkeypatch.setattr(links, "FEW", 0)
    assert sorted((r["target_id"], r["project_id"], r["rank"]) for r in links.hinted_projects(targets, projects).collect()) == want


def test_medians_of_many_values_sort_only_what_lies_about_the_middle(spark, monkeypatch):
    import random
    import statistics

    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), rng.choice([rng.gauss(0, 1), 3.0, float(rng.randint(0, 9)), rng.random() * 1e12])) for _ in range(6000)] + [("c", 1.0), ("c", 4.0), ("d", None), ("e", 7.0)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(7)
    monkeypatch.setattr(quantiles, "SMALL", 1000)  # values; those between are fewer
    sorted_ = []
    monkeypatch.setattr(quantiles, "_bracketed", lambda *a, f=quantiles._bracketed: sorted_.append(f(*a)) or sorted_[-1])
    got = {r["k"]: r["m"] for r in quantiles.medians(df, ["k"], {"m": F.col("v")}).collect()}
    assert sorted_ and sorted_[0] is not None
    want = {k: statistics.median([v for kk, v in rows if kk == k and v is not None]) for k in ("a", "b", None, "c", "e")}
    assert {k: v for k, v in got.items() if k != "d"} == want
    monkeypatch.setattr(quantiles, "FEW_GROUPS", 1)
    assert {r["k"]: r["m"] for r in quantiles.medians(df, ["k"], {"m": F.col("v")}).collect()} == got


DRAWN = "plan_id int, page_no int, mark_id string, content string, subject string, title string, colour string"


def test_patterns_of_a_mark_are_read_once(spark):
    """As columns in a row they were read some thirty times, by code that was too long to compile."""
    pages = spark.createDataFrame([(1, 1, "SM by others")], PAGES.replace("plan_id string", "plan_id int"))
    marks = spark.createDataFrame([(1, 1, "a", "CLOUD-1 Area: 1,200.5 SF", None, None, "red"), (1, 1, "b", "AWP-2 Length: 10 LF", None, None, None), (1, 1, "c", None, "see", None, "#ff0000"), (1, 1, "d", None, None, None, "#ff0000"), (1, 1, "e", "ACT-1", None, None, "#ffff00")], DRAWN)
    found = plan_pages.suggested(pages, marks)
    assert _plan(found).count("regexp_extract(") <= 4
    got = sorted((r["scope_type"], r["tag"], r["area_sf"], r["length_lf"], r["confidence"], r["source"]) for r in found.collect())
    assert got == [("ACT", None, None, None, 0.7, "colour"), ("AWP", "AWP-2", None, 10.0, 0.95, "tag"), ("Baffles", "CLOUD-1", 1200.5, None, 0.95, "tag"), ("SM", None, None, None, 0.5, "keyword")]


def test_plans_are_dealt_once_into_a_fixed_number_of_parts(spark):
    pages = spark.createDataFrame([(k, 1, "ACT and FW by others, a page of text that is long enough to be read by all") for k in range(6)], PAGES.replace("plan_id string", "plan_id int"))
    marks = spark.createDataFrame([(k, 1, f"m{k}", f"ACT-{k} Area: {k}00 SF", None, None, None) for k in range(6)], DRAWN)
    found = plan_chain.estimated_plans(pages, marks)
    physical = found._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in physical
    assert len(found.collect()) == 5
    rows = spark.createDataFrame([(1, k, "ACT", "ACT-1", 10.0, 0.5, None, None) for k in range(3)], "plan_id int, seq int, scope_type string, scope_tag string, area_sf double, confidence double, product_hint string, room string")
    merged = plan_pages.merged(rows.repartition(4, "plan_id"))._jdf.queryExecution().executedPlan().toString()
    assert merged.count("Exchange ") == 1 and merged.split("Window")[0].count("Sort [") <= 1 and merged.count("Sort [plan_id#") <= 2
    kinds = [("ACT", 0.7), ("FW", 0.35), ("SM", 0.9), ("WW", 0.61)] * 30
    many = [(1, kind, 1000.1 + k, sure) for k, (kind, sure) in enumerate(kinds)]
    each = {tuple(r) for m in (many, many[::-1], sorted(many)) for r in estimates.project_estimates(spark.createDataFrame(m, "plan_id int, scope_type string, area_sf double, confidence double").coalesce(1)).collect()}
    assert len(each) == 1


def test_patterns_of_a_vendor_text_are_read_once(spark):
    docs = spark.createDataFrame([("a", "x.pdf", "FBM\nInvoice #INV-1001\n3/5/24\nLead time 2-3 weeks\n24-1234 Panel Blue 12 ctn $42.50 $1,040.00\nFreight: $225.00\nGrand Total: $3,100.00"), ("b", "armstrong.pdf", None)], "doc_id string, file_name string, text string")
    found = quotes.vendor_fields(docs)
    assert _plan(found).count("regexp_extract(") <= 10 and _plan(found).count("lower(substring") <= 1
    got = {r["doc_id"]: tuple(r)[1:] for r in found.collect()}
    assert got["a"] == ("FBM", "INV-1001", "3/5/24", "2-3 weeks", 225.0, None, 3100.0, 0.75) and got["b"][:6] == ("Armstrong", None, None, None, None, None)


def test_what_is_known_of_a_folder_is_one_join(spark):
    projects = spark.createDataFrame([(1, "Job 1", None, None), (2, "Job 2", None, None), (3, "+Job 2", None, None)], "project_id int, folder string, quote_date date, gc_name string")
    said = spark.createDataFrame([], "folder string, dated date")
    files = project_files.in_folders(spark.createDataFrame([("/itb/Job 1/b 1.2.2023.xlsx",), ("/itb/+Job 1/b 1.1.2020.xlsx",), ("file:///itb/+Job 2/Quote 3.pdf",), ("/itb/Job 2/sub/b 1.1.2021.xlsx",), ("/other/Job 2/b 1.1.2021.xlsx",)], "path string").withColumn("modified", F.lit("2022-05-06 00:00:00").cast("timestamp")), "/itb")
    who = spark.createDataFrame([("Job 1", " Acme "), ("Job 2", " ")], "folder string, gc_name string")
    found = project_files.enriched(projects, said, files, who)
    assert _plan(found).count("Join LeftOuter") == 1
    got = sorted((r["project_id"], str(r["quote_date"]), r["date_source"], r["gc_name"]) for r in found.collect())
    assert got == [(1, "2023-01-02", "xlsx_filename_date", "Acme"), (2, "2022-05-06", "quote_pdf_mtime", None), (3, "2022-05-06", "quote_pdf_mtime", None)]


def test_batches_meet_their_state_without_a_join(spark):
    row = lambda day, cost, k: ("tile", "sf", "V", f"2024-01-{day:02d}", k, 1, k, f"${cost}")
    schema = "product string, unit string, vendor string, quote_date string, quote_id int, line_no int, part_id int, unit_cost_text string"
    batch = lambda *rows: spark.createDataFrame(list(rows), schema).withColumn("quote_date", F.col("quote_date").cast("date"))
    found = increments.alerts_of_batches([batch(row(1, 10, 1), row(2, 20, 2)), batch(row(1, 99, 3), row(3, 21, 4)), batch(row(4, 30, 5))])
    assert "Join" not in _plan(found)
    assert sorted((str(r["old_date"]), str(r["quote_date"]), r["old_cost"], r["unit_cost"]) for r in found.collect()) == [("2024-01-01", "2024-01-02", 10.0, 20.0), ("2024-01-03", "2024-01-04", 21.0, 30.0)]


def test_names_are_matched_once_for_both_parts(spark):
    names = spark.createDataFrame([("dune on suprafine",), ("zzzz on dune",), ("wwww",)], "name string")
    aliases = spark.createDataFrame([("Dune", "Armstrong Dune", 0)], "alias string, canonical string, position int")
    found = products.linked(names, aliases)
    assert {f.split("/")[-2].split("-")[0] for f in found.inputFiles()} == {"names", "matched"}
    assert sorted((r["name"], r["product"]) for r in found.collect()) == [("dune on suprafine", "Armstrong Dune"), ("wwww", None), ("zzzz on dune", "Armstrong Dune")]


def test_an_audit_takes_one_shuffle_of_each_table(spark):
    expected = spark.createDataFrame([("a", 1, "ACT", "du", 100.0, None, "B"), ("b", 1, "fw", None, None, None, None), ("b", 1, "FW", None, None, None, None), ("c", 2, "A", None, None, None, None), ("d", None, None, None, None, None, None)], "expected_id string, project_id int, kind string, product string, area double, markup double, format string")
    scopes = spark.createDataFrame([(1, "act", "s2", "Dune", 100.5, None), (1, "ACT", "s1", "Ultima", 1.0, None), (1, "FW", "s4", "x", None, None), (1, "FW", "s3", "x", None, None), (2, "ACT", "s5", "x", None, None)], "project_id int, scope_type string, scope_id string, product_name string, square_footage double, markup_pct double")
    formats = spark.createDataFrame([(1, "B")], "project_id int, format string")
    with_shuffles = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = links.audited_in_full(expected, scopes, formats)
        assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hash") == 3
        got = sorted((r["expected_id"], r["scope_id"], r["product_ok"], r["area_ok"], r["format_ok"], r["passed"]) for r in found.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", with_shuffles)
    assert got == [("a", "s2", True, True, True, True), ("b", "s3", None, None, None, True), ("c", None, None, None, None, False), ("d", None, None, None, None, False)]


def test_equal_scopes_are_one_place_with_its_first_projects(spark, monkeypatch):
    scopes = spark.createDataFrame([(p, "ACT", 100.0, 5.0) for p in range(400)] + [(7, "ACT", 100.0, None), (3, "FW", 90.0, 4.0)], "project_id int, scope_type string, square_footage double, cost_per_unit double")
    targets = spark.createDataFrame([("t", "ACT", 100.0, 5.0), ("u", "FW", 90.0, 4.0), ("v", "ACT", 100.0, None)], "target_id string, kind string, area double, cost double")
    written = {}
    monkeypatch.setattr(comparables, "kept", lambda df, name, f=comparables.kept: written.setdefault(name, f(df, name)) if name == "scopes" else f(df, name))
    got = sorted((r["target_id"], r["rank"], r["project_id"]) for r in comparables.comparable_projects(targets, scopes).collect())
    assert written["scopes"].count() == 3 and {len(r["projects"]) for r in written["scopes"].collect()} == {1, 3}
    assert got == [("t", 1, 0), ("t", 2, 1), ("t", 3, 2), ("u", 1, 3), ("u", 2, 0), ("u", 3, 1), ("v", 1, 0), ("v", 2, 1), ("v", 3, 2)]


def test_targets_of_types_and_markups_are_counted_without_a_sort(spark):
    plan = range_queries._targets(domain(spark, "/root/testdata/sf0.001", "scopes"))._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "HashAggregate" in plan

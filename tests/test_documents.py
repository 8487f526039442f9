import random

from pyspark.sql import functions as F

from tallyworks.functions import classify, text
from tallyworks.operators import links, plan_pages, quotes


def test_quote_texts(spark):
    a = "Date: 03/15/2024\nQUOTE #: 02537\nQTY TYPE DESCRIPTION COST PER UNIT TOTAL\n1 ACT-1 Ceiling 45,000.00 45,000.00\n2 AWP-1 Panels 4,750.00 9,500.00\nMaterial Subtotal $38,000.00\nLabor Subtotal $14,000.00\nTax Subtotal $2,280.00\nGRAND TOTAL $54,280.00\nMILESTONE BILLING"
    b = "January 15, 2024\nQUOTE #: 05906-R1\nACOUSTIC PANEL FAB & INSTALL\nQTY TYPE DESCRIPTION COST PER UNIT TOTAL\n24 AWP-1 Fabric panel 850.00 20,400.00\nGrand Total\n\n$21,408.00"
    docs = spark.createDataFrame([("a", a), ("b", b), ("c", ""), ("d", None)], "doc_id string, text string")
    h = {r.doc_id: r for r in quotes.headers(docs).collect()}
    assert h["a"][1:] == ("02537", None, "03/15/2024", "T-004A", "MILESTONE BILLING")
    assert h["b"][1:5] == ("05906-R1", "R1", "January 15, 2024", "T-004B")
    assert h["c"][1:] == h["d"][1:] == (None,) * 5
    t = {r.doc_id: r[1:] for r in quotes.totals(docs).collect()}
    assert t == {"a": (38000.0, 14000.0, 2280.0, 54280.0), "b": (None, None, None, 21408.0), "c": (None,) * 4, "d": (None,) * 4}
    assert sorted((r.doc_id, r.item_type, r.total) for r in quotes.items(docs).collect()) == [("a", "ACT-1", 45000.0), ("a", "AWP-1", 9500.0), ("b", "AWP-1", 20400.0)]
    assert {r.doc_id: r.confidence for r in quotes.confidence(docs).collect()} == {"a": 1.0, "b": 1.0, "c": 0.0, "d": 0.0}


def test_heights_colours_and_types(spark):
    df = spark.createDataFrame([("9'-0\"", "24X48", "#ff0000"), ("9FT", "2 x 2", "#ffff00"), ('108"', "48 x 48", "#ffa500"), ("none", "", "red"), (None, None, None)], "h string, g string, c string")
    rows = df.select(text.height(F.col("h")), text.grid(F.col("g")), classify.colour_scope(F.col("c"))).collect()
    assert [tuple(r) for r in rows] == [("9'-0\"", "2x4", "ACT"), ("9'-0\"", "2x2", None), ("9'-0\"", "48 x 48", "Baffles"), (None, None, None), (None, None, None)]


def test_containing_against_brute_force(spark):
    rng = random.Random(3)
    word = lambda lo, hi: "".join(rng.choice("abc ") for _ in range(rng.randint(lo, hi)))
    needles, hays = [word(0, 6) for _ in range(150)] + [None], [word(0, 14) for _ in range(120)] + [None]
    got = links.containing(spark.createDataFrame([(x,) for x in needles], "needle string"), spark.createDataFrame([(x,) for x in hays], "hay string")).collect()
    want = {(n, h) for n in needles for h in hays if n and h and n in h}
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_empty_client_matches_any_project(spark):
    q = spark.createDataFrame([(1, ""), (2, None), (3, "Zed"), (4, "the Hall annex")], "quote_id int, client string")
    p = spark.createDataFrame([("Hall",), (None,)], "name string")
    assert sorted(r.quote_id for r in links.cross_referenced(q, p).collect()) == [1, 2, 4]
    assert links.cross_referenced(q, p.limit(0)).count() == 0


def test_areas_fall_back(spark):
    pages = spark.createDataFrame([(1, 1, "900 SF"), (2, 1, "900 SF and 900 SF and 1,000 sq ft, 5 SF"), (3, 1, "12'-6\" x 18'-0\" and 2x4"), (4, 1, ""), (4, 2, None)], "plan_id int, page_no int, text string")
    marks = spark.createDataFrame([(1, 1, "m", "ACT-1 Area: 568.87 sq ft", None, None, None), (1, 1, "n", "ACT-1 Area: 378.18 SF", None, None, None)], "plan_id int, page_no int, mark_id string, content string, subject string, title string, colour string")
    got = {r.plan_id: (r.source, r.area_sf, r.confidence) for r in plan_pages.areas(pages, marks).collect()}
    assert got == {1: ("marks", 947.05, 0.95), 2: ("labels", 1900.0, 0.7), 3: ("sides", 225.0, 0.4), 4: ("none", None, 0.0)}


def test_needles_that_share_their_words_are_told_apart_by_long_runs(spark):
    """Candidates grow with the texts, not with their square: each name lies in one client's name, and their words in all."""
    n = 1_200
    names = spark.createDataFrame([(f"st mary hospital tower {10_000 + i}",) for i in range(n)], "needle string")
    clients = spark.createDataFrame([(f"st mary hospital tower {10_000 + i} annex",) for i in range(n)], "hay string")
    found = links.candidates(names, clients)
    assert found.count() <= 12 * n  # 1,200 names of three-character runs have some 40 each
    assert links.containing(names, clients).count() == n
    assert {(r["side"], r["n"]) for r in links.linked_texts(names, clients).groupBy("side").count().withColumnRenamed("count", "n").collect()} == {("needle", n), ("hay", n)}


def test_many_short_needles_are_linked(spark):
    needles = [chr(97 + i) + chr(97 + j) for i in range(10) for j in range(10)] + ["q"]
    hays = ["abcab", "xyz", "jj", "queue"]
    got = {(r["text"], r["side"]) for r in links.linked_texts(spark.createDataFrame([(x,) for x in needles], "needle string"), spark.createDataFrame([(x,) for x in hays], "hay string")).collect()}
    pairs = [(a, b) for a in needles for b in hays if a in b]
    assert got == {(a, "needle") for a, _ in pairs} | {(b, "hay") for _, b in pairs}


def test_few_needles_are_tested_on_each_hay_without_runs(spark):
    """Runs are many times their texts, and a handful of hints needs none."""
    hays = spark.range(200).selectExpr("concat('palm apartments ', id) AS hay")
    found = links.containing(spark.createDataFrame([("palm",), ("7",), ("zoo",)], "needle string"), hays)
    assert "Generate" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert found.count() == 200 + sum("7" in str(i) for i in range(200))

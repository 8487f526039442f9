"""Codes against SQL and brute force, the tree against all distances, and odd tables."""

import compare
import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyworks.llm import vector_codes
from tallyworks.llm.queries import oracle_sql, queries

SCHEMA = "vec_id long, embedding array<float>, label int"


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_codes_against_sql(spark, sf):
    d = f"/root/testdata/sf{sf}"
    df = queries()["op12_vector_codes"](spark, d)
    assert compare.difference(df.collect(), df.columns, compare.connect(d), oracle_sql()["op12_vector_codes"]) == ""


@pytest.mark.parametrize("seed", range(6))
def test_tree_finds_the_lowest_of_the_nearest(seed):
    rng = np.random.default_rng(seed)
    n, width, most = [(1, 3, 5), (12, 2, 4), (13, 2, 4), (256, 16, 3), (256, 16, 1000), (700, 1, 50)][seed]
    points, queries_ = rng.integers(-most, most + 1, (n, width)), rng.integers(-most - 2, most + 3, (900, width))
    row, square = vector_codes.Gnat(points).nearest(queries_)
    every = ((queries_[:, None] - points[None]) ** 2).sum(axis=2)
    assert (square == every.min(axis=1)).all() and (row == every.argmin(axis=1)).all()


def test_tree_leaves_out_whole_subtrees():
    rng = np.random.default_rng(1)
    centres = rng.integers(-(10**6), 10**6, (16, 8))
    points = np.repeat(centres, 16, axis=0) + rng.integers(-50, 50, (256, 8))
    tree = vector_codes.Gnat(points)
    tree.nearest(points)
    assert tree.compared < 0.35 * 256 * 256


def test_large_components_are_exact_and_larger_ones_refused(spark):
    big = vector_codes.limit(4) // 1024 - 1
    rows = [(i, [float(s * big)] * 4, 0) for i, s in enumerate((1, -1, 1))]
    got = {r["vec_id"]: r["code"] for r in vector_codes.op12(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got == {0: "00000000", 1: "01010101", 2: "00000000"}
    with pytest.raises(ValueError, match="no long holds"):
        vector_codes.op12(spark.createDataFrame([(1, [1e38] * 4, 0)], "vec_id long, embedding array<double>, label int"))


def test_defined_cases(spark):
    rows = [(1, [0.0, 1.0, 2.0, 3.0], 7), (2, None, 7), (3, [1.0, None, 0.0, 0.0], 7), (4, [1.0, float("nan"), 0.0, 0.0], 7), (5, [float("inf"), 1.0, 1.0, 1.0], 7)]
    rows += [(6, [1.0, 2.0], 7), (7, [], 7), (8, [-0.0001, 1.0, 2.0, 3.0], None), (8, [-0.0001, 1.0, 2.0, 3.0], None), (None, [5.0, 1.0, 2.0, 3.0], None)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("code", F.lit("clash")).withColumn("own", F.lit(1)).withColumn("a.b", F.lit(1))
    got = sorted((r["vec_id"] or 0, r["code"], r["error"], r["label_error"]) for r in vector_codes.op12(df).collect())
    assert [g[0] for g in got] == [0, 1, 8, 8] and all(g[2] == 0 for g in got)
    assert got[2] == got[3] and got[1][1] == "00000000"
    assert vector_codes.op12(df.limit(0)).count() == 0
    assert vector_codes.op12(spark.createDataFrame([(1, [1.0, 2.0], 1)], SCHEMA)).count() == 0
    assert [(r["code"], r["error"]) for r in vector_codes.op12(spark.createDataFrame([(1, [], 1)], SCHEMA)).collect()] == [("00000000", 0)]


def test_label_error_sums_a_label(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(0, 1, 8)], [None, 1, 2][i % 3]) for i in range(900)]
    got = vector_codes.op12(spark.createDataFrame(rows, SCHEMA)).collect()
    label = {r[0]: r[2] for r in rows}
    for r in got:
        assert r["label_error"] == sum(x["error"] for x in got if label[x["vec_id"]] == label[r["vec_id"]])

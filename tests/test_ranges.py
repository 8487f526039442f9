"""Running values, as-of, interval and nearest joins against brute force, on many ranges and hot keys."""

import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tallyworks.operators import comparables, ranges, schedules


@pytest.fixture
def many_ranges(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_running_values_are_carried_over_ranges(spark, many_ranges):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "a", "a", "b", None]), k, rng.choice([None, k]), 1) for k in range(400)]
    df = spark.createDataFrame(rows, "k string, t int, v int, n long").repartition(7)
    got = ranges.carried(df, ["k"], [F.col("t")], {"sum_n": F.col("n")}, {"last_v": F.col("v")}).collect()
    want, total, last = {}, defaultdict(int), {}
    for k, t, v, n in rows:
        total[k] += n
        last[k] = v if v is not None else last.get(k)
        want[t] = (total[k], last[k])
    assert {r["t"]: (r["sum_n"], r["last_v"]) for r in got} == want


def test_rates_in_force_against_brute_force(spark, many_ranges):
    rng = random.Random(2)
    steps = [(rng.choice(["x", "x", "y", None]), rng.choice([None, *range(0, 900, 7)]), float(rng.randint(1, 9))) for _ in range(600)]
    rows = [(k, rng.choice(["x", "x", "x", "y", "z", None]), rng.choice([None, rng.randint(-5, 905)])) for k in range(700)]
    got = schedules.rates_in_force(spark.createDataFrame(rows, "row int, k string, t int"), spark.createDataFrame(steps, "k string, begins int, rate double"), ["k"], "t", 0.5)
    own = defaultdict(dict)
    for k, b, r in steps:
        if b is not None:
            own[k][b] = max(r, own[k].get(b, 0))
    for r in got.collect():
        s = own[r["k"]]
        past = [b for b in s if r["t"] is not None and b <= r["t"]]
        assert r["rate"] == (0.5 if not s else s[max(s)] if r["t"] is None else s[max(past)] if past else s[min(s)])
    assert got.count() == 700


def test_interval_join_against_brute_force(spark):
    rng = random.Random(3)
    end = lambda: rng.choice([None, *(round(rng.uniform(-50, 50) * 10 ** rng.randint(-3, 2), 3) for _ in range(6))])
    bands = [(rng.choice(["a", "b", None]), end(), end(), f"band {k}") for k in range(120)]
    rows = [(k, rng.choice(["a", "b", "c", None]), rng.choice([None, rng.uniform(-60, 60), float(rng.randint(-5000, 5000)), 0.0])) for k in range(300)]
    got = schedules.banded(spark.createDataFrame(rows, "row_id int, k string, v double"), spark.createDataFrame(bands, "k string, low double, high double, label string"), ["k"], "v", "none")
    want = []
    for i, k, v in rows:
        own = [b[3] for b in bands if v is not None and b[0] == k and (b[1] is None or b[1] <= v) and (b[2] is None or v < b[2])]
        want += [(i, x) for x in own or ["none"]]
    assert sorted((r["row_id"], r["label"]) for r in got.collect()) == sorted(want)


def like(kind, area, cost, k, a, c):
    size = 1 / (1 + abs(math.log(area / a))) if area and area > 0 and a > 0 else 0.0
    base = 0.5 * (kind is not None and kind == k) + 0.3 * size
    return base + 0.2 / (1 + abs(cost - c) / c) if cost and cost > 0 and c and c > 0 else base / 0.8


def made(seed):
    rng = random.Random(seed)
    kinds = ["ACT"] * 6 + ["FW"] * 3 + ["AWP", "rare", None]
    scopes = [(k, rng.randint(1, 60), rng.choice(kinds), rng.choice([None, 0.0, -5.0, *(float(rng.choice([100, 200, 300, 5000, rng.randint(1, 9000)])) for _ in range(9))]), rng.choice([None, 0.0, *(rng.uniform(1, 90) for _ in range(5))])) for k in range(400)]
    scopes += [(1000 + k, 1, "ACT", 100.0 + k / 8, 20.0 + k / 50) for k in range(300)]  # one project close to everything
    scopes += [(2000 + k, 70 + k, "rare", 50.0 + k, None) for k in range(2)]
    targets = [(k, rng.choice([*kinds, "unknown"]), rng.choice([None, 0.0, 100.0, 110.0, 250.0, rng.uniform(1, 20000)]), rng.choice([None, 0.0, 22.0, rng.uniform(0.5, 200)])) for k in range(60)]
    return scopes, targets


@pytest.mark.parametrize("seed", [1, 2])
def test_comparables_against_all_pairs(spark, seed):
    scopes, targets = made(seed)
    s = spark.createDataFrame(scopes, "scope_id int, project_id int, scope_type string, square_footage double, cost_per_unit double")
    t = spark.createDataFrame(targets, "target_id int, kind string, area double, cost double")
    got = defaultdict(list)
    for r in comparables.comparable_projects(t, s).orderBy("target_id", "rank").collect():
        got[r["target_id"]].append((r["project_id"], round(r["score"], 5)))
    for i, kind, area, cost in targets:
        best = {}
        for _, p, k, a, c in scopes:
            if a and a > 0:
                best[p] = max(best.get(p, 0), like(kind, area, cost, k, a, c))
        order = sorted(best.items(), key=lambda x: (-round(x[1], 6), x[0]))[:3]
        assert got[i] == [(p, pytest.approx(v, abs=2e-5)) for p, v in order], (i, kind, area, cost)
    found = defaultdict(list)
    for r in comparables.comparable_scopes(t, s).orderBy("target_id", "rank").collect():
        found[r["target_id"]].append(r["scope_id"])
    for i, kind, area, _ in targets:
        order = sorted(((-round(like(kind, area, None, k, a, None), 6), sid) for sid, _, k, a, _ in scopes if a is not None))[:5]
        assert found[i] == [x[1] for x in order]
    near = defaultdict(list)
    for r in comparables.nearest_area(s, t.filter("area > 0")).orderBy("target_id", "rank").collect():
        near[r["target_id"]].append((r["off"], r["project_id"]))
    for i, kind, area, _ in targets:
        best = {}
        for _, p, k, a, _ in scopes:
            if a and a > 0 and k == kind and kind is not None and area and area > 0:
                best[p] = min(best.get(p, math.inf), abs(a - area))
        assert near[i] == sorted((v, p) for p, v in best.items())[:3]


def test_a_target_meets_few_rows(spark):
    rng = random.Random(5)
    points = spark.createDataFrame([(rng.uniform(0, 1), k) for k in range(20_000)], "x double, id int").withColumn("k", F.lit("one"))
    targets = spark.createDataFrame([(k, rng.uniform(0, 1), "one") for k in range(50)], "t int, at double, k string")
    met = ranges.Line(points, targets, ["k"], "x", "at", 3).window(3)
    assert met.count() <= 50 * 2 * 3 * 3

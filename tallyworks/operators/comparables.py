"""Comparables: the projects and scopes that are most like a target, found near it instead of among all.

A score falls with the distance of the logarithms of areas, and of costs where both sides have one.
Along one of them a target takes its neighbours by rank (``ranges.Line``).  Along both, scopes lie in the
cells of a grid, and a target looks into its own and the eight cells around; what lies outside them is a
cell's width away at least, which bounds its score.  A target is certain when its n-th best reaches
that bound; those that aren't go on with a grid of wider cells.  So a target meets some n rows, however
many scopes and targets there are.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .estimates import similarity
from .ranges import Line, first_by, kept, small

#: Decimals of a score, and the ratio of the widths of one grid's cells to the one before.
PLACES, WIDEN = 6, 4


def comparable_scopes(targets: DataFrame, scopes: DataFrame, n: int = 5) -> DataFrame:
    """For each target (target_id, kind, area) the n scopes most like it, costs aside; ties go to the smaller id.

    A scope of the target's type comes before any other, so others count only where a type has fewer than n.
    Sizes that aren't positive match nothing, so those scopes, and all scopes for a target of such a size, go by id.
    """
    none = F.lit(None).cast("double")
    rows = kept(scopes.filter("square_footage is not null").select(F.col("scope_type").alias("kind"), F.col("square_footage").cast("double").alias("x"), F.struct("scope_id", "scope_type", F.col("square_footage").cast("double").alias("square_footage")).alias("id")), "scopes")
    targets = kept(targets.select("target_id", "kind", F.col("area").cast("double").alias("area")), "targets")
    sized, unsized = targets.filter("area > 0"), targets.filter("not coalesce(area > 0, false)")
    enough = rows.groupBy("kind").count().filter(F.col("count") >= n).select("kind")
    few = kept(targets.join(enough, "kind", "left_anti").select(*targets.columns), "few")
    dead, first = (first_by(r, ["kind"], [F.col("id")], n).select("kind", "id") for r in (rows.filter("x <= 0"), rows))
    found = [Line(rows.filter("x > 0"), sized, ["kind"], "x", "area", n).window(n).drop("x"), sized.join(dead, "kind"), unsized.join(first, "kind")]
    if not few.isEmpty():  # their own scopes are fewer than n, so 2 n rows hold n others
        every = Line(rows.filter("x > 0"), few.filter("area > 0"), [], "x", "area", 2 * n).window(2 * n).drop("x")
        dead, first = (r.orderBy("id").limit(2 * n).select("id") for r in (rows.filter("x <= 0"), rows))
        found += [every, few.filter("area > 0").crossJoin(F.broadcast(dead)), few.filter("not coalesce(area > 0, false)").crossJoin(F.broadcast(first))]  # 2 n rows each
    pairs = reduce(DataFrame.unionByName, [f.select("target_id", "kind", "area", "id") for f in found]).distinct()
    score = F.round(similarity(F.col("kind"), F.col("area"), none, F.col("id.scope_type"), F.col("id.square_footage"), none), PLACES)
    ranked = first_by(pairs.select("target_id", F.col("id.scope_id").alias("scope_id"), score.alias("score")), ["target_id"], [F.desc("score"), F.col("scope_id")], n)
    return ranked.select("target_id", "rank", "scope_id", "score")


def _distinct(line: Line, score: Column, key: str, n: int, places: int | None = PLACES) -> DataFrame:
    """(key, project_id, score): the n best distinct projects (ids of the line), each by its best place; ``score`` falls away from a target on both sides.

    Windows grow until a target's n-th best is better than what stands at the ends of its window, by what rounding to ``places`` can hide.
    """
    rounded, hidden = (lambda c: c if places is None else F.round(c, places)), 0.0 if places is None else 10.0**-places
    side, done = 2 * n, []
    found = kept(line.window(side).select(key, line.x, "below", F.col("id").alias("project_id"), score.alias("score")), "window")
    while True:
        best = found.groupBy(key, "project_id").agg(F.max("score").alias("score"))
        best = kept(first_by(best, [key], [rounded(F.col("score")).desc(), F.col("project_id")], n, "nth_"), "best")
        ends = found.groupBy(key, "below", line.x).agg(F.max("score").alias("score")).groupBy(key, "below").agg(F.count("*").alias("places"), F.min("score").alias("edge"))
        ends = ends.filter(F.col("places") >= side).groupBy(key).agg(F.max("edge").alias("edge"))  # a side with fewer is done
        last = best.groupBy(key).agg(F.count("*").alias("n_"), F.min("score").alias("least"))
        rest = kept(ends.join(last, key).filter((F.col("n_") < n) | (F.col("least") < F.col("edge") + hidden)).select(key), "rest")
        done.append(best.join(small(rest), key, "left_anti"))
        if rest.isEmpty():
            return reduce(DataFrame.unionByName, done).select(key, "project_id", "score")
        line = line.only(rest, key)
        more = line.window(side * WIDEN, side).select(key, line.x, "below", F.col("id").alias("project_id"), score.alias("score"))
        found = kept(found.join(small(rest), key, "left_semi").unionByName(more), "window")
        side *= WIDEN


def nearest_area(scopes: DataFrame, targets: DataFrame, n: int = 3) -> DataFrame:
    """The n projects with a scope of the target's type (kind, area; and target_id where a type has several targets) whose area is nearest; ties go to the smaller project."""
    key = "target_id" if "target_id" in targets.columns else "kind"
    points = scopes.filter("square_footage > 0").select(F.col("scope_type").alias("kind"), F.col("square_footage").cast("double").alias("place"), F.col("project_id").alias("id"))
    line = Line(points, targets.filter("kind is not null"), ["kind"], "place", "area", n)
    found = _distinct(line, -F.abs(F.col("place") - F.col("area")), key, n, None).withColumn("off", -F.col("score"))
    return first_by(found, [key], [F.col("off"), F.col("project_id")], n).select(key, "project_id", "off", "rank")


def _grid(points: DataFrame, targets: DataFrame, keys: list[str], n: int) -> DataFrame:
    """(target_id, project_id, score): the n best distinct projects of each target among points (kind, x, y, cost, area, projects) of equal keys; both have costs.

    ``same`` of a target is what being of its type counts here.
    """
    mine, theirs = targets.select("target_id", "same", "kind", "area", "cost", F.log("area").alias("tx"), F.log("cost").alias("ty")), points
    sizes = theirs.agg(F.count("*"), F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    ends = mine.agg(F.min("tx"), F.max("tx"), F.min("ty"), F.max("ty")).first()
    if not sizes[0] or ends[0] is None:
        return targets.select("target_id", F.lit(None).cast(dict(points.select(F.explode("projects").alias("p")).dtypes)["p"]).alias("project_id"), F.lit(None).cast("double").alias("score")).limit(0)
    wide, high = (max(a, b) - min(c, d) for a, b, c, d in ((sizes[2], ends[1], sizes[1], ends[0]), (sizes[4], ends[3], sizes[3], ends[2])))
    cell, done = max(1e-4, math.sqrt(max(wide, 1e-3) * max(high, 1e-3) * 2 * n / sizes[0])), []
    while True:
        at = lambda c, w=cell: F.floor(F.col(c) / w).cast("long")
        around = F.array(*[F.struct((at("tx") + i).alias("cx"), (at("ty") + j).alias("cy")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
        left = mine.withColumn("c_", F.explode(around)).select("*", "c_.cx", "c_.cy").drop("c_")
        right = theirs.select(*[F.col(k).alias(f"{k}_own") for k in keys], at("x").alias("cx"), at("y").alias("cy"), F.col("kind").alias("other_kind"), F.col("area").alias("area_own"), F.col("cost").alias("cost_own"), "projects")
        on = reduce(Column.__and__, [F.col(k) == F.col(f"{k}_own") for k in keys], (left["cx"] == right["cx"]) & (left["cy"] == right["cy"]))
        met = left.join(right, on)
        if not keys:  # its own type is looked at elsewhere
            met = met.filter(~F.col("kind").eqNullSafe(F.col("other_kind")))
        score = F.col("same") + similarity(F.lit(None), F.col("area"), F.col("cost"), F.lit(None), F.col("area_own"), F.col("cost_own"))
        best = met.select("target_id", score.alias("score"), F.explode("projects").alias("project_id")).groupBy("target_id", "project_id").agg(F.max("score").alias("score"))
        best = kept(first_by(best, ["target_id"], [F.desc(F.round("score", PLACES)), F.col("project_id")], n, "nth_"), "best")
        # what lies outside is a cell away in area or in cost
        outside = max(0.3 / (1 + cell) + 0.2, 0.3 + 0.2 / (2 - math.exp(-cell)))
        last = best.groupBy("target_id").agg(F.count("*").alias("n_"), F.min("score").alias("least"))
        sure = mine.join(last, "target_id").filter((F.col("n_") >= n) & (F.col("least") > F.col("same") + outside + 2 * 10.0**-PLACES)).select("target_id")
        whole = cell > max(wide, high)
        rest = kept(mine.join(sure, "target_id", "left_anti") if not whole else mine.limit(0), "rest")
        done.append(best.join(rest.select("target_id"), "target_id", "left_anti").select("target_id", "project_id", "score"))
        if rest.isEmpty():
            return reduce(DataFrame.unionByName, done)
        mine, cell = rest, cell * WIDEN


def comparable_projects(targets: DataFrame, scopes: DataFrame, n: int = 3) -> DataFrame:
    """For each target (target_id, kind, area, cost) the n projects whose best scope is most like it; ties go to the smaller project.

    Scopes of a positive size count.  A scope of the target's type scores above any other, so others count
    only where fewer than n projects have the type (n of all hold those that are missing).  Scopes and targets without a positive cost are compared
    by area alone, targets without a positive area by cost alone.
    """
    cost = lambda c: F.when(F.col(c) > 0, F.col(c).cast("double"))
    rows = scopes.filter("square_footage > 0").select("project_id", F.col("scope_type").alias("kind"), F.col("square_footage").cast("double").alias("area"), cost("cost_per_unit").alias("cost"))
    # Of scopes that are equal in type, area and cost only the n first projects can be among the n best, whatever a target compares: a row a place.
    place = ["kind", "area", "cost"]
    first = rows.withColumn("nth_", F.dense_rank().over(Window.partitionBy(*place).orderBy("project_id"))).filter(F.col("nth_") <= n)
    spots = kept(first.groupBy(*place).agg(F.collect_set("project_id").alias("projects")), "scopes")
    rows = spots.select(*place, F.explode("projects").alias("project_id"))
    t = kept(targets.select("target_id", "kind", F.col("area").cast("double").alias("area"), cost("cost").alias("cost")), "targets")
    # Projects fall into 64 classes: a type with n classes has n projects, so only the types that have fewer are counted.
    classes = kept(rows.groupBy("kind").agg(F.size(F.collect_set(F.pmod(F.xxhash64("project_id"), F.lit(64)))).alias("classes")), "classes")
    counted = rows.join(F.broadcast(classes.filter(F.col("classes") < n)), "kind", "left_semi").select("kind", "project_id").distinct().groupBy("kind").count()
    enough = classes.filter(F.col("classes") >= n).select("kind").unionByName(counted.filter(F.col("count") >= n).select("kind"))
    typed, few = (kept(t.join(enough, "kind", how).select(*t.columns), "targets") for how in ("left_semi", "left_anti"))
    found = _alike(typed, spots, ["kind"], n, 0.5)
    if not few.isEmpty():
        own = few.join(rows.select("kind", "project_id", F.col("area").alias("area_own"), F.col("cost").alias("cost_own")), "kind")  # of fewer than n projects
        score = similarity(F.col("kind"), F.col("area"), F.col("cost"), F.col("kind"), F.col("area_own"), F.col("cost_own"))
        found += [own.groupBy("target_id", "project_id").agg(F.max(score).alias("score")), *_alike(few, spots, [], n, 0.0)]
    every = reduce(DataFrame.unionByName, [f.select("target_id", "project_id", "score") for f in found])
    every = every.groupBy("target_id", "project_id").agg(F.round(F.max("score"), PLACES).alias("score"))
    return first_by(every, ["target_id"], [F.desc("score"), F.col("project_id")], n).select("target_id", "rank", "project_id", "score")


def _alike(targets: DataFrame, spots: DataFrame, keys: list[str], n: int, same: float) -> list[DataFrame]:
    """Candidates (target_id, project_id, score) by what targets and scopes have: area and cost, one of them, or none.  Without keys, types are told apart by the caller."""
    out, rows = [], spots.select("kind", "area", "cost", F.explode("projects").alias("project_id"))
    part = lambda where: (lambda df: None if df.isEmpty() else df)(targets.filter(where))

    def line(some: DataFrame, points: DataFrame, at: str, score: Column) -> DataFrame:
        return _distinct(Line(points.select(*keys, F.col(at).alias("place"), F.col("project_id").alias("id")), some, keys, "place", at, n), score, "target_id", n)

    by_area = (F.lit(same) + F.lit(0.3) / (1 + F.abs(F.log(F.col("area") / F.col("place"))))) / 0.8
    by_cost = F.lit(same) + F.lit(0.2) / (1 + F.abs(F.col("cost") - F.col("place")) / F.col("place"))
    priced, free = rows.filter("cost is not null"), rows.filter("cost is null")
    if (some := part("area > 0 and cost is not null")) is not None:
        points = spots.filter("cost is not null").withColumns({"x": F.log("area"), "y": F.log("cost")})
        out.append(_grid(points, some.withColumn("same", F.lit(same)), keys, n))
        if not free.isEmpty():
            out.append(line(some, free, "area", by_area))
    if (some := part("area > 0 and cost is null")) is not None:
        out.append(line(some, rows, "area", by_area))
    if (some := part("not coalesce(area > 0, false) and cost is not null")) is not None:
        out.append(line(some, priced, "cost", by_cost))
        out.append(_first(some, free, keys, n).withColumn("score", F.lit(same / 0.8)))
    if (some := part("not coalesce(area > 0, false) and cost is null")) is not None:
        out.append(_first(some, rows, keys, n).withColumn("score", F.lit(same / 0.8)))
    return out


def _first(targets: DataFrame, rows: DataFrame, keys: list[str], n: int) -> DataFrame:
    """The n first projects of a target's type, or of all."""
    projects = rows.select(*keys, "project_id").distinct()
    if keys:
        return targets.join(first_by(projects, keys, [F.col("project_id")], n, "nth_"), keys)
    return targets.crossJoin(F.broadcast(projects.orderBy("project_id").limit(n)))  # n rows

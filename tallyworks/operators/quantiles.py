"""Exact medians by counted values.

Up to SMALL values, and for many groups, equal values are counted before anything is shuffled, and the
counts are written once.  Then each group's counts are added up in the order of its values, and the medians
are where the sums cross the middle.  Up to SMALL counted values a task adds up a group; beyond it the sums
run over ranges of (group, value) and are carried from one to the next, so no task holds a group, wherever its
values lie.  The percentile aggregate keeps all distinct values of a group in one buffer.

More values of up to FEW_GROUPS groups are not shuffled: a sketch gives two values that have the middle
between them, the values below are counted, and only those between are sorted.  Whether the middle lies
there is checked by the counts, so the sketch decides nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranges import carried, kept, small

#: Counted values of all groups up to which one task may add up a group.
SMALL = 1_000_000
#: Groups up to which their middles are bracketed by sketches, the sketches' accuracy, and how far from the middle its bracket ends, in parts of a group.
FEW_GROUPS, ACCURACY, BRACKET = 100, 10_000, 0.0003


def medians(rows: DataFrame, keys: list[str], values: dict[str, Column], most: int | None = None, times: str | None = None) -> DataFrame:
    """(keys, names of ``values``): the median of each value's non-null numbers, null where there is none; null keys are a group.

    A row counts as often as its column ``times`` says, once without it.
    """
    pairs = F.array(*[F.struct(F.lit(name).alias("name"), v.cast("double").alias("v")) for name, v in values.items()])
    said = rows.select(*keys, (F.lit(1) if times is None else F.col(times)).cast("long").alias("times_"), F.explode(pairs).alias("x")).select(*keys, "times_", "x.*").filter("v is not null")
    group, most_ = [*keys, "name"], SMALL if most is None else most
    if times is None:
        said = kept(said, "values")
        if said.count() > most_ and (found := _bracketed(said, group)) is not None:
            return _wide(found, keys, values)
    counted = kept(said.groupBy(*group, "v").agg(F.sum("times_").alias("n")), "counted")
    if counted.count() <= most_:
        at = Window.partitionBy(*group).orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        whole = counted.withColumns({"at": F.sum("n").over(at), "total": F.sum("n").over(Window.partitionBy(*group))})
    else:
        totals = kept(counted.groupBy(*[F.col(c).alias(f"{c}_of") for c in group]).agg(F.sum("n").alias("total")), "totals")
        same = [F.col(c).eqNullSafe(F.col(f"{c}_of")) for c in group]
        whole = carried(counted, group, [F.col("v")], {"at": F.col("n")}).join(small(totals), same)
    return _wide(_middle(whole, group), keys, values)


def _middle(whole: DataFrame, group: list[str]) -> DataFrame:
    """(group, a, b): the values on both sides of the middle, out of counted values (v, n) with the count up to them and of all (at, total)."""
    first, last = F.floor((F.col("total") - 1) / 2), F.floor(F.col("total") / 2)
    middle = whole.filter((F.col("at") - F.col("n") <= last) & (F.col("at") > first))
    return middle.groupBy(*group).agg(F.min(F.when(F.col("at") > first, F.col("v"))).alias("a"), F.min(F.when(F.col("at") > last, F.col("v"))).alias("b"))


def _wide(found: DataFrame, keys: list[str], values: dict[str, Column]) -> DataFrame:
    # As the percentile aggregate and DuckDB: the lower one and half the way to the upper one.
    return found.groupBy(*keys).agg(*[F.max(F.when(F.col("name") == name, F.col("a") + (F.col("b") - F.col("a")) * 0.5)).alias(name) for name in values])


def _bracketed(said: DataFrame, group: list[str]) -> DataFrame | None:
    """As ``_middle``, of the written rows ``said`` (group, v); None where there are many groups, many values between or a middle isn't between."""
    totals = kept(said.groupBy(*group).agg(F.count("*").alias("total")), "totals")
    if totals.limit(FEW_GROUPS + 1).count() > FEW_GROUPS:
        return None
    ends = F.percentile_approx("v", [0.5 - BRACKET, 0.5 + BRACKET], ACCURACY)
    of = kept(said.groupBy(*[F.col(c).alias(f"{c}_of") for c in group]).agg(ends.alias("ends"), F.count("*").alias("total")), "brackets")
    same = [F.col(c).eqNullSafe(F.col(f"{c}_of")) for c in group]
    rows = said.join(F.broadcast(of), same).select(*group, "v", "total", F.col("ends")[0].alias("low"), F.col("ends")[1].alias("high"))
    # Values below the bracket are one counted value of their group, those within it stay apart, those above are left out.
    within = F.when(F.col("v") >= F.col("low"), F.col("v"))
    counted = kept(rows.filter("v <= high").groupBy(*group, within.alias("v"), "total").agg(F.count("*").alias("n")), "counted")
    if counted.count() > SMALL:
        return None
    at = Window.partitionBy(*group).orderBy(F.col("v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = kept(counted.withColumn("at", F.sum("n").over(at)), "whole")
    held = whole.groupBy(*group, "total").agg(F.sum(F.when(F.col("v").isNull(), F.col("n"))).alias("below"), F.sum("n").alias("upto"))
    off = held.filter((F.coalesce("below", F.lit(0)) > F.floor((F.col("total") - 1) / 2)) | (F.col("upto") <= F.floor(F.col("total") / 2)))
    if held.count() < totals.count() or not off.isEmpty():
        return None
    return _middle(whole.filter("v is not null"), group)

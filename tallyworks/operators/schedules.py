"""Rates in force and bands, from tables of any size."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rates import CURRENT_RATE
from .ranges import as_of, in_bands, kept, small

#: Bands up to which each row is held against all bands of its key.
FEW_BANDS = 1_000


def rates_in_force(rows: DataFrame, schedule: DataFrame, keys: list[str], at: str, default: float = CURRENT_RATE) -> DataFrame:
    """``rows`` with the ``rate`` of their key's schedule (keys, begins, rate) in force ``at`` a date.

    Before the first step the first rate counts, without a date the last one, without a schedule the
    default; of steps of one day the highest.  Steps without a date or rate are none.
    """
    steps = kept(schedule.filter("begins is not null and rate is not null").groupBy(*keys, "begins").agg(F.max("rate").cast("double").alias("rate")), "schedule")
    found = as_of(rows, steps, keys, at, "begins", "rate")
    ends = kept(steps.groupBy(*[F.col(k).alias(f"{k}_own") for k in keys]).agg(F.min_by("rate", "begins").alias("first_"), F.max_by("rate", "begins").alias("last_")), "ends")
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"{k}_own")) for k in keys])
    rate = F.coalesce("rate", F.when(F.col(at).isNull(), F.col("last_")).otherwise(F.col("first_")), F.lit(default))
    return found.join(small(ends), same, "left").select(*[F.col(f"`{c}`") for c in rows.columns], rate.alias("rate"))


def banded(rows: DataFrame, bands: DataFrame, keys: list[str], at: str, unknown: str) -> DataFrame:
    """``rows`` with the ``label`` of each band (keys, low, high, label) that holds ``at``: a row for each, or one with ``unknown``.

    Bands are half-open, may overlap, and are open where an end is null.  Rows need a column ``row_id``.
    FEW_BANDS bands are broadcast and tested on each row; more are met by cells.
    """
    own = kept(bands.select(*keys, "low", "high", "label"), "bands")
    if own.limit(FEW_BANDS + 1).count() <= FEW_BANDS:
        v = F.col(at).cast("double")
        few = own.select(*[F.col(k).alias(f"{k}_own") for k in keys], F.col("low").cast("double").alias("low_"), F.col("high").cast("double").alias("high_"), "label")
        inside = v.isNotNull() & F.coalesce(F.col("low_") <= v, F.lit(True)) & F.coalesce(v < F.col("high_"), F.lit(True))
        same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"{k}_own")) for k in keys], inside)
        met = rows.join(F.broadcast(few.withColumn("met_", F.lit(True))), same, "left")
        return met.select(*rows.columns, F.when(F.col("met_"), F.col("label")).otherwise(unknown).alias("label"))
    met = kept(in_bands(rows, own, keys, at, "low", "high").select(*rows.columns, "label"), "banded")
    rest = rows.join(met.select("row_id").distinct(), "row_id", "left_anti")
    return met.unionByName(rest.select(*rows.columns, F.lit(unknown).alias("label")))

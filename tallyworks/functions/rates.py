"""Labour rates: the schedule, bands, and normalisation to the present rate."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
CURRENT_RATE = 725.0
SCHEDULE = [("2020-01-01", 486.0), ("2023-01-01", 504.0), ("2023-07-01", 522.0), ("2024-04-01", 540.0), ("2024-09-01", 558.0), ("2025-03-01", 580.0), ("2026-01-01", 725.0)]
ERAS = [
    (0, 490, "Era 1 (~pre-2023, $486/day)"),
    (490, 514, "Era 2 (2023-early 2024, $504/day)"),
    (514, 535, "Era 3 (early-mid 2024, $522/day)"),
    (535, 556, "Era 4 (mid 2024, $540/day)"),
    (556, 580, "Era 5 (late 2024, $558/day)"),
    (580, 700, "Era 6 (2025, $580-$650/day)"),
    (700, 9999, "Era 7 (current, $725/day)"),
]


def rate_on(date: Column) -> Column:
    """The rate in force on a date: the last step not after it, the first rate before all, the present rate for null."""
    out = F.when(date.isNull(), CURRENT_RATE)
    for start, rate in reversed(SCHEDULE):
        out = out.when(date >= F.lit(start).cast("date"), rate)
    return out.otherwise(SCHEDULE[0][1])


def era(rate: Column) -> Column:
    """The half-open band that holds a rate."""
    out = F.when(F.lit(False), "")
    for low, high, label in ERAS:
        out = out.when((rate >= low) & (rate < high), label)
    return out.otherwise("Era Unknown")


def labour_factor(rate: Column) -> Column:
    return F.when(rate > 0, F.round(F.lit(CURRENT_RATE) / rate, 4))


def normal_labour(man_days: Column, rate: Column, labour: Column) -> Column:
    """Man-days at the present rate, else labour scaled to it, else null."""
    return F.when(man_days > 0, F.round(man_days * CURRENT_RATE, 2)).when(labour.isNotNull() & (rate > 0), F.round(labour * (F.lit(CURRENT_RATE) / rate), 2))

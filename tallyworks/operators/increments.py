"""State that batches are merged into, so that a new batch is worked out without the rows before it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .prices import priced_items, summary_of_totals, vendor_totals
from .ranges import kept

KEYS = ["product_key", "unit_key", "vendor_key"]
_PLACE = ["quote_date", "quote_id", "line_no", "part_id", "unit_cost"]


def last_prices(items: DataFrame) -> DataFrame:
    """(product_key, unit_key, vendor_key, last): the last observation of each, as a struct of date, quote, line, part and cost."""
    return priced_items(items).groupBy(*KEYS).agg(F.max(F.struct(*_PLACE)).alias("last"))


def merged_prices(state: DataFrame, batch: DataFrame) -> DataFrame:
    """The state after a batch (both as ``last_prices`` gives them): a row a key, whatever the history."""
    return state.unionByName(batch).groupBy(*KEYS).agg(F.max("last").alias("last"))


def _observed(items: DataFrame, state: DataFrame | None) -> DataFrame:
    """(keys, now, held, old, next, last): a batch's priced rows and the state's, each with the ones before and after it, and with the state's last of its key.

    The state's row stands among the rows of its key, so one shuffle and one sort serve for all of them.
    """
    rows = priced_items(items).select(*KEYS, F.struct(*_PLACE).alias("now"), F.lit(False).alias("held"))
    if state is not None:
        rows = rows.unionByName(state.select(*KEYS, F.col("last").alias("now"), F.lit(True).alias("held")))
    ordered = Window.partitionBy(*KEYS).orderBy("now")
    rows = rows.withColumns({"old": F.lag("now").over(ordered), "next": F.lead("now").over(ordered)})
    return rows.withColumn("last", F.max(F.when(F.col("held"), F.col("now"))).over(Window.partitionBy(*KEYS)))


def _changed(seen: DataFrame, threshold: float) -> DataFrame:
    """``seen`` with ``pct``, and ``alert``: a row of the batch, after the state's last, whose price differs enough from the one before."""
    pct = F.round((F.col("now.unit_cost") - F.col("old.unit_cost")) * 100 / F.col("old.unit_cost"), 1)
    fresh = ~F.col("held") & F.coalesce(F.col("now") > F.col("last"), F.lit(True))
    return seen.withColumn("pct", pct).withColumn("alert", fresh & F.coalesce(F.abs("pct") >= threshold, F.lit(False)))


def _alerts(changed: DataFrame) -> DataFrame:
    return changed.filter("alert").select(*KEYS, F.col("old.quote_date").alias("old_date"), F.col("now.quote_date").alias("quote_date"), F.col("old.unit_cost").alias("old_cost"), F.col("now.unit_cost").alias("unit_cost"), "pct")


def batch_alerts(items: DataFrame, state: DataFrame, threshold: float = 10.0) -> tuple[DataFrame, DataFrame]:
    """(alerts, late) of a batch: price alerts as ``prices.price_alerts`` gives them, the first observation of a key against the state's last.

    ``late`` are the priced rows that aren't after the state's last observation of their key; they give no
    alert, since the rows around them may have given theirs, and are for the caller to run with the history.
    """
    seen = _observed(items, state)
    late = seen.filter(~F.col("held") & (F.col("now") <= F.col("last"))).select(*KEYS, "now.*")
    return _alerts(_changed(seen, threshold)), late


def alerts_of_batches(batches: list[DataFrame], threshold: float = 10.0) -> DataFrame:
    """The alerts of batches that come one after another, each with the state that those before it left.

    A batch is read once: its alerts and the last row of each key, which is the state for the next, are written together.
    """
    state, out = None, None
    for k, batch in enumerate(batches):
        changed = _changed(_observed(batch, state), threshold)
        if k < len(batches) - 1:
            changed = kept(changed.withColumn("ends", F.col("next").isNull()).filter("alert or ends").drop("next", "last"), "prices")
            state = changed.filter("ends").select(*KEYS, F.col("now").alias("last"))
        out = _alerts(changed) if out is None else out.unionByName(_alerts(changed))
    return out


def merged_totals(state: DataFrame, batch: DataFrame) -> DataFrame:
    """Totals of quotes (as ``prices.vendor_totals``) after a batch; a quote may have items in several batches."""
    both = state.unionByName(batch)
    return both.groupBy("quote_id", "vendor").agg(F.sum("total").alias("total"), F.min("quote_date").alias("quote_date"), F.sum("items").alias("items"))


def summary_of_batches(batches: list[DataFrame]) -> DataFrame:
    """``prices.vendor_price_summary`` of all batches, from totals that each batch is merged into."""
    state = None
    for batch in batches:
        own = vendor_totals(batch)
        state = kept(own if state is None else merged_totals(state, own), "totals")
    return summary_of_totals(state)

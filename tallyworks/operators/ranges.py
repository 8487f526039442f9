"""Sorted work on tables of any size: running aggregates, as-of joins, interval joins, nearest rows.

Rows are sorted by ranges of (key, order), so a key with most of the rows is many tasks' work.  A range
works out running values of its own; what the ranges before hold of the same key is carried over.  A
range can only continue the key that it begins with, so what is carried is a row or two a range.
"""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows up to which a side that was counted is broadcast.
BROADCAST_ROWS = 100_000


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; without it only a local session has one, of this machine."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if path is None:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(path)
        path = spark.sparkContext.getCheckpointDir()
    return path.rstrip("/")


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, so that it is worked out once and survives lost executors."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, a table that was written, to be broadcast if it has so few rows."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def carried(rows: DataFrame, keys: list[str], order: list[Column], add: dict[str, Column], last: dict[str, Column] | None = None) -> DataFrame:
    """``rows`` with running values over their key in ``order``, each row's own included: sums of ``add`` and last non-null values of ``last``.

    Null keys are a key.  Rows that are equal in key and order have running values in any order among them.
    """
    last = last or {}
    columns = rows.columns
    key = F.struct(*[F.col(f"`{k}`") for k in keys]) if keys else F.struct(F.lit(0).alias("all"))
    named = [v.alias(f"order_{i}") for i, v in enumerate(order)]
    wide = rows.select(*[F.col(f"`{c}`") for c in columns], key.alias("key_"), *named, *[v.alias(n) for n, v in {**add, **last}.items()])
    by = [F.col(f"order_{i}") for i in range(len(order))]
    dealt = wide.repartitionByRange("key_", *by).withColumn("part_", F.spark_partition_id())
    dealt = kept(dealt, "ranges")
    inside = Window.partitionBy("part_", "key_").orderBy(*by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = dealt.withColumns({n: F.sum(n).over(inside) for n in add} | {n: F.last(n, ignorenulls=True).over(inside) for n in last})

    ends = dealt.groupBy("part_").agg(F.min("key_").alias("key_"))  # a row a range
    place = F.struct(*by)
    held = dealt.groupBy("part_", "key_").agg(*[F.sum(n).alias(n) for n in add], *[F.max_by(n, F.when(F.col(n).isNotNull(), place)).alias(n) for n in last])
    held = held.join(F.broadcast(ends.select("key_").distinct()), "key_", "left_semi")
    ahead = Window.partitionBy("key_").orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    before = held.select("part_", "key_", *[F.sum(n).over(ahead).alias(f"{n}_before") for n in add], *[F.last(n, ignorenulls=True).over(ahead).alias(f"{n}_before") for n in last])
    before = kept(before, "carried")  # two rows a range at most
    out = local.join(F.broadcast(before), ["part_", "key_"], "left")
    sums = [(F.coalesce(n, F.lit(0)) + F.coalesce(f"{n}_before", F.lit(0))).alias(n) for n in add]
    return out.select(*[F.col(f"`{c}`") for c in columns if c not in {**add, **last}], *sums, *[F.coalesce(n, f"{n}_before").alias(n) for n in last])


def as_of(rows: DataFrame, steps: DataFrame, keys: list[str], at: str, begins: str, value: str) -> DataFrame:
    """``rows`` with the ``value`` of the last of the key's ``steps`` that begins at or before ``at``; null where there is none, or no ``at``.

    Of steps that begin at once the greatest value counts.  Both tables may be of any size: they are sorted together.
    """
    line = F.struct(*[F.col(f"`{c}`") for c in rows.columns])
    kinds = dict(rows.dtypes)
    one = steps.filter(F.col(begins).isNotNull()).groupBy(*keys, begins).agg(F.max(value).alias("value_"))
    both = rows.select(*keys, F.col(at).alias("at_"), F.lit(1).alias("side_"), line.alias("row_"), F.lit(None).cast(dict(one.dtypes)["value_"]).alias("value_"))
    both = both.unionByName(one.select(*keys, F.col(begins).cast(kinds[at]).alias("at_"), F.lit(0).alias("side_"), "value_"), allowMissingColumns=True)
    found = carried(both, keys, [F.col("at_"), F.col("side_")], {}, {"found_": F.col("value_")})
    return found.filter("side_ = 1").select("row_.*", F.when(F.col("at_").isNotNull(), F.col("found_")).alias(value))


def in_bands(rows: DataFrame, bands: DataFrame, keys: list[str], at: str, low: str, high: str) -> DataFrame:
    """Pairs of ``rows`` and ``bands`` of the same key where low <= at < high; a null end is open, null keys are a key.

    An interval join by cells.  A band is cut into cells of a power of two that is its width at least, so it
    has two cells at most; a row has a cell for each width in use.  Cells are an equi-join, the exact
    test follows.  Open ends are cut where the rows end.  Columns of bands that rows have too, but for the
    keys, get the suffix ``_band``.
    """
    v, names = F.col(at).cast("double"), {c: f"{c}_band" if c in rows.columns and c not in keys else c for c in bands.columns}
    ends = rows.agg(F.min(v), F.max(v)).first()
    if ends[0] is None:
        ends = (0.0, 0.0)
    own = bands.select(*[F.col(f"`{c}`").alias(names[c]) for c in bands.columns])
    lo, hi = F.col(names[low]).cast("double"), F.col(names[high]).cast("double")
    cut = own.withColumn("low_", F.greatest(F.coalesce(lo, F.lit(ends[0])), F.lit(ends[0]))).withColumn("high_", F.least(F.coalesce(hi, F.lit(ends[1])), F.lit(ends[1])))
    cut = cut.filter((F.coalesce(lo < hi, F.lit(True))) & (F.col("low_") <= F.col("high_")))
    level = F.ceil(F.log2(F.greatest(F.col("high_") - F.col("low_"), F.lit(max(abs(ends[0]), abs(ends[1]), 1.0) * 2.0**-40)))).cast("int")
    cut = kept(cut.withColumn("level_", level), "bands")
    levels = sorted(r[0] for r in cut.select("level_").distinct().collect())  # exponents of doubles: some dozens
    if not levels:
        return rows.join(own.limit(0), F.lit(False)).select(*[rows[c] for c in rows.columns], *[own[names[c]] for c in bands.columns if c not in keys])
    cell = lambda x, k: F.floor(x / F.pow(F.lit(2.0), k)).cast("long")
    cut = cut.withColumn("cell_", F.explode(F.sequence(cell(F.col("low_"), F.col("level_")), cell(F.col("high_"), F.col("level_")))))
    cut = cut.drop("low_", "high_").withColumnsRenamed({k: f"{k}_own" for k in keys})
    wide = rows.withColumn("c_", F.explode(F.array(*[F.struct(F.lit(k).alias("level_"), cell(v, F.lit(k)).alias("cell_")) for k in levels])))
    wide = wide.filter(v.isNotNull()).withColumns({"level_": F.col("c_.level_"), "cell_": F.col("c_.cell_")}).drop("c_")
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"{k}_own")) for k in keys], (wide["level_"] == cut["level_"]) & (wide["cell_"] == cut["cell_"]))
    inside = (F.coalesce(F.col(names[low]).cast("double") <= v, F.lit(True))) & (F.coalesce(v < F.col(names[high]).cast("double"), F.lit(True)))
    return wide.join(small(cut), same).filter(inside).select(*[F.col(f"`{c}`") for c in rows.columns], *[F.col(names[c]) for c in bands.columns if c not in keys])


class Line:
    """Points on a line by key, ranked, and targets that look for what is nearest to them.

    ``points`` have (keys, x, id), ``targets`` (keys, at, ...); points without x and targets without at are
    left out.  A place holds its ``each`` first ids.  Ranks are running counts over points and targets
    together, so a target finds its neighbours by rank: an equi-join, a row a neighbour.
    """

    def __init__(self, points: DataFrame, targets: DataFrame, keys: list[str], x: str, at: str, each: int):
        self.keys, self.x = keys, x
        nth = F.dense_rank().over(Window.partitionBy(*keys, x).orderBy("id"))  # equal ids are one, and each task cuts its own before they are shuffled
        stops = points.filter(F.col(x).isNotNull()).select(*keys, x, "id").withColumn("nth_", nth).filter(F.col("nth_") <= each)
        stops = stops.groupBy(*keys, x).agg(F.array_sort(F.collect_set("id")).alias("ids_"))
        line = F.struct(*[F.col(f"`{c}`") for c in targets.columns])
        both = stops.select(*keys, F.col(x).cast("double").alias("at_"), F.lit(0).alias("side_"), F.lit(1).cast("long").alias("one_"), "ids_")
        both = both.unionByName(targets.filter(F.col(at).isNotNull()).select(*keys, F.col(at).cast("double").alias("at_"), F.lit(1).alias("side_"), F.lit(0).cast("long").alias("one_"), line.alias("row_")), allowMissingColumns=True)
        self.ranked = kept(carried(both, keys, [F.col("at_"), F.col("side_")], {"rank_": F.col("one_")}), "ranked")

    def window(self, side: int, inner: int = 0) -> DataFrame:
        """The targets' columns with (x, below, id): the ids of up to ``side`` places below (or at) and above each target, without the ``inner`` nearest ones of each side."""
        below = F.sequence(F.col("rank_") - (side - 1), F.col("rank_") - inner)
        above = F.sequence(F.col("rank_") + (inner + 1), F.col("rank_") + side)
        mine = self.ranked.filter("side_ = 1").select(*self.keys, "row_", F.col("rank_").alias("mine_"), F.explode(F.concat(below, above)).alias("rank_"))
        theirs = self.ranked.filter("side_ = 0").select(*[F.col(k).alias(f"{k}_own") for k in self.keys], F.col("rank_").alias("rank_own"), F.col("at_").alias("x_own"), "ids_")
        same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"{k}_own")) for k in self.keys], F.col("rank_") == F.col("rank_own"))
        found = mine.join(theirs, same).select("row_", F.col("x_own").alias(self.x), (F.col("rank_") <= F.col("mine_")).alias("below"), F.explode("ids_").alias("id"))
        return found.select("row_.*", self.x, "below", "id")

    def only(self, targets: DataFrame, key: str) -> "Line":
        """The same points for the targets whose ``key`` is in ``targets``."""
        out = object.__new__(Line)
        out.keys, out.x = self.keys, self.x
        own = targets.select(F.col(key).alias("own_"))
        mine = self.ranked.filter("side_ = 1").join(small(own), F.col(f"row_.{key}") == F.col("own_"), "left_semi")
        out.ranked = self.ranked.filter("side_ = 0").unionByName(mine)
        return out


def first_by(rows: DataFrame, keys: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first n rows of each key, numbered; cut by each task before they are shuffled."""
    return rows.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(rank) <= n)



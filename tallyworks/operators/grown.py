"""Forests and boosted trees grown over counted rows, many fits in one job.

Features are cut at 32 quantiles, as MLlib cuts them, but of all rows and not of a sample.  Rows that are equal in
features and target are counted before anything is shuffled, so a fit never sees a row twice; a task has
one fit (a family, a kind, a fold) and holds its counted rows as bytes a feature.  Drawing is by row: a counted row
comes as often as so many rows would, by Poisson's law for a forest and by the binomial one for boosting, so it is the
bootstrap of the rows.  Once drawn, rows of equal bins are one cell, and trees are grown level by level over cells.
Splits, leaves and weights of trees are those of MLlib's forest and boosting; ``Grown.write`` gives its models.

Beyond MOST counted rows ``counted`` gives None, and the caller's fits are Spark's own, distributed by row.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.feature import StringIndexerModel, VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, RandomForestRegressionModel
from pyspark.ml.util import MLWriter
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .ranges import kept

#: Bins of a feature, bins of types (bits of a split's mask), counted rows that one task may hold, and the lower bound of predictions in errors.
BINS, TYPES, MOST, FLOOR = 32, 63, 30_000_000, 0.5
#: Quantile of the absolute residuals beyond which Huber's loss cuts them.
ALPHA = 0.9
#: Distinct rows of features whose predictions a task remembers.
REMEMBERED = 1_000_000
#: Gain of a split, in parts of its sides' terms, up to which it is rounding.
ROUNDING = 1e-11
#: Joint bins of features that are counted in one pass.
JOINT = 1024


@dataclass(frozen=True)
class Fit:
    """One model: over a type's rows or (None) all, learned from the lots ``learnt``, its error taken over the lots ``held``."""

    family: str | None
    kind: str
    trees: int
    depth: int
    least: int = 1
    step: float = 0.05
    sample: float = 0.8
    tried: int | None = None
    learnt: tuple[int, ...] = (0,)
    held: tuple[int, ...] = ()
    seed: int = 42


@dataclass
class Counted:
    rows: DataFrame
    inputs: list[str]
    indexed: str
    types: list[str]
    lots: int


def counted(rows: DataFrame, target: Column, inputs: list[str], indexed: str = "scope_type", lot: Column | None = None, lots: int = 1, most: int | None = None) -> Counted | None:
    """``rows`` of a target, counted by features, target and lot (a row's part, 0 to ``lots`` - 1); None where they are too many for a task.

    ``indexed`` is the text column whose number is the input ``type_index``.
    """
    types = sorted(r[0] for r in rows.select(indexed).distinct().filter(F.col(indexed).isNotNull()).limit(TYPES + 1).collect())
    if len(types) > TYPES:
        return None
    said = rows.select(_type(indexed, types).alias("t"), *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(_numbers(inputs))], target.cast("double").alias("y"), (F.lit(0) if lot is None else lot).cast("int").alias("lot")).filter("y is not null")
    by = said.groupBy("t", *[f"x{i}" for i in range(len(_numbers(inputs)))], "y")
    own = kept(by.agg(F.array(*[F.sum((F.col("lot") == i).cast("long")) for i in range(lots)]).alias("n")), "counted")
    return None if own.count() > (MOST if most is None else most) else Counted(own, inputs, indexed, types, lots)


def _numbers(inputs: list[str]) -> list[str]:
    return [c for c in inputs if c != "type_index"]


def _type(indexed: str, types: list[str]) -> Column:
    """The number of a row's type; all that aren't known have the number after them."""
    at = F.array_position(F.array(*[F.lit(t) for t in types]).cast("array<string>"), F.col(indexed))
    return F.coalesce(F.when(at > 0, at - 1), F.lit(len(types))).cast("int")


def _edges(found: Counted, families: set[str | None]) -> dict[str | None, list[np.ndarray]]:
    """Each family's cuts of each feature: between neighbours of up to 32 values, else of 32 quantiles of its rows."""
    width = len(_numbers(found.inputs))
    out: dict[str | None, list] = {f: [[] for _ in range(width)] for f in families}
    if not width:
        return out
    lines = found.rows.select("t", F.aggregate("n", F.lit(0).cast("long"), lambda a, b: a + b).alias("n"), F.posexplode(F.array(*[f"x{i}" for i in range(width)])).alias("f", "v"))
    values = kept(lines.filter("v is not null").groupBy("t", "f", "v").agg(F.sum("n").alias("n")), "values")
    both = values.groupBy(F.lit(-1).alias("t"), "f", "v").agg(F.sum("n").alias("n"))
    both = both.unionByName(values) if families != {None} else both
    group = Window.partitionBy("t", "f")
    upto = group.orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = both.withColumns({"at": F.sum("n").over(upto), "rank": F.count("*").over(upto), "total": F.sum("n").over(group), "each": F.count("*").over(group)})
    part = F.when(F.col("each") <= BINS, F.col("rank")).otherwise(F.ceil(F.col("at") * BINS / F.col("total")))
    ends = ranked.groupBy("t", "f", part.alias("part")).agg(F.min("v").alias("low"), F.max("v").alias("high")).collect()  # 32 rows a feature and type
    for r in sorted(ends, key=lambda r: (r["t"], r["f"], r["part"])):
        family = None if r["t"] < 0 else found.types[r["t"]] if r["t"] < len(found.types) else ""
        if family in out:
            out[family][r["f"]].append((r["low"], r["high"]))
    return {f: [np.array([(a[1] + b[0]) / 2 for a, b in zip(x, x[1:], strict=False)]) for x in xs] for f, xs in out.items()}


def _binned(t: np.ndarray, xs: list[np.ndarray], edges: list[np.ndarray], at: int) -> np.ndarray:
    """A row a feature, bytes; no number is the last bin."""
    bins = [np.searchsorted(e, x, side="left").astype(np.uint8) for e, x in zip(edges, xs, strict=True)]
    return np.stack([*bins[:at], t.astype(np.uint8), *bins[at:]] if at >= 0 else bins)


def trained(found: Counted, fits: list[Fit]) -> list[tuple["Grown", float | None]]:
    """Each fit's model, and its mean absolute error over its held lots as a share of the target (None without any).

    Forests without held lots are dealt over tasks by their trees.
    """
    spark = found.rows.sparkSession
    spare = -(-spark.sparkContext.defaultParallelism // len(fits))
    pieces = []
    for k, fit in enumerate(fits):
        parts = min(spare, fit.trees) if fit.kind == "forest" and not fit.held else 1
        pieces += [(k, replace(fit, trees=fit.trees // parts + (p < fit.trees % parts), seed=fit.seed + 1_000 * p)) for p in range(parts)]
    pieces.sort(key=lambda p: (p[1].family is not None, p[1].kind == "forest"))  # the longest begin first
    edges = _edges(found, {f.family for f in fits})
    numbers, nominal, types = _numbers(found.inputs), (found.inputs.index("type_index") if "type_index" in found.inputs else -1), found.types
    of: dict[str | None, list[int]] = {}
    for j, (_, fit) in enumerate(pieces):
        of.setdefault(fit.family, []).append(j)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            t, y = batch.column("t").to_numpy(), batch.column("y").to_numpy()
            xs = [batch.column(f"x{i}").to_numpy(zero_copy_only=False) for i in range(len(numbers))]
            n = batch.column("n").flatten().to_numpy().reshape(len(t), -1)
            for family, own in of.items():
                rows = np.arange(len(t)) if family is None else np.flatnonzero(t == types.index(family))
                if not len(rows):
                    continue
                bins = _binned(t[rows], [x[rows] for x in xs], edges[family], nominal)
                jobs, blobs = [], []
                for j in own:
                    learnt, held = (n[rows][:, list(lots)].sum(axis=1) for lots in (pieces[j][1].learnt, pieces[j][1].held))
                    some = (learnt > 0) | (held > 0)
                    kind = np.uint32 if max(learnt.max(), held.max()) < 2**32 else np.int64
                    jobs.append(j)
                    blobs.append(pickle.dumps((bins[:, some], y[rows][some], learnt[some].astype(kind), held[some].astype(kind)), 5))
                yield pa.RecordBatch.from_arrays([pa.array(jobs, pa.int32()), pa.array(blobs, pa.binary())], ["job", "blob"])

    def grown(job: int, blobs: Iterator[tuple[int, bytes]]) -> Iterator[tuple]:
        parts = [pickle.loads(b) for _, b in blobs]
        if parts:
            yield job, *_fitted(pieces[job][1], [np.concatenate(a, axis=-1) for a in zip(*parts, strict=True)], nominal)

    blobs = found.rows.mapInArrow(dealt, "job int, blob binary").rdd.map(lambda r: (r[0], bytes(r[1])))
    done = {job: out for job, *out in blobs.partitionBy(len(pieces), int).mapPartitionsWithIndex(grown).collect()}  # trees and errors
    out: list[tuple[Grown, float | None]] = []
    for k, fit in enumerate(fits):
        mine = [done[j] for j, (own, _) in enumerate(pieces) if own == k and j in done]
        if not mine:
            raise ValueError("no rows to learn from")
        trees = {name: np.concatenate([m[1][name] for m in mine]) for name in mine[0][1]}
        out.append((Grown(found.inputs, found.indexed, types, edges[fit.family], nominal, fit.kind, fit.depth, mine[0][0], **trees), mine[0][2]))
    return out


def _fitted(fit: Fit, rows: list[np.ndarray], nominal: int) -> tuple[float, dict[str, np.ndarray], float | None]:
    """The start, the trees and the error of one fit over its rows."""
    bins, y, learnt, held = rows
    key = _packed(bins)
    if key is None:
        key = np.unique(np.ascontiguousarray(bins.T), axis=0, return_inverse=True)[1].ravel()
    order = np.lexsort((y, key))
    key, y, learnt, held = key[order], y[order], learnt[order], held[order]
    fresh = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (y[1:] != y[:-1])])  # rows of equal bins and target are one
    bins = bins[:, order[fresh]]
    key, y, learnt, held = key[fresh], y[fresh], np.add.reduceat(learnt, fresh, dtype=np.int64), np.add.reduceat(held, fresh, dtype=np.int64)
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    cell = np.cumsum(np.r_[False, key[1:] != key[:-1]])
    bins = bins[:, first]
    together, bins = _together(bins), np.ascontiguousarray(bins.T)
    draw, add = _Draw(learnt, fit), lambda v: np.add.reduceat(v, first)
    rng = np.random.default_rng(fit.seed)
    if not learnt.any():
        raise ValueError("no rows to learn from")
    trees, weights, total = [], [], np.zeros(len(first))
    if fit.kind == "huber":
        start, run = float(_quantile(y, learnt, 0.5)), None
        total += start
        for _ in range(fit.trees):
            off = y - total[cell]
            width = _quantile(np.abs(off), learnt, ALPHA)
            drawn = draw(rng)
            tree, place = _grow(bins, together, add(drawn), add(drawn * np.clip(off, -width, width)), fit, nominal, rng)
            tree["value"] = fit.step * _huber_values(place[cell], off, learnt, width, len(tree["value"]))
            total += tree["value"][place]
            trees.append(tree)
            weights.append(1.0)
    else:
        start = 0.0
        middle = float(np.average(y, weights=learnt))
        for k in range(fit.trees):
            drawn = draw(rng)
            n, s = add(drawn), add(drawn * (y - middle))
            if fit.kind == "forest":
                tree, place = _grow(bins, together, n, s, fit, nominal, rng)
                tree["value"] = tree["value"] + middle
                weights.append(1.0)
            elif k == 0:  # as MLlib's boosting: the first tree counts whole, later ones by the step, on the loss's gradient
                tree, place = _grow(bins, together, n, s, fit, nominal, rng)
                tree["value"] = tree["value"] + middle
                weights.append(1.0)
            else:
                tree, place = _grow(bins, together, n, 2 * (s - n * (total - middle)), fit, nominal, rng)
                weights.append(fit.step)
            total += weights[-1] * tree["value"][place]
            trees.append(tree)
        total = total / fit.trees if fit.kind == "forest" else total
    error = None
    if fit.held:
        error = float((held * np.abs(np.maximum(total[cell], FLOOR) - y) / y).sum() / held.sum()) if held.any() else 0.0
    return start, {name: np.stack([t[name] for t in trees]) for name in trees[0]} | {"weights": np.array(weights)}, error


def _packed(bins: np.ndarray) -> np.ndarray | None:
    """One number a row of bins, the same in every batch; None for too many features."""
    if len(bins) * 6 > 62:
        return None
    key = np.zeros(bins.shape[1], np.int64)
    for b in bins:
        key = key * (TYPES + 1) + b
    return key


class _Draw:
    """How often each counted row comes: Poisson's law for a forest, a share without replacement for boosting."""

    def __init__(self, n: np.ndarray, fit: Fit):
        self.n, self.share, self.forest = n, fit.sample, fit.kind == "forest"
        self.order = np.argsort(n, kind="stable")  # rows of one count are drawn one after the other, which is fast
        self.sorted = n[self.order]
        self.ones = int(np.searchsorted(self.sorted, 1, side="right"))

    def __call__(self, rng: np.random.Generator) -> np.ndarray:
        few, more = self.sorted[: self.ones], self.sorted[self.ones :]
        drawn = np.concatenate([few * (rng.poisson(1.0, len(few)) if self.forest else rng.random(len(few), np.float32) < self.share), rng.poisson(more) if self.forest else rng.binomial(more, self.share)])
        out = np.empty(len(drawn))
        out[self.order] = drawn
        return out if out.any() else self.n.astype(float)


def _quantile(v: np.ndarray, n: np.ndarray, q: float) -> float:
    """The least value with a share q of the counted rows at or below it."""
    order = np.argsort(v)
    at = np.cumsum(n[order])
    return float(v[order[np.searchsorted(at, max(np.ceil(q * at[-1]), 1))]])


def _huber_values(leaf: np.ndarray, off: np.ndarray, n: np.ndarray, width: float, size: int) -> np.ndarray:
    """Each leaf's median residual and the mean of what is off it, cut to the width; 0 where no row is."""
    order = np.lexsort((off, leaf))
    own, o, c = leaf[order], off[order], n[order]
    at, total = np.cumsum(c), np.bincount(own, c, size)
    before = np.cumsum(total) - total
    leaves = np.flatnonzero(total > 0)
    middle = np.zeros(size)
    middle[leaves] = o[np.searchsorted(at, before[leaves] + np.maximum(np.ceil(total[leaves] / 2), 1))]
    rest = np.bincount(own, c * np.clip(o - middle[own], -width, width), size)
    return np.where(total > 0, middle + rest / np.maximum(total, 1), 0.0)


def _together(bins: np.ndarray) -> list[tuple[list[int], list[int], np.ndarray]]:
    """Features in groups of up to JOINT joint bins, with their bins' numbers and each cell's joint bin: a pass over the cells counts a group."""
    sizes = [int(b.max()) + 1 for b in bins]
    out: list[tuple[list[int], list[int], np.ndarray]] = []
    for f in sorted((f for f in range(len(bins)) if sizes[f] > 1), key=lambda f: -sizes[f]):
        for own, held, key in out:
            if np.prod(held) * sizes[f] <= JOINT:
                key *= sizes[f]
                key += bins[f]
                own.append(f)
                held.append(sizes[f])
                break
        else:
            out.append(([f], [sizes[f]], bins[f].astype(np.int32)))
    return out


def _grow(bins: np.ndarray, together: list, n: np.ndarray, s: np.ndarray, fit: Fit, nominal: int, rng: np.random.Generator) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """A tree over cells (bins, a line a cell, drawn rows, their target's sum), its nodes numbered as in a heap, and each cell's leaf."""
    width, lines = bins.shape[1], bins.ravel()
    size, keys = 2 ** (fit.depth + 1) - 1, [key for _, _, key in together]
    tree = {"feature": np.full(size, -1, np.int8), "mask": np.zeros(size, np.uint64), "value": np.zeros(size), "gain": np.zeros(size), "rows": np.zeros(size)}
    place = np.zeros(len(n), np.int32)
    ids, node, at = np.array([0]), np.zeros(len(n), np.int64), np.arange(len(n))
    for level in range(fit.depth + 1):
        m = len(ids)
        nn, ns = np.bincount(node, n, m), np.bincount(node, s, m)
        tree["value"][ids], tree["rows"][ids] = ns / np.where(nn > 0, nn, 1), nn
        if level == fit.depth:
            break
        whole = ns * ns / np.where(nn > 0, nn, 1)
        best, chosen, masks = np.zeros(m), np.full(m, -1), np.zeros(m, np.uint64)
        may = np.argsort(rng.random((m, width)), axis=1).argsort(axis=1) < fit.tried if fit.tried else None
        joint = [[np.bincount(node * int(np.prod(sizes)) + key, v, m * int(np.prod(sizes))).reshape(m, *sizes) for v in (n, s)] for (_, sizes, _), key in zip(together, keys, strict=True)]
        for (own, sizes, _), both in zip(together, joint, strict=True):
            for axis, f in enumerate(own):
                hn, hs = (h.sum(axis=tuple(a + 1 for a in range(len(own)) if a != axis)) for h in both)
                order = None
                if f == nominal:
                    order = np.argsort(np.where(hn > 0, hs / np.where(hn > 0, hn, 1), np.inf), axis=1, kind="stable")
                    hn, hs = np.take_along_axis(hn, order, 1), np.take_along_axis(hs, order, 1)
                ln, ls = np.cumsum(hn, axis=1)[:, :-1], np.cumsum(hs, axis=1)[:, :-1]
                rn, rs = nn[:, None] - ln, ns[:, None] - ls
                ok = (ln >= fit.least) & (rn >= fit.least) & (ln > 0) & (rn > 0)
                sides = ls * ls / np.where(ok, ln, 1) + rs * rs / np.where(ok, rn, 1)
                gain = np.where(ok & (sides - whole[:, None] > ROUNDING * sides), sides - whole[:, None], 0.0)
                cut = gain.argmax(axis=1)
                top = gain[np.arange(m), cut]
                better = (top > best) & (may[:, f] if may is not None else True)
                some = np.uint64(1) << (np.broadcast_to(np.arange(sizes[axis]), hn.shape) if order is None else order).astype(np.uint64)
                masks = np.where(better, np.bitwise_or.accumulate(some, axis=1)[np.arange(m), cut], masks)
                best, chosen = np.where(better, top, best), np.where(better, f, chosen)
        split = chosen >= 0
        tree["feature"][ids], tree["mask"][ids], tree["gain"][ids] = chosen, masks, np.where(nn > 0, best / np.where(nn > 0, nn, 1), 0)
        if not split.any():
            break
        stay = ~split[node]
        if stay.any():
            place[at[stay]] = ids[node[stay]]
            go = ~stay
            at, node, n, s, keys = at[go], node[go], n[go], s[go], [key[go] for key in keys]
        left = (masks[:, None] >> np.arange(TYPES + 1, dtype=np.uint64)) & np.uint64(1)
        to = (2 * (np.cumsum(split) - 1)[:, None] + 1 - left.astype(np.int64)).ravel()  # the child by node and bin
        node = to[node * (TYPES + 1) + lines[at * width + chosen[node]]]
        ids = np.stack([2 * ids[split] + 1, 2 * ids[split] + 2], axis=1).ravel()
    place[at] = ids[node]
    return tree, place


@dataclass
class Grown:
    """Trees as tables of nodes, a row a tree: the feature (-1: a leaf), the bins that go left as bits, and the value of each."""

    inputs: list[str]
    indexed: str
    types: list[str]
    edges: list[np.ndarray]
    nominal: int
    kind: str
    depth: int
    start: float
    feature: np.ndarray = field(repr=False)
    mask: np.ndarray = field(repr=False)
    value: np.ndarray = field(repr=False)
    gain: np.ndarray = field(repr=False)
    rows: np.ndarray = field(repr=False)
    weights: np.ndarray = field(repr=False)

    @property
    def rounds(self) -> np.ndarray:
        return self.feature

    def said(self, bins: np.ndarray, staged_from: int) -> np.ndarray:
        """Predictions, and the deviation of a forest's trees or of the running predictions from ``staged_from`` on."""
        run, s1, s2 = (np.full(bins.shape[1], v) for v in (self.start, 0.0, 0.0))
        rows, trees = np.arange(bins.shape[1]), len(self.feature)
        for k, weight in enumerate(self.weights):
            node = np.zeros(len(rows), np.int32)
            for _ in range(self.depth):
                f = self.feature[k][node]
                left = (self.mask[k][node] >> bins[np.maximum(f, 0), rows].astype(np.uint64)) & np.uint64(1)
                node = np.where(f >= 0, 2 * node + 2 - left.astype(np.int32), node)
            value = self.value[k][node]
            run += weight * value
            at = value if self.kind == "forest" else run
            if self.kind == "forest" or k >= staged_from:
                s1, s2 = s1 + at, s2 + at * at
        n = trees if self.kind == "forest" else max(trees - staged_from, 1)
        spread = np.sqrt(np.maximum(s2 / n - (s1 / n) ** 2, 0.0))
        return np.stack([run / trees if self.kind == "forest" else run, spread])

    def transform(self, rows: DataFrame, staged_from: int | None = None) -> DataFrame:
        """``rows`` with ``predicted``; with ``staged_from`` also ``spread``, as ``said`` has it."""
        out = predictions([self], rows, F.lit(0), staged_from or 0)
        return out if staged_from is not None else out.drop("spread")

    @property
    def stages(self) -> list:
        """The same model by MLlib: a number for the type, a vector, the trees."""
        spark = SparkSession.getActiveSession()
        jvm, new_array = spark._jvm, spark.sparkContext._gateway.new_array
        ml, width, numbers = jvm.org.apache.spark.ml, len(self.inputs), iter(self.edges)
        edges = [None if i == self.nominal else next(numbers) for i in range(width)]

        def array(values: list, kind=jvm.double):
            out = new_array(kind, len(values))
            for i, v in enumerate(values):
                out[i] = v
            return out

        def node(k: int, i: int):
            n, value, f = float(self.rows[k][i]), float(self.value[k][i]), int(self.feature[k][i])
            held = jvm.org.apache.spark.mllib.tree.impurity.VarianceCalculator(array([n, n * value, n * value * value]), int(n))
            if f < 0:
                return ml.tree.LeafNode(value, 0.0, held)
            left = [b for b in range(TYPES + 1) if int(self.mask[k][i]) >> b & 1]
            cut = ml.tree.CategoricalSplit(f, array([float(b) for b in left]), len(self.types) + 1) if f == self.nominal else ml.tree.ContinuousSplit(f, float(edges[f][left[-1]]))
            return ml.tree.InternalNode(value, 0.0, float(self.gain[k][i]), node(k, 2 * i + 1), node(k, 2 * i + 2), cut, held)

        tree = ml.regression.DecisionTreeRegressionModel
        trees = array([tree(f"dtr_{uuid.uuid4().hex[:12]}", node(k, 0), width) for k in range(len(self.feature))], tree)
        if self.kind == "forest":
            model = RandomForestRegressionModel(ml.regression.RandomForestRegressionModel(f"rfr_{uuid.uuid4().hex[:12]}", trees, width))._set(numTrees=len(trees))
        else:
            model = GBTRegressionModel(ml.regression.GBTRegressionModel(f"gbtr_{uuid.uuid4().hex[:12]}", trees, array(self.weights.tolist()), width))
        index = StringIndexerModel.from_labels(self.types, self.indexed, "type_index", "keep")
        return [index, VectorAssembler(inputCols=self.inputs, outputCol="vector"), model.setFeaturesCol("vector").setPredictionCol("predicted")]

    def write(self) -> MLWriter:
        """As MLlib's pipeline, which is read again by ``PipelineModel.load``; Huber's trees have none."""
        if self.kind == "huber":
            raise ValueError("Huber's trees have no model of MLlib")
        return PipelineModel(self.stages).write()


def predictions(models: list[Grown], rows: DataFrame, which: Column, staged_from: int = 0) -> DataFrame:
    """``rows`` with ``predicted`` and ``spread`` by the model whose place in ``models`` is ``which``; what equal features are given is worked out once a task."""
    numbers, types = _numbers(models[0].inputs), models[0].types

    @F.pandas_udf("predicted double, spread double")
    def said(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, np.int64), np.empty((2, 0))) for _ in models]
        for part in parts:
            out = np.zeros((2, len(part)))
            of = part["which"].to_numpy()
            for m in np.unique(of):
                own = np.flatnonzero(of == m)
                model, (keys, values) = models[m], known[m]
                bins = _binned(part["t"].to_numpy()[own], [part[f"x{i}"].to_numpy()[own] for i in range(len(numbers))], model.edges, model.nominal)
                key = _packed(bins)
                if key is None:
                    out[:, own] = model.said(bins, staged_from)
                    continue
                fresh, first = np.unique(key, return_index=True)
                at = np.searchsorted(keys, fresh)
                new = np.r_[keys, -1][at] != fresh
                if new.any():
                    if len(keys) > REMEMBERED:
                        keys, values, at, new = keys[:0], values[:, :0], np.zeros(len(fresh), int), np.ones(len(fresh), bool)
                    # Both are sorted: what is new goes in at its place, without a sort for each batch.
                    keys, values = np.insert(keys, at[new], fresh[new]), np.insert(values, at[new], model.said(bins[:, first[new]], staged_from), axis=1)
                    known[m] = keys, values
                out[:, own] = values[:, np.searchsorted(keys, key)]
            yield pd.DataFrame({"predicted": out[0], "spread": out[1]})

    line = F.struct(which.cast("int").alias("which"), _type(models[0].indexed, types).alias("t"), *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(numbers)])
    return rows.withColumn("said_", said(line)).select(*[F.col(f"`{c}`") for c in rows.columns], "said_.*")

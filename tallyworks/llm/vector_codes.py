"""Vector code compression: a vector is cut into parts, and each part is named by the nearest entry of its position's codebook.

Codebooks are learned in integers.  Each round a task finds the nearest entry of each of its vectors'
parts and adds the parts up by entry; Spark adds the tasks' sums, so what reaches the driver is a
codebook's size however many vectors there are.  A codebook is that many entries times a vector's
length, which bounds what is broadcast.

Nearest entries are found by a GNAT (geometric near-neighbour access tree) over the entries.  A node
has up to FANOUT split points, taken far from each other; every other entry goes below its nearest
split point, and the node stores for each pair of a child and a split point the range of distances
between that split point and the child's entries.  A query meets a node's split points; then a child
goes, with all below it, if for some split point its range lies farther from the query's distance than
the best found so far.  That is strict, and distances are square roots of integers with their bounds
rounded outwards, so an entry that is as near as the best is never cut off; those that are left are
compared by exact integer squares, and ties go to the lower index.  All queries of a batch go down
together, each with its own best.

Defined cases: a vector that is null or holds null, NaN or infinite components is dropped; so is one
whose length isn't that of the kept vector with the smallest id or can't be cut into equal parts (its
distances to entries aren't defined).  Codebooks start from the first rows in the order of vec_id (null
last), then of the vector, so repeated rows count each and get their rows each; with fewer rows than
entries, codebooks have as many entries as there are rows.  Null labels are one label.  An empty table
gives an empty result.  Components so large that a squared distance would pass 2^62 are refused with an
error, since their errors are no longs.  Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, written

#: A component x is the integer floor(SCALE * x).
SCALE = 1024
#: Parts of a vector, entries of a codebook, rounds of learning.
PARTS, ENTRIES, ROUNDS = 4, 256, 4
#: Split points of a node of the tree; a node of fewer entries is a leaf.
FANOUT = 24
#: Relative error that bounds of distances are widened by; a square root's is below 2^-52.
SLACK = 2.0**-48


class Gnat:
    """A tree over integer points (one a row), for exact nearest points with ties to the lower row."""

    def __init__(self, points: np.ndarray, fanout: int = FANOUT):
        self.points, self.fanout = points.astype(np.int64), fanout
        self.norms = (self.points**2).sum(axis=1)
        # (split points, children, low, high): children[i] is a node or None; low[i, j] and high[i, j] bound the distances from split j to child i's points
        self.root = self._node(np.arange(len(points)))
        self.compared = 0

    def _squares(self, a: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Exact squared distances of the rows of a to own points."""
        b = self.points[own]
        most = max(int(np.abs(a).max(initial=0)), int(np.abs(b).max(initial=0)))
        if 4 * a.shape[1] * most**2 < 2**53:  # all sums are whole numbers that a double holds, so the product is exact
            inner = (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
            return (a**2).sum(axis=1)[:, None] + self.norms[own][None, :] - 2 * inner
        out = np.zeros((len(a), len(b)), np.int64)
        for k in range(a.shape[1]):
            out += (a[:, k, None] - b[None, :, k]) ** 2
        return out

    def _node(self, own: np.ndarray) -> tuple:
        if len(own) <= self.fanout:
            return own, [], None, None
        chosen, far = [0], np.full(len(own), np.iinfo(np.int64).max)
        while len(chosen) < self.fanout:  # the next is the farthest from those chosen
            far = np.minimum(far, self._squares(self.points[own], own[chosen[-1:]])[:, 0])
            far[chosen] = -1
            chosen.append(int(np.argmax(far)))
        splits, rest = own[chosen], np.delete(own, chosen)
        roots = np.sqrt(self._squares(self.points[rest], splits).astype(np.float64))
        nearest = roots.argmin(axis=1)
        children, low, high = [], np.full((self.fanout, self.fanout), np.inf), np.full((self.fanout, self.fanout), -np.inf)
        for i in range(self.fanout):
            below = nearest == i
            children.append(self._node(rest[below]) if below.any() else None)
            if below.any():
                low[i], high[i] = roots[below].min(axis=0) * (1 - SLACK), roots[below].max(axis=0) * (1 + SLACK)
        return splits, children, low, high

    def nearest(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, squared distance) of the nearest point of each query; the lowest row of those as near."""
        queries = queries.astype(np.int64)
        best, square = np.full(len(queries), np.iinfo(np.int64).max), np.full(len(queries), np.iinfo(np.int64).max)
        stack = [(self.root, np.arange(len(queries)))] if len(self.points) else []
        while stack:
            (splits, children, low, high), active = stack.pop()
            found = self._squares(queries[active], splits)
            self.compared += found.size
            least = found.min(axis=1)
            row = np.where(found == least[:, None], splits[None, :], np.iinfo(np.int64).max).min(axis=1)
            better = (least < square[active]) | ((least == square[active]) & (row < best[active]))
            best[active[better]], square[active[better]] = row[better], least[better]
            if not children:
                continue
            roots = np.sqrt(found.astype(np.float64))
            under, over = roots * (1 - SLACK), roots * (1 + SLACK)
            for i in np.argsort([0 if c is None else -len(c[0]) for c in children]).tolist():
                if children[i] is None:
                    continue
                reach = np.sqrt(square[active].astype(np.float64)) * (1 + SLACK)
                # every point of the child is farther from split j than the query by more than the best, or nearer by more
                apart = (low[i][None, :] > over + reach[:, None]) | (high[i][None, :] < under - reach[:, None])
                keep = ~apart.any(axis=1)
                if keep.any():
                    stack.append((children[i], active[keep]))
        return best, square


def limit(width: int) -> int:
    """Components below it in size keep a part's squared distances, and their sum over parts, below 2^62."""
    return int((2**60 / max(1, width)) ** 0.5)


def vectors(rows: DataFrame) -> DataFrame:
    """(vec_id, label, v) of the rows that are kept; v has the integer components."""
    v = F.col("embedding").cast("array<double>")
    sound = F.col("embedding").isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    kept = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("int").alias("label"), v.alias("v"), sound.alias("sound")).filter("sound")
    # 2^62 stands for what is larger still: it is refused below, never wrapped
    bound = float(2**62)
    whole = F.transform("v", lambda x: F.floor(F.greatest(F.least(x * float(SCALE), F.lit(bound)), F.lit(-bound))).cast("long"))
    return kept.select("vec_id", "label", whole.alias("v"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def assigned(books: list[np.ndarray], matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes, errors) of each row: the nearest entry of each of its parts, and the squared distances to them."""
    width = matrix.shape[1] // len(books)
    found = [Gnat(book).nearest(matrix[:, k * width : (k + 1) * width]) for k, book in enumerate(books)]
    return np.stack([f[0] for f in found], axis=1), np.stack([f[1] for f in found], axis=1)


def sums(kept: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """(part, entry, at, total): of the parts that an entry is nearest to, the sum of the components at each place; at their end stands how many they are."""
    held = kept.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [Gnat(b) for b in held.value]
        width = held.value[0].shape[1]
        total = [np.zeros((len(b), width + 1), np.int64) for b in held.value]
        for batch in batches:
            matrix = _matrix(batch.column(0), width * len(trees))
            for k, tree in enumerate(trees):
                part = matrix[:, k * width : (k + 1) * width]
                near, _ = tree.nearest(part)
                np.add.at(total[k], near, np.hstack([part, np.ones((len(part), 1), np.int64)]))
        for k, own in enumerate(total):
            used = np.flatnonzero(own[:, -1])
            values = pa.ListArray.from_arrays(pa.array(np.arange(len(used) + 1) * (width + 1), pa.int32()), pa.array(own[used].ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(used), k)), pa.array(used), values], ["part", "entry", "total"])

    each = kept.select("v").mapInArrow(run, "part long, entry long, total array<long>")
    return each.select("part", "entry", F.posexplode("total").alias("at", "x")).groupBy("part", "entry", "at").agg(F.sum("x").alias("total"))


def learned(kept: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[np.ndarray]:
    """A codebook a part position, one entry a row.  ``kept`` is a written table of (vec_id, label, v)."""
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").collect()
    start = np.array([r["v"] for r in first], np.int64).reshape(len(first), len(first[0]["v"]) if first else 0)
    width = start.shape[1] // parts
    books = [start[:, k * width : (k + 1) * width].copy() for k in range(parts)]
    for _ in range(rounds if width else 0):
        total = [np.zeros((len(b), width + 1), np.int64) for b in books]
        for part, entry, at, value in sums(kept, books).collect():  # a codebook's size at most
            total[part][entry, at] = value
        for own, book in zip(total, books, strict=True):
            used = own[:, -1] > 0
            book[used] = np.floor_divide(own[used, :-1], own[used, -1:])
    return books


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def comparable(kept: DataFrame, parts: int = PARTS) -> DataFrame:
    """The rows whose vectors are as long as the first one and can be cut; refuses components that are too large."""
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(1).select(F.size("v")).first()
    size = first[0] if first else 0
    if size % parts:
        return kept.limit(0)
    kept = kept.filter(F.size("v") == size)
    most = kept.agg(F.max(F.array_max(F.transform("v", F.abs)))).first()[0] or 0
    if most >= limit(size):
        raise ValueError(f"a component of {most} makes squared distances that no long holds")
    return kept


def codes(kept: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """(vec_id, label, code, error): code has an entry's number for each part."""
    held = kept.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            width = sum(b.shape[1] for b in held.value)
            if width and batch.num_rows:
                near, square = assigned(held.value, _matrix(batch.column(2), width))
            else:
                near, square = (np.zeros((batch.num_rows, len(held.value)), np.int64) for _ in range(2))
            values = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * near.shape[1], pa.int32()), pa.array(near.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), values, pa.array(square.sum(axis=1))], ["vec_id", "label", "code", "error"])

    return kept.select("vec_id", "label", "v").mapInArrow(run, "vec_id long, label int, code array<long>, error long")


def compressed(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray]]:
    """(vec_id, label, code, error) of the kept rows of (vec_id, embedding, label), and the codebooks."""
    kept = comparable(written(vectors(rows), "vectors"), parts)
    books = learned(kept, parts, entries, rounds)
    return written(codes(kept, books), "codes"), books


def op12(rows: DataFrame) -> DataFrame:
    """Codes as two hex digits a part; ``label_error`` sums the errors of a label."""
    coded, books = compressed(rows)
    each = coded.groupBy("label").agg(F.sum("error").alias("label_error")).select(F.col("label").alias("own"), "label_error")
    each = written(each, "label_errors")
    small = each.count() <= BROADCAST_IDS
    out = coded.join(F.broadcast(each) if small else each, F.col("label").eqNullSafe(F.col("own")))
    code = F.array_join(F.transform("code", lambda x: F.lpad(F.lower(F.hex(x)), 2, "0")), "")
    return out.select("vec_id", code.alias("code"), "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def oracle(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    """DuckDB SQL of op12 over ``embeddings`` of one length; sums of products are exact, being whole numbers below 2^53."""
    steps = [
        f"""kept AS MATERIALIZED (
                SELECT vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v FROM embeddings
                WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
            cut AS MATERIALIZED (
                SELECT vec_id, label, k, v[k * (len(v) // {parts}) + 1 : (k + 1) * (len(v) // {parts})] AS p FROM kept, range({parts}) AS t(k)),
            first_ids AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept QUALIFY e < {entries}),
            book0 AS MATERIALIZED (SELECT k, e, p AS c FROM cut JOIN first_ids USING (vec_id))"""
    ]
    for i in range(rounds + 1):
        steps.append(f"""near{i} AS MATERIALIZED (
                SELECT vec_id, k, min({{'d': list_dot_product(p, p) - 2 * list_dot_product(p, c) + list_dot_product(c, c), 'e': e}}) AS m
                FROM cut JOIN book{i} USING (k) GROUP BY vec_id, k)""")
        if i < rounds:
            steps.append(f"""mean{i} AS (
                SELECT k, e, list(x ORDER BY spot) AS c FROM (
                    SELECT k, m.e AS e, spot, floor(sum(p[spot]) / count(*)) AS x FROM near{i} JOIN cut USING (vec_id, k), range(1, 1 + (SELECT max(len(p)) FROM cut)) AS t(spot) GROUP BY ALL) GROUP BY k, e),
            book{i + 1} AS MATERIALIZED (SELECT b.k, b.e, coalesce(n.c, b.c) AS c FROM book{i} AS b LEFT JOIN mean{i} AS n USING (k, e))""")
    return f"""WITH {", ".join(steps)},
            coded AS (SELECT vec_id, string_agg(printf('%02x', m.e), '' ORDER BY k) AS code, sum(m.d)::BIGINT AS error FROM near{rounds} GROUP BY vec_id),
            digest AS (SELECT sha256(string_agg(array_to_string(list_transform(c, lambda x: x::BIGINT::VARCHAR), ','), ',' ORDER BY k, e)) AS h FROM book{rounds})
            SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, (SELECT h FROM digest) AS codebooks_sha256
            FROM coded JOIN kept USING (vec_id)"""

"""Exact deduplication screened by static binary-fuse filters.

The corpus is an immutable snapshot plus an incoming batch.  Digests of the snapshot, hashed into
buckets, get one static 3-wise binary-fuse filter a bucket.  Incoming digests are grouped among
themselves first (so that copies inside the batch cost one probe), then screened: a negative is
surely new; positives join the snapshot's exact buckets by the whole digest.  Digests that occur more
than once are then checked byte for byte: their texts are grouped by the text itself, with map-side
combining, so that a group of any size moves once a task.  Digests whose texts differ are resolved
by a join on the text.

Defined cases: null text counts as empty; empty texts are copies of one another; null ``doc_id`` is
never the smallest unless a group has no other; repeated rows of one ``doc_id`` share the outcome
(``kept`` on each; the pipeline stage keeps one); an empty table gives an empty result.  Other columns,
whatever their names, are ignored by the query and come through the stage as they are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANK, free_name, without, written

#: Digests a bucket of the filters, about.
BUCKET_DIGESTS = 50_000
#: Repeated digests up to which their table is broadcast (33 bytes each); beyond it the join shuffles.
BROADCAST_DIGESTS = 500_000

_U = np.uint64


def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """64-bit finaliser of a seeded key."""
    with np.errstate(over="ignore"):
        h = keys + _U((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1))
        for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
            h = (h ^ (h >> _U(shift))) * _U(factor)
    return h ^ (h >> _U(33))


def _slots(h: np.ndarray, segment: int, segments: int) -> np.ndarray:
    """Three slots a key, in neighbouring segments; shape (3, n)."""
    first = ((h >> _U(32)) * _U(segments)) >> _U(32)
    mask = _U(segment - 1)
    return np.stack([((first + _U(i)) * _U(segment) + ((h >> _U(s)) & mask)) for i, s in enumerate((0, 11, 22))]).astype(np.int64)


class BinaryFuse:
    """A static set of 64-bit keys with 8-bit fingerprints: no false negative, about 1/256 false positives."""

    def __init__(self, seed: int, segment: int, segments: int, cells: np.ndarray):
        self.seed, self.segment, self.segments, self.cells = seed, segment, segments, cells

    @classmethod
    def build(cls, keys: np.ndarray) -> BinaryFuse:
        keys = np.unique(keys.astype(np.uint64))
        n = len(keys)
        segment = 1 << max(2, min(11, int(np.log(max(n, 2)) / np.log(3.33) + 2.25)))
        factor = max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(max(n, 2)))
        for seed in range(1000):
            segments = max(1, int(np.ceil(n * factor * (1 + seed / 50) / segment)) - 2) if n else 1
            size = (segments + 2) * segment
            h = _mix(keys, seed)
            at = _slots(h, segment, segments)
            layers = cls._peel(at, size)
            if layers is not None:
                mark, cells = (h >> _U(56)).astype(np.uint8), np.zeros(size, np.uint8)
                for own, slot in reversed(layers):  # keys of a layer share none of its slots
                    cells[slot] = 0
                    cells[slot] = mark[own] ^ cells[at[0, own]] ^ cells[at[1, own]] ^ cells[at[2, own]]
                return cls(seed, segment, segments, cells)
        raise ArithmeticError("no peelable seed")

    @staticmethod
    def _peel(at: np.ndarray, size: int) -> list[tuple[np.ndarray, np.ndarray]] | None:
        n = at.shape[1]
        degree = np.bincount(at.ravel(), minlength=size)
        who = np.zeros(size, np.int64)
        for row in at:
            np.bitwise_xor.at(who, row, np.arange(n))
        layers, left = [], n
        while left:
            slot = np.flatnonzero(degree == 1)
            own, first = np.unique(who[slot], return_index=True)
            if not len(own):
                return None
            layers.append((own, slot[first]))
            left -= len(own)
            for row in at:
                np.subtract.at(degree, row[own], 1)
                np.bitwise_xor.at(who, row[own], own)
        return layers

    def __contains__(self, key: int) -> bool:
        return bool(self.has(np.array([key], np.uint64))[0])

    def has(self, keys: np.ndarray) -> np.ndarray:
        h = _mix(keys.astype(np.uint64), self.seed)
        at = _slots(h, self.segment, self.segments)
        return (self.cells[at[0]] ^ self.cells[at[1]] ^ self.cells[at[2]]) == (h >> _U(56)).astype(np.uint8)

    def to_bytes(self) -> bytes:
        return np.array([self.seed, self.segment, self.segments], np.int64).tobytes() + self.cells.tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> BinaryFuse:
        return cls(*np.frombuffer(raw[:24], np.int64).tolist(), np.frombuffer(raw[24:], np.uint8))


def build_filters(snapshot: DataFrame) -> DataFrame:
    """One filter a bucket from (bucket, key64): (bucket, filter)."""

    def build(rows: pa.Table) -> pa.Table:
        raw = BinaryFuse.build(rows.column("key64").to_numpy().view(np.uint64)).to_bytes()
        return pa.table({"bucket": rows.column("bucket").slice(0, 1), "filter": pa.array([raw], pa.binary())})

    return snapshot.groupBy("bucket").applyInArrow(build, "bucket long, filter binary")


def screen(batch: DataFrame, filters: DataFrame) -> DataFrame:
    """Rows of (bucket, key64, ...) that a filter of their bucket may hold."""

    def keep(rows: pa.Table, own: pa.Table) -> pa.Table:
        if not len(own) or not len(rows):
            return rows.slice(0, 0)
        return rows.filter(pa.array(BinaryFuse.from_bytes(own.column("filter")[0].as_py()).has(rows.column("key64").to_numpy().view(np.uint64))))

    return batch.groupBy("bucket").cogroup(filters.groupBy("bucket")).applyInArrow(keep, batch.schema)


def normalised(text: str = "text") -> Column:
    """Each run of white space becomes one space; null is empty."""
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), f"[{BLANK}]+", " ")


def exact_dedup(docs: DataFrame, snapshot: Column | None = None) -> DataFrame:
    """(doc_id, digest, keep_id, group_size) for each row of ``docs``.

    ``snapshot`` is true for rows of the immutable snapshot; by default those below the median
    ``doc_id``, the rows that came first.  The result doesn't depend on it.
    """
    spark = docs.sparkSession
    if snapshot is None:
        middle = docs.select(F.percentile_approx(F.col("doc_id").cast("long"), 0.5, 100)).first()[0]
        snapshot = F.coalesce(F.col("doc_id") < F.lit(middle), F.lit(True)) if middle is not None else F.lit(True)
    rows = written(docs.select("doc_id", F.unhex(F.sha2(normalised().cast("binary"), 256)).alias("digest"), snapshot.alias("old")), "digests")
    n_buckets = max(1, -(-rows.count() // BUCKET_DIGESTS))

    def grouped(df: DataFrame) -> DataFrame:
        return df.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n"))

    def keyed(df: DataFrame) -> DataFrame:
        return df.withColumn("key64", F.xxhash64("digest")).withColumn("bucket", F.pmod("key64", F.lit(n_buckets)))

    old, new = keyed(grouped(rows.filter("old"))), keyed(grouped(rows.filter("not old")))
    hits = screen(new, build_filters(old.select("bucket", "key64")))
    both = hits.select("digest", F.col("first_id").alias("new_id"), F.col("n").alias("new_n")).join(old.select("digest", F.col("first_id").alias("old_id"), F.col("n").alias("old_n")), "digest")
    shared = both.select("digest", F.least("old_id", "new_id").alias("first_id"), (F.col("old_n") + F.col("new_n")).alias("n"))
    inside = old.unionByName(new).filter("n > 1").select("digest", "first_id", "n")  # a shared digest is here too if one side repeats it
    repeated = written(shared.unionByName(inside).groupBy("digest").agg(F.min("first_id").alias("first_id"), F.max("n").alias("n")), "repeated")

    n_repeated = repeated.count()
    wanted = repeated.select("digest")
    texts = docs.select("doc_id", normalised().alias("norm")).withColumn("digest", F.unhex(F.sha2(F.col("norm").cast("binary"), 256)))
    texts = texts.join(F.broadcast(wanted) if n_repeated <= BROADCAST_DIGESTS else wanted, "digest", "left_semi")
    same = texts.groupBy("digest", "norm").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    checked = written(same.groupBy("digest").agg(F.count("*").alias("variants"), F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size")), "checked")
    out = rows.select("doc_id", "digest").join(checked, "digest", "left")
    sound = out.filter("variants is null or variants = 1").select("doc_id", "digest", F.when(F.col("variants").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"))
    if checked.filter("variants > 1").isEmpty():
        return sound
    clash = checked.filter("variants > 1").select("digest")
    exact = texts.join(clash, "digest", "left_semi").join(same, ["digest", "norm"])
    return sound.unionByName(exact.select("doc_id", "digest", "keep_id", "group_size"))


def op7(docs: DataFrame) -> DataFrame:
    """The query: one row a document, dropped ones too."""
    out = exact_dedup(docs)
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def stage(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` that stay, all columns.

    Of repeated rows of one ``doc_id`` and text one stays; rows without ``doc_id`` stay.
    """
    fate = exact_dedup(docs).select("doc_id", "digest", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"))
    ids = written(fate.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("kept").alias("kept")).filter("doc_id is not null and (n > 1 or not kept)"), "fate")
    out = without(docs, ids.select("doc_id"))
    if ids.filter("n > 1 and kept").isEmpty():
        return out
    several = ids.filter("n > 1 and kept").select("doc_id")
    name = free_name(docs)
    again = docs.withColumn(name, F.unhex(F.sha2(normalised().cast("binary"), 256)))
    live = several.join(fate.filter("kept"), "doc_id").select(F.col("doc_id").alias("id_"), F.col("digest").alias("digest_")).distinct()
    again = again.join(live, (F.col("doc_id") == live["id_"]) & (F.col(name) == live["digest_"]), "left_semi").dropDuplicates(["doc_id", name]).drop(name)
    return out.union(again)

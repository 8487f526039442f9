"""Benchmark decontamination by greedy string tiling.

Words are runs of letters and digits, lower case.  Both sides get Karp-Rabin hashes of SEED words at
every position.  A scan keeps the positions of a document whose hash some benchmark item has; these
seeds are joined with the items' seeds by their words, a row for each distinct seed of a document with
all its places, so repetition doesn't multiply.  Of each pair of document and item the longest match
whose words are still free is marked, then the next, until none of SEED words is left.  A pair counts if
the marked words cover COVERAGE of the item: order doesn't matter, so passages dealt in another order
are caught.  Pairs whose shared seeds can't cover so much aren't tiled.

Where the places of a pair multiply to TABLE at most, its matches are laid out by diagonals and taken
from a heap; else the longest matches are found by ranks of runs that double in length (running
Karp-Rabin with exact ranks), so texts that repeat one word cost no more than sorting them.

The screen is the benchmark's sorted hashes up to BROADCAST_SEEDS of them, and binary-fuse filters (nine
bits a seed) beyond it, where the join shuffles.

Defined cases: null and empty texts match nothing; an item of fewer than SEED words is matched by
documents that are that item and nothing else; repeated rows and items count once; rows of one
``doc_id`` with different texts are judged apart and the document is contaminated if one of them is;
texts of one item_id that differ are judged apart; empty tables give an empty result; other columns,
whatever their names, are ignored by the query and come through the stage as they are.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import without, written
from .exact_dedup import BUCKET_DIGESTS, BinaryFuse, build_filters

#: Words of a seed and of the shortest tile.
SEED = 5
#: Share of an item's words that must be covered.
COVERAGE = 0.5
#: Seeds of the benchmark up to which they are broadcast (8 bytes each, and once more with their words).
BROADCAST_SEEDS = 1_000_000
#: Pairs of places up to which a pair's matches are laid out.
TABLE = 20_000
#: Documents that are screened at once.
GROUP = 64

_BASE = np.uint64(0x9E3779B97F4A7C15)


def words(text: str = "text") -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}]+", " "))


def seeds(tokens: list[bytes], k: int = SEED) -> np.ndarray:
    """Karp-Rabin hash of each k words in a row (of all words, if fewer): h(i+1) = h(i) * base - first * base^k + next, computed for all i together."""
    k = min(k, len(tokens))
    if not k:
        return np.zeros(0, np.int64)
    one = xxhash.xxh3_64_intdigest
    h = np.array([one(t) for t in tokens], np.uint64)
    with np.errstate(over="ignore"):
        out = np.zeros(len(h) - k + 1, np.uint64)
        for i in range(k):
            out = out * _BASE + h[i : i + len(out)]
        return ((out ^ (out >> np.uint64(31))) * _BASE).view(np.int64)


def tile(hits: list[tuple[list[int], list[int]]], k: int = SEED) -> tuple[list[tuple[int, int, int]], int]:
    """Greedy tiles (doc position, item position, words) of a pair, and the words they cover; a hit has the places of one seed in either."""
    if sum(len(a) * len(b) for a, b in hits) <= TABLE:
        return _laid_out([x for a, b in hits for x in a for _ in b], [y for a, b in hits for _ in a for y in b], k)
    doc, item = (np.full(1 + max(max(h[side]) for h in hits), -1, np.int64) for side in (0, 1))
    for number, (a, b) in enumerate(hits):
        doc[a] = item[b] = number
    return _by_ranks(doc, item, k)


def _laid_out(doc_at: list[int], item_at: list[int], k: int) -> tuple[list[tuple[int, int, int]], int]:
    d, i = np.array(doc_at, np.int64), np.array(item_at, np.int64)
    order = np.lexsort((d, i - d))
    d, i = d[order], i[order]
    new = np.ones(len(d), bool)
    new[1:] = (np.diff(i - d) != 0) | (np.diff(d) != 1)
    start = np.flatnonzero(new)
    length = np.diff(np.append(start, len(d))) + k - 1
    queue = [(-int(n), int(i[s]), int(d[s])) for s, n in zip(start, length, strict=True)]
    heapq.heapify(queue)
    first = int(d.min())
    free_d, free_i = np.ones(int(d.max()) - first + k, bool), np.ones(int(i.max()) + k, bool)
    tiles, covered = [], 0
    while queue:
        n, b, a = heapq.heappop(queue)
        n = -n
        free = free_d[a - first : a - first + n] & free_i[b : b + n]
        if free.all():
            free_d[a - first : a - first + n] = free_i[b : b + n] = False
            tiles.append((a, b, n))
            covered += n
            continue
        edge = np.flatnonzero(np.diff(np.concatenate([[0], free.view(np.int8), [0]])))
        for s, e in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            if e - s >= k:
                heapq.heappush(queue, (s - e, b + s, a + s))
    return tiles, covered


def _joined(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ranks of the pairs of ranks; -1 where either is."""
    out, on = np.full(len(x), -1, np.int64), (x >= 0) & (y >= 0)
    if on.any():
        out[on] = np.unique(x[on] * (int(y.max()) + 1) + y[on], return_inverse=True)[1]
    return out


def _longest(doc: np.ndarray, item: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """(m, doc ranks, item ranks): length of the longest common run, and equal ranks where runs of that length are equal; m is 0 if there is none."""
    n = len(doc)

    def later(r: np.ndarray, by: int) -> np.ndarray:
        """What stands ``by`` places further on in the same text."""
        out = np.full(len(r), -1, np.int64)
        for low, high in ((0, n), (n, len(r))):
            if high - low > by:
                out[low : high - by] = r[low + by : high]
        return out

    def common(r: np.ndarray) -> bool:
        mark = np.zeros(int(r.max()) + 2, bool)
        mark[r[:n]] = True
        mark[-1] = False  # rank -1
        return bool(mark[r[n:]].any())

    now = np.concatenate([doc, item])
    if not len(now) or not common(now):
        return 0, doc, item
    powers, length = [now], 1
    while common(more := _joined(now, later(now, length))):
        now, length = more, 2 * length
        powers.append(now)
    step = length
    for rank in reversed(powers[:-1]):
        step //= 2
        if common(more := _joined(now, later(rank, length))):
            now, length = more, length + step
    return length, now[:n], now[n:]


def _by_ranks(doc: np.ndarray, item: np.ndarray, k: int) -> tuple[list[tuple[int, int, int]], int]:
    """As ``tile``, over the seeds' numbers at each place (-1 where none is shared); all tiles of one length a round."""
    tiles, covered = [], 0
    while True:
        m, here, there = _longest(doc, item)
        if not m:
            return tiles, covered
        words, places = m + k - 1, defaultdict(list)
        for at in np.flatnonzero(np.isin(here, there[there >= 0]))[::-1].tolist():
            places[int(here[at])].append(at)  # the first place is last
        held = np.zeros(len(doc), bool)
        free_from = 0
        for b in np.flatnonzero(there >= 0).tolist():
            own = places.get(int(there[b]))
            if b < free_from or not own:
                continue
            while own and held[own[-1]]:
                own.pop()
            if own:
                a = own.pop()
                tiles.append((a, b, words))
                covered += words
                held[max(0, a - words + 1) : a + words] = True
                free_from = b + words
        for a, b, n in tiles:
            if n == words:
                doc[max(0, a - k + 1) : a + n] = -1
                item[max(0, b - k + 1) : b + n] = -1


def item_seeds(benchmark: DataFrame, k: int = SEED) -> DataFrame:
    """(item_id, item, item_words, seed, gram, item_at) a distinct seed of each distinct text of an item; item is a hash of the text, item_at all places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column(0), batch.column(1), strict=True):
                tokens = (text.as_py() or "").encode("utf-8", "surrogatepass").split()
                grams = _places(tokens, range(max(1, len(tokens) - k + 1)) if tokens else [], k)
                got, n = seeds(tokens, k), len(grams)
                if n:
                    cols = [pa.array([item.as_py()] * n, pa.int64()), pa.array([_name(tokens)] * n, pa.int64()), pa.array([len(tokens)] * n, pa.int64()), pa.array([int(got[at[0]]) for at in grams.values()], pa.int64())]
                    yield pa.RecordBatch.from_arrays([*cols, pa.array(list(grams), pa.binary()), pa.array(list(grams.values()), pa.list_(pa.int32()))], ["item_id", "item", "item_words", "seed", "gram", "item_at"])

    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), words().alias("w")).distinct()
    return rows.mapInArrow(run, "item_id long, item long, item_words long, seed long, gram binary, item_at array<int>")


def _name(tokens: list[bytes]) -> int:
    return xxhash.xxh64_intdigest(b" ".join(tokens)) - (1 << 63)


def _places(tokens: list[bytes], at: range | list[int], k: int) -> dict[bytes, list[int]]:
    """The places of each distinct run of k words."""
    out: dict[bytes, list[int]] = defaultdict(list)
    for i in at:
        out[b" ".join(tokens[i : i + k])].append(i)
    return out


class Sorted:
    """A test of hashes against sorted ones.  A table of one bit for each value of a hash's low bits drops most at once."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.unique(keys)
        self.low = np.zeros(1 << max(10, min(23, int(len(keys) * 16).bit_length())), bool)
        self.low[self.keys & (len(self.low) - 1)] = True

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        on = self.low[keys & (len(self.low) - 1)]
        at = np.flatnonzero(on)
        if len(at):
            on[at] = self.keys[np.minimum(np.searchsorted(self.keys, keys[at]), len(self.keys) - 1)] == keys[at]
        return on


class Fused:
    """A test of hashes against binary-fuse filters of buckets: none is missed, few pass that shouldn't."""

    def __init__(self, filters: dict[int, BinaryFuse], buckets: int):
        self.filters, self.buckets = filters, buckets

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        on, bucket = np.zeros(len(keys), bool), keys % self.buckets
        order = np.argsort(bucket, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1) if len(keys) else []:
            if (own := self.filters.get(int(bucket[part[0]]))) is not None:
                on[part] = own.has(keys[part].view(np.uint64))
        return on


def screen(own: DataFrame, n: int) -> Callable[[np.ndarray], np.ndarray]:
    """A test of hashes against the seeds of ``own`` (n rows) that misses none."""
    if n <= BROADCAST_SEEDS:
        return Sorted(own.select("seed").toArrow().column("seed").to_numpy())
    buckets = -(-n // BUCKET_DIGESTS)
    keyed = own.select(F.col("seed").alias("key64"), F.pmod("seed", F.lit(buckets)).alias("bucket"))
    return Fused({r["bucket"]: BinaryFuse.from_bytes(bytes(r["filter"])) for r in build_filters(keyed).toLocalIterator()}, buckets)


def doc_seeds(docs: DataFrame, known: Callable[[np.ndarray], np.ndarray], k: int = SEED) -> DataFrame:
    """(doc_id, copy, gram, doc_at) a distinct seed of a document that ``known`` lets through; copy is a hash of the words, doc_at all places."""
    held = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, GROUP):
                part = batch.slice(begin, GROUP)
                tokens = [(t.as_py() or "").encode("utf-8", "surrogatepass").split() for t in part.column(1)]
                got = [seeds(t, k) for t in tokens]
                on = held.value(np.concatenate(got))
                out, low = ([], [], [], []), 0
                for doc, own, keys in zip(part.column(0).to_pylist(), tokens, got, strict=True):
                    at = np.flatnonzero(on[low : low + len(keys)]).tolist()
                    low += len(keys)
                    if at:
                        copy = _name(own)
                        for gram, places in _places(own, at, k).items():
                            for column, v in zip(out, (doc, copy, gram, places), strict=True):
                                column.append(v)
                if out[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, (pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int32())), strict=True)], ["doc_id", "copy", "gram", "doc_at"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), words().alias("w")).mapInArrow(run, "doc_id long, copy long, gram binary, doc_at array<int>")


def tiled(docs: DataFrame, benchmark: DataFrame, k: int = SEED, least: float = 0.0) -> DataFrame:
    """(doc_id, item_id, item_words, covered, tiles) of each pair that shares a seed, unless its seeds can't cover ``least`` of the item."""
    own = written(item_seeds(benchmark, k), "seeds")
    n = own.count()
    mine = own.select("item_id", "item", "item_words", "gram", "item_at")
    shared = doc_seeds(docs, screen(own, n), k).join(F.broadcast(mine) if n <= BROADCAST_SEEDS else mine, "gram")
    pairs = shared.groupBy("doc_id", "copy", "item_id", "item", "item_words").agg(F.collect_set(F.struct("doc_at", "item_at")).alias("hits"))
    reach = F.aggregate("hits", F.lit(0), lambda n, x: n + F.size(x["item_at"])) * F.least(F.col("item_words"), F.lit(k))
    pairs = pairs.filter(reach >= F.col("item_words") * least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list[int], list[int]] = ([], [])
            for size, hits in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                tiles, covered = tile([(h["doc_at"], h["item_at"]) for h in hits], min(k, size))
                out[0].append(covered)
                out[1].append(len(tiles))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in range(3)), *(pa.array(v, pa.int64()) for v in out)], ["doc_id", "item_id", "item_words", "covered", "tiles"])

    return pairs.select("doc_id", "item_id", "item_words", "hits").mapInArrow(run, "doc_id long, item_id long, item_words long, covered long, tiles long")


def leaks(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """Pairs (doc_id, item_id, coverage, tiles) that reach ``coverage``."""
    share = F.col("covered") / F.col("item_words")
    return tiled(docs, benchmark, least=coverage).withColumn("coverage", share).filter(F.col("coverage") >= coverage).select("doc_id", "item_id", "coverage", "tiles")


def op6(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row a contaminated document: its best item, the coverage, and how many items it holds."""
    pairs = leaks(docs, benchmark)
    return pairs.groupBy("doc_id").agg(F.max_by("item_id", F.struct("coverage", -F.col("item_id"))).alias("item_id"), F.max("coverage").alias("coverage"), F.countDistinct("item_id").alias("n_items"))


def stage(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows of documents that hold no benchmark item; rows without doc_id stay."""
    bad = leaks(docs, benchmark).filter("doc_id is not null").select("doc_id").distinct()
    return without(docs, written(bad, "leaks"))

"""SimHash near-duplicates by a binary-trie self-join.

Fingerprints are grouped first, so any number of copies is one leaf.  At most two bits may differ, so
of the four 16-bit quarters of two linked fingerprints two are equal: each fingerprint goes to six
tries, one for each pair of quarters, keyed by those 32 bits.  Inside a key the trie over the other 32
bits is joined with itself: pairs of nodes go down together, add up the bits in which their paths
differ, and end where the error budget is exceeded.  Since leaves differ, a leaf has at most 528
partners there, so the work is linear in a key's leaves.  A key with more than HOT leaves is split
first: its leaves are copied to pairs of nodes eight bits down (37 at most), each a task's key of its
own, and a node that still has more is split again.  Links leave a key as a star, and components are found by alternating large and small stars
over tables written to the shared folder.

Defined cases: null and blank texts have fingerprint zero and are linked like any other; repeated
rows each get their row; a null ``doc_id`` is never a component's smallest unless it is alone; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: Bits in which linked fingerprints may differ.
BUDGET = 2
#: Words of a shingle.
WORDS = 3
#: Leaves above which one trie, or one node of it, is split eight bits further down.
HOT = 20_000
#: Node pairs that one step of the traversal holds.
FRONT = 400_000
#: Shingles whose bits are unpacked at once.
CHUNK = 1 << 15


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """SimHash of XXH64 (seed 42) of a text's word shingles, repeats included."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII blanks only
    if not tokens:
        return 0
    shingles = [b" ".join(tokens)] if len(tokens) < words else map(b" ".join, zip(*(tokens[i:] for i in range(words)), strict=False))
    digest = xxhash.xxh64_digest
    raw = np.frombuffer(b"".join([digest(s, 42) for s in shingles]), np.uint8).reshape(-1, 8)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(raw), CHUNK):
        ones += np.unpackbits(raw[at : at + CHUNK], axis=1).sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(ones * 2 > len(raw)).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, fp) a row; fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), words) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], ["doc_id", "fp"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, fp long")


def _quarters() -> list[tuple[int, int, int, int]]:
    """The six ways to choose the two equal quarters, then the two others."""
    return [(a, b, *[c for c in range(4) if c not in (a, b)]) for a in range(4) for b in range(a + 1, 4)]


def _quarter(fp: Column, i: int) -> Column:
    return F.shiftrightunsigned(fp, 48 - 16 * i).bitwiseAND(F.lit(0xFFFF))


def trie_keys(fps: DataFrame) -> DataFrame:
    """Six rows a fingerprint: (trie, rest, fp).  trie names the pair of quarters and their 32 bits, rest has the other 32."""
    fp = F.col("fp")
    forms = [F.struct((F.lit(i << 32) + F.shiftleft(_quarter(fp, a), 16) + _quarter(fp, b)).alias("trie"), (F.shiftleft(_quarter(fp, c), 16) + _quarter(fp, d)).alias("rest")) for i, (a, b, c, d) in enumerate(_quarters())]
    return fps.select("fp", F.explode(F.array(*forms)).alias("k")).select("k.trie", "k.rest", "fp")


def split_hot(keys: DataFrame, budget: int = BUDGET, hot: int = HOT) -> DataFrame:
    """(trie, node, rest, fp): node is -1, or in tries of over ``hot`` leaves the smaller end of a pair of nodes eight bits down, and so on while a node has more.

    A leaf goes to each node whose bits differ from its own in what is left of ``budget`` at most, so two
    linked leaves meet at least once: at the node of either.  After 32 bits a node has 529 leaves at most.
    """
    near = F.array(*[F.struct(F.lit(m).cast("long").alias("mask"), F.lit(m.bit_count()).alias("bits")) for m in range(256) if m.bit_count() <= budget])
    rows = keys.select("trie", F.lit(-1).cast("long").alias("node"), "rest", "fp", F.lit(budget).alias("left"))
    for shift in (24, 16, 8, 0):
        large = written(rows.groupBy("trie", "node").count().filter(F.col("count") > hot).select("trie", "node", F.lit(True).alias("hot")), "hot")
        if large.isEmpty():
            break
        own = F.shiftrightunsigned("rest", shift).bitwiseAND(F.lit(255))
        down = F.transform(F.filter(near, lambda x: x["bits"] <= F.col("left")), lambda x: F.struct(((F.col("node") + 1) * 256 + own.bitwiseXOR(x["mask"])).alias("node"), (F.col("left") - x["bits"]).alias("left")))
        stay = F.array(F.struct("node", "left"))
        rows = rows.join(large, ["trie", "node"], "left").select("trie", "rest", "fp", F.explode(F.when(F.col("hot"), down).otherwise(stay)).alias("x")).select("trie", "x.node", "rest", "fp", "x.left")
    return rows.select("trie", "node", "rest", "fp")


def linked(leaves: np.ndarray, lo: np.ndarray, hi: np.ndarray, budget: int = BUDGET) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of indices of ``leaves`` (uint32, sorted inside each [lo, hi)) that differ in ``budget`` bits at most.

    Each [lo, hi) is a trie's root; all tries go down a bit at a time together.
    """
    ones = [np.concatenate([[0], np.cumsum((leaves >> np.uint32(bit)) & np.uint32(1), dtype=np.int64)]) for bit in range(31, -1, -1)]
    found: list[tuple[np.ndarray, np.ndarray]] = []
    stack = [(0, np.stack([lo, hi, lo, hi, np.zeros(len(lo), np.int64)]))]
    while stack:
        depth, front = stack.pop()
        single = (front[1] - front[0] == 1) & (front[3] - front[2] == 1)
        a, b = front[0, single], front[2, single]
        if len(a):
            ok = (np.bitwise_count(leaves[a] ^ leaves[b]) <= budget) & (a != b)
            found.append((a[ok], b[ok]))
        front = front[:, ~single]
        if depth == 32 or not front.shape[1]:
            continue
        if front.shape[1] > FRONT:
            half = front.shape[1] // 2
            stack += [(depth, front[:, :half]), (depth, front[:, half:])]
            continue
        total = ones[depth]
        mid1, mid2 = front[1] - (total[front[1]] - total[front[0]]), front[3] - (total[front[3]] - total[front[2]])
        same = front[0] == front[2]
        children = [(front[0], mid1, front[2], mid2, 0, None), (mid1, front[1], mid2, front[3], 0, None), (front[0], mid1, mid2, front[3], 1, None), (mid1, front[1], front[2], mid2, 1, ~same)]
        parts = []
        for l1, h1, l2, h2, cost, only in children:
            keep = (h1 > l1) & (h2 > l2) & (front[4] + cost <= budget)
            keep &= ~((l1 == l2) & (h1 - l1 == 1))
            if only is not None:
                keep &= only
            parts.append(np.stack([l1[keep], h1[keep], l2[keep], h2[keep], front[4, keep] + cost]))
        stack.append((depth + 1, np.concatenate(parts, axis=1)))
    return tuple(np.concatenate([f[i] for f in found] or [np.zeros(0, np.int64)]) for i in (0, 1))  # type: ignore[return-value]


def linked_wide(leaves: np.ndarray, lo: np.ndarray, hi: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """``linked`` for fingerprints of several words: rows of ``leaves`` (uint64), sorted inside each [lo, hi)."""
    words = leaves.shape[1]
    totals: dict[int, np.ndarray] = {}  # of a bit, how many leaves before each have it; only of the depths in use

    def ones(depth: int) -> np.ndarray:
        if depth not in totals:
            bit = (leaves[:, depth // 64] >> np.uint64(63 - depth % 64)) & np.uint64(1)
            totals[depth] = np.concatenate([[0], np.cumsum(bit, dtype=np.int64)])
        return totals[depth]

    found: list[tuple[np.ndarray, np.ndarray]] = []
    stack = [(0, np.stack([lo, hi, lo, hi, np.zeros(len(lo), np.int64)])[:, hi - lo > 1])]
    while stack:
        depth, front = stack.pop()
        for old in [d for d in totals if d > depth + 1]:
            del totals[old]
        if front.shape[1] > FRONT // words:
            half = front.shape[1] // 2
            stack += [(depth, front[:, :half]), (depth, front[:, half:])]
            continue
        single = (front[1] - front[0] == 1) & (front[3] - front[2] == 1)
        a, b = front[0, single], front[2, single]
        if len(a):
            ok = (np.bitwise_count(leaves[a] ^ leaves[b]).sum(axis=1, dtype=np.int64) <= budget) & (a != b)
            found.append((a[ok], b[ok]))
        front = front[:, ~single]
        if not front.shape[1]:
            continue
        if depth == 64 * words:  # equal fingerprints
            for l1, h1, l2, h2, _ in front.T.tolist():
                a, b = (x.ravel() for x in np.meshgrid(np.arange(l1, h1), np.arange(l2, h2), indexing="ij"))
                keep = (a < b) if l1 == l2 else np.ones(len(a), bool)
                found.append((a[keep], b[keep]))
            continue
        total = ones(depth)
        mid1, mid2 = front[1] - (total[front[1]] - total[front[0]]), front[3] - (total[front[3]] - total[front[2]])
        same = front[0] == front[2]
        parts = []
        for l1, h1, l2, h2, cost, only in [(front[0], mid1, front[2], mid2, 0, None), (mid1, front[1], mid2, front[3], 0, None), (front[0], mid1, mid2, front[3], 1, None), (mid1, front[1], front[2], mid2, 1, ~same)]:
            keep = (h1 > l1) & (h2 > l2) & (front[4] + cost <= budget)
            keep &= ~((l1 == l2) & (h1 - l1 == 1))
            if only is not None:
                keep &= only
            parts.append(np.stack([l1[keep], h1[keep], l2[keep], h2[keep], front[4, keep] + cost]))
        stack.append((depth + 1, np.concatenate(parts, axis=1)))
    return tuple(np.concatenate([f[i] for f in found] or [np.zeros(0, np.int64)]) for i in (0, 1))  # type: ignore[return-value]


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest node that the edges a-b reach."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _stars(batches: Iterator[pa.RecordBatch], budget: int) -> Iterator[pa.RecordBatch]:
    """Links of the tries in a partition sorted by (trie, node, rest), as stars (a, b)."""

    def solve(trie: np.ndarray, node: np.ndarray, rest: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        starts = np.flatnonzero(np.concatenate([[True], (trie[1:] != trie[:-1]) | (node[1:] != node[:-1])]))
        ends = np.append(starts[1:], len(trie))
        several = ends - starts > 1
        a, b = linked(rest.astype(np.uint32), starts[several], ends[several], budget)
        root = roots(len(fp), a, b)
        own = np.flatnonzero(root != np.arange(len(fp)))
        return pa.RecordBatch.from_arrays([pa.array(fp[root[own]]), pa.array(fp[own])], ["a", "b"])

    held: list[list[np.ndarray]] = []
    size = 0
    for batch in batches:
        if batch.num_rows:
            held.append([batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)])
            size += batch.num_rows
        if size >= HOT:
            cols = [np.concatenate(c) for c in zip(*held, strict=True)]
            last = (cols[0] == cols[0][-1]) & (cols[1] == cols[1][-1])
            at = int(np.argmax(last))  # the last trie may go on in the next batch
            if at:
                yield solve(*(c[:at] for c in cols))
            held, size = [[c[at:] for c in cols]], 0  # counted anew, so a long trie isn't copied each time
    if held:
        yield solve(*(np.concatenate(c) for c in zip(*held, strict=True)))


def links(fps: DataFrame, budget: int = BUDGET, hot: int = HOT) -> DataFrame:
    """Distinct fingerprints (fp) to links (a, b) that join each component."""
    if budget > BUDGET:
        raise ValueError(f"fingerprints that differ in {budget} bits need not have two equal quarters; {BUDGET} at most")
    keys = split_hot(trie_keys(fps), budget, hot)
    dealt = keys.repartition("trie", "node").sortWithinPartitions("trie", "node", "rest")
    return dealt.mapInArrow(lambda it: _stars(it, budget), "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of the edges (a, b): root is the smallest node reachable.  Large star and small star in turn."""
    one = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    now = written(one, "edges")
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.*").filter("a <> b").distinct()
        now = written(small, "edges")
        new = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if mark == tuple(new):
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        mark = tuple(new)


def simhash_components(docs: DataFrame, words: int = WORDS, budget: int = BUDGET, hot: int = HOT) -> DataFrame:
    """(doc_id, fp, component_id) a row of ``docs``."""
    rows = written(fingerprints(docs, words), "fingerprints")
    leaves = written(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "leaves")
    roots_ = components(links(leaves.select("fp"), budget, hot))
    known = leaves.join(roots_.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    first = known.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = written(known.join(first, "root").select("fp", "component_id"), "components")
    return rows.join(named, "fp").select("doc_id", "fp", "component_id")


def op8(docs: DataFrame) -> DataFrame:
    out = simhash_components(docs)
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")

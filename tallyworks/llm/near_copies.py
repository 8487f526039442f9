"""Near copies: documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Sets are nodes, equal ones the same node, so any number of copies costs as much as one.  Nodes that share
a band of ROWS least hash values (MinHash) meet in a group; at 0.8 a pair shares none of the BANDS bands
with probability (1 - 0.8 ** ROWS) ** BANDS, about 7e-4.  Bands with the same members are one group.  A
group of more than BLOCK shingles is dealt into blocks by a hash of the node, and each pair of blocks is
a task's group of its own.

Inside a group the nodes' SimHash fingerprints are joined by their binary trie (``simhash.linked_wide``):
pairs of nodes of the trie go down together, add up differing bits and end where the budget is exceeded.
The pairs of leaves that are left are judged by the exact similarity of their shingle sets, unless
links found before join them already.  A task gives out its links as stars, so what leaves a group is a
row a node, never a row a pair.

(The trie can't stand alone here: at 0.8 about ten of 64 bits differ, or 78 of 512, and with such a budget
the first levels prune nothing, so a trie over all documents would visit nearly all their pairs.)

Defined cases: null and blank texts have the empty set and are copies of each other; a text of fewer
than five words is a shingle of its own; words are split at ASCII blanks and A-Z count as small letters;
a null doc_id is never a component's smallest unless it is alone, and has its row; repeated rows each
get their row; very long texts are whole, their sets travel in pieces; an empty table gives an empty
result; other columns, whatever their names, are ignored, and kept by the stage.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import without, written
from .simhash import components, linked_wide

#: Words of a shingle.
WORDS = 5
#: Similarity from which texts are near copies, as a fraction: 4/5.
SIMILAR = (4, 5)
#: Bands of a set, and least values in each.
BANDS, ROWS = 24, 6
#: 64-bit words of a SimHash fingerprint.
WIDE = 8
#: Bits in which fingerprints of similar sets may differ.  Of sets of four and five shingles, the worst case at 0.8, three bits of 16 differ; this is four deviations more.
BUDGET = 131
#: Shingles whose values are computed at once, and of a piece of a set.
CHUNK, PIECE = 1 << 12, 1 << 10
#: Shingles of a block of a group, about.
BLOCK = 1 << 20
#: Shingles of the groups that are compared at once, about.
BATCH = 1 << 18

_RNG = np.random.default_rng(42)
_FACTORS = _RNG.integers(0, 2**64, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
_TERMS = _RNG.integers(0, 2**64, BANDS * ROWS, dtype=np.uint64)
_WIDE_FACTORS = _RNG.integers(0, 2**64, WIDE, dtype=np.uint64) | np.uint64(1)


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct XXH64 of a text's word shingles."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return np.zeros(0, np.uint64)
    parts = [b" ".join(tokens)] if len(tokens) < words else map(b" ".join, zip(*(tokens[i:] for i in range(words)), strict=False))
    digest = xxhash.xxh64_digest
    return np.unique(np.frombuffer(b"".join([digest(s, 42) for s in parts]), ">u8").astype(np.uint64))


def name(own: np.ndarray) -> int:
    """A set's node."""
    return xxhash.xxh64_intdigest(own.tobytes()) - (1 << 63)


def bands(own: np.ndarray) -> list[int]:
    """Keys of a set's bands; the empty set has none."""
    if not len(own):
        return []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(own), CHUNK):
        part = own[at : at + CHUNK]
        for i in range(BANDS * ROWS):
            least[i] = min(least[i], (part * _FACTORS[i] + _TERMS[i]).min())
    return [xxhash.xxh64_intdigest(least[k * ROWS : (k + 1) * ROWS].tobytes(), k) - (1 << 63) for k in range(BANDS)]


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, node, n, bands) a row; n is the size of its set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, sizes, keys = [], [], []
            for text in batch.column(1):
                own = shingles(text.as_py())
                nodes.append(name(own))
                sizes.append(len(own))
                keys.append(bands(own))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "node", "n", "bands"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, node long, n long, bands array<long>")


def wide_fingerprint(own: np.ndarray) -> np.ndarray:
    """SimHash of a set of hashes, WIDE words."""
    ones = np.zeros((WIDE, 64), np.int64)
    for at in range(0, len(own), CHUNK):
        part = own[at : at + CHUNK]
        for w in range(WIDE):
            h = part * _WIDE_FACTORS[w]
            h = (h ^ (h >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
            ones[w] += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(ones * 2 > len(own), axis=1).view(">u8").astype(np.uint64).ravel()


def sets(docs: DataFrame) -> DataFrame:
    """(node, piece, print, own) a row: a piece of a node's set, as signed longs, and its fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple[int, int, np.ndarray, np.ndarray]] = []
            held = 0
            for at, text in enumerate(batch.column(0), 1):
                own = shingles(text.as_py())
                print_ = wide_fingerprint(own)
                rows += [(name(own), k, print_, own[k * PIECE : (k + 1) * PIECE]) for k in range(max(1, -(-len(own) // PIECE)))]
                held += len(own) + 1
                if at == batch.num_rows or held >= BATCH:
                    lists = [pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, c)]), pa.int32()), pa.array(np.concatenate(c).view(np.int64))) for c in zip(*((r[2], r[3]) for r in rows), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()), *lists], ["node", "piece", "print", "own"])
                    rows, held = [], 0

    return docs.select(F.col("text").cast("string")).mapInArrow(run, "node long, piece int, print array<long>, own array<long>")


class Sets:
    """Sets of a batch of groups, one after another: ``codes`` from ``starts``, small numbers instead of hashes."""

    def __init__(self, values: np.ndarray, starts: np.ndarray):
        self.codes, self.starts = np.unique(values, return_inverse=True)[1], starts
        self.sizes = np.diff(np.append(starts, len(values)))
        self.mark = np.zeros(int(self.codes.max(initial=-1)) + 1, bool)

    def similar(self, a: int, others: np.ndarray) -> np.ndarray:
        """Which of the others are similar to a: i common of m and n are where i / (m + n - i) reaches the fraction."""
        own = self.codes[self.starts[a] : self.starts[a] + self.sizes[a]]
        self.mark[own] = True
        n = self.sizes[others]
        ends = np.cumsum(n)
        places = np.arange(int(ends[-1])) + np.repeat(self.starts[others] - (ends - n), n)
        common = np.diff(np.concatenate([[0], np.cumsum(self.mark[self.codes[places]])])[np.concatenate([[0], ends])])
        self.mark[own] = False
        return common * sum(SIMILAR) >= (self.sizes[a] + n) * SIMILAR[0]


def joined(first: np.ndarray, group: np.ndarray, block: np.ndarray, print_: np.ndarray, values: np.ndarray, budget: int = BUDGET) -> np.ndarray:
    """For each row the smallest row of its group that links reach.

    ``first`` says where each row's set starts in ``values``.  Rows of one group, which are together, are
    compared; if it has rows of two blocks, only those of different ones.
    """
    every = np.arange(len(group))
    order = np.lexsort([*(print_[:, w] for w in range(print_.shape[1] - 1, -1, -1)), group])
    edges = np.flatnonzero(np.concatenate([[True], np.diff(group) != 0]))
    ends = np.append(edges[1:], len(group))
    a, b = linked_wide(print_[order], edges, ends, budget)
    a, b = order[a], order[b]
    mixed = np.maximum.reduceat(block, edges) != np.minimum.reduceat(block, edges)
    apart = np.repeat(mixed, ends - edges)
    keep = ~apart[a] | (block[a] != block[b])
    held = Sets(values, first)
    sizes = held.sizes
    keep &= np.minimum(sizes[a], sizes[b]) * SIMILAR[1] >= np.maximum(sizes[a], sizes[b]) * SIMILAR[0]
    a, b = np.minimum(a, b)[keep], np.maximum(a, b)[keep]
    order = np.argsort(a, kind="stable")
    a, b = a[order], b[order]
    root = every.copy()
    starts = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]])) if len(a) else np.zeros(0, np.int64)
    span = dict(zip(edges.tolist(), ends.tolist(), strict=True))
    begin = np.repeat(edges, ends - edges)
    for at, end in zip(starts.tolist(), np.append(starts[1:], len(a)).tolist(), strict=False):
        one = int(a[at])
        others = b[at:end][root[b[at:end]] != root[one]]
        if len(others):
            linked = others[held.similar(one, others)]
            if len(linked):
                own = root[begin[one] : span[int(begin[one])]]  # of this group
                gone = np.unique(np.append(root[linked], root[one]))
                own[np.isin(own, gone)] = gone[0]
    return root


def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) of the groups in a partition sorted by (key, i, j, node, piece), as stars."""

    def solve(table: pa.Table) -> pa.RecordBatch:
        key, i, j, node, block = (table.column(c).to_numpy() for c in ("key", "i", "j", "node", "block"))
        lists = table.column("own").combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        prints = np.asarray(table.column("print").combine_chunks().flatten()).view(np.uint64).reshape(-1, WIDE)
        values, offsets = np.asarray(lists.flatten()), np.asarray(lists.offsets)[:-1].astype(np.int64)
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])])
        rows = np.flatnonzero(new | np.concatenate([[True], node[1:] != node[:-1]]))  # the first piece of each set
        root = joined(offsets[rows] - offsets[0], np.cumsum(new)[rows], block[rows], prints[rows], values)
        own = np.flatnonzero(root != np.arange(len(root)))
        node = node[rows]
        return pa.RecordBatch.from_arrays([pa.array(node[root[own]]), pa.array(node[own])], ["a", "b"])

    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += len(batch.column(batch.schema.get_field_index("own")).flatten())
        if size >= BATCH:
            whole = pa.Table.from_batches(held)
            last = np.ones(whole.num_rows, bool)
            for c in ("key", "i", "j"):
                own = whole.column(c).to_numpy()
                last &= own == own[-1]
            at = int(np.argmax(last))  # the last group may go on in the next batch
            if at:
                yield solve(whole.slice(0, at).combine_chunks())
            held, size = whole.slice(at).combine_chunks().to_batches(), 0  # counted anew, so a long group isn't copied each time
    if held:
        yield solve(pa.Table.from_batches(held).combine_chunks())


def near_components(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """(doc_id, node, component_id) a row of ``docs``: the smallest doc_id that links of near copies reach."""
    rows = written(signatures(docs), "signatures")
    leaves = written(rows.groupBy("node").agg(F.min("doc_id").alias("first_id"), F.first("n").alias("n"), F.first("bands").alias("bands")), "leaves")
    keys = leaves.select("node", "n", F.explode("bands").alias("key"))
    members = [F.bit_xor(F.xxhash64("node", F.lit(k))).alias(f"x{k}") for k in range(2)]
    groups = keys.groupBy("key").agg(F.count("*").alias("count"), F.sum("n").alias("total"), *members).filter("count > 1")
    groups = written(groups.groupBy("count", "total", "x0", "x1").agg(F.min("key").alias("key")).select("key", F.greatest(F.ceil(F.col("total") / block), F.lit(1)).cast("long").alias("blocks")), "groups")
    own = F.pmod(F.xxhash64("node", F.lit("block")), F.col("blocks")).alias("block")
    dealt = keys.join(groups, "key").select("key", "node", own, F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
    dealt = written(dealt.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "node", "block"), "dealt")

    several = written(dealt.select("node").distinct(), "several")
    ids = leaves.join(several, "node", "left_semi").filter("first_id is not null").select(F.col("first_id").alias("doc_id"))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    texts = own.filter("doc_id is null").unionByName(own.join(ids, "doc_id", "left_semi").select("doc_id", "text"))
    known = sets(texts).join(several, "node", "left_semi").groupBy("node", "piece").agg(F.first("print").alias("print"), F.first("own").alias("own"))
    met = dealt.join(written(known, "sets"), "node").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "node", "piece")
    links = written(met.select("key", "i", "j", "node", "block", "print", "own").mapInArrow(stars, "a long, b long").distinct(), "links")

    whole = leaves.join(components(links), "node", "left").select("node", "first_id", F.coalesce("root", "node").alias("root"))
    least = whole.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = written(whole.join(least, "root").select("node", "component_id"), "components")
    return rows.join(named, "node").select("doc_id", "node", "component_id")


def stage(docs: DataFrame) -> DataFrame:
    """One document of each component stays: the smallest doc_id (all its rows; rows without doc_id stay)."""
    gone = near_components(docs).filter("doc_id is not null and doc_id <> component_id").select("doc_id").distinct()
    return without(docs, written(gone, "gone"))

"""Conversation prefix trie: which conversations begin alike, and how many code points sharing those beginnings saves.

A turn has an id, two hashes of its role, text and depth.  A conversation is cut into segments of
SEGMENT turns; a segment knows the key of what stands before it, the exclusive or of its turns' ids, so
a conversation of any length is many small rows.  Segments are range-partitioned by (segment number,
key before, ids, whether more follows, conversation), about SHARD of them to a shard.

A shard puts its segments into a padded matrix of turn ids and sorts it by numpy's lexsort.  Where a
column differs from the row above, the change is carried to the columns right of it by accumulated OR:
that mask marks where each depth's nodes start, and reduceat aggregates members and children of each
depth from the deepest one up.  A node is closed if all its members are inside the shard; it is open if
it is on the path of the shard's first or last row, or if a member goes on in another segment.  Open
nodes come out as parts, and the parts recombine by their key.  What is open is closed under "parent
of", so the open nodes are a trie of their own, whose leaves and savings are summed up the tree by
pointer jumping (a round doubles the distance).

Rebuilding: conversation c begins with the first h turns of the first conversation of its hundred.

Defined cases: rows without conv_id belong to no conversation and are left out; a null turn comes
first, turns that are equal are in the order of role, then of the text's SHA-256, so repeated rows
are turns each; null roles and texts are empty ones; conversations without turns after rebuilding
end in the root; an empty table has no conversation and gives an empty result; very long texts are read
whole, and only their hashes go further; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, written

#: Turns of a segment: columns of a matrix.
SEGMENT = 32
#: Segments of a shard, about.
SHARD = 20_000
#: Conversations that share the beginning of their first one.
GROUP = 100
#: A rebuilt conversation has fewer turns of that than this.
HEADS = 6

_PAD = np.iinfo(np.int64).min
_NODES = "depth long, k1 long, k2 long, up1 long, up2 long, is_open boolean, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved long, chars long, ends string, first_end long, n_ends long"


def _wide(n: int) -> Column:
    return F.lit(n).cast("long")


def numbered(rows: DataFrame) -> DataFrame:
    """Turns as (conv_id, place, digest, chars): place is 1, 2, ... in a conversation, however many turns it has.

    The turns are sorted by ranges; a task numbers what it has of each conversation, and the conversations
    that lie in several ranges, one for each edge of a range at most, get what the ranges before hold.
    """
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    digest = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    turns = rows.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), F.sha2(text, 256).alias("sha"), digest.alias("digest"), F.char_length(text).cast("long").alias("chars"))
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "sha"]
    dealt = written(turns, "turns").repartitionByRange(*order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, before = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            conv = batch.column(1).to_numpy(zero_copy_only=False)
            fresh = np.concatenate([[True], conv[1:] != conv[:-1]])
            starts = np.flatnonzero(fresh)
            place = np.arange(1, len(conv) + 1) - starts[np.cumsum(fresh) - 1]
            if conv[0] == last:
                place[: starts[1] if len(starts) > 1 else len(conv)] += before
            last, before = conv[-1], int(place[-1])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(place), batch.column(2), batch.column(3)], ["part", "conv_id", "place", "digest", "chars"])

    local = dealt.select(F.spark_partition_id().cast("long").alias("part"), "conv_id", "digest", "chars")
    local = written(local.mapInArrow(run, "part long, conv_id long, place long, digest string, chars long"), "places")
    ranges = local.groupBy("conv_id", "part").agg(F.max("place").alias("n"))
    several = ranges.groupBy("conv_id").count().filter("count > 1").select("conv_id")
    ahead = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = written(ranges.join(several, "conv_id", "left_semi").select("conv_id", "part", F.coalesce(F.sum("n").over(ahead), _wide(0)).alias("shift")), "shifts")
    out = local.join(F.broadcast(shifts), ["conv_id", "part"], "left")  # two rows an edge of a range at most, and the ranges inside one conversation
    return out.select("conv_id", (F.col("place") + F.coalesce("shift", _wide(0))).alias("place"), "digest", "chars")


def rebuilt(turns: DataFrame, group: int = GROUP, heads: int = HEADS) -> DataFrame:
    """(conv_id, total, depth, digest, chars) a turn of a rebuilt conversation; depth is null where it has none."""
    turns = written(turns, "numbered")
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(heads)).cast("long")
    base = F.col("conv_id") - F.col("conv_id") % group
    convs = turns.groupBy("conv_id").agg(F.max("place").alias("n")).withColumn("h", h).withColumn("base", base)
    first = turns.filter((F.col("place") < heads) & (F.col("conv_id") % group == 0))
    first = first.groupBy(F.col("conv_id").alias("base")).agg(F.array_sort(F.collect_list(F.struct("place", "digest", "chars"))).alias("first"))
    known = convs.join(first, "base", "left").withColumn("head", F.when(F.col("h") > 0, F.slice("first", 1, F.greatest(F.col("h"), _wide(1)).cast("int"))))
    known = known.withColumn("k", F.greatest(F.coalesce(F.size("head"), F.lit(0)), F.lit(0)).cast("long"))
    known = written(known.select("conv_id", "h", "k", "head", (F.col("k") + F.greatest(F.col("n") - F.col("h"), _wide(0))).alias("total")), "convs")
    begin = known.filter("k > 0").select("conv_id", "total", F.explode("head").alias("x")).select("conv_id", "total", F.col("x.place").alias("depth"), "x.digest", "x.chars")
    own = turns.join(known.select("conv_id", "h", "k", "total"), "conv_id").filter("place > h")
    own = own.select("conv_id", "total", (F.col("place") - F.col("h") + F.col("k")).alias("depth"), "digest", "chars")
    none = known.filter("total = 0").select("conv_id", "total", F.lit(None).cast("long").alias("depth"), F.lit(None).cast("string").alias("digest"), F.lit(None).cast("long").alias("chars"))
    return begin.unionByName(own).unionByName(none)


def segments(turns: DataFrame, size: int = SEGMENT) -> DataFrame:
    """(segment, p1, p2, conv_id, total, ids, chars): ids are pairs of hashes, p1 and p2 the exclusive or of those before the segment."""
    turns = turns.withColumn("segment", F.floor((F.coalesce("depth", _wide(1)) - 1) / size).cast("long"))
    turn = F.struct("depth", F.xxhash64("depth", "digest").alias("v1"), F.xxhash64("digest", "depth", F.lit(1)).alias("v2"), "chars")
    held = turns.groupBy("conv_id", "total", "segment").agg(F.array_sort(F.collect_list(F.when(F.col("depth").isNotNull(), turn))).alias("t"), *[F.bit_xor(F.when(F.col("depth").isNotNull(), turn[f"v{i}"]).otherwise(_wide(0))).alias(f"x{i}") for i in (1, 2)])
    before = Window.partitionBy("conv_id").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)  # a row for SEGMENT turns
    keys = [F.coalesce(F.bit_xor(f"x{i}").over(before), _wide(0)).alias(f"p{i}") for i in (1, 2)]
    return held.select("segment", *keys, "conv_id", "total", F.transform("t", lambda x: F.struct(x["v1"].alias("v1"), x["v2"].alias("v2"))).alias("ids"), F.transform("t", lambda x: x["chars"]).alias("chars"))


def _hashed(ids: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, ids.tolist())).encode()).hexdigest()


def nodes(segment: np.ndarray, p1: np.ndarray, p2: np.ndarray, conv: np.ndarray, total: np.ndarray, sizes: np.ndarray, v1: np.ndarray, v2: np.ndarray, chars: np.ndarray, size: int = SEGMENT) -> dict[str, list]:
    """A shard's nodes, columns of _NODES; v1, v2 and chars hold the turns of all segments in a row."""
    rows, width = len(sizes), int(sizes.max(initial=0))
    inside = np.arange(width)[None, :] < sizes[:, None]
    ids = np.full((2, rows, width), _PAD)
    length = np.zeros((rows, width), np.int64)
    ids[0][inside], ids[1][inside], length[inside] = v1, v2, chars
    goes_on = total > (segment + 1) * size
    order = np.lexsort([conv, goes_on, *(ids[i][:, j] for j in range(width - 1, -1, -1) for i in (1, 0)), p2, p1, segment])
    segment, p1, p2, conv, goes_on, sizes, length, inside = (x[order] for x in (segment, p1, p2, conv, goes_on, sizes, length, inside))
    ids = ids[:, order]

    change = np.ones((rows, width + 1), bool)
    change[1:, 0] = (segment[1:] != segment[:-1]) | (p1[1:] != p1[:-1]) | (p2[1:] != p2[:-1])
    change[1:, 1:] = (ids[:, 1:] != ids[:, :-1]).any(axis=0)
    start = np.logical_or.accumulate(change, axis=1)
    keys = np.zeros((2, rows, width + 1), np.int64)
    keys[0, :, 0], keys[1, :, 0] = p1, p2
    keys[:, :, 1:] = np.where(inside[None], ids, 0)
    keys = np.bitwise_xor.accumulate(keys, axis=2)

    edge = goes_on.copy()
    edge[[0, -1]] = True
    one, below = np.ones(rows, np.int64), np.zeros((3, rows), np.int64)  # of closed children, at their first rows: children, leaves, saved
    levels: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
    out: dict[str, list] = {name.split()[0]: [] for name in _NODES.split(", ")}
    made: list[tuple[int, dict[str, np.ndarray]]] = []
    for j in range(width, -1, -1):
        first = np.flatnonzero(start[:, j])
        n, least = np.add.reduceat(one, first), np.minimum.reduceat(conv, first)
        is_open = np.maximum.reduceat(edge, first) | (j == 0)
        ends = (sizes == j) & ~goes_on & ((j > 0) | (segment == 0))
        n_ends = np.add.reduceat(ends.astype(np.int64), first)
        kids, leaves, saved = (np.add.reduceat(b, first) for b in below)
        text = length[first, j - 1] if j else np.zeros(len(first), np.int64)
        leaves = np.where(is_open, leaves, np.maximum(leaves, kids == 0))
        saved = np.where(is_open, saved, saved + (n - 1) * text)
        levels[j] = np.cumsum(start[:, j]) - 1, least, is_open
        real = sizes[first] >= j  # the others are padding
        below = np.zeros((3, rows), np.int64)
        closed = real & ~is_open
        below[:, first[closed]] = np.stack([np.ones(len(first), np.int64), leaves, saved])[:, closed]
        again = (segment[first] > 0) & (j == 0)  # the node itself is the last one of the segment before
        made.append((j, {"first": first[real], "n": np.where(again, 0, n)[real], "least": least[real], "again": again[real], "is_open": is_open[real], "kids": kids[real], "leaves": leaves[real], "saved": saved[real], "text": text[real], "n_ends": n_ends[real]}))
    for j, x in made:
        first, is_open = x["first"], x["is_open"]
        block, up_least, up_open = levels[j - 1] if j else (np.zeros(rows, np.int64), np.zeros(1, np.int64), np.ones(1, bool))
        up = block[first]
        lost = up_open[up] & (j > 0)  # the parent's smallest member is known after parts are recombined
        keep = lambda values, on: pa.array(values, mask=~on)
        out["depth"].append(pa.array(segment[first] * size + j))
        for i in (0, 1):
            out[f"k{i + 1}"].append(keep(keys[i][first, j], is_open))
            out[f"up{i + 1}"].append(keep(keys[i][first, max(j - 1, 0)], lost))
        out["is_open"].append(pa.array(is_open))
        out["conv_id"].append(keep(x["least"], ~x["again"]))
        out["parent_conv_id"].append(keep(up_least[up], ~lost & (j > 0)))
        for name, values in (("n_convs", x["n"]), ("n_children", x["kids"]), ("n_leaves", x["leaves"]), ("saved", x["saved"]), ("chars", x["text"]), ("n_ends", x["n_ends"])):
            out[name].append(pa.array(values))
        # those that end in a node are its first rows, by conv_id: padding and what doesn't go on sort first
        lists = [(conv[a : a + b]) if b else None for a, b in zip(first.tolist(), x["n_ends"].tolist(), strict=True)]
        said = [None if own is None else ",".join(map(str, own.tolist())) if o else _hashed(own) for own, o in zip(lists, is_open.tolist(), strict=True)]
        out["ends"].append(pa.array(said, pa.string()))
        out["first_end"].append(keep(conv[first], x["n_ends"] > 0))
    return out


def shards(rows: DataFrame, size: int = SEGMENT, shard: int = SHARD) -> DataFrame:
    """Nodes of each shard (_NODES): closed ones whole, open ones in parts."""
    count = -(-rows.count() // shard)
    dealt = rows.repartitionByRange(max(1, count), "segment", "p1", "p2", "ids", F.col("total") > (F.col("segment") + 1) * size, "conv_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        whole = pa.Table.from_batches(held).combine_chunks()
        cols = [whole.column(i).to_numpy() for i in range(5)]
        ids, chars = (whole.column(i).combine_chunks() for i in (5, 6))
        ids, chars = (c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in (ids, chars))
        flat = ids.flatten()
        v1, v2 = (np.asarray(flat.field(i)) for i in (0, 1))
        got = nodes(*cols, np.diff(np.asarray(ids.offsets)).astype(np.int64), v1, v2, np.asarray(chars.flatten()), size)
        for k in range(len(got["depth"])):
            yield pa.RecordBatch.from_arrays([got[name][k] for name in got], list(got))

    return dealt.mapInArrow(run, _NODES)


def summed(opened: DataFrame) -> DataFrame:
    """Open nodes (depth, k1, k2, up1, up2, leaves, saved) with leaves and saved added up over the open nodes below each, itself included."""
    key = ["depth", "k1", "k2"]
    now = opened.select(*key, F.when(F.col("up1").isNotNull(), F.struct((F.col("depth") - 1).alias("depth"), F.col("up1").alias("k1"), F.col("up2").alias("k2"))).alias("jump"), "leaves", "saved")
    now = written(now, "sums")
    while not now.filter("jump is not null").isEmpty():
        added = now.filter("jump is not null").groupBy(*[F.col(f"jump.{c}").alias(c) for c in key]).agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        target = now.select(F.struct(*key).alias("jump"), F.col("jump").alias("next"))
        ahead = now.filter("jump is not null").join(target, "jump").select(*key, "next", "leaves", "saved")
        rest = now.filter("jump is null").select(*key, "jump", "leaves", "saved")
        moved = rest.unionByName(ahead.withColumnRenamed("next", "jump"))
        now = written(moved.join(added, key, "left").select(*key, "jump", (F.col("leaves") + F.coalesce("more_leaves", _wide(0))).alias("leaves"), (F.col("saved") + F.coalesce("more_saved", _wide(0))).alias("saved")), "sums")
    return now.select(*key, "leaves", "saved")


def end_digests(parts: DataFrame) -> DataFrame:
    """(depth, k1, k2, digest) of open nodes in which conversations end: the lists of their shards in order, hashed as a stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, state = None, hashlib.sha256()
        give = lambda: pa.RecordBatch.from_arrays([pa.array([x]) for x in (*own, state.hexdigest())], ["depth", "k1", "k2", "digest"])
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if row[:3] != own:
                    if own:
                        yield give()
                    own, state = row[:3], hashlib.sha256()
                    state.update(row[3].encode())
                else:
                    state.update(b"," + row[3].encode())
        if own:
            yield give()

    rows = parts.filter("ends is not null").select("depth", "k1", "k2", "ends", "first_end").repartition("depth", "k1", "k2").sortWithinPartitions("depth", "k1", "k2", "first_end")
    return rows.select("depth", "k1", "k2", "ends").mapInArrow(run, "depth long, k1 long, k2 long, digest string")


def trie(rows: DataFrame, size: int = SEGMENT, shard: int = SHARD) -> DataFrame:
    """A row a node of the trie of ``rows`` (conv_id, turn, role, text), rebuilt: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    found = written(shards(written(segments(rebuilt(numbered(rows)), size), "segments"), size, shard), "nodes")
    key = ["depth", "k1", "k2"]
    parts = found.filter("is_open")
    opened = parts.groupBy(*key).agg(F.max("up1").alias("up1"), F.max("up2").alias("up2"), F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.sum("n_children").alias("n_children"), F.sum("n_leaves").alias("leaves"), F.sum("saved").alias("saved"), F.max("chars").alias("chars"))
    opened = written(opened, "open")
    kids = opened.filter("up1 is not null").groupBy((F.col("depth") - 1).alias("depth"), F.col("up1").alias("k1"), F.col("up2").alias("k2")).agg(F.count("*").alias("open_children"))
    whole = opened.join(kids, key, "left").withColumn("n_children", F.col("n_children") + F.coalesce("open_children", _wide(0))).drop("open_children")
    whole = whole.withColumn("leaves", F.col("leaves") + (F.col("n_children") == 0).cast("long")).withColumn("saved", F.col("saved") + (F.col("n_convs") - 1) * F.col("chars"))
    whole = written(whole, "whole")
    sums = summed(whole)
    names = written(whole.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("up1"), F.col("k2").alias("up2"), F.col("conv_id").alias("above")), "names")
    names = F.broadcast(names) if names.count() <= BROADCAST_IDS else names
    nothing = F.lit(hashlib.sha256(b"").hexdigest())

    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    open_rows = whole.drop("leaves", "saved").join(sums, key).join(end_digests(parts), key, "left").join(names, ["depth", "up1", "up2"], "left")
    open_rows = open_rows.select("conv_id", "depth", F.col("above").alias("parent_conv_id"), "n_convs", "n_children", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("digest", nothing).alias("ends_sha256"))
    inner = found.filter("not is_open and up1 is null").withColumn("above", F.col("parent_conv_id"))
    closed = found.filter("not is_open and up1 is not null").join(names, ["depth", "up1", "up2"]).select(inner.columns).unionByName(inner)
    closed = closed.select("conv_id", "depth", F.col("above").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), F.coalesce("ends", nothing).alias("ends_sha256"))
    return open_rows.select(columns).unionByName(closed.select(columns))


def op11(rows: DataFrame) -> DataFrame:
    return trie(rows)


#: DuckDB SQL of op11.  A node's rows are found through its smallest member, which has all nodes above it on its path.
ORACLE = f"""
    WITH ids AS (SELECT DISTINCT conv_id AS c FROM conversations WHERE conv_id IS NOT NULL),
    bits AS (SELECT c, flatten(list_transform(string_split(c::VARCHAR, ''), lambda ch: list_transform(range(8), lambda b: (ascii(ch) >> b) & 1))) AS b FROM ids),
    heads AS (
        SELECT c, c - c % {GROUP} AS base, xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda a, x: CASE WHEN xor(a, x) & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END), 4294967295) % {HEADS} AS h FROM bits),
    turns AS (
        SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
               row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(coalesce(text, ''))) AS place FROM conversations),
    long AS (
        SELECT c, 0 AS own, place, role, text FROM heads JOIN turns ON conv_id = base AND place <= h
        UNION ALL SELECT c, 1, place, role, text FROM heads JOIN turns ON conv_id = c AND place > h),
    path AS (
        SELECT c, row_number() OVER w AS d, length(text) AS chars, sha256(string_agg(sha256(length(role) || ':' || role || text), '') OVER w) AS k, count(*) OVER (PARTITION BY c) AS total
        FROM long WINDOW w AS (PARTITION BY c ORDER BY own, place)),
    every AS MATERIALIZED (
        SELECT c, d, chars, k, coalesce(lag(k) OVER (PARTITION BY c ORDER BY d), '') AS up, total FROM path
        UNION ALL SELECT c, 0, 0, '', NULL, (SELECT count(*) FROM path AS p WHERE p.c = ids.c) FROM ids),
    nodes AS MATERIALIZED (
        SELECT d, k, any_value(up) AS up, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(chars) AS own,
               sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (total = d), '')) AS ends_sha256
        FROM every GROUP BY d, k),
    kids AS (SELECT d - 1 AS d, up AS k, count(*) AS n FROM nodes WHERE d > 0 GROUP BY ALL),
    full_nodes AS (SELECT nodes.*, coalesce(kids.n, 0) AS n_children FROM nodes LEFT JOIN kids USING (d, k)),
    sums AS (
        SELECT e.d, e.k, sum((n.n_children = 0)::INT)::BIGINT AS n_leaves, sum(n.own)::BIGINT AS saved_tokens
        FROM full_nodes AS n JOIN every AS e ON e.c = n.conv_id AND e.d <= n.d GROUP BY ALL)
    SELECT f.conv_id, f.d AS depth, p.conv_id AS parent_conv_id, f.n_convs, f.n_children, n_leaves, saved_tokens, f.ends_sha256
    FROM full_nodes AS f JOIN sums USING (d, k) LEFT JOIN nodes AS p ON p.d = f.d - 1 AND p.k = f.up"""

"""Mixing sources to target weights: blocks of tokens, multinomial shards, index permutations.

Words of a source are packed into blocks of BLOCK words, document after document in an order dealt
by hash.  A source's target says how many slots it gets.  The slots are drawn from an urn that holds
EPOCHS copies of each of its blocks: what each output shard gets is a multinomial count without
replacement, drawn by halves (the shards are halved again and again, and a hash of the half seeds the
count of its left side, by the normal law of that mean and variance, held to what the urn has).  A
shard owns an equal part of a pseudorandom permutation of the source's block indices and takes as many
slots from its part as it drew, round after round.  So the draw decides which blocks are taken, totals
stay the source's target, and no block is taken more than EPOCHS times.  One slot a source is cut so
that the words taken equal the rounded target; the short last block of a source is taken once for each
whole round.  A slot finds its block by (source, block index), never by a search.

The permutation is a "swap or not" shuffle: rounds of x -> K - x (mod n), taken where a hash bit of
the pair is set, so any n has an exact permutation.

Only built-in functions run here.  Prefix sums over a hot source are two-level: sums of hash buckets
first, over ranges of all sources' buckets, then inside a bucket.  Sources are numbered by ranges and filled by sums over all of them, so a
table of very many sources is no task's.

Defined cases: null or blank text has size 0 and gives nothing; a null source is a source of its own,
last in order; repeated rows count and get their rows each; with no words all targets are 0; an empty
table gives an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BLANK, written

#: Weights of the sources in order, repeating.
WEIGHTS = (5, 2, 1)
#: Times that a document may be taken.
EPOCHS = 3
#: Words of a block.
BLOCK = 512
#: Slots of an output shard, about.
SHARD = 1024
#: Sources up to which their table is broadcast; beyond it the joins shuffle.
BROADCAST_SOURCES = 100_000
#: Rows of a bucket of the prefix sums, about.
BUCKET_ROWS = 500
#: Rounds of a permutation.
ROUNDS = 24
#: Halvings after which the counts are dealt anew over tasks.
DEAL = 8


def shuffled(x: Column, n: Column, key: Column, rounds: int = ROUNDS) -> Column:
    """A pseudorandom permutation of 0..n-1 applied to x; ``key`` names the permutation."""

    def step(acc: Column, r: Column) -> Column:
        mirror = F.pmod(F.pmod(F.xxhash64(key, r), n) - acc, n)
        return F.when(F.xxhash64(key, r, F.greatest(acc, mirror)).bitwiseAND(F.lit(1)) == 1, mirror).otherwise(acc)

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), x.cast("long"), step)


def _key(seed: int = 0) -> Column:
    return F.xxhash64(F.coalesce("source", F.lit("")), F.col("source").isNull(), F.lit(seed))


def ranked(sizes: DataFrame) -> DataFrame:
    """``sizes`` with ``place``: 0, 1, ... by source, null last.  Each range is numbered from what the ranges before it hold."""
    by = F.col("source").asc_nulls_last()
    dealt = written(sizes.repartitionByRange(by).sortWithinPartitions(by).withColumn("at", F.monotonically_increasing_id()), "ranges")
    part, inside = F.shiftright("at", 33), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    counts = dealt.groupBy(part.alias("part")).agg(F.count("*").alias("n")).withColumn("first", F.coalesce(F.sum("n").over(ahead), F.lit(0)))
    return dealt.join(F.broadcast(counts), part == F.col("part")).withColumn("place", F.col("first") + inside).select(*sizes.columns, "place")


def summed_before(rows: DataFrame, by: list[Column], sums: dict[str, str]) -> DataFrame:
    """``rows`` with sums over all rows before each in the order ``by``: (name of the sum: column).  A range's rows are a task's, and what the ranges before it hold is a row a range."""
    dealt = written(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("at", F.monotonically_increasing_id()), "ranges")
    dealt = dealt.withColumn("part", F.shiftright("at", 33))
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    held = dealt.groupBy("part").agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    held = held.select("part", *[F.coalesce(F.sum(n).over(ahead), F.lit(0)).alias(f"{n}_ahead") for n in sums])
    inside = Window.partitionBy("part").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    local = dealt.select(*rows.columns, "part", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(n) for n, c in sums.items()])
    return local.join(F.broadcast(held), "part").select(*rows.columns, *[(F.col(n) + F.col(f"{n}_ahead")).alias(n) for n in sums])


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """(source, source_size) to (source, source_size, weight, target): weighted shares of all words, none above ``epochs`` times its size.

    Sources fill in the order of words a weight that they can give.  If those before a source are full, what
    they leave over the weights from it on is the level (words a weight); the level is the greatest of those
    that their source reaches.
    """
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    rows = written(ranked(sizes).withColumn("weight", F.element_at(cycle, (F.pmod("place", F.lit(len(weights))) + 1).cast("int"))), "ranked")
    cap = F.col("source_size") * float(epochs)
    total, weight = rows.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0.0))).first()
    if not total:
        return rows.select("source", "source_size", "weight", F.lit(0.0).alias("target"))
    order = rows.select("weight", cap.alias("cap"), (cap / F.col("weight")).alias("reach"), "place")
    before = summed_before(order, [F.col("reach"), F.col("place")], {"full": "cap", "spent": "weight"})
    level = (F.lit(float(total)) - F.col("full")) / (F.lit(weight) - F.col("spent"))
    at = before.select(level.alias("level"), "reach").filter("level <= reach").agg(F.max("level")).first()[0]
    goal = cap if at is None else F.least(cap, F.lit(at) * F.col("weight"))
    return rows.select("source", "source_size", "weight", goal.alias("target"))


def plan(sources: DataFrame, block: int = BLOCK, epochs: int = EPOCHS, seed: int = 0) -> DataFrame:
    """One row a source with words: whole blocks, words of the short one, its rounds and its words beyond them, slots of whole blocks and words cut from one of them."""
    size, goal = F.col("source_size"), F.col("goal")
    rows = sources.filter("source_size > 0").withColumn("key", _key(seed)).withColumn("goal", F.least(F.round("target").cast("long"), size * epochs))
    rows = rows.withColumn("blocks", F.floor(size / block).cast("long")).withColumn("rounds", F.floor(goal / size).cast("long"))
    rows = rows.withColumn("tail", size - F.col("blocks") * block)
    rest = goal - F.col("rounds") * F.col("tail")
    rows = rows.withColumn("more", F.greatest(rest - F.col("blocks") * epochs * block, F.lit(0).cast("long")))
    rows = rows.withColumn("slots", F.ceil((rest - F.col("more")) / block).cast("long"))
    return rows.withColumn("cut", F.col("slots") * block - rest + F.col("more"))


def draw(planned: DataFrame, shards: int, epochs: int = EPOCHS, seed: int = 0) -> DataFrame:
    """The multinomial counts: (key, blocks, group, groups, low, width, n, cut); ``n`` slots come from places low..low+width-1 of the permutation.

    A source has a group for each shard, or for each block where those are fewer.
    """
    begin = planned.filter("slots > 0").select("key", "blocks", F.least(F.lit(shards).cast("long"), F.col("blocks")).alias("groups"), F.lit(0).cast("long").alias("group"), F.col("slots").alias("n"), "cut")
    nodes = begin.withColumn("span", F.col("groups"))
    edge = lambda g: F.floor(g * F.col("blocks") / F.col("groups")).cast("long")
    for level in range(math.ceil(math.log2(shards)) if shards > 1 else 0):
        half = F.floor(F.col("span") / 2).cast("long")
        held = (edge(F.col("group") + F.col("span")) - edge(F.col("group"))) * epochs
        left = (edge(F.col("group") + half) - edge(F.col("group"))) * epochs
        part = left / held
        spread = F.sqrt(F.col("n") * part * (1 - part) * (held - F.col("n")) / F.greatest(held - 1, F.lit(1)))
        even = lambda name: (F.pmod(F.xxhash64("key", "group", "span", F.lit(f"{name}{seed}")), F.lit(1 << 40)) + 0.5) / float(1 << 40)
        normal = F.sqrt(-2 * F.log(even("r"))) * F.cos(2 * math.pi * even("a"))
        low, high = F.greatest(F.col("n") - (held - left), F.lit(0).cast("long")), F.least(F.col("n"), left)
        nodes = nodes.withColumn("half", half).withColumn("a", F.least(F.greatest(F.round(F.col("n") * part + normal * spread).cast("long"), low), high))
        first = F.struct("group", F.col("half").alias("span"), F.col("a").alias("n"), F.when(F.col("a") > 0, F.col("cut")).otherwise(F.lit(0).cast("long")).alias("cut"))
        second = F.struct((F.col("group") + F.col("half")).alias("group"), (F.col("span") - F.col("half")).alias("span"), (F.col("n") - F.col("a")).alias("n"), F.when(F.col("a") > 0, F.lit(0).cast("long")).otherwise(F.col("cut")).alias("cut"))
        same = F.array(F.struct("group", "span", "n", "cut"))
        nodes = nodes.select("key", "blocks", "groups", F.explode(F.when(F.col("span") > 1, F.array(first, second)).otherwise(same)).alias("x")).select("key", "blocks", "groups", "x.*").filter("n > 0")
        if level % DEAL == DEAL - 1:
            nodes = nodes.repartition("key", "group")
    return nodes.select("key", "blocks", "group", "groups", edge(F.col("group")).alias("low"), (edge(F.col("group") + 1) - edge(F.col("group"))).alias("width"), "n", "cut")


def picks(planned: DataFrame, drawn: DataFrame, block: int = BLOCK) -> DataFrame:
    """A row a block that is taken: (key, index, group, groups, whole, part); ``whole`` times all of it, and once its first ``part`` words."""
    # A number is given, so that few small rows aren't put in one task before each becomes many.
    parts = int(planned.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = drawn.repartition(parts, "key", "group").withColumn("p", F.explode(F.sequence(F.lit(0).cast("long"), F.least("width", "n") - 1)))
    copies = F.floor(F.col("n") / F.col("width")).cast("long") + F.when(F.col("p") < F.col("n") % F.col("width"), 1).otherwise(0)
    short = (F.col("cut") > 0) & (F.col("p") == (F.col("n") - 1) % F.col("width"))
    index = shuffled(F.col("low") + F.col("p"), F.col("blocks"), F.col("key"))
    whole = rows.select("key", index.alias("index"), "group", "groups", (copies - short.cast("long")).alias("whole"), F.when(short, block - F.col("cut")).otherwise(F.lit(0)).cast("long").alias("part"))
    zero = F.lit(0).cast("long")
    return whole.unionByName(planned.filter("tail > 0 and rounds + more > 0").select("key", F.col("blocks").alias("index"), zero.alias("group"), zero.alias("groups"), F.col("rounds").alias("whole"), F.col("more").alias("part")))


def slots(picked: DataFrame, shards: int) -> DataFrame:
    """A row a slot: (shard, position, key, index, words); ``words`` is null for a whole block, else how many of its first words are taken.

    A group of its own shard stays in it; blocks of sources with fewer blocks than shards, and short
    ones, are dealt by hash.  A shard's slots are in an order dealt by hash.
    """
    copies = F.concat(F.when(F.col("whole") > 0, F.transform(F.sequence(F.lit(1).cast("long"), F.col("whole")), lambda k: F.struct(k.alias("copy"), F.lit(None).cast("long").alias("words")))).otherwise(F.array()), F.when(F.col("part") > 0, F.array(F.struct(F.lit(0).cast("long").alias("copy"), F.col("part").alias("words")))).otherwise(F.array()))
    rows = picked.select("key", "index", "group", "groups", F.explode(copies).alias("x")).select("key", "index", "group", "groups", "x.*")
    own = F.when(F.col("groups") == shards, F.col("group")).otherwise(F.pmod(F.xxhash64("key", "index", "copy"), F.lit(shards)))
    rows = rows.withColumn("shard", own).withColumn("deal", F.xxhash64("copy", "key", "index"))
    order = Window.partitionBy("shard").orderBy("deal", "key", "index", "copy")  # about SHARD rows each
    return rows.select("shard", (F.row_number().over(order) - 1).alias("position"), "key", "index", "words")


class Mix:
    """A corpus packed and drawn: ``rows`` (doc_id, source, size), ``sources``, ``pieces`` (documents cut at block ends) and ``picked``."""

    def __init__(self, docs: DataFrame, block: int = BLOCK, shard: int = SHARD, seed: int = 0):
        self.block = block
        rows = docs.select(F.col("doc_id"), F.col("source").cast("string").alias("source"), F.coalesce(F.regexp_count(F.col("text"), F.lit(f"[^{BLANK}]+")), F.lit(0)).cast("long").alias("size"))
        self.rows = written(rows, "sizes")
        buckets = max(1, -(-self.rows.count() // BUCKET_ROWS))
        rows = self.rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "size"), F.lit(buckets)))
        sums = written(rows.groupBy("source", "bucket").agg(F.sum("size").alias("words")), "sums")
        self.sources = written(targets(sums.groupBy("source").agg(F.sum("words").alias("source_size"))), "sources")
        planned = written(plan(self.sources, block, seed=seed), "plan")
        n = planned.agg(F.sum(F.col("slots") + F.col("rounds") + (F.col("more") > 0).cast("long"))).first()[0] or 0
        self.shards = max(1, -(-n // shard))
        self.picked = picks(planned, draw(planned, self.shards, seed=seed), block)

        ahead = summed_before(sums, [F.col("source"), F.col("bucket")], {"ahead": "words"})
        ahead = written(ahead.select(F.col("source").alias("source_"), F.col("bucket").alias("bucket_"), "ahead"), "ahead")
        own = written(ahead.groupBy(F.col("source_").alias("of_")).agg(F.min("ahead").alias("first")), "firsts")
        own = F.broadcast(own) if own.count() <= BROADCAST_SOURCES else own
        starts = ahead.join(own, F.col("source_").eqNullSafe(F.col("of_"))).select("source_", "bucket_", (F.col("ahead") - F.col("first")).alias("start"))
        inside = Window.partitionBy("source", "bucket").orderBy("doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        placed = rows.filter("size > 0").withColumn("within", F.sum("size").over(inside) - F.col("size"))
        placed = placed.join(starts, F.col("source").eqNullSafe(F.col("source_")) & (F.col("bucket") == F.col("bucket_"))).select("doc_id", "source", "size", (F.col("start") + F.col("within")).alias("begin"))
        first, last = F.floor(F.col("begin") / block).cast("long"), F.floor((F.col("begin") + F.col("size") - 1) / block).cast("long")
        pieces = placed.withColumn("key", _key(seed)).withColumn("index", F.explode(F.sequence(first, last)))
        low = F.greatest(F.col("begin") - F.col("index") * block, F.lit(0))
        high = F.least(F.col("begin") + F.col("size") - F.col("index") * block, F.lit(block))
        self.pieces = pieces.withColumn("low", low).withColumn("high", high)

    def taken(self) -> DataFrame:
        """(doc_id, source, size, source_size, target, taken) of each row."""
        part = F.coalesce("whole", F.lit(0)) * (F.col("high") - F.col("low")) + F.greatest(F.least("high", F.coalesce("part", F.lit(0))) - F.col("low"), F.lit(0))
        got = self.pieces.join(self.picked.select("key", "index", "whole", "part"), ["key", "index"], "left")
        got = got.groupBy("doc_id", "source", "size", "begin").agg(F.sum(part).alias("taken"))
        every = got.select("doc_id", "source", "size", "taken").unionByName(self.rows.filter("size = 0").select("doc_id", "source", "size", F.lit(0).cast("long").alias("taken")))
        named = self.sources.select(F.col("source").alias("source_"), "source_size", "target")
        out = every.join(F.broadcast(named) if named.count() <= BROADCAST_SOURCES else named, F.col("source").eqNullSafe(F.col("source_")))
        return out.select("doc_id", "source", "size", "source_size", "target", "taken")

    def blocks(self) -> DataFrame:
        """(shard, position, doc_id, source, begin, end): what each slot holds, as word numbers in its documents, end exclusive."""
        at = slots(self.picked, self.shards).join(self.pieces, ["key", "index"])
        end = F.least("high", F.coalesce("words", "high"))
        shift = F.col("index") * self.block - F.col("begin")
        return at.filter(F.col("low") < end).select("shard", "position", "doc_id", "source", (F.col("low") + shift).alias("begin"), (end + shift).alias("end"))


def mixed(docs: DataFrame, block: int = BLOCK, shard: int = SHARD, seed: int = 0) -> DataFrame:
    """Rows of ``docs`` (doc_id, source, text) with size, source_size, target, taken."""
    return Mix(docs, block, shard, seed).taken()


def op10(docs: DataFrame) -> DataFrame:
    return mixed(docs).select("doc_id", "size", "source_size", "target", "taken", "source")


def stage(docs: DataFrame) -> DataFrame:
    """The mix: (shard, position, doc_id, source, begin, end), a row for each document in each slot.

    Documents without words and blocks that weren't drawn have no row; repeated rows have theirs each.
    """
    return Mix(docs).blocks()

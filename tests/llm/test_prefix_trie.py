"""The trie against brute force: whole tables, many shards, many segments, and odd rows."""

import hashlib
import random
import zlib
from collections import defaultdict

import compare
import pytest
from pyspark.sql import functions as F

from tallyworks.llm import prefix_trie
from tallyworks.llm.queries import oracle_sql, queries

SCHEMA = "conv_id long, turn long, role string, text string"


def rebuilt(rows):
    held = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            held[c].append((turn is not None, turn or 0, role or "", hashlib.sha256((text or "").encode()).hexdigest(), text or ""))
    turns = {c: [(x[2], x[4]) for x in sorted(own)] for c, own in held.items()}
    h = {c: zlib.crc32(str(c).encode()) % 6 for c in turns}
    return {c: turns.get(c - c % 100, [])[: h[c]] + own[h[c] :] for c, own in turns.items()}


def brute(rows):
    convs = rebuilt(rows)
    members, kids = defaultdict(list), defaultdict(set)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
            if d:
                kids[tuple(turns[: d - 1])].add(tuple(turns[:d]))
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[k] for k in kids[node]) if kids[node] else 1
        saved[node] = sum(saved[k] for k in kids[node]) + (len(members[node]) - 1) * (len(node[-1][1]) if node else 0)
    out = []
    for node, own in members.items():
        ends = sorted(c for c in own if len(convs[c]) == len(node))
        digest = hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()
        out.append((min(own), len(node), min(members[node[:-1]]) if node else None, len(own), len(kids[node]), leaves[node], saved[node], digest))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_whole_table_against_brute_force(spark, sf):
    df = spark.read.parquet(f"/root/testdata/sf{sf}/conversations.parquet")
    rows = [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]
    out = prefix_trie.op11(df)
    assert out.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert got(out) == brute(rows)


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_whole_table_against_sql(spark, sf):
    d = f"/root/testdata/sf{sf}"
    df = queries()["op11_prefix_trie"](spark, d)
    assert compare.difference(df.collect(), df.columns, compare.connect(d), oracle_sql()["op11_prefix_trie"]) == ""


def made(seed, n, longest, words):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        turns = [rng.choice(words) for _ in range(rng.randint(1, longest))]
        if rng.random() < 0.4 and rows:
            other = rng.choice(rows)[0]
            turns = [r[3] for r in rows if r[0] == other] + ([rng.choice(words)] if rng.random() < 0.3 else [])
        rows += [(c, i, "user", t) for i, t in enumerate(turns)]
    return rows


@pytest.mark.parametrize(("seed", "size", "shard"), [(1, 3, 7), (2, 1, 5), (3, 4, 1), (4, 2, 1000), (5, 32, 20)])
def test_many_shards_and_segments(spark, seed, size, shard):
    rows = made(seed, 130, 9, ["a", "b", "é" * seed])
    random.Random(seed).shuffle(rows)
    assert got(prefix_trie.trie(spark.createDataFrame(rows, SCHEMA), size, shard)) == brute(rows)


def test_one_hot_and_long_conversation(spark):
    rows = [(7, i, "user", str(i % 3)) for i in range(3000)] + [(8, i, "user", str(i % 3)) for i in range(2000)] + [(c, 0, "user", "0") for c in range(100, 160)]
    assert got(prefix_trie.op11(spark.createDataFrame(rows, SCHEMA).repartition(9))) == brute(rows)


def test_equal_conversations_over_many_shards(spark):
    rows = [(c * 1000, i, "user", f"t{i}") for c in range(300) for i in range(3 + c % 2)]
    assert got(prefix_trie.trie(spark.createDataFrame(rows, SCHEMA), 3, 8)) == brute(rows)


def test_defined_cases(spark):
    rows = [(1, None, None, None), (1, 0, "user", "x" * 300_000), (1, 0, "user", "x" * 300_000), (2, 5, "user", ""), (3, 1, "b", "same"), (3, 1, "a", "same"), (100, 1, None, ""), (101, 0, "u", "t"), (250, 0, "u", "t"), (250, 0, None, "t")]
    lost = [(None, 0, "user", "nobody's"), (None, None, None, None)]
    df = spark.createDataFrame(rows + lost, SCHEMA).withColumn("depth", F.lit("clash")).withColumn("k1", F.lit(1)).withColumn("a.b", F.lit(1))
    assert got(prefix_trie.op11(df)) == brute(rows)
    assert prefix_trie.op11(df.limit(0)).count() == 0

"""Fingerprints against a brute-force version, and how likeness follows edits."""

import hashlib
import random
import re
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from tallyworks.llm import order_minhash

SCHEMA = "doc_id long, text string"
LOW = (1 << 30) - 1


def chained(parts):
    seed = 42
    for p in parts:
        raw = p.encode() if isinstance(p, str) else p.to_bytes(4, "little") if 0 <= p < 1 << 20 else (p & (2**64 - 1)).to_bytes(8, "little")
        seed = xxhash.xxh64_intdigest(raw, seed)
    return seed


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0d]{1,16}", text)
    seen, ranked = Counter(), []
    for i in range(len(words)):
        g = chained(words[i - j] for j in range(5) if i >= j) & ~LOW
        h = g if not seen[g] else chained([signed(g), seen[g]]) & ~LOW
        seen[g] += 1
        ranked.append((signed(h), i))
    out = []
    for slot in range(64):
        own = sorted(((h, i) for h, i in ranked if (h >> 58) + 32 == slot))[:2]
        rest = [((h >> 30) & ((1 << 28) - 1)).to_bytes(8, "little") for h, i in sorted(own, key=lambda x: x[1])]
        seed = 42
        for raw in rest:
            seed = xxhash.xxh64_intdigest(raw, seed)
        out.append(seed & 0xFFFF if own else -1)
    return out


def near(a, b):
    filled = [(x, y) for x, y in zip(a, b, strict=True) if x >= 0 or y >= 0]
    return sum(x == y for x, y in filled) / len(filled) if filled else 1.0


def expected(rows):
    keys = sorted({(i is None, -(i or 0), t or "") for i, t in rows})
    following = {keys[k]: keys[(k + 1) % len(keys)] for k in range(len(keys))}
    out = []
    for i, t in rows:
        own = t or ""
        third = len(own) // 3
        after = following[(i is None, -(i or 0), own)][2]
        edited = own[: len(own) - third] + after[:third]
        f, e = brute(own), brute(edited)
        hexed = lambda s: "".join("----" if x < 0 else f"{x:04x}" for x in s)
        out.append((i, len(own), hashlib.sha256(edited.encode()).hexdigest(), hexed(f), hexed(e), round(near(f, e), 9), round(near(f, brute(after)), 9)))
    return sorted(out, key=str)


def got(df):
    return sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in df.collect()), key=str)


def test_whole_table_against_brute_force(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert got(order_minhash.op13(df)) == expected([(r["doc_id"], r["text"]) for r in df.collect()])


@pytest.mark.parametrize("parts", [1, 7])
def test_defined_cases(spark, parts):
    rows = [(5, "a b c d e f g"), (5, "a b c d e f g"), (4, "x"), (3, None), (2, ""), (1, " \t "), (9, "ab " * 30_000), (8, "é" * 100_000), (7, "one two three four five six"), (None, "nobody's text of a few words")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts).withColumn("a", F.lit("clash")).withColumn("need", F.lit(1)).withColumn("x.y", F.lit(2))
    assert got(order_minhash.op13(df)) == expected(rows)
    assert order_minhash.op13(df.limit(0)).count() == 0
    assert got(order_minhash.op13(spark.createDataFrame([(1, "alone with words")], SCHEMA))) == expected([(1, "alone with words")])


def test_order_of_same_id_and_hot_copies(spark):
    rows = [(3, "the same text of one document " * 4)] * 300 + [(i, f"text number {i} of all others here") for i in range(10, 60)]
    assert got(order_minhash.op13(spark.createDataFrame(rows, SCHEMA).repartition(8))) == expected(rows)


def test_likeness_follows_edits_and_order(spark):
    rng = random.Random(4)
    words = [f"w{rng.randrange(10**6)}" for _ in range(2000)]
    few, many = words[:], words[:]
    for k in range(20):
        few[k * 100] = "changed"
    for k in range(200):
        many[k * 10] = "changed"
    moved = words[1000:] + words[:1000]
    texts = [" ".join(x) for x in (words, few, many, moved, [f"v{i}" for i in range(2000)])]
    f = [r[0] for r in spark.createDataFrame(list(enumerate(texts)), SCHEMA).orderBy("doc_id").select(order_minhash.fingerprint(F.col("text"))).collect()]
    same, slight, strong, swapped, other = (near(f[0], x) for x in f)
    assert same == 1.0 and slight > 0.7 and strong < slight - 0.3 and other < 0.05
    assert 0.3 < swapped < 0.85  # the same k-mers but for a few: a set's MinHash would be near 1


def test_no_python_in_the_plan(spark):
    plan = order_minhash.op13(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)

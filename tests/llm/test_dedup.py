import hashlib
import random
import re

import numpy as np
import pytest

from tallyworks.llm import exact_dedup, simhash
from tallyworks.llm import near_copies as near
from tallyworks.llm.near_copies import near_components

SCHEMA = "doc_id long, text string, keep_id string, digest string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "clash", "clash") for i, t in rows], SCHEMA)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 10, 1000, 30_000])
def test_binary_fuse_has_no_false_negative(n):
    rng = np.random.default_rng(n)
    keys = rng.integers(0, 2**64, n, dtype=np.uint64)
    f = exact_dedup.BinaryFuse.from_bytes(exact_dedup.BinaryFuse.build(np.concatenate([keys, keys[: n // 2]])).to_bytes())
    assert f.has(keys).all()
    assert f.has(rng.integers(0, 2**64, 20_000, dtype=np.uint64)).mean() < 0.02


DOCS = [(5, "a  b"), (3, "a\tb"), (9, "a b"), (4, None), (2, ""), (7, "\x0b"), (8, " "), (1, "x" * 200_000), (6, "x" * 200_000), (10, "é  b"), (10, "é  b"), (None, "n")]


def test_exact_dedup_against_brute_force(spark):
    got = sorted((str(r["doc_id"]), r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in exact_dedup.op7(frame(spark, DOCS)).collect())
    norm = [(i, re.sub(r"[\x20\x09-\x0d]+", " ", t or "")) for i, t in DOCS]
    want = []
    for i, t in norm:
        own = [j for j, u in norm if u == t]
        keep = min((j for j in own if j is not None), default=None)
        want.append((str(i), keep, len(own), i == keep, hashlib.sha256(t.encode()).hexdigest()))
    assert got == sorted(want)


@pytest.mark.parametrize("split", ["true", "false", "doc_id % 2 = 0"])
def test_snapshot_makes_no_difference(spark, split):
    from pyspark.sql import functions as F

    rows = [(i, f"text {i % 7}") for i in range(60)]
    got = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in exact_dedup.exact_dedup(frame(spark, rows), F.expr(split)).collect()}
    assert got == {i: (i % 7, len(range(i % 7, 60, 7))) for i in range(60)}


def test_stage_keeps_one_of_each(spark):
    out = exact_dedup.stage(frame(spark, DOCS))
    assert out.columns == ["doc_id", "text", "keep_id", "digest"]
    assert sorted(str(r["doc_id"]) for r in out.collect()) == ["1", "10", "2", "3", "7", "None"]


def test_empty(spark):
    assert exact_dedup.op7(frame(spark, [])).count() == 0
    assert simhash.op8(frame(spark, [])).count() == 0


def brute_components(rows):
    fps = [(i, simhash.fingerprint(t)) for i, t in rows]
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(fps)):
        for b in range(a):
            if (fps[a][1] ^ fps[b][1]).bit_count() <= 2:
                root[max(find(a), find(b))] = min(find(a), find(b))
    low = {}
    for k, (i, _) in enumerate(fps):
        low[find(k)] = min(low.get(find(k), i), i)
    return sorted((i, f"{f:016x}", low[find(k)]) for k, (i, f) in enumerate(fps))


def near_copies(n, seed=0):
    rng, rows = random.Random(seed), []
    for k in range(n):
        own = [rng.choice("abcdefghij") * rng.randint(1, 3) for _ in range(rng.choice([0, 1, 2, 3, 40, 300]))]
        rows.append((2 * k, " ".join(own)))
        if own:
            own[rng.randrange(len(own))] = "changed"
        rows.append((2 * k + 1, "\n".join(own).upper()))
    return [*rows, (1000, None), (1001, "  "), (1002, "Ä b c d"), (1002, "Ä b c d")]


@pytest.mark.parametrize("hot", [simhash.HOT, 3])
def test_components_against_brute_force(spark, hot):
    rows = near_copies(60)
    got = simhash.simhash_components(frame(spark, rows), hot=hot).collect()
    assert sorted((r["doc_id"], f"{r['fp'] % 2**64:016x}", r["component_id"]) for r in got) == brute_components(rows)


def test_fingerprint_bits_against_plain_count():
    import xxhash

    text = "One two  THREE four two three four Ä"
    words = [w.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for w in re.findall(r"[^\x20\x09-\x0d]+", text)]
    hs = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(len(words) - 2)]
    assert simhash.fingerprint(text) == sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def test_trie_join_against_all_pairs():
    rng = np.random.default_rng(1)
    seeds = rng.integers(0, 2**32, 40, dtype=np.uint64)
    leaves = np.unique(np.concatenate([seeds, *(seeds ^ np.uint64(1 << int(b)) for b in rng.integers(0, 32, 12)), seeds ^ np.uint64(6)]).astype(np.uint32))
    a, b = simhash.linked(leaves, np.array([0]), np.array([len(leaves)]))
    got = {tuple(sorted(p)) for p in zip(a.tolist(), b.tolist(), strict=True)}
    assert got == {(i, j) for i in range(len(leaves)) for j in range(i + 1, len(leaves)) if int(leaves[i] ^ leaves[j]).bit_count() <= 2}
    assert len(a) == len(got)


@pytest.mark.parametrize("budget", [0, 3, 40, 128])
def test_wide_trie_join_against_all_pairs(budget):
    rng = np.random.default_rng(budget)
    seeds = rng.integers(0, 2**64, (30, 2), dtype=np.uint64)
    flips = [seeds ^ (np.uint64(1) << rng.integers(0, 64, seeds.shape, dtype=np.uint64)) for _ in range(3)]
    leaves = np.concatenate([seeds, seeds[:7], *flips])
    group = rng.integers(0, 3, len(leaves))
    order = np.lexsort([leaves[:, 1], leaves[:, 0], group])
    leaves, group = leaves[order], group[order]
    edges = np.searchsorted(group, [0, 1, 2])
    a, b = simhash.linked_wide(leaves, edges, np.append(edges[1:], len(group)), budget)
    got = sorted(tuple(sorted(p)) for p in zip(a.tolist(), b.tolist(), strict=True))
    differ = lambda i, j: sum(int(x).bit_count() for x in leaves[i] ^ leaves[j])
    assert got == [(i, j) for i in range(len(leaves)) for j in range(i + 1, len(leaves)) if group[i] == group[j] and differ(i, j) <= budget]


def test_long_chain_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    assert {r["root"] for r in simhash.components(edges).collect()} == {0}


def similarity(a, b):
    one, two = (set(zip(*(t.lower().split()[k:] for k in range(5)), strict=False)) for t in (a, b))
    return len(one & two) / len(one | two)


def test_pipeline_drops_all_near_copies(spark):
    import corpus_pipeline

    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    rows = []
    for k in range(80):
        own = [word() for _ in range(rng.randint(120, 400))]
        for copy in range(3):  # the third has changes of its own in the second's text
            rows.append((10 * k + copy, " ".join(own)))
            for _ in range(len(own) // 60):
                own[rng.randrange(len(own))] = word()
        rows.append((10 * k + 5, " ".join([*own[: len(own) // 2], *(word() for _ in range(len(own) // 2))])))
    text = dict(rows)
    want = set()
    for k in range(80):
        own = [10 * k + c for c in (0, 1, 2, 5)]
        low = {i: i for i in own}
        for a in own:
            for b in own:
                if similarity(text[a], text[b]) >= 0.8:
                    low = {i: min(low[a], low[b]) if r in (low[a], low[b]) else r for i, r in low.items()}
        want |= set(low.values())
    step = next(f for n, f in corpus_pipeline.STAGES if "near" in n)
    out = step(spark, frame(spark, [*rows, (2000, None), (2001, " "), (None, "n")]), None)
    assert len(want) < 200
    assert {r["doc_id"] for r in out.collect()} == {*want, 2000, None}


def cloud(n, seed):
    """Variants of one text, each with changes of its own: about half of their pairs are similar."""
    rng = random.Random(seed)
    base = [f"w{i}" for i in range(150)]
    out = []
    for _ in range(n):
        own = base[:]
        for _ in range(rng.randint(0, 6)):
            own[rng.randrange(150)] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(own))
    return out


@pytest.mark.parametrize("block", [near.BLOCK, 3000])
def test_cloud_of_variants_against_exact_similarity(spark, block):
    texts = cloud(120, 2) + cloud(5, 3)[:1] + ["other words that nobody has here at all"] * 2
    low = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if low[a] != low[b] and similarity(texts[a], texts[b]) >= 0.8:
                low = [min(low[a], low[b]) if x in (low[a], low[b]) else x for x in low]
    got = near_components(frame(spark, list(enumerate(texts))), block).collect()
    assert [x for _, x in sorted((r["doc_id"], r["component_id"]) for r in got)] == low


def test_sets_of_four_and_five_shingles_are_within_the_budget():
    rng = np.random.default_rng(8)
    far = 0
    for _ in range(3000):
        own = rng.integers(0, 2**64, 5, dtype=np.uint64)
        far = max(far, int(np.bitwise_count(near.wide_fingerprint(own) ^ near.wide_fingerprint(own[:4])).sum()))
    assert 96 < far <= near.BUDGET


def test_long_sets_travel_in_pieces(spark):
    words = [f"w{i}" for i in range(5000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:4700])), (3, " ".join(words[2500:])), (4, " ".join(words[::-1]))]
    got = {r["doc_id"]: r["component_id"] for r in near_components(frame(spark, rows)).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4}


def test_recall_of_near_copies_on_a_given_table(spark):
    """Documents whose id is divisible by 20 against all rows, by the exact similarity of their sets."""
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    root = {r["doc_id"]: r["component_id"] for r in near_components(df).collect()}
    sets_ = {r["doc_id"]: near.shingles(r["text"]) for r in df.collect()}
    links = found = 0
    for a in (i for i in sets_ if i % 20 == 0):
        for b in sets_:
            n = len(np.intersect1d(sets_[a], sets_[b], assume_unique=True)) if a != b else 0
            if n * 9 >= (len(sets_[a]) + len(sets_[b])) * 4 and n:
                links += 1
                found += root[a] == root[b]
    assert links and found >= 0.9 * links


def test_bands_links_that_only_others_than_the_smallest_have(spark):
    rng = random.Random(5)
    own = [[f"w{rng.randrange(10**6)}" for _ in range(300)]]
    for k in range(12):  # a chain: neighbours are similar, ends are not
        own.append([f"x{k}_{i}" if 24 * k <= i < 24 * k + 24 else w for i, w in enumerate(own[-1])])
    assert similarity(" ".join(own[0]), " ".join(own[2])) < 0.8 < similarity(" ".join(own[0]), " ".join(own[1]))
    got = near_components(frame(spark, [(k, " ".join(w)) for k, w in enumerate(own)])).collect()
    assert {r["component_id"] for r in got} == {0}


def test_budget_that_keys_cannot_reach_is_refused(spark):
    with pytest.raises(ValueError, match="bits"):
        simhash.links(spark.createDataFrame([(1,), (2,)], "fp long"), budget=3)


def test_one_hot_trie_is_split_until_it_is_not(spark):
    rng = random.Random(12)
    fps = sorted({(0x1234 << 48) | (0xABCD << 32) | sum(1 << b for b in rng.sample(range(32), rng.randint(0, 3))) for _ in range(400)})
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    parent = {f: f for f in signed}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(signed):
        for b in signed[i + 1 :]:
            if (a ^ b).bit_count() <= 2:
                parent[find(b)] = find(a)
    want = {frozenset(f for f in signed if find(f) == r) for r in {find(f) for f in signed}}
    for f in signed:
        parent[f] = f
    for r in simhash.links(df, hot=20).collect():
        assert (r["a"] ^ r["b"]).bit_count() <= 64
        parent[find(r["b"])] = find(r["a"])
    assert {frozenset(f for f in signed if find(f) == r) for r in {find(f) for f in signed}} == want

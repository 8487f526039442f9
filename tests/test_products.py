import random

import pytest

from tallyworks.operators import products


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_likeness_against_plain_lcs():
    rng = random.Random(2)
    for _ in range(300):
        a, b = ("".join(rng.choice("abc ") for _ in range(rng.randint(0, 80))) for _ in range(2))
        sa, sb = " ".join(sorted(a.split())), " ".join(sorted(b.split()))
        want = 100.0 if not sa and not sb else 200.0 * lcs(sa, sb) / (len(sa) + len(sb))
        assert products.likeness(a, b) == pytest.approx(want)


def test_matching(spark):
    aliases = spark.createDataFrame([("Dune", "Armstrong Dune", 0), ("Armstrong Dune", "Armstrong Dune", 0), ("Suprafine", "Armstrong Suprafine", 1), ("dune", "Other Dune", -1)], "alias string, canonical string, position int")
    names = spark.createDataFrame([("dune",), ("SUPRAFINE",), ("Armstrng Dune",), ("Completely Unknown Product XYZ",), ("",), ("   ",), (None,), ("dune",)], "name string")
    got = {r["name"]: (r["canonical"], r["score"]) for r in products.match(names, aliases).collect()}
    assert got.pop("Armstrng Dune")[0] == "Armstrong Dune"
    assert got == {"dune": ("Armstrong Dune", 1.0), "SUPRAFINE": ("Armstrong Suprafine", 1.0), "Completely Unknown Product XYZ": (None, None)}


def test_segments(spark):
    names = spark.createDataFrame([("Dune on Suprafine",), ("dune ON suprafine",), ("Dune, 2x2, Suprafine grid",)], "name string")
    assert [(r["primary"], r["secondary"]) for r in products.segments(names).collect()] == [("Dune", "Suprafine"), ("dune", "suprafine"), ("Dune, 2x2, Suprafine grid", None)]


def test_no_like_alias_is_missed(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abc ") for _ in range(rng.randint(1, 12)))
    names, aliases = sorted({word() for _ in range(120)}), sorted({word().strip() or "a" for _ in range(60)})
    rows = [(a, a, k) for k, a in enumerate(aliases)]
    got = {r["name"]: r["score"] for r in products.match(spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame(rows, "alias string, canonical string, position int")).collect()}
    for n in names:
        if not n.strip():
            assert n not in got
            continue
        best = 100.0 if n.strip() in aliases else max(products.likeness(n, a) for a in aliases)
        assert got[n] == (pytest.approx(best / 100, abs=1e-4) if best >= 75 else None)


def catalogue(n, seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("aaeeiioubcdfghklmnprstw") for _ in range(rng.randint(3, 9))) for _ in range(800)]
    return sorted({" ".join(rng.sample(words, 3)) for _ in range(n)})


def test_candidates_of_a_catalogue_are_few_and_whole(spark):
    rng = random.Random(9)
    aliases = catalogue(1500, 1)
    names = []
    for a in aliases[:120]:
        b = list(a)
        for _ in range(2):
            b[rng.randrange(len(b))] = rng.choice("xyz")
        names.append(" ".join(sorted("".join(b).split())))
    frame = lambda texts: spark.createDataFrame([(t,) for t in texts], "text string")
    sorted_aliases = sorted({" ".join(sorted(a.split())) for a in aliases})
    got = {(r["a"], r["b"]) for r in products.candidates(frame(names), frame(sorted_aliases)).collect()}
    like = {(a, b) for a in names for b in sorted_aliases if min(len(a), len(b)) * 8 >= 3 * (len(a) + len(b)) and products.likeness(a, b) >= products.LEAST}
    assert like and like <= got
    assert len(got) <= 36 * len(set(names))


def test_candidates_of_the_given_names(spark):
    part = spark.read.parquet("/root/testdata/sf0.1/part.parquet").selectExpr("p_name AS name").distinct()
    spelt = part.selectExpr("explode(array(upper(name), name || 'x', reverse(name), 'zq ' || name || ' yw')) AS text")
    sorted_words = lambda df, c: df.select(products._sorted_words(df[c]).alias("text"))
    n = products.candidates(sorted_words(spelt, "text"), sorted_words(part, "name")).count()
    assert n <= 8 * spelt.distinct().count()

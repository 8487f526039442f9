"""Product names: exact aliases first, then the closest by sorted words."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranges import kept

#: Least score of a match by likeness.
LEAST = 75.0


def likeness(a: str, b: str) -> float:
    """100 * 2 * LCS / (length of both) of the texts with their words sorted; case counts."""
    a, b = " ".join(sorted(a.split())), " ".join(sorted(b.split()))
    if not a and not b:
        return 100.0
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    free = every = (1 << len(a)) - 1  # bit-parallel LCS: zero bits of free are matched
    for c in b:
        hit = free & places.get(c, 0)
        free = ((free + hit) | (free - hit)) & every
    return 200.0 * (len(a) - free.bit_count()) / (len(a) + len(b))


def segments(names: DataFrame) -> DataFrame:
    """(name, primary, secondary): split at the first `` on ``, in any case."""
    parts = F.split("name", "(?i) on ", 2)
    return names.select("name", F.trim(parts[0]).alias("primary"), F.when(F.size(parts) > 1, F.trim(F.try_element_at(parts, F.lit(2)))).alias("secondary"))


def _sorted_words(text: Column) -> Column:
    return F.array_join(F.array_sort(F.filter(F.split(text, r"\s+"), lambda w: w != "")), " ")


#: Ratio of the ends of a band of lengths.
BAND = 1.25


def _common(n: Column, m: Column) -> Column:
    """Least length of the common subsequence of texts of n and m characters that are alike enough."""
    return F.ceil((n + m) * LEAST / 200.0).cast("int")


def _band(n: Column) -> Column:
    return F.floor(F.log(n.cast("double")) / math.log(BAND) + 1e-9).cast("int")


def _numbered(parts: Column) -> Column:
    """A bag as a set: each part with its number among equal ones."""
    return F.flatten(F.transform(F.array_distinct(parts), lambda c: F.transform(F.sequence(F.lit(1), F.size(F.filter(parts, lambda x: x == c))), lambda k: F.concat(c, F.lit("\0"), k.cast("string")))))


def _runs(text: Column, q: int) -> Column:
    """Runs of q characters, as a bag."""
    return F.when(F.length(text) >= q, F.transform(F.sequence(F.lit(1), F.length(text) - q + 1), lambda i: text.substr(i, F.lit(q)))).otherwise(F.array().cast("array<string>"))


def _ranked(texts: DataFrame, common: DataFrame) -> DataFrame:
    """(text) with ``tokens``: its numbered characters, rarest first by ``common`` (token, df); those it hasn't got are rarest."""
    each = texts.select("text", F.explode(_numbered(_runs(F.col("text"), 1))).alias("token")).join(common, "token", "left")
    return each.groupBy("text").agg(F.transform(F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "token"))), lambda x: x["token"]).alias("tokens"))


def _prefix_keys(ranked: DataFrame, first: bool) -> DataFrame:
    """(text, key): for each band of lengths that a like text can have, each two of the rarest tokens that must hold two of the common ones."""
    n = F.length("text")
    bands = F.sequence(_band(F.greatest(F.ceil(n * LEAST / (200.0 - LEAST)), F.lit(1))), _band(F.greatest(F.floor(n * (200.0 - LEAST) / LEAST), F.lit(1))))
    rows = ranked.select("text", "tokens", n.alias("n"), F.explode(bands).alias("other"))
    least = F.greatest(F.ceil(F.pow(F.lit(BAND), F.col("other")) - 1e-9).cast("int"), F.lit(1))
    rows = rows.withColumn("p", F.least(F.col("n"), F.col("n") - _common(F.col("n"), least) + 2))
    rows = rows.filter("p >= 2").withColumn("head", F.slice("tokens", 1, F.col("p")))
    two = F.flatten(F.transform("head", lambda x, i: F.transform(F.slice("head", i + 2, F.size("head")), lambda y: F.struct(x.alias("x"), y.alias("y")))))
    pair = (_band(F.col("n")), F.col("other")) if first else (F.col("other"), _band(F.col("n")))
    return rows.select("text", *[c.alias(k) for c, k in zip(pair, ("band_a", "band_b"), strict=True)], F.explode(two).alias("t")).select("text", F.xxhash64("band_a", "band_b", "t.x", "t.y").alias("key"))


def candidates(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs (a, b) of distinct non-empty texts (column text of each) that pass all counts which like texts must pass.

    A prefix-filter join.  Where 2 LCS / (n + m) reaches the threshold, the texts have LCS characters in
    common as bags.  Characters of each text are ordered by rarity; two of the common ones are then among the
    first n - LCS + 2 of the one and the first m - LCS + 2 of the other, so two rare characters and the bands
    of both lengths are the key.  (One character in common, as texts of length 1 have it, is equality.)
    Then lengths, bags of characters, and bags of two characters in a row are counted: a subsequence is broken
    at n + m - 2 LCS places at most, so all but as many of its LCS - 1 neighbours stand together in both texts.
    """
    left, right = (x.select("text").filter("text <> ''").distinct() for x in (left, right))
    common = right.select(F.explode(_numbered(_runs(F.col("text"), 1))).alias("token")).groupBy("token").agg(F.count("*").alias("df"))
    keys = _prefix_keys(_ranked(left, common), True).withColumnRenamed("text", "a")
    pairs = keys.join(_prefix_keys(_ranked(right, common), False).withColumnRenamed("text", "b"), "key").select("a", "b").distinct()
    n, m = F.length("a"), F.length("b")
    bag = lambda q: F.size(F.array_intersect(_numbered(_runs(F.col("a"), q)), _numbered(_runs(F.col("b"), q))))
    pairs = pairs.filter(F.least(n, m) >= _common(n, m)).filter(bag(1) >= _common(n, m)).filter(bag(2) >= 3 * _common(n, m) - n - m - 1)
    same = left.join(right, "text", "left_semi").select(F.col("text").alias("a"), F.col("text").alias("b"))
    return pairs.unionByName(same).distinct()


def match(names: DataFrame, aliases: DataFrame) -> DataFrame:
    """(name, canonical, score) of each distinct non-blank name; aliases are (alias, canonical, position), a later position wins a repeated alias.

    Exact aliases count 1.0.  The rest is scored against the aliases that ``candidates`` leaves, which loses none.
    """
    known = kept(aliases.groupBy(F.lower("alias").alias("key")).agg(F.max_by("canonical", "position").alias("canonical"), F.max_by("alias", "position").alias("alias"), F.max("position").alias("position")), "aliases")
    own = kept(names.select("name").filter(F.trim("name") != "").distinct(), "names")
    exact = own.join(known, F.lower(F.trim("name")) == F.col("key")).select("name", "canonical", F.lit(1.0).alias("score"))
    rest = own.join(exact.select("name"), "name", "left_anti").withColumn("a", _sorted_words(F.col("name")))
    table = known.select("alias", "canonical", "position", _sorted_words(F.col("alias")).alias("b"))
    pairs = candidates(rest.select(F.col("a").alias("text")), table.select(F.col("b").alias("text")))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [likeness(a, b) for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64())], ["a", "b", "score"])

    found = pairs.mapInArrow(scored, "a string, b string, score double").filter(F.col("score") >= LEAST)
    best = found.join(table, "b").groupBy("a").agg(F.min_by(F.struct("canonical", "score"), F.struct(-F.col("score"), "position", "alias")).alias("x"))
    out = rest.join(best, "a", "left").select("name", "x.canonical", F.round(F.col("x.score") / 100, 4).alias("score"))
    return exact.unionByName(out)


def match_rate(links: DataFrame) -> DataFrame:
    """Names, those linked to a product, and their share in percent (from ``linked``)."""
    return links.agg(F.count("*").alias("names"), F.count("product").alias("linked"), F.round(F.count("product") * 100.0 / F.count("*"), 1).alias("pct"))


def linked(names: DataFrame, aliases: DataFrame, least: float = LEAST / 100) -> DataFrame:
    """Each distinct name with the product that its first or else second part matches, or the reason for a review: no match, or below the threshold."""
    parts = segments(kept(names.distinct(), "names"))
    found = kept(match(parts.select(F.col("primary").alias("name")).union(parts.select("secondary")).filter("name is not null"), aliases), "matched")
    for part in ("primary", "secondary"):
        parts = parts.join(found.select(F.col("name").alias(part), F.col("canonical").alias(f"{part}_to"), F.col("score").alias(f"{part}_score")), part, "left")
    product = F.when(F.col("primary_score") >= least, F.col("primary_to")).when(F.col("secondary_score") >= least, F.col("secondary_to"))
    none = F.col("primary_score").isNull() & F.col("secondary_score").isNull()
    return parts.select("name", product.alias("product"), F.when(product.isNull(), F.when(none, "no match").otherwise("below threshold")).alias("review"))

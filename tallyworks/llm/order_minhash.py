"""Order MinHash fingerprints of documents, by built-in functions only.

A text's tokens are its words; what stands without a blank for more than PIECE code points is cut into
pieces of that many.  A token and the K - 1 before it are a k-mer (the first ones of a text are
shorter), and the k-mers of a text that are equal are numbered in text order.  The hash of a k-mer and
its number ranks it and deals it to one of SLOTS slots.  A slot selects its LEAST minimal k-mers, keeps
them in the order in which they stand in the text, and hashes that tuple.  So a slot is alike in two
texts if they share its minimal k-mers in the same order, which an edit changes for the k-mers that it
touches or reorders.  (Slots share one ranking of all k-mers, each k-mer in one of them, so a text is
ranked once whatever the number of slots.)  The likeness of two fingerprints is the share of equal ones
among the slots that either has filled.

The next document is looked up by a sorted list of (doc_id, hash of text): each row of that list says
which document needs how many of its code points.  Texts are shuffled by key once for that.

Defined cases: null text is empty; an empty or blank text has no k-mer and no filled slot, and two such
fingerprints have likeness 1, one such and another 0; rows of one doc_id are ordered by two hashes of their
text, and rows of the same doc_id and text are one document in that order, each with its row; a null
doc_id comes last; a single document is its own next one; an empty table gives an empty result; very
long texts are whole; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BLANK, written

#: Tokens of a k-mer.
K = 5
#: Slots of a fingerprint; a power of two.
SLOTS = 64
#: Minimal k-mers of a slot.
LEAST = 2
#: Code points of a token at most.
PIECE = 16
#: Part of a text's code points that the edit replaces: one third.
PART = 3

#: The low bits of a ranked k-mer hold its place: a text has fewer tokens than its 2^31 bytes.
_PLACE = 30
_LOW = (1 << _PLACE) - 1


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _high(x: Column) -> Column:
    return x.bitwiseAND(F.lit(~_LOW))


def _bits(slots: int) -> int:
    return slots.bit_length() - 1


def _slot(x: Column, slots: int) -> Column:
    """0, 1, ... in the order of signed numbers."""
    return F.shiftright(x, 64 - _bits(slots)) + slots // 2


def tokens(text: Column, piece: int = PIECE) -> Column:
    return F.regexp_extract_all(text, F.lit(f"[^{BLANK}]{{1,{piece}}}"), F.lit(0))


def kmers(words: Column, k: int = K) -> Column:
    """Array of longs: the high bits are a k-mer's hash, the low ones its place."""
    # a null is no part of a hash, so the k-mers at the beginning are of fewer tokens
    return F.transform(words, lambda w, i: _high(F.xxhash64(w, *(F.get(words, i - j) for j in range(1, k)))).bitwiseOR(i.cast("long")))


def ranked(found: Column) -> Column:
    """Hashes of (k-mer, number) and places, smallest first; the first of equal k-mers keeps its own hash."""

    def renumbered(s: Column) -> Column:
        n = F.size(s)
        starts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (_high(F.get(s, i)) != _high(F.get(s, i - 1))))
        numbers = _let(starts, lambda a: F.flatten(F.transform(a, lambda x, j: F.sequence(F.lit(0), F.coalesce(F.get(a, j + 1), n) - x - 1))))
        return F.zip_with(s, numbers, lambda x, number: F.when(number == 0, x).otherwise(_high(F.xxhash64(_high(x), number)).bitwiseOR(x.bitwiseAND(F.lit(_LOW)))))

    unlike = F.size(F.array_distinct(F.transform(found, _high))) == F.size(found)
    return F.sort_array(F.when(unlike, found).otherwise(_let(F.sort_array(found), renumbered)))


def selected(order: Column, slots: int = SLOTS, least: int = LEAST) -> Column:
    """The least ones of each slot, by slot."""
    return F.filter(order, lambda x, i: (i < least) | (_slot(F.get(order, i - least), slots) != _slot(x, slots)))


def signature(chosen: Column, slots: int = SLOTS, least: int = LEAST) -> Column:
    """Array of SLOTS numbers: 16 bits of the hash of a slot's tuple, -1 where the slot is empty."""
    rest = 64 - _bits(slots) - _PLACE  # bits of the hash beside the slot's
    by_place = lambda x: F.shiftleft(F.shiftright(x, 64 - _bits(slots)), 64 - _bits(slots)).bitwiseOR(F.shiftleft(x.bitwiseAND(F.lit(_LOW)), rest)).bitwiseOR(F.shiftright(x, _PLACE).bitwiseAND(F.lit((1 << rest) - 1)))

    def tuples(r: Column) -> Column:
        first = F.filter(F.sequence(F.lit(0), F.size(r) - 1), lambda i: (i == 0) | (_slot(F.get(r, i), slots) != _slot(F.get(r, i - 1), slots)))
        own = lambda i, j: F.when(_slot(F.get(r, i + j), slots) == _slot(F.get(r, i), slots), F.get(r, i + j).bitwiseAND(F.lit((1 << rest) - 1)))
        return F.transform(first, lambda i: F.struct(_slot(F.get(r, i), slots).alias("slot"), F.xxhash64(*(own(i, j) for j in range(least))).bitwiseAND(F.lit(0xFFFF)).cast("int").alias("h")))

    def dense(t: Column) -> Column:
        empty = lambda a, b: F.array_repeat(F.lit(-1), (b - a - 1).cast("int"))
        order = F.flatten(F.transform(t, lambda x, j: F.concat(empty(F.coalesce(F.get(t, j - 1)["slot"], F.lit(-1)), x["slot"]), F.array(x["h"]))))
        return _let(order, lambda o: F.concat(o, F.array_repeat(F.lit(-1), F.lit(slots) - F.size(o))))

    return _let(_let(F.sort_array(F.transform(chosen, by_place)), tuples), dense)


def fingerprint(text: Column, k: int = K, slots: int = SLOTS, least: int = LEAST, piece: int = PIECE) -> Column:
    """The fingerprint of a text, as an array of SLOTS numbers."""
    return _let(tokens(text, piece), lambda w: _let(kmers(w, k), lambda g: F.when(F.size(g) == 0, F.array_repeat(F.lit(-1), slots)).otherwise(_let(ranked(g), lambda o: _let(selected(o, slots, least), lambda c: signature(c, slots, least))))))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal slots among those filled in either fingerprint; 1 where neither has any."""
    equal = F.size(F.filter(F.zip_with(a, b, lambda x, y: (x == y) & (x >= 0)), lambda x: x))
    filled = F.size(F.filter(F.zip_with(a, b, lambda x, y: (x >= 0) | (y >= 0)), lambda x: x))
    return F.when(filled == 0, F.lit(1.0)).otherwise(equal / F.greatest(filled, F.lit(1)).cast("double"))


def written_out(f: Column) -> Column:
    """Four hex digits a slot, or four dashes."""
    return F.array_join(F.transform(f, lambda x: F.when(x < 0, F.lit("----")).otherwise(F.lower(F.lpad(F.hex(x), 4, "0")))), "")


def followed(rows: DataFrame) -> tuple[DataFrame, bool]:
    """(id, a, b, need, next_id, next_a, next_b): each document's key, a third of its code points, and the key of the next one in descending doc_id; and whether a document has several rows."""
    order = [F.col("doc_id").desc_nulls_last(), "a", "b"]
    each = rows.groupBy("doc_id", "a", "b").agg(F.first("n_chars").alias("n_chars"), F.count("*").alias("copies"))
    dealt = written(each.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "order")
    part = F.shiftright("at", 33)
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    counts = dealt.groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.max("copies").alias("copies"))
    counts = written(counts.withColumn("first", F.coalesce(F.sum("n").over(ahead), F.lit(0).cast("long"))), "ranges")
    total, copies = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("copies"), F.lit(0))).first()
    ranks = dealt.join(F.broadcast(counts.select("part", "first")), part == F.col("part")).withColumn("rank", F.col("first") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)))
    ranks = written(ranks.select("rank", F.col("doc_id").alias("id"), "a", "b", F.expr(f"n_chars div {PART}").alias("need")), "ranks")
    after = ranks.select(F.pmod(F.col("rank") - 1, F.lit(max(total, 1))).alias("rank"), *[F.col(c).alias(f"next_{c}") for c in ("id", "a", "b")])
    return written(ranks.join(after, "rank").drop("rank"), "next"), copies > 1


def _same(x: DataFrame, y: DataFrame, *pairs: tuple[str, str]) -> Column:
    return F.expr("true") if not pairs else x[pairs[0][0]].eqNullSafe(y[pairs[0][1]]) & _same(x, y, *pairs[1:])


def fingerprinted(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of each row; fingerprints as arrays."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    rows = rows.withColumns({"a": F.xxhash64("text", "doc_id"), "b": F.xxhash64(F.lit(13), "doc_id", "text")})
    order, several = followed(rows.select("doc_id", "a", "b", F.char_length("text").cast("long").alias("n_chars")))
    single = (lambda df, *key: df.dropDuplicates(list(key))) if several else (lambda df, *key: df)
    # Both joins have the same key and columns on this side, so one shuffle of the texts serves both.
    found = rows.join(order, _same(rows, order, ("doc_id", "next_id"), ("a", "next_a"), ("b", "next_b")))
    heads = single(found.select("id", order["a"].alias("own_a"), order["b"].alias("own_b"), F.substring("text", 1, F.col("need").cast("int")).alias("head")), "own_a", "own_b")
    both = rows.join(heads, _same(rows, heads, ("doc_id", "id"), ("a", "own_a"), ("b", "own_b")))
    n = F.char_length("text")
    edited = F.concat(F.substring("text", 1, n - F.expr(f"char_length(text) div {PART}").cast("int")), "head")
    both = both.select("doc_id", "a", "b", n.cast("long").alias("n_chars"), "text", edited.alias("edited"))
    print_ = [F.sha2("edited", 256).alias("edited_sha256"), fingerprint(F.col("text")).alias("fingerprint"), fingerprint(F.col("edited")).alias("edited_fingerprint")]
    held = written(both.select("doc_id", "a", "b", "n_chars", *print_), "fingerprints")
    theirs = single(held.select(F.col("a").alias("next_a"), F.col("b").alias("next_b"), F.col("fingerprint").alias("theirs")), "next_a", "next_b")
    following = order.select("a", "b", "next_a", "next_b").join(theirs, ["next_a", "next_b"]).drop("next_a", "next_b")
    out = held.join(following, ["a", "b"])
    near = [likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("theirs")).alias("near_next")]
    return out.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", *near)


def op13(docs: DataFrame) -> DataFrame:
    out = fingerprinted(docs)
    return out.select("doc_id", "n_chars", "edited_sha256", written_out(F.col("fingerprint")).alias("fingerprint"), written_out(F.col("edited_fingerprint")).alias("edited_fingerprint"), "near_edited", "near_next")

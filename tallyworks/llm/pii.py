"""Personal data by bootstrapped contextual extraction, with built-in functions only.

Base entities of four kinds (email, ip, card, phone) are found by pattern and test.  They and secrets of
a strict form (long lower-case hex) are the seeds of a bootstrap: the words before an entity, since the
match before it, are its lexical pattern (the last one, and the last two), and looser candidates, such as
an address without a dotted domain, a number that fails its check digit or any long run of letters and
digits, are instances that a pattern may also precede.  Patterns and instances are a graph whose edges
are counted before they are shuffled.  Each round scores a pattern by the share of its distinct
instances of a kind that are trusted, and trusts instances that a pattern of high score precedes; trusted
instances then speak for further patterns.  Spans of trusted instances are added to the base ones: what
the bootstrap discovered, and the secrets it started from, which no base kind has.

A pattern needs SEEDS distinct trusted instances and a share of CONFIDENCE; both are bounds on evidence,
not on data.  Patterns are joined by shuffle, so no table of them is collected; edges of one pattern
are one row an instance, however often both occur.

Every expression starts only where the one before it ended or where no character of its own kind
precedes, and is possessive, so a run of any length is read once; matches are those of the plain
leftmost patterns.  A row's matches become rows and their places are running sums, so the work grows
with a text's length and its matches.

Defined cases: null text is empty and has no spans; an empty text gives the digest of an empty list;
repeated rows are found apart; positions count code points; very long texts are read whole; other
columns, whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

# Kinds in order (the first four have base entities), and their expressions (Java).
KINDS = ["email", "ip", "card", "phone", "secret"]
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9]){11,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
STRICT_SECRET = r"(?<![A-Za-z0-9])(?=[a-f]*+[0-9])(?=[0-9]*+[a-f])[0-9a-f]{32,64}+(?![A-Za-z0-9])"
LOOSE = {
    "email": r"(?<![^\x20\x09-\x0D])[A-Za-z0-9._%+-]++(?:@|\x20?[\[(](?:at|AT)[\])]\x20?)[A-Za-z0-9-]++(?![A-Za-z0-9.@-])",
    "ip": r"(?<![0-9A-Fa-f:.])(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{0,4}){3,7}|[0-9]{1,4}(?:\.[0-9]{1,4}){3})(?![0-9A-Fa-f:.])",
    "card": r"(?<![0-9+.-])[0-9]{4}(?:[\x20-]?[0-9]{4}){2}[\x20-]?[0-9]{1,7}(?![0-9.-])",
    "phone": r"(?<![0-9+.-])(?:\([0-9]{2,5}\)|0[0-9]{1,4}|[0-9]{3})[\x20-][0-9]{3,4}[\x20-]?[0-9]{3,5}(?![0-9.-])",
    "secret": r"(?<![A-Za-z0-9_+/-])(?=[A-Za-z_+/-]*+[0-9])(?=[0-9_+/-]*+[A-Za-z])[A-Za-z0-9_+/-]{12,}+(?![A-Za-z0-9_+/@-])",
}
#: What a text must contain, cheap to see, before the expressions of a kind are tried.
NEEDED = {"email": "@", "ip": ".", "phone": "+"}
#: Distinct trusted instances that a pattern needs, the share of its instances they must be.
SEEDS, CONFIDENCE = 3, 0.8


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _luhn(s: Column) -> Column:
    """The check digit holds: every second digit from the right doubled, 9 taken from what is over 9."""
    plain = F.reverse(_digits(s))
    total = F.aggregate(
        F.sequence(F.lit(1), F.length(plain)),
        F.lit(0),
        lambda acc, i: acc + F.when(i % 2 == 1, F.substr(plain, i, F.lit(1)).cast("int")).otherwise(F.substr(plain, i, F.lit(1)).cast("int") * 2 - F.when(F.substr(plain, i, F.lit(1)).cast("int") > 4, 9).otherwise(0)),
    )
    return total % 10 == 0


def _holds(kind: str, s: Column) -> Column:
    """The test that a match of a base expression must pass."""
    n = F.length(_digits(s))
    if kind == "ip":  # parts of any length: over 255 unless leading zeros make it less
        return F.forall(F.split(s, r"\."), lambda p: F.length(F.regexp_replace(p, "^0+", "")).between(0, 3) & (F.coalesce(F.regexp_replace(p, "^0+(?=[0-9])", "").try_cast("int"), F.lit(999)) <= 255))
    if kind == "card":
        return F.when(n.between(12, 19), _luhn(s)).otherwise(False)
    if kind == "phone":
        return n.between(9, 15)
    return F.lit(True)


def _found(kind: str, regex: str, text: Column, base: bool, guard: Column) -> Column:
    """Array of a row's matches of one expression in order: (kind, base, gap, size, v, words, sound).

    Matches and what lies between them take turns; ``gap`` is how many code points lie before a match
    since the one before it, ``words`` what is last of them.  A match that isn't sound keeps its turn.
    """
    between = F.split(text, regex, -1)
    values = F.regexp_extract_all(text, F.lit(regex), F.lit(0))

    def step(gap: Column, v: Column) -> Column:
        said = F.trim(F.regexp_replace(F.lower(gap), r"[^\p{L}:=#]+", " "))
        return F.struct(
            F.lit(KINDS.index(kind)).alias("kind"),
            F.lit(base).alias("base"),
            F.char_length(gap).cast("long").alias("gap"),
            F.char_length(v).cast("long").alias("size"),
            F.lower(v).alias("v"),
            F.substring_index(said, " ", -2).alias("words"),
            (_holds(kind, v) if base else F.lit(True)).alias("sound"),
        )

    rows = F.zip_with(F.slice(between, 1, F.greatest(F.size(between) - 1, F.lit(0))), values, step)
    return F.when(guard, rows).otherwise(F.array().cast("array<struct<kind:int,base:boolean,gap:bigint,size:bigint,v:string,words:string,sound:boolean>>"))


def matches(docs: DataFrame) -> DataFrame:
    """(row, doc_id, found): each row's matches of every expression; row tells rows apart."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("t"))
    has_digit = F.col("t").rlike("[0-9]")
    found = []
    for kind in KINDS:
        guard = F.contains(F.col("t"), F.lit(NEEDED[kind])) if kind in NEEDED else has_digit
        found.append(_found(kind, BASE.get(kind, STRICT_SECRET), F.col("t"), True, guard & (has_digit if kind != "email" else F.lit(True))))
        found.append(_found(kind, LOOSE[kind], F.col("t"), False, F.col("t").rlike("@|[\\[(](?:at|AT)[\\])]") if kind == "email" else has_digit))
    return rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.concat(*found).alias("found"))


def placed(found: DataFrame) -> DataFrame:
    """(row, kind, base, start, end, v, words) of sound matches, without loose ones that touch a strict one."""
    rows = found.filter(F.size("found") > 0).select("row", F.posexplode("found").alias("at", "x")).select("row", "at", "x.*")
    so_far = Window.partitionBy("row", "kind", "base").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(so_far)).withColumn("start", F.col("end") - F.col("size")).filter("sound")
    order = Window.partitionBy("row").orderBy("start", F.col("base").desc(), "end", "kind")
    back = Window.partitionBy("row").orderBy(F.col("start").desc(), "base", F.col("end").desc(), F.col("kind").desc())  # a frame that only grows, unlike one that shrinks
    before, after = (w.rowsBetween(Window.unboundedPreceding, -1) for w in (order, back))
    rows = rows.withColumn("reach", F.max(F.when(F.col("base"), F.col("end"))).over(before)).withColumn("next", F.min(F.when(F.col("base"), F.col("start"))).over(after))
    free = (F.coalesce("reach", F.lit(0)) <= F.col("start")) & (F.coalesce(F.col("next") >= F.col("end"), F.lit(True)))
    return rows.filter(F.col("base") | free).select("row", "kind", "base", "start", "end", "v", "words")


def bootstrap(spans: DataFrame) -> DataFrame:
    """(kind, v): instances that the seeds and the rounds came to trust.

    An edge joins a pattern and an instance of a kind, once; seed says that the instance is a seed.
    """
    words = F.split("words", " ")
    patterns = F.array_distinct(F.array_compact(F.array(F.when(F.size(words) == 2, F.col("words")), F.nullif(F.element_at(words, -1), F.lit("")))))
    edges = written(spans.select("kind", "v", F.explode(patterns).alias("pattern"), F.col("base").cast("int").alias("seed")).groupBy("kind", "pattern", "v").agg(F.max("seed").alias("seed")), "edges")
    trusted = written(spans.filter("base").select("kind", "v").distinct(), "trusted")
    while True:  # trusted only grows, so it ends
        known = edges.join(trusted.withColumn("on", F.lit(1)), ["kind", "v"], "left").withColumn("on", F.coalesce("on", F.lit(0)))
        score = known.groupBy("kind", "pattern").agg(F.sum("on").alias("n"), F.avg("on").alias("share")).filter((F.col("n") >= SEEDS) & (F.col("share") >= CONFIDENCE)).select("kind", "pattern")
        fresh = edges.join(score, ["kind", "pattern"], "left_semi").select("kind", "v").distinct().join(trusted, ["kind", "v"], "left_anti")
        fresh = written(fresh, "fresh")
        if fresh.isEmpty():
            return trusted
        trusted = written(trusted.unionByName(fresh), "trusted")


def personal_data(docs: DataFrame) -> DataFrame:
    """(doc_id, base, spans) of each row; arrays of (start, kind, end), sorted, spans holding base."""
    found = written(matches(docs), "found")
    spans = written(placed(found), "spans")
    loose = spans.filter("not base").join(bootstrap(spans), ["kind", "v"], "left_semi")
    every = spans.filter("base").unionByName(loose.select(*spans.columns))
    own = (F.col("base") & (F.col("kind") < len(BASE))).alias("own")
    span = F.struct("start", "kind", "end")
    held = every.groupBy("row").agg(F.array_sort(F.collect_set(F.when(own, span))).alias("base"), F.array_sort(F.collect_set(span)).alias("spans"))
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    full = found.filter(F.size("found") > 0).select("row", "doc_id").join(held, "row", "left").select("doc_id", F.coalesce("base", none).alias("base"), F.coalesce("spans", none).alias("spans"))
    return full.unionByName(found.filter(F.size("found") == 0).select("doc_id", none.alias("base"), none.alias("spans")))


def _listed(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def op3(docs: DataFrame) -> DataFrame:
    """Counts of the base spans by kind and their digest, and all spans listed; ``n_added`` are those that no base expression has."""
    out = personal_data(docs)
    kinds = F.transform("base", lambda x: x["kind"])
    counts = [(F.size("base") - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{name}") for k, name in enumerate(BASE)]
    added = (F.size("spans") - F.size("base")).cast("long").alias("n_added")
    return out.select("doc_id", *counts, F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"), added)

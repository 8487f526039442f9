"""Token counts by an exact length histogram.

Documents are encoded by a public byte-level BPE vocabulary and only their lengths are kept.  The
histogram (length, documents) is exact; suffix sums over it answer, for any context limit, how many
documents are longer, how many tokens there are in all and after truncation, and any quantile, with no
second pass over the texts.  Suffix sums are two-level (bands of lengths, then inside a band), so no
task holds the whole histogram.

A text's length is the sum over its pieces, as the vocabulary's splitting pattern cuts them, and pieces
repeat: each task keeps the counts of pieces it has met (CACHE at most, then it starts anew).

Defined cases: null and empty texts have length 0 and are counted; repeated rows count each; very
long texts are encoded whole; an empty table gives an empty histogram; limits below 0 are refused.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Ranks of the default vocabulary; any file of the same format will do.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How the default vocabulary's texts are cut into pieces before merging: the published pattern of its kind.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces that a task remembers.
CACHE = 300_000
#: Lengths of a band of the suffix sums.
BAND = 256


class Counter(dict):
    """Number of tokens of each piece, encoded when first met."""

    def __init__(self, vocabulary: str):
        import regex
        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encode = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.cut = regex.compile(PATTERN).findall

    def __missing__(self, piece: str) -> int:
        self[piece] = n = len(self.encode(piece))
        return n

    def length(self, text: str | None) -> int:
        return sum(map(self.__getitem__, self.cut(text))) if text else 0


def lengths(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, length) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = Counter(vocabulary)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                got = [count.length(t) for t in part.column(1).to_pylist()]
                if len(count) > CACHE:
                    count.clear()
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(got, pa.int64())], ["doc_id", "length"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, length long")


def histogram(lengths_: DataFrame) -> DataFrame:
    """(length, docs): exact."""
    return lengths_.groupBy("length").agg(F.count("*").alias("docs"))


def suffix_sums(hist: DataFrame) -> DataFrame:
    """(length, docs, docs_below, docs_from, tokens_below, tokens_from): sums below a length and from it on."""
    rows = hist.withColumn("band", F.floor(F.col("length") / BAND)).withColumn("tokens", F.col("docs") * F.col("length"))
    bands = rows.groupBy("band").agg(F.sum("docs").alias("docs_"), F.sum("tokens").alias("tokens_"))
    zero = F.lit(0).cast("long")
    before = Window.orderBy("band").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    bands = bands.select("band", *[F.coalesce(F.sum(f"{c}_").over(before), zero).alias(f"{c}_before") for c in ("docs", "tokens")], *[F.sum(f"{c}_").over(every).alias(f"{c}_all") for c in ("docs", "tokens")])
    inside = Window.partitionBy("band").orderBy("length").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.join(bands, "band")
    for c in ("docs", "tokens"):
        rows = rows.withColumn(f"{c}_below", F.col(f"{c}_before") + F.coalesce(F.sum(c).over(inside), zero)).withColumn(f"{c}_from", F.col(f"{c}_all") - F.col(f"{c}_below"))
    return rows.select("length", "docs", "docs_below", "docs_from", "tokens_below", "tokens_from")


def at_limits(sums: DataFrame, limits: Sequence[int]) -> DataFrame:
    """For each context limit: documents over it, tokens kept when texts are cut there, and tokens lost."""
    if any(v < 0 for v in limits):
        raise ValueError("a limit is below 0")
    whole = [F.sum(F.when(F.col("length") <= v, F.col("docs") * F.col("length")).otherwise(F.col("docs") * v)).alias(f"k{v}") for v in limits]
    over = [F.sum(F.when(F.col("length") > v, F.col("docs")).otherwise(0)).alias(f"o{v}") for v in limits]
    one = sums.agg(F.sum(F.col("docs") * F.col("length")).alias("tokens"), *whole, *over)
    return one.select(F.explode(F.array(*[F.struct(F.lit(v).alias("limit"), F.col(f"o{v}").alias("docs_over"), F.col(f"k{v}").alias("tokens_kept"), (F.col("tokens") - F.col(f"k{v}")).alias("tokens_lost")) for v in limits])).alias("r")).select("r.*")


def quantile(sums: DataFrame, q: float) -> int | None:
    """The least length that at least the share q of the documents doesn't exceed."""
    row = sums.filter(F.col("docs_below") + F.col("docs") >= F.lit(q) * (F.col("docs_below") + F.col("docs_from"))).agg(F.min("length")).first()
    return row[0] if row else None


def op2(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """One row a length: every length is a context limit, so the rows answer each limit; truncated is the total if texts are cut there."""
    sums = suffix_sums(written(histogram(lengths(docs, vocabulary)), "lengths"))
    share = (F.col("docs_below") + F.col("docs")) / (F.col("docs_below") + F.col("docs_from"))
    return sums.select("length", "docs", "docs_from", "tokens_from", (F.col("tokens_below") + F.col("docs_from") * F.col("length")).alias("truncated"), (F.col("tokens_below") + F.col("tokens_from")).alias("tokens_all"), share.alias("share_within"))

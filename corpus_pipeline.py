"""A corpus pipeline of training-data operators; each stage is written as Parquet and read again by the next.

All stages but the last return the columns of ``documents``, whatever they are, for the rows they keep;
the last returns the mix, a row for each document in each slot: (shard, position, doc_id, source, begin,
end).

Defined cases: texts without a letter, null ones included, are rejected by language ID; of equal texts
the smallest doc_id stays, of near copies the smallest doc_id of their component, of repeated rows of
one doc_id one; rows without doc_id can't be told apart and stay until the mix, whose rows then have no
doc_id; a null source is a source; documents whose blocks weren't drawn have no row in the mix; an empty
table gives an empty mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyworks.llm import decontaminate, exact_dedup, language_id, mixing, near_copies
from tallyworks.llm.common import shared_folder, table, written

STAGES = [
    ("language ID", lambda spark, docs, sf_dir: language_id.stage(docs)),
    ("exact dedup", lambda spark, docs, sf_dir: exact_dedup.stage(docs)),
    ("SimHash near-dedup", lambda spark, docs, sf_dir: near_copies.stage(docs)),
    ("benchmark decontamination", lambda spark, docs, sf_dir: decontaminate.stage(docs, table(spark, sf_dir, "benchmark"))),
    ("mixing sources to target weights", lambda spark, docs, sf_dir: mixing.stage(docs)),
]

#: Language ID, fingerprints, tiling and the mix's permutations can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared_folder(spark)
    docs = table(spark, sf_dir, "documents")
    for k, (_, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage{k}")
    return docs

"""The pipeline's stages in a row, and what every stage does with odd tables."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tallyworks.llm import decontaminate, exact_dedup, language_id, mixing, near_copies

SF = "/root/testdata/sf0.001"


def test_pipeline_on_the_smallest_tables(spark):
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    docs, left = documents, [{r["doc_id"] for r in documents.select("doc_id").collect()}]
    for _, step in corpus_pipeline.STAGES[:-1]:
        docs = step(spark, docs, SF)
        assert docs.columns == documents.columns
        left.append({r["doc_id"] for r in docs.select("doc_id").collect()})
        assert left[-1] <= left[-2]
    texts = {r["doc_id"]: " ".join((r["text"] or "").split()) for r in documents.collect()}
    firsts = {t: min(d for d in left[1] if texts[d] == t) for t in {texts[d] for d in left[1]}}
    assert left[2] == set(firsts.values())
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["shard", "position", "doc_id", "source", "begin", "end"]
    rows = out.collect()
    assert {r["doc_id"] for r in rows} <= left[-1]
    sizes = {d: len(texts[d].split()) for d in left[-1]}
    assert abs(sum(r["end"] - r["begin"] for r in rows) - sum(sizes.values())) <= 20  # a source's target is rounded


def stages(spark):
    bench = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven twelve")], "item_id long, text string")
    return {"language": language_id.stage, "exact": exact_dedup.stage, "near": near_copies.stage, "benchmark": lambda docs: decontaminate.stage(docs, bench)}


@pytest.mark.parametrize("name", ["language", "exact", "near", "benchmark"])
def test_stage_keeps_odd_columns_and_rows(spark, name):
    text = "the house of the old town and the people that live with it every day of the year"
    leak = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(1, text, "en", "s"), (1, text, "en", "s"), (2, text, None, "s"), (3, f"{text} and more words that nobody else has", "en", None), (4, None, "en", "s"), (5, "", "en", "s"), (6, leak, "en", "s"), (None, text, "en", "s"), (7, "word " * 60_000, "en", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    for extra in ("digest", "digest_", "id_", "own_0", "node", "a.b", "score", "n"):
        df = df.withColumn(extra, F.lit(f"kept {extra}"))
    out = stages(spark)[name](df)
    assert out.columns == df.columns
    got = out.collect()
    assert all(r[c] == f"kept {c}" for r in got for c in df.columns[4:])
    ids = sorted((r["doc_id"] or 0) for r in got)
    assert ids == {"language": [0, 1, 1, 2, 3, 6, 7], "exact": [0, 1, 3, 4, 6, 7], "near": [0, 1, 1, 3, 4, 6, 7], "benchmark": [0, 1, 1, 2, 3, 4, 5, 7]}[name]
    assert stages(spark)[name](df.limit(0)).count() == 0


def test_mixing_stage_ignores_odd_columns(spark):
    df = spark.createDataFrame([(1, "a b c", None, 1), (1, "a b c", None, 1), (2, None, "x", 1), (None, "d", "x", 1)], "doc_id long, text string, source string, size int").withColumn("a.b", F.lit(1)).withColumn("begin", F.lit(2))
    assert sum(r["end"] - r["begin"] for r in mixing.stage(df).collect()) == 7

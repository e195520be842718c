"""All operators and stages on odd rows, on empty tables and beside clashing columns."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from blockloom.llm import decontam, knn, langid, mixing, neardup, orc_tokens, pii, secret_scan, sharding, toxicity

LABELS = "doc_id long, quality int, toxic int"


def labels(spark, rows=((1, 1, 0), (5, 1, 1), (5, 1, 0), (7, None, None), (None, 0, 1), (8, 0, 1), (99, 0, 1), (3, 0, 7))):
    return spark.createDataFrame(list(rows), LABELS)


def benchmark(spark, rows=((1, "alpha"), (2, None), (3, "!!"), (None, "beta"))):
    return spark.createDataFrame(list(rows), "item_id long, text string")


OPERATORS = {
    "langid": lambda spark, docs: langid.identify(docs),
    "tokens": lambda spark, docs: orc_tokens.tokenize_and_read_back(docs, public_tokenizers.path("word_bpe_49k.json")),
    "mixing": lambda spark, docs: mixing.in_training_order(mixing.mix(docs)),
    "sharding": lambda spark, docs: sharding.shard_documents(docs),
    "pii": lambda spark, docs: pii.find_personal_data(docs),
    "toxicity": lambda spark, docs: toxicity.toxicity(docs, labels(spark)),
    "decontam": lambda spark, docs: decontam.contamination_digest(decontam.contamination(docs, benchmark(spark))),
    "neardup": lambda spark, docs: neardup.near_duplicates(docs, 3, 85),
    "secrets": lambda spark, docs: secret_scan.find_secrets(docs),
}


def rows(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(spark, odd, odd_rows, clashing, name):
    out = OPERATORS[name](spark, odd)
    got = rows(out)
    assert len(got) == len(odd_rows)
    assert got == rows(OPERATORS[name](spark, odd.repartition(5)))
    assert got == rows(OPERATORS[name](spark, clashing))


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, none, name):
    assert OPERATORS[name](spark, none).collect() == []


def test_empty_sides(spark, odd):
    assert {r["predicted"] for r in toxicity.toxicity(odd, labels(spark, ())).collect()} == {0}
    found = decontam.contamination_digest(decontam.contamination(odd, benchmark(spark, ())))
    assert {r["n_hit"] for r in found.collect()} == {0}


@pytest.mark.parametrize("kind", ["odd", "none", "clashing"])
def test_stages(spark, tmp_path, odd, none, clashing, kind):
    import corpus_pipeline

    docs = {"odd": odd, "none": none, "clashing": clashing}[kind]
    labels(spark).write.parquet(f"{tmp_path}/labels.parquet")
    benchmark(spark).write.parquet(f"{tmp_path}/benchmark.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k + 1 < len(corpus_pipeline.STAGES):
            assert out.columns == docs.columns, name
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
    assert {"shard", "slot"} <= set(docs.columns)
    assert len(set(docs.columns)) == len(docs.columns)
    if kind == "none":
        assert docs.count() == 0


def test_odd_vectors(spark):
    rows_ = [(0, [0.5, 0.25]), (1, [0.5, 0.25]), (20, [1.0, None]), (40, None), (60, [float("nan"), 1.0]), (80, [float("inf"), 1.0]), (None, [1.0, 1.0]), (100, [0.5]), (3, [-0.1, 0.9]), (3, [-0.1, 0.9]), (120, []), (140, [1e30, 1.0])]
    v = spark.createDataFrame(rows_, "vec_id long, embedding array<double>").withColumn("score", F.lit(1)).withColumn("q", F.lit(2))
    got = {}
    for r in knn.top_k(v).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == {0, 100, 120, 140}
    best = sorted(got[0])
    assert [x[0] for x in best] == list(range(1, len(best) + 1)) and len(best) == 6
    assert {x[1] for x in best} == {1, 3, 100, 120, 140}
    assert knn.top_k(v.limit(0)).collect() == []

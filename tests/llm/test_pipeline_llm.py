import corpus_pipeline as P
from pyspark.sql import functions as F

from shardloom.llm import decontaminate, neardup, quality_model, quality_rules
from shardloom.llm.common import materialise

from .conftest import SCHEMA, odd_rows, sentence
from .test_operators_llm import check_pack

DATA = "/root/testdata/sf0.001"


def test_run_equals_a_plain_version(spark, docs, labels):
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    model = quality_model.train(docs, labels)
    good = {r["doc_id"] for r in quality_model.score_quality(docs, model).collect() if r["score"] >= 0.3}
    one = docs.where(F.col("doc_id").isin(list(good)))
    good = {r["doc_id"] for r in quality_rules.quality_rules(one).collect() if r["kept"]}
    two = docs.where(F.col("doc_id").isin(list(good)))
    good = {r["doc_id"] for r in neardup.near_duplicates(two, percent=80).collect() if r["kept"]}
    three = docs.where(F.col("doc_id").isin(list(good)))
    bad = {r["doc_id"] for r in decontaminate.decontaminate(three, spark.read.parquet(f"{DATA}/benchmark.parquet")).collect() if r["contaminated"] or r["longest"] >= 13}
    got = P.run(spark, DATA).collect()
    check_pack(got, [(k, rows[k]) for k in good - bad], 1024)


def test_no_passage_of_the_benchmark_survives(spark):
    """A 13-word passage is found in a long text; 12 words of it, and words that items of a few words share, are left alone."""
    items = [r["text"].split() for r in spark.read.parquet(f"{DATA}/benchmark.parquet").orderBy("item_id").collect()]
    passages = [w[len(w) // 3 :][:13] if len(w) >= 20 else w[:13] for w in items]
    clean = sentence(2000, "clean")
    rows = [(k, f"{sentence(1000, k)} {' '.join(p)} {sentence(1000, -k)}") for k, p in enumerate(passages) if len(p) == 13]
    rows += [(1000, clean), (1001, clean + " " + " ".join(passages[0][:6])), (1002, None), (1003, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert len(rows) > 10 and sorted(r["doc_id"] for r in P.decontamination(spark, docs, DATA).collect()) == [1000, 1001, 1002, 1003]


def test_near_stage_keeps_one_of_each_group(spark):
    """Copies at 0.8 and more are one, whatever repeats an id."""
    base = sentence(200, "base").split()
    near = [*base[:60], "changed", *base[61:]]
    rows = [(4, " ".join(base)), (2, " ".join(near)), (7, " ".join(base)), (9, sentence(80, "x")), (9, sentence(80, "y")), (None, " ".join(base)), (5, None)]
    kept = P.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(3), DATA).collect()
    assert {r["doc_id"]: r["text"] for r in kept} == {2: " ".join(near), 9: min(sentence(80, "x"), sentence(80, "y")), None: " ".join(base), 5: None} and len(kept) == 4


def test_stages_on_odd_rows(spark, odd):
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, odd, DATA)
        assert out.columns == odd.columns, name
        assert out.count() <= len(odd_rows())
    packed = P.pack_sequences(spark, odd, DATA)
    assert packed.where("start = 0").count() == len(odd_rows())
    near = P.near_dedup(spark, odd, DATA)
    assert sorted(r["doc_id"] for r in near.where("doc_id is not null").collect()) == [1, 2, 3, 4, 5, 6, 9, 10] and near.where("doc_id is null").count() == 2


def test_stages_on_no_rows(spark, empty):
    docs = empty
    for name, stage in P.STAGES:
        docs = materialise(stage(spark, docs, DATA), name)
        assert docs.count() == 0
    assert SCHEMA.startswith("doc_id long")

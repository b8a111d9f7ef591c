"""Documents to training sequences in five stages, each written as Parquet before the next.

A stage takes (spark, docs, sf_dir) and works on all rows of docs, the stage before's result.
All but the last return the columns of documents. SQL cannot express the first, third and
last stage, so there is no ORACLE_SQL; tests hold run() against a plain version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shardloom.llm import decontaminate, neardup, packing, quality_model, quality_rules
from shardloom.llm.common import documents, materialise, read_table, sized

LEAST_QUALITY = 0.3
#: The general rule for near-duplicate stages, in hundredths.
NEAR_PERCENT = 80


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the rule ensemble, trained on labels of these rows, scores at LEAST_QUALITY or more."""
    model = quality_model.train(docs, read_table(spark, sf_dir, "labels"))
    return docs.where(quality_model.score_column(F.col("text"), model) >= LEAST_QUALITY)


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the threshold table keeps."""
    return docs.where(quality_rules.kept_column(F.col("text")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the smallest id of each near-duplicate class, links taken from NEAR_PERCENT on.

    Rows that repeat an id are one document, of which the row with the smallest text stays; rows
    without an id stay.
    """
    found = neardup.near_duplicates(docs, percent=NEAR_PERCENT).where("doc_id is not null")
    ids = found.groupBy(F.col("doc_id").alias("near_dedup_id")).agg(F.count(F.lit(1)).alias("near_dedup_rows"), F.min("component_id").alias("near_dedup_component"))
    kept = F.col("near_dedup_component") == F.col("near_dedup_id")
    ids = materialise(ids.where((F.col("near_dedup_rows") > 1) | ~kept).select("near_dedup_id", kept.alias("near_dedup_kept")), "near-dedup-ids")
    same = F.col("doc_id") == F.col("near_dedup_id")
    single = docs.join(sized(ids.select("near_dedup_id")), same, "left_anti")
    repeated = ids.where("near_dedup_kept").select("near_dedup_id")
    if repeated.isEmpty():
        return single
    several = docs.join(sized(repeated), same, "left_semi").groupBy(F.col("doc_id").alias("near_dedup_id")).agg(F.min_by(F.struct(*docs.columns), F.coalesce("text", F.lit(""))).alias("near_dedup_row"))
    return single.unionByName(several.select("near_dedup_row.*"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a passage of the benchmark: none of its whole windows, however long the text around it.

    Items shorter than a window, which may be common words, count only where the operator calls the
    document contaminated.
    """
    found = decontaminate.decontaminate(docs, read_table(spark, sf_dir, "benchmark"))
    bad = materialise(found.where(F.col("contaminated") | (F.col("longest") >= decontaminate.WINDOW)).select(F.col("doc_id").alias("decontamination_bad")).distinct(), "decontaminated-ids")
    return docs.join(sized(bad), F.col("doc_id").eqNullSafe(F.col("decontamination_bad")), "left_anti")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all rows in sequences of at most 1024 tokens."""
    return packing.pack(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", quality_filter),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", pack_sequences),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs

"""From raw documents to packed training sequences: five stages, each written as Parquet and read again as the next one's input.

Every stage works on all rows that its predecessor kept and judges each row for itself: rows with a null or a repeated doc_id are as good as
any. Null and empty texts and texts of fewer than 20 words go with the base rules; an empty table gives an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voicegrain.llm import near_dedup, packing, private_data, quality_model, quality_rules
from voicegrain.llm.shared import materialize, table

#: Documents that the classifier scores lower go.
LEAST_QUALITY = 0.3


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what the quality classifier, trained on the labelled documents, does not reject."""
    labels = table(spark, sf_dir, "labels").where(~quality_model.held_out())
    return quality_model.score(docs, quality_model.train(docs, labels)).where(F.col("score") >= LEAST_QUALITY).select(*docs.columns)


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what passes the base rules and reaches the log-likelihood threshold."""
    return quality_rules.quality_rules(docs, table(spark, sf_dir, "labels"), verdict=True).where("kept").select(*docs.columns)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near copies (five-word shingles, a similarity of 0.8): that with the least doc_id, null ids last."""
    row = "__row"
    while row in docs.columns:
        row += "_"
    numbered = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    groups = near_dedup.near_groups(numbered.select(F.col(row).alias("doc_id"), "text")).select(F.col("doc_id").alias(row), "component_id")
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col(row).alias("row"))
    kept = groups.join(numbered.select(row, "doc_id"), row).groupBy("component_id").agg(F.min(order)["row"].alias(row)).select(row)
    return numbered.join(kept.hint("merge"), row, "left_semi").select(*docs.columns)


def privacy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in every text by the name of its kind."""
    return private_data.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all texts into sequences of at most 2048 tokens."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality_model", classify), ("quality_rules", rules), ("near_dedup", dedup), ("private_data", privacy), ("packing", sequences)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs


#: SQL cannot express the stages' hashes and models; the tests hold them against plain versions.
ORACLE_SQL = None

QUERIES = {"pipeline": run}
ORACLES = {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}

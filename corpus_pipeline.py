"""The corpus pipeline: each stage reads what the one before it wrote."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm import packing, quality, simhash, toxicity
from quarry.llm.common import materialize, row_struct, table

QUALITY_FLOOR = 0.3
TOXIC_FROM = 0.5
#: Near copies: a Jaccard similarity of five-word shingles of 0.8 or more.
NEAR = {"shingle": 5, "least": 0.8}


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    model = quality.fit_quality(docs, table(spark, sf_dir, "labels"))
    return quality.score_quality(docs, model, carry=True).where(F.col("score") >= QUALITY_FLOOR).select("row.*")


def keep_civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without toxic spans."""
    field = toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels"))
    return toxicity.tag_toxicity(docs, field, carry=True).where(F.col("score") < TOXIC_FROM).select("row.*")


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each group of near copies; one row of each id.

    Rows without an id can't be told from each other and stay.
    """
    first = simhash.near_copies(docs, **NEAR).where("doc_id = component_id").select("doc_id")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), row_struct(docs))
    one = F.row_number().over(Window.partitionBy("doc_id").orderBy("text_hash"))
    kept = rows.join(first, "doc_id", "left_semi").withColumn("place", one).where("place = 1")
    return kept.select("row.*").unionByName(docs.where("doc_id is null"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the kept documents in windows of 2048 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality", keep_good), ("toxicity", keep_civil), ("near duplicates", keep_distinct), ("packing", pack)]

#: The classifiers, the trie join and the packer aren't SQL; tests hold run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)

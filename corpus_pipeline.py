"""A training-data pipeline over documents, each stage an operator of tallyspark.llm.

Every stage's result is written as Parquet in the shared folder and read again as the next one's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import linededup, minhash, mixing, quality, sentencepiece
from tallyspark.llm.common import materialize
from tallyspark.llm.queries import TOKENIZER

#: Five-word shingles at a similarity of 0.8.
NEAR = minhash.NearConfig(shingle=5, percent=80)
#: The production weights and, as documents are kept or not, one epoch.
MIX = mixing.MixConfig(weights=mixing.PRODUCTION.weights, budget_permille=700, max_epochs=1, seed=mixing.PRODUCTION.seed)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return quality.keep_clean(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines in later occurrences of three-line windows go; n_chars follows the text."""
    out = linededup.dedup_lines(docs).drop("n_lines", "n_removed_lines")
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: that with the smallest id."""
    return minhash.keep_one(docs, cfg=NEAR)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents within the budgets of their sources stay, whole."""
    return mixing.mix_documents(docs, MIX)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, token_ids, n_tokens, decoded_equal."""
    out = sentencepiece.encode(docs, sentencepiece.Vocabulary.load(TOKENIZER))
    return out.select("doc_id", "token_ids", F.size("token_ids").cast("long").alias("n_tokens"), "decoded_equal")


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("MinHash near-dedup", near_dedup),
    ("mixing sources", mix_sources),
    ("SentencePiece encoding", encode),
]

#: SQL can't express the last stage; tests/llm/test_pipeline.py holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{k}")
    return docs

"""Registered queries of the ten operators and their DuckDB SQL, where SQL can express them."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import langid, linededup, lm, minhash, mixing, oracles, quality, sentencepiece, simhash, substring, warc

TOKENIZER = os.environ.get("TALLYSPARK_SENTENCEPIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), mixing.PRODUCTION)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(table(spark, sf_dir, "documents"))


def op5_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = langid.held_out("doc_id", 7, 2)
    model, counts = lm.fit(docs.filter(~out))
    return lm.score(docs, model, counts, out)


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_components(table(spark, sf_dir, "documents"))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.with_neighbours(simhash.edited_fingerprints(table(spark, sf_dir, "documents")), every=50, radius=16)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece.encode(table(spark, sf_dir, "documents"), sentencepiece.Vocabulary.load(TOKENIZER), digest=True)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.repetition_metrics(table(spark, sf_dir, "documents"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed_lines", F.sha2("text", 256).alias("kept_sha256"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = langid.held_out("doc_id", 5, 0)
    net = langid.train(docs.filter(~out))
    return langid.predict(docs, net).select("doc_id", out.alias("held_out"), "lang_pred", "score")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mix_sources": op1_mix_sources,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_fingerprints": op3_fingerprints,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_lm_scores": op5_lm_scores,
    "op6_quality_rules": op6_quality_rules,
    "op7_line_dedup": op7_line_dedup,
    "op8_warc": op8_warc,
    "op9_language_id": op9_language_id,
    "op10_near_dedup": op10_near_dedup,
}

ORACLE: dict[str, str] = {
    "op1_mix_sources": mixing.oracle(mixing.PRODUCTION),
    "op2_substring_dedup": oracles.SUBSTRING,
    "op7_line_dedup": linededup.ORACLE,
    "op8_warc": oracles.WARC,
    "op10_near_dedup": oracles.NEAR,
}

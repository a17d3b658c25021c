"""Votes over sampled answers, answer entropy and disagreement. Two hash aggregations each; ties go to the first sample."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def vote(samples: DataFrame, by: str = "problem_id", key: str = "answer", idx: str = "sample_idx", weight: Column | None = None, representative: Column | None = None, skip_blank: bool = False, fallback: Column | None = None) -> DataFrame:
    """(by, winner, support, n_votes, n_keys, rep_idx): the key with the most weight (default: a vote each); ties go to the
    key seen first. rep_idx: the winner's sample with the largest `representative` (default: the first), ties to the first.
    V01 V02 V03 V04 V05 V07 V08 are settings of it. With skip_blank, NULL and '' don't vote; a problem without any vote has
    support 0 and, of its samples, that with the largest `fallback` (default: the last), ties to the first."""
    w = F.lit(1).cast("long") if weight is None else weight
    if skip_blank:
        votes = F.coalesce(F.col(key), F.lit("")) != ""
        mute = samples.groupBy(by).agg(F.bool_or(votes).alias("any"), F.max_by(F.struct(key, idx), F.struct((F.col(idx) if fallback is None else fallback).alias("f"), (-F.col(idx)).alias("i"))).alias("s")).filter("not any")
        voted = vote(samples.filter(votes), by, key, idx, weight, representative)
        zero = F.lit(0).cast("long")
        return voted.unionByName(mute.select(by, F.col(f"s.{key}").alias("winner"), zero.cast(voted.schema["support"].dataType).alias("support"), zero.alias("n_votes"), zero.alias("n_keys"), F.col(f"s.{idx}").alias("rep_idx")))
    s = samples
    rank = F.struct(*([] if representative is None else [representative.alias("r")]), (-F.col(idx)).alias("i"))
    per_key = s.groupBy(by, key).agg(F.sum(w).alias("w"), F.min(idx).alias("first"), F.count(F.lit(1)).alias("n"), F.max_by(F.col(idx), rank).alias("rep"))
    best = F.max_by(F.struct(F.col(key).alias("k"), "w", "rep"), F.struct("w", -F.col("first")))
    out = per_key.groupBy(by).agg(best.alias("b"), F.sum("n").alias("n_votes"), F.count(F.lit(1)).alias("n_keys"))
    return out.select(by, F.col("b.k").alias("winner"), F.col("b.w").alias("support"), "n_votes", "n_keys", F.col("b.rep").alias("rep_idx"))


def best_reward(samples: DataFrame, by: str = "problem_id", reward: str = "reward", idx: str = "sample_idx") -> DataFrame:
    """The sample with the largest reward, the first of equals."""
    return samples.groupBy(by).agg(F.max(reward).alias("best"), F.max_by(idx, F.struct(reward, -F.col(idx))).alias("rep_idx"))


def distribution(samples: DataFrame, by: str = "problem_id", key: str = "answer") -> DataFrame:
    """(by, key, n)."""
    return samples.groupBy(by, key).agg(F.count(F.lit(1)).alias("n"))


def disagreement(samples: DataFrame, by: str = "problem_id", key: str = "answer", idx: str = "sample_idx") -> DataFrame:
    """D01 D02 D06 (V08 V10): answer entropy in bits, majority answer, its count and fraction, distinct answers, confidence."""
    per_key = samples.groupBy(by, key).agg(F.count(F.lit(1)).alias("n"), F.min(idx).alias("first"))
    nlogn = F.sum(F.col("n") * F.log2("n"))
    g = per_key.groupBy(by).agg(F.sum("n").alias("total"), nlogn.alias("nl"), F.max("n").alias("majority_count"), F.max_by(key, F.struct("n", -F.col("first"))).alias("majority"), F.count(F.lit(1)).alias("n_distinct"))
    g = g.withColumn("entropy", F.greatest(F.log2("total") - F.col("nl") / F.col("total"), F.lit(0.0))).withColumn("fraction", F.col("majority_count") / F.col("total"))
    return g.withColumn("confidence", F.when(F.col("entropy") > 0, F.col("fraction") / (1 + F.col("entropy"))).otherwise(F.col("fraction"))).drop("nl")


def pass_at_k(samples: DataFrame, gold: DataFrame, ks: list[int], by: str = "problem_id", key: str = "answer", idx: str = "sample_idx", match: Callable[[Column, Column], Column] = Column.__eq__) -> DataFrame:
    """For each k whether one of the first k samples has the gold answer (by, gold), by equality or by `match`, such as
    functions.answers.matches_simple."""
    hit = samples.join(gold, by).groupBy(by).agg(F.min(F.when(match(F.col(key), F.col("gold")), F.col(idx))).alias("at"))
    return hit.select(by, *[F.coalesce(F.col("at") < k, F.lit(False)).alias(f"pass_{k}") for k in ks])


def first_stop(rounds: DataFrame, threshold: float, by: str = "problem_id") -> DataFrame:
    """The round at which a run stops: from the second on, confidence reaches the threshold or all agree."""
    stop = (F.col("round") >= 2) & ((F.col("confidence") >= threshold) | ((F.col("entropy") == 0) & (F.col("confidence") == 1)))
    return rounds.groupBy(by).agg(F.coalesce(F.min(F.when(stop, F.col("round"))), F.max("round")).alias("last_round"))

"""Model calls as tables (M01-M13, without M12): a provider turns prompts into samples; everything after it is relational."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .voting import disagreement, vote

SAMPLES = "problem_id long, sample_idx long, text string, answer string, tokens long"


class Provider(Protocol):
    def generate(self, prompts: DataFrame, n: int, round_: int = 1) -> DataFrame:
        """From (problem_id, prompt): n rows of SAMPLES for each."""


class StubProvider:
    """Samples from a hash of the prompt: the same each time, no model needed."""

    def __init__(self, answers: int = 5):
        self.answers = answers

    def generate(self, prompts: DataFrame, n: int, round_: int = 1) -> DataFrame:
        t = prompts.select("problem_id", "prompt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("sample_idx"))
        a = F.pmod(F.xxhash64("prompt", "sample_idx", F.lit(round_)), F.lit(self.answers)).cast("string")
        return t.select("problem_id", "sample_idx", F.concat(F.lit("so \\boxed{"), a, F.lit("}")).alias("text"), a.alias("answer"), F.length("prompt").cast("long").alias("tokens"))


class ReplayProvider:
    """Samples from a table of earlier ones (round, problem_id, sample_idx, text, answer, tokens)."""

    def __init__(self, table: DataFrame):
        self.table = table

    def generate(self, prompts: DataFrame, n: int, round_: int = 1) -> DataFrame:
        t = self.table.filter((F.col("round") == round_) & (F.col("sample_idx") < n))
        return t.join(prompts.select("problem_id"), "problem_id", "left_semi").select("problem_id", "sample_idx", "text", "answer", "tokens")


def rerank(candidates: DataFrame, by: str, rank: str, logprobs: str) -> DataFrame:
    """M03 (by, rank, score): of each group's lookahead candidates that with the largest sum of log probabilities, the
    better ranked of equals; a candidate whose lookahead is empty or NULL has 0."""
    total = F.aggregate(F.coalesce(F.col(logprobs), F.array().cast("array<double>")), F.lit(0.0), lambda s, x: s + x)
    best = F.max_by(F.struct(F.col(rank), total.alias("score")), F.struct(F.round(total, 9), -F.col(rank)))
    return candidates.groupBy(by).agg(best.alias("b")).select(by, f"b.{rank}", F.round("b.score", 6).alias("score"))


def deliberate(prompts: DataFrame, provider: Provider, first: int, later: int, rounds: int, threshold: float, save: Callable[[DataFrame, str], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(votes over all rounds, each problem's last disagreement map). A problem stops from the second round on when
    its confidence reaches the threshold. save(df, name) writes a round's table and reads it again."""
    open_, all_, maps = prompts, None, None
    for k in range(1, rounds + 1):
        s = provider.generate(open_, first if k == 1 else later, k).withColumn("sample_idx", F.col("sample_idx") + F.lit((k - 1) * 1_000_000).cast("long"))
        s = save(s, f"samples-{k}")
        all_ = s if all_ is None else all_.unionByName(s)
        m = save(disagreement(s).withColumn("round", F.lit(k)), f"maps-{k}")
        maps = m if maps is None else maps.join(m.select("problem_id"), "problem_id", "left_anti").unionByName(m)
        if k > 1:
            open_ = open_.join(m.filter(F.col("confidence") >= threshold).select("problem_id"), "problem_id", "left_anti")
    return vote(all_, representative=F.length("text"), skip_blank=True), maps

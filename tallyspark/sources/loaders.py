"""Problem tables from raw dataset tables (S01-S13, S22): one schema, whatever the source."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import answers as A

COLUMNS = ["problem_id", "question", "gold_answer", "source", "level", "problem_type"]


def _text(df: DataFrame, *names: str) -> Column:
    """The first of the columns that is there and not empty, as trimmed text."""
    there = [F.nullif(A.strip(F.col(n).cast("string")), F.lit("")) for n in names if n in df.columns]
    return F.coalesce(*there, F.lit(""))


def _box(x: Column) -> Column:
    return F.nullif(A.boxed_first(x), F.lit(""))


def _numbered(df: DataFrame, n: int, seed: int | None, order: str | None) -> DataFrame:
    """The first n in an order of hashes with the seed (or of the order column), numbered from 0.

    With n, only n rows are numbered; without, problem sets are small by nature (thousands) and numbered in one task."""
    keys = [F.xxhash64(F.col("question"), F.lit(seed)), F.col("question")] if seed is not None else [F.col(order) if order else F.monotonically_increasing_id()]
    t = df.withColumns({f"_k{i}": k for i, k in enumerate(keys)})
    names = [f"_k{i}" for i in range(len(keys))]
    if n > 0:
        t = t.orderBy(*names).limit(n)
    return t.withColumn("problem_id", (F.row_number().over(Window.orderBy(*names)) - 1).cast("long")).select(*COLUMNS)


def _problem(df: DataFrame, question, gold, source: str, level=None, kind=None) -> DataFrame:
    return df.select("*", question.alias("_q"), gold.alias("_g"), (F.lit("") if level is None else level).alias("_l"), (F.lit("") if kind is None else kind).alias("_t")).select(*[c for c in df.columns if c not in COLUMNS], F.col("_q").alias("question"), F.coalesce("_g", F.lit("")).alias("gold_answer"), F.lit(source).alias("source"), F.coalesce("_l", F.lit("")).alias("level"), F.coalesce("_t", F.lit("")).alias("problem_type"))


def gsm8k(df, n=0, seed=42):
    return _numbered(_problem(df, _text(df, "question"), A.gsm8k_gold("answer"), "gsm8k"), n, seed, None)


def math500(df, n=0, seed=42):
    level = F.regexp_extract(F.col("level").cast("string"), r"\d+", 0)
    return _numbered(_problem(df, _text(df, "problem"), _text(df, "answer"), "math500", level, _text(df, "subject", "type")), n, seed, None)


def deepmath(df, n=0, seed=42):
    return _numbered(_problem(df, _text(df, "question", "problem"), _text(df, "final_answer", "answer"), "deepmath", _text(df, "difficulty"), _text(df, "topic")), n, seed, None)


def aime_2024(df, n=0, seed=None):
    solution = _text(df, "solution")
    return _numbered(_problem(df, _text(df, "problem"), F.coalesce(_box(solution), solution), "aime_2024", F.lit("competition")), n, None, "id" if "id" in df.columns else None)


def aime_2025(df, n=0, seed=None):
    gold = F.coalesce(F.col("answer").try_cast("double").try_cast("bigint").cast("string"), _text(df, "answer"))
    return _numbered(_problem(df, _text(df, "problem"), gold, "aime_2025", F.lit("competition")), n, None, "id" if "id" in df.columns else None)


def amc(df, n=0, seed=None):
    url = _text(df, "url")
    kind = F.when(url.contains("AMC_12A"), "AMC_12A").when(url.contains("AMC_12B"), "AMC_12B").otherwise("AMC")
    first = F.get("answer", 0).cast("string") if dict(df.dtypes)["answer"].startswith("array") else _text(df, "answer")
    return _numbered(_problem(df, _text(df, "problem", "question"), first, "amc", F.lit("competition"), kind), n, None, "id" if "id" in df.columns else None)


def competition_math(df, n=0, seed=42, last_box=False):
    lines = F.filter(F.transform(F.split("solution", "\n"), A.strip), lambda s: s != "")
    box = F.nullif(A.boxed_last("solution"), F.lit("")) if last_box else _box(F.col("solution"))
    level = F.regexp_extract(F.col("level").cast("string"), r"\d+", 0)
    return _numbered(_problem(df, _text(df, "problem"), F.coalesce(box, F.try_element_at(lines, F.lit(-1))), "competition_math", level, _text(df, "type")), n, seed, None)


def olympiad_bench(df, n=0, seed=42, numeric_only=True):
    if "modality" in df.columns:
        df = df.filter("modality = 'Text-only'")
    if numeric_only and "answer_type" in df.columns:
        df = df.filter("answer_type = 'Numerical'")
    joined = F.array_join("final_answer", ", ") if dict(df.dtypes)["final_answer"].startswith("array") else F.col("final_answer").cast("string")
    gold = A.strip(F.regexp_replace(joined, r"^\$+|\$+$", ""))
    return _numbered(_problem(df, _text(df, "question"), gold, "olympiad_bench", F.lit("olympiad"), _text(df, "subfield")), n, seed, None)


def amo_bench(df, n=0, seed=42, number_only=True):
    if number_only and "answer_type" in df.columns:
        df = df.filter("answer_type = 'number'")
    return _numbered(_problem(df, _text(df, "prompt", "problem"), A.boxed_one_level("answer"), "amo_bench", F.lit("olympiad")), n, seed, None)


LOADERS: dict[str, Callable[..., DataFrame]] = {"gsm8k": gsm8k, "math500": math500, "deepmath": deepmath, "aime_2024": aime_2024, "aime_2025": aime_2025, "amc": amc, "competition_math": competition_math, "olympiad_bench": olympiad_bench, "amo_bench": amo_bench}


def load(name: str, raw: DataFrame, n: int = 0, **options) -> DataFrame:
    """The loader of that name; S06: AIME of an unknown year is that of 2025."""
    if name.startswith("aime") and name not in LOADERS:
        name = "aime_2025"
    if name not in LOADERS:
        raise ValueError(f"unknown dataset: {name}")
    return LOADERS[name](raw, n, **options)

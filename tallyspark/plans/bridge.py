"""Views of the driver's tables as the domain's tables, in Spark and, for the oracle, as DuckDB CTEs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def results(spark: SparkSession, d: str) -> DataFrame:
    """Method results; several rows for one (problem, method), the last by ord counts."""
    return table(spark, d, "orders").selectExpr("o_custkey problem_id", "o_orderpriority method", "o_orderstatus level", "concat('t', o_orderkey % 3) ptype", "o_totalprice > 250000 correct", "cast(floor(o_totalprice / 100) as bigint) total_tokens", "round(o_totalprice / 1000, 3) wall", "o_orderkey ord", "o_orderkey % 5 <> 0 has_boxed")


RESULTS = "b1 AS (SELECT o_custkey AS problem_id, o_orderpriority AS method, o_orderstatus AS level, 't' || (o_orderkey % 3) AS ptype, o_totalprice > 250000 AS correct, floor(o_totalprice / 100)::BIGINT AS total_tokens, round(o_totalprice / 1000, 3) AS wall, o_orderkey AS ord, o_orderkey % 5 <> 0 AS has_boxed FROM orders)"


def _sample_order():
    return Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")


_ANSWER = "case when {q} % 7 = 0 then '' else cast(cast({q} as int) % 5 as string) end"
_TOKENS = "cast(floor({p}) as bigint)"


def samples(spark: SparkSession, d: str) -> DataFrame:
    """Sampled solutions with their order within a problem."""
    t = table(spark, d, "lineitem").withColumn("sample_idx", (F.row_number().over(_sample_order()) - 1).cast("bigint"))
    return t.selectExpr("l_orderkey problem_id", "sample_idx", _ANSWER.format(q="l_quantity") + " answer", "l_discount reward", _TOKENS.format(p="l_extendedprice") + " tokens", "repeat('w', cast(l_quantity as int) % 4 + 1) text")


def first_samples(spark: SparkSession, d: str, n: int) -> DataFrame:
    """(problem_id, s0, s1, ...): a row per problem with the first n of its samples, as (answer, tokens); null where it has
    fewer. The pass that orders samples brings those that follow along, so only its sort holds rows."""
    w = _sample_order()
    t = table(spark, d, "lineitem").withColumns({"i": F.row_number().over(w), "q0": F.col("l_quantity"), "p0": F.col("l_extendedprice"), "there0": F.lit(True)})
    t = t.withColumns({f"{c}{k}": F.lead(x, k).over(w) for k in range(1, n) for c, x in (("q", "l_quantity"), ("p", "l_extendedprice"), ("there", F.lit(True)))})
    one = lambda k: F.when(F.col(f"there{k}"), F.struct(F.expr(_ANSWER.format(q=f"q{k}")).alias("answer"), F.expr(_TOKENS.format(p=f"p{k}")).alias("tokens")))
    return t.filter("i = 1").select(F.col("l_orderkey").alias("problem_id"), *[one(k).alias(f"s{k}") for k in range(n)])


SAMPLES = "b2 AS (SELECT l_orderkey AS problem_id, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) - 1)::BIGINT AS sample_idx, CASE WHEN l_quantity % 7 = 0 THEN '' ELSE (l_quantity::INT % 5)::VARCHAR END AS answer, l_discount AS reward, floor(l_extendedprice)::BIGINT AS tokens, repeat('w', l_quantity::INT % 4 + 1) AS text FROM lineitem)"


def tokens(spark: SparkSession, d: str) -> DataFrame:
    """Per-token uncertainty records: one problem per user, positions in time order."""
    k = F.regexp_extract("props", r"(\d+)", 1).cast("int")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    t = table(spark, d, "events").withColumn("k", k).withColumn("position", (F.row_number().over(w) - 1).cast("bigint"))
    return t.selectExpr("user_id problem_id", "position", "value / 100 entropy", "event_type in ('click', 'purchase', 'view') zone", "k / 100.0D disagreement", "k % 2 = 0 correct", "exp(-value / 100) top1", "exp(-value / 100) / 2 margin", "event_type", "event_id")


TOKENS = "b3 AS (SELECT user_id AS problem_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)::BIGINT AS position, value / 100 AS entropy, event_type IN ('click', 'purchase', 'view') AS zone, k / 100.0::DOUBLE AS disagreement, k % 2 = 0 AS correct, exp(-value / 100) AS top1, exp(-value / 100) / 2 AS margin, event_type, event_id FROM (SELECT *, regexp_extract(props, '(\\d+)', 1)::INT AS k FROM events))"


def tree(spark: SparkSession, d: str) -> DataFrame:
    """Step nodes: binary trees of conversation turns."""
    return table(spark, d, "conversations").selectExpr("conv_id tree_id", "turn node_id", "case when turn = 0 then null else cast(floor((turn - 1) / 2) as bigint) end parent_id", "(conv_id * 31 + turn * 17) % 101 / 100.0D reward", "(conv_id * 7 + turn * 13) % 97 / 100.0D diversity", "length(text) n_chars", "turn >= 3 terminal", "turn % 2 = 1 complete", "text")


TREE = "b5 AS (SELECT conv_id AS tree_id, turn AS node_id, CASE WHEN turn = 0 THEN NULL ELSE floor((turn - 1) / 2)::BIGINT END AS parent_id, (conv_id * 31 + turn * 17) % 101 / 100.0::DOUBLE AS reward, (conv_id * 7 + turn * 13) % 97 / 100.0::DOUBLE AS diversity, length(text)::INT AS n_chars, turn >= 3 AS terminal, turn % 2 = 1 AS complete, text FROM conversations)"


def rounds(spark: SparkSession, d: str) -> DataFrame:
    """Per problem the series of a metric over its rounds, and whether it ended well."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    t = table(spark, d, "orders").withColumn("round", F.row_number().over(w).cast("int"))
    return t.selectExpr("o_custkey problem_id", "round", "o_totalprice / 100000 entropy", "least(1.0D, 20000 / o_totalprice) confidence", "o_custkey % 2 = 0 correct")


ROUNDS = "b6 AS (SELECT o_custkey AS problem_id, round::INT AS round, o_totalprice / 100000 AS entropy, least(1.0::DOUBLE, 20000 / o_totalprice) AS confidence, o_custkey % 2 = 0 AS correct FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS round FROM orders))"


def wide(spark: SparkSession, d: str) -> DataFrame:
    """One row per problem with the outcome of three methods and its answer entropy."""
    return table(spark, d, "customer").selectExpr("c_custkey problem_id", "c_mktsegment level", "c_custkey % 3 = 0 greedy", "c_custkey % 4 < 2 majority", "case when c_custkey % 11 = 0 then null else c_custkey % 5 < 3 end dad", "case when c_custkey % 7 = 0 then 0.0D else abs(c_acctbal) / 2500 end entropy", "c_custkey % 4 rounds", "c_custkey % 20 - 1 d1")


WIDE = "b9 AS (SELECT c_custkey AS problem_id, c_mktsegment AS level, c_custkey % 3 = 0 AS greedy, c_custkey % 4 < 2 AS majority, CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE c_custkey % 5 < 3 END AS dad, CASE WHEN c_custkey % 7 = 0 THEN 0.0::DOUBLE ELSE abs(c_acctbal) / 2500 END AS entropy, c_custkey % 4 AS rounds, c_custkey % 20 - 1 AS d1 FROM customer)"


def claims_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "text")


def quality(spark: SparkSession, d: str) -> DataFrame:
    """Score and label of the labelled documents."""
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").selectExpr("doc_id", "cast(n_chars as double) score", "quality = 1 label")


QUALITY = "b8 AS (SELECT doc_id, n_chars::DOUBLE AS score, quality = 1 AS label FROM documents JOIN labels USING (doc_id))"


def vectors(spark: SparkSession, d: str) -> DataFrame:
    """Vectors in groups, few in each: groups of ten ids."""
    return table(spark, d, "embeddings").selectExpr("vec_id", "floor(vec_id / 10) grp", "label", "transform(embedding, x -> cast(x as double)) v")


VECTORS = "b4 AS (SELECT vec_id, floor(vec_id / 10)::BIGINT AS grp, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)"

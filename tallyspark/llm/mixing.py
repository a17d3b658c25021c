"""Operator 1, mixing sources to target weights (DataFrame functions only): hierarchical budgets.

Leaves are (domain, language, source). A node's budget goes to its children by weight, none above its capacity (tokens
below it times max_epochs); what a full child leaves goes to its siblings by weight, and reaches other branches only
when the whole branch is full. Each leaf then takes its budget as whole epochs and a token prefix of one more, in that
epoch's seeded order.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, broadcast_if_small, materialize

LEVELS = ("domain", "lang", "source")
BUCKET_HEX = 3  # the first digits of the order's hash: 4096 buckets a leaf
BIG = "decimal(38,0)"


@dataclass(frozen=True)
class MixConfig:
    """weights by level and child name, integers, 1 where none is given (0: take nothing); budget as share of all tokens
    in thousandths; seed of the epochs' orders."""

    weights: dict[str, dict[str, int]] = field(default_factory=dict)
    budget_permille: int = 600
    max_epochs: int = 3
    seed: int = 17
    domains: int = 4
    max_broadcast_leaves: int = 20_000


PRODUCTION = MixConfig(weights={"lang": {"en": 4, "de": 3, "fr": 2, "es": 2}, "domain": {"domain0": 3, "domain1": 2, "domain2": 2, "domain3": 1}, "source": {"src0": 1, "src1": 5, "src2": 3}})


def default_domain(cfg: MixConfig, source_col: str = "source") -> Column:
    """The driver's tables name no domain: that of a source is the remainder of its number."""
    digits = F.regexp_extract(F.coalesce(F.col(source_col), F.lit("")), r"([0-9]{1,9})$", 1)
    return F.concat(F.lit("domain"), (F.coalesce(F.nullif(digits, F.lit("")).cast("int"), F.lit(0)) % cfg.domains).cast("string"))


def word_count(text_col: str) -> Column:
    return F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long")


def _weight(cfg: MixConfig, level: str) -> Column:
    pairs = [F.lit(x) for kv in cfg.weights.get(level, {}).items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.col(level)), F.lit(1)).cast("long") if pairs else F.lit(1).cast("long")


def _share(nodes: DataFrame, parent: list[str], level: str, budget: str) -> DataFrame:
    """Adds `grant`: the part of the parent's budget for each child, children being capped at `cap`.

    In order of cap / weight, a child is full if its share of what is left, among the children from it on, reaches its
    cap; the others share the rest by weight, rounded down.
    """
    key = [F.col(c) for c in parent] or [F.lit(0)]
    order = [F.col("cap") / F.col("weight"), F.col(level)]
    before = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    onward = Window.partitionBy(*key).orderBy(*order).rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy(*key)
    n = nodes.filter("weight > 0").withColumn("_left", F.col(budget).cast(BIG) - F.coalesce(F.sum("cap").over(before), F.lit(0)).cast(BIG)).withColumn("_w", F.sum("weight").over(onward).cast(BIG))
    n = n.withColumn("_full", F.col("_left") * F.col("weight") >= F.col("cap").cast(BIG) * F.col("_w"))
    n = n.withColumn("_rest", F.max(F.when(~F.col("_full"), F.col("_left"))).over(whole)).withColumn("_rw", F.max(F.when(~F.col("_full"), F.col("_w"))).over(whole))
    open_ = F.expr("cast(greatest(_rest, 0) * weight div _rw as bigint)")
    return n.withColumn("grant", F.when(F.col("_full"), F.col("cap")).otherwise(open_)).drop("_left", "_w", "_full", "_rest", "_rw")


def budgets(leaves: DataFrame, cfg: MixConfig) -> DataFrame:
    """(domain, lang, source, tokens, grant) from (domain, lang, source, tokens); zero grants and leaves are left out."""
    t = leaves
    for level in LEVELS:
        t = t.withColumn(f"w_{level}", _weight(cfg, level))
    open_ = (F.col("w_domain") > 0) & (F.col("w_lang") > 0) & (F.col("w_source") > 0)
    t = t.withColumn("total", F.sum("tokens").over(Window.partitionBy(F.lit(0)))).filter(open_ & (F.col("tokens") > 0))
    t = t.withColumn("cap", F.col("tokens") * cfg.max_epochs)
    goal = F.expr(f"cast(cast(total as {BIG}) * {cfg.budget_permille} div 1000 as bigint)")
    top = t.groupBy("domain").agg(F.sum("cap").alias("cap"), F.max("w_domain").alias("weight"), F.max(goal).alias("b0"))
    top = _share(top, [], "domain", "b0").select("domain", F.col("grant").alias("b1"))
    mid = t.groupBy("domain", "lang").agg(F.sum("cap").alias("cap"), F.max("w_lang").alias("weight")).join(top, "domain")
    mid = _share(mid, ["domain"], "lang", "b1").select("domain", "lang", F.col("grant").alias("b2"))
    low = t.withColumn("weight", F.col("w_source")).join(mid, ["domain", "lang"])
    return _share(low, ["domain", "lang"], "source", "b2").select(*LEVELS, "tokens", "grant").filter("grant > 0")


def _order(cfg: MixConfig, epoch: Column, id_col: str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(cfg.seed)), epoch.cast("string"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))


def plan(keyed: DataFrame, cfg: MixConfig, label: str = "mix") -> DataFrame:
    """From (domain, lang, source, id, n_tokens): a row per leaf with its grant, whole epochs and the cut of the last.

    The cut, (cut_h, cut_id, cut_n): the last document of the prefix; cut_take, its tokens in it. A hot leaf is never in
    one task: its tokens are summed by hash bucket, and only the bucket with the cut is put in order.
    """
    leaves = keyed.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"))
    b = budgets(leaves, cfg).withColumn("epochs", F.expr("grant div tokens")).withColumn("part", F.expr("grant % tokens"))
    b = materialize(b, f"{label}-budgets")
    h = keyed.filter("n_tokens > 0").join(broadcast_if_small(b.filter("part > 0"), cfg.max_broadcast_leaves), list(LEVELS))
    h = h.withColumn("h", _order(cfg, F.col("epochs"), "id")).withColumn("bucket", F.substring("h", 1, BUCKET_HEX))
    sums = h.groupBy(*LEVELS, "bucket", "part").agg(F.sum("n_tokens").alias("in_bucket"))
    run = Window.partitionBy(*LEVELS).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("in_bucket").over(run), F.lit(0)))
    edge = sums.filter("before < part and before + in_bucket >= part").select(*LEVELS, "bucket", "before")
    edge = materialize(edge, f"{label}-edges")
    rows = h.join(broadcast_if_small(edge, cfg.max_broadcast_leaves), [*LEVELS, "bucket"])
    inside = Window.partitionBy(*LEVELS).orderBy("h", "id", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("start", F.col("before") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    cut = rows.filter("start < part and start + n_tokens >= part").select(*LEVELS, F.col("h").alias("cut_h"), F.col("id").alias("cut_id"), F.col("n_tokens").alias("cut_n"), (F.col("part") - F.col("start")).alias("cut_take"))
    return materialize(b.join(cut, list(LEVELS), "left"), f"{label}-plan")


def keys(docs: DataFrame, cfg: MixConfig, id_col: str, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    fill = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return docs.select(default_domain(cfg, source_col).alias("domain"), fill(lang_col).alias("lang"), fill(source_col).alias("source"), F.col(id_col).alias("id"), word_count(text_col).alias("n_tokens"))


def _taken(rows: DataFrame, leaf_plan: DataFrame, cfg: MixConfig, id_col: str, n_col: str, leaf: list[str]) -> DataFrame:
    """Adds _epochs (whole epochs), _last (tokens of this row in the last one) and _e to rows of leaves that take any."""
    p = broadcast_if_small(leaf_plan, cfg.max_broadcast_leaves).select(*[F.col(c).alias(f"_{c}") for c in LEVELS], F.col("epochs").alias("_epochs"), F.col("part").alias("_part"), "cut_h", "cut_id", "cut_n", "cut_take")
    on = [F.col(a) == F.col(f"_{b}") for a, b in zip(leaf, LEVELS, strict=True)]
    t = rows.join(p, on[0] & on[1] & on[2]).withColumn("_h", _order(cfg, F.col("_epochs"), id_col))
    here = F.struct(F.col("_h"), F.col(id_col), F.col(n_col))
    edge = F.struct(F.col("cut_h"), F.col("cut_id"), F.col("cut_n"))
    last = F.when((F.col("_part") == 0) | F.col("cut_h").isNull(), 0).when(here < edge, F.col(n_col)).when(here == edge, F.col("cut_take")).otherwise(0)
    return t.withColumn("_last", F.coalesce(last, F.lit(0)).cast("long"))


def mix(docs: DataFrame, cfg: MixConfig = PRODUCTION, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(domain, lang, source, doc_id, epoch, n_tokens, take_tokens): a row per document and epoch it is taken in.

    Documents without words are never taken. Null language or source: '' (domain0 for sources that end in no number).
    Rows that repeat an id and a length tie and share their fate: at the cut each takes the same tokens. No rows, or all
    weights 0: an empty table. Columns beyond the four named are not read.
    """
    slim = materialize(keys(docs, cfg, id_col, text_col, lang_col, source_col), "mix-keys")
    t = _taken(slim.filter("n_tokens > 0"), plan(slim, cfg), cfg, "id", "n_tokens", list(LEVELS))
    full = F.transform(F.when(F.col("_epochs") > 0, F.sequence(F.lit(0), (F.col("_epochs") - 1).cast("int"))).otherwise(F.array().cast("array<int>")), lambda e: F.struct(e.alias("epoch"), F.col("n_tokens").alias("take")))
    part = F.when(F.col("_last") > 0, F.array(F.struct(F.col("_epochs").cast("int").alias("epoch"), F.col("_last").alias("take")))).otherwise(F.array().cast("array<struct<epoch:int,take:bigint>>"))
    out = t.select(*LEVELS, F.col("id").alias("doc_id"), "n_tokens", F.explode(F.concat(full, part)).alias("x"))
    return out.select(*LEVELS, "doc_id", F.col("x.epoch").alias("epoch"), "n_tokens", F.col("x.take").alias("take_tokens"))


def mix_documents(docs: DataFrame, cfg: MixConfig, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The rows of docs, whole and unchanged, that the mix takes at least in part, once each (as a filter)."""
    slim = materialize(keys(docs, cfg, id_col, text_col, lang_col, source_col), "mix-keys")
    p = plan(slim, cfg)
    fill = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select("*", default_domain(cfg, source_col).alias("_a"), fill(lang_col).alias("_b"), fill(source_col).alias("_c"), word_count(text_col).alias("_n")).filter("_n > 0")
    return _taken(rows, p, cfg, id_col, "_n", ["_a", "_b", "_c"]).filter("_epochs > 0 or _last > 0").select(*docs.columns)


def oracle(cfg: MixConfig) -> str:
    """DuckDB SQL for mix() over documents, by plain windows over whole leaves."""

    def weight(level):
        cases = " ".join(f"WHEN '{k}' THEN {v}" for k, v in cfg.weights.get(level, {}).items())
        return f"CASE {level} {cases} ELSE 1 END" if cases else "1"

    def share(name, source, parent, level, budget):
        part = f"PARTITION BY {', '.join(parent)}" if parent else ""
        return f"""
{name}_a AS (SELECT *, {budget}::HUGEINT - coalesce(sum(cap) OVER ({part} ORDER BY cap / weight, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lft,
  sum(weight) OVER ({part} ORDER BY cap / weight, {level} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w FROM {source} WHERE weight > 0),
{name}_b AS (SELECT *, lft * weight >= cap::HUGEINT * w AS is_full FROM {name}_a),
{name}_c AS (SELECT *, max(CASE WHEN NOT is_full THEN lft END) OVER ({part}) AS rest, max(CASE WHEN NOT is_full THEN w END) OVER ({part}) AS rw FROM {name}_b),
{name} AS (SELECT * EXCLUDE (lft, w, is_full, rest, rw), CASE WHEN is_full THEN cap ELSE (greatest(rest, 0) * weight // rw) END::BIGINT AS g FROM {name}_c)"""

    return f"""
WITH k AS (SELECT 'domain' || (coalesce(try_cast(nullif(regexp_extract(coalesce(source, ''), '([0-9]{{1,9}})$', 1), '') AS INT), 0) % {cfg.domains}) AS domain,
  coalesce(lang, '') AS lang, coalesce(source, '') AS source, doc_id, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS n FROM documents),
lv AS (SELECT domain, lang, source, sum(n)::BIGINT AS tokens FROM k GROUP BY ALL),
tot AS (SELECT sum(tokens)::BIGINT AS total FROM lv),
t AS (SELECT *, tokens * {cfg.max_epochs} AS cap, {weight("domain")} AS wd, {weight("lang")} AS wl, {weight("source")} AS ws FROM lv WHERE tokens > 0),
op AS (SELECT * FROM t WHERE wd > 0 AND wl > 0 AND ws > 0),
d0 AS (SELECT domain, sum(cap)::BIGINT AS cap, max(wd) AS weight, (SELECT (total::HUGEINT * {cfg.budget_permille} // 1000) FROM tot) AS b FROM op GROUP BY domain),
{share("d1", "d0", [], "domain", "b")},
l0 AS (SELECT op.domain, lang, sum(op.cap)::BIGINT AS cap, max(wl) AS weight, max(g) AS b FROM op JOIN d1 USING (domain) GROUP BY op.domain, lang),
{share("l1", "l0", ["domain"], "lang", "b")},
s0 AS (SELECT op.domain, op.lang, source, tokens, op.cap, ws AS weight, g AS b FROM op JOIN l1 USING (domain, lang)),
{share("s1", "s0", ["domain", "lang"], "source", "b")},
bud AS (SELECT domain, lang, source, tokens, g // tokens AS epochs, g % tokens AS part FROM s1 WHERE g > 0),
j AS (SELECT k.*, epochs, part, md5('{cfg.seed}:' || epochs || ':' || doc_id) AS h FROM k JOIN bud USING (domain, lang, source) WHERE n > 0),
c AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY domain, lang, source ORDER BY h, doc_id, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM j)
SELECT domain, lang, source, doc_id, e::INT AS epoch, n AS n_tokens, n AS take_tokens FROM (SELECT *, unnest(range(0, epochs)) AS e FROM c)
UNION ALL
SELECT domain, lang, source, doc_id, epochs::INT, n, least(n, part - start)::BIGINT FROM c WHERE start < part
"""

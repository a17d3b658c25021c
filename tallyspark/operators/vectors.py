"""Uncertainty of logits and diversity of vectors, as higher-order functions on arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .metrics import r6


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def _let(x: Column, body) -> Column:
    return F.get(F.transform(F.array(x), body), 0)


def scrub(v) -> Column:
    """NaN as 0, infinities as 10000 with their sign."""
    return F.transform(_c(v), lambda x: F.when(F.isnan(x), 0.0).when(x == float("inf"), 1e4).when(x == float("-inf"), -1e4).otherwise(x))


def softmax(v) -> Column:
    return _let(_c(v), lambda a: _let(F.array_max(a), lambda m: _let(F.transform(a, lambda x: F.exp(x - m)), lambda e: _let(_sum(e), lambda z: F.transform(e, lambda x: x / z)))))


def entropy_nats(v) -> Column:
    """E01."""
    return _sum(F.transform(softmax(v), lambda p: F.when(p > 0, -p * F.log(p)).otherwise(0.0)))


def top_probs(v, k: int) -> Column:
    """The k largest probabilities, or as many as there are."""
    return F.slice(F.sort_array(softmax(v), asc=False), 1, k)


def logit_margin(v) -> Column:
    """The difference of the two largest probabilities."""
    return _let(top_probs(v, 2), lambda t: F.get(t, 0) - F.coalesce(F.get(t, 1), F.lit(0.0)))


def full_record(v, position, zone, tau: float, least: int) -> Column:
    """struct(entropy, margin, top1, triggered, gated): gated is 0 where the gate is shut."""
    h = entropy_nats(v)
    return _let(F.struct(h.alias("h"), top_probs(v, 2).alias("t")), lambda s: F.struct(s["h"].alias("entropy"), (F.get(s["t"], 0) - F.get(s["t"], 1)).alias("margin"), F.get(s["t"], 0).alias("top1"), (_c(zone) & (_c(position) >= least) & (s["h"] > tau)).alias("triggered"), F.when(_c(zone) & (_c(position) >= least), s["h"]).otherwise(0.0).alias("gated")))


def dot(a, b) -> Column:
    return _sum(F.zip_with(_c(a), _c(b), lambda x, y: x * y))


def norm(a) -> Column:
    return F.sqrt(_sum(F.transform(_c(a), lambda x: x * x)))


def unit(v) -> Column:
    return _let(_c(v), lambda a: _let(norm(a), lambda n: F.transform(a, lambda x: x / F.when(n > 1e-12, n).otherwise(1e-12))))


def pairwise_disagreement(rows: DataFrame, by: str, v: str) -> DataFrame:
    """1 - mean cosine over the pairs of a group, within 0..1; 0 for a single vector.

    The sum over pairs comes from the sum of the unit vectors, (|sum|^2 - n) / 2: no pair is ever formed.
    """
    t = rows.select(by, F.posexplode(unit(v)).alias("i", "x")).groupBy(by, "i").agg(F.sum("x").alias("s"), F.count(F.lit(1)).alias("n"))
    g = t.groupBy(by).agg(F.sum(F.col("s") * F.col("s")).alias("q"), F.max("n").alias("n"))
    mean = F.try_divide(F.col("q") - F.col("n"), F.col("n") * (F.col("n") - 1))
    inside = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - mean))
    return g.select(by, "n", r6(F.when(F.col("n") < 2, 0.0).otherwise(inside), "disagreement"))


def centroid(rows: DataFrame, by: str, v: Column) -> DataFrame:
    """(by, c): the mean vector of a group."""
    t = rows.select(by, F.posexplode(v).alias("i", "x")).groupBy(by, "i").agg(F.avg("x").alias("m"))
    return t.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("c"))


def commitment(rows: DataFrame, by: str, id_col: str, v: str, tau: float) -> DataFrame:
    """Divergence of a group, whether it reaches tau, and the member next to the normalised centroid."""
    c = centroid(rows, by, unit(v)).withColumn("c", unit("c"))
    near = rows.join(c, by).withColumn("d", 1 - dot(unit(v), "c"))
    pick = near.groupBy(by).agg(F.min_by(id_col, F.struct(F.round("d", 9), id_col)).alias("selected"), r6(F.max("d"), "farthest"))
    return pairwise_disagreement(rows, by, v).join(pick, by).select(by, F.col("disagreement").alias("divergence"), (F.col("disagreement") >= tau).alias("unstable"), "selected", "farthest")


def kl_full(p, q) -> Column:
    """Dense KL divergence with 1e-10 inside the logarithm, at least 0."""
    return F.greatest(F.lit(0.0), _sum(F.zip_with(_c(p), _c(q), lambda a, b: a * (F.log(a + 1e-10) - F.log(b + 1e-10)))))


def kl_topk(ids, probs, pool_ids, pool_probs, vocabulary: int) -> Column:
    """KL divergence of two top-k lists over the union of their ids; an absent id has a share of the mass left."""

    both = F.array_union(_c(ids), _c(pool_ids))
    at = lambda i, p, k: F.when(F.array_contains(_c(i), k), F.get(_c(p), F.greatest(F.array_position(_c(i), k) - 1, F.lit(0)).cast("int"))).otherwise(F.greatest(F.lit(1e-8), 1 - _sum(_c(p))) / F.greatest(F.lit(1), F.lit(vocabulary) - F.size(_c(i))))
    pa, pb = F.transform(both, lambda k: at(ids, probs, k)), F.transform(both, lambda k: at(pool_ids, pool_probs, k))
    scaled = lambda a: _let(a, lambda x: _let(_sum(x), lambda z: F.transform(x, lambda y: y / z)))
    return F.greatest(F.lit(0.0), _sum(F.zip_with(scaled(pa), scaled(pb), lambda a, b: a * F.log(a / b))))


def sibling_kl(rows: DataFrame, by: str, id_col: str, ids: str, probs: str, vocabulary: int, clamp: float = 5.0) -> DataFrame:
    """G05 (by, id_col, kl): KL divergence of each sibling's top-k list from the pool of the others of its group, clamped.

    Over the ids of the whole group; an id that a list lacks has a share of the mass it leaves. The pool is the sum of the
    others' vectors, then normalised; windows before and after a row make it, so no pair is formed and nothing cancels. A
    lone sibling has 0; rows with an empty list take no part.
    """
    rest = F.greatest(F.lit(1e-8), 1 - _sum(F.col(probs))) / F.greatest(F.lit(1), F.lit(vocabulary) - F.size(ids))
    own = rows.select(by, id_col, rest.alias("rest"), F.explode(F.arrays_zip(F.col(ids).alias("k"), F.col(probs).alias("p"))).alias("x")).select(by, id_col, "rest", "x.k", "x.p")
    nodes, seen = own.select(by, id_col, "rest").distinct(), own.select(by, "k").distinct()
    t = nodes.join(seen, by).join(own.drop("rest"), [by, id_col, "k"], "left").withColumn("p", F.when(F.col("p").isNull(), F.col("rest")).otherwise(F.greatest("p", F.lit(1e-8))))
    w = Window.partitionBy(by, "k").orderBy(id_col)
    side = lambda a, b: F.coalesce(F.sum("p").over(w.rowsBetween(a, b)), F.lit(0.0))
    t = t.withColumn("q", side(Window.unboundedPreceding, -1) + side(1, Window.unboundedFollowing))
    g = t.groupBy(by, id_col).agg(F.sum("p").alias("z"), F.sum("q").alias("y"), F.sum(F.when(F.col("q") > 0, F.col("p") * F.log(F.col("p") / F.col("q")))).alias("a"))
    kl = F.least(F.lit(clamp), F.greatest(F.lit(0.0), F.col("a") / F.col("z") + F.log(F.col("y") / F.col("z"))))
    return g.select(by, id_col, r6(F.when(F.col("y") > 0, kl).otherwise(0.0), "kl"))


def jaccard(a, b) -> Column:
    """G05's set form: |a and b| / |a or b|, 0 for two empty sets."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(_c(a), _c(b))).cast("double"), F.size(F.array_union(_c(a), _c(b)))), F.lit(0.0))


def leave_one_out(rows: DataFrame, by: str, value: str) -> DataFrame:
    """Each row's value against the mean of the others of its group; a lone row has 0."""
    g = rows.groupBy(by).agg(F.sum(value).alias("_s"), F.count(F.lit(1)).alias("_n"))
    t = rows.join(g, by)
    return t.withColumn("others", F.coalesce(F.try_divide(F.col("_s") - F.col(value), F.col("_n") - 1), F.col(value))).withColumn("gap", F.round(F.col(value) - F.col("others"), 6)).drop("_s", "_n", "others")


def mixture(weights, vectors) -> Column:
    """The average of vectors by renormalised weights, and the spread of the weights."""
    w = _let(_c(weights), lambda a: _let(_sum(a), lambda z: F.transform(a, lambda x: x / z)))
    mixed = F.aggregate(F.zip_with(w, _c(vectors), lambda a, v: F.transform(v, lambda x: x * a)), F.array_repeat(F.lit(0.0), F.size(F.get(_c(vectors), 0))), lambda s, v: F.zip_with(s, v, lambda a, b: a + b))
    return F.struct(mixed.alias("mixed"), (F.array_max(w) - F.array_min(w)).alias("spread"))


def combined_score(reward, diversity, weight: float) -> Column:
    """G04."""
    return _c(reward) + weight * _c(diversity)

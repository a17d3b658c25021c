"""Ranking metrics, thresholds and distributions of token records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .metrics import last_wins, r6


def auroc(rows: DataFrame, score: str, label: str, by: list[str]) -> DataFrame:
    """Area under the ROC curve per group, ties with half credit, 0.5 where a class is missing.

    Distinct scores are counted first, so only as many rows as there are scores are put in order. `by` can't be empty:
    an order over all rows at once is one task.
    """
    per = rows.filter(F.col(score).isNotNull()).groupBy(*by, score).agg(F.count_if(F.col(label)).alias("p"), F.count_if(~F.col(label)).alias("q"))
    below = Window.partitionBy(*by).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    t = per.withColumn("b", F.coalesce(F.sum("q").over(below), F.lit(0)))
    g = t.groupBy(*by).agg(F.sum("p").alias("n_pos"), F.sum("q").alias("n_neg"), F.sum(F.col("p") * (F.col("b") + F.col("q") / 2.0)).alias("u"))
    return g.select(*by, "n_pos", "n_neg", r6(F.coalesce(F.try_divide(F.col("u"), F.col("n_pos").cast("double") * F.col("n_neg")), F.lit(0.5)), "auroc"))


def auc_in_order(rows: DataFrame, score: str, label: str, idx: str, by: list[str]) -> DataFrame:
    """As auroc, but ties stand in the order of idx."""
    w = Window.partitionBy(*by).orderBy(F.desc(score), idx).rowsBetween(Window.unboundedPreceding, 0)
    t = rows.withColumn("tp", F.sum(F.col(label).cast("long")).over(w))
    g = t.groupBy(*by).agg(F.sum(F.when(~F.col(label), F.col("tp")).otherwise(0)).alias("area"), F.count_if(F.col(label)).alias("p"), F.count_if(~F.col(label)).alias("q"))
    return g.select(*by, r6(F.coalesce(F.try_divide(F.col("area").cast("double"), F.col("p") * F.col("q")), F.lit(0.5)), "auc"))


def roc_points(rows: DataFrame, score: str, label: str, by: list[str]) -> DataFrame:
    """(threshold, fpr, tpr) at each distinct score, from the highest."""
    per = rows.groupBy(*by, score).agg(F.count_if(F.col(label)).alias("p"), F.count_if(~F.col(label)).alias("q"))
    run = Window.partitionBy(*by).orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*by)
    rate = lambda c: F.coalesce(F.try_divide(F.sum(c).over(run).cast("double"), F.sum(c).over(whole)), F.lit(0.0))
    return per.select(*by, F.col(score).alias("threshold"), r6(rate("q"), "fpr"), r6(rate("p"), "tpr"))


def _finite(score: str) -> Column:
    """Neither NULL, NaN nor infinite."""
    return F.coalesce(~F.isnan(score) & (F.abs(score) < float("inf")), F.lit(False))


def sweep(rows: DataFrame, score: str, label: str, lo: float, hi: float, steps: int, min_rate: float, max_rate: float, metric: str = "f1") -> DataFrame:
    """(tau, rate, precision, recall, f1, feasible, chosen) over a grid of thresholds; the lowest feasible tau of
    the best score is chosen (with metric auroc, which tau doesn't change, that is the lowest feasible one).

    One pass: scores are bucketed against the grid, and bucket sums accumulate from above.
    """
    taus = [lo + (hi - lo) * i / (steps - 1) for i in range(steps)]
    grid = rows.sparkSession.createDataFrame(list(enumerate(taus)), "i int, tau double")
    bucket = F.aggregate(F.array(*[F.lit(t) for t in taus]), F.lit(0), lambda n, t: n + (F.col(score) > t).cast("int"))
    sums = rows.filter(_finite(score)).groupBy((bucket - 1).alias("i")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(label)).alias("p"))
    totals = sums.agg(F.sum("n").alias("all_n"), F.sum("p").alias("all_p"))
    above = Window.partitionBy(F.lit(0)).orderBy(F.desc("i")).rowsBetween(Window.unboundedPreceding, 0)  # a row per grid point
    t = F.broadcast(grid).join(sums, "i", "left").withColumn("tn", F.coalesce(F.sum("n").over(above), F.lit(0))).withColumn("tp", F.coalesce(F.sum("p").over(above), F.lit(0))).crossJoin(F.broadcast(totals))
    tp, tn = F.col("tp").cast("double"), F.col("tn")
    t = t.withColumn("rate", F.coalesce(F.try_divide(tn.cast("double"), F.col("all_n")), F.lit(0.0))).withColumn("precision", tp / (tn + 1e-9)).withColumn("recall", tp / (F.col("all_p") + 1e-9))
    t = t.withColumn("f1", 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall") + 1e-9)).withColumn("feasible", F.col("rate").between(min_rate, max_rate))
    goal = {"f1": F.round("f1", 9), "precision": F.round("precision", 9), "auroc": F.lit(1.0)}[metric]
    best = F.max_by(F.when(F.col("feasible"), F.col("i")), F.when(F.col("feasible"), F.struct(goal, -F.col("i")))).over(Window.partitionBy(F.lit(0)))
    return t.select("i", r6(F.col("tau"), "tau"), r6(F.col("rate"), "rate"), r6(F.col("precision"), "precision"), r6(F.col("recall"), "recall"), r6(F.col("f1"), "f1"), "feasible", F.coalesce(F.col("i") == best, F.lit(False)).alias("chosen"))


def fallback_threshold(rows: DataFrame, score: str, label: str, none: float = 1.0) -> DataFrame:
    """R05's cases without a sweep: no rows: none; nothing finite: 1.5; one class: the median; else NULL."""
    fin = F.when(_finite(score), F.col(score))
    own = F.when(_finite(score), F.col(label))
    a = rows.agg(F.count(F.lit(1)).alias("n"), F.count(fin).alias("f"), F.min(own).alias("lo"), F.max(own).alias("hi"), F.median(fin).alias("med"))
    return a.select(F.when(F.col("n") == 0, none).when(F.col("f") == 0, 1.5).when(F.col("lo") == F.col("hi"), F.col("med")).alias("tau"))


def choose_threshold(rows: DataFrame, score: str, label: str, lo: float, hi: float, steps: int, min_rate: float, max_rate: float, metric: str = "f1", none: float = 1.0, other: float | None = None) -> DataFrame:
    """R05 R06 (tau): fallback_threshold's where it has one, else the sweep's choice, else, no tau being feasible, `other`
    (default: the median of the finite scores)."""
    chosen = sweep(rows, score, label, lo, hi, steps, min_rate, max_rate, metric).agg(F.max(F.when(F.col("chosen"), F.col("tau"))).alias("c"))
    median = rows.agg(F.median(F.when(_finite(score), F.col(score))).alias("m"))
    last = F.col("m") if other is None else F.lit(other)
    return fallback_threshold(rows, score, label, none).crossJoin(F.broadcast(chosen)).crossJoin(F.broadcast(median)).select(F.coalesce("tau", "c", last).alias("tau"))  # a row each


def compare_signals(rows: DataFrame, signals: dict[str, Column], label: str) -> DataFrame:
    """AUROC of several signals over the same rows, in one pass."""
    parts = F.array(*[F.struct(F.lit(k).alias("signal"), v.cast("double").alias("score")) for k, v in signals.items()])
    return auroc(rows.select(label, F.explode(parts).alias("x")).select(label, "x.*"), "score", label, ["signal"])


def validate_claim(tokens: DataFrame, triggered: DataFrame, order: str = "disagreement") -> DataFrame:
    """Joins zone tokens with triggered ones, AUROC of entropy, disagreement and their product on what both have. Of
    triggered rows of one token the last by `order` counts."""
    last = last_wins(triggered, ["problem_id", "position"], order)
    j = tokens.select("problem_id", "position", "entropy", "wrong").join(last.select("problem_id", "position", "disagreement"), ["problem_id", "position"])
    return compare_signals(j, {"entropy": F.col("entropy"), "disagreement": F.col("disagreement"), "product": F.col("entropy") * F.col("disagreement")}, "wrong")


def histogram(rows: DataFrame, value: str, label: str, lo: float, hi: float, n: int) -> DataFrame:
    """Counts by class and bin, and their density; the upper edge belongs to the last bin, outside values to none."""
    width = (hi - lo) / n
    b = F.least(F.floor((F.col(value) - lo) / width), F.lit(n - 1)).cast("int")
    t = rows.filter(F.col(value).between(lo, hi)).groupBy(F.col(label).alias("label"), b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return t.withColumn("density", F.round(F.col("n") / (F.sum("n").over(Window.partitionBy("label")) * width), 6))


def class_stats(rows: DataFrame, value: str, label: str, tau: float) -> DataFrame:
    """Mean by class, counts, rate above tau, percentiles."""
    v = F.col(value)
    p = F.percentile(value, F.array(*[F.lit(x) for x in (0.05, 0.25, 0.5, 0.75, 0.95)]))
    t = rows.agg(r6(F.avg(F.when(F.col(label), v)), "mean_true"), r6(F.avg(F.when(~F.col(label), v)), "mean_false"), F.count_if(F.col(label)).alias("n_true"), F.count_if(~F.col(label)).alias("n_false"), r6(F.avg((v > tau).cast("double")), "rate"), p.alias("p"))
    return t.select("mean_true", "mean_false", "n_true", "n_false", "rate", *[r6(F.get("p", i), f"p{x}") for i, x in enumerate((5, 25, 50, 75, 95))])


def low_entropy(rows: DataFrame, window: int, ceiling: float, pcts: list[int]) -> DataFrame:
    """The percentiles of early tokens' entropy and the share strictly below each."""
    t = rows.filter((F.col("position") < window) & ~F.isnan("entropy") & (F.col("entropy") < ceiling))
    tau = t.agg(F.percentile("entropy", F.array(*[F.lit(p / 100) for p in pcts])).alias("q"))
    x = t.crossJoin(F.broadcast(tau)).agg(*[F.struct(F.lit(p).alias("pct"), F.first(F.get("q", i)).alias("tau"), F.avg((F.col("entropy") < F.get("q", i)).cast("double")).alias("rate")).alias(f"x{i}") for i, p in enumerate(pcts)])
    return x.select(F.explode(F.array(*[f"x{i}" for i in range(len(pcts))])).alias("x")).select("x.pct", r6(F.col("x.tau"), "tau"), r6(F.col("x.rate"), "rate"))


def zone_stats(rows: DataFrame, tau: float) -> DataFrame:
    """Counts and trigger rates in and out of the zone, mean and median position of triggers."""
    trig = F.col("zone") & (F.col("entropy") > tau)
    t = rows.agg(F.count_if("zone").alias("n_zone"), F.count_if(~F.col("zone")).alias("n_rest"), F.count_if(trig).alias("n_trig"), r6(F.avg(F.when(trig, F.col("position"))), "mean_position"), F.median(F.when(trig, F.col("position"))).alias("median_position"), r6(F.avg(F.when(trig, F.col("entropy"))), "mean_entropy"), r6(F.avg(F.when(trig, F.col("disagreement"))), "mean_disagreement"), F.count_if(trig & F.col("correct")).alias("n_trig_correct"))
    return t.withColumn("zone_fraction", F.round(F.col("n_zone") / F.greatest(F.lit(1), F.col("n_zone") + F.col("n_rest")), 6)).withColumn("trigger_rate", F.round(F.col("n_trig") / F.greatest(F.lit(1), F.col("n_zone")), 6))


def collect_records(tokens: DataFrame, tau: float, least: int) -> DataFrame:
    """Each token with its gate (in the zone, from position `least` on, entropy above tau) and, as label of every step,
    the outcome of its problem: that of the last position."""
    final = tokens.groupBy("problem_id").agg(F.max_by("correct", "position").alias("final_correct"))
    gate = (F.col("position") >= least) & F.col("zone") & (F.col("entropy") > tau)
    return tokens.join(final, "problem_id").select("problem_id", "position", "entropy", "zone", gate.alias("entropy_triggered"), "final_correct")


def full_analysis(rows: DataFrame, tau: float) -> DataFrame:
    """zone_stats and effectiveness in one row, with the triggers a problem of each outcome."""
    t = zone_stats(rows, tau).crossJoin(F.broadcast(effectiveness(rows, tau)))  # a row each
    rate = lambda n, a, b: F.round(n / F.greatest(F.lit(1), F.col(a) + F.col(b)), 6)
    return t.withColumn("rate_in_correct", rate(F.col("n_trig_correct"), "yy", "ny")).withColumn("rate_in_incorrect", rate(F.col("n_trig") - F.col("n_trig_correct"), "yn", "nn"))


def effectiveness(rows: DataFrame, tau: float) -> DataFrame:
    """Accuracy of problems with and without an expansion."""
    per = rows.groupBy("problem_id").agg(F.bool_or(F.col("zone") & (F.col("entropy") > tau)).alias("x"), F.max_by("correct", "position").alias("ok"))
    n = lambda c: F.count_if(F.expr(c))
    t = per.agg(n("x and ok").alias("yy"), n("x and not ok").alias("yn"), n("not x and ok").alias("ny"), n("not x and not ok").alias("nn"))
    acc = lambda a, b: F.col(a) / F.greatest(F.lit(1), F.col(a) + F.col(b))
    return t.withColumn("delta", F.round(acc("yy", "yn") - acc("ny", "nn"), 6))


def capped_triggers(rows: DataFrame, tau: float, cap: int) -> DataFrame:
    """Triggers up to the cap-th of each problem."""
    return rows.filter(F.col("zone") & (F.col("entropy") > tau)).withColumn("k", F.row_number().over(Window.partitionBy("problem_id").orderBy("position"))).filter(F.col("k") <= cap).select("problem_id", "position", F.col("k").cast("long").alias("k"))


def entropy_summary(rows: DataFrame, by: str, value: str = "entropy") -> DataFrame:
    """Mean, lower median, extremes, standard deviation of the sample."""
    return rows.groupBy(by).agg(r6(F.avg(value), "mean"), r6(F.expr(f"percentile_disc(0.5) within group (order by {value})"), "lower_median"), r6(F.max(value), "high"), r6(F.min(value), "low"), r6(F.stddev_samp(value), "std"))

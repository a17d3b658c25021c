"""Accuracy, cost and budget reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def mean(flag: str | Column) -> Column:
    c = F.col(flag) if isinstance(flag, str) else flag
    return F.avg(c.cast("double"))


def r6(c: Column, name: str, places: int = 6) -> Column:
    return F.round(c, places).alias(name)


def last_wins(rows: DataFrame, by: list[str], order: str) -> DataFrame:
    """The last row of each key, as a dictionary keeps it: an aggregation, no window."""
    rest = [c for c in rows.columns if c not in by]
    return rows.groupBy(*by).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*by, "_r.*")


def aggregate(rows: DataFrame) -> DataFrame:
    """One row of totals; standard deviation of the population; boxed accuracy over rows with a box."""
    return rows.agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("correct").cast("long")).alias("n_correct"), r6(mean("correct"), "accuracy"), r6(F.avg("total_tokens"), "mean_tokens", 4),
        F.median("total_tokens").alias("median_tokens"), r6(F.stddev_pop("total_tokens"), "std_tokens", 4), r6(F.avg("wall"), "mean_wall", 4), r6(F.sum("wall"), "total_wall", 3),
        r6(F.coalesce(F.avg(F.when(F.col("has_boxed"), F.col("correct").cast("double"))), F.lit(0.0)), "boxed_accuracy"),
    )


def accuracy_by(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(dimension, value, n, accuracy) for each column, in one pass; '' is left out."""
    parts = F.array(*[F.struct(F.lit(c).alias("dimension"), F.col(c).cast("string").alias("value")) for c in columns])
    t = rows.select("correct", F.explode(parts).alias("x")).filter(F.coalesce(F.col("x.value"), F.lit("")) != "")
    return t.groupBy(F.col("x.dimension").alias("dimension"), F.col("x.value").alias("value")).agg(F.count(F.lit(1)).alias("n"), r6(mean("correct"), "accuracy"))


def method_metrics(rows: DataFrame) -> DataFrame:
    """A03 A10."""
    return rows.groupBy("method").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("correct").cast("long")).alias("n_correct"), r6(mean("correct"), "accuracy"), r6(F.avg("total_tokens"), "mean_tokens", 4), F.median("total_tokens").alias("median_tokens"), F.sum("total_tokens").alias("total_tokens"), r6(F.avg("wall"), "mean_wall", 4))


def against_baseline(metrics: DataFrame, baseline: str) -> DataFrame:
    """Differences and ratios against the baseline's row; without one, against the first method's by name."""
    pick = F.struct((F.col("method") != baseline).alias("other"), "method")
    base = metrics.agg(F.min_by("accuracy", pick).alias("ba"), F.min_by("mean_tokens", pick).alias("bt"), F.min_by("mean_wall", pick).alias("bw"))
    t = metrics.crossJoin(F.broadcast(base))  # one row
    over = lambda a, b: F.col(a) / F.greatest(F.lit(1.0), F.col(b))
    return t.select("method", r6(F.col("accuracy") - F.col("ba"), "delta"), r6(over("mean_tokens", "bt"), "token_ratio"), r6(over("mean_wall", "bw"), "wall_ratio"), r6((F.col("mean_tokens") - F.col("bt")) / F.greatest(F.lit(1.0), F.col("bt")) * 100, "overhead_pct", 4))


def pareto_curve(rows: DataFrame, points: int) -> DataFrame:
    """Accuracy of each method within each of so many budgets between the least and the largest cost.

    Rows aren't multiplied by the grid: costs are bucketed against it, and bucket sums are accumulated.
    """
    span = rows.agg(F.min("total_tokens").alias("lo"), F.max("total_tokens").alias("hi"))
    grid = span.select(F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: F.floor(F.col("lo") + (F.col("hi") - F.col("lo")) * i.cast("double") / (points - 1)).cast("long"))).alias("i", "budget"))
    grid_array = grid.agg(F.array_sort(F.collect_list("budget")).alias("g"))
    t = rows.crossJoin(F.broadcast(grid_array)).withColumn("b", F.size(F.filter("g", lambda x: x < F.col("total_tokens"))))
    sums = t.groupBy("method", "b").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("correct").cast("long")).alias("c"))
    cells = sums.select("method").distinct().crossJoin(F.broadcast(grid))
    run = Window.partitionBy("method").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    u = cells.join(sums.withColumnRenamed("b", "i"), ["method", "i"], "left").withColumn("n", F.coalesce(F.sum("n").over(run), F.lit(0))).withColumn("c", F.coalesce(F.sum("c").over(run), F.lit(0)))
    return u.select("method", "i", "budget", F.col("n").cast("long").alias("n"), r6(F.coalesce(F.try_divide(F.col("c").cast("double"), F.col("n")), F.lit(0.0)), "accuracy"))


def budget_matched(rows: DataFrame, reference: str, slack: float = 1.05) -> DataFrame:
    """Each method within slack times the reference's mean cost: all its rows if its mean fits, else those that fit."""
    cap = rows.filter(F.col("method") == reference).agg((F.avg("total_tokens") * slack).alias("cap"), F.avg("total_tokens").alias("ref")).filter("cap is not null")
    means = rows.groupBy("method").agg(F.avg("total_tokens").alias("m"))
    t = rows.join(means, "method").crossJoin(F.broadcast(cap))
    fits = (F.col("m") <= F.col("cap")) | (F.col("total_tokens") <= F.col("cap"))
    return t.groupBy("method").agg(r6(F.coalesce(F.avg(F.when(fits, F.col("correct").cast("double"))), F.lit(0.0)), "accuracy"), F.count_if(fits).alias("n_used"), r6(F.first("m") / F.greatest(F.lit(1.0), F.first("ref")), "token_ratio"))


def ablation(rows: DataFrame, means: list[str]) -> DataFrame:
    """Mean of each column by method, missing values as 0, best accuracy first."""
    t = rows.groupBy("method").agg(r6(mean("correct"), "accuracy"), *[r6(F.avg(F.coalesce(F.col(c).cast("double"), F.lit(0.0))), c, 4) for c in means])
    return t.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("accuracy"), "method")))


def difficulty(wide: DataFrame, methods: list[str]) -> DataFrame:
    """Accuracy in per cent by level and method, and over all levels; NULL outcomes are left out."""
    t = wide.unpivot(["level"], methods, "method", "ok").filter("ok is not null")
    return t.rollup("method", "level").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("ok").cast("long")).alias("c")).filter("method is not null").select("method", F.coalesce("level", F.lit("overall")).alias("level"), "n", r6(100.0 * F.col("c") / F.col("n"), "accuracy", 1))


def gain_matrix(wide: DataFrame, method: str, others: list[str]) -> DataFrame:
    """Gain of a method over others by level."""
    one = lambda m: F.avg(F.col(m).cast("double"))
    return wide.groupBy("level").agg(*[r6(F.coalesce(one(method) - one(o), F.lit(0.0)), f"over_{o}") for o in others])


def above_best(wide: DataFrame, method: str, others: list[str]) -> DataFrame:
    """What a method has above the best of the others, if anything, and its mean gain."""
    a = {m: F.avg(F.col(m).cast("double")) for m in [method, *others]}
    t = wide.groupBy("level").agg(*[v.alias(k) for k, v in a.items()])
    gain = F.col(method) - F.greatest(*others)
    return t.select("level", r6(F.when(gain > 0, gain), "advantage"), r6(sum((F.col(method) - F.col(o) for o in others), F.lit(0.0)) / len(others), "mean_gain"))


def running_accuracy(rows: DataFrame) -> DataFrame:
    """A36 W01."""
    run = Window.partitionBy("method").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    return rows.select("method", "ord", r6(F.avg(F.col("correct").cast("double")).over(run), "running"))


def paired(rows: DataFrame, a: str, b: str, least: int = 5) -> DataFrame:
    """Contingency of two methods on the problems both have, if there are `least` at least."""
    side = lambda m, c: rows.filter(F.col("method") == m).select("problem_id", F.col("correct").alias(c))
    t = side(a, "x").join(side(b, "y"), "problem_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.expr("x and y")).alias("both"), F.count_if(F.expr("x and not y")).alias("a_only"), F.count_if(F.expr("y and not x")).alias("b_only"), F.count_if(F.expr("not x and not y")).alias("neither"))
    return t.filter(F.col("n") >= least).withColumn("net", F.col("a_only") - F.col("b_only"))


def radar(metrics: DataFrame, axes: list[str]) -> DataFrame:
    """Each axis scaled to 0.05..1 over all methods."""
    w = Window.partitionBy(F.lit(0))
    span = lambda c: F.max(c).over(w) - F.min(c).over(w)
    return metrics.select("method", *[r6(0.05 + 0.95 * (F.col(c) - F.min(c).over(w)) / F.when(span(c) == 0, 1.0).otherwise(span(c)), c) for c in axes])


def bins(values: DataFrame, value: str, edges: list[tuple[str, int, int]]) -> DataFrame:
    """Counts and accuracies in closed integer bins, empty ones as zeros, values outside left out."""
    rows = values.sparkSession.createDataFrame([(i, *e) for i, e in enumerate(edges)], "i int, bin string, lo long, hi long")
    label = F.coalesce(*[F.when(F.col(value).between(lo, hi), F.lit(i)) for i, (_, lo, hi) in enumerate(edges)])
    per = values.withColumn("i", label).filter("i is not null").groupBy("i").agg(F.count(F.lit(1)).alias("n"), r6(100 * mean("correct"), "accuracy", 1))
    return F.broadcast(rows).join(per, "i", "left").select("i", "bin", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("accuracy", F.lit(0.0)).alias("accuracy"))


def entropy_bins(wide: DataFrame, edges: list[float]) -> DataFrame:
    """Gain of dad over greedy by entropy, bins (lo, hi] but the first, with the error of the mean."""
    e = F.col("entropy")
    cond = [F.when(e <= edges[1], F.lit(0)), *[F.when((e > lo) & (e <= hi), F.lit(i)) for i, (lo, hi) in enumerate(zip(edges[1:-1], edges[2:], strict=True), 1)]]
    t = wide.filter("dad is not null").withColumn("i", F.coalesce(*cond)).filter("i is not null").withColumn("g", F.col("dad").cast("double") - F.col("greedy").cast("double"))
    n = F.count(F.lit(1))
    return t.groupBy("i").agg(n.alias("n"), r6(F.avg("g") * 100, "gain", 4), r6(F.when(n > 1, F.stddev_pop("g") / F.sqrt(n) * 100).otherwise(0.0), "sem", 4), r6(mean("greedy"), "greedy"), r6(mean("majority"), "majority"), r6(mean("dad"), "dad"))


def zero_entropy(wide: DataFrame) -> DataFrame:
    """Of problems whose samples all agree: how many, greedy wrong, majority wrong, dad right."""
    return wide.filter("entropy = 0").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("greedy")).alias("greedy_wrong"), F.count_if(~F.col("majority")).alias("majority_wrong"), F.count_if("dad").alias("dad_right"))


def category(wide: DataFrame) -> DataFrame:
    """Outcome category of greedy, majority and dad, with share and mean rounds. The order of the cases matters."""
    g, m, d = F.col("greedy"), F.col("majority"), F.coalesce(F.col("dad"), F.lit(False))
    label = F.when(g & m & d, "A").when(~g & ~m & ~d, "D").when(d & ~m, "C").when(m & ~d, "E").when(~g & m & d, "B").otherwise("G")
    t = wide.withColumn("category", label).groupBy("category").agg(F.count(F.lit(1)).alias("n"), r6(F.coalesce(F.avg(F.when(F.col("rounds") > 0, F.col("rounds"))), F.lit(0.0)), "mean_rounds"), F.min("problem_id").alias("first_id"))
    return t.withColumn("fraction", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))), 6))


def convergence(rounds: DataFrame) -> DataFrame:
    """Entropy and confidence by round, for all runs and split by outcome."""
    t = rounds.rollup("round", "correct").agg(F.grouping("correct").alias("all_"), F.count(F.lit(1)).alias("n_active"), r6(F.avg("entropy"), "mean_entropy"), r6(F.median("entropy"), "median_entropy"), r6(F.stddev_pop("entropy"), "std_entropy"), r6(F.avg("confidence"), "mean_confidence"), r6(F.median("confidence"), "median_confidence"))
    return t.filter("round is not null").select("round", F.when(F.col("all_") == 1, "all").when(F.col("correct"), "correct").otherwise("wrong").alias("grp"), "n_active", "mean_entropy", "median_entropy", "std_entropy", "mean_confidence", "median_confidence")

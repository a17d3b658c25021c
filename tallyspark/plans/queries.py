"""Registered queries of the engine's own operators, each with DuckDB SQL for the same rows. Names begin with the ids of
the operators in the inventory."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import answers as A
from ..operators import calibration as C
from ..operators import claims as CL
from ..operators import metrics as M
from ..operators import tree as T
from ..operators import vectors as V
from ..operators import voting as Q
from . import bridge as B

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None, *views: str):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = (f"WITH {', '.join(views)} " if views else "") + sql
        return f

    return add


DEDUP = "bl AS (SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY problem_id, method ORDER BY ord DESC) AS k FROM b1) WHERE k = 1)"
METRICS = "mm AS (SELECT method, count(*) AS n, round(avg(correct::INT), 6) AS accuracy, round(avg(total_tokens), 4) AS mean_tokens, round(avg(wall), 4) AS mean_wall FROM bl GROUP BY method)"


def _results(s, d):
    return M.last_wins(B.results(s, d), ["problem_id", "method"], "ord")


# ---- votes


def _vote_sql(key="answer", weight="1", rep="min(sample_idx)", where="", cast="BIGINT"):
    return f"""SELECT problem_id, k AS winner, {"round(w, 6)" if cast == "DOUBLE" else f"w::{cast}"} AS support, n_votes::BIGINT AS n_votes, n_keys::BIGINT AS n_keys, rep AS rep_idx FROM (
      SELECT *, sum(n) OVER (PARTITION BY problem_id) AS n_votes, count(*) OVER (PARTITION BY problem_id) AS n_keys,
        row_number() OVER (PARTITION BY problem_id ORDER BY w DESC, first) AS r
      FROM (SELECT problem_id, {key} AS k, sum({weight}) AS w, min(sample_idx) AS first, count(*) AS n, {rep} AS rep FROM b2 {where} GROUP BY ALL)) WHERE r = 1"""


@query("v01_majority_vote", _vote_sql(), B.SAMPLES)
def v01(s, d):
    return Q.vote(B.samples(s, d))


_MUTE = " UNION ALL SELECT problem_id, arg_max({{'a': answer}}, {0}).a, 0, 0, 0, arg_max(sample_idx, {0}) FROM b2 GROUP BY problem_id HAVING count(nullif(answer, '')) = 0"  # problems without a vote


@query("v02_longest_representative", _vote_sql(rep="arg_max(sample_idx, {'l': length(text), 'i': -sample_idx})", where="WHERE answer <> ''") + _MUTE.format("sample_idx"), B.SAMPLES)
def v02(s, d):
    return Q.vote(B.samples(s, d), representative=F.length("text"), skip_blank=True)


_CENTS = "round(reward * 100)::BIGINT"


@query("v03_weighted_vote", _vote_sql(weight=_CENTS, rep="arg_max(sample_idx, {'r': reward, 'i': -sample_idx})"), B.SAMPLES)
def v03(s, d):
    return Q.vote(B.samples(s, d), weight=F.round(F.col("reward") * 100).cast("long"), representative=F.col("reward"))


@query("v04_majority_best_reward", _vote_sql(rep="arg_max(sample_idx, {'r': reward, 'i': -sample_idx})"), B.SAMPLES)
def v04(s, d):
    return Q.vote(B.samples(s, d), representative=F.col("reward"))


@query("v05_sampling_vote", _vote_sql(weight=_CENTS, rep="arg_max(sample_idx, {'r': reward, 'i': -sample_idx})", where="WHERE answer <> ''") + _MUTE.format("{'r': reward, 'i': -sample_idx}"), B.SAMPLES)
def v05(s, d):
    return Q.vote(B.samples(s, d), weight=F.round(F.col("reward") * 100).cast("long"), representative=F.col("reward"), skip_blank=True, fallback=F.col("reward"))


@query("v06_best_reward", "SELECT problem_id, max(reward) AS best, arg_max(sample_idx, {'r': reward, 'i': -sample_idx}) AS rep_idx FROM b2 GROUP BY problem_id", B.SAMPLES)
def v06(s, d):
    return Q.best_reward(B.samples(s, d))


@query("v07_vote_over_prefix", _vote_sql(where="WHERE sample_idx < 3"), B.SAMPLES)
def v07(s, d):
    return Q.vote(B.samples(s, d).filter("sample_idx < 3"))


@query("v11_pass_at_k", "SELECT problem_id, coalesce(bool_or(answer = gold AND sample_idx < 1), false) AS pass_1, coalesce(bool_or(answer = gold AND sample_idx < 4), false) AS pass_4 FROM b2 JOIN (SELECT o_orderkey AS problem_id, (o_custkey % 5)::VARCHAR AS gold FROM orders) USING (problem_id) GROUP BY problem_id", B.SAMPLES)
def v11(s, d):
    gold = B.table(s, d, "orders").selectExpr("o_orderkey problem_id", "cast(o_custkey % 5 as string) gold")
    return Q.pass_at_k(B.samples(s, d), gold, [1, 4])


@query("d02_answer_distribution", "SELECT problem_id, answer, count(*) AS n FROM b2 GROUP BY ALL", B.SAMPLES)
def d02(s, d):
    return Q.distribution(B.samples(s, d))


@query(
    "d07_disagreement_map",
    """SELECT problem_id, sum(n)::BIGINT AS total, max(n) AS majority_count, arg_max(answer, {'n': n, 'i': -first}) AS majority, count(*) AS n_distinct,
       round(greatest(log2(sum(n)) - sum(n * log2(n)) / sum(n), 0), 6) AS entropy, round(max(n) / sum(n), 6) AS fraction,
       round(max(n) / sum(n) / (1 + greatest(log2(sum(n)) - sum(n * log2(n)) / sum(n), 0)), 6) AS confidence
       FROM (SELECT problem_id, answer, count(*) AS n, min(sample_idx) AS first FROM b2 GROUP BY ALL) GROUP BY problem_id""",
    B.SAMPLES,
)
def d07(s, d):
    t = Q.disagreement(B.samples(s, d))
    return t.withColumns({c: F.round(c, 6) for c in ("entropy", "fraction", "confidence")})


@query("d09_round_stop", "SELECT problem_id, coalesce(min(CASE WHEN round >= 2 AND confidence >= 0.2 THEN round END), max(round)) AS last_round FROM b6 GROUP BY problem_id", B.ROUNDS)
def d09(s, d):
    return Q.first_stop(B.rounds(s, d), 0.2)


# ---- metrics


@query("a01_aggregate_metrics", "SELECT count(*) AS n, sum(correct::INT)::BIGINT AS n_correct, round(avg(correct::INT), 6) AS accuracy, round(avg(total_tokens), 4) AS mean_tokens, median(total_tokens) AS median_tokens, round(stddev_pop(total_tokens), 4) AS std_tokens, round(avg(wall), 4) AS mean_wall, round(sum(wall), 3) AS total_wall, round(coalesce(avg(correct::INT) FILTER (has_boxed), 0), 6) AS boxed_accuracy FROM bl", B.RESULTS, DEDUP)
def a01(s, d):
    return M.aggregate(_results(s, d))


@query("a02_accuracy_by_level_and_type", "SELECT 'level' AS dimension, level AS value, count(*) AS n, round(avg(correct::INT), 6) AS accuracy FROM bl GROUP BY level UNION ALL SELECT 'ptype', ptype, count(*), round(avg(correct::INT), 6) FROM bl GROUP BY ptype", B.RESULTS, DEDUP)
def a02(s, d):
    return M.accuracy_by(_results(s, d), ["level", "ptype"])


@query("a03_method_metrics", "SELECT method, count(*) AS n, sum(correct::INT)::BIGINT AS n_correct, round(avg(correct::INT), 6) AS accuracy, round(avg(total_tokens), 4) AS mean_tokens, median(total_tokens) AS median_tokens, sum(total_tokens)::BIGINT AS total_tokens, round(avg(wall), 4) AS mean_wall FROM bl GROUP BY method", B.RESULTS, DEDUP)
def a03(s, d):
    return M.method_metrics(_results(s, d))


@query("a04_against_baseline", "SELECT m.method, round(m.accuracy - b.accuracy, 6) AS delta, round(m.mean_tokens / greatest(1.0, b.mean_tokens), 6) AS token_ratio, round(m.mean_wall / greatest(1.0, b.mean_wall), 6) AS wall_ratio, round((m.mean_tokens - b.mean_tokens) / greatest(1.0, b.mean_tokens) * 100, 4) AS overhead_pct FROM mm m, (SELECT * FROM mm WHERE method = '3-MEDIUM') b", B.RESULTS, DEDUP, METRICS)
def a04(s, d):
    return M.against_baseline(M.method_metrics(_results(s, d)), "3-MEDIUM")


@query("a07_pareto_curve", "SELECT method, i::INT AS i, budget, count(*) FILTER (total_tokens <= budget) AS n, round(coalesce(avg(correct::INT) FILTER (total_tokens <= budget), 0), 6) AS accuracy FROM bl, (SELECT i, floor(lo + (hi - lo) * i::DOUBLE / 19)::BIGINT AS budget FROM (SELECT min(total_tokens) AS lo, max(total_tokens) AS hi FROM bl), range(20) r(i)) GROUP BY ALL", B.RESULTS, DEDUP)
def a07(s, d):
    return M.pareto_curve(_results(s, d), 20)


@query("a08_budget_matched", "SELECT method, round(coalesce(avg(correct::INT) FILTER (m <= cap OR total_tokens <= cap), 0), 6) AS accuracy, count(*) FILTER (m <= cap OR total_tokens <= cap) AS n_used, round(any_value(m) / greatest(1.0, any_value(ref)), 6) AS token_ratio FROM (SELECT *, avg(total_tokens) OVER (PARTITION BY method) AS m FROM bl), (SELECT avg(total_tokens) * 1.05::DOUBLE AS cap, avg(total_tokens) AS ref FROM bl WHERE method = '1-URGENT') GROUP BY method", B.RESULTS, DEDUP)
def a08(s, d):
    return M.budget_matched(_results(s, d), "1-URGENT")


@query("a09_ablation_table", "SELECT *, row_number() OVER (ORDER BY accuracy DESC, method)::INT AS rank FROM (SELECT method, round(avg(correct::INT), 6) AS accuracy, round(avg(total_tokens), 4) AS total_tokens, round(avg(wall), 4) AS wall FROM bl GROUP BY method)", B.RESULTS, DEDUP)
def a09(s, d):
    return M.ablation(_results(s, d), ["total_tokens", "wall"])


@query("a11_difficulty_breakdown", "SELECT method, coalesce(level, 'overall') AS level, count(*) AS n, round(100.0 * sum(ok::INT) / count(*), 1)::DOUBLE AS accuracy FROM (SELECT level, 'greedy' AS method, greedy AS ok FROM b9 UNION ALL SELECT level, 'majority', majority FROM b9 UNION ALL SELECT level, 'dad', dad FROM b9) WHERE ok IS NOT NULL GROUP BY GROUPING SETS ((method, level), (method))", B.WIDE)
def a11(s, d):
    return M.difficulty(B.wide(s, d), ["greedy", "majority", "dad"])


@query("a14_trigger_and_zone_stats", "SELECT *, round(n_zone / greatest(1, n_zone + n_rest), 6) AS zone_fraction, round(n_trig / greatest(1, n_zone), 6) AS trigger_rate FROM (SELECT count(*) FILTER (zone) AS n_zone, count(*) FILTER (NOT zone) AS n_rest, count(*) FILTER (g) AS n_trig, round(avg(position) FILTER (g), 6) AS mean_position, median(position) FILTER (g) AS median_position, round(avg(entropy) FILTER (g), 6) AS mean_entropy, round(avg(disagreement) FILTER (g), 6) AS mean_disagreement, count(*) FILTER (g AND correct) AS n_trig_correct FROM (SELECT *, zone AND entropy > 1.0 AS g FROM b3))", B.TOKENS)
def a14(s, d):
    return C.zone_stats(B.tokens(s, d), 1.0)


@query("a15_expansion_effectiveness", "SELECT yy, yn, ny, nn, round(yy / greatest(1, yy + yn) - ny / greatest(1, ny + nn), 6) AS delta FROM (SELECT count(*) FILTER (x AND ok) AS yy, count(*) FILTER (x AND NOT ok) AS yn, count(*) FILTER (NOT x AND ok) AS ny, count(*) FILTER (NOT x AND NOT ok) AS nn FROM (SELECT problem_id, bool_or(zone AND entropy > 3.0) AS x, arg_max(correct, position) AS ok FROM b3 GROUP BY problem_id))", B.TOKENS)
def a15(s, d):
    return C.effectiveness(B.tokens(s, d), 3.0)


@query("a18_convergence", "SELECT round, CASE WHEN grouping(correct) = 1 THEN 'all' WHEN correct THEN 'correct' ELSE 'wrong' END AS grp, count(*) AS n_active, round(avg(entropy), 6) AS mean_entropy, round(median(entropy), 6) AS median_entropy, round(stddev_pop(entropy), 6) AS std_entropy, round(avg(confidence), 6) AS mean_confidence, round(median(confidence), 6) AS median_confidence FROM b6 GROUP BY GROUPING SETS ((round, correct), (round))", B.ROUNDS)
def a18(s, d):
    return M.convergence(B.rounds(s, d))


@query("a21_category_table", "SELECT category, n, mean_rounds, first_id, round(n / sum(n) OVER (), 6) AS fraction FROM (SELECT CASE WHEN greedy AND majority AND x THEN 'A' WHEN NOT greedy AND NOT majority AND NOT x THEN 'D' WHEN x AND NOT majority THEN 'C' WHEN majority AND NOT x THEN 'E' WHEN NOT greedy AND majority AND x THEN 'B' ELSE 'G' END AS category, count(*) AS n, round(coalesce(avg(rounds) FILTER (rounds > 0), 0), 6) AS mean_rounds, min(problem_id) AS first_id FROM (SELECT *, coalesce(dad, false) AS x FROM b9) GROUP BY category)", B.WIDE)
def a21(s, d):
    return M.category(B.wide(s, d))


_D1 = [("0", 0, 0), ("1-3", 1, 3), ("4-7", 4, 7), ("8-15", 8, 15), ("16+", 16, 10**9)]


@query("a22_disputed_bins", "SELECT i::INT AS i, bin, coalesce(n, 0) AS n, coalesce(accuracy, 0) AS accuracy FROM (VALUES (0, '0'), (1, '1-3'), (2, '4-7'), (3, '8-15'), (4, '16+')) b(i, bin) LEFT JOIN (SELECT CASE WHEN d1 = 0 THEN 0 WHEN d1 <= 3 THEN 1 WHEN d1 <= 7 THEN 2 WHEN d1 <= 15 THEN 3 ELSE 4 END AS i, count(*) AS n, round(100 * avg(greedy::INT), 1) AS accuracy FROM b9 WHERE d1 >= 0 GROUP BY 1) USING (i)", B.WIDE)
def a22(s, d):
    return M.bins(B.wide(s, d).withColumn("correct", F.col("greedy")), "d1", _D1)


@query("a23_entropy_bins", "SELECT i::INT AS i, count(*) AS n, round(avg(g) * 100, 4) AS gain, round(CASE WHEN count(*) > 1 THEN stddev_pop(g) / sqrt(count(*)) * 100 ELSE 0 END, 4) AS sem, round(avg(greedy::INT), 6) AS greedy, round(avg(majority::INT), 6) AS majority, round(avg(dad::INT), 6) AS dad FROM (SELECT *, dad::INT - greedy::INT AS g, CASE WHEN entropy <= .001 THEN 0 WHEN entropy <= .5 THEN 1 WHEN entropy <= 1 THEN 2 WHEN entropy <= 1.5 THEN 3 WHEN entropy <= 2 THEN 4 WHEN entropy <= 3.5 THEN 5 END AS i FROM b9 WHERE dad IS NOT NULL) WHERE i IS NOT NULL GROUP BY i", B.WIDE)
def a23(s, d):
    return M.entropy_bins(B.wide(s, d), [0, 0.001, 0.5, 1.0, 1.5, 2.0, 3.5])


@query("a26_zero_entropy", "SELECT count(*) AS n, count(*) FILTER (NOT greedy) AS greedy_wrong, count(*) FILTER (NOT majority) AS majority_wrong, count(*) FILTER (dad) AS dad_right FROM b9 WHERE entropy = 0", B.WIDE)
def a26(s, d):
    return M.zero_entropy(B.wide(s, d))


@query("a27_token_entropy_summary", "SELECT problem_id, round(avg(entropy), 6) AS mean, round(quantile_disc(entropy, 0.5), 6) AS lower_median, round(max(entropy), 6) AS high, round(min(entropy), 6) AS low, round(stddev_samp(entropy), 6) AS std FROM b3 GROUP BY problem_id", B.TOKENS)
def a27(s, d):
    return C.entropy_summary(B.tokens(s, d), "problem_id")


@query("a29_main_table", "SELECT method, row_number() OVER (ORDER BY CASE method WHEN '3-MEDIUM' THEN 0 WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 ELSE 99 END, method)::INT AS place, accuracy FROM mm", B.RESULTS, DEDUP, METRICS)
def a29(s, d):
    place = F.when(F.col("method") == "3-MEDIUM", 0).when(F.col("method") == "1-URGENT", 1).when(F.col("method") == "2-HIGH", 2).otherwise(99)
    return M.method_metrics(_results(s, d)).select("method", F.row_number().over(Window.orderBy(place, "method")).alias("place"), "accuracy")


@query("a30_entropy_histogram", "SELECT *, round(n / (sum(n) OVER (PARTITION BY label) * 0.1), 6) AS density FROM (SELECT correct AS label, least(floor(entropy / 0.1), 49)::INT AS bin, count(*) AS n FROM b3 WHERE entropy BETWEEN 0 AND 5 GROUP BY ALL)", B.TOKENS)
def a30(s, d):
    return C.histogram(B.tokens(s, d), "entropy", "correct", 0.0, 5.0, 50)


@query("a31_class_statistics", "SELECT round(avg(entropy) FILTER (correct), 6) AS mean_true, round(avg(entropy) FILTER (NOT correct), 6) AS mean_false, count(*) FILTER (correct) AS n_true, count(*) FILTER (NOT correct) AS n_false, round(avg((entropy > 1.5)::INT), 6) AS rate, round(quantile_cont(entropy, .05), 6) AS p5, round(quantile_cont(entropy, .25), 6) AS p25, round(quantile_cont(entropy, .5), 6) AS p50, round(quantile_cont(entropy, .75), 6) AS p75, round(quantile_cont(entropy, .95), 6) AS p95 FROM b3", B.TOKENS)
def a31(s, d):
    return C.class_stats(B.tokens(s, d), "entropy", "correct", 1.5)


@query("a32_low_entropy_threshold", "SELECT pct::INT AS pct, round(tau, 6) AS tau, round((SELECT avg((entropy < tau)::INT) FROM b3 WHERE position < 40 AND entropy < 15), 6) AS rate FROM (SELECT unnest([5, 20, 50]) AS pct, unnest(quantile_cont(entropy, [.05, .2, .5])) AS tau FROM b3 WHERE position < 40 AND entropy < 15)", B.TOKENS)
def a32(s, d):
    return C.low_entropy(B.tokens(s, d), 40, 15.0, [5, 20, 50])


@query("a33_radar", "SELECT method, round(0.05 + 0.95 * (accuracy - min(accuracy) OVER ()) / CASE WHEN max(accuracy) OVER () = min(accuracy) OVER () THEN 1 ELSE max(accuracy) OVER () - min(accuracy) OVER () END, 6) AS accuracy, round(0.05 + 0.95 * (mean_tokens - min(mean_tokens) OVER ()) / CASE WHEN max(mean_tokens) OVER () = min(mean_tokens) OVER () THEN 1 ELSE max(mean_tokens) OVER () - min(mean_tokens) OVER () END, 6) AS mean_tokens FROM mm", B.RESULTS, DEDUP, METRICS)
def a33(s, d):
    return M.radar(M.method_metrics(_results(s, d)), ["accuracy", "mean_tokens"])


@query("a34_family_points", "SELECT split_part(method, '-', 1) AS family, method, round(accuracy * 100, 4) AS acc, round(mean_tokens / 1000, 6) AS kilo, row_number() OVER (PARTITION BY split_part(method, '-', 1) ORDER BY mean_tokens, method)::INT AS place FROM mm", B.RESULTS, DEDUP, METRICS)
def a34(s, d):
    t = M.method_metrics(_results(s, d)).withColumn("family", F.substring_index("method", "-", 1))
    return t.select("family", "method", F.round(F.col("accuracy") * 100, 4).alias("acc"), F.round(F.col("mean_tokens") / 1000, 6).alias("kilo"), F.row_number().over(Window.partitionBy("family").orderBy("mean_tokens", "method")).alias("place"))


@query("a35_gain_matrix", "SELECT level, round(coalesce(avg(dad::INT) - avg(greedy::INT), 0), 6) AS over_greedy, round(coalesce(avg(dad::INT) - avg(majority::INT), 0), 6) AS over_majority FROM b9 GROUP BY level", B.WIDE)
def a35(s, d):
    return M.gain_matrix(B.wide(s, d), "dad", ["greedy", "majority"])


@query("a36_running_accuracy", "SELECT method, ord, round(avg(correct::INT) OVER (PARTITION BY method ORDER BY ord ROWS UNBOUNDED PRECEDING), 6) AS running FROM b1", B.RESULTS)
def a36(s, d):
    return M.running_accuracy(B.results(s, d))


@query("a38_advantage", "SELECT level, round(CASE WHEN d > greatest(g, m) THEN d - greatest(g, m) END, 6) AS advantage, round((d - g + d - m) / 2, 6) AS mean_gain FROM (SELECT level, avg(dad::INT) AS d, avg(greedy::INT) AS g, avg(majority::INT) AS m FROM b9 GROUP BY level)", B.WIDE)
def a38(s, d):
    return M.above_best(B.wide(s, d), "dad", ["greedy", "majority"])


# ---- ranking and calibration


def _auc_sql(rows: str, by: str) -> str:
    return f"SELECT {by}, sum(label::INT)::BIGINT AS n_pos, sum((NOT label)::INT)::BIGINT AS n_neg, round(coalesce((sum(CASE WHEN label THEN r END) - sum(label::INT) * (sum(label::INT) + 1) / 2) / nullif(sum(label::INT) * sum((NOT label)::INT), 0), 0.5), 6) AS auroc FROM (SELECT {by}, label, avg(k) OVER (PARTITION BY {by}, score) AS r FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY score) AS k FROM ({rows}))) GROUP BY {by}"


@query("r01_auroc", _auc_sql("SELECT event_type, NOT correct AS label, entropy AS score FROM b3", "event_type"), B.TOKENS)
def r01(s, d):
    return C.auroc(B.tokens(s, d).withColumn("wrong", ~F.col("correct")), "entropy", "wrong", ["event_type"])


@query("r01_auroc_quality", _auc_sql("SELECT 1 AS grp, score, label FROM b8", "grp"), B.QUALITY)
def r01q(s, d):
    return C.auroc(B.quality(s, d).withColumn("grp", F.lit(1)), "score", "label", ["grp"])


@query("r02_auc_input_order", "SELECT problem_id, round(coalesce(sum(CASE WHEN correct THEN 0 ELSE tp END) / nullif(sum(correct::INT) * sum((NOT correct)::INT), 0), 0.5), 6) AS auc FROM (SELECT *, sum(correct::INT) OVER (PARTITION BY problem_id ORDER BY disagreement DESC, position ROWS UNBOUNDED PRECEDING) AS tp FROM b3) GROUP BY problem_id", B.TOKENS)
def r02(s, d):
    return C.auc_in_order(B.tokens(s, d), "disagreement", "correct", "position", ["problem_id"])


@query("r03_roc_points", "SELECT event_type, threshold, round(coalesce(sum(q) OVER (PARTITION BY event_type ORDER BY threshold DESC) / nullif(sum(q) OVER (PARTITION BY event_type), 0), 0), 6) AS fpr, round(coalesce(sum(p) OVER (PARTITION BY event_type ORDER BY threshold DESC) / nullif(sum(p) OVER (PARTITION BY event_type), 0), 0), 6) AS tpr FROM (SELECT event_type, disagreement AS threshold, sum(correct::INT) AS p, sum((NOT correct)::INT) AS q FROM b3 GROUP BY ALL)", B.TOKENS)
def r03(s, d):
    return C.roc_points(B.tokens(s, d), "disagreement", "correct", ["event_type"])


def _sweep_sql(rows: str, lo: float, hi: float, steps: int, least: float, most: float, goal: str) -> str:
    return f"""SELECT i, round(tau, 6) AS tau, round(rate, 6) AS rate, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, feasible,
      coalesce(i = first_value(CASE WHEN feasible THEN i END) OVER (ORDER BY feasible DESC, {goal} DESC, i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), false) AS chosen
      FROM (SELECT *, 2 * precision * recall / (precision + recall + 1e-9::DOUBLE) AS f1, rate BETWEEN {least} AND {most} AS feasible
      FROM (SELECT i::INT AS i, tau, count(*) FILTER (score > tau) / count(*) AS rate, count(*) FILTER (score > tau AND label) / (count(*) FILTER (score > tau) + 1e-9::DOUBLE) AS precision, count(*) FILTER (score > tau AND label) / (count(*) FILTER (label) + 1e-9::DOUBLE) AS recall
      FROM ({rows}), (SELECT i, {lo}::DOUBLE + ({hi}::DOUBLE - {lo}::DOUBLE) * i / {steps - 1} AS tau FROM range({steps}) r(i)) GROUP BY ALL))"""


@query("r05_entropy_threshold_sweep", _sweep_sql("SELECT entropy AS score, NOT correct AS label FROM b3 WHERE zone", 0.1, 4.0, 20, 0.005, 0.8, "round(f1, 9)"), B.TOKENS)
def r05(s, d):
    return C.sweep(B.tokens(s, d).filter("zone").withColumn("wrong", ~F.col("correct")), "entropy", "wrong", 0.1, 4.0, 20, 0.005, 0.8)


@query("r06_disagreement_threshold_sweep", _sweep_sql("SELECT disagreement AS score, NOT correct AS label FROM b3 WHERE zone AND entropy > 0.8", 0.055, 0.955, 20, 0.005, 0.6, "1"), B.TOKENS)
def r06(s, d):
    rows = B.tokens(s, d).filter("zone and entropy > 0.8D").withColumn("wrong", ~F.col("correct"))
    return C.sweep(rows, "disagreement", "wrong", 0.055, 0.955, 20, 0.005, 0.6, metric="auroc")


_SIGNALS = "SELECT 'entropy' AS signal, entropy AS score, NOT correct AS label FROM b3 WHERE zone UNION ALL SELECT 'margin', -margin, NOT correct FROM b3 WHERE zone UNION ALL SELECT 'top1', -top1, NOT correct FROM b3 WHERE zone"


@query("r07_compare_signals", _auc_sql(_SIGNALS, "signal"), B.TOKENS)
def r07(s, d):
    rows = B.tokens(s, d).filter("zone").withColumn("wrong", ~F.col("correct"))
    return C.compare_signals(rows, {"entropy": F.col("entropy"), "margin": -F.col("margin"), "top1": -F.col("top1")}, "wrong")


_JOINED = "j AS (SELECT entropy, disagreement, NOT correct AS label FROM b3 WHERE zone AND entropy > 0.8::DOUBLE)"


@query("r08_claim_validation", _auc_sql("SELECT 'entropy' AS signal, entropy AS score, label FROM j UNION ALL SELECT 'disagreement', disagreement, label FROM j UNION ALL SELECT 'product', entropy * disagreement, label FROM j", "signal"), B.TOKENS, _JOINED)
def r08(s, d):
    t = B.tokens(s, d).filter("zone").withColumn("wrong", ~F.col("correct"))
    return C.validate_claim(t, t.filter("entropy > 0.8D"))


@query("w02_capped_triggers", "SELECT problem_id, position, k FROM (SELECT problem_id, position, row_number() OVER (PARTITION BY problem_id ORDER BY position) AS k FROM b3 WHERE zone AND entropy > 1) WHERE k <= 8", B.TOKENS)
def w02(s, d):
    return C.capped_triggers(B.tokens(s, d), 1.0, 8)


# ---- vectors


_SOFT = "sm AS (SELECT vec_id, list_transform(v, lambda x: exp(x - list_max(v))) AS e FROM b4), sp AS (SELECT vec_id, list_reverse_sort(list_transform(e, lambda x: x / list_sum(e))) AS p FROM sm)"


@query("e01_logit_records", "SELECT vec_id, round(list_sum(list_transform(p, lambda x: CASE WHEN x > 0 THEN -x * ln(x) ELSE 0 END)), 6) AS entropy, round(p[1] - p[2], 6) AS margin, round(p[1], 6) AS top1, round(p[3], 6) AS third FROM sp", B.VECTORS, _SOFT)
def e01(s, d):
    t = B.vectors(s, d)
    return t.select("vec_id", F.round(V.entropy_nats("v"), 6).alias("entropy"), F.round(V.logit_margin("v"), 6).alias("margin"), F.round(F.get(V.top_probs("v", 3), 0), 6).alias("top1"), F.round(F.get(V.top_probs("v", 3), 2), 6).alias("third"))


@query("e07_pairwise_disagreement", "SELECT c.grp, c.n, round(coalesce(greatest(0, least(1, 1 - m)), 0), 6) AS disagreement FROM (SELECT grp, count(*) AS n FROM b4 GROUP BY grp) c LEFT JOIN (SELECT a.grp, avg(list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v)) / sqrt(list_dot_product(b.v, b.v))) AS m FROM b4 a JOIN b4 b ON a.grp = b.grp AND a.vec_id < b.vec_id GROUP BY a.grp) p ON p.grp = c.grp", B.VECTORS)
def e07(s, d):
    return V.pairwise_disagreement(B.vectors(s, d), "grp", "v")


@query(
    "e09_commitment_probe",
    """SELECT grp, divergence, divergence >= 0.5 AS unstable, selected, farthest FROM (SELECT grp, arg_min(vec_id, {'d': round(d, 9), 'i': vec_id}) AS selected, round(max(d), 6) AS farthest FROM near GROUP BY grp)
    JOIN (SELECT x.grp, round(coalesce(greatest(0, least(1, 1 - avg(list_dot_product(x.u, y.u)))), 0), 6) AS divergence FROM un x LEFT JOIN un y ON x.grp = y.grp AND x.vec_id < y.vec_id GROUP BY x.grp) USING (grp)""",
    B.VECTORS,
    "un AS (SELECT vec_id, grp, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS u FROM b4)",
    "ce AS (SELECT grp, list(m ORDER BY i) AS c FROM (SELECT grp, i, avg(x) AS m FROM (SELECT grp, unnest(u) AS x, unnest(range(len(u))) AS i FROM un) GROUP BY grp, i) GROUP BY grp)",
    "near AS (SELECT grp, vec_id, 1 - list_dot_product(u, c) / sqrt(list_dot_product(c, c)) AS d FROM un JOIN ce USING (grp))",
)
def e09(s, d):
    return V.commitment(B.vectors(s, d), "grp", "vec_id", "v", 0.5)


@query("g02_kl_to_next", "SELECT x.vec_id, round(greatest(0, list_sum(list_transform(range(1, len(x.q) + 1), lambda i: x.q[i] * (ln(x.q[i] + 1e-10::DOUBLE) - ln(y.q[i] + 1e-10::DOUBLE))))), 6) AS kl FROM sq x JOIN sq y ON y.vec_id = x.vec_id + 1", B.VECTORS, "sm AS (SELECT vec_id, list_transform(v, lambda x: exp(x - list_max(v))) AS e FROM b4), sq AS (SELECT vec_id, list_transform(e, lambda x: x / list_sum(e)) AS q FROM sm)")
def g02(s, d):
    t = B.vectors(s, d).select("vec_id", V.softmax("v").alias("p"))
    u = t.select((F.col("vec_id") - 1).alias("vec_id"), F.col("p").alias("q"))
    return t.join(u, "vec_id").select("vec_id", F.round(V.kl_full("p", "q"), 6).alias("kl"))


@query("g05_sibling_gap", "SELECT tree_id, node_id, round(CASE WHEN n < 2 THEN 0 ELSE abs(reward - (s - reward) / (n - 1)) END, 6) AS gap FROM (SELECT *, sum(reward) OVER (PARTITION BY tree_id, parent_id) AS s, count(*) OVER (PARTITION BY tree_id, parent_id) AS n FROM b5 WHERE parent_id IS NOT NULL AND NOT terminal)", B.TREE)
def g05(s, d):
    return T.sibling_diversity(B.tree(s, d), "reward")


# ---- trees


_WALK = "walk AS (SELECT tree_id, node_id, 0 AS depth, node_id::VARCHAR AS path FROM b5 WHERE parent_id IS NULL UNION ALL SELECT n.tree_id, n.node_id, w.depth + 1, w.path || '>' || n.node_id FROM walk w JOIN b5 n ON n.tree_id = w.tree_id AND n.parent_id = w.node_id)"


@query("t01_children", "SELECT tree_id, parent_id AS node_id, count(*) AS n_children FROM b5 WHERE parent_id IS NOT NULL GROUP BY ALL", B.TREE)
def t01(s, d):
    return T.children(B.tree(s, d))


@query("t04_paths", f"RECURSIVE {B.TREE}, {_WALK} SELECT * FROM walk")
def t04(s, d):
    return T.paths(B.tree(s, d))


@query("t02_open_at_depth", f"RECURSIVE {B.TREE}, {_WALK} SELECT walk.* FROM walk JOIN b5 USING (tree_id, node_id) WHERE depth = 1 AND NOT terminal")
def t02(s, d):
    return T.at_depth(B.tree(s, d), 1)


@query("t06_top_children", "SELECT tree_id, parent_id, node_id, score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY tree_id, parent_id ORDER BY score DESC, node_id) AS rank FROM (SELECT *, round(reward + 0.5::DOUBLE * diversity, 6) AS score FROM b5 WHERE parent_id IS NOT NULL)) WHERE rank <= 1", B.TREE)
def t06(s, d):
    return T.top_children(B.tree(s, d), 1, 0.5)


@query("t08_solution_reward", f"RECURSIVE {B.TREE}, {_WALK}, lf AS (SELECT tree_id, node_id AS leaf, unnest(string_split(path, '>'))::BIGINT AS node_id FROM walk ANTI JOIN (SELECT tree_id, parent_id AS node_id FROM b5 WHERE parent_id IS NOT NULL) USING (tree_id, node_id)), per AS (SELECT tree_id, leaf, min(reward) AS reward, avg(diversity) AS diversity FROM lf JOIN b5 USING (tree_id, node_id) GROUP BY ALL) SELECT tree_id, count(*) AS n_solutions, round(avg(reward), 6) AS mean_reward, round(avg(diversity), 6) AS mean_diversity, arg_max(leaf, {{'r': reward, 'i': -leaf}}) AS best_leaf FROM per GROUP BY tree_id")
def t08(s, d):
    return T.solution_reward(B.tree(s, d))


for _k in ("t04_paths", "t02_open_at_depth", "t08_solution_reward"):
    ORACLE[_k] = "WITH " + ORACLE[_k]


# ---- answers and claims


@query("f01_gsm8k_gold", "SELECT p_partkey, replace(regexp_extract(p_name || chr(10) || '#### ' || p_size || ',' || p_partkey, '####\\s*([-\\d,.]+)', 1), ',', '') AS gold FROM part")
def f01(s, d):
    t = B.table(s, d, "part").withColumn("t", F.concat("p_name", F.lit("\n#### "), F.col("p_size").cast("string"), F.lit(","), F.col("p_partkey").cast("string")))
    return t.select("p_partkey", A.gsm8k_gold("t").alias("gold"))


@query("f02_boxed_answer", "SELECT p_partkey, '{' || p_size || '}/' || p_brand AS answer FROM part")
def f02(s, d):
    t = B.table(s, d, "part").withColumn("t", F.concat(F.lit("so \\boxed{ {"), F.col("p_size").cast("string"), F.lit("}/"), "p_brand", F.lit("} and \\boxed{no}")))
    return t.select("p_partkey", A.boxed_first("t").alias("answer"))


@query("f15_normalize_answer", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN lower(p_brand) WHEN p_partkey % 3 = 1 THEN p_size::VARCHAR ELSE regexp_replace(regexp_replace(printf('%.10f', p_retailprice), '0+$', ''), '\\.$', '') END AS answer FROM part")
def f15(s, d):
    raw = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit(" $"), "p_brand", F.lit("$ "))).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("x = "), F.col("p_size").cast("string"), F.lit(".0 %"))).otherwise(F.format_string("%.4f", "p_retailprice"))
    return B.table(s, d, "part").select("p_partkey", A.normalize_answer(raw).alias("answer"))


@query("f17_answers_match", "SELECT p_size, (p_size % 3 <> 2) AS matched FROM (SELECT DISTINCT p_size FROM part)")
def f17(s, d):
    t = B.table(s, d, "part").select("p_size").distinct()
    n = F.col("p_size").cast("string")
    t = t.withColumn("pred", F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("\\frac{"), n, F.lit("}{1}"))).when(F.col("p_size") % 3 == 1, F.concat(F.lit("0"), n, F.lit(".0"))).otherwise(F.concat(n, F.lit("7")))).withColumn("gold", n)
    return t.join(A.match_pairs(t), ["pred", "gold"]).select("p_size", "matched")


@query("f20_vote_keys", "SELECT q, CASE WHEN q = 7 THEN '' ELSE q::VARCHAR END AS run_key, q::VARCHAR AS tree_key FROM (SELECT DISTINCT l_quantity::INT AS q FROM lineitem)")
def f20(s, d):
    t = B.table(s, d, "lineitem").select(F.col("l_quantity").cast("int").alias("q")).distinct()
    raw = F.concat(F.lit("00"), F.col("q").cast("string"), F.lit(".0"))
    return t.select("q", A.vote_key_run(F.when(F.col("q") == 7, "").otherwise(raw)).alias("run_key"), A.vote_key_tree(raw).alias("tree_key"))


@query("f27_solution_steps", "SELECT doc_id, greatest(1, len(list_filter(string_split(replace(text, chr(10), chr(10) || chr(10)), chr(10) || chr(10)), lambda x: trim(x) <> '')))::INT AS n_steps FROM documents")
def f27(s, d):
    t = B.claims_text(s, d).withColumn("t", F.replace("text", F.lit("\n"), F.lit("\n\n")))
    return t.select("doc_id", F.size(A.solution_steps("t")).alias("n_steps"))


def _either(words: list[str]) -> str:
    return "|".join(re.escape(w).replace("\\ ", " ") for w in sorted(words, key=len, reverse=True))


_OPS, _SAYS = _either(A.OPERATORS), _either(A.TRANSITIONS)


@query("f28_zone_tokens", f"SELECT doc_id, regexp_matches(right(text, 20), '{_OPS}') OR regexp_matches(right(text, 40), '(?i)(^|[^\\pL\\pN_])({_SAYS})([^\\pL\\pN_]|$)') AS zone FROM documents")
def f28(s, d):
    return B.claims_text(s, d).select("doc_id", A.in_zone("text", F.lit("x")).alias("zone"))


@query("f29_garbage_documents", "SELECT doc_id, regexp_matches(text, '[^\\x{0}-\\x{FF}\\x{370}-\\x{3FF}\\x{2190}-\\x{21FF}\\x{2200}-\\x{22FF}]') AS garbage FROM documents")
def f29(s, d):
    return B.claims_text(s, d).select("doc_id", A.is_garbage("text").alias("garbage"))


_U02 = "(?i)(?:therefore|thus|hence|so|we get|we have|we obtain|this gives|which gives)\\s*[,:]?\\s*(.{5,120}?)(?:\\.|$)"


@query("u02_intermediate_results", f"SELECT doc_id, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{_U02}', 1)) AS m FROM documents) GROUP BY doc_id")
def u02(s, d):
    found = F.regexp_extract_all("text", F.lit(CL.RESULTS[0].replace("(?Uid)", "(?id)")), 1)
    return B.claims_text(s, d).select("doc_id", F.explode(found).alias("m")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


@query("u04_claims")
def u04(s, d):
    t = B.samples(s, d).withColumn("text", F.concat(F.lit("By induction, x = "), "answer", F.lit("7.\nTherefore y is "), F.col("reward").cast("string"), F.lit(". Let n = 3")))
    return CL.claims(t, ["problem_id", "sample_idx"], unique=True)


@query("d03_claim_clusters", """SELECT problem_id, 'equation' AS claim_type, 'x' AS content_key, sum(n)::BIGINT AS mentions, count(*) AS n_values, arg_max(v, {'n': n, 'i': -first}) AS majority_value, round(max(n) / sum(n), 6) AS ratio, count(*) = 1 AS agreed
  FROM (SELECT problem_id, (answer || '7')::INT || '.0' AS v, count(*) AS n, min(sample_idx) AS first FROM b2 GROUP BY ALL) GROUP BY problem_id HAVING sum(n) >= 2""", B.SAMPLES)  # fmt: skip
def d03(s, d):
    t = B.samples(s, d).select("problem_id", F.col("sample_idx").alias("pos"), F.lit("equation").alias("claim_type"), F.concat(F.lit("X = "), "answer", F.lit("7")).alias("content"))
    return CL.clusters(t.withColumn("value", A.numeric_value(F.substring("content", 5, 20))), "problem_id")


# ---- joins, sets, windows


@query("j01_semi_join", "SELECT DISTINCT problem_id FROM b1 WHERE problem_id IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)", B.RESULTS)
def j01(s, d):
    return B.results(s, d).select("problem_id").distinct().join(B.table(s, d, "customer").filter("c_acctbal > 0"), F.col("problem_id") == F.col("c_custkey"), "left_semi")


@query("k07_resume_anti_join", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT problem_id FROM b1)", B.RESULTS)
def k07(s, d):
    return B.table(s, d, "customer").join(B.results(s, d), F.col("c_custkey") == F.col("problem_id"), "left_anti").select("c_custkey")


@query("j03_paired_contingency", "SELECT *, a_only - b_only AS net FROM (SELECT count(*) AS n, count(*) FILTER (x AND y) AS both, count(*) FILTER (x AND NOT y) AS a_only, count(*) FILTER (y AND NOT x) AS b_only, count(*) FILTER (NOT x AND NOT y) AS neither FROM (SELECT problem_id, correct AS x FROM bl WHERE method = '1-URGENT') JOIN (SELECT problem_id, correct AS y FROM bl WHERE method = '5-LOW') USING (problem_id)) WHERE n >= 5", B.RESULTS, DEDUP)
def j03(s, d):
    return M.paired(_results(s, d), "1-URGENT", "5-LOW")


@query("w03_top_k_per_group", "SELECT problem_id, sample_idx, k::INT AS k FROM (SELECT *, row_number() OVER (PARTITION BY problem_id ORDER BY reward DESC, sample_idx) AS k FROM b2) WHERE k <= 2", B.SAMPLES)
def w03(s, d):
    w = Window.partitionBy("problem_id").orderBy(F.desc("reward"), "sample_idx")
    return B.samples(s, d).withColumn("k", F.row_number().over(w)).filter("k <= 2").select("problem_id", "sample_idx", "k")


@query("w04_leave_one_out", "SELECT vec_id, grp, label, round(label - CASE WHEN n > 1 THEN (s - label) / (n - 1) ELSE label END, 6) AS gap FROM (SELECT *, sum(label) OVER (PARTITION BY grp) AS s, count(*) OVER (PARTITION BY grp) AS n FROM b4)", B.VECTORS)
def w04(s, d):
    return V.leave_one_out(B.vectors(s, d).select("vec_id", "grp", "label"), "grp", "label")


@query("s01_last_wins", "SELECT * EXCLUDE (wall) FROM bl", B.RESULTS, DEDUP)
def s01(s, d):
    return _results(s, d).drop("wall")


@query("x01_method_sets", "SELECT problem_id FROM b1 WHERE method = '1-URGENT' INTERSECT SELECT problem_id FROM b1 WHERE method = '2-HIGH' EXCEPT SELECT problem_id FROM b1 WHERE method = '5-LOW'", B.RESULTS)
def x01(s, d):
    ids = lambda m: B.results(s, d).filter(F.col("method") == m).select("problem_id")
    return ids("1-URGENT").intersect(ids("2-HIGH")).subtract(ids("5-LOW"))


@query("m13_experiment_grid", "SELECT method, n::INT AS n, w AS weight FROM (SELECT DISTINCT method FROM b1), (VALUES (4), (8), (16)) a(n), (VALUES (0.0::DOUBLE), (0.5), (1.0)) b(w)", B.RESULTS)
def m13(s, d):
    ns = s.createDataFrame([(4,), (8,), (16,)], "n int")
    ws = s.createDataFrame([(0.0,), (0.5,), (1.0,)], "weight double")
    return B.results(s, d).select("method").distinct().crossJoin(F.broadcast(ns)).crossJoin(F.broadcast(ws))


@query("k08_padded_arrays", "SELECT problem_id, coalesce(max(entropy) FILTER (round = 1), -1) AS r1, coalesce(max(entropy) FILTER (round = 2), -1) AS r2, coalesce(max(entropy) FILTER (round = 3), -1) AS r3 FROM b6 GROUP BY problem_id", B.ROUNDS)
def k08(s, d):
    arrays = B.rounds(s, d).groupBy("problem_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("round", "entropy"))), lambda x: x["entropy"]).alias("e"))
    return arrays.select("problem_id", *[F.coalesce(F.get("e", i), F.lit(-1.0)).alias(f"r{i + 1}") for i in range(3)])


@query("m02_beam_prune", "SELECT tree_id, node_id, cum FROM (SELECT *, row_number() OVER (PARTITION BY tree_id ORDER BY cum DESC, node_id) AS k FROM (SELECT tree_id, node_id, round(sum(ln(reward + 0.01)) OVER (PARTITION BY tree_id ORDER BY node_id ROWS UNBOUNDED PRECEDING), 6) AS cum FROM b5)) WHERE k <= 2", B.TREE)
def m02(s, d):
    run = Window.partitionBy("tree_id").orderBy("node_id").rowsBetween(Window.unboundedPreceding, 0)
    t = B.tree(s, d).select("tree_id", "node_id", F.round(F.sum(F.log(F.col("reward") + 0.01)).over(run), 6).alias("cum"))
    return t.withColumn("k", F.row_number().over(Window.partitionBy("tree_id").orderBy(F.desc("cum"), "node_id"))).filter("k <= 2").drop("k")

"""Registered queries against their SQL, golden values, loaders, readers, the provider loop and the stream."""

import datetime
import json
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from tallyspark.operators import calibration as C
from tallyspark.operators import metrics as M
from tallyspark.operators import provider as P
from tallyspark.operators import vectors as V
from tallyspark.operators import voting as Q
import tallyspark.plans.more_queries  # noqa: F401
from tallyspark.plans.queries import ORACLE, QUERIES
from tallyspark.sources import loaders as L
from tallyspark.sources import readers as R
from tallyspark.streaming import results as S

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if isinstance(v, float):
        return round(v, 5) + 0.0
    return float(v) if type(v).__name__ == "Decimal" else v


@pytest.mark.skipif(not os.path.exists(DATA), reason="no data")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_against_sql(spark, name):
    df = QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    if name not in ORACLE:
        assert got
        return
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    r = con.sql(ORACLE[name])
    assert sorted(r.columns) == cols
    at = [r.columns.index(c) for c in cols]
    assert got == sorted((tuple(norm(x[i]) for i in at) for x in r.fetchall()), key=repr)


def test_vote_ties_and_order(spark):
    rows = [(1, 0, "b", 0.1), (1, 1, "a", 0.9), (1, 2, "a", 0.2), (1, 3, "b", 0.3), (2, 0, "", 0.5), (2, 1, None, 0.5), (3, 0, "x", 0.0)]
    df = spark.createDataFrame(rows, "problem_id long, sample_idx long, answer string, reward double")
    for t in (df, df.orderBy(F.desc("reward")).repartition(3)):
        got = {r.problem_id: r for r in Q.vote(t).collect()}
        assert (got[1].winner, got[1].support, got[1].rep_idx) == ("b", 2, 0)
        got = {r.problem_id: (r.winner, r.support, r.rep_idx) for r in Q.vote(t, skip_blank=True).collect()}
        assert set(got) == {1, 2, 3} and got[2] == (None, 0, 1)  # without a vote, the last sample
        assert {r.problem_id: r.winner for r in Q.vote(t, weight=F.col("reward")).collect()}[1] == "a"
    d = {r.problem_id: r for r in Q.disagreement(df).collect()}
    assert d[1].entropy == 1.0 and d[3].entropy == 0.0 and d[1].confidence == 0.25


def test_auroc(spark):
    rows = [(0.1, False), (0.4, True), (0.35, False), (0.8, True), (0.4, False)]
    df = spark.createDataFrame(rows, "s double, y boolean").withColumn("g", F.lit(1))
    one = lambda t: C.auroc(t, "s", "y", ["g"]).first()["auroc"]
    assert one(df) == round((2.5 + 3) / 6, 6)
    assert one(df.withColumn("s", -F.col("s"))) == pytest.approx(1 - one(df), abs=1e-6)
    assert one(df.filter("y")) == 0.5
    assert C.fallback_threshold(df.limit(0), "s", "y").first()["tau"] == 1.0
    assert C.fallback_threshold(df.filter("y"), "s", "y").first()["tau"] == pytest.approx(0.6)


def test_sweep_with_a_constant_score_takes_the_lowest_threshold(spark):
    df = spark.range(100).selectExpr("id / 100.0D s", "id % 3 = 0 y")
    rows = C.sweep(df, "s", "y", 0.0, 1.0, 11, 0.1, 0.55, metric="auroc").collect()
    assert [r.tau for r in rows if r.chosen] == [0.5]


def test_categories_in_order(spark):
    rows = [(1, True, True, True, 1), (2, True, False, True, 1), (3, False, False, False, 0), (4, False, True, True, 2), (5, True, True, False, 1), (6, True, False, False, 1)]
    t = M.category(spark.createDataFrame(rows, "problem_id long, greedy boolean, majority boolean, dad boolean, rounds int"))
    assert {r.first_id: r.category for r in t.collect()} == {1: "A", 2: "C", 3: "D", 4: "B", 5: "E", 6: "G"}


def test_vectors(spark):
    df = spark.createDataFrame([(1, [0.0] * 8, 0), (2, [1.0, 0.0], 0), (3, [float("nan"), float("inf")], 0)], "id long, v array<double>, g int")
    r = {x.id: x for x in df.select("id", V.entropy_nats(V.scrub("v")).alias("h"), V.logit_margin(V.scrub("v")).alias("m"), V.kl_full(V.softmax(V.scrub("v")), V.softmax(V.scrub("v"))).alias("k")).collect()}
    assert r[1].h == pytest.approx(2.0794415) and r[1].m == 0 and r[3].h == pytest.approx(0) and all(x.k == 0 for x in r.values())
    k = spark.range(1).select(V.kl_topk(F.array(F.lit(1), F.lit(2)), F.array(F.lit(0.6), F.lit(0.3)), F.array(F.lit(1), F.lit(2)), F.array(F.lit(0.6), F.lit(0.3)), 50).alias("same"), V.kl_topk(F.array(F.lit(1)), F.array(F.lit(0.9)), F.array(F.lit(2)), F.array(F.lit(0.9)), 50).alias("other"), V.jaccard(F.array(F.lit(1), F.lit(2)), F.array(F.lit(2), F.lit(3))).alias("j"), V.mixture(F.array(F.lit(1.0), F.lit(3.0)), F.array(F.array(F.lit(0.0), F.lit(4.0)), F.array(F.lit(4.0), F.lit(0.0)))).alias("x")).first()
    assert k.same == 0 and k.other > 1 and k.j == pytest.approx(1 / 3) and k.x.mixed == [3.0, 1.0] and k.x.spread == 0.5
    e = df.filter("id < 3").select(V.full_record("v", F.lit(5), F.lit(True), 1.0, 3).alias("r")).collect()
    assert [x.r.triggered for x in e] == [True, False]


def test_loaders(spark):
    g = spark.createDataFrame([("q1", "a\n#### 1,000"), ("q2", "line\n last \n")], "question string, answer string")
    assert sorted((r.question, r.gold_answer) for r in L.load("gsm8k", g).collect()) == [("q1", "1000"), ("q2", "last")]
    assert [r.problem_id for r in L.load("gsm8k", g, 1, seed=3).collect()] == [0]
    m = spark.createDataFrame([("p", " 5 ", "Level 4", "Algebra")], "problem string, answer string, level string, subject string")
    assert L.load("math500", m).first().asDict() == {"problem_id": 0, "question": "p", "gold_answer": "5", "source": "math500", "level": "4", "problem_type": "Algebra"}
    assert L.load("deepmath", spark.createDataFrame([("", "p", " 7 ")], "question string, problem string, final_answer string")).first()["question"] == "p"
    assert L.load("aime_2024", spark.createDataFrame([(1, "p", "so \\boxed{42}")], "id int, problem string, solution string")).first()["gold_answer"] == "42"
    assert L.load("aime_1999", spark.createDataFrame([(1, "p", "70.0")], "id int, problem string, answer string")).first()["gold_answer"] == "70"
    assert L.load("amc", spark.createDataFrame([("p", 3.0, "x/2023_AMC_12A_Problems")], "problem string, answer double, url string")).first()["problem_type"] == "AMC_12A"
    assert L.load("competition_math", spark.createDataFrame([("p", "no box\nlast line\n", "Level 2", "T")], "problem string, solution string, level string, type string")).first()["gold_answer"] == "last line"
    o = spark.createDataFrame([("q", ["$1$", "2"], "Text-only", "Numerical"), ("r", ["x"], "Text-only", "Expression")], "question string, final_answer array<string>, modality string, answer_type string")
    assert [r.gold_answer for r in L.load("olympiad_bench", o).collect()] == ["1$, 2"]
    assert L.load("amo_bench", spark.createDataFrame([("q", "\\boxed{1} \\boxed{2}", "number")], "prompt string, answer string, answer_type string")).first()["gold_answer"] == "2"
    with pytest.raises(ValueError):
        L.load("nothing", g)


def test_readers_and_writers(spark, tmp_path):
    f = tmp_path / "metrics_a.json"
    f.write_text('{"problem_id": 1, "dataset": "d"}\nnot json\n\n{"problem_id": 2, "dataset": "e"}\n')
    schema = "problem_id long, dataset string"
    assert R.read_lenient(spark, str(f), schema).count() == 2 and R.read_lenient(spark, str(tmp_path / "none.json"), schema).count() == 0
    with pytest.raises(Exception, match="(?i)malformed"):
        R.read_strict(spark, str(f), schema).collect()
    assert [(r.problem_id, r.key) for r in R.read_glob(spark, str(tmp_path / "metrics_*.json"), schema, "d").collect()] == [(1, "a")]
    assert R.newest_file(spark, str(tmp_path / "*.json")).endswith("metrics_a.json")
    (tmp_path / "list.json").write_text('[{"problem_id": 5}, {"problem_id": 6}]')
    assert R.read_array(spark, str(tmp_path / "list.json"), schema).count() == 2
    rows = spark.createDataFrame([(1, "x"), (2, None)], "k long, v string")
    got = R.upsert(rows, spark.createDataFrame([(2, "y", 1.0), (3, None, 2.0)], "k long, v string, w double"), ["k"])
    assert sorted((r.k, r.v, r.w) for r in got.collect()) == [(1, "x", None), (2, "y", 1.0), (3, None, 2.0)]
    out = str(tmp_path / "out")
    R.append(rows, out)
    R.append(rows, out)
    assert spark.read.json(out).count() == 4
    assert [r.k for r in R.todo(rows, rows.filter("k = 1"), "k").collect()] == [2]
    assert json.loads(R.write_metrics(rows.limit(1))) == {"k": 1, "v": "x"}
    assert R.thresholds(spark, str(tmp_path / "t.json"), "m") == {"tau_e": 1.5, "tau_d": 0.3}
    assert spark.range(1).select(R.run_id("own/Model", "d", "all").alias("r")).first()["r"].startswith("Model_d_all_")


def test_deliberation_stops_early(spark):
    prompts = spark.createDataFrame([(i, f"p{i}") for i in range(20)], "problem_id long, prompt string")
    votes, maps = P.deliberate(prompts, P.StubProvider(2), 4, 2, 3, 0.9, lambda df, _: df.cache())
    assert votes.count() == 20 and {r.round for r in maps.collect()} == {2, 3}
    replay = P.ReplayProvider(P.StubProvider().generate(prompts, 3).withColumn("round", F.lit(1)))
    assert replay.generate(prompts.limit(2), 2).count() == 4


def test_stream_counts_each_line_once(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("src", "out", "ck"))
    t = lambda m: datetime.datetime(2024, 1, 1, 0, m)
    for part in ([(1, "a", False, 10, t(0)), (2, "a", True, 20, t(0))], [(1, "a", True, 11, t(5)), (1, "b", True, 5, t(1))]):
        spark.createDataFrame(part, S.SCHEMA).write.mode("append").json(src)
        q = S.latest_results(S.result_stream(spark, src), out, ck)
        q.awaitTermination()
    last = max((int(x) for x in os.listdir(out)), default=0)
    assert sorted((r.problem_id, r.method, r.total_tokens) for r in spark.read.parquet(f"{out}/{last}").collect()) == [(1, "a", 11), (1, "b", 5), (2, "a", 20)]


def test_imports_without_the_llm_folders():
    import ast
    import pathlib

    root = pathlib.Path(__file__).parent.parent
    for f in (root / "tallyspark").rglob("*.py"):
        if "llm" not in f.parts:
            names = [getattr(n, "module", None) or "" for n in ast.walk(ast.parse(f.read_text())) if isinstance(n, ast.ImportFrom)]
            assert not any("llm" in n for n in names), f


def test_vote_without_votes(spark):
    from tallyspark.operators import voting

    rows = [(1, 0, "", 0.9), (1, 1, None, 0.2), (2, 0, "a", 0.1), (2, 1, "", 0.9), (3, 0, "", 0.5), (3, 1, "", 0.5)]
    s = spark.createDataFrame(rows, "problem_id long, sample_idx int, answer string, reward double")
    last = {r.problem_id: (r.winner, r.support, r.n_votes, r.rep_idx) for r in voting.vote(s, skip_blank=True).collect()}
    assert last == {1: (None, 0, 0, 1), 2: ("a", 1, 1, 0), 3: ("", 0, 0, 1)}
    best = {r.problem_id: r.rep_idx for r in voting.vote(s, weight=F.col("reward"), skip_blank=True, fallback=F.col("reward")).collect()}
    assert best == {1: 0, 2: 0, 3: 0}
    assert voting.vote(s.limit(0), skip_blank=True).count() == 0


def test_pass_at_k_by_a_matcher(spark):
    from tallyspark.functions import answers
    from tallyspark.operators import voting

    s = spark.createDataFrame([(1, 0, "1/2"), (1, 1, "7")], "problem_id long, sample_idx int, answer string")
    gold = spark.createDataFrame([(1, "0.5")], "problem_id long, gold string")
    assert not voting.pass_at_k(s, gold, [1]).first().pass_1
    assert voting.pass_at_k(s, gold, [1], match=answers.matches_simple).first().pass_1


def test_thresholds_drop_what_is_not_finite(spark):
    from tallyspark.operators import calibration as C

    inf, nan = float("inf"), float("nan")
    rows = [(0.5, False), (1.0, False), (2.0, True), (3.0, True)]
    clean = spark.createDataFrame(rows, "score double, label boolean")
    dirty = spark.createDataFrame([*rows, (inf, True), (-inf, False), (nan, True), (None, True)], clean.schema)
    args = ("score", "label", 0.0, 4.0, 9, 0.01, 0.9)
    assert sorted(C.sweep(clean, *args).collect()) == sorted(C.sweep(dirty, *args).collect())
    assert C.choose_threshold(dirty, *args).first().tau == 1.0
    assert C.choose_threshold(clean, "score", "label", 5.0, 6.0, 3, 0.5, 0.6).first().tau == 1.5  # none feasible: the median
    assert C.choose_threshold(clean, "score", "label", 5.0, 6.0, 3, 0.5, 0.6, other=0.3).first().tau == 0.3
    one = spark.createDataFrame([(1.0, True), (2.0, True), (inf, False)], clean.schema)
    assert C.choose_threshold(one, *args).first().tau == 1.5
    assert C.choose_threshold(dirty.filter("score = double('inf')"), *args).first().tau == 1.5
    assert C.choose_threshold(clean.limit(0), *args).first().tau == 1.0


def test_claim_validation_takes_the_last_of_repeats(spark):
    from tallyspark.operators import calibration as C

    tokens = spark.createDataFrame([(1, i, i / 4, i > 1) for i in range(4)], "problem_id long, position int, entropy double, wrong boolean")
    rows = [(1, i, 0.1 * i, 2) for i in range(4)] + [(1, i, 9.0 - i, 1) for i in range(4)]
    got = C.validate_claim(tokens, spark.createDataFrame(rows, "problem_id long, position int, disagreement double, seq int"), order="seq").collect()
    assert {(r.signal, r.n_pos, r.n_neg, r.auroc) for r in got} == {(s, 2, 2, 1.0) for s in ("entropy", "disagreement", "product")}


def test_baseline_falls_back_to_the_first_method(spark):
    from tallyspark.operators import metrics

    m = spark.createDataFrame([("b", 0.5, 100.0, 1.0), ("a", 0.25, 50.0, 2.0)], "method string, accuracy double, mean_tokens double, mean_wall double")
    assert {r.method: r.delta for r in metrics.against_baseline(m, "greedy").collect()} == {"a": 0.0, "b": 0.25}
    assert {r.method: r.delta for r in metrics.against_baseline(m, "b").collect()} == {"a": -0.25, "b": 0.0}


def test_paths_of_deep_trees(spark):
    from tallyspark.operators import tree

    n = 5000
    chain = spark.range(n).selectExpr("1L as tree_id", "id as node_id", "if(id = 0, null, id - 1) as parent_id")
    odd = spark.createDataFrame([(2, 1, 2), (2, 2, 1), (2, 3, 9), (3, 7, None)], "tree_id long, node_id long, parent_id long")  # a circle, an orphan, a root
    got = tree.paths(chain.unionByName(odd))
    deep = got.filter("tree_id = 1 and depth = 4999").first()
    assert deep.node_id == 4999 and deep.path == ">".join(map(str, range(n)))
    assert got.filter("tree_id = 1").selectExpr("count(*)", "sum(depth)", "bool_and(depth = node_id)").first()[:] == (n, n * (n - 1) // 2, True)
    assert [tuple(r) for r in got.filter("tree_id > 1").collect()] == [(3, 7, 0, "7")]


def test_many_trees(spark):
    from tallyspark.operators import tree

    nodes = spark.range(300_000).selectExpr("id div 2 as tree_id", "id as node_id", "if(id % 2 = 0, null, id - 1) as parent_id")
    assert tree.paths(nodes).selectExpr("count(*)", "sum(depth)").first()[:] == (300_000, 150_000)


def test_workspace_text(spark):
    from tallyspark.operators import claims

    samples = spark.createDataFrame([(1, 0, "7"), (1, 1, "7"), (1, 2, "8")], "problem_id long, sample_idx int, answer string")
    rows = [(1, "intermediate", "x = 3", "3", 0), (1, "intermediate", "x = 3", "3", 4), (1, "intermediate", "y = 1", "1", 1), (1, "intermediate", "y = 2", "2", 5), (1, "intermediate", "y = 2", "2", 6), (1, "method", "induction", "induction", 2)]
    c = spark.createDataFrame(rows, "problem_id long, claim_type string, content string, value string, pos int")
    want = """SOLUTION ANALYSIS (3 attempts):

ANSWER DISTRIBUTION:
  7: 2/3 (67%)
  8: 1/3 (33%)

AGREED FACTS (all solutions concur):
  - x = 3

DISPUTED CLAIMS (solutions disagree):
  - y: 2 (2 solutions) vs 1 (1 solutions)

APPROACHES USED:
  - induction: 1 solutions

NOTE: Some disagreement exists. Check the disputed claims above."""
    assert claims.workspace(samples, c).first().workspace == want
    assert claims.workspace(samples, c, limit=5).first().workspace == want[:20] + "\n[truncated]"


def test_workspace_of_even_splits(spark):
    """Two answers with equal votes have an entropy of exactly 1, which is not above 1, whatever the number of samples."""
    from tallyspark.operators import claims

    rows = [(n, i, "a" if i % 2 else "b") for n in (2, 10, 12, 24, 26, 28, 144, 208) for i in range(n)] + [(3, i, "abc"[i]) for i in range(3)]
    samples = spark.createDataFrame(rows, "problem_id long, sample_idx int, answer string")
    none = spark.createDataFrame([], "problem_id long, claim_type string, content string, value string, pos int")
    got = {r.problem_id: r.workspace.split("NOTE: ")[1].split(".")[0] for r in claims.workspace(samples, none).collect()}
    assert got.pop(3) == "High disagreement on final answer"
    assert set(got.values()) == {"Some disagreement exists"}


def test_trailing_context_is_linear(spark, tmp_path):
    """Odd texts against brute force; no token becomes a row, and none is sought from its text's start."""
    texts = [None, "", " ", "a", "  b  c ", "x" * 50 + " y", "\U0001f600" * 45 + " é\n\tz \U0001f600", "w " * 60 + "v", " ".join(f"t{i * 7919 % 1000}" for i in range(200_000))]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    df = QUERIES["w06_trailing_context"](spark, str(tmp_path))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Window" not in plan and "Join" not in plan
    got = {r.doc_id: (r.n_tokens, r.last_in_order, r.n_chars) for r in df.collect()}
    for k, t in enumerate(texts):
        if t is None:
            assert k not in got
            continue
        c, e = [], -1
        for word in t.split(" "):
            e += len(word) + 1
            c.append(t[max(0, e - 40) : e])
        assert got[k] == (len(c), max(c), sum(map(len, c)))


def test_budget_points_hold_one_row_per_problem(spark, tmp_path):
    """Votes over the first 1, 2 and 4 samples against brute force; samples aren't multiplied or grouped before the totals."""
    day = datetime.datetime(2020, 1, 1)
    rows = [(o, o % 7, o % 3, i, float((o * 5 + i * i * 3) % 11) if (o + i) % 9 else 7.0, 10.5 * i + o, day) for o in range(200) for i in range(o % 7)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_shipdate timestamp").repartition(3).withColumn("l_discount", F.lit(0.1)).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(o, o * 3) for o in range(150)], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    df = QUERIES["a37_budget_points"](spark, str(tmp_path))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 1
    want = {}
    for o in range(150):
        mine = [("" if q % 7 == 0 else str(int(q) % 5), int(p)) for x, _, _, _, q, p, _ in rows if x == o]
        for k in (1, 2, 4) if mine else ():
            votes = [a for a, _ in mine[:k]]
            winner = max(votes, key=lambda a: (votes.count(a), -votes.index(a)))
            n, c, t = want.get(k, (0, 0, 0))
            want[k] = (n + 1, c + (winner == str(o * 3 % 5)), t + sum(p for _, p in mine[:k]))
    assert {r.k: (r.n, r.n_correct, r.total_tokens) for r in df.collect()} == want


def test_claims_of_odd_texts(spark):
    """Every pattern, over texts in and outside ASCII; with unique rows nothing is shuffled, and repeated rows merge."""
    from tallyspark.functions import answers as A
    from tallyspark.operators import claims as CL

    texts = [None, "", "x = 3. y = 1e3, X = 3, x = 3.0; \\alpha = 5\nz= \\begin{a}", "THEREFORE, y is 0.05. Thus we get x = frac12. The result is 1,000.", "By induction and via casework; using the angle bisector theorem, with TRIG", "LET n = 3, setting k=2 and define q = 0.50", "by ınductıon, vıa caſework = 7, leT K = \u0663.", "with Kelvin = 1. The answer is  inf. equals nan. x = inf", "so x = 2.50. so x = 2.5. hence x = 2.5", "using coordinate geometry by modular  arithmetic with generating function via substitution by the quadratic formula using case analysis"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")
    made = lambda kind, content, raw: F.struct(F.lit(kind).alias("claim_type"), content.alias("content"), raw.alias("raw"))
    every = lambda p, g=1: F.regexp_extract_all("text", F.lit(p), g)
    parts = []
    for p in CL.EQUATIONS:
        right = F.transform(every(p, 2), lambda s: F.regexp_replace(A.strip(s), r"\.+$", ""))
        pairs = F.filter(F.arrays_zip(every(p).alias("l"), right.alias("r")), lambda x: (F.length(x["r"]) >= 2) & ~x["r"].startswith("\\begin"))
        parts.append(F.transform(pairs, lambda x: made("equation", F.concat(A.strip(x["l"]), F.lit(" = "), x["r"]), x["r"])))
    parts += [F.transform(every(p), lambda s: made("intermediate_result", A.strip(s), A.strip(s))) for p in CL.RESULTS]
    for p in [r"(?Ui)(?:using|by|via|with)\s+(" + m + ")" for m in CL.METHODS] + [CL.CHOICE]:
        kind = "variable_choice" if p == CL.CHOICE else "method"
        low = F.transform(every(p), lambda s: F.lower(A.strip(s)))
        parts.append(F.transform(low, (lambda kind: lambda s: made(kind, s, s))(kind)))
    rows = df.select("id", F.posexplode(F.concat(*parts)).alias("pos", "c")).select("id", "pos", "c.*", A.numeric_value("c.raw").alias("n")).orderBy("id", "pos").collect()
    want = {}
    for r in rows:
        want.setdefault((r.id, r.claim_type, r.raw if r.claim_type in ("method", "variable_choice") else r.n), (r.pos, r.content))
    assert {k[1] for k in want} == {"equation", "intermediate_result", "method", "variable_choice"} and len(want) > 20
    once = CL.claims(df, ["id"], unique=True)
    assert "Exchange" not in once._jdf.queryExecution().executedPlan().toString()
    for t in (once, CL.claims(df.union(df), ["id"])):
        assert sorted(((r.id, r.claim_type, r.value), (r.pos, r.content)) for r in t.collect()) == sorted(want.items())


def test_entry_without_the_llm_folders(tmp_path):
    """The rest imports, and only their queries are missing."""
    import pathlib
    import shutil
    import subprocess
    import sys

    root = pathlib.Path(__file__).parent.parent
    shutil.copytree(root / "tallyspark", tmp_path / "tallyspark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 90 and not any(k.startswith('op') or k == 'pipeline' for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)


def test_sibling_kl_of_lone_and_equal_lists(spark):
    rows = [(1, 1, [3, 4], [0.5, 0.25]), (2, 1, [3], [0.5]), (2, 2, [3], [0.5]), (3, 1, [1], [1.0]), (3, 2, [2], [1.0]), (4, 1, [], [])]
    df = spark.createDataFrame(rows, "grp int, id int, ids array<int>, probs array<double>")
    got = {(r.grp, r.id): r.kl for r in V.sibling_kl(df, "grp", "id", "ids", "probs", 10).collect()}
    assert got == {(1, 1): 0.0, (2, 1): 0.0, (2, 2): 0.0, (3, 1): 5.0, (3, 2): 5.0}


def test_rerank_ties_and_empty_lookaheads(spark):
    rows = [(1, 0, [-1.0, -1.0]), (1, 1, [-2.0]), (2, 0, [-0.5]), (2, 1, None), (3, 0, [-3.0]), (3, 1, [-1.0, -1.0])]
    got = P.rerank(spark.createDataFrame(rows, "g int, k int, lp array<double>"), "g", "k", "lp").collect()
    assert {(r.g, r.k, r.score) for r in got} == {(1, 0, -2.0), (2, 1, 0.0), (3, 1, -2.0)}


def test_collector_labels_every_step_with_the_outcome(spark):
    rows = [(1, 0, 2.0, True, False), (1, 5, 2.0, True, True), (2, 5, 2.0, False, False), (2, 6, 0.5, True, False)]
    df = spark.createDataFrame(rows, "problem_id int, position int, entropy double, zone boolean, correct boolean")
    got = {(r.problem_id, r.position): (r.entropy_triggered, r.final_correct) for r in C.collect_records(df, 1.0, 3).collect()}
    assert got == {(1, 0): (False, True), (1, 5): (True, True), (2, 5): (False, False), (2, 6): (False, False)}

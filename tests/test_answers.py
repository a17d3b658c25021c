import pytest
from pyspark.sql import functions as F

from tallyspark.functions import answers as A

MATCHES = [
    ("-7", "7", True), ("1", "100", True), ("234", "1,234", True), (None, "5", False), ("", "5", False), ("5", "", False),
    ("(0, 1)", "(1, 0)", False), ("\\{1,2\\}", "\\{2,1\\}", True), ("(1,2)", "(1,2)", True), ("\\frac{1}{2}", "0.5", True),
    ("\\dfrac{3}{4}", "\\frac{3}{4}", True), ("042", "42", True), ("62.5%", "0.625", True), ("5", "6", False), ("3", "3.0", True),
    ("\\text{Yes}", "yes", True), ("-\\frac{1}{2}", "\\frac{-1}{2}", False), ("x = 5", "5", True), ("2", "1, 2, 3", True), ("$12$", "12", True),
    ("a+b", "a-b", False), ("\\sqrt{2}", "sqrt(2)", True), ("90^\\circ", "90", True),
]


def one(spark, expr, *values):
    df = spark.createDataFrame([values], ", ".join(f"c{i} string" for i in range(len(values))))
    return df.select(expr.alias("r")).first()["r"]


def test_matcher_truth_table(spark):
    df = spark.createDataFrame([(p, g) for p, g, _ in MATCHES], "pred string, gold string")
    got = {(r.pred, r.gold): r.matched for r in A.match_pairs(df).collect()}
    assert [(p, g, got[p, g]) for p, g, _ in MATCHES] == MATCHES
    strict = {(r.pred, r.gold): r.matched for r in A.match_pairs(df, strict=True).collect()}
    assert not strict["-7", "7"] and not strict["1", "100"] and not strict["234", "1,234"] and strict["3", "3.0"]


@pytest.mark.parametrize(
    "text,want",
    [("a \\boxed{\\frac{1}{2}} b \\boxed{3}", "\\frac{1}{2}"), ("\\boxed{1 \\boxed{7}", "7"), ("none", None), ("\\boxed{ x }", "x")],
)
def test_boxed_first(spark, text, want):
    assert one(spark, A.boxed_first("c0"), text) == want


def test_boxes(spark):
    assert one(spark, A.boxed_last("c0"), "\\boxed{1} \\boxed{2}") == "2"
    assert one(spark, A.boxed_last("c0"), "\\boxed{1} \\boxed{2") == ""
    assert one(spark, A.has_box("c0"), "\\boxed{1 \\boxed{2}") is True
    assert one(spark, A.has_box("c0"), "{} \\boxed{1") is False
    assert one(spark, A.boxed_one_level("c0"), " plain ") == "plain"


@pytest.mark.parametrize(
    "text,want",
    [("so \\boxed{5}", "5"), ("The final answer is: $12$.", "12"), ("Answer: 7.", "7"), ("x\n#### 1,234", "1,234"), ("**bold** and **42**", "42"), ("y = 3\nthen more words", "3"), ("we get 1,024.", "1024."), ("nothing", None)],
)
def test_numeric_answer(spark, text, want):
    assert one(spark, A.numeric_answer("c0"), text) == want


@pytest.mark.parametrize("text,want", [("1,000", "1000"), ("1/4", "0.25"), ("x = 5.", "5"), ("YES", "yes"), (None, ""), ("3d", "3d"), ("nan", "nan"), ("1e20", "100000000000000000000"), ("0.10", "0.1"), ("45^\\circ", "45")])
def test_normalize_answer(spark, text, want):
    assert one(spark, A.normalize_answer("c0"), text) == want


def test_vote_keys(spark):
    assert one(spark, A.vote_key_run("c0"), "") == "" and one(spark, A.vote_key_tree("c0"), "") == "0"
    assert one(spark, A.vote_key_run("c0"), "007") == "7" and one(spark, A.vote_key_entropy("c0"), "$1,000.50") == "1000.5"


@pytest.mark.parametrize("text,want", [("\\frac{12}{5}", "2.4"), ("\\frac{1}{25}", "2.4"), ("42", "42.0"), ("Two", "two")])
def test_numeric_value(spark, text, want):
    assert one(spark, A.numeric_value("c0"), text) == want


def test_text_helpers(spark):
    assert one(spark, A.gsm8k_gold("c0"), "a\n#### 1,200") == "1200" and one(spark, A.gsm8k_gold("c0"), "a\n b \n\n") == "b"
    assert one(spark, A.solution_steps("c0"), "a\n\n \n\n b ") == ["a", "b"] and one(spark, A.solution_steps("c0"), " ") == ["(no content)"]
    assert one(spark, A.in_zone("c0", "c1"), "and therefore", " it") and not one(spark, A.in_zone("c0", "c1"), "sofa cushion", " it")
    assert one(spark, A.is_garbage("c0"), "日") and not one(spark, A.is_garbage("c0"), "αβ→∀é")
    assert one(spark, A.until_garbage(F.split("c0", "\\|")), "a|b|日|c") == ["a", "b"]
    p = A.format_prompt("c0", "Some-Qwen-Model")
    assert one(spark, A.question_of(p), "1+1?") == "1+1?"
    assert one(spark, A.score_prediction("c0", "c1"), "so \\boxed{5}", "5.0").correct
    assert one(spark, A.last_number("c0"), "the answer is 1,5") == "15"


def test_nesting_of_any_depth(spark):
    deep = "x"
    for name in A.TEXT_WRAPPERS[:9]:
        deep = f"\\{name}{{{deep}}}"
    assert one(spark, A.strip_wrappers("c0"), deep) == "x"
    frac, want = "1", "1"
    for _ in range(10):
        frac, want = f"\\frac{{{frac}}}{{2}}", f"(({want})/(2))"
    assert one(spark, A.frac_to_slash("c0"), frac) == want
    assert "\\frac" in one(spark, A.frac_to_slash("c0"), f"\\frac{{{frac}}}{{2}}")  # the eleventh round isn't there
    root, want = "a", "a"
    for _ in range(5):
        root, want = f"\\sqrt{{{root}}}", f"sqrt({want})"
    assert one(spark, A.sqrt_plain("c0"), root) == want
    assert one(spark, A.strip_wrappers("c0"), "plain") == "plain" and one(spark, A.strip_wrappers("c0"), "") == ""


def test_plain_numbers_are_what_python_prints(spark):
    """What built-ins claim to read, they read as the function does; the rest is left to it."""
    texts = ["7", "-7", "007", "-0", "000", "0.50", "-0.0", "0.000", "0.0001", "0.00001", "12.340", "1234567890123.5", "123456789012345", "1234567890123456", "12345678901234.56", "1.", ".5", "1e5", "1E5", "inf", "nan", "Infinity", "1_0", "frac12", "\\frac{1}{2}", "X is 5", "  Bob ", "a,b", "{x}", "Éq", "x\n", "7\n", "7 ", "", "٣", "+5", "x\\left(y", "face", "- 5", "20°"]
    t = spark.createDataFrame([(x,) for x in texts], "c0 string")
    got = t.select("c0", A.plain_number("c0").alias("p"), A.numeric_value("c0").alias("n")).collect()
    assert [(r.c0, r.p) for r in got if r.p is not None and r.p != r.n] == []
    assert {r.c0 for r in got if r.p is None} >= {"0.00001", "1e5", "inf", "frac12", "a,b", "Éq", "+5"}
    assert {"7", "-0", "0.50", "X is 5"} <= {r.c0 for r in got if r.p is not None}

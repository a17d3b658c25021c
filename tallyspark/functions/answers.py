"""Answer extraction, normalisation and matching as Column expressions (Arrow UDFs only for unbounded brace matching and
for the exact text of floats)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StringType

# Formats and word lists that results depend on.
TEXT_WRAPPERS = ["text", "mathrm", "mathbf", "mathit", "mathsf", "mathtt", "operatorname", "textbf", "textit", "textrm", "rm", "bf", "it", "displaystyle", "textstyle", "scriptstyle", "scriptscriptstyle"]
SPACING = [r"\!", r"\,", r"\:", r"\;", "\\ ", r"\quad", r"\qquad"]
OPERATORS = ["=", "+", "-", "*", "/", "^", "**", "≤", "≥", "≠", "∈", "∉", "⊂", "⊃", "∪", "∩", "→", "⇒", "⟹", "≡", "≈", "∝", r"\leq", r"\geq", r"\neq", r"\in", r"\notin", r"\subset", r"\supset", r"\cup", r"\cap", r"\implies", r"\equiv", r"\approx", r"\times", r"\cdot", r"\div", r"\frac", r"\sqrt", r"\sum", r"\prod", r"\int"]
TRANSITIONS = ["therefore", "thus", "hence", "so", "we get", "we have", "we obtain", "we find", "it follows", "this gives", "this means", "which gives", "which means", "this implies", "substituting", "simplifying", "expanding", "factoring", "solving", "computing", "note that", "observe that", "recall that", "since", "because", "plugging in", "plugging", "substitution", "combining", "rearranging", "applying"]
PROMPT = "You are a helpful math assistant. Solve the following problem step by step. Show your reasoning clearly. Put your final answer in \\boxed{}."
PROMPT_GEMMA = "Solve the following math problem completely. Show all calculations. You MUST compute the final numerical answer. Put your final answer in \\boxed{} at the end."
NUMBER = r"[\-\+]?\d[\d,\.]*(?:/\d+)?"
ONE_LEVEL_BOX = r"\\boxed\{([^{}]*(?:\{[^{}]*\}[^{}]*)*)\}"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _let(x: Column, body) -> Column:
    """body(x) with x worked out once, however often body uses it: keeps nested expressions linear in size."""
    return F.get(F.transform(F.array(x), body), 0)


def strip(x) -> Column:
    return F.regexp_replace(_c(x), r"(?U)^\s+|\s+$", "")


def _strip_dollars(x) -> Column:
    return F.regexp_replace(_c(x), r"^\$+|\$+$", "")


def _blank_null(x: Column) -> Column:
    return F.nullif(x, F.lit(""))


# ---- boxed answers


def _close(text: str, at: int) -> int:
    """The position of the brace that closes what opens before `at`, or -1."""
    depth = 1
    for m in re.compile(r"[{}]").finditer(text, at):
        depth += 1 if m.group() == "{" else -1
        if not depth:
            return m.start()
    return -1


@F.udf(StringType(), useArrow=True)
def boxed_first(text):
    """the content of the first box; if that never closes, of the last one with one level of braces at most."""
    if text is None:
        return None
    at = text.find("\\boxed{")
    if at >= 0 and (end := _close(text, at + 7)) >= 0:
        return text[at + 7 : end].strip()
    found = re.findall(ONE_LEVEL_BOX, text)
    return found[-1].strip() if found else None


@F.udf(BooleanType(), useArrow=True)
def has_box(text):
    """whether some box closes, each new one starting the count again."""
    depth = 0
    for m in re.finditer(r"\\boxed\{|[{}]", text or ""):
        if m.group() == "{":
            depth += depth > 0
        elif m.group() == "}":
            depth -= depth > 0
            if not depth and m.start() and "\\boxed{" in text[: m.start()]:
                return True
        else:
            depth = 1
    return False


@F.udf(StringType(), useArrow=True)
def boxed_last(text):
    """the content of the last box; '' if there is none or it never closes."""
    at = (text or "").rfind("\\boxed{")
    end = _close(text, at + 7) if at >= 0 else -1
    return text[at + 7 : end].strip() if end >= 0 else ""


def boxed_one_level(x) -> Column:
    """the last box with one level of braces at most, else the trimmed text."""
    found = F.regexp_extract_all(_c(x), F.lit(ONE_LEVEL_BOX), 1)
    return strip(F.coalesce(F.try_element_at(found, F.lit(-1)), _c(x)))


# ---- answers in free text


def gsm8k_gold(x) -> Column:
    """what follows ####, without commas; else the last line that isn't blank."""
    hit = _blank_null(F.replace(F.regexp_extract(_c(x), r"####\s*([\-\d,\.]+)", 1), F.lit(","), F.lit("")))
    lines = F.filter(F.transform(F.split(_c(x), "\n"), strip), lambda s: s != "")
    return F.coalesce(F.when(_c(x).rlike(r"####\s*[\-\d,\.]+"), F.coalesce(hit, F.lit(""))), F.try_element_at(lines, F.lit(-1)), F.lit(""))


def _clean(x: Column) -> Column:
    """A hit's text without outer dollars, points and space; NULL if nothing is left."""
    return _let(x, _clean_once)


def _clean_once(x: Column) -> Column:
    return _blank_null(strip(F.regexp_replace(_strip_dollars(strip(x)), r"^\.+|\.+$", "")))


def numeric_answer(x, boxed: Column | None = None) -> Column:
    """the first of: box, `answer is`, `answer:`, ####, bold number, `= number` at a line's end, number at the end."""
    x = _c(x)
    t = strip(x)
    said = [r"(?Ui)(?:the\s+(?:final\s+)?answer\s+is)[:\s]*\$?([^\$\n]{1,60})\$?", r"(?Ui)(?:answer)[:\s]*\$?([^\$\n]{1,60})\$?", r"(?Ui)####\s*([\-\+]?\d[\d,\.]*(?:/\d+)?)"]
    bold = F.transform(F.regexp_extract_all(x, F.lit(r"\*\*([^\*]{1,60})\*\*"), 1), lambda s: strip(_strip_dollars(strip(s))))
    bold = F.filter(bold, lambda s: s.rlike(r"^[\-\+]?\d|^\\?(?:frac|sqrt)"))
    equal = _clean(F.regexp_extract(t, r"(?Umd)=\s*\$?([^\$\n=]{1,40})\$?\s*$", 1))
    bare = F.replace(F.regexp_extract(t, r"(?Ud)([\-\+]?\d[\d,\.]*(?:/\d+)?)\s*\.?\s*$", 1), F.lit(","), F.lit(""))
    box = boxed_first(x) if boxed is None else boxed
    return F.coalesce(_blank_null(box), *[_clean(F.regexp_extract(t, p, 1)) for p in said], F.try_element_at(bold, F.lit(-1)), F.when(equal.rlike(r"^[\-\+]?\d"), equal), _blank_null(bare))


def last_number(x) -> Column:
    """number after `answer is`, after = at a line's end, or at a line's end."""
    t = strip(x)
    pats = [r"(?Uimd)(?:answer\s*(?:is|=|:)\s*)(" + NUMBER + ")", r"(?Uimd)(?:=\s*)(" + NUMBER + r")\s*$", r"(?Uimd)(" + NUMBER + r")\s*$"]
    return _let(t, lambda t: F.coalesce(*[_blank_null(F.replace(F.regexp_extract(t, p, 1), F.lit(","), F.lit(""))) for p in pats]))


def extracted(x) -> Column:
    """the box, else the numeric answer."""
    return numeric_answer(x)


# ---- normal forms


def _any_of(words: list[str]) -> str:
    return "|".join(re.escape(w) for w in words)


def _again(x: Column, mark: str, most: int | None, step) -> Column:
    """step, as often as x has marks, each of which a step that changes anything takes away one of; `most` times at most."""

    def run(s):
        n = F.regexp_count(s, F.lit(mark))
        return F.aggregate(F.array_repeat(F.lit(0), n if most is None else F.least(n, F.lit(most))), s, lambda a, _: step(a))

    return _let(x, run)


def strip_wrappers(x) -> Column:
    """\\text{..} and the like, however deep they are nested."""
    x, names = _c(x), "|".join(TEXT_WRAPPERS)
    return _again(x, r"\\(?:" + names + ")", None, lambda s: F.regexp_replace(F.regexp_replace(s, r"(?U)\\(?:" + names + r")\s*\{([^{}]*)\}", "$1"), r"(?U)\\(?:" + names + r")\s+", ""))


def frac_to_slash(x) -> Column:
    """\\frac{a}{b} as ((a)/(b)), innermost first, in ten rounds at most."""
    x = F.regexp_replace(_c(x), r"\\(?:dfrac|tfrac)\b", r"\\frac")
    x = _again(x, r"\\frac", 10, lambda s: F.regexp_replace(s, r"(?U)\\frac\s*\{([^{}]*)\}\s*\{([^{}]*)\}", r"(($1)/($2))"))
    return F.regexp_replace(x, r"(?U)\\frac\s+(\S)\s+(\S)", r"(($1)/($2))")


def sqrt_plain(x) -> Column:
    """\\sqrt{a} as sqrt(a), in five rounds at most."""
    x = _again(_c(x), r"\\sqrt", 5, lambda s: F.regexp_replace(s, r"(?U)\\sqrt\s*\{([^{}]*)\}", r"sqrt($1)"))
    return F.regexp_replace(x, r"(?U)\\sqrt\s+(\S+)", r"sqrt($1)")


def strip_left_right(x) -> Column:
    """F11."""
    return F.regexp_replace(_c(x), r"\\left|\\right", "")


def normalize_latex(x) -> Column:
    """F12."""
    s = strip(F.regexp_replace(F.regexp_replace(strip(x), r"^\${1,2}", ""), r"\${1,2}$", ""))
    s = sqrt_plain(frac_to_slash(strip_wrappers(strip_left_right(s))))
    s = F.regexp_replace(s, _any_of(SPACING), "")
    s = F.regexp_replace(s, r"\^\\circ|\\circ|°|\\%|%", "")
    s = F.regexp_replace(F.regexp_replace(F.regexp_replace(s, r"\\pi", "pi"), r"\\cdot|\\times", "*"), r"\\div", "/")
    s = F.regexp_replace(F.regexp_replace(s, "[−–—]", "-"), r"[\${}]", "")
    return F.coalesce(F.regexp_replace(F.lower(F.regexp_replace(s, r"(?U)\s+", "")), r"[.,;:]+$", ""), F.lit(""))


def try_float(x) -> Column:
    """a finite double from a decimal literal or a / b, with or without brackets; else NULL."""
    n = r"([\-\+]?\d+(?:\.\d+)?)"
    forms = [r"^\(?\s*" + n + r"\s*\)?\s*/\s*\(?\s*" + n + r"\s*\)?$", r"^\(*\(" + n + r"\)/\(" + n + r"\)\)*$"]

    def parse(s):
        part = lambda p, i: _blank_null(F.regexp_extract(s, p, i)).try_cast("double")
        plain = F.when(s.rlike(r"^[+-]?(?:\d+(?:_\d+)*\.?(?:\d+(?:_\d+)*)?|\.\d+(?:_\d+)*)(?:[eE][+-]?\d+)?$"), F.replace(s, F.lit("_"), F.lit("")).try_cast("double"))
        return F.coalesce(F.nullif(F.nullif(plain, F.lit(float("inf"))), F.lit(float("-inf"))), *[F.try_divide(part(p, 1), part(p, 2)) for p in forms])

    return _let(strip(x), parse)


def format_number(v: Column, places: int) -> Column:
    """Integers below 1e15 as such, others with up to so many places."""

    def text(v):
        whole = (v == F.rint(v)) & (F.abs(v) < 1e15)
        return F.when(whole, v.try_cast("bigint").cast("string")).otherwise(F.regexp_replace(F.format_string(f"%.{places}f", v), r"\.?0+$", ""))

    return F.when(v.isNotNull(), _let(v, text))


def _bare(x) -> Column:
    s = F.regexp_replace(strip(x), r"(?U)\s+", " ")
    s = strip(F.regexp_replace(s, r"^\s*x\s*\\?in\s*", ""))
    s = strip(F.regexp_replace(s, r"^\s*x\s*=\s*", ""))
    s = F.regexp_replace(s, r"\^\\?circ", "")
    s = F.regexp_replace(F.regexp_replace(s, r"\\?circ", ""), r"\\?%", "")
    return F.regexp_replace(strip(_strip_dollars(F.replace(s, F.lit(","), F.lit("")))), r"[.,;:]+$", "")


def normalize_answer(x) -> Column:
    """numbers in their shortest decimal form, other answers in lower case; NULL as ''."""
    return F.coalesce(_let(_bare(x), lambda s: _number_or(s, 10, strip(F.lower(s)))), F.lit(""))


def _number_or(s: Column, places: int, other: Column) -> Column:
    return F.coalesce(format_number(try_float(s), places), other)


def _zeros(s: Column) -> Column:
    return _let(F.ltrim(s, F.lit("0")), lambda t: F.when(t == "", "0").otherwise(t))


def vote_key_run(x) -> Column:
    """'' stays ''; leading zeros go; numbers with up to 8 places."""
    return F.when(F.coalesce(_c(x), F.lit("")) == "", "").otherwise(_let(_zeros(normalize_answer(x)), lambda s: _number_or(s, 8, s)))


def vote_key_tree(x) -> Column:
    """NULL is '', but '' votes as 0."""
    return F.when(_c(x).isNull(), "").otherwise(_let(_zeros(normalize_answer(x)), lambda s: _number_or(s, 8, s)))


def vote_key_entropy(x) -> Column:
    """numbers with up to 6 places, else lower case."""
    s = strip(F.replace(F.replace(_c(x), F.lit(","), F.lit("")), F.lit("$"), F.lit("")))
    return F.coalesce(_let(s, lambda s: _number_or(s, 6, F.lower(s))), F.lit(""))


def _number_text(text):
    """a number in the form a float prints in; braces go before fractions are read, as results depend on it."""
    if text is None:
        return None
    text = re.sub(r"\\circ|°", "", text.strip().replace(",", ""))
    for part in ("{", "}", "\\left", "\\right"):
        text = text.replace(part, "")
    try:
        return str(float(text))
    except ValueError:
        m = re.fullmatch(r"\\?frac\s*(-?\d+)\s*(-?\d+)", text)
        if m and float(m.group(2)):
            return str(float(m.group(1)) / float(m.group(2)))
    return text.lower().strip()


numeric_value = F.udf(_number_text, StringType(), useArrow=True)
numeric_values = F.udf(lambda texts: None if texts is None else [_number_text(t) for t in texts], ArrayType(StringType()), useArrow=True)


def plain_number(x) -> Column:
    """F24 by built-ins where they give the same: plain decimals of 15 digits at most (which a float prints as they are, but
    for spare zeros), and ASCII texts with a letter that no number or fraction has; else NULL."""
    x = _c(x)
    part = F.regexp_extract(x, r"\.(\d+?)0*\z", 1)
    number = F.concat(F.when(x.startswith("-"), "-").otherwise(""), F.regexp_extract(x, r"^-?0*(\d+)", 1), F.lit("."), F.when(part == "", "0").otherwise(part))
    decimal = x.rlike(r"^-?(?=[\d.]{1,16}\z)(?:\d{1,15}|(?=0*[1-9]|0*\.\d{0,3}[1-9]|0*\.0*\z)\d+\.\d+)\z")
    word = x.rlike(r"^[ -+\--\[\]-z|~]*[bdghj-mo-qsu-xzBDGHJ-MO-QSU-XZ][ -+\--\[\]-z|~]*\z")
    return F.when(decimal, number).when(word, F.trim(F.lower(x)))


# ---- matching


def parsed_set(x) -> Column:
    """['set' or 'seq', parts...] of {..}, (..) or [..] with two parts or more; else NULL."""
    s = F.regexp_replace(F.regexp_replace(strip_left_right(strip(x)), r"\\\{", "{"), r"\\\}", "}")
    kind = F.when(s.rlike(r"(?s)^\{.*\}$"), "set").when(s.rlike(r"(?s)^\(.*\)$|^\[.*\]$"), "seq")
    parts = F.filter(F.transform(F.split(F.substring(s, F.lit(2), F.length(s) - 2), ","), strip), lambda p: p != "")
    norm = F.transform(parts, normalize_answer)
    return F.when(kind.isNotNull() & (F.size(parts) >= 2), F.concat(F.array(kind), F.when(kind == "set", F.array_sort(norm)).otherwise(norm)))


def _near(a: Column, b: Column, tol: float) -> Column:
    return F.coalesce(F.abs(a - b) < tol, F.lit(False))


def match_pairs(pairs: DataFrame, pred: str = "pred", gold: str = "gold", tol: float = 1e-6, strict: bool = False) -> DataFrame:
    """F16/F17 over the distinct (pred, gold) of pairs: (pred, gold, matched).

    Default: as lenient as the figures to match (signs and factors of 100 are ignored; a comma gold matches any part).
    strict: set, normal form, number or LaTeX form must agree. Steps are columns of their own, so nothing is worked out
    twice; only distinct pairs are matched.
    """
    d = pairs.select(F.col(pred).alias("pred"), F.col(gold).alias("gold")).distinct()
    d = d.withColumn("p0", strip(_strip_dollars(strip("pred")))).withColumn("g0", strip(_strip_dollars(strip("gold"))))
    wrapped = F.col("g0").rlike(r"(?s)^(\{.*\}|\(.*\)|\[.*\])$")
    parts = F.filter(F.transform(F.split(F.replace("g0", F.lit("$"), F.lit("")), ","), strip), lambda s: s != "")
    many = F.col("g0").contains(",") & ~wrapped & (F.size(parts) > 1)
    d = d.withColumn("g", F.explode(F.when(many & F.lit(not strict), F.array_append(parts, F.col("g0"))).otherwise(F.array("g0"))))
    tail = lambda c: F.regexp_replace(strip(_strip_dollars(strip(c))), r"[.,;:]+$", "")
    d = d.withColumn("p", tail("p0")).withColumn("g", tail("g"))
    d = d.withColumns({"ps": parsed_set("p"), "gs": parsed_set("g"), "pn": normalize_answer("p"), "gn": normalize_answer("g"), "pl": normalize_latex("p"), "gl": normalize_latex("g")})
    d = d.withColumns({"pv": try_float("pn"), "gv": try_float("gn"), "pf": try_float("pl"), "gf": try_float("gl")})
    for c in "pg":
        s = F.col(f"{c}l")
        minus, bracket = s.startswith("-"), s.startswith("(")
        rest = F.substring(s, F.lit(2), F.length(s))
        opened = F.regexp_replace(s, r"^[()]+|[()]+$", "")
        d = d.withColumn(f"{c}x", F.when(minus, F.array(s, rest, F.concat(F.lit("-("), rest, F.lit(")")))).when(bracket, F.array(s, opened)).otherwise(F.array(s)))
        d = d.withColumn(f"{c}y", F.filter(F.transform(f"{c}x", try_float), lambda v: v.isNotNull()))
    numbers = _near(F.col("pv"), F.col("gv"), tol)
    scaled = _near(F.col("pv"), F.col("gv") * 100, tol) | _near(F.col("pv") * 100, F.col("gv"), tol)
    signs = F.arrays_overlap("px", "gx") | F.exists("py", lambda a: F.exists("gy", lambda b: F.abs(a - b) < tol))
    same = (F.col("pn") == F.col("gn")) | numbers | ((F.col("pl") != "") & (F.col("pl") == F.col("gl"))) | _near(F.col("pf"), F.col("gf"), tol)
    loose = same | (_zeros(F.col("pn")) == _zeros(F.col("gn"))) & (F.col("pn") != "") & (F.col("gn") != "") | scaled | F.coalesce(signs, F.lit(False))
    one = F.when((F.col("p") == "") | (F.col("g") == ""), False).when(F.col("ps").isNotNull() & F.col("gs").isNotNull(), F.col("ps") == F.col("gs")).otherwise(same if strict else loose)
    out = d.withColumn("one", F.coalesce(one, F.lit(False)) & (F.col("p0") != "") & (F.col("g0") != ""))
    return out.groupBy("pred", "gold").agg(F.coalesce(F.bool_or("one"), F.lit(False)).alias("matched"))


def _symbolic(x) -> Column:
    s = strip_left_right(F.regexp_replace(strip(x), r"(?U)\s+", " "))
    s = F.regexp_replace(F.regexp_replace(s, r"\\cdot|\\times", "*"), r"\\div", "/")
    return strip(F.lower(F.regexp_replace(s, r"\\(?:text|mathrm)\{([^}]+)\}", "$1")))


def matches_simple(pred, gold, tol: float = 1e-6) -> Column:
    """F18, the other matcher: equal text, else two numbers decide, else symbolic text."""
    p, g = _c(pred), _c(gold)
    num = lambda x: try_float(F.replace(strip(x), F.lit(","), F.lit("")))
    return F.when(p.isNull() | g.isNull(), False).when(strip(p) == strip(g), True).when(num(p).isNotNull() & num(g).isNotNull(), F.abs(num(p) - num(g)) < tol).otherwise(_symbolic(p) == _symbolic(g))


def score_prediction(text, gold) -> Column:
    """struct(extracted, gold, correct, has_boxed)."""
    got = F.coalesce(_blank_null(boxed_first(_c(text))), last_number(text))
    return F.struct(got.alias("extracted"), _c(gold).alias("gold"), matches_simple(got, gold).alias("correct"), has_box(_c(text)).alias("has_boxed"))


# ---- prompts and tokens


def format_prompt(question, model: str) -> Column:
    """the chat format of the model's family, by the first family whose name it contains."""
    q, m = _c(question), model.lower()
    wrap = lambda a, b: F.concat(F.lit(a), q, F.lit(b))
    chat = wrap(f"<|im_start|>system\n{PROMPT}<|im_end|>\n<|im_start|>user\n", "<|im_end|>\n<|im_start|>assistant\n")
    if "gemma" in m:
        return wrap(f"<start_of_turn>user\n{PROMPT_GEMMA}\n\n", "<end_of_turn>\n<start_of_turn>model\n")
    if any(k in m for k in ("qwen", "deepseek", "nemotron")):
        return chat
    if "llama" in m:
        head = lambda r: f"<|start_header_id|>{r}<|end_header_id|>\n\n"
        return wrap(f"<|begin_of_text|>{head('system')}{PROMPT}<|eot_id|>{head('user')}", f"<|eot_id|>{head('assistant')}")
    return wrap(f"[INST] {PROMPT}\n\n", " [/INST]") if "mistral" in m or "ministral" in m else chat


def question_of(prompt) -> Column:
    """the user's part of a chat prompt, else all of it."""
    p = _c(prompt)
    return F.when(p.contains("<|im_start|>user\n"), F.substring_index(F.substring_index(F.substring_index(p, "<|im_start|>user\n", 2), "<|im_start|>user\n", -1), "<|im_end|>", 1)).otherwise(p)


# The words of a later round's prompt.
REFINE = [
    "<|im_start|>system\nYou are a helpful math assistant. Solve the following problem step by step. Show your reasoning clearly. Put your final answer in \\boxed{}.<|im_end|>\n<|im_start|>user\n",
    "\n\nHere is an analysis of multiple previous solution attempts:\n<workspace>\n",
    "\n</workspace>\n\nBased on this analysis, provide a careful solution. Pay special attention to any disputed claims and verify each step. Do not simply repeat previous answers - check the reasoning independently.<|im_end|>\n<|im_start|>assistant\n",
]


def refine_prompt(prompt, workspace) -> Column:
    """the question of a prompt with a workspace text, as the prompt of a later round; NULL texts are empty."""
    head, middle, tail = map(F.lit, REFINE)
    return F.concat(head, F.coalesce(question_of(prompt), F.lit("")), middle, F.coalesce(_c(workspace), F.lit("")), tail)


def solution_steps(x) -> Column:
    """paragraphs that aren't blank; else the trimmed text, or '(no content)'."""
    steps = F.filter(F.transform(F.split(_c(x), "\n\n"), strip), lambda s: s != "")
    return F.when(F.size(steps) > 0, steps).otherwise(F.array(F.coalesce(_blank_null(strip(x)), F.lit("(no content)"))))


def in_zone(prefix, token) -> Column:
    """an operator in the token or in the last 20 characters, or a transition phrase in the last 40, before it."""
    ops = _any_of(sorted(OPERATORS, key=len, reverse=True))
    words = r"(?Ui)\b(" + _any_of(sorted(TRANSITIONS, key=len, reverse=True)) + r")\b"
    p, t = _c(prefix), _c(token)
    context = F.right(p, F.lit(40))
    line = strip(F.substring_index(context, "\n", -1))
    return t.rlike(ops) | F.right(context, F.lit(20)).rlike(ops) | context.rlike(words) | ((F.length(line) <= 5) & F.concat(line, t).rlike(ops))


GARBAGE = r"[^\x{0}-\x{FF}\x{370}-\x{3FF}\x{2190}-\x{21FF}\x{2200}-\x{22FF}]"


def is_garbage(token) -> Column:
    """a character outside Latin-1, Greek, arrows and mathematical operators."""
    return _c(token).rlike(GARBAGE)


def until_garbage(tokens) -> Column:
    """the tokens before the first garbage one."""
    flags = F.transform(_c(tokens), is_garbage)
    at = F.array_position(flags, F.lit(True))
    return F.when(at > 0, F.slice(_c(tokens), F.lit(1), (at - 1).cast("int"))).otherwise(_c(tokens))

"""Claims in solution texts, their clusters and disagreement."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.answers import boxed_first, numeric_values, plain_number, strip

# Patterns that results depend on.
EQUATIONS = [r"(?U)([a-zA-Z_]\w*)\s*=\s*([^\n,;]{1,80})", r"(?U)\\([a-zA-Z]+)\s*=\s*([^\n\\]{1,80})"]
RESULTS = [r"(?Uid)(?:therefore|thus|hence|so|we get|we have|we obtain|this gives|which gives)\s*[,:]?\s*(.{5,120}?)(?:\.|$)", r"(?Uid)(?:the answer is|the result is|equals)\s+(.{3,80}?)(?:\.|$)"]
METHODS = [r"coordinate\s+geometry", r"trigonometry|trig", r"the\s+(?:angle|power|Stewart|Menelaus|Ceva)[\w\s]*(?:theorem|lemma)", r"modular\s+arithmetic", r"generating\s+functions?", r"casework|case\s+analysis", "induction", "substitution", r"the\s+quadratic\s+formula"]
CHOICE = r"(?Ui)(?:let|setting|define)\s+([A-Za-z])\s*="


# Of these (in the order above) an ASCII text in lower case has one at least if the pattern matches.
EQUATION_HINTS = [["="], ["\\"]]
RESULT_HINTS = [["therefore", "thus", "hence", "so", "we ", "gives"], ["the answer is", "the result is", "equals"]]
METHOD_HINTS = [["coordinate"], ["trig"], ["theorem", "lemma"], ["modular"], ["generating"], ["case"], ["induction"], ["substitution"], ["quadratic"]]
CHOICE_HINTS = ["let", "setting", "define"]


def _all(text: str, pattern: str, hints: list[str], group: int = 1) -> Column:
    """All matches; the pattern only runs over texts that have a hint, or characters outside ASCII."""
    may = reduce(lambda a, b: a | b, [F.col("low").contains(h) for h in hints], F.col("odd"))
    return F.when(may, F.regexp_extract_all(F.col(text), F.lit(pattern), group)).otherwise(F.array().cast("array<string>"))


def claims(solutions: DataFrame, by: list[str], text: str = "text", unique: bool = False) -> DataFrame:
    """(by, pos, claim_type, content, value); of one type and value only the first of a solution stays.

    unique: no two rows have the same `by`; then nothing is shuffled, as all is done within a row. Python sees only what
    built-ins can't read as a number."""
    key = [F.col(b).alias(f"by{i}") for i, b in enumerate(by)]
    keys = [f"by{i}" for i in range(len(by))]
    x = solutions.select(*key, F.col(text).alias("t")).withColumns({"low": F.lower("t"), "odd": F.length("t") != F.octet_length("t")})
    made = lambda kind, content, raw: F.struct(F.lit(kind).alias("claim_type"), content.alias("content"), raw.alias("raw"))
    parts = []
    for p, h in zip(EQUATIONS, EQUATION_HINTS, strict=True):
        right = F.transform(_all("t", p, h, 2), lambda s: F.regexp_replace(strip(s), r"\.+$", ""))
        pairs = F.filter(F.arrays_zip(_all("t", p, h, 1).alias("l"), right.alias("r")), lambda x: (F.length(x["r"]) >= 2) & ~x["r"].startswith("\\begin"))
        parts.append(F.transform(pairs, lambda x: made("equation", F.concat(strip(x["l"]), F.lit(" = "), x["r"]), x["r"])))
    stripped = [F.transform(_all("t", p, h), strip) for p, h in zip(RESULTS, RESULT_HINTS, strict=True)]
    parts += [F.transform(m, lambda s: made("intermediate_result", s, s)) for m in stripped]
    lower = lambda m: F.transform(m, lambda s: F.lower(strip(s)))
    methods = [lower(_all("t", r"(?Ui)(?:using|by|via|with)\s+(" + m + ")", h)) for m, h in zip(METHODS, METHOD_HINTS, strict=True)]
    parts += [F.transform(m, lambda s: made("method", s, s)) for m in methods]
    parts.append(F.transform(lower(_all("t", CHOICE, CHOICE_HINTS)), lambda s: made("variable_choice", s, s)))
    x = x.select(*keys, F.concat(*parts).alias("c"))

    plain = lambda c: c["claim_type"].isin("method", "variable_choice")
    value = lambda c: F.when(plain(c), c["raw"]).otherwise(plain_number(c["raw"]))
    x = x.select(*keys, F.transform("c", lambda c: F.struct(c["claim_type"].alias("claim_type"), c["content"].alias("content"), c["raw"].alias("raw"), value(c).alias("value"))).alias("c"))
    hard = F.when(F.exists("c", lambda c: c["value"].isNull()), F.transform("c", lambda c: F.when(c["value"].isNull(), c["raw"])))
    x = x.select(*keys, "c", numeric_values(hard).alias("v"))
    whole = F.transform("c", lambda c, i: F.struct(c["claim_type"].alias("claim_type"), F.coalesce(c["value"], F.get("v", i)).alias("value"), i.alias("pos"), c["content"].alias("content")))
    x = x.select(*keys, F.sort_array(whole).alias("c"))
    again = lambda c, i: (i > 0) & F.get("c", i - 1)["claim_type"].eqNullSafe(c["claim_type"]) & F.get("c", i - 1)["value"].eqNullSafe(c["value"])
    x = x.select(*keys, F.explode(F.filter("c", lambda c, i: ~again(c, i))).alias("f"))
    if not unique:
        x = x.groupBy(*keys, "f.claim_type", "f.value").agg(F.min(F.struct("f.pos", "f.content", "f.claim_type", "f.value")).alias("f"))
    return x.select(*[F.col(k).alias(b) for k, b in zip(keys, by, strict=True)], "f.pos", "f.claim_type", "f.content", "f.value")


def final_answer(text: str = "text") -> Column:
    """The box, else what follows `answer is` or `answer:`."""
    said = F.regexp_extract(F.col(text), r"(?Ui)(?:answer is|answer:)\s*([^\n]{1,60})", 1)
    return F.coalesce(boxed_first(F.col(text)), strip(said), F.lit(""))


def _per_value(claim_rows: DataFrame, by: str) -> DataFrame:
    key = F.when(F.col("content").contains("="), strip(F.lower(F.substring_index("content", "=", 1)))).otherwise(F.lower(F.substring("content", 1, 30)))
    return claim_rows.groupBy(by, "claim_type", key.alias("content_key"), "value").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first"))


def clusters(claim_rows: DataFrame, by: str) -> DataFrame:
    """Clusters of claims about one thing: key, mentions, values, majority value and its share, agreed or not.

    The key is what stands before the first '=', or the first 30 characters; clusters of one mention are left out."""
    per = _per_value(claim_rows, by)
    g = per.groupBy(by, "claim_type", "content_key").agg(F.sum("n").alias("mentions"), F.count(F.lit(1)).alias("n_values"), F.max_by("value", F.struct("n", -F.col("first"))).alias("majority_value"), F.max("n").alias("top"))
    g = g.filter("mentions >= 2").withColumn("ratio", F.round(F.col("top") / F.col("mentions"), 6)).withColumn("agreed", F.col("n_values") == 1)
    return g.drop("top")


def workspace(samples: DataFrame, claim_rows: DataFrame, by: str = "problem_id", key: str = "answer", idx: str = "sample_idx", limit: int = 800) -> DataFrame:
    """D08 (by, workspace): the text of a disagreement map, cut after 4 * limit characters.

    Sections: answers by their number; the first five facts that all mentions agree on; five disputed ones, the least
    agreed first (D04's order); methods by their number; a note by the entropy. Ties keep the order of first mention.
    claim_rows: (by, claim_type, content, value, pos); may be empty.
    """
    ordered = lambda *c: F.array_sort(F.collect_list(F.struct(*c)))
    join = lambda items: F.array_join(items, "\n")
    per = samples.groupBy(by, key).agg(F.count(F.lit(1)).alias("n"), F.min(idx).alias("first"))
    answers = per.groupBy(by).agg(F.sum("n").alias("total"), ordered((-F.col("n")).alias("r"), "first", F.col(key).alias("k")).alias("answers"))
    share = lambda x: -x["r"] / F.col("total")
    # From shares, so that an even split has an entropy of exactly 1; log2(10) - log2(5) is above it.
    answers = answers.withColumn("entropy", F.aggregate("answers", F.lit(0.0), lambda e, x: e - share(x) * F.log2(share(x))))

    rows = _per_value(claim_rows, by).withColumn("text", F.concat(F.col("value"), F.lit(" ("), F.col("n").cast("string"), F.lit(" solutions)")))
    g = rows.groupBy(by, "claim_type", "content_key").agg(F.sum("n").alias("mentions"), F.max("n").alias("top"), F.min("first").alias("at"), ordered((-F.col("n")).alias("r"), "first", "text", "value").alias("v")).filter("mentions >= 2")
    agreed = F.size("v") == 1
    fact = F.concat(F.lit("  - "), "content_key", F.lit(" = "), F.get("v", 0)["value"])
    dispute = F.concat(F.lit("  - "), "content_key", F.lit(": "), F.array_join(F.transform("v", lambda x: x["text"]), " vs "))
    g = g.select(by, "at", "claim_type", "content_key", F.when(agreed, fact).alias("fact"), F.when(~agreed, dispute).alias("dispute"), F.when(~agreed, F.col("top") / F.col("mentions")).alias("ratio"))
    five = lambda text, *order: F.slice(F.array_sort(F.collect_list(F.when(F.col(text).isNotNull(), F.struct(*order, "claim_type", "content_key", F.col(text).alias("t"))))), 1, 5)
    facts = g.groupBy(by).agg(five("fact", "at").alias("facts"), five("dispute", "ratio", "at").alias("disputes"))
    used = claim_rows.filter("claim_type = 'method'").groupBy(by, "value").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first"))
    methods = used.groupBy(by).agg(ordered((-F.col("n")).alias("r"), "first", "value").alias("methods"))

    t = answers.join(facts, by, "left").join(methods, by, "left")
    percent = lambda x: F.bround(share(x) * 100, 0).cast("long").cast("string")
    count = lambda x: (-x["r"]).cast("string")
    line = lambda x: F.concat(F.lit("  "), F.coalesce(x["k"], F.lit("")), F.lit(": "), count(x), F.lit("/"), F.col("total").cast("string"), F.lit(" ("), percent(x), F.lit("%)"))
    section = lambda head, items, text: F.when(F.size(items) > 0, F.concat(F.lit(f"{head}\n"), join(F.transform(items, text)), F.lit("\n\n"))).otherwise("")
    note = F.when(F.col("entropy") > 1, "NOTE: High disagreement on final answer. Carefully verify each step.").when(F.col("entropy") > 1e-12, "NOTE: Some disagreement exists. Check the disputed claims above.").otherwise("NOTE: All solutions agree. Verify the shared reasoning is correct.")
    text = F.concat(  # fixed values: the headings, the notes and the forms of lines
        F.lit("SOLUTION ANALYSIS ("), F.col("total").cast("string"), F.lit(" attempts):\n\n"), section("ANSWER DISTRIBUTION:", F.col("answers"), line),
        section("AGREED FACTS (all solutions concur):", F.col("facts"), lambda x: x["t"]), section("DISPUTED CLAIMS (solutions disagree):", F.col("disputes"), lambda x: x["t"]),
        section("APPROACHES USED:", F.col("methods"), lambda x: F.concat(F.lit("  - "), x["value"], F.lit(": "), count(x), F.lit(" solutions"))), note,
    )
    whole = t.select(by, text.alias("t"))
    return whole.select(by, F.when(F.length("t") > 4 * limit, F.concat(F.substring("t", 1, 4 * limit), F.lit("\n[truncated]"))).otherwise(F.col("t")).alias("workspace"))

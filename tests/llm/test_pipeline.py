"""Mixing, and the whole pipeline, against plain Python."""

import collections
import hashlib
import os
import re
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tallyspark.llm import mixing, quality
from tests.llm.test_text_operators import components

DATA = "/root/testdata/sf0.001"


def share(children, budget):
    """children: name -> (cap, weight); what each gets of the budget, in the order of fullness."""
    live = sorted(((Fraction(c) / w, n, c, w) for n, (c, w) in children.items() if w > 0))
    out, left, total = {}, budget, sum(x[3] for x in live)
    for i, (_, n, c, w) in enumerate(live):
        if left * w >= c * total:
            out[n], left, total = c, left - c, total - w
        else:
            out |= {m: max(left, 0) * v // total for _, m, _, v in live[i:]}
            break
    return out


def mixed(rows, cfg):
    """(domain, lang, source, id, epoch, n, take) of rows (id, text, lang, source)."""
    leaves, weight = collections.defaultdict(list), lambda level, n: cfg.weights.get(level, {}).get(n, 1)
    for d, t, lang, src in rows:
        m = re.search(r"([0-9]{1,9})$", src or "")
        n = len((t or "").encode().split())
        if n:
            leaves[f"domain{int(m[1]) % cfg.domains if m else 0}", lang or "", src or ""].append((d, n))
    tokens = {k: sum(n for _, n in v) for k, v in leaves.items()}
    open_ = {k: n for k, n in tokens.items() if all(weight(level, x) > 0 for level, x in zip(mixing.LEVELS, k, strict=True))}

    def caps(prefix, level):
        c = collections.Counter()
        for k, n in open_.items():
            if k[: len(prefix)] == prefix:
                c[k[len(prefix)]] += n * cfg.max_epochs
        return {n: (v, weight(level, n)) for n, v in c.items()}

    out = []
    for a, x in share(caps((), "domain"), sum(tokens.values()) * cfg.budget_permille // 1000).items():
        for b, y in share(caps((a,), "lang"), x).items():
            for c, z in share(caps((a, b), "source"), y).items():
                leaf = (a, b, c)
                whole, part = divmod(z, tokens[leaf])
                for e in range(whole):
                    out += [(*leaf, d, e, n, n) for d, n in leaves[leaf]]
                at = 0
                for h, d, n in sorted((hashlib.md5(f"{cfg.seed}:{whole}:{d}".encode()).hexdigest(), d, n) for d, n in leaves[leaf]):
                    if at < part:
                        out.append((*leaf, d, whole, n, min(n, part - at)))
                    at += n
    return out


ROWS = [(i, "w " * (i % 17 + 1), ["en", "fr", None][i % 3], [f"s{i % 5}", "plain", None][i % 7 % 3]) for i in range(300)] + [(900, None, "en", "s1"), (901, " ", "en", "s1"), (902, "", None, None)]


@pytest.mark.parametrize(
    "cfg",
    [
        mixing.MixConfig(),
        mixing.MixConfig(weights={"source": {"s1": 50, "s2": 0}, "lang": {"en": 7}, "domain": {"domain1": 9}}, budget_permille=1500),
        mixing.MixConfig(max_epochs=1, budget_permille=1000),
        mixing.MixConfig(max_epochs=2, budget_permille=9000, weights={"lang": {"fr": 0}}),
    ],
)
def test_mix(spark, cfg):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string").selectExpr("*", "1 as tokens", "2 as domain", "3 as n_tokens").repartition(3)
    want = sorted(mixed(ROWS, cfg))
    assert sorted(map(tuple, mixing.mix(df, cfg).collect())) == want
    kept = mixing.mix_documents(df, cfg)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted({r[3] for r in want})


def test_mix_of_nothing(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string")
    assert mixing.mix(df.limit(0)).count() == 0
    assert mixing.mix(df.filter("text is null")).count() == 0
    twice = df.filter("doc_id < 20").unionAll(df.filter("doc_id < 20"))
    assert mixing.mix(twice, mixing.MixConfig(budget_permille=500)).count() > 0


def deduped(rows):
    seen, drop = {}, collections.defaultdict(set)
    for d, t, *_ in sorted(rows):
        lines = t.split("\n")
        for i in range(len(lines) - 2):
            w = tuple(lines[i : i + 3])
            if any(x.strip(quality.SPACES) for x in w) and seen.setdefault(w, (d, i)) != (d, i):
                drop[d].update((i, i + 1, i + 2))
    return [(d, "\n".join(x for i, x in enumerate(t.split("\n")) if i not in drop[d]), *r) for d, t, *r in rows]


@pytest.mark.skipif(not os.path.exists(DATA) or not os.path.exists(corpus_pipeline.TOKENIZER), reason="no data")
def test_pipeline_against_brute_force(spark):
    import sentencepiece

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in docs.collect()]
    rows = [r for r, m in zip(rows, quality.measure([r[1] for r in rows], quality.RepetitionRules()).to_pylist(), strict=True) if m["kept"]]
    rows = deduped(rows)
    keep = {d for d, _, _, k in components(rows, 5, 80) if k}
    rows = [r for r in rows if r[0] in keep]
    taken = {r[3] for r in mixed(rows, corpus_pipeline.MIX)}
    sp = sentencepiece.SentencePieceProcessor(model_file=corpus_pipeline.TOKENIZER)
    want = {d: sp.encode(t) for d, t, *_ in rows if d in taken}
    got = corpus_pipeline.run(spark, DATA)
    assert {r.doc_id: r.token_ids for r in got.collect()} == want
    assert got.filter(~F.col("decoded_equal")).count() == 0
    assert len(corpus_pipeline.STAGES) == 5


def test_stages_keep_columns_and_take_odd_rows(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "src1", 0), (3, " ".join(f"a{i}" for i in range(40)), "en", "src1", 5), (3, " ".join(f"a{i}" for i in range(40)), "en", "src1", 5), (None, " ".join(f"b{i}" for i in range(40)), None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        for t in (df, df.limit(0)):
            assert stage(spark, t, "").columns == df.columns
        df = stage(spark, df, "")
    assert corpus_pipeline.STAGES[-1][1](spark, df, "").count() <= 3

import random

import pytest

from tallyspark.llm.quality import RepetitionRules, keep_clean, longest_repeats, measure, repetition_metrics
from tallyspark.llm.common import word_hashes


def brute(words, n):
    out = [0] * n
    for i in range(n):
        for j in range(n):
            if i != j:
                k = 0
                while i + k < n and j + k < n and words[i + k] == words[j + k]:
                    k += 1
                out[i] = max(out[i], k)
    return out


@pytest.mark.parametrize("seed", range(12))
def test_longest_repeats_against_brute_force(seed):
    rng = random.Random(seed)
    docs = [[rng.choice("abcd"[: rng.randint(1, 4)]) for _ in range(rng.randint(0, 40))] for _ in range(6)]
    h, counts = word_hashes([" ".join(d).encode() for d in docs])
    want = [x for d in docs for x in brute(d, len(d))]
    assert longest_repeats(h, counts).tolist() == want


def test_base_columns():
    text = "a b c d e\nx # $\na b c d e\n\n  \nlast ü%"
    m = measure([text, None, "", " \n\t"], RepetitionRules()).to_pylist()
    words = text.split()
    assert m[0]["n_words"] == len(words) and m[0]["word_chars"] == sum(map(len, words))
    assert m[0]["n_symbols"] == 3 and m[0]["n_dup_lines"] == 1 and m[0]["n_repeat_words"] == 10
    assert m[0]["base_failed"] and not m[0]["kept"]
    assert all(x["n_words"] == 0 and x["base_failed"] and not x["kept"] for x in m[1:])


def test_verdict(spark):
    rng = random.Random(1)
    clean = " ".join(f"w{rng.randrange(10**9)}" for _ in range(300))
    junk = "spam " * 200
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(1, clean), (2, junk), (3, None), (4, clean + " " + passage), (5, f"{passage} x {passage}")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as kept", "2 as n_words")
    assert [r.doc_id for r in keep_clean(df).orderBy("doc_id").collect()] == [1, 4]
    assert keep_clean(df).columns == df.columns
    assert repetition_metrics(df).count() == 5
    assert repetition_metrics(df.limit(0)).count() == 0

import os
import random

import numpy as np
import pytest

from tallyspark.llm.sentencepiece import NONE, SPACE, Encoder, Vocabulary, best_states, decode, encode, maxplus
from tallyspark.llm.queries import TOKENIZER

pytestmark = pytest.mark.skipif(not os.path.exists(TOKENIZER), reason="no tokenizer file")


def chunked(e: Encoder, text: str, size: int) -> list[int]:
    w, halo = e.escape(text), 2 * e.longest
    n = -(-len(w) // size)
    parts = []
    for c in range(n):
        lead, k = min(c * size, halo), min(size, len(w) - c * size)
        parts.append((w[c * size - lead : c * size + k + halo], lead, k))
    t = [e.transfer(*p, i == 0, i == n - 1) for i, p in enumerate(parts)]
    at = [None, *[t[i][1][k] for i, k in enumerate(best_states([m for _, _, m in t]))], None]
    return [x for i, (w, lead, k) in enumerate(parts) for x in e._link(w, lead, lead + k, at[i], at[i + 1])[1]]


def random_text(rng):
    parts = ["a", "the", "  ", " ", "    ", "\n", "ing", "é", "日", "🙂", "\t", "function", "'", "....", SPACE, "aaaa", "000"]
    return "".join(rng.choice(parts) for _ in range(rng.randint(0, 60)))


def test_equals_the_library_whole_and_in_chunks():
    import sentencepiece

    sp, e, rng = sentencepiece.SentencePieceProcessor(model_file=TOKENIZER), Encoder(Vocabulary.load(TOKENIZER)), random.Random(4)
    for _ in range(250):
        text = random_text(rng)
        want = sp.encode(text)
        assert e.encode(text).tolist() == want
        if text:
            assert chunked(e, text, 40) == want and chunked(e, text, 17) == want
        if SPACE not in text:
            assert e.decode(np.array(want, dtype=np.int32)) == text


def unigram():
    pieces = ["<unk>", SPACE, "a", "b", "c", "ab", "abc", "bc", "ca", SPACE + "a", "cab", "aa", SPACE + "ab"]
    scores = [0, -2.0, -3.1, -3.3, -3.7, -4.0, -5.1, -4.3, -4.4, -3.0, -6.0, -4.9, -4.2]
    return Vocabulary(tuple(pieces), tuple(scores), "unigram", frozenset([0]), None, 0)


def test_unigram_scan_finds_the_best_path():
    v, rng = unigram(), random.Random(1)
    e = Encoder(v)

    def best(text):
        score = [0.0] + [NONE] * len(text)
        for p in range(1, len(text) + 1):
            score[p] = max((score[q] + v.scores[e.ids[text[q:p]]] for q in range(p) if text[q:p] in e.ids), default=NONE)
        return score[-1]

    for _ in range(200):
        text = "".join(rng.choice("abc ") for _ in range(rng.randint(1, 50)))
        for ids in (e.encode(text).tolist(), chunked(e, text, 8), chunked(e, text, 11)):
            assert e.decode(ids) == text
            assert sum(v.scores[i] for i in ids) == pytest.approx(best(e.escape(text)))


def test_maxplus_is_associative():
    rng = np.random.default_rng(0)
    a, b, c = (np.where(rng.random(s) < 0.3, NONE, rng.normal(size=s)) for s in ((3, 4), (4, 5), (5, 2)))
    assert np.allclose(maxplus(maxplus(a, b), c), maxplus(a, maxplus(b, c)), equal_nan=True)


def test_rows(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=TOKENIZER)
    long = "word and more words without end " * 40 + "x" * 300 + " tail"
    rows = [(1, "hello world\n"), (2, None), (3, ""), (4, long), (4, long), (5, "a" * 1000), (None, "same"), (6, "é日 " * 100)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as token_ids", "'x' as _key")
    out = encode(df, Vocabulary.load(TOKENIZER), chunk_chars=64)
    got = sorted((r.doc_id or 0, r.token_ids) for r in out.collect())
    assert got == sorted((i or 0, sp.encode(t or "")) for i, t in rows)
    assert all(r.decoded_equal for r in out.collect())
    back = decode(out, Vocabulary.load(TOKENIZER))
    assert sorted((r.doc_id or 0, r.text) for r in back.collect()) == sorted((i or 0, t or "") for i, t in rows)
    assert encode(df.limit(0), Vocabulary.load(TOKENIZER)).count() == 0

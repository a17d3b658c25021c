"""Operators 2, 3, 5, 7, 8, 9 and 10 against brute force on small fixtures with awkward rows."""

import base64
import collections
import hashlib
import math
import random
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyspark.llm import langid, linededup, lm, minhash, simhash, substring, warc
from tallyspark.llm.common import word_hashes

SCHEMA = "doc_id long, text string, lang string, source string"


def corpus(seed=0, n=60):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    text = lambda k: " ".join(rng.choice(vocab) for _ in range(k))
    base, passage = text(120), text(45)
    rows = [(i, text(rng.randint(1, 150)), "en", "s") for i in range(n)]
    for i in range(n, n + 12):  # near copies
        w = base.split()
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        rows.append((i, " ".join(w), "en", "s"))
    rows += [(100, text(20) + " " + passage + " " + text(9), "en", "s"), (101, passage + "\n" + text(30), "en", "s"), (102, "x " * 90, "en", "s")]
    rows += [(103, None, None, None), (104, "", "en", ""), (105, " \t\n", "en", "s"), (106, base, "en", "s"), (106, base, "en", "s"), (107, "Ünïcode word here\x1c", "en", "s"), (108, text(3000), "en", "s")]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    # clashing names on purpose
    return spark.createDataFrame(corpus(), SCHEMA).selectExpr("*", "1 as n_words", "'x' as spans", "2 as id", "3 as kept", "4 as label").repartition(3)


def words(t):
    return (t or "").encode().split()


@pytest.mark.parametrize("cfg", [substring.SubstringConfig(), substring.SubstringConfig(shard_words=500)])
def test_substring(docs, cfg):
    seen, want = collections.Counter(), []
    for _, t, *_ in corpus():
        w = words(t)
        seen.update(tuple(w[i : i + 35]) for i in range(len(w) - 34))
    for d, t, *_ in corpus():
        w = words(t)
        gone = set()
        for i in range(len(w) - 34):
            if seen[tuple(w[i : i + 35])] > 1:
                gone.update(range(i, i + 35))
        want.append((d, len(w), len(gone), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest()))
    got = substring.remove_repeats(docs, cfg=cfg)
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert substring.remove_repeats(docs.limit(0)).count() == 0


def test_repeated_windows_index():
    rng, cfg = random.Random(3), substring.SubstringConfig(window=5, gram=2)
    for _ in range(60):
        segs = list({tuple(rng.randrange(3) for _ in range(rng.randint(5, 14))) for _ in range(rng.randint(1, 8))})
        weight = np.array([rng.choice([1, 1, 2]) for _ in segs])
        seen = collections.Counter()
        for s, k in zip(segs, weight, strict=True):
            for i in range(len(s) - 4):
                seen[s[i : i + 5]] += k
        for s, spans in zip(segs, substring.repeated_windows([np.array(s, dtype=np.uint64) for s in segs], weight, cfg), strict=True):
            want = {j for i in range(len(s) - 4) if seen[s[i : i + 5]] > 1 for j in range(i, i + 5)}
            assert {j for a, b in spans for j in range(a, b)} == want


def test_simhash_edits(docs):
    rows = sorted(((d, t or "") for d, t, *_ in corpus()), key=lambda r: (r[0], r[1]))
    got = sorted(simhash.with_neighbours(simhash.edited_fingerprints(docs), 50).collect(), key=lambda r: (r.doc_id, r.edited_sha256))
    want = []
    for i, (d, t) in enumerate(rows):
        k, nxt = len(t) // 2, rows[(i + 1) % len(rows)][1]
        want.append((d, len(t), hashlib.sha256((t[: len(t) - k] + nxt[:k]).encode()).hexdigest()))
    assert [(r.doc_id, r.n_chars, r.edited_sha256) for r in got] == sorted(want, key=lambda r: (r[0], r[2]))
    by_text = {(d, len(t)): simhash._hex(simhash.fingerprints([t]))[0] for d, t in rows}
    assert all(r.fingerprint == by_text[r.doc_id, r.n_chars] for r in got)
    bits = {r.doc_id: int(r.fingerprint, 16) for r in got}
    for r in got:
        near = sum((bits[r.doc_id] ^ int(o.fingerprint, 16)).bit_count() <= 3 for o in got) - 1
        assert r.n_within == (near if r.doc_id % 50 == 0 else None)
    assert simhash.edited_fingerprints(docs.limit(0)).count() == 0


def test_block_tables_find_every_pair(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(128) for _ in range(20)]
    fps = base + [b ^ sum(1 << k for k in rng.sample(range(128), rng.randint(1, 6))) for b in base for _ in range(6)]
    df = spark.createDataFrame([(f"{x:032x}",) for x in fps], "fingerprint string")
    for radius, blocks in ((3, 5), (2, 4)):
        got = {(r.fingerprint, r.match) for r in simhash.within_radius(df, df, radius, blocks).collect()}
        assert got == {(f"{a:032x}", f"{b:032x}") for a in fps for b in fps if (a ^ b).bit_count() <= radius}


def test_neighbours_of_a_wide_radius(spark):
    """Every match within the radius is found and named, whatever the bits that differ."""
    rng = random.Random(6)
    base = [rng.getrandbits(128) for _ in range(5)]
    fps = base + [b ^ sum(1 << k for k in rng.sample(range(128), rng.randint(4, 20))) for b in base for _ in range(12)] + base[:2]
    every = [*fps, base[0]]
    df = spark.createDataFrame([*((i, f"{x:032x}") for i, x in enumerate(fps)), (None, f"{base[0]:032x}")], "doc_id long, fingerprint string")
    got = {r.doc_id: r for r in simhash.with_neighbours(df, 2, radius=16).collect()}
    assert len(got) == len(every)
    for i, x in enumerate(fps):
        near = [y for y in every if (x ^ y).bit_count() <= 16]
        assert got[i].n_within == (len(near) - 1 if i % 2 == 0 else None)
        assert got[i].matches == (sorted({f"{y:032x}" for y in near}) if i % 2 == 0 else None)
    assert got[None].n_within is None and got[None].matches is None


def test_lm_scores(docs):
    held = lambda d: zlib.crc32(str(d).encode()) % 7 == 2
    toks = [(d, [x.lower() for x in words(t)] + [b""]) for d, t, *_ in corpus()]
    c = collections.Counter(x for d, t in toks if not held(d) for x in t)
    n, v = sum(c.values()), len(c)
    cfg = lm.LmConfig(classes=50, dim=8, batch=64, block_bytes=2000)
    out = langid.held_out("doc_id", 7, 2)
    model, counts = lm.fit(docs.filter(~out), cfg=cfg)
    got = lm.score(docs, model, counts, out, cfg=cfg).collect()
    want = sorted((d, held(d), len(t), sum(c[x] > 0 for x in t), n, round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in t), 6)) for d, t in toks)
    assert sorted((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 for r in got)
    # the class distribution is normalised, and the share of the other class sums to one
    every = np.arange(model.other + 1)
    total = sum(np.exp(model.log_probabilities(np.array([3, 4, k]), np.array([0]))[2]) for k in every)
    assert total == pytest.approx(1, abs=1e-5)
    rest = [x for x in c if x not in set(model.names)]
    assert sum(c[x] + 1 for x in rest) + 1 == model.counts[-1] + (v - model.other) + 1
    empty_model, none = lm.fit(docs.limit(0), cfg=cfg)
    assert lm.score(docs, empty_model, none, out, cfg=cfg).count() == len(toks)


def plain_blocks(rows, names, limit):
    """Blocks of (rows, ids, starts, words), token by token; the end token after the names and all words if it has no name."""
    blocks, part, size = [], [], 0
    for r in rows:
        part.append(r)
        size += len(r[2] or "")
        if size >= limit:
            blocks, part, size = [*blocks, part], [], 0
    for part in [*blocks, part] if part else blocks:
        index, ids, starts = {t: i for i, t in enumerate(names)}, [], []
        for r in part:
            starts.append(len(ids))
            for t in lm.tokens(r[2]):
                ids.append(index.setdefault(t, len(index)))
            ids.append(-1)
        end = index.setdefault(b"", len(index))
        yield [r[:2] for r in part], [end if i < 0 else i for i in ids], starts, list(index)[len(names) :]


def test_lm_tokens_cost_less_than_a_python_step_each():
    """Cutting texts into token ids takes well under the CPU time of one dictionary step a token, with the same ids."""
    rng = random.Random(8)
    odd = [None, "", " ", "\t\n\x0b\x0c\r ", "A", " a  B\u00a0c\u0085d\x1ce ", "É\u2003é a", "x\x00y \U0001f600 Ab"]
    rows = [(rng.choice([None, i]), rng.choice([None, True, False]), " ".join([rng.choice(odd) or "", *(f"W{rng.randint(0, 50)}" for _ in range(rng.randint(0, 9)))]) if i % 3 else rng.choice(odd)) for i in range(400)]

    def batches(rows, n):
        return [pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows[i : i + n]), (pa.int64(), pa.bool_(), pa.string()))], names=["a", "b", "c"]) for i in range(0, len(rows), n)]

    for names in ([], [b""], [b"w1", b"", b"nowhere", b"a"], [b"w3", b"w2"]):
        for limit, n in ((1, 7), (100, 7), (100, 400), (5000, 50), (10**9, 33)):
            got = [([tuple(r.values()) for r in rows.to_pylist()], ids.tolist(), starts.tolist(), words.to_pylist()) for rows, ids, starts, words in lm._blocks_of(batches(rows, n), names, limit)]
            assert got == list(plain_blocks(rows, names, limit))
    big = [(1, True, " ".join(f"w{int(rng.paretovariate(0.6))}" for _ in range(300))) for _ in range(1000)]
    cut = batches(big, 300)

    def seconds(f):
        took = []
        for _ in range(5):
            t = time.process_time()
            f()
            took.append(time.process_time() - t)
        return min(took)

    assert seconds(lambda: list(lm._blocks_of(cut, [b""], 10**6))) < 0.6 * seconds(lambda: list(plain_blocks([tuple(r.values()) for b in cut for r in b.to_pylist()], [b""], 10**6)))


def test_lm_sums_and_orders():
    rng = np.random.default_rng(3)
    words = [b"", b"a", b"zz", "é\u2003".encode(), b"x" * 300, *(b"w%d" % i for i in range(500))]
    h, n = word_hashes(words)
    want = np.zeros(len(words), dtype=np.uint64)
    want[n > 0] = h
    want = np.stack([want & np.uint64(1023), (want >> np.uint64(32)) & np.uint64(1023)], axis=1).astype(np.int64)
    assert (lm.hashed_rows(words, 1024) == want).all() and (lm.hashed_rows(pa.array(words, pa.binary())[3:], 1024) == want[3:]).all()
    assert lm.hashed_rows([], 8).shape == (0, 2)
    for top in (1, 50, 1 << 40, 1 << 62):  # the last doesn't fit beside positions
        key = rng.integers(0, top, 1000)
        assert (lm.in_order(key) == np.argsort(key, kind="stable")).all()
    # a table larger than a batch's rows is updated at the rows hit, as if it were summed as a whole
    cfg, g = lm.LmConfig(), rng.normal(size=(60, 4)).astype(np.float32)
    index = rng.integers(0, 40, 60)
    for size in (40, 100, 70_000):
        model = lm.Lbl.start([(b"", 5)], 9, 4, np.zeros((64, 64)), cfg)
        model.w["hr"], state, touched = np.zeros((size, 4), dtype=np.float32), {}, {}
        model._rows("hr", index, g, cfg, state, touched)
        sums = np.zeros((size, 4))
        np.add.at(sums, index, g)
        assert model.w["hr"] == pytest.approx(-cfg.rate * sums / np.sqrt(sums**2 + 1e-8), abs=1e-5)
        assert (touched["hr"] == np.isin(np.arange(size), index)).all()


def test_lm_tokens_outside_the_classes(spark):
    """Every token has its own probability given its context, and is a context of its own; all of them sum to one."""
    rows = [(i, " ".join(f"a{k} b{k}" if (i + k) % 3 else f"b{k} a{k}" for k in range(40))) for i in range(30)]
    rows = [(i, "the " * 50 + t) for i, t in rows]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    cfg = lm.LmConfig(classes=2, dim=8, batch=64, block_bytes=2000, rate=0.3, rounds=10)
    model, counts = lm.fit(df, cfg=cfg)
    c = {bytes(r.token): r.c for r in counts.collect()}
    rest = [x for x in c if x not in set(model.names)]
    share = lambda n: (n + 1) / (model.counts[-1] + len(rest) + 1)
    k, size = model.other, len(model.w["hr"])
    rows = lm.hashed_rows(rest, size)
    assert len(set(map(tuple, rows))) == len(rest) == 80  # vectors of their own
    tilts = {}
    for before in (b"a1", b"b2"):
        ids = np.array([[k + rest.index(before), k + i] for i in range(len(rest))])
        got = [model.logs(i, np.array([0]), rows) for i in ids]
        tilts[before] = {x: g[1][1] for x, g in zip(rest, got, strict=True)}
        assert sum(share(c[x]) * math.exp(g[1][1] - g[2][1]) for x, g in zip(rest, got, strict=True)) + share(0) * math.exp(-got[0][2][1]) == pytest.approx(1, abs=1e-5)
    assert tilts[b"a1"][b"b1"] > tilts[b"b2"][b"b1"]  # the pair that was seen
    few = lm.LmConfig(classes=2, sample=40)
    top = [(t, c[t]) for t in model.names]
    sample = lm.tail_sample(counts, [{"token": t} for t, _ in top], few)
    assert len(sample) == 40 and sum(w for _, w in sample) == pytest.approx(sum(c[x] + 1 for x in rest), rel=0.35)
    # the score of a text: its class logarithms, tilted shares of tokens seen, plain ones of others
    asked = spark.createDataFrame([(1, "the a1 b1 never a2")], "doc_id long, text string")
    score = lm.score(asked, model, counts, F.lit(True), cfg=cfg).first().score
    words = [b"a1", b"b1", b"never", b"a2"]
    index = {t: i for i, t in enumerate(model.names + words)}
    ids = np.array([index[t] for t in [b"the", *words, b""]])
    cls, tilt, total = model.logs(ids, np.array([0]), lm.hashed_rows(words, size))
    want = cls.sum() + sum(math.log(share(c.get(x, 0))) + (tilt[j + 1] if x in c else 0) - total[j + 1] for j, x in enumerate(words))
    assert score == pytest.approx(want / math.log(10), abs=1e-4)


def test_lm_sums_over_all_types(spark):
    """With more types than any sample held, the probabilities of all tokens of the other class and the unseen kind sum to one."""
    rng = random.Random(4)
    df = spark.createDataFrame([(i, " ".join(f"w{rng.randint(0, 3000)}" for _ in range(200))) for i in range(60)], "doc_id long, text string")
    cfg = lm.LmConfig(classes=5, dim=8, batch=64, block_bytes=5000, rate=0.3, rounds=2)
    model, counts = lm.fit(df, cfg=cfg)
    c = {bytes(r.token): r.c for r in counts.collect()}
    rest = [x for x in c if x not in set(model.names)]
    assert len(rest) > 2000
    k, whole = model.other, model.counts[-1] + len(rest) + 1
    rows = lm.hashed_rows(rest, len(model.w["hr"]))
    for before in (0, 7, 1234):
        ids = np.array([x for i in range(len(rest)) for x in (k + before, k + i)])
        _, tilt, total = model.logs(ids, np.arange(0, len(ids), 2), rows)
        assert np.ptp(tilt[1::2]) > 0.1  # tilts are learned
        p = (np.array([c[x] + 1 for x in rest]) / whole * np.exp(tilt[1::2] - total[1::2])).sum() + math.exp(-total[1]) / whole
        assert p == pytest.approx(1, abs=1e-4)


def test_line_dedup(spark):
    rows = [(1, "a\nb\nc\nd"), (2, "x\na\nb\nc"), (2, "x\na\nb\nc"), (3, "a\nb\nc\nb\nc\nd\na\nb\nc"), (4, None), (5, ""), (6, "\n\n\n\n"), (7, "a\nb"), (None, "a\nb\nc")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("pos", F.lit(1)).withColumn("n_lines", F.lit("x"))
    got = linededup.dedup_lines(df)
    assert got.columns == ["doc_id", "text", "pos", "n_lines", "n_removed_lines"]
    want = [(None, "a\nb\nc", 3, 0), (1, "d", 4, 3), (2, "x", 4, 3), (2, "x", 4, 3), (3, "", 9, 9), (4, None, 0, 0), (5, "", 1, 0), (6, "\n\n\n\n", 5, 0), (7, "a\nb", 2, 0)]
    assert sorted(((r.doc_id, r.text, r.n_lines, r.n_removed_lines) for r in got.collect()), key=str) == sorted(want, key=str)
    assert linededup.dedup_lines(df.limit(0)).count() == 0


def test_warc(spark, tmp_path):
    big = "é<p>\r\n\r\nWARC/1.1 " * 3000
    rows = [(1, "http://a\nb", "x"), (2, "u", "x"), (3, "u", big), (4, None, None), (5, "u", ""), (6, "u", "y"), (9, "u", big), (9, "u", big)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("id", F.lit(1)).repartition(3)
    cfg = warc.WarcConfig(chunk_bytes=1000, archive_bytes=5000)
    top = {}
    for p, _, h in rows:
        top[h or ""] = max(top.get(h or "", p), p)
    dig = lambda h: base64.b32encode(hashlib.sha1(h.encode()).digest()).decode()
    want = sorted((p, len((h or "").encode()), dig(h or ""), "response" if top[h or ""] == p else "revisit", None if top[h or ""] == p else top[h or ""]) for p, _, h in rows)
    got = warc.round_trip(df, cfg).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == sorted(want, key=str)
    assert all(r.digest_ok for r in got)
    archives, folder = warc.archive_pages(df, cfg)
    chunks = sorted((r for r in warc.read_chunks(archives, folder, cfg).collect() if r.record_id == "6" or r.record_id == "3"), key=lambda r: (r.record_id, r.chunk_no))
    assert b"".join(bytes(r.data) for r in chunks if r.record_id == "6") == b"y"
    some = warc.round_trip(df, warc.WarcConfig(min_revisit_bytes=100)).filter("record_type = 'revisit'").collect()
    assert [r.page_id for r in some] == [3]
    assert warc.round_trip(df.limit(0), cfg).count() == 0


def test_language_id(spark):
    rng = random.Random(2)
    letters = {"xx": "aeiou", "yy": "bcdfg", "zz": "äöüß"}
    rows = [(i, "".join(rng.choice(letters[k] + " ") for _ in range(rng.randint(5, 300))), k) for i, k in enumerate(["xx", "yy", "zz"] * 40)]
    rows += [(900, None, "xx"), (901, "", "yy"), (902, "123 !", "xx"), (903, "aeiou" * 3, None), (904, "a" * 5000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit(1))
    cfg = langid.LangConfig(per_lang=30, epochs=20, batch=64)
    out = langid.held_out("doc_id", 5, 0)
    net = langid.train(df.filter(~out), cfg)
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(df, net, cfg).collect()}
    test = [r for r in rows[:120] if zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[1].strip()]
    assert sum(got[r[0]][0] == r[2] for r in test) >= 0.9 * len(test)
    assert all(got[i] == ("und", 0.0) for i in (900, 901, 902)) and got[903][0] == "xx" and all(0 <= s <= 1 for _, s in got.values())
    assert set(langid.label_positions(net, "aeiou" * 30, cfg)) == {"xx"}
    assert {r.lang_pred for r in langid.predict(df, langid.train(df.limit(0), cfg), cfg).collect()} == {"und"}


def test_every_language_is_learned(spark):
    df = spark.createDataFrame([(f"text {j} of {i}", f"l{i:03d}") for i in range(300) for j in range(3)] + [("same", "l000")] * 900, "text string, lang string")
    sample = langid.training_sample(df, langid.LangConfig(per_lang=3), "text", "lang")
    assert [r["lang"] for r in sample] == [f"l{i:03d}" for i in range(300) for _ in range(3)]
    assert len({(r["lang"], r["t"]) for r in sample}) == 900


def plain_pass(net, data):
    """The network's probabilities over a whole text, byte by byte, with the state carried from end to end."""
    sig, n = (lambda v: 1 / (1 + np.exp(-v))), net.h
    logits = np.tile(net.w["b"], (len(data), 1))
    for d, part in (("f", slice(0, n)), ("b", slice(n, 2 * n))):
        h = np.zeros(n)
        for t in range(len(data)) if d == "f" else range(len(data) - 1, -1, -1):
            gx, gh = net.w[d + "x"][data[t]], h @ net.w[d + "h"]
            z, r = sig(gx[:n] + gh[:n]), sig(gx[n : 2 * n] + gh[n : 2 * n])
            h = z * h + (1 - z) * np.tanh(gx[2 * n :] + r * gh[2 * n :])
            logits[t] += h @ net.w["o"][part]
    p = np.exp(logits)
    return p / p.sum(axis=1, keepdims=True)


def test_language_id_is_a_pass_over_the_whole_text():
    rng, cfg = random.Random(3), langid.LangConfig(epochs=10, batch=16)
    texts = ["".join(rng.choice("aeiou " if i % 2 else "bcdfg ") for _ in range(200)) for i in range(40)]
    cut = langid.Rows([t.encode() for t in texts], cfg.steps)
    y = np.repeat([i % 2 for i in range(40)], cut.n)
    net = langid.BiGru(["con", "vow"], cfg.hidden, 3).fit(*(lambda p: (p[0], y, p[1]))(cut.part(0, len(y))), cfg)
    for size in (1, 200, cfg.row, cfg.row + 1, 5 * cfg.row):
        text = "".join(rng.choice("aeiou bcd") for _ in range(size - 1)) + "a"
        data, rows = text.encode(), []
        for at in range(0, size, cfg.row):  # a row's own bytes, seen with halo bytes on both sides; up to a row the whole text
            begin = max(0, at - cfg.halo)
            rows.append(plain_pass(net, data[begin : at + cfg.row + cfg.halo])[at - begin :][: cfg.row])
        want = np.concatenate(rows)
        assert len(want) == size
        (lang,), (score,) = langid.predict_texts(net, [text], cfg)
        assert score == pytest.approx(want.mean(axis=0).max(), abs=1e-5) and lang == net.langs[want.mean(axis=0).argmax()]
        assert langid.label_positions(net, text, cfg) == [net.langs[k] for k in want.argmax(axis=1)]


def test_bigru_gradients():
    net = langid.BiGru(["a", "b"], 3, 1)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    rng = np.random.default_rng(0)
    x, y, live = rng.integers(0, 256, (5, 4)), np.array([0, 1, 1, 0]), np.ones((5, 4))
    live[3:, 1] = 0
    _, g = net.gradients(x, y, live)
    for k in net.w:
        at = tuple(rng.integers(0, s) for s in net.w[k].shape) if k[1:] != "x" else (x[0, 0], 1)
        keep, d = net.w[k][at], []
        for e in (1e-3, -1e-3):
            net.w[k][at] = keep + e
            d.append(net.gradients(x, y, live)[0])
        net.w[k][at] = keep
        assert (d[0] - d[1]) / 2e-3 == pytest.approx(float(g[k][at]), abs=2e-3)


def components(rows, k, percent):
    sets, up = [], {}

    def find(a):
        while up.setdefault(a, a) != a:
            a = up[a]
        return a

    for d, t, *_ in rows:
        w = [x.lower() for x in words(t)]
        s = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
        sets.append((d, s))
        find(d)
    for i, (a, s) in enumerate(sets):
        for b, r in sets[:i]:
            if s and r and 100 * len(s & r) >= percent * len(s | r):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return sorted((d, len(s), find(d), find(d) == d) for d, s in sets)


@pytest.mark.parametrize("cfg", [minhash.NearConfig(), minhash.NearConfig(block=3), minhash.NearConfig(shingle=5)])
def test_near_dedup(docs, cfg):
    want = components(corpus(), cfg.shingle, cfg.percent)
    got = minhash.near_components(docs, cfg=cfg)
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got.collect()) == want
    kept = minhash.keep_one(docs, cfg=cfg)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {d for d, _, _, k in want if k}


def test_near_dedup_of_nothing(docs, spark):
    assert minhash.near_components(docs.limit(0)).count() == 0
    odd = spark.createDataFrame([(None, "a b"), (None, "a b"), (1, None)], "doc_id long, text string")
    assert sorted(((r.doc_id, r.component_id, r.kept) for r in minhash.near_components(odd).collect()), key=str) == [(1, 1, True), (None, None, True), (None, None, True)]


def test_posterior_bounds():
    cfg = minhash.NearConfig()
    for n, m in cfg.least_matches():
        tail = lambda k: sum(math.comb(n + 1, i) * 0.8**i * 0.2 ** (n + 1 - i) for i in range(k + 1))
        assert tail(m) >= cfg.miss > tail(m - 1)

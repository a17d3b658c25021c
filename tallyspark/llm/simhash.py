"""Operator 3, document fingerprints: SimHash of 128 bits.

Each term (a word, and a pair of neighbouring words, which weighs more) votes with its weight on every bit by the sign
of that bit of its hash. Fingerprints within a Hamming radius are found by permuted block tables: the bits are cut into
blocks; two fingerprints within the radius agree on the remaining blocks for at least one choice of `radius` blocks, so
each choice's other blocks, as leading key, make one table.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import gram_hashes, materialize, mix64, shuffle_parts, slices, word_hashes

BITS = 128
HALF = 64


@dataclass(frozen=True)
class SimHashConfig:
    word_weight: float = 0.25
    pair_weight: float = 1.0
    slice_bytes: int = 1_000_000
    docs_per_vote: int = 256


_SIGNS = (2.0 * np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1) - 1).astype(np.float32)


def _votes(term: np.ndarray, doc: np.ndarray, weight: np.ndarray, n_docs: int) -> np.ndarray:
    """(n_docs, BITS) sums: byte by byte of the hashes, as histograms times the signs of each byte value's bits."""
    out = np.empty((n_docs, BITS), dtype=np.float32)
    planes = [(mix64(term ^ np.uint64(salt)), salt_at) for salt_at, salt in enumerate((0x5851F42D4C957F2D, 0x14057B7EF767814F))]
    base = doc * 256
    for h, at in planes:
        raw = h.view(np.uint8).reshape(-1, 8)
        for b in range(8):
            hist = np.bincount(base + raw[:, b], weights=weight, minlength=n_docs * 256)
            out[:, at * HALF + 8 * b : at * HALF + 8 * b + 8] = hist.reshape(n_docs, 256).astype(np.float32) @ _SIGNS
    return out


def fingerprints(texts: list[str], cfg: SimHashConfig = SimHashConfig()) -> np.ndarray:
    """(len(texts), 16) bytes. A term counts once for each time it stands, dampened: weight times 1 + log of the count.
    Texts without words have the fingerprint of no votes, all zero bits; equal texts have equal fingerprints."""
    blobs = [t.encode("utf-8", "surrogatepass") for t in texts]
    out = np.zeros((len(texts), BITS // 8), dtype=np.uint8)
    for i, j in slices([len(b) for b in blobs], cfg.slice_bytes):
        h, counts = word_hashes(blobs[i:j])
        doc = np.repeat(np.arange(j - i), counts)
        pairs = gram_hashes(h, 2)
        ok = doc[:-1] == doc[1:]
        term, where = np.concatenate([h, pairs[ok]]), np.concatenate([doc, doc[:-1][ok]])
        kind = np.concatenate([np.full(len(h), cfg.word_weight), np.full(int(ok.sum()), cfg.pair_weight)])
        key = mix64(term + where.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(key)
        key = key[order]
        head = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.empty(0, np.int64)
        tf = np.diff(np.append(head, len(key)))
        pick = order[head]
        by_doc = np.argsort(where[pick], kind="stable")
        pick, tf = pick[by_doc], tf[by_doc]
        term, where, weight = term[pick], where[pick], kind[pick] * (1 + np.log(np.maximum(tf, 1)))
        edges = np.searchsorted(where, np.arange(0, j - i + cfg.docs_per_vote, cfg.docs_per_vote))
        for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
            first = k * cfg.docs_per_vote
            n = min(cfg.docs_per_vote, j - i - first)
            v = _votes(term[a:b], where[a:b] - first, weight[a:b], n)
            out[i + first : i + first + n] = np.packbits(v > 1e-3, axis=1)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """1 - Hamming distance / BITS, row by row."""
    return 1.0 - np.bitwise_count(a ^ b).sum(axis=1) / BITS


def _hex(fp: np.ndarray) -> list[str]:
    return [r.tobytes().hex() for r in fp]


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", cfg: SimHashConfig = SimHashConfig()) -> DataFrame:
    """(id_col, fingerprint): a row per row of docs; null text is empty. Other columns are not read."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(_hex(fingerprints([t or "" for t in b.column(1).to_pylist()], cfg)), pa.string())], names=[id_col, "fingerprint"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, fingerprint string")


def _half(hex_col, at: int):
    """Sixteen hexadecimal digits as a signed long, bit for bit."""
    part = F.substring(hex_col, at, 16)
    high, low = F.conv(F.substring(part, 1, 8), 16, 10).cast("long"), F.conv(F.substring(part, 9, 8), 16, 10).cast("long")
    return F.shiftleft(high, 32).bitwiseOR(low)


def within_radius(queries: DataFrame, fps: DataFrame, radius: int = 3, blocks: int = 5, key: str = "fingerprint") -> DataFrame:
    """(fingerprint, match, distance): all pairs of a distinct query fingerprint and a distinct one of fps within radius.

    radius < blocks. A pair counts only in the first table in which it meets. Copies stand as one fingerprint, so a group
    of copies is one row here; join back on the fingerprint for the documents. Null fingerprints match nothing.
    """
    width = BITS // 4 // blocks  # hexadecimal digits of a block; the last block has what is left
    spans = [(b * width + 1, width if b < blocks - 1 else BITS // 4 - width * (blocks - 1)) for b in range(blocks)]
    tables = list(combinations(range(blocks), blocks - radius))

    def keyed(df, name):
        rows = df.select(F.col(key).alias(name)).filter(F.col(name).isNotNull()).distinct()
        entries = [F.struct(F.lit(i).alias("t"), F.concat(*[F.substring(name, *spans[b]) for b in blocks_]).alias("k")) for i, blocks_ in enumerate(tables)]
        return rows.select(name, F.explode(F.array(*entries)).alias("e")).select(name, "e.t", "e.k")

    same = [F.substring("fingerprint", *s) == F.substring("match", *s) for s in spans]
    first = F.coalesce(*[F.when(_all(same[b] for b in blocks_), F.lit(i)) for i, blocks_ in enumerate(tables)])
    distance = sum((F.bit_count(_half(F.col("fingerprint"), at).bitwiseXOR(_half(F.col("match"), at))) for at in (1, 17)), F.lit(0))
    q, m = keyed(queries, "fingerprint"), keyed(fps, "match")
    pairs = q.join(m, (q.t == m.t) & (q.k == m.k)).filter(first == q.t)
    return pairs.select("fingerprint", "match", distance.cast("int").alias("distance")).filter(F.col("distance") <= radius)


def _all(conditions):
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def _edit(text: str, nxt: str) -> str:
    k = len(text) // 2
    return text[: len(text) - k] + nxt[:k]


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", cfg: SimHashConfig = SimHashConfig()) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next: a row per row of docs.

    A document's next one is the following in order of id, then text; after the last comes the first. Null ids come
    first, null texts are empty. Texts move once, to ranges of ids cut at the ids' quantiles; the first rows of a range
    go to the range before as well. Each range streams in order. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    parts = shuffle_parts(spark)
    ids = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("k"))
    q = ids.agg(F.percentile_approx("k", [i / parts for i in range(1, parts)] or [0.5], 10_000).alias("q")).first()["q"]
    cuts = sorted(set(q or []))[: parts - 1]
    edges = F.array(*[F.lit(c).cast("long") for c in cuts]) if cuts else F.array().cast("array<bigint>")
    bucket = lambda k: F.size(F.filter(edges, lambda e: e <= k))
    heads = {r["b"]: r["k"] for r in ids.groupBy(bucket(F.col("k")).alias("b")).agg(F.min("k").alias("k")).collect()}  # a row per range
    order = sorted(heads)
    before = {heads[b]: order[i - 1] for i, b in enumerate(order)}  # the first range's head goes to the last range
    moves = F.create_map(*[F.lit(x) for kv in before.items() for x in kv]) if before else F.create_map().cast("map<bigint,int>")
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("k"), F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("b", bucket(F.col("k")))
    also = F.try_element_at(moves, F.col("k"))
    own = F.struct(F.col("b").alias("b"), F.lit(0).alias("guest"))
    rows = rows.withColumn("at", F.explode(F.when(also.isNull(), F.array(own)).otherwise(F.array(own, F.struct(also.alias("b"), F.lit(1).alias("guest"))))))
    rows = rows.select("doc_id", "text", F.col("at.b").alias("b"), F.col("at.guest").alias("guest"), "k")
    dealt = rows.repartitionById(parts, F.col("b")).sortWithinPartitions("guest", "k", "text")

    def run(batches):
        held, closed = None, False
        for b in batches:
            out = []
            for r in zip(*[b.column(c).to_pylist() for c in ("doc_id", "text", "guest")], strict=True):
                if closed:
                    continue
                if held is not None:
                    out.append((held[0], held[1], r[1]))
                held, closed = r, r[2] == 1
            if out:
                yield _edited(out, cfg)

    ddl = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return dealt.mapInArrow(run, ddl)


def _edited(rows: list[tuple], cfg: SimHashConfig) -> pa.RecordBatch:
    texts, nxt = [r[1] for r in rows], [r[2] for r in rows]
    edits = [_edit(a, b) for a, b in zip(texts, nxt, strict=True)]
    chain = all(a is b or a == b for a, b in zip(texts[1:], nxt[:-1], strict=True))
    own = fingerprints([*texts, nxt[-1]] if chain else texts, cfg)
    follow = own[1:] if chain else fingerprints(nxt, cfg)
    own = own[: len(rows)]
    changed = fingerprints(edits, cfg)
    sha = [hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest() for e in edits]
    cols = [pa.array([r[0] for r in rows], pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array(sha), pa.array(_hex(own)), pa.array(_hex(changed)), pa.array(likeness(own, changed)), pa.array(likeness(own, follow))]
    return pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])


def matches_of(queries: DataFrame, classes: DataFrame, radius: int) -> DataFrame:
    """(fingerprint, n_within, matches): for each distinct query fingerprint, the rows that classes (fingerprint, n) count
    within the radius, less one, and their distinct fingerprints in order. Exact at every radius: all queries, which every
    task holds at 16 bytes each, are compared with every class."""
    asked = [r["fingerprint"] for r in queries.select("fingerprint").filter("fingerprint is not null").distinct().collect()]
    shared = queries.sparkSession.sparkContext.broadcast(np.frombuffer(bytes.fromhex("".join(asked)), dtype=np.uint64).reshape(-1, 2))

    def run(batches):
        q = shared.value
        for b in batches:
            hexes = b.column(0).to_pylist()
            m = np.frombuffer(bytes.fromhex("".join(hexes)), dtype=np.uint64).reshape(-1, 2)
            step = max(1, 1_000_000 // max(1, len(m)))
            for i in range(0, len(q), step):
                d = np.bitwise_count(q[i : i + step, None, 0] ^ m[:, 0]) + np.bitwise_count(q[i : i + step, None, 1] ^ m[:, 1])
                at, of = np.nonzero(d <= radius)
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array(_hex(q[i + at])), pa.array([hexes[k] for k in of]), b.column(1).take(pa.array(of))], names=["fingerprint", "match", "n"])

    pairs = classes.filter("fingerprint is not null").select("fingerprint", "n").mapInArrow(run, "fingerprint string, match string, n long")
    return pairs.groupBy("fingerprint").agg((F.sum("n") - 1).alias("n_within"), F.sort_array(F.collect_list("match")).alias("matches"))


def with_neighbours(rows: DataFrame, every: int, radius: int = 3) -> DataFrame:
    """rows (doc_id, fingerprint, ...), n_within and matches: for ids divisible by `every` the number of other rows whose
    fingerprint lies within the radius, of all rows, and the distinct fingerprints of those and of the row itself; NULL for
    the rest and for null ids. A group of copies is one entry; join back on the fingerprint for the documents."""
    rows = materialize(rows, "fingerprints")
    asks = F.coalesce(F.col("doc_id") % every == 0, F.lit(False))
    classes = materialize(rows.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n")), "fingerprint-classes")
    found = matches_of(rows.filter(asks), classes, radius)
    asked = rows.filter(asks).join(found, "fingerprint", "left").select(*rows.columns, "n_within", "matches")
    return asked.unionByName(rows.filter(~asks).withColumn("n_within", F.lit(None).cast("long")).withColumn("matches", F.lit(None).cast("array<string>")))

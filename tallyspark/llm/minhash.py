"""Operator 10, MinHash near-dedup with sequential Bayesian verification.

Documents with equal shingle sets stand as one class. Classes that share a band of their signatures meet in a candidate
cluster. Within a cluster pairs are compared batch by batch of their signatures; a pair goes as soon as the posterior
probability (uniform prior) that its similarity reaches the threshold falls under `miss`; survivors are verified exactly
on their full sets. Pairs that are connected already need no check. Components follow from the verified links.

A cluster over `block` classes or `block_bytes` of sets is split: blocks are linked by themselves, then one member of each block's components
against the others, then all members of every component but the largest against all rows, block by block.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, few, gram_hashes, materialize, mix64, slices, small, word_hashes
from .graph import components


@dataclass(frozen=True)
class NearConfig:
    shingle: int = 2
    percent: int = 80
    bands: int = 32
    rows: int = 5
    batch: int = 32
    miss: float = 1e-6
    block: int = 2000
    block_bytes: int = 32_000_000
    seed: int = 11
    slice_bytes: int = 1_000_000
    max_broadcast_rows: int = 1_000_000

    @property
    def hashes(self) -> int:
        return self.bands * self.rows

    def least_matches(self) -> list[tuple[int, int]]:
        """(n, m): after n compared hashes a pair with under m matches goes. P(J >= t | m of n) = P(Bin(n + 1, t) <= m)."""
        t, out = self.percent / 100, []
        for n in range(self.batch, self.hashes + 1, self.batch):
            total, m = 0.0, -1
            while total < self.miss:
                m += 1
                total += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            out.append((n, m))
        return out


def shingle_sets(texts: list[str | None], cfg: NearConfig) -> list[np.ndarray]:
    """Sorted distinct hashes of the shingles of each lower-cased text; of a text with fewer words, its whole sequence."""
    blobs = [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]
    out = []
    for i, j in slices([len(b) for b in blobs], cfg.slice_bytes):
        h, counts = word_hashes(blobs[i:j])
        g, at = gram_hashes(h, cfg.shingle), 0
        for n in counts.tolist():
            if n >= cfg.shingle:
                out.append(np.unique(g[at : at + n - cfg.shingle + 1]))
            elif n:
                out.append(mix64(gram_hashes(h[at : at + n], n) + np.uint64(n)))
            else:
                out.append(np.empty(0, dtype=np.uint64))
            at += n
    return out


def _family(cfg: NearConfig) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(cfg.seed)
    return rng.integers(0, 2**31, cfg.hashes, dtype=np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 2**32, cfg.hashes, dtype=np.uint32)


def signature(s: np.ndarray, family) -> np.ndarray:
    """The smallest value of each hash function over the set, of whose 64 bits the lower half is taken."""
    a, b = family
    low, half = np.full(len(a), np.iinfo(np.uint32).max, dtype=np.uint32), s.astype(np.uint32)
    for i in range(0, len(s), 512):  # stays in cache
        low = np.minimum(low, (half[None, i : i + 512] * a[:, None] + b[:, None]).min(axis=1))
    return low


def _bands(sig: np.ndarray, cfg: NearConfig) -> np.ndarray:
    rows = sig.reshape(cfg.bands, cfg.rows).astype(np.uint64)
    h = np.arange(cfg.bands, dtype=np.uint64)
    for k in range(cfg.rows):
        h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + rows[:, k])
    return h.view(np.int64)


def features(docs: DataFrame, id_col: str, text_col: str, cfg: NearConfig) -> DataFrame:
    """(doc_id, n_shingles, digest, bands) of every row."""

    def run(batches):
        family = _family(cfg)
        for b in small(batches, 1):
            sets = shingle_sets(b.column(1).to_pylist(), cfg)
            bands = [_bands(signature(s, family), cfg) if len(s) else None for s in sets]
            digest = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(digest, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "digest", "bands"])

    return docs.select(id_col, text_col).mapInArrow(run, "doc_id long, n_shingles long, digest binary, bands array<long>")


class _Forest:
    def __init__(self, n: int):
        self.up = np.arange(n)

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return int(i)

    def roots(self) -> np.ndarray:
        while True:
            nxt = self.up[self.up]
            if (nxt == self.up).all():
                return nxt
            self.up = nxt


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def link_rows(sigs: np.ndarray, sets: list[np.ndarray], cfg: NearConfig, left=None, group=None) -> list[tuple[int, int]]:
    """Verified links that connect all linked rows. left: rows to compare with all others (default: every row);
    group: labels of rows known to be connected."""
    n = len(sets)
    size = np.array([len(s) for s in sets])
    forest, out = _Forest(n), []
    if group is not None:
        _, first, back = np.unique(group, return_index=True, return_inverse=True)
        forest.up = first[back.ravel()]
    least = cfg.least_matches()
    for i in range(n) if left is None else left:
        roots = forest.roots()
        j = np.arange(i + 1, n) if left is None else np.arange(n)
        j = j[roots[j] != roots[i]]
        lo, hi = np.minimum(size[j], size[i]), np.maximum(size[j], size[i])
        j = j[100 * lo >= cfg.percent * hi]
        hits, done = np.zeros(len(j), dtype=np.int64), 0
        for upto, m in least:
            hits = hits + (sigs[j, done:upto] == sigs[i, done:upto]).sum(axis=1)
            keep, done = hits >= m, upto
            j, hits = j[keep], hits[keep]
            if not len(j):
                break
        for k in j[np.argsort(-hits, kind="stable")].tolist():
            if forest.find(k) != forest.find(i) and linked(sets[i], sets[k], cfg.percent):
                forest.up[forest.find(k)] = forest.find(i)
                out.append((i, k))
    return out


def _group_linker(cfg: NearConfig, sided: bool):
    def run(t: pa.Table) -> pa.Table:
        ids = t.column("id").to_numpy()
        sets = [np.frombuffer(x.as_py(), dtype=np.uint64) for x in t.column("set")]
        sigs = np.stack([np.frombuffer(x.as_py(), dtype=np.uint32) for x in t.column("sig")])
        if sided:
            left = np.flatnonzero(t.column("side").to_numpy(zero_copy_only=False)).tolist()
            links = link_rows(sigs, sets, cfg, left, t.column("comp").to_numpy())
        else:
            links = link_rows(sigs, sets, cfg)
        return pa.table({"a": pa.array([int(ids[i]) for i, _ in links], pa.int64()), "b": pa.array([int(ids[k]) for _, k in links], pa.int64())})

    return run


def _with_sets(docs: DataFrame, members: DataFrame, id_col: str, text_col: str, cfg: NearConfig) -> DataFrame:
    """members (id, cid, block, n) with sig and set of the document of that id."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t")).join(broadcast_if_small(members, cfg.max_broadcast_rows), "id")

    def run(batches):
        family = _family(cfg)
        for b in small(batches, 3):
            at = b.schema.names.index
            sets = shingle_sets(b.column(at("t")).to_pylist(), cfg)
            yield pa.RecordBatch.from_arrays([b.column(at("id")), b.column(at("cid")), b.column(at("block")), b.column(at("n")), pa.array([signature(s, family).tobytes() for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["id", "cid", "block", "n", "sig", "set"])

    return rows.select("id", "cid", "block", "t", "n").mapInArrow(run, "id long, cid long, block long, n long, sig binary, set binary")


def _parts(rows, shingles, cfg: NearConfig):
    """How many blocks so many rows with so many shingles in all need."""
    return F.greatest(F.ceil(rows / cfg.block), F.ceil(8 * shingles / cfg.block_bytes), F.lit(1))


def _blocks(members: DataFrame, cfg: NearConfig) -> DataFrame:
    """members (id, cid, n) with block, and large: whether the cluster has more than one."""
    parts = members.groupBy("cid").agg(_parts(F.count(F.lit(1)), F.sum("n"), cfg).alias("parts")).filter("parts > 1")
    t = members.drop("block").join(parts, "cid", "left")
    return t.withColumn("block", F.coalesce(F.pmod(F.xxhash64("id"), F.col("parts")), F.lit(0)).cast("long")).withColumn("large", F.col("parts").isNotNull()).drop("parts")


LINKS = "a long, b long"


def _linked(groups, shingles: int, cfg: NearConfig) -> DataFrame:
    """(a, b): links within each group, in few tasks, of which none has many more than block_bytes of all the sets."""
    return few(groups.applyInArrow(_group_linker(cfg, False), LINKS), 8 * shingles, cfg.block_bytes)


def links_between(docs: DataFrame, classes: DataFrame, id_col: str, text_col: str, cfg: NearConfig) -> DataFrame:
    """(a, b): verified links that connect the classes (id, n, bands) as all links would."""
    entries = classes.select("id", F.explode("bands").alias("h"))
    tops = entries.groupBy("h").agg(F.min("id").alias("top"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    stars = entries.join(tops, "h").select(F.col("id").alias("a"), F.col("top").alias("b")).filter("a <> b")
    clusters = components(stars).select(F.col("v").alias("id"), F.col("label").alias("cid"))
    members = materialize(few(_blocks(clusters.join(classes.select("id", "n"), "id"), cfg), clusters.count()), "near-members")
    shingles = {r["large"]: r["n"] for r in members.groupBy("large").agg(F.sum("n").alias("n")).collect()}  # two rows at most
    rows = _with_sets(docs, members.filter("not large"), id_col, text_col, cfg)
    links = materialize(_linked(rows.groupBy("cid"), shingles.get(False, 0), cfg), "near-links")
    if True not in shingles:
        return links
    large = materialize(_with_sets(docs, members.filter("large"), id_col, text_col, cfg), "near-sets")
    links = materialize(links.unionByName(_linked(large.groupBy("cid", "block"), shingles[True], cfg)), "near-links")
    pivots = None
    while True:  # one member of each component found so far against the others, until a level fits in one block each
        comp = components(links).withColumnRenamed("v", "id")
        state = large.drop("block").join(comp, "id", "left").withColumn("comp", F.coalesce("label", "id")).drop("label")
        heads = materialize(few(_blocks(state.filter("id = comp").select("id", "cid", "n"), cfg), shingles[True], cfg.block_bytes), "near-heads")
        n = heads.count()
        if n == pivots or not heads.groupBy("cid").count().filter("count > 1").limit(1).count():
            break
        pivots = n
        level = state.select("id", "cid", "sig", "set").join(heads.select("id", "block"), "id")
        links = materialize(links.unionByName(_linked(level.groupBy("cid", "block"), shingles[True], cfg)), "near-links")
    sizes = state.groupBy("cid", "comp").agg(F.count(F.lit(1)).alias("count"), F.sum("n").alias("n"))
    total = sizes.groupBy("cid").agg(F.max(F.struct("count", "comp", "n")).alias("m"), F.sum("count").alias("all"), F.sum("n").alias("all_n"), F.count(F.lit(1)).alias("parts")).filter("parts > 1")
    least = _parts(F.col("all") - F.col("m.count"), F.col("all_n") - F.col("m.n"), cfg)
    main = materialize(few(total.select("cid", F.col("m.comp").alias("main"), _parts(F.col("all"), F.col("all_n"), cfg).alias("cells"), least.alias("groups")), shingles[True], cfg.block_bytes), "near-main")
    if not main.limit(1).count():
        return links
    t = state.join(main, "cid")
    cell, group = F.pmod(F.xxhash64("id", F.lit(1)), F.col("cells")), F.pmod(F.xxhash64("id", F.lit(2)), F.col("groups"))
    all_rows = t.withColumn("i", cell).withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1))).withColumn("side", F.lit(False))
    few_rows = t.filter("comp <> main").withColumn("j", group).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cells") - 1))).withColumn("side", F.lit(True))
    cols = ["id", "cid", "i", "j", "side", "comp", "sig", "set"]
    rest = all_rows.select(cols).unionByName(few_rows.select(cols)).groupBy("cid", "i", "j").applyInArrow(_group_linker(cfg, True), LINKS)
    return materialize(links.unionByName(rest), "near-links")


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", cfg: NearConfig = NearConfig()) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: a row per row of docs.

    Texts without words have no shingles and no links. Rows of one id belong together; rows with a null id are linked
    with nothing, and kept with a null component. Other columns are not read. An empty table gives an empty table.
    """
    f = materialize(features(docs, id_col, text_col, cfg), "near-features")
    live = f.filter("n_shingles > 0 and doc_id is not null")
    same = materialize(few(live.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.min_by("bands", "doc_id").alias("bands"), F.max("n_shingles").alias("n")), f.count(), 100_000), "near-classes")
    classes = same.select(F.col("rep").alias("id"), "n", "bands")
    reps = same.select("digest", "rep")
    # rows of one id with different sets: their classes are linked through that id
    twice = live.groupBy("doc_id").agg(F.min("digest").alias("lo"), F.max("digest").alias("hi"), F.count(F.lit(1)).alias("n")).filter("n > 1 and lo <> hi").select("doc_id")
    own = live.join(reps, "digest")
    shared = own.join(broadcast_if_small(materialize(twice, "near-twice"), cfg.max_broadcast_rows), "doc_id").filter("rep <> doc_id").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    labels = components(links_between(docs, classes, id_col, text_col, cfg).unionByName(shared))
    slim = f.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("digest")).alias("digest"))
    out = slim.join(reps, "digest", "left").withColumn("rep", F.when(F.col("doc_id").isNotNull(), F.coalesce("rep", "doc_id")))
    out = out.join(labels.withColumnRenamed("v", "rep"), "rep", "left").withColumn("component_id", F.coalesce("label", "rep"))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", cfg: NearConfig = NearConfig()) -> DataFrame:
    """The rows of docs, whole and unchanged, that are kept: one document of each component. Rows of one kept id stay."""
    gone = near_components(docs, id_col, text_col, cfg).filter("not kept").select(F.col("doc_id").alias("_gone")).distinct()
    gone = materialize(gone, "near-gone")
    return docs.join(broadcast_if_small(gone, cfg.max_broadcast_rows), docs[id_col] == F.col("_gone"), "left_anti")

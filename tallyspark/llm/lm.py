"""Operator 5, LM scoring: a log-bilinear neural model trained by noise-contrastive estimation.

Token counts come from all training texts. The most frequent tokens are classes of their own, all others one class. The
model predicts the next class from the two before: a context vector, the sum of the two token vectors each through a
matrix, times each class's output vector plus its bias. A token of the other class has a vector of its own as context: the
class's plus two rows of a hashed table of 4 sqrt(v) rows at least for v types, chosen by 64 bits of its hash. As output it
has a row of each of two tables of cfg.buckets rows, by the same hash. Within its class, its probability is its add-one
share times the exponential of its tilt (the sum over both tables of context times row, bent by x / (1 + |x|), at most
cfg.bound either way), over the sum of the same over all tokens of the class and one unseen kind, whose tilt is 0.

Each task trains on all tokens of its training texts, starting from shared weights; weights are then averaged by tokens
seen (rows of hashed tables: by times touched), and a next round may follow. Scores use the exact softmax over classes,
as matrix products over the distinct contexts of a block. The sum within the other class is exact too, over all its types:
the exponentials of one table, times the matrix of the types' shares by their rows in both, times those of the other.

Scoring writes, block by block of texts, the tokens outside the classes once, joins them with the counts, and brings the
counts back to their block; texts aren't shuffled.
"""

from __future__ import annotations

import random
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _BASIS, _FNV, materialize, mix64

END = b""  # no word is empty


@dataclass(frozen=True)
class LmConfig:
    classes: int = 255
    dim: int = 16
    noise: int = 24
    batch: int = 4096
    rate: float = 0.04
    rounds: int = 1
    seed: int = 5
    block_bytes: int = 16_000_000
    buckets: int = 64  # a power of 2 up to 256
    sample: int = 256  # of tail_sample
    bound: float = 3.0
    chunk: int = 256


def tokens(text: str | None) -> list[bytes]:
    """Words of the text with A-Z in lower case (bytes.split takes just the six separators), without the end token."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def count_tokens(docs: DataFrame, text_col: str, cfg: LmConfig) -> DataFrame:
    """(token, c) over all rows of docs, the end token included."""

    def run(batches):
        for _, ids, _, words in _blocks_of(batches, [], cfg.block_bytes):
            yield pa.RecordBatch.from_arrays([words, pa.array(np.bincount(ids, minlength=len(words)))], names=["token", "c"])

    return _texts(docs, text_col).mapInArrow(run, "token binary, c long").groupBy("token").agg(F.sum("c").alias("c"))


def _texts(docs: DataFrame, text_col: str) -> DataFrame:
    """The texts as _blocks_of reads them, without ids."""
    return docs.select(F.lit(None).cast("long"), F.lit(None).cast("boolean"), text_col)


@dataclass
class Lbl:
    """Classes by token, with counts; the last class stands for all other tokens. Context class n + 1: before the text."""

    names: list[bytes]
    counts: np.ndarray  # of the classes, then of all others
    n: int  # training tokens
    v: int  # distinct training tokens
    w: dict[str, np.ndarray]
    share: np.ndarray  # (buckets, buckets): of all tokens of the other class, within it, by their rows as output
    unseen: float  # the unseen kind's share
    bound: np.float32  # of tilts

    @property
    def other(self) -> int:
        return len(self.names)

    @staticmethod
    def start(top: list[tuple[bytes, int]], n: int, v: int, weight: np.ndarray, cfg: LmConfig) -> Lbl:
        """weight: of the tokens outside top, the sums of c + 1 by their rows as output."""
        rng = np.random.default_rng(cfg.seed)
        k = len(top)
        counts = np.array([c for _, c in top] + [n - sum(c for _, c in top)], dtype=np.float64)
        share = (counts + 0.5) / (counts.sum() + 0.5 * (k + 1))
        small = lambda *s: rng.normal(0, 0.1, s).astype(np.float32)
        w = {"r": small(k + 2, cfg.dim), "q": small(k + 1, cfg.dim), "b": np.log(share).astype(np.float32)}
        w["m1"], w["m2"] = (np.eye(cfg.dim) * s for s in (1.0, 0.5))
        size = 1 << max(8, int(np.ceil(np.log2(4 * np.sqrt(v + 1)))))
        w["hr"], w["hq"] = np.zeros((size, cfg.dim)), np.zeros((2 * cfg.buckets, cfg.dim))
        rest = counts[-1] + v - k  # what the weights sum to
        return Lbl([t for t, _ in top], counts, n, v, {x: np.ascontiguousarray(y, dtype=np.float32) for x, y in w.items()}, weight / (rest + 1), 1 / (rest + 1), np.float32(cfg.bound))

    def contexts(self, ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids one and two before each position, -1 before the text; first: positions where a text begins."""
        begin = -1
        one, two = np.empty_like(ids), np.empty_like(ids)
        one[1:], two[2:] = ids[:-1], ids[:-2]
        one[first] = two[first] = begin
        second = first + 1
        two[second[second < len(ids)]] = begin
        two[first] = begin
        return one, np.minimum(two, self.other)

    def outputs(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows in both tables of output vectors, which follow one another, from rows of the hashed table of contexts."""
        b = len(self.share)
        return words[..., 0] & (b - 1), (words[..., 1] & (b - 1)) + b

    def classes_of(self, at: np.ndarray) -> np.ndarray:
        """Rows of the table of context vectors by class."""
        k = self.other
        return np.where(at < 0, k + 1, np.minimum(at, k))

    def vectors(self, at: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Context vectors of token ids, those before the text being -1; words: rows of the hashed tables of those outside."""
        k = self.other
        out = self.w["r"].take(self.classes_of(at), axis=0)
        far = np.flatnonzero(at >= k)
        out[far] = self.far_vectors(words.take(at.take(far) - k, axis=0))
        return out

    def far_vectors(self, rows: np.ndarray) -> np.ndarray:
        """Context vectors of tokens outside the classes, from their rows of the hashed table."""
        out = self.w["hr"].take(rows[:, 0], axis=0)
        out += self.w["hr"].take(rows[:, 1], axis=0)
        out += self.w["r"][self.other]
        return out

    def train(self, ids: np.ndarray, first: np.ndarray, words: np.ndarray, cfg: LmConfig, state: dict, touched: dict, rng) -> None:
        """One pass of noise-contrastive estimation, noise shared by a batch (Adagrad): for classes drawn from their
        shares, and within the other class from the tokens of ids themselves, where the share of a token cancels out.
        Gradients of a class's vectors are summed over its positions before they go through a matrix."""
        k = self.other
        one, two = self.contexts(ids, first)
        share = self.counts + 0.5
        share = share / share.sum()
        log_noise = np.log(cfg.noise * share).astype(np.float32)
        w, order = self.w, rng.permutation(-(-len(ids) // cfg.batch))
        draw = np.searchsorted(np.cumsum(share), rng.random((len(order), cfg.noise))).clip(0, len(share) - 1)
        out_a, out_t = _Spots(one >= k, cfg.batch), _Spots(ids >= k, cfg.batch)
        far_a, far_t = words.take(one.take(out_a.at) - k, axis=0), words.take(ids.take(out_t.at) - k, axis=0)
        draw_far = far_t[rng.integers(0, len(far_t), (len(order), max(1, cfg.noise // 2)))] if len(far_t) else None
        far_noise, half = np.float32(np.log(max(1, cfg.noise // 2))), self.bound / 2
        one, two, ids = self.classes_of(one), self.classes_of(two), np.minimum(ids, k)
        near_a, near_b, near_t = (_Spots(x != k, cfg.batch) for x in (one, two, ids))
        for step, at in enumerate(order):
            s = slice(at * cfg.batch, (at + 1) * cfg.batch)
            a, b, t, z = one[s], two[s], ids[s], draw[step]
            out, rows = out_a.of(at), far_a[out_a.slice(at)]
            ra = w["r"].take(a, axis=0)
            ra[out] = self.far_vectors(rows)
            ctx = ra @ w["m1"]
            ctx += (w["r"] @ w["m2"]).take(b, axis=0)
            qt, qz = w["q"].take(t, axis=0), w["q"].take(z, axis=0)
            gt = 1 / (1 + np.exp(log_noise.take(t) - w["b"].take(t) - np.einsum("ij,ij->i", ctx, qt))) - 1
            gz = logistic(ctx @ qz.T, w["b"][z] - log_noise[z])
            scale = np.float32(1 / len(t))
            gt *= scale
            gz *= scale
            qt *= gt[:, None]
            up = qt
            up += gz @ qz
            far = out_t.of(at)
            if len(far):
                (own0, own1), (other0, other1) = self.outputs(far_t[out_t.slice(at)]), self.outputs(draw_far[step])
                c = ctx.take(far, axis=0)
                q0, q1, o0, o1 = (w["hq"].take(x, axis=0) for x in (own0, own1, other0, other1))
                (b0, d0), (b1, d1) = bend(np.einsum("ij,ij->i", c, q0) / half), bend(np.einsum("ij,ij->i", c, q1) / half)
                (n0, e0), (n1, e1) = bend(c @ (o0 / half).T), bend(c @ (o1 / half).T)
                hit = (1 / (1 + np.exp(far_noise - half * (b0 + b1))) - 1) * scale
                d0 *= hit
                d1 *= hit
                n0 += n1
                n0 *= half
                miss = logistic(n0, -far_noise)
                miss *= scale
                e0 *= miss
                e1 *= miss
                q0 *= d0[:, None]
                q1 *= d1[:, None]
                q0 += q1
                q0 += e0 @ o0
                q0 += e1 @ o1
                q0 += up.take(far, axis=0)
                up[far] = q0
                self._rows("hq", np.concatenate([own0, own1, other0, other1]), np.concatenate([d0[:, None] * c, d1[:, None] * c, e0.T @ c, e1.T @ c]), cfg, state, touched)
            up_out = up.take(out, axis=0)
            sum_a = self._sums(near_a.of(at), a, up)
            sum_a[k] += up_out.sum(axis=0)
            sum_b = self._sums(near_b.of(at), b, up)
            sum_b[k] += (b == k).astype(np.float32) @ up
            gr = sum_a @ w["m1"].T + sum_b @ w["m2"].T
            grads = {"m1": ra.T @ up, "m2": w["r"].T @ sum_b}
            ga = up_out @ w["m1"].T
            for name, g in grads.items():
                self._adagrad(name, slice(None), g, cfg, state)
            if len(out):
                self._rows("hr", np.concatenate([rows[:, 0], rows[:, 1]]), np.concatenate([ga, ga]), cfg, state, touched)
            self._adagrad("r", slice(None), gr, cfg, state)
            near = near_t.of(at)
            gq = sums_of_rows(np.concatenate([t.take(near), z]), np.concatenate([gt.take(near)[:, None] * ctx.take(near, axis=0), gz.T @ ctx]), k + 1)
            if len(far):
                gq[k] += gt.take(far) @ c
            self._adagrad("q", slice(None), gq, cfg, state)
            gb = np.bincount(t, weights=gt, minlength=len(share)) + np.bincount(z, weights=gz.sum(axis=0), minlength=len(share))
            self._adagrad("b", slice(None), gb.astype(np.float32), cfg, state)

    def _sums(self, near, classes, g):
        return sums_of_rows(classes.take(near), g.take(near, axis=0), self.other + 2)

    def _rows(self, k, index, g, cfg, state, touched):
        n = len(self.w[k])
        seen = touched.setdefault(k, np.zeros(n, dtype=np.float32))
        if n <= len(index):  # a small table: summed as a whole
            seen[index] += 1
            return self._adagrad(k, slice(None), sums_of_rows(index, g, n), cfg, state)
        order = np.argsort(index.astype(np.uint16) if n <= 1 << 16 else index, kind="stable")  # 16 bits are sorted by radix
        index = index.take(order)
        head = np.concatenate(([True], index[1:] != index[:-1]))
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.cumsum(head) - 1
        index = index[head]
        seen[index] += 1
        self._adagrad(k, index, sums_of_rows(rank, g, len(index)), cfg, state)

    def _adagrad(self, k, at, g, cfg, state):
        if k not in state:
            state[k] = np.full_like(self.w[k], 1e-8)
        s = g * g
        s += state[k][at]
        state[k][at] = s
        np.sqrt(s, out=s)
        np.divide(g, s, out=s)
        s *= np.float32(cfg.rate)
        self.w[k][at] -= s

    def log_probabilities(self, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Natural logarithm of the normalised probability of the class at each position."""
        words = np.zeros((max(0, int(ids.max(initial=0)) - self.other + 1), 2), dtype=np.int64)
        return self.logs(ids, first, words)[0]

    def logs(self, ids: np.ndarray, first: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Natural logarithms at each position: of its class's probability; and for the other class's tokens, else 0,
        the tilt, and of the sum that the class's shares, tilted, are divided by."""
        k, w = self.other, self.w
        one, two = self.contexts(ids, first)
        width = k + 2
        one += 1
        one *= width
        one += two
        one += 1
        del two
        order = in_order(one)
        key = one.take(order)
        del one
        head = np.concatenate(([True], key[1:] != key[:-1]))
        starts = np.flatnonzero(head)
        contexts, back, step = key[starts], np.cumsum(head) - 1, 512  # so many rows of scores stay in cache
        del key, head
        starts = np.append(starts, len(ids))
        out, tilt, total = np.empty(len(ids)), np.zeros(len(ids)), np.zeros(len(ids))
        q = np.ascontiguousarray(np.concatenate([w["q"], w["b"][:, None]], axis=1).T)
        half, b = self.bound / 2, len(self.share)
        tables = np.ascontiguousarray(w["hq"].T / half)
        part, unseen = self.share.astype(np.float32), np.float32(self.unseen)
        second, ones = w["r"] @ w["m2"], np.ones(k + 1, dtype=np.float32)
        for i in range(0, len(contexts), step):
            c = contexts[i : i + step]
            lo, hi = starts[i], starts[i + len(c)]
            ctx = np.ones((len(c), q.shape[0]), dtype=np.float32)
            ctx[:, :-1] = self.vectors(c // width - 1, words) @ w["m1"]
            ctx[:, :-1] += second.take(self.classes_of(c % width - 1), axis=0)
            pick = order[lo:hi]
            row, own = back[lo:hi] - i, ids.take(pick)
            t = np.minimum(own, k)
            s = ctx @ q
            ctx = ctx[:, :-1]
            if s.max(initial=0) > 60:  # beyond it exp could overflow
                s -= s.max(axis=1, keepdims=True)
            mine = s.ravel().take(row * (k + 1) + t)
            np.exp(s, out=s)
            out[pick] = mine - np.log(s @ ones).take(row)
            far = np.flatnonzero(own >= k)
            if len(far):
                row, own, pick = row.take(far), words.take(own.take(far) - k, axis=0), pick.take(far)
                head = np.concatenate(([True], row[1:] != row[:-1]))
                need, of = row[head], np.cumsum(head) - 1
                e = ctx.take(need, axis=0) @ tables
                size = np.abs(e)
                size += 1
                e /= size
                e *= half
                own0, own1 = self.outputs(own)
                flat, of_row = e.ravel(), of * (2 * b)
                tilt[pick] = flat.take(of_row + own0) + flat.take(of_row + own1)
                np.exp(e, out=e)
                total[pick] = np.log(np.einsum("ij,ij->i", e[:, :b] @ part, e[:, b:]) + unseen).take(of)
        return out, tilt, total


class _Spots:
    """Positions where a mask holds, cut by batches."""

    def __init__(self, mask: np.ndarray, batch: int):
        self.at, self.batch = np.flatnonzero(mask), batch
        self.edges = np.searchsorted(self.at, np.arange(0, len(mask) + batch, batch))

    def slice(self, i: int) -> slice:
        return slice(self.edges[i], self.edges[i + 1])

    def of(self, i: int) -> np.ndarray:
        """Those of batch i, from its start."""
        return self.at[self.slice(i)] - i * self.batch


@lru_cache(maxsize=16)
def _cells(n: int, width: int) -> np.ndarray:
    return np.arange(n * width).reshape(n, width)


def sums_of_rows(index: np.ndarray, g: np.ndarray, n: int) -> np.ndarray:
    """(n, width): the sums of the rows of g by index. Cells are numbered in a table as long as a power of 2."""
    width = g.shape[1]
    cells = _cells(1 << max(0, n - 1).bit_length(), width).take(index, axis=0)
    return np.bincount(cells.ravel(), weights=g.ravel(), minlength=n * width).reshape(n, width).astype(np.float32)


def in_order(key: np.ndarray) -> np.ndarray:
    """A stable argsort of whole numbers from 0; where key and position fit into 63 bits they are sorted as one number."""
    bits = len(key).bit_length()
    if int(key.max(initial=0)).bit_length() + bits > 63:
        return np.argsort(key, kind="stable")
    both = (key << bits) | np.arange(len(key))
    both.sort()
    both &= (1 << bits) - 1
    return both


def logistic(x: np.ndarray, shift) -> np.ndarray:
    """1 / (1 + exp(-(x + shift))), in the place of x."""
    x += shift
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def bend(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """x / (1 + |x|), between -1 and 1, and its derivative; x is overwritten."""
    part = np.abs(x)
    part += 1
    np.reciprocal(part, out=part)
    x *= part
    part *= part
    return x, part


def hashed_rows(words: pa.Array | list[bytes], size: int) -> np.ndarray:
    """(words, 2): the rows of a hashed table of `size`, a power of 2, that make up each word's vector, by its hash (that of
    common.word_hashes; 0 for the end token)."""
    words = words if isinstance(words, pa.Array) else pa.array(words, pa.binary())
    h = np.zeros(len(words), dtype=np.uint64)
    if len(words):
        at = np.frombuffer(words.buffers()[1], np.int64 if pa.types.is_large_binary(words.type) else np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
        order = in_order(np.diff(at))
        start, length = at[order], np.diff(at)[order]
        buf = np.frombuffer(words.buffers()[2] or b"", np.uint8)
        live, j, x = np.searchsorted(length, 0, "right"), 0, np.full(len(words), _BASIS, dtype=np.uint64)
        begun = live
        while live < len(x):
            x[live:] ^= buf[start[live:] + j]
            x[live:] *= _FNV
            j += 1
            live += np.searchsorted(length[live:], j, "right")
        h[order[begun:]] = mix64(x[begun:])
    return np.stack([h & np.uint64(size - 1), (h >> np.uint64(32)) & np.uint64(size - 1)], axis=1).astype(np.int64)


HASHED = ("hr", "hq")


def train_round(model: Lbl, docs: DataFrame, text_col: str, cfg: LmConfig, number: int) -> None:
    """All tokens of docs; weights are averaged by tokens seen. What comes to the driver has the size of the model."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    size = len(model.w["hr"])
    small = sorted(k for k in model.w if k not in HASHED)

    def run(batches):
        m = shared.value
        local = Lbl(m.names, m.counts, m.n, m.v, {k: v.copy() for k, v in m.w.items()}, m.share, m.unseen, m.bound)
        state, touched, seen = {}, {}, 0
        rng = np.random.default_rng([cfg.seed, number])
        for _, ids, first, words in _blocks_of(batches, m.names, cfg.block_bytes // 4):
            local.train(ids, first, hashed_rows(words, size), cfg, state, touched, rng)
            seen += len(ids)
        if seen:
            flat = np.concatenate([local.w[k].ravel() for k in small]).astype(np.float32)
            parts = [("", 0, flat * np.float32(seen), np.array([seen], dtype=np.float32))]
            for k, n in touched.items():
                for i in range(0, size, cfg.chunk):
                    if n[i : i + cfg.chunk].any():
                        parts.append((k, i, local.w[k][i : i + cfg.chunk] * n[i : i + cfg.chunk, None], n[i : i + cfg.chunk]))
            for k, i, x, n in parts:
                yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([i], pa.int64()), pa.array([x.tobytes()], pa.binary()), pa.array([n.tobytes()], pa.binary())], names=["k", "i", "x", "n"])

    def merge(key: tuple, t: pa.Table) -> pa.Table:
        """Of one range of rows: the sums over tasks, divided; rows that no task touched stay as they were."""
        x = n = 0
        for u, v in zip(t.column("x"), t.column("n"), strict=True):
            x, n = x + np.frombuffer(u.as_py(), np.float32).astype(np.float64), n + np.frombuffer(v.as_py(), np.float32).astype(np.float64)
        x = x.reshape(len(n), -1) / np.maximum(n, 1)[:, None]
        return pa.table({"k": pa.array([key[0].as_py()]), "i": pa.array([key[1].as_py()], pa.int64()), "x": pa.array([x.astype(np.float32).tobytes()], pa.binary()), "n": pa.array([(n > 0).tobytes()], pa.binary())})

    ddl = "k string, i long, x binary, n binary"
    rows = _texts(docs, text_col).mapInArrow(run, ddl).groupBy("k", "i").applyInArrow(merge, ddl)
    for r in rows.toArrow().to_pylist():
        x, live = np.frombuffer(r["x"], np.float32), np.frombuffer(r["n"], bool)
        if r["k"]:
            at = model.w[r["k"]][r["i"] : r["i"] + len(live)]
            at[live] = x.reshape(len(live), -1)[live]
            continue
        at = 0
        for k in small:
            model.w[k] = x[at : at + model.w[k].size].reshape(model.w[k].shape).copy()
            at += model.w[k].size


def fit(docs: DataFrame, text_col: str = "text", cfg: LmConfig = LmConfig()) -> tuple[Lbl, DataFrame]:
    """The model and the table (token, c) of its training texts."""
    counts = materialize(count_tokens(docs, text_col, cfg), "lm-counts")
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    top = counts.orderBy(F.desc("c"), "token").limit(cfg.classes).collect()
    model = Lbl.start([(bytes(r["token"]), r["c"]) for r in top], total["n"], total["v"], tail_weights(counts, top, cfg), cfg)
    for k in range(cfg.rounds):
        train_round(model, docs, text_col, cfg, k)
    return model, counts


def tail_weights(counts: DataFrame, top: list, cfg: LmConfig) -> np.ndarray:
    """Of all tokens outside top, the sums of c + 1 by their rows in both tables of output vectors."""
    names, b = [bytes(r["token"]) for r in top], cfg.buckets

    def run(batches):
        total, named = np.zeros(b * b), pa.array(names, pa.binary())
        for x in batches:
            rows = hashed_rows(x.column(0), b)
            weight = np.where(pc.is_in(x.column(0), named).to_numpy(zero_copy_only=False), 0.0, x.column(1).to_numpy() + 1.0)
            total += np.bincount(rows[:, 0] * b + rows[:, 1], weights=weight, minlength=b * b)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["at", "weight"])

    out = np.zeros(b * b)
    for r in counts.mapInArrow(run, "at long, weight double").groupBy("at").agg(F.sum("weight").alias("weight")).collect():
        out[r["at"]] = r["weight"]
    return out.reshape(b, b)


def tail_sample(counts: DataFrame, top: list, cfg: LmConfig) -> list[tuple[bytes, float]]:
    """For looking at a tail; no model or score uses it. (token, weight) of cfg.sample tokens outside top: those whose exponential arrival at rate c + 1 is first. A weight
    is c + 1 over the chance to arrive before the first one left out, so sums are unbiased; all tokens if they are few."""
    arrival = -F.log((F.pmod(F.xxhash64("token", F.lit(cfg.seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)) / (F.col("c") + 1)
    first = counts.select("token", "c", arrival.alias("a")).orderBy("a", "token").limit(cfg.sample + len(top) + 1).collect()
    named = {bytes(r["token"]) for r in top}
    rest = [(bytes(r["token"]), r["c"] + 1.0, r["a"]) for r in first if bytes(r["token"]) not in named]
    if len(rest) <= cfg.sample:
        return [(t, c) for t, c, _ in rest]
    edge = rest[cfg.sample][2]
    return [(t, float(c / -np.expm1(-c * edge))) for t, c, _ in rest[: cfg.sample]]


BLOCKS = pa.schema([("block", pa.int64()), ("id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_class", pa.int64()), ("class_log", pa.float64()), ("lm_log", pa.float64()), ("ids", pa.list_(pa.int32())), ("tilt_sum", pa.float64()), ("tilts", pa.list_(pa.float32())), ("words", pa.list_(pa.binary()))])
BLOCKS_DDL = "block long, id long, held_out boolean, n_tokens long, n_class long, class_log double, lm_log double, ids array<int>, tilt_sum double, tilts array<float>, words array<binary>"


def score(docs: DataFrame, model: Lbl, counts: DataFrame, held_out, id_col: str = "doc_id", text_col: str = "text", cfg: LmConfig = LmConfig()) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: a row per row of docs.

    Null and empty texts are the end token alone. With nothing to learn from, all tokens are unseen. Logarithms are to
    base 10. held_out must be true for rows that the model didn't learn from: only there can a token be unseen, which has
    no tilt. Texts of any length are scored whole. Rows are never joined by id, so repeated and null ids are scored each by itself. Other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        k = m.other
        log_c = np.log10(m.counts[:-1] + 1)

        for rows, ids, first, words in _blocks_of(batches, m.names, cfg.block_bytes):
            classes = np.minimum(ids, k)
            lp, tilt, total = m.logs(ids, first, hashed_rows(words, len(m.w["hr"])))
            lp -= total
            stop = np.append(first[1:], len(ids))
            outside = ids >= k
            n_out = np.add.reduceat(outside.astype(np.int64), first)
            logs = np.add.reduceat(np.where(outside, 0.0, np.append(log_c, 0.0)[classes]), first)
            off = np.concatenate(([0], np.cumsum(n_out)))
            lists = pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array((ids[outside] - k).astype(np.int32)))
            new = pc.fill_null(rows.column(1), False).to_numpy().astype(bool)
            tilt_sum = pa.array(np.add.reduceat(tilt, first), mask=new)
            new_off = np.concatenate(([0], np.cumsum(np.where(new, n_out, 0))))
            tilts = pa.ListArray.from_arrays(pa.array(new_off, pa.int32()), pa.array(tilt[outside & np.repeat(new, stop - first)].astype(np.float32)))
            block, none = random.getrandbits(62), pa.nulls(rows.num_rows, pa.list_(pa.binary()))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(rows.num_rows, block)), *(c.combine_chunks() for c in rows.columns), pa.array(stop - first, pa.int64()), pa.array(stop - first - n_out, pa.int64()), pa.array(logs), pa.array(np.add.reduceat(lp, first) / np.log(10)), lists, tilt_sum, tilts, none], schema=BLOCKS)
            if len(words):
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), *[pa.nulls(1, f.type) for f in list(BLOCKS)[1:-1]], pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words)], schema=BLOCKS)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), held_out.alias("h"), F.col(text_col).alias("t")).mapInArrow(run, BLOCKS_DDL)
    rows = materialize(rows, "lm-blocks")
    texts = rows.filter("n_tokens is not null").drop("words")
    words = rows.filter("words is not null").select(F.col("block").alias("of"), F.posexplode("words").alias("k", "token"))
    found = words.join(counts, "token").select("of", "k", "c")
    n, v = model.n, model.v
    rest_n, rest_v = float(model.counts[-1]), v - model.other
    base_z, rest_z = float(np.log10(n + v + 1)), float(np.log10(rest_n + rest_v + 1))

    def finish(_, t: pa.Table, c: pa.Table) -> pa.Table:
        ids = t.column("ids").combine_chunks()
        flat = ids.flatten().to_numpy(zero_copy_only=False)
        table = np.zeros(int(flat.max(initial=-1)) + 1)
        at = c.column("k").to_numpy()
        live = at < len(table)
        table[at[live]] = c.column("c").to_numpy()[live]
        off = ids.offsets.to_numpy() - ids.offsets[0].as_py()
        got = table[flat]
        sums = t.column("tilt_sum").combine_chunks()
        new = np.repeat(sums.is_null().to_numpy(zero_copy_only=False), np.diff(off))
        tilt = np.zeros(len(flat))
        tilt[new] = t.column("tilts").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        tilt = np.concatenate(([0], np.cumsum(np.where(got > 0, tilt, 0.0))))
        tilt = (pc.fill_null(sums, 0.0).to_numpy() + tilt[off[1:]] - tilt[off[:-1]]) / np.log(10)
        logs = np.concatenate(([0], np.cumsum(np.log10(got + 1))))
        known = np.concatenate(([0], np.cumsum(got > 0)))
        out_log, out_known = logs[off[1:]] - logs[off[:-1]], known[off[1:]] - known[off[:-1]]
        n_tokens, n_out = t.column("n_tokens").to_numpy(), np.diff(off)
        base = t.column("class_log").to_numpy() + out_log - n_tokens * base_z
        lm = t.column("lm_log").to_numpy() + tilt + out_log - n_out * rest_z
        cols = {"doc_id": t.column("id"), "held_out": t.column("held_out"), "n_tokens": t.column("n_tokens"), "n_known": pa.array(t.column("n_class").to_numpy() + out_known, pa.int64()), "train_tokens": pa.array(np.full(len(n_out), n, dtype=np.int64)), "base_score": pa.array(base), "score": pa.array(lm)}
        return pa.table(cols)

    ddl = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return texts.groupBy("block").cogroup(found.groupBy("of")).applyInArrow(finish, ddl)


def _blocks_of(batches, names, limit):
    """(rows, ids, starts, words) of texts with limit characters, or a text more, from (id, held_out, text): the first two
    columns, token ids, where each text begins, and the words outside names, which have the ids from len(names) on."""
    held, size = [], 0
    for b in batches:
        chars, lo = np.cumsum(pc.fill_null(pc.utf8_length(b.column(2)), 0).to_numpy(), dtype=np.int64), 0
        while lo < b.num_rows:
            before = chars[lo - 1] if lo else 0
            hi = int(np.searchsorted(chars, limit - size + before)) + 1
            held.append(b.slice(lo, hi - lo))
            if hi > b.num_rows:
                size += chars[-1] - before
                break
            out, held, size, lo = held, [], 0, hi
            yield _block(out, names)
    if held:
        yield _block(held, names)


def _block(batches: list[pa.RecordBatch], names: list[bytes]):
    rows = pa.Table.from_batches(batches)
    # the six separators are ASCII's white space; a text that begins or ends with one has an empty part there
    parts = [pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(c, ""))) for c in rows.column(2).chunks]
    codes = pa.chunked_array([x.flatten().cast(pa.binary()) for x in parts]).dictionary_encode()
    types = codes.chunk(codes.num_chunks - 1).dictionary
    codes = np.concatenate([c.indices.to_numpy() for c in codes.chunks])
    offsets = np.cumsum(np.concatenate([[0], *(np.diff(x.offsets.to_numpy()) for x in parts)]))
    del parts
    k, named = len(names), pa.array(names, pa.binary())
    empty = pc.equal(types, END).to_numpy(zero_copy_only=False)
    ids = pc.fill_null(pc.index_in(types, named), -1).to_numpy().astype(np.int64)
    far = (ids < 0) & ~empty
    ids[far] = k + np.arange(far.sum())
    words = types.filter(pa.array(far))
    end = names.index(END) if END in names else k + len(words)
    if end >= k:
        words = pa.concat_arrays([words, pa.array([END], pa.binary())])
    full = ~empty[codes]
    n = np.diff(np.concatenate(([0], np.cumsum(full)))[offsets]) + 1
    stop = np.cumsum(n)
    out, inside = np.full(stop[-1], end, dtype=np.int64), np.ones(stop[-1], dtype=bool)
    inside[stop - 1] = False
    out[inside] = ids[codes[full]]
    return rows.select([0, 1]), out, stop - n, words

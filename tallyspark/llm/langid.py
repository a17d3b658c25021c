"""Operator 9, language identification: a bidirectional gated recurrent network over bytes.

Trained in numpy by backpropagation through time on a bounded sample (per_lang whole texts of each language); every position
of every whole text gets class probabilities, and a text's probabilities are their mean. Texts run as rows of bytes, many
rows side by side. In prediction a row also runs over the `halo` bytes on both sides of its own, so that both directions
come to its first byte with the state that the halo bytes before it have left; at a text's ends the state is zero, so that
texts of up to `row` bytes get exactly one pass from end to end.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, materialize, small
from .common import slices as ranges

UNDEFINED = "und"


@dataclass(frozen=True)
class LangConfig:
    """per_lang: the bound on the labelled texts to learn from, by language; steps, row: bytes of a row in training and
    in prediction."""

    per_lang: int = 100
    steps: int = 64
    row: int = 512
    halo: int = 64
    hidden: int = 8
    batch: int = 256
    epochs: int = 3
    rate: float = 0.02
    seed: int = 7
    slice_bytes: int = 400_000
    max_broadcast_langs: int = 100_000


def _sigmoid(x):
    return 0.5 + 0.5 * np.tanh(0.5 * x)


class BiGru:
    """Weights: per direction x (256, 3h), h (h, 3h); output o (2h, classes), b (classes)."""

    def __init__(self, langs: list[str], hidden: int, seed: int):
        rng = np.random.default_rng(seed)
        self.langs, self.h = langs, hidden
        self.w = {}
        for d in "fb":
            self.w[d + "x"] = rng.normal(0, 0.4, (256, 3 * hidden)).astype(np.float32)
            self.w[d + "h"] = rng.normal(0, 1 / np.sqrt(hidden), (hidden, 3 * hidden)).astype(np.float32)
        self.w["o"] = rng.normal(0, 0.3, (2 * hidden, len(langs))).astype(np.float32)
        self.w["b"] = np.zeros(len(langs), dtype=np.float32)

    def states(self, x: np.ndarray, d: str, inside: np.ndarray, keep: list | None = None) -> np.ndarray:
        """Hidden states (steps, rows, h) of one direction, zero where inside is 0; keep gets what backpropagation needs."""
        n, h = self.h, np.zeros((x.shape[1], self.h), dtype=np.float32)
        out = np.empty((*x.shape, n), dtype=np.float32)
        wx, wh = self.w[d + "x"], self.w[d + "h"]
        for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
            gx, gh = wx[x[t]], h @ wh
            zr = _sigmoid(gx[:, : 2 * n] + gh[:, : 2 * n])
            z, r = zr[:, :n], zr[:, n:]
            c = np.tanh(gx[:, 2 * n :] + r * gh[:, 2 * n :])
            new = c + z * (h - c)
            if keep is not None:
                keep.append((t, h, z, r, c, gh[:, 2 * n :].copy()))
            h = new * inside[t][:, None]
            out[t] = h
        return out

    def probabilities(self, x: np.ndarray, inside: np.ndarray, body: slice = slice(None)) -> np.ndarray:
        """(steps, rows, classes): the label distribution of every position in body."""
        logits = self.states(x, "f", inside)[body] @ self.w["o"][: self.h] + self.states(x, "b", inside)[body] @ self.w["o"][self.h :] + self.w["b"]
        logits -= logits.max(axis=-1, keepdims=True)
        np.exp(logits, out=logits)
        return logits / logits.sum(axis=-1, keepdims=True)

    def gradients(self, x: np.ndarray, y: np.ndarray, live: np.ndarray) -> tuple[float, dict]:
        """Mean cross-entropy over the live positions, each with its row's class, and its gradients."""
        kept = {"f": [], "b": []}
        hs = {d: self.states(x, d, live, kept[d]) for d in "fb"}
        both = np.concatenate([hs["f"], hs["b"]], axis=-1)
        logits = both @ self.w["o"] + self.w["b"]
        logits -= logits.max(axis=-1, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(axis=-1, keepdims=True)
        total = max(1.0, float(live.sum()))
        rows = np.arange(x.shape[1])
        loss = -float((np.log(p[:, rows, y] + 1e-12) * live).sum()) / total
        p[:, rows, y] -= 1
        p *= (live / total)[:, :, None]
        g = {"o": np.einsum("tbi,tbj->ij", both, p, optimize=True), "b": p.sum(axis=(0, 1))}
        for d, w in (("f", self.w["o"][: self.h]), ("b", self.w["o"][self.h :])):
            up = p @ w.T
            g |= self._back(x, d, up, live, kept[d])
        return loss, g

    def _back(self, x, d, up, inside, kept):
        n, wh = self.h, self.w[d + "h"]
        gx, gh = np.zeros_like(self.w[d + "x"]), np.zeros_like(wh)
        carry = np.zeros((x.shape[1], n), dtype=np.float32)
        for t, h, z, r, c, hc in reversed(kept):
            dh = (up[t] + carry) * inside[t][:, None]
            dc = dh * (1 - z) * (1 - c * c)
            dz = dh * (h - c) * z * (1 - z)
            dr = dc * hc * r * (1 - r)
            dg = np.concatenate([dz, dr, dc], axis=1)
            np.add.at(gx, x[t], dg)
            dgh = np.concatenate([dz, dr, dc * r], axis=1)
            gh += h.T @ dgh
            carry = dh * z + dgh @ wh.T
        return {d + "x": gx, d + "h": gh}

    def fit(self, x: np.ndarray, y: np.ndarray, live: np.ndarray, cfg: LangConfig) -> BiGru:
        """Adam over shuffled batches; x and live are (steps, rows)."""
        rng = np.random.default_rng(cfg.seed)
        m = {k: np.zeros_like(v) for k, v in self.w.items()}
        s = {k: np.zeros_like(v) for k, v in self.w.items()}
        step, total = 0, cfg.epochs * -(-x.shape[1] // cfg.batch)
        for _ in range(cfg.epochs):
            order = rng.permutation(x.shape[1])
            for i in range(0, len(order), cfg.batch):
                pick = order[i : i + cfg.batch]
                _, g = self.gradients(x[:, pick], y[pick], live[:, pick])
                norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
                clip, step = min(1.0, 1.0 / (norm + 1e-9)), step + 1
                rate = cfg.rate * (1 - 0.9 * step / total)
                for k, v in g.items():
                    v = v * clip
                    m[k] = 0.9 * m[k] + 0.1 * v
                    s[k] = 0.999 * s[k] + 0.001 * v * v
                    self.w[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return self


class Rows:
    """Rows of `steps` bytes of each blob with halo bytes on both sides; n: the number of rows of each blob."""

    def __init__(self, blobs: list[bytes], steps: int, halo: int = 0):
        self.steps, self.halo = steps, halo
        self.sizes = np.array([len(b) for b in blobs], dtype=np.int64)
        self.n = -(-self.sizes // steps)
        self.bytes = np.frombuffer(b"".join(blobs) + b" ", dtype=np.uint8)
        self.ends = np.cumsum(self.n)

    def part(self, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        """Of rows lo to hi the bytes (steps + 2 halo, rows), padded, and which of them lie inside the text."""
        row = np.arange(lo, min(hi, int(self.n.sum())))
        blob = np.searchsorted(self.ends, row, side="right")
        at = (row - (self.ends - self.n)[blob]) * self.steps + np.arange(-self.halo, self.steps + self.halo)[:, None]
        inside = (at >= 0) & (at < self.sizes[blob])
        x = np.where(inside, self.bytes[np.where(inside, at + (np.cumsum(self.sizes) - self.sizes)[blob], 0)], np.uint8(32))
        return x, inside.astype(np.float32)


def training_sample(docs: DataFrame, cfg: LangConfig, text_col: str, lang_col: str) -> list:
    """(language, text): of each language the per_lang distinct texts whose hashes are lowest. Hashes under a bound that
    the number of distinct texts gives go on to be ordered, a few hundred a language, however hot it is."""
    known = docs.filter(F.col(lang_col).isNotNull() & (F.length(text_col) > 0)).select(F.col(lang_col).alias("lang"), F.xxhash64(text_col).alias("rank"), F.col(text_col).alias("t"))
    edges = known.groupBy("lang").agg(F.approx_count_distinct("rank", 0.02).alias("n"))
    share = F.least(F.lit(1.0), F.lit(1.5 * cfg.per_lang + 50) / F.col("n"))
    edges = materialize(edges.select("lang", ((share - 0.5) * 2.0**64).alias("edge")), "lang-edges")
    low = known.join(broadcast_if_small(edges, cfg.max_broadcast_langs), "lang").filter(F.col("rank") <= F.col("edge"))
    order = Window.partitionBy("lang").orderBy("rank")
    picked = low.groupBy("lang", "rank").agg(F.min("t").alias("t")).withColumn("k", F.row_number().over(order)).filter(F.col("k") <= cfg.per_lang)
    return picked.orderBy("lang", "k").select("lang", "t").collect()


def train(docs: DataFrame, cfg: LangConfig = LangConfig(), text_col: str = "text", lang_col: str = "lang") -> BiGru | None:
    """The network, or None if no row has a text and a language (an empty table included). Repeated texts of a language
    count once; rows with a null or empty text or a null language teach nothing. Other columns are not read."""
    rows = training_sample(docs, cfg, text_col, lang_col)
    langs = sorted({r["lang"] for r in rows})
    if not langs:
        return None
    cut = Rows([r["t"].encode("utf-8", "surrogatepass") for r in rows], cfg.steps)
    y = np.repeat([langs.index(r["lang"]) for r in rows], cut.n)
    x, live = cut.part(0, len(y))
    return BiGru(langs, cfg.hidden, cfg.seed).fit(x, y, live, cfg)


def predict_texts(net: BiGru | None, texts: list[str | None], cfg: LangConfig) -> tuple[list[str], np.ndarray]:
    langs, scores = [UNDEFINED] * len(texts), np.zeros(len(texts))
    index = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))] if net else []
    blobs = [texts[i].encode("utf-8", "surrogatepass") for i in index]
    for i, j in ranges([len(b) for b in blobs], cfg.slice_bytes):
        cut, body = Rows(blobs[i:j], cfg.row, cfg.halo), slice(cfg.halo, cfg.halo + cfg.row)
        sums = np.empty((int(cut.n.sum()), len(net.langs)))
        for a in range(0, len(sums), 1024):  # bounds the memory of one very long text
            x, inside = cut.part(a, a + 1024)
            sums[a : a + 1024] = np.einsum("tbc,tb->bc", net.probabilities(x, inside, body), inside[body])
        starts = np.concatenate(([0], np.cumsum(cut.n)[:-1]))
        pooled = np.add.reduceat(sums, starts, axis=0)
        pooled /= pooled.sum(axis=1, keepdims=True)
        best = pooled.argmax(axis=1)
        for k, (b, p) in enumerate(zip(best, pooled, strict=True)):
            langs[index[i + k]] = net.langs[b]
            scores[index[i + k]] = min(1.0, float(p[b]))
    return langs, scores


def label_positions(net: BiGru, text: str, cfg: LangConfig = LangConfig()) -> list[str]:
    """The label of every byte of a text."""
    cut = Rows([text.encode("utf-8", "surrogatepass")], cfg.row, cfg.halo)
    x, inside = cut.part(0, int(cut.n.sum()))
    body = slice(cfg.halo, cfg.halo + cfg.row)
    best = net.probabilities(x, inside, body).argmax(axis=-1).T.ravel()
    return [net.langs[k] for k in best[inside[body].T.ravel() > 0]]


def predict(docs: DataFrame, net: BiGru | None, cfg: LangConfig = LangConfig(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, lang_pred, score), a row per row of docs. Null texts and those without a letter: `und`, 0.0.
    Only the text is read for a prediction; with no trained network every row is `und`. Texts of any length are labelled
    whole; equal texts get equal results, in repeated rows too; of languages that tie the first by name is taken. Null ids
    stay null. An empty table gives an empty table; columns beyond the two named are not read."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches):
        for b in small(batches, 1):
            langs, scores = predict_texts(shared.value, b.column(1).to_pylist(), cfg)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[id_col, "lang_pred", "score"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, lang_pred string, score double")


def held_out(id_col: str, mod: int, rest: int):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % mod == rest, F.lit(False))

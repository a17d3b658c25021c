"""Operator 2, substring dedup: compressed FM-indexes over shards that hold all texts which could match each other.

Each window of `window` words picks an anchor: the leftmost run of `gram` words with the smallest hash in it. Equal windows
pick equal anchors, so windows are dealt to shards by anchor; consecutive windows with one anchor travel as one segment.
Segments whose anchor stands once in the corpus cannot match and stay home. A shard's distinct segments, with their
numbers of occurrences, form an FM-index (a wavelet matrix of packed bits over the Burrows-Wheeler transform, suffixes
sorted to the window's depth); each segment streams through it by backward search, and intervals of windows that occur
twice or more are reported.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import gram_hashes, materialize, mix64, shuffle_parts, slices, word_hashes


@dataclass(frozen=True)
class SubstringConfig:
    """window: words of a window; gram: words of an anchor; shard_words: words of whole anchors that make an index."""

    window: int = 35
    gram: int = 8
    shard_words: int = 600_000
    slice_bytes: int = 1_000_000


# ---- anchors and segments


def window_anchors(h: np.ndarray, counts: np.ndarray, cfg: SubstringConfig):
    """Of all runs of windows with one anchor: the anchor's hash, the first window's word position, number of windows, text."""
    grams, per = gram_hashes(h, cfg.gram), cfg.window - cfg.gram + 1
    n = len(h) - cfg.window + 1
    empty = np.empty(0, dtype=np.int64)
    if n <= 0:
        return empty.astype(np.uint64), empty, empty, empty
    val, pos, have = grams, np.arange(len(grams)), 1

    def join(shift, m):
        a, b = val[:m], val[shift : shift + m]
        right = b < a
        return np.where(right, b, a), np.where(right, pos[shift : shift + m], pos[:m])

    while have * 2 <= per:
        val, pos = join(have, len(val) - have)
        have *= 2
    if have < per:
        val, pos = join(per - have, len(val) - (per - have))
    text = np.repeat(np.arange(len(counts)), counts)
    inside = np.flatnonzero(text[:n] == text[cfg.window - 1 : cfg.window - 1 + n])
    val, pos, at = val[inside], pos[inside], inside
    if not len(at):
        return empty.astype(np.uint64), empty, empty, empty
    head = np.flatnonzero(np.concatenate(([True], (pos[1:] != pos[:-1]) | (at[1:] != at[:-1] + 1) | (text[at[1:]] != text[at[:-1]]))))
    return val[head], at[head], np.diff(np.append(head, len(at))), text[at[head]]


def _segment_hash(h: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    g = size.astype(np.uint64)
    for j in range(int(size.max(initial=0))):
        live = size > j
        x = (g + h[np.where(live, start + j, 0)]) * np.uint64(0x9E3779B97F4A7C15)
        g = np.where(live, x ^ (x >> np.uint64(29)), g)
    return mix64(g)


def _blobs(column) -> list[bytes]:
    return [(t or "").encode("utf-8", "surrogatepass") for t in column.to_pylist()]


def anchor_counts(docs: DataFrame, text_col: str, cfg: SubstringConfig) -> DataFrame:
    """(anchor, n): pre-aggregated by slice."""

    def run(batches):
        for b in batches:
            blobs = _blobs(b.column(0))
            for i, j in slices([len(x) for x in blobs], cfg.slice_bytes):
                h, counts = word_hashes(blobs[i:j])
                u, n = np.unique(window_anchors(h, counts, cfg)[0], return_counts=True)
                if len(u):
                    yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(n.astype(np.int64))], names=["anchor", "n"])

    return docs.select(text_col).mapInArrow(run, "anchor long, n long")


def _places(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("t"))


SEGMENTS = pa.schema([("anchor", pa.int64()), ("seg", pa.int64()), ("words", pa.binary()), ("ids", pa.list_(pa.int64())), ("ths", pa.list_(pa.int64())), ("starts", pa.list_(pa.int32()))])
SEGMENTS_DDL = "anchor long, seg long, words binary, ids array<long>, ths array<long>, starts array<int>"


def segments(docs: DataFrame, id_col: str, text_col: str, cfg: SubstringConfig, shared: DataFrame) -> DataFrame:
    """A row per distinct segment of a slice whose anchor is in shared, with all its places (id, text hash, first word).

    Each document's shared anchors come to its text by joins, so no corpus-wide set is ever in one place."""
    places = _places(docs, id_col, text_col)
    per_doc = _anchors_by_doc(places, cfg).join(shared, "anchor").groupBy("id", "th").agg(F.collect_set("anchor").alias("a"))
    per_doc = per_doc.select(F.col("id").alias("_i"), F.col("th").alias("_t"), "a")
    places = places.join(per_doc, places.id.eqNullSafe(F.col("_i")) & (places.th == F.col("_t"))).select("id", "th", "t", "a")

    def run(batches):
        for b in batches:
            blobs, ids, ths = _blobs(b.column(2)), b.column(0).to_pylist(), b.column(1).to_pylist()
            for i, j in slices([len(x) for x in blobs], cfg.slice_bytes):
                h, counts = word_hashes(blobs[i:j])
                anchor, start, n, text = window_anchors(h, counts, cfg)
                own = np.unique(b.column(3).slice(i, j - i).flatten().to_numpy().view(np.uint64))
                keep = _among(anchor, own)
                if keep.any():
                    yield _segment_batch(h, counts, anchor[keep], start[keep], n[keep], text[keep], ids[i:j], ths[i:j], cfg)

    return places.mapInArrow(run, SEGMENTS_DDL)


def _among(x: np.ndarray, sorted_: np.ndarray) -> np.ndarray:
    if not len(sorted_) or not len(x):
        return np.zeros(len(x), dtype=bool)
    at = np.minimum(np.searchsorted(sorted_, x), len(sorted_) - 1)
    return sorted_[at] == x


def _anchors_by_doc(places: DataFrame, cfg: SubstringConfig) -> DataFrame:
    def run(batches):
        for b in batches:
            blobs = _blobs(b.column(2))
            for i, j in slices([len(x) for x in blobs], cfg.slice_bytes):
                h, counts = word_hashes(blobs[i:j])
                anchor, _, _, text = window_anchors(h, counts, cfg)
                at = pa.array(text + i, pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(anchor.view(np.int64))], names=["id", "th", "anchor"])

    return places.mapInArrow(run, "id long, th long, anchor long")


def _segment_batch(h, counts, anchor, start, n, text, ids, ths, cfg) -> pa.RecordBatch:
    size = n + cfg.window - 1
    first_word = np.concatenate(([0], np.cumsum(counts)))[text]
    seg = _segment_hash(h, start, size)
    order = np.argsort(seg, kind="stable")
    head = np.flatnonzero(np.concatenate(([True], seg[order][1:] != seg[order][:-1])))
    pick = order[head]
    raw = h.astype("<u8").tobytes()
    words = [raw[8 * s : 8 * (s + k)] for s, k in zip(start[pick].tolist(), size[pick].tolist(), strict=True)]
    off = pa.array(np.append(head, len(order)), pa.int32())
    doc = text[order].tolist()
    lists = [pa.ListArray.from_arrays(off, pa.array(v, t)) for v, t in (([ids[d] for d in doc], pa.int64()), ([ths[d] for d in doc], pa.int64()), ((start - first_word)[order], pa.int32()))]
    return pa.RecordBatch.from_arrays([pa.array(anchor[pick].view(np.int64)), pa.array(seg[pick].view(np.int64)), pa.array(words, pa.binary()), *lists], schema=SEGMENTS)


# ---- the index


class FmIndex:
    """Over symbols 1.. with 0 between texts; weight: how often the text of each symbol occurs. Patterns up to depth."""

    def __init__(self, text: np.ndarray, weight: np.ndarray, depth: int):
        n = len(text)
        sigma = int(text.max(initial=0)) + 1
        order = self._suffixes(text, depth)
        self.before = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=sigma))))
        self.weights = np.concatenate(([0], np.cumsum(weight[order])))
        seq = text[order - 1]
        self.shifts = list(range(max(1, (sigma - 1).bit_length()) - 1, -1, -1))
        self.bits, self.ones, self.zeros = [], [], []
        base = np.zeros(sigma, dtype=np.int64)
        symbols = np.arange(sigma)
        for s in self.shifts:
            bit = ((seq >> s) & 1).astype(np.uint8)
            packed = np.packbits(bit, bitorder="little")
            words = np.frombuffer(packed.tobytes() + b"\0" * (-len(packed) % 8 + 8), dtype="<u8")
            self.bits.append(words)
            self.ones.append(np.concatenate(([0], np.cumsum(np.bitwise_count(words), dtype=np.int64)))[:-1].astype(np.int32))
            zero = n - int(bit.sum())
            self.zeros.append(zero)
            r = self._rank(len(self.bits) - 1, base)
            base = np.where((symbols >> s) & 1, zero + r, base - r)
            seq = np.concatenate([seq[bit == 0], seq[bit == 1]])
        self.base, self.n = base, n

    @staticmethod
    def _suffixes(text: np.ndarray, depth: int) -> np.ndarray:
        n = len(text)
        rank, k = text.astype(np.int64), 1
        while True:
            nxt = np.zeros(n, dtype=np.int64)
            nxt[: n - k] = rank[k:] + 1 if k < n else 0
            key = rank * (n + 2) + nxt if k > 1 else rank * (int(text.max()) + 3) + nxt
            order = np.argsort(key, kind="stable")
            s = key[order]
            new = np.concatenate(([0], np.cumsum(s[1:] != s[:-1])))
            rank = np.empty(n, dtype=np.int64)
            rank[order] = new
            k *= 2
            if k >= depth or new[-1] == n - 1:
                return order

    def _rank(self, level: int, i: np.ndarray) -> np.ndarray:
        w = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.ones[level][w] + np.bitwise_count(self.bits[level][w] & mask)

    def step(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of symbol + pattern from those of patterns."""
        c = np.concatenate([symbol, symbol])
        i = np.concatenate([lo, hi])
        for level, s in enumerate(self.shifts):
            r = self._rank(level, i)
            i = np.where((c >> s) & 1, self.zeros[level] + r, i - r)
        i += (self.before[:-1] - self.base)[c]
        return i[: len(symbol)], i[len(symbol) :]

    def occurrences(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return self.weights[hi] - self.weights[lo]


def _extend(fm: FmIndex, text: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For each [left, right): the least start from left on from which the pattern up to right occurs twice or more."""
    at = right.copy()
    lo, hi = np.zeros(len(at), dtype=np.int64), np.full(len(at), fm.n, dtype=np.int64)
    live = np.flatnonzero(at > left)
    a, b = lo[live], hi[live]
    while len(live):
        a, b = fm.step(text[at[live] - 1], a, b)
        ok = fm.occurrences(a, b) >= 2
        live, a, b = live[ok], a[ok], b[ok]
        at[live] -= 1
        go = at[live] > left[live]
        live, a, b = live[go], a[go], b[go]
    return at


def repeated_windows(segs: list[np.ndarray], weight: np.ndarray, cfg: SubstringConfig) -> list[list[tuple[int, int]]]:
    """For each distinct segment the word intervals (start, end) covered by windows that occur twice or more in all."""
    size = np.array([len(s) for s in segs])
    off = np.concatenate(([0], np.cumsum(size + 1)))[:-1]
    _, symbols = np.unique(np.concatenate(segs), return_inverse=True)
    text = np.zeros(int((size + 1).sum()), dtype=np.int64)
    text[np.repeat(off - np.concatenate(([0], np.cumsum(size)))[:-1], size) + np.arange(len(symbols))] = symbols.ravel() + 1
    fm = FmIndex(text, np.repeat(weight, size + 1), cfg.window)
    w, hit = cfg.window, np.zeros(len(text) + 1, dtype=np.int64)

    def mark(start, end):
        np.add.at(hit, start, 1)
        np.add.at(hit, end, -1)

    twice = weight >= 2
    mark(off[twice], (off + size)[twice])
    ask = np.flatnonzero(~twice)
    # the windows from first to last are still open. From the left, [first, first + w): if it fails at j, all windows up
    # to j hold what failed; if it occurs, so does all that reaches further right as one string
    first, last = off[ask], off[ask] + size[ask] - w
    whole = True
    while len(ask):
        end = last + w if whole else first + w
        at = _extend(fm, text, first, end)
        good = end - at >= w
        mark(at[good], end[good])
        if whole:
            last = np.where(good, at - 1, last - 1)
        else:
            first = np.where(at == first, first + 1, at)
        whole = False
        go = first <= last
        ask, first, last = ask[go], first[go], last[go]
    cover = np.concatenate(([0], (np.cumsum(hit[:-1]) > 0).astype(np.int8), [0]))
    edge = np.flatnonzero(np.diff(cover))
    begin, stop = edge[0::2], edge[1::2]
    out: list[list[tuple[int, int]]] = [[] for _ in segs]
    owner = np.searchsorted(off, begin, side="right") - 1
    for k, a, b in zip(owner.tolist(), begin.tolist(), stop.tolist(), strict=True):
        out[k].append((a - int(off[k]), b - int(off[k])))
    return out


def search_shards(segs: DataFrame, cfg: SubstringConfig) -> DataFrame:
    """(id, th, start, size): word intervals that repeated windows cover. Rows of an anchor come together, in order, and
    an index is built whenever shard_words words of whole anchors are there."""
    dealt = segs.repartition(shuffle_parts(segs.sparkSession), "anchor").sortWithinPartitions("anchor", "seg")

    def flush(rows):
        keys: dict[int, int] = {}
        words, weight = [], []
        for r in rows:
            k = keys.setdefault(r[1], len(words))
            if k == len(words):
                words.append(np.frombuffer(r[2], dtype="<u8"))
                weight.append(0)
            weight[k] += len(r[3])
        spans = repeated_windows(words, np.array(weight), cfg)
        ids, ths, starts, sizes = [], [], [], []
        for r in rows:
            for a, b in spans[keys[r[1]]]:
                ids += r[3]
                ths += r[4]
                starts += [s + a for s in r[5]]
                sizes += [b - a] * len(r[3])
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ths, pa.int64()), pa.array(starts, pa.int32()), pa.array(sizes, pa.int32())], names=["id", "th", "start", "size"])

    def run(batches):
        rows, held, last = [], 0, None
        for b in batches:
            for r in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if held >= cfg.shard_words and r[0] != last:
                    yield flush(rows)
                    rows, held = [], 0
                rows.append(r)
                held, last = held + len(r[2]) // 8, r[0]
        if rows:
            yield flush(rows)

    return dealt.mapInArrow(run, "id long, th long, start int, size int")


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", cfg: SubstringConfig = SubstringConfig()) -> DataFrame:
    """(id, th, spans array<struct<start, size>>): per document with repeated windows the word intervals they cover."""
    shared = anchor_counts(docs, text_col, cfg).groupBy("anchor").agg(F.sum("n").alias("n")).filter("n > 1").select("anchor")
    shared = materialize(shared, "anchors")
    found = search_shards(segments(docs, id_col, text_col, cfg, shared), cfg)
    return found.groupBy("id", "th").agg(F.collect_set(F.struct("start", "size")).alias("spans"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", cfg: SubstringConfig = SubstringConfig(), with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and kept_text if asked for): a row per row of docs.

    Null texts have no words; the hash of no words is that of the empty text. Repeated rows repeat each other's windows.
    Null ids are one id. Other columns are not read. An empty table gives an empty table.
    """
    spans = repeated_spans(docs, id_col, text_col, cfg).select(F.col("id").alias("_i"), F.col("th").alias("_t"), "spans")
    places = _places(docs, id_col, text_col)
    t = places.join(spans, places.id.eqNullSafe(F.col("_i")) & (places.th == F.col("_t")), "left").select("id", "t", "spans")

    def run(batches):
        for b in batches:
            n, gone, sha, kept = [], [], [], []
            starts = b.column(2)
            for text, s in zip(b.column(1).to_pylist(), starts, strict=True):
                words = (text or "").encode("utf-8", "surrogatepass").split()
                n.append(len(words))
                if s.is_valid:
                    d = np.zeros(len(words) + 1, dtype=np.int64)
                    for x in s.as_py():
                        d[x["start"]] += 1
                        d[x["start"] + x["size"]] -= 1
                    stay = np.flatnonzero(np.cumsum(d[:-1]) == 0)
                    words = [words[k] for k in stay.tolist()]
                gone.append(n[-1] - len(words))
                joined = b" ".join(words)
                sha.append(hashlib.sha256(joined).hexdigest())
                kept.append(joined.decode("utf-8", "surrogatepass") if with_text else None)
            cols = [b.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string())]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
            if with_text:
                cols, names = [*cols, pa.array(kept, pa.string())], [*names, "kept_text"]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return t.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text)

"""Operator 6, quality rules: repetition from a suffix array over the words of each document.

Suffixes of all documents in a slice are sorted together by prefix doubling (only suffixes that still tie are sorted
again); longest common prefixes of neighbours come from the stored ranks. A suffix's longest repeat is the larger of
its two; the union of the spans [i, i + repeat) is the union of all maximal repeated substrings.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import mix64, slices, small, word_hashes

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class RepetitionRules:
    """Base limits and those of the method. Repeats under min_repeat words are ignored; a document goes if they cover
    more than max_covered of its words, or one is longer than max(long_repeat, long_share * n_words)."""

    min_words: int = 10
    window: int = 5
    max_window_share: float = 0.20
    min_repeat: int = 4
    max_covered: float = 0.30
    long_repeat: int = 50
    long_share: float = 0.15
    slice_bytes: int = 2_000_000


def longest_repeats(words: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each word position the length of the longest run of words starting there that starts elsewhere in its document."""
    n = len(words)
    out = np.zeros(n, dtype=np.int64)
    if n < 2:
        return out
    doc = np.repeat(np.arange(len(counts)), counts)
    stop = np.repeat(np.cumsum(counts), counts)
    key = mix64(words + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key, kind="stable")
    rank = np.empty(n, dtype=np.int64)
    new = np.concatenate(([True], key[order][1:] != key[order][:-1]))
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    levels, k = [rank.copy()], 1
    live = _tied(rank, np.arange(n))
    while len(live):
        nxt = live + k
        inside = nxt < stop[live]
        second = np.where(inside, rank[np.minimum(nxt, n - 1)] + 1, 0)
        order = np.lexsort((second, rank[live]))
        live, second = live[order], second[order]
        old = rank[live]
        head = np.concatenate(([True], old[1:] != old[:-1]))
        cut = head | np.concatenate(([True], second[1:] != second[:-1]))
        at = np.arange(len(live))
        rank[live] = old + np.maximum.accumulate(np.where(cut, at, 0)) - np.maximum.accumulate(np.where(head, at, 0))
        k *= 2
        levels.append(rank.copy())
        live = _tied(rank, live)
    suffixes = np.empty(n, dtype=np.int64)
    suffixes[rank] = np.arange(n)
    first = levels[0]
    left, right = suffixes[:-1], suffixes[1:]
    pair = first[left] == first[right]
    left, right = left[pair], right[pair]
    lcp = np.zeros(len(left), dtype=np.int64)
    for step in range(len(levels) - 1, -1, -1):
        size, level = 1 << step, levels[step]
        a, b = left + lcp, right + lcp
        ok = (a + size <= stop[left]) & (b + size <= stop[right])
        a, b = np.minimum(a, n - 1), np.minimum(b, n - 1)
        lcp += size * (ok & (level[a] == level[b]))
    np.maximum.at(out, left, lcp)
    np.maximum.at(out, right, lcp)
    return out


def _tied(rank: np.ndarray, live: np.ndarray) -> np.ndarray:
    """Those of live whose rank another one shares."""
    r = rank[live]
    order = np.argsort(r, kind="stable")
    s = r[order]
    same = s[1:] == s[:-1]
    tie = np.concatenate((same, [False])) | np.concatenate(([False], same))
    return live[order[tie]]


def _covered(at: np.ndarray, size: np.ndarray, n: int) -> np.ndarray:
    d = np.zeros(n + 1, dtype=np.int64)
    np.add.at(d, at, 1)
    np.add.at(d, at + size, -1)
    return np.cumsum(d[:-1]) > 0


def _dup_lines(text: str) -> int:
    seen, dup = set(), 0
    if "\n" in text:
        for line in text.split("\n"):
            if line in seen:
                dup += 1
            elif line.strip(SPACES):
                seen.add(line)
    return dup


METRICS = pa.schema(
    [("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("covered_words", pa.int64()), ("longest_repeat", pa.int64())]
)
METRICS_DDL = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, covered_words long, longest_repeat long"


def measure(texts: list[str | None], rules: RepetitionRules) -> pa.RecordBatch:
    """The metrics of each text, a null text being one without words."""
    texts = [t or "" for t in texts]
    blobs = [t.encode("utf-8", "surrogatepass") for t in texts]
    cols = {f: [] for f in ("n_words", "n_repeat_words", "covered_words", "longest_repeat")}
    for i, j in slices([len(b) for b in blobs], rules.slice_bytes):
        words, counts = word_hashes(blobs[i:j])
        rep = longest_repeats(words, counts)
        bounds = np.concatenate(([0], np.cumsum(counts)))
        n, w = len(words), rules.window
        hit = np.flatnonzero(rep >= w)
        windowed = np.concatenate(([0], np.cumsum(_covered(hit, w, n))))
        hit = np.flatnonzero(rep >= rules.min_repeat)
        spans = np.concatenate(([0], np.cumsum(_covered(hit, rep[hit], n))))
        longest = np.zeros(len(counts), dtype=np.int64)
        if n:
            full = counts > 0
            longest[full] = np.maximum.reduceat(rep, bounds[:-1][full])
        cols["n_words"].append(counts)
        cols["n_repeat_words"].append(np.diff(windowed[bounds]))
        cols["covered_words"].append(np.diff(spans[bounds]))
        cols["longest_repeat"].append(longest)
    c = {k: np.concatenate(v).astype(np.int64) if v else np.empty(0, np.int64) for k, v in cols.items()}
    n = c["n_words"]
    base = (n < rules.min_words) | (c["n_repeat_words"] * 100 > round(100 * rules.max_window_share) * n)
    method = (c["covered_words"] <= rules.max_covered * n) & (c["longest_repeat"] <= np.maximum(rules.long_repeat, rules.long_share * n))
    c |= {
        "word_chars": np.array([len(t) - sum(map(t.count, SPACES)) for t in texts], dtype=np.int64),
        "n_symbols": np.array([sum(map(t.count, SYMBOLS)) for t in texts], dtype=np.int64),
        "n_dup_lines": np.array([_dup_lines(t) for t in texts], dtype=np.int64),
        "base_failed": base,
        "kept": ~base & method,
    }
    return pa.RecordBatch.from_arrays([pa.array(c[f.name], f.type) for f in METRICS], schema=METRICS)


def repetition_metrics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: RepetitionRules = RepetitionRules()) -> DataFrame:
    """id_col and the metrics, a row per row of docs. Null or empty text: no words, so base_failed. Repeated rows are
    measured one by one; other columns of docs are not read, so their names cannot clash. An empty table gives none."""

    def run(batches):
        for b in small(batches, 1):
            m = measure(b.column(1).to_pylist(), rules)
            yield pa.RecordBatch.from_arrays([b.column(0), *m.columns], names=[id_col, *METRICS.names])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, {METRICS_DDL}")


def keep_clean(docs: DataFrame, text_col: str = "text", rules: RepetitionRules = RepetitionRules()) -> DataFrame:
    """The rows of docs, all columns unchanged, that the rules keep. Rows with a null text have no words and go."""

    at = docs.columns.index(text_col)

    def run(batches):
        for b in small(batches, at):
            yield b.filter(measure(b.column(at).to_pylist(), rules).column("kept"))

    return docs.mapInArrow(run, docs.schema)

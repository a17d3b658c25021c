"""Operator 4, SentencePiece encoding and decoding by a max-plus scan over chunks.

A text is a path through the lattice of vocabulary pieces. Its boundary state at a chunk border is the piece that
covers the border, as (start, end) positions. A chunk's transfer matrix holds for each pair of states at its two borders
the best score of a path between them. Matrices combine by the (max, +) product, which is associative; prefix and suffix
products give the one best state at each border, and each chunk is then backtraced by itself.

Edge weights. Unigram models: the score of a piece. BPE models: 0 if the two neighbours form a stable pair (merging
their joined text gives just these two), else minus infinity; a text's BPE encoding is the only path of stable pairs.
Where no piece can cross a place (before a run of spaces, beside a character outside the vocabulary) the text is cut
into units, which are encoded once per worker and kept in a bounded table.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small

SPACE = "▁"
NONE = -np.inf


@dataclass(frozen=True)
class Vocabulary:
    """pieces and scores by id; kind 'unigram' or 'bpe'; byte_ids: ids of the byte pieces by value, or None."""

    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    kind: str
    special: frozenset[int]
    byte_ids: tuple[int, ...] | None
    unk_id: int

    @staticmethod
    def load(path: str) -> Vocabulary:
        """Reads the vocabulary of a model file on the driver. Its segmentation code isn't used."""
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        n = m.vocab_size()
        bytes_ = {int(m.id_to_piece(i)[3:5], 16): i for i in range(n) if m.is_byte(i)}
        special = frozenset(i for i in range(n) if m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))
        kind = {1: "unigram", 2: "bpe"}[_model_type(open(path, "rb").read())]
        return Vocabulary(tuple(m.id_to_piece(i) for i in range(n)), tuple(m.get_score(i) for i in range(n)), kind, special, tuple(bytes_[b] for b in range(256)) if len(bytes_) == 256 else None, m.unk_id())


def _fields(buf: bytes):
    """(number, value) of the fields of a protocol buffer message."""
    at = 0

    def varint():
        nonlocal at
        x = shift = 0
        while True:
            x |= (buf[at] & 127) << shift
            shift, at = shift + 7, at + 1
            if buf[at - 1] < 128:
                return x

    while at < len(buf):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            value = varint()
        else:
            size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
            value, at = buf[at : at + size], at + size
        yield tag >> 3, value


def _model_type(buf: bytes) -> int:
    trainer = b"".join(v for k, v in _fields(buf) if k == 2)
    return next((v for k, v in _fields(trainer) if k == 3), 1)


class Merges:
    """BPE on many short units at once. A row of the table is a pair of pieces whose joined text is a piece."""

    def __init__(self, ids: dict[str, int], rank: dict[str, float]):
        self.n = max(ids.values(), default=0) + 1
        order = np.unique([rank[p] for p in ids], return_inverse=True)[1].ravel() if ids else []
        at = dict(zip(ids, np.asarray(order).tolist(), strict=True))
        rows = [(ids[p[:c]] * self.n + ids[p[c:]], at[p], k) for p, k in ids.items() for c in range(1, len(p)) if p[:c] in ids and p[c:] in ids]
        t = np.array(sorted(rows) or np.empty((0, 3)), dtype=np.int64)
        self.none = len(ids)
        size = 1 << max(4, int(4 * len(t)).bit_length())
        self.mask, self.shift = size - 1, np.uint64(64 - size.bit_length() + 1)
        self.keys, self.ranks, self.to = np.full(size, -1, dtype=np.int64), np.full(size, self.none, dtype=np.int32), np.zeros(size, dtype=np.int32)
        slot, todo = self._slot(t[:, 0]), np.arange(len(t))
        while len(todo):  # of rows that want one free place the first gets it, the others try the next place
            free = todo[self.keys[slot[todo]] < 0]
            place, first = np.unique(slot[free], return_index=True)
            won = free[first]
            self.keys[place], self.ranks[place], self.to[place] = t[won].T
            todo = np.setdiff1d(todo, won, assume_unique=True)
            slot[todo] = (slot[todo] + 1) & self.mask
        codes = {ord(p): k for p, k in ids.items() if len(p) == 1}
        self.chars = np.full(0x110000, -1, dtype=np.int32)
        self.chars[list(codes)] = list(codes.values())

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (self.none: no piece) and id of the joined text of each pair; ids under 0 stand for nothing."""
        key = np.where((a < 0) | (b < 0), -2, a.astype(np.int64) * self.n + b)
        at = self._slot(key)
        live = np.flatnonzero((self.keys[at] != key) & (self.keys[at] >= 0))
        while len(live):
            at[live] = (at[live] + 1) & self.mask
            live = live[(self.keys[at[live]] != key[live]) & (self.keys[at[live]] >= 0)]
        return np.where(self.keys[at] == key, self.ranks[at], self.none), self.to[at]

    def run(self, units: list[str]) -> list[bytes | None]:
        """The ids of each unit as little-endian int32; None for units with a character that is no piece."""
        out: list[bytes | None] = [None] * len(units)
        size = np.array(list(map(len, units)), dtype=np.int64)
        order = np.argsort(size, kind="stable")
        for part in np.array_split(order, max(1, len(order) // 8192)):
            n = size[part]
            code = np.frombuffer("".join([units[i] for i in part.tolist()]).encode("utf-32-le", "surrogatepass"), dtype="<u4")
            x = np.full((len(part), int(n.max(initial=1))), -1, dtype=np.int32)
            inside = np.arange(x.shape[1]) < n[:, None]
            x[inside] = self.chars[code]
            known = ((x >= 0) == inside).all(axis=1)
            part, x = part[known], self._merge(x[known])
            stay = x >= 0
            raw, end = x[stay].astype("<i4").tobytes(), (4 * np.cumsum(stay.sum(axis=1))).tolist()
            for i, lo, hi in zip(part.tolist(), [0, *end], end, strict=False):
                out[i] = raw[lo:hi]
        return out

    def _merge(self, x: np.ndarray) -> np.ndarray:
        """Merges in all rows at once: each time the pair of least rank, of equal ranks the leftmost."""
        if x.shape[1] < 2 or not len(x):
            return x
        rank = self.find(x[:, :-1].ravel(), x[:, 1:].ravel())[0].reshape(len(x), -1)
        live = np.arange(len(x))
        while True:
            i = rank.argmin(axis=1)
            go = rank[np.arange(len(rank)), i] < self.none
            live, rank, i = live[go], rank[go], i[go]
            if not len(live):
                return x
            r, w = np.arange(len(live)), x.shape[1]
            part = np.concatenate([x[live], np.full((len(live), 1), -1, dtype=np.int32)], axis=1)
            joined = self.find(part[r, i], part[r, i + 1])[1]
            cols = np.arange(w)
            part = np.take_along_axis(part, cols + (cols > i[:, None]), axis=1)
            part[r, i] = joined
            x[live] = part
            rank = np.concatenate([rank, np.full((len(live), 1), self.none, dtype=rank.dtype)], axis=1)
            cols = cols[:-1]
            rank = np.take_along_axis(rank, cols + (cols > i[:, None]), axis=1)
            for j in (i - 1, i):
                ok = np.flatnonzero((j >= 0) & (j < w - 1))
                rank[ok, j[ok]] = self.find(part[ok, j[ok]], part[ok, j[ok] + 1])[0]


class Encoder:
    def __init__(self, vocab: Vocabulary, cache_items: int = 100_000):
        self.v = vocab
        self.ids = {p: i for i, p in enumerate(vocab.pieces) if i not in vocab.special}
        self.rank = {p: -vocab.scores[i] for p, i in self.ids.items()}
        self.longest = max(map(len, self.ids), default=1)
        self.chars = {c for p in self.ids if len(p) == 1 for c in p}
        if vocab.kind == "unigram":
            self.chars = {c for p in self.ids for c in p}
        known = "".join(re.escape(c) for c in sorted(self.chars - {SPACE}))
        s = SPACE if SPACE in self.chars else ""
        self.clean = bool(s) and not any(a != SPACE and b == SPACE for p in self.ids for a, b in pairwise(p))
        word = f"{s}*[{known}]+|{s}+|." if self.clean else f"[{known}{s}]+|."
        self.unit = re.compile(word, re.DOTALL)
        self.by_word = self.clean and "\n" not in self.chars
        self.merges = Merges(self.ids, self.rank) if vocab.kind == "bpe" else None
        self.stable: dict[tuple[int, int], bool] = {}
        self.now: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        self.cache_items = cache_items
        self.bytes = [p.replace(SPACE, " ").encode() for p in vocab.pieces]
        for i in vocab.special:
            self.bytes[i] = b""
        for b, i in enumerate(vocab.byte_ids or ()):
            self.bytes[i] = bytes([b])
        self.column = pa.array(self.bytes, pa.binary())

    # -- BPE on short strings: defines which pairs are stable
    def merge(self, text: str) -> list[str]:
        parts, rank = list(text), self.rank
        ranks = [rank.get(a + b, np.inf) for a, b in pairwise(parts)]
        while ranks and (best := min(ranks)) < np.inf:
            i = ranks.index(best)  # of equal ranks the leftmost
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank.get(parts[i - 1] + parts[i], np.inf)
            if i < len(ranks):
                ranks[i] = rank.get(parts[i] + parts[i + 1], np.inf)
        return parts

    def weight(self, left: int | None, right: int) -> float:
        if self.v.kind == "unigram":
            return self.v.scores[right]
        key = (left, right)
        ok = self.stable.get(key)
        if ok is None:
            a, b = self.v.pieces[left] if left is not None else "", self.v.pieces[right]
            ok = self.merge(a + b) == [x for x in (a, b) if x]
            if len(self.stable) > self.cache_items:
                self.stable.clear()
            self.stable[key] = ok
        return 0.0 if ok else NONE

    def forward(self, text: str, begin: int, end: int, first: int | None = None):
        """Best score and last piece of paths over text[begin:p] for p up to end, after the piece first."""
        best, last, size = {begin: 0.0}, {begin: (begin, first)}, self.longest
        for p in range(begin + 1, end + 1):
            for q in range(max(begin, p - size), p):
                if q in best and (k := self.ids.get(text[q:p])) is not None:
                    w = best[q] + self.weight(last[q][1], k)
                    if w > best.get(p, NONE):
                        best[p], last[p] = w, (q, k)
        return best, last

    @staticmethod
    def path(last: dict, begin: int, end: int) -> list[int]:
        out = []
        while end > begin:
            end, k = last[end]
            out.append(k)
        return out[::-1]

    def _encode_unit(self, unit: str) -> tuple[int, ...]:
        k = self.ids.get(unit)
        if k is not None and self.v.kind == "bpe" and self.weight(None, k) == 0:
            return (k,)
        if len(unit) == 1 and unit not in self.chars:
            return self.unknown(unit)
        if self.v.kind == "bpe" and len(unit) <= 24:  # plain merging is the same path, and faster on short units
            return tuple(self.ids[p] for p in self.merge(unit))
        best, last = self.forward(unit, 0, len(unit))
        return tuple(self.path(last, 0, len(unit))) if len(unit) in best else tuple(chain.from_iterable(map(self.unknown, unit)))

    def unknown(self, c: str) -> tuple[int, ...]:
        k = self.ids.get(c)
        if k is not None:
            return (k,)
        if self.v.byte_ids is None:
            return (self.v.unk_id,)
        return tuple(self.v.byte_ids[b] for b in c.encode("utf-8", "surrogatepass"))

    @staticmethod
    def escape(text: str | None) -> str:
        """The dummy space before, spaces as U+2581; no other normalisation. Null and empty: empty."""
        return SPACE + text.replace(" ", SPACE) if text else ""

    def keys(self, text: str | None) -> list[str]:
        """The text in parts that no piece crosses: a word stands for a space and the word, "\\n" and a word for both, a key
        that begins with a space or holds one for itself. No other key begins with a space or a line break."""
        if not text:
            return []
        if not self.by_word or SPACE in text:
            return [" " + text]
        first, *lines = text.split("\n")
        out = [" " + first] if "  " in first or first[:1] == " " else first.split(" ")
        for line in lines:
            if "  " in line:
                out.append("\n" + line)
            else:
                words = line.split(" ")
                words[0] = "\n" + words[0]
                out += words
        return out

    def table(self, keys) -> dict[str, bytes]:
        """The ids of each distinct key as little-endian int32; those not met of late are encoded together."""
        got, new = {}, []
        now, before = self.now, self.before
        for k in set(keys):
            x = now.get(k) or before.get(k)
            if x is None:
                new.append(k)
            else:
                got[k] = x
        got.update(zip(new, self._encode_keys(new), strict=True))
        now.update((k, got[k]) for k in got if len(k) <= 32 and " " not in k)
        if len(now) >= self.cache_items:  # units in use come back from the table before
            self.now, self.before = {}, now
        return got

    def _encode_keys(self, keys: list[str]) -> list[bytes]:
        escaped = [k.replace(" ", SPACE) if k[:1] in ("\n", " ") else SPACE + k for k in keys]
        if self.merges is None:
            return [self._bytes(self.unit.findall(e)) for e in escaped]
        plain = self.clean
        at = [i for i, e in enumerate(escaped) if plain and len(e) <= 24 and SPACE not in e[1:]]
        out: list[bytes | None] = [None] * len(keys)
        for i, x in zip(at, self.merges.run([escaped[i] for i in at]), strict=True):
            out[i] = x
        rest = [i for i, x in enumerate(out) if x is None]
        if rest:  # keys of several units: those go the same way, each distinct one once
            units = [self.unit.findall(escaped[i]) for i in rest]
            short = [u for u in set(chain.from_iterable(units)) if len(u) <= 24]
            ids = dict(zip(short, self.merges.run(short), strict=True))
            for i, us in zip(rest, units, strict=True):
                out[i] = b"".join([ids.get(u) or self._bytes([u]) for u in us])
        return out

    def _bytes(self, units: list[str]) -> bytes:
        return np.array(list(chain.from_iterable(map(self._encode_unit, units))), dtype="<i4").tobytes()

    def raw(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian int32."""
        keys = list(map(self.keys, texts))
        get = self.table(chain.from_iterable(keys)).__getitem__
        return [b"".join(map(get, k)) for k in keys]

    def encode(self, text: str | None) -> np.ndarray:
        return np.frombuffer(self.raw([text])[0], dtype="<i4")

    def middle(self, escaped: str) -> list[int]:
        """Ids of a part of an escaped text that begins and ends at cuts."""
        if not self.by_word:
            return np.frombuffer(self._bytes(self.unit.findall(escaped)), dtype="<i4").tolist()
        first, *lines = escaped.split("\n")
        head, *words = [first] if SPACE * 2 in first else first.split(SPACE)
        for line in lines:
            if SPACE * 2 in line:
                words.append("\n" + line)
            else:
                more = line.split(SPACE)
                more[0] = "\n" + more[0]
                words += more
        got = self.table(words)
        return np.frombuffer(self._bytes(self.unit.findall(head)) + b"".join(map(got.__getitem__, words)), dtype="<i4").tolist()

    def decode(self, ids) -> str:
        raw = b"".join(map(self.bytes.__getitem__, ids.tolist() if isinstance(ids, np.ndarray) else ids))
        return raw.decode("utf-8", "replace")[1:] if raw[:1] == b" " else raw.decode("utf-8", "replace")

    def decodes_to(self, flat: np.ndarray, sizes: np.ndarray, texts: pa.Array) -> pa.Array:
        """Whether decoding gives each text back; flat: the ids of all texts, sizes: how many each has."""
        pieces = self.column.take(pa.array(flat))
        off = np.frombuffer(pieces.buffers()[1], dtype=np.int32)[pieces.offset :][: len(flat) + 1]
        ends = np.ascontiguousarray(off[np.concatenate(([0], np.cumsum(sizes)))])
        back = pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(ends), pieces.buffers()[2]])
        full = pc.greater(pc.binary_length(texts), 0)
        want = pc.if_else(full, pc.binary_join_element_wise(" ", texts, ""), "")
        return pc.equal(back, want.cast(pa.binary()))

    # -- chunks of giant texts. Positions count from the window's start; the chunk is window[lead:lead+size].
    def is_cut(self, window: str, p: int) -> bool:
        """Whether a unit begins at p."""
        if p == 0 or window[p] not in self.chars or window[p - 1] not in self.chars:
            return True
        return self.clean and window[p] == SPACE != window[p - 1]

    def first_cut(self, window: str, a: int, b: int) -> int | None:
        """The first unit that begins in [a, b]."""
        return next((p for p in range(a, min(b + 1, len(window))) if self.is_cut(window, p)), None)

    def last_cut(self, window: str, a: int, b: int) -> int:
        return next(p for p in range(min(b, len(window) - 1), a - 1, -1) if self.is_cut(window, p))

    def states(self, window: str, border: int) -> list[tuple[int, int]]:
        """Pieces and unknown characters that cover the border or end at it, as (start, end) relative to it."""
        out = []
        for s in range(max(0, border - self.longest), border):
            for e in range(border, min(len(window), s + self.longest) + 1):
                if window[s:e] in self.ids or e == s + 1 == border and window[s] not in self.chars:
                    out.append((s - border, e - border))
        return out

    def _token(self, window: str, border: int, state: tuple[int, int] | None) -> int | None:
        return self.ids.get(window[border + state[0] : border + state[1]], self.v.unk_id) if state else None

    def transfer(self, window: str, lead: int, size: int, first: bool, final: bool) -> tuple[list, list, np.ndarray]:
        """Entry states, exit states and the matrix of best scores of a chunk. The text's ends have one state, None."""
        border = lead + size
        entries = [None] if first else self.states(window, lead)
        exits = [None] if final else self.states(window, border)
        m = np.full((len(entries), len(exits)), NONE)
        for i, state in enumerate(entries):
            for j, x in enumerate(exits):
                m[i, j] = self._link(window, lead, border, state, x, ids=False)[0]
        return entries, exits, m

    def _link(self, window: str, lead: int, border: int, entry, leave, ids: bool = True):
        """Score and ids of the path from the end of entry to the end of leave."""
        at = lead + (entry[1] if entry else 0)
        goal = border + (leave[0] if leave else 0)  # where the leaving piece starts
        if getattr(self, "_memo_of", None) is not window:
            self._memo_of, self._memo = window, {}
        if leave is not None and at == border + leave[1] and entry is not None and lead + entry[0] == goal:
            return 0.0, []  # one piece covers both borders
        if at > goal:
            return NONE, []
        key = (lead, entry, goal, ids)
        if key not in self._memo:
            self._memo[key] = self._reach(window, at, self._token(window, lead, entry), goal, ids)
        score, out, before = self._memo[key]
        if leave is None or score == NONE:
            return score, out
        k = self._token(window, border, leave)
        c = window[goal]
        if c not in self.chars and leave[1] - leave[0] == 1:
            return score, out + list(self.unknown(c))
        return score + self.weight(None if self.is_cut(window, goal) else before, k), [*out, k]

    def _reach(self, window: str, at: int, first: int | None, goal: int, ids: bool):
        """Best path from at, after the piece first, to goal: score, ids if asked for, last piece (None at a cut).

        What lies before the first cut and after the last is searched; the units between are encoded whole, and not at
        all where only the score counts and is 0."""
        head = self.first_cut(window, at, goal)
        if head is None:
            return self._search(window, at, goal, first)
        score, out, tail = 0.0, [], self.last_cut(window, head, goal)
        if head > at:
            score, out, _ = self._search(window, at, head, first)
        if tail > head and score > NONE and (ids or self.v.kind == "unigram"):
            middle = self.middle(window[head:tail])
            out = out + middle
            score += sum(map(self.v.scores.__getitem__, middle)) if self.v.kind == "unigram" else 0.0
        if goal == tail or score == NONE:
            return score, out, None
        if goal == len(window):
            unit = list(self._encode_unit(window[tail:goal]))
            return score + (sum(self.v.scores[k] for k in unit) if self.v.kind == "unigram" else 0.0), out + unit, unit[-1]
        more, rest, before = self._search(window, tail, goal, None)
        return score + more, out + rest, before

    def _search(self, window: str, a: int, b: int, first: int | None):
        best, last = self.forward(window, a, b, first)
        if b not in best:
            return NONE, [], None
        ids = self.path(last, a, b)
        return best[b], ids, ids[-1] if ids else first


def maxplus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a[:, :, None] + b[None, :, :]).max(axis=1, initial=NONE)


def best_states(matrices: list[np.ndarray]) -> list[int]:
    """Index of the best path's state at each inner border: prefix products from the left meet suffix products."""
    right = [np.zeros((1, 1))]
    for m in reversed(matrices[1:]):
        right.append(maxplus(m, right[-1]))
    left, out = np.zeros((1, 1)), []
    for m, tail in zip(matrices[:-1], reversed(right), strict=False):
        left = maxplus(left, m)
        i = int(np.argmax(left[0] + tail[:, 0]))
        out.append(i)
        left = np.where(np.arange(left.shape[1]) == i, left, NONE)
    return out


_WORKER: dict[bytes, Encoder] = {}


def _encoder(vocab) -> Encoder:
    v = vocab.value
    if id(v) not in _WORKER:
        _WORKER.clear()
        _WORKER[id(v)] = Encoder(v)
    return _WORKER[id(v)]


def chunk_rows(docs: DataFrame, key: str, text_col: str, chunk_chars: int, halo: int) -> DataFrame:
    """(key, chunk_no, n_chunks, window, lead): chunks of the escaped text with halo characters on both sides."""
    escaped = F.concat(F.lit(SPACE), F.translate(F.col(text_col), " ", SPACE))
    t = docs.select(F.col(key), escaped.alias("t")).withColumn("n_chunks", F.ceil(F.length("t") / chunk_chars).cast("int"))
    t = t.select("*", F.explode(F.sequence(F.lit(0), F.col("n_chunks") - 1)).alias("chunk_no"))
    begin = F.col("chunk_no") * chunk_chars
    lead = F.least(begin, F.lit(halo))
    size = F.least(F.lit(chunk_chars), F.length("t") - begin)
    return t.select(key, "chunk_no", "n_chunks", F.substring("t", begin - lead + 1, lead + size + halo).alias("window"), lead.alias("lead"), size.alias("size"))


DIGEST = "n_tokens long, ids_sha256 string"
IDS = "token_ids array<int>"


def _result(enc: Encoder, keys: pa.Array, texts: pa.Array, raw: list[bytes], id_col: str, digest: bool) -> pa.RecordBatch:
    """Rows of encode() from each text's ids as little-endian int32: the ids themselves, or their number and SHA-256."""
    flat, sizes = np.frombuffer(b"".join(raw), dtype="<i4"), np.array(list(map(len, raw)), dtype=np.int64) // 4
    if digest:
        made = {"n_tokens": pa.array(sizes), "ids_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in raw], pa.string())}
    else:
        made = {"token_ids": pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.array(flat, pa.int32()))}
    texts = pc.fill_null(texts, "")
    cols = {id_col: keys, "n_chars": pc.utf8_length(texts).cast(pa.int64()), **made, "decoded_equal": enc.decodes_to(flat, sizes, texts)}
    return pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))


def encode(docs: DataFrame, vocab: Vocabulary, id_col: str = "doc_id", text_col: str = "text", chunk_chars: int = 32_768, digest: bool = False) -> DataFrame:
    """(id_col, n_chars long, token_ids array<int>, decoded_equal boolean): a row per row of docs; with digest, n_tokens and
    ids_sha256 (of the ids as little-endian int32) in place of the ids.

    Null and empty texts: no tokens, equal. decoded_equal: decoding gives the text back (a text that itself holds U+2581
    does not). Texts over chunk_chars go through the chunk scan, a task per chunk; repeated rows are each encoded.
    Other columns of docs are not read. An empty table gives an empty table.
    """
    spark: SparkSession = docs.sparkSession
    shared = spark.sparkContext.broadcast(vocab)
    kind = docs.schema[id_col].dataType.simpleString()
    out = f"`{id_col}` {kind}, n_chars long, {DIGEST if digest else IDS}, decoded_equal boolean"

    def whole(batches):
        enc = _encoder(shared)
        for b in small(batches, 1, 2_000_000):
            yield _result(enc, b.column(0), b.column(1), enc.raw(b.column(1).to_pylist()), id_col, digest)

    long = F.coalesce(F.length(text_col), F.lit(0)) >= chunk_chars
    short = docs.select(id_col, text_col).filter(~long).mapInArrow(whole, out)
    giant = docs.select(id_col, text_col).filter(long)
    return short.unionByName(encode_giant(giant, shared, id_col, text_col, chunk_chars, out, digest))


def encode_giant(giant: DataFrame, shared, id_col: str, text_col: str, chunk_chars: int, out: str, digest: bool) -> DataFrame:
    """The chunk scan: a transfer matrix per chunk, states per text, a backtrace per chunk, chunks in order again.

    Rows of one id and one text are the same text, encoded once and given out as often as they came.
    """
    key = "_key"
    halo = 2 * max(len(p) for i, p in enumerate(shared.value.pieces) if i not in shared.value.special)
    named = giant.withColumn(key, F.sha2(F.concat_ws("\x01", F.col(id_col).cast("string"), F.col(text_col)), 256))
    chunks = chunk_rows(named.dropDuplicates([key]), key, text_col, chunk_chars, halo).repartition(F.col(key), F.col("chunk_no"))

    def matrices(batches):
        enc = _encoder(shared)
        for b in small(batches, 3, 1_000_000):
            rows = []
            for r in b.to_pylist():
                first, final = r["chunk_no"] == 0, r["chunk_no"] == r["n_chunks"] - 1
                entries, exits, m = enc.transfer(r["window"], r["lead"], r["size"], first, final)
                flat = lambda states: [x for s in states if s for x in s]
                rows.append((r[key], r["chunk_no"], flat(entries), flat(exits), m.shape[0], m.ravel().tolist()))
            c = list(zip(*rows, strict=True)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.string()), pa.array(c[1], pa.int32()), pa.array(c[2], pa.list_(pa.int32())), pa.array(c[3], pa.list_(pa.int32())), pa.array(c[4], pa.int32()), pa.array(c[5], pa.list_(pa.float64()))], names=[key, "chunk_no", "entries", "exits", "n", "m"])

    scanned = chunks.mapInArrow(matrices, f"{key} string, chunk_no int, entries array<int>, exits array<int>, n int, m array<double>")

    def scan(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["chunk_no"])
        picks = best_states([np.array(r["m"]).reshape(r["n"], -1) for r in rows])
        at = [None, *[rows[i]["exits"][2 * p : 2 * p + 2] for i, p in enumerate(picks)], None]
        return pa.table({key: pa.array([r[key] for r in rows], pa.string()), "chunk_no": pa.array([r["chunk_no"] for r in rows], pa.int32()), "enter": pa.array(at[:-1], pa.list_(pa.int32())), "leave": pa.array(at[1:], pa.list_(pa.int32()))})

    states = scanned.groupBy(key).applyInArrow(scan, f"{key} string, chunk_no int, enter array<int>, leave array<int>")

    def back(batches):
        enc = _encoder(shared)
        for b in small(batches, 3, 1_000_000):
            ids = []
            for r in b.to_pylist():
                pair = lambda s: tuple(s) if s else None
                ids.append(enc._link(r["window"], r["lead"], r["lead"] + r["size"], pair(r["enter"]), pair(r["leave"]))[1])
            yield pa.RecordBatch.from_arrays([b.column(b.schema.names.index(key)), b.column(b.schema.names.index("chunk_no")), pa.array(ids, pa.list_(pa.int32()))], names=[key, "chunk_no", "ids"])

    traced = chunks.join(states, [key, "chunk_no"]).mapInArrow(back, f"{key} string, chunk_no int, ids array<int>")
    joined = traced.groupBy(key).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("chunk_no", "ids"))), lambda x: x["ids"])).alias("token_ids"))

    def checked(batches):
        enc = _encoder(shared)
        for b in small(batches, 1):
            yield _result(enc, b.column(0), b.column(1), [x.values.to_numpy().astype("<i4").tobytes() for x in b.column(2)], id_col, digest)

    return named.join(joined, key).select(id_col, text_col, "token_ids").mapInArrow(checked, out)


def decode(tokens: DataFrame, vocab: Vocabulary, id_col: str = "doc_id", ids_col: str = "token_ids") -> DataFrame:
    """(id_col, text): the text of each row's ids; null ids give the empty text."""
    shared = tokens.sparkSession.sparkContext.broadcast(vocab)

    def run(batches):
        enc = _encoder(shared)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([enc.decode(x or []) for x in b.column(1).to_pylist()], pa.string())], names=[id_col, "text"])

    return tokens.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {tokens.schema[id_col].dataType.simpleString()}, text string")

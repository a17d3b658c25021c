"""Shared helpers: the cluster's shared folder, materialised tables, word hashing in numpy."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import materialize, shared_dir

__all__ = ["materialize", "shared_dir"]

WORD = r"[^\x20\x09-\x0D]+"


def new_folder(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """df, which must be materialised, with a broadcast hint if it has max_rows rows at most; else Spark joins by shuffle."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def few(df: DataFrame, amount: int, per: int = 1_000_000) -> DataFrame:
    """df in twice as many partitions as there are cores at most, or more where `amount` (of rows, unless the caller counts
    bytes) would put over `per` into one: each written file of a small table costs a process and buffers of an executor."""
    return df.coalesce(max(2 * df.sparkSession.sparkContext.defaultParallelism, -(-amount // per)))


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


_SEP = np.ones(256, dtype=bool)
_SEP[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
_FNV = np.uint64(0x100000001B3)
_BASIS = np.uint64(0xCBF29CE484222325)


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (Stafford's variant 13)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all blobs, one after the other, and the number of words of each blob."""
    buf = np.frombuffer(b" ".join(blobs) + b" ", dtype=np.uint8)
    inside = _SEP[buf]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], inside)).view(np.int8)))
    if len(edge) % 2:
        edge = np.append(edge, len(buf))
    start, size = edge[0::2], edge[1::2] - edge[0::2]
    h = np.full(len(start), _BASIS, dtype=np.uint64)
    live, j = np.arange(len(start)), 0
    while len(live):
        h[live] = (h[live] ^ buf[start[live] + j]) * _FNV
        j += 1
        live = live[size[live] > j]
    first = np.cumsum([0] + [len(b) + 1 for b in blobs])
    counts = np.diff(np.searchsorted(start, first))
    return mix64(h), counts


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k consecutive word hashes; the caller drops those that cross documents."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    g = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        g = (g + h[j : j + n]) * np.uint64(0x9E3779B97F4A7C15)
        g ^= g >> np.uint64(29)
    return mix64(g)


def slices(sizes: list[int], limit: int):
    """Ranges (i, j) of consecutive items of about limit in all; an item over the limit stands alone."""
    i, total = 0, 0
    for j, n in enumerate(sizes):
        if j > i and total + n > limit:
            yield i, j
            i, total = j, 0
        total += n
    if i < len(sizes):
        yield i, len(sizes)


def small(batches, column: int, limit: int = 4_000_000):
    """The batches in slices of about limit bytes in a string column: bounds what a worker holds as Python objects."""
    for b in batches:
        sizes = pc.fill_null(pc.binary_length(b.column(column)), 0).to_pylist()
        for i, j in slices(sizes, limit):
            yield b.slice(i, j - i)

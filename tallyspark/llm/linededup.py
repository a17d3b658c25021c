"""Operator 7, line dedup (DataFrame functions only): overlapping windows of three consecutive lines.

A window that also starts earlier in the corpus (by id, then text hash, then line number) is a later occurrence; the
lines that later occurrences cover are removed. Windows are judged on the input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

BLANK = r"^[\x20\x09-\x0D]*$"


def _lines(text_col: str) -> Column:
    return F.split(F.col(text_col), "\n", -1)


def _window_rows(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """(a, b, id, th, pos): the hash pair of each window with a word in it, and where it starts."""
    lines = _lines(text_col)
    digests = F.transform(lines, lambda x: F.struct(F.xxhash64(x).alias("p"), F.xxhash64(F.lit(1), x).alias("q"), (~x.rlike(BLANK)).alias("w")))
    t = docs.filter(F.size(lines) >= size).select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), digests.alias("d"))

    def window(i):
        parts = [F.get("d", i + k) for k in range(size)]
        word = parts[0]["w"]
        for p in parts[1:]:
            word = word | p["w"]
        return F.struct(F.xxhash64(*[p["p"] for p in parts]).alias("a"), F.xxhash64(*[p["q"] for p in parts]).alias("b"), i.alias("pos"), word.alias("w"))

    windows = F.transform(F.sequence(F.lit(0), F.size("d") - size), window)
    return t.select("id", "th", F.explode(F.filter(windows, lambda x: x["w"])).alias("x")).select("x.a", "x.b", "id", "th", "x.pos")


def later_positions(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """(id, th, mask): per document with a later occurrence, whether each line goes (lines after the last are not listed).

    The starts of later windows, in order, are merged into one mask: a gap of kept lines, then the lines not yet covered.
    """
    windows = materialize(_window_rows(docs, id_col, text_col, size), "line-windows")
    first = windows.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "th", "pos")).alias("first"))
    again = first.filter(F.col("n") > 1).select("a", "b", "first")
    later = windows.join(again, ["a", "b"]).filter(F.struct("id", "th", "pos") > F.col("first"))
    starts = later.groupBy("id", "th").agg(F.array_sort(F.collect_set("pos")).alias("s"))

    def piece(p, i):
        end = F.when(i == 0, 0).otherwise(F.get("s", i - 1) + size)
        gap, over = F.greatest(p - end, F.lit(0)), F.greatest(end - p, F.lit(0))
        return F.concat(F.array_repeat(F.lit(False), gap), F.array_repeat(F.lit(True), F.lit(size) - over))

    return starts.select("id", "th", F.flatten(F.transform("s", piece)).alias("mask"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3) -> DataFrame:
    """docs with text_col replaced by its kept lines, plus n_lines, n_removed_lines (long).

    Null text stays null with 0 lines; texts of under `size` lines and windows without a word stay whole. Repeated rows
    (one id, one text) count as one place, so the first of a set of repeated rows stays in each of them; rows of one id
    with different texts are ordered by text hash. Null ids come first. Columns named n_lines or n_removed_lines of docs
    are replaced; any others stay. An empty table gives an empty table.
    """
    docs = docs.drop("n_lines", "n_removed_lines")
    drops = later_positions(docs, id_col, text_col, size).select(F.col("id").alias("_id"), F.col("th").alias("_th"), F.col("mask").alias("_mask"))
    t = docs.join(drops, docs[id_col].eqNullSafe(F.col("_id")) & (F.xxhash64(docs[text_col]) == F.col("_th")), "left")
    lines = _lines(text_col)
    kept = F.array_join(F.filter(lines, lambda x, i: ~F.coalesce(F.get("_mask", i), F.lit(False))), "\n")
    removed = F.when(F.col("_mask").isNull(), 0).otherwise(F.size(F.filter("_mask", lambda x: x)))
    t = t.withColumn("n_lines", F.when(F.col(text_col).isNull(), 0).otherwise(F.size(lines)).cast("long")).withColumn("n_removed_lines", removed.cast("long"))
    t = t.withColumn(text_col, F.when(F.col("_mask").isNull(), F.col(text_col)).otherwise(kept))
    return t.select(*docs.columns, "n_lines", "n_removed_lines")


ORACLE = """
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents),
w AS (SELECT doc_id, p AS pos, l[p] AS x, l[p + 1] AS y, l[p + 2] AS z
      FROM (SELECT doc_id, l, unnest(range(1, len(l) - 1)) AS p FROM d)
      WHERE NOT regexp_full_match(l[p] || l[p + 1] || l[p + 2], '[\\x20\\x09-\\x0D]*')),
r AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY x, y, z ORDER BY doc_id, pos) AS k FROM w),
gone AS (SELECT DISTINCT doc_id, pos + i AS pos FROM r, (VALUES (0), (1), (2)) AS o(i) WHERE k > 1),
per AS (SELECT doc_id, list(pos) AS g FROM gone GROUP BY doc_id),
kept AS (SELECT d.doc_id, d.text, len(l) AS n, coalesce(len(g), 0) AS m,
           CASE WHEN g IS NULL THEN d.text ELSE array_to_string(list_transform(list_filter(range(1, len(l) + 1), lambda p: NOT list_contains(g, p)), lambda p: l[p]), chr(10)) END AS t
         FROM d LEFT JOIN per USING (doc_id))
SELECT doc_id, CASE WHEN text IS NULL THEN 0 ELSE n END::BIGINT AS n_lines, m::BIGINT AS n_removed_lines, sha256(t) AS kept_sha256 FROM kept
"""

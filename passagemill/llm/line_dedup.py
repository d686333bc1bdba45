"""Removal of repeated passages by overlapping three-line windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagemill.functions import text as tx
from passagemill.llm.rows import packed, unpacked
from passagemill.session import cut_lineage

WINDOW = 3


def _windows(lines: Column, window: int) -> Column:
    """One struct of two 64-bit hashes per run of ``window`` lines."""

    def hashed(i: Column) -> Column:
        run = F.array_join(F.slice(lines, i + 1, F.lit(window)), "\n")
        return F.struct(F.xxhash64(run).alias("h1"), F.xxhash64(F.lit(window), run).alias("h2"))

    starts = F.sequence(F.lit(0), F.size(lines) - window)
    return F.when(F.size(lines) >= window, F.transform(starts, hashed))


def _covered(starts: Column, window: int) -> Column:
    return F.array_distinct(F.flatten(F.transform(starts, lambda p: F.sequence(p, p + window - 1))))


def dedup_lines(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Every row of ``docs`` with later copies of repeated ``window``-line passages taken out.

    A window's first place is the smallest (doc_id, text hash, line number), null ids last. Lines
    that only later places cover are removed; a line inside some repeated window's first place
    stays, so every passage is left once. ``n_chars`` follows the new text; ``n_lines`` and
    ``n_removed`` are added. No row is dropped: a full copy keeps its row with an empty text.

    Null texts stay null with no lines; texts of fewer than ``window`` lines stay as they are. Rows
    that agree in doc_id and text count as one place and are treated alike. An empty table stays
    empty; of columns named like the results the results stay. A long text is one array of lines in its row.

    Only hashes are shuffled to find repeated windows (sums per hash before the exchange); the
    texts move once, in the last join, by the same plan whatever the number of marks.
    """
    text = F.col("row.text")
    keyed = packed(docs).select(
        "row",
        F.col("row.doc_id").alias("id"),
        F.xxhash64(text).alias("k1"),
        F.xxhash64(F.lit(window), text).alias("k2"),
    )
    windows = cut_lineage(
        keyed.filter(text.isNotNull())
        .select("id", "k1", "k2", F.posexplode(_windows(F.split(text, "\n"), window)).alias("pos", "w"))
        .select("id", "k1", "k2", "pos", "w.h1", "w.h2")
    )
    place = F.struct(F.col("id").isNull().alias("last"), "id", "k1", "k2", "pos")
    repeated = (
        windows.groupBy("h1", "h2")
        .agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
        .select("h1", "h2", "first")
    )
    is_first = place == F.col("first")
    marks = (
        windows.join(repeated, ["h1", "h2"])
        .groupBy("id", "k1", "k2")
        .agg(
            F.collect_set(F.when(~is_first, F.col("pos"))).alias("later"),
            F.collect_set(F.when(is_first, F.col("pos"))).alias("firsts"),
        )
        .select(
            F.col("id").alias("m_id"),
            F.col("k1").alias("m_k1"),
            F.col("k2").alias("m_k2"),
            F.array_except(_covered(F.col("later"), window), _covered(F.col("firsts"), window)).alias("gone"),
        )
        .filter(F.size("gone") > 0)
    )
    marks = cut_lineage(marks)
    lines = F.split(text, "\n")
    left = tx.let(
        lines,
        lambda all_lines: F.array_join(
            F.transform(
                F.array_except(F.sequence(F.lit(0), F.size(all_lines) - 1), F.col("gone")),
                lambda i: F.get(all_lines, i),
            ),
            "\n",
        ),
    )
    joined = keyed.join(
        marks.hint("merge"), F.col("id").eqNullSafe(F.col("m_id")) & (F.col("k1") == F.col("m_k1")) & (F.col("k2") == F.col("m_k2")), "left"
    )
    added = ["text", "n_chars", "n_lines", "n_removed"]
    out = joined.select(
        "row",
        F.when(F.col("gone").isNull(), text).otherwise(left).alias("text"),
        F.when(text.isNull(), 0).otherwise(F.size(lines)).cast("bigint").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("bigint").alias("n_removed"),
    ).withColumn("n_chars", F.length("text").cast("bigint"))
    ordered = unpacked(docs.columns, added)
    return out.select(*ordered)

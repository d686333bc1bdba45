"""A query set against all vectors in blocks, shared by the two vector searches."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROWS_PER_BLOCK = 4_096
QUERIES_PER_BLOCK = 512


def usable(vector: Column, largest: float) -> Column:
    """Not null, not empty, every component a number below ``largest`` in size."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < largest))
    return vector.isNotNull() & (F.size(vector) > 0) & F.coalesce(fine, F.lit(False))


def matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, equal ones by smaller id. Scores may be Python's whole numbers."""
    if scores.dtype == object:
        return np.array(sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i]))[:k], dtype=np.int64)
    if len(scores) > 4 * k:
        bound = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= bound)
        return at[np.lexsort((ids[at], -scores[at]))[:k]]
    return np.lexsort((ids, -scores))[:k]


def distinct(table: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray]:
    """Rows without their repetitions, and how often each occurs."""
    keys = pd.DataFrame({"id": table["vec_id"].to_numpy(), "v": [x.tobytes() for x in table["v"]]})
    copies = np.bincount(keys.groupby(["id", "v"], sort=False).ngroup(), minlength=0)
    return table.loc[~keys.duplicated().to_numpy()], copies


def search_blocks(
    vectors: DataFrame,
    is_query: Column,
    k: int,
    searcher: Callable,
    score_type: str,
    rows_per_block: int = ROWS_PER_BLOCK,
    queries_per_block: int = QUERIES_PER_BLOCK,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k best rows of each query, from per-block results.

    ``vectors`` has ``vec_id, v``. Rows are dealt by hash into blocks of about ``rows_per_block``,
    queries into blocks of ``queries_per_block``, and each pair of blocks is one group: its size is
    fixed, whatever the input. ``searcher(ids, matrix)`` prepares a block and returns a function
    (query ids, query matrix) that yields (places, scores) per query. Vectors of different lengths never meet.
    Equal rows are searched once and stand in the result once per copy; equal queries answer once.
    """
    queries = vectors.filter(is_query)
    n_blocks = max(1, -(-vectors.count() // rows_per_block))
    n_query_blocks = max(1, -(-queries.count() // queries_per_block))

    def dealt(rows: DataFrame, own: str, n: int, other: str, m: int) -> DataFrame:
        return rows.select(
            "vec_id",
            "v",
            F.size("v").alias("width"),
            F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int").alias(own),
            F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias(other),
        )

    keys = ["width", "block", "query_block"]
    left = dealt(vectors, "block", n_blocks, "query_block", n_query_blocks).groupBy(*keys)
    right = dealt(queries, "query_block", n_query_blocks, "block", n_blocks).groupBy(*keys)

    def run(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        columns = ["query_id", "vec_id", "score"]
        if rows.empty or asked.empty:
            return pd.DataFrame({c: [] for c in columns})
        (rows, copies), (asked, _) = distinct(rows), distinct(asked)
        ids = rows["vec_id"].to_numpy()
        find = searcher(ids, matrix(rows["v"]))
        out = []
        query_ids = asked["vec_id"].to_numpy()
        for query_id, (at, scores) in zip(query_ids, find(query_ids, matrix(asked["v"]))):
            keep = best(ids[at], scores, k)
            keep = np.repeat(keep, np.minimum(copies[at][keep], k))[:k]
            out.append((np.full(len(keep), query_id), ids[at][keep], scores[keep]))
        return pd.DataFrame(dict(zip(columns, map(np.concatenate, zip(*out)))) if out else {c: [] for c in columns})

    found = left.cogroup(right).applyInPandas(run, f"query_id long, vec_id long, score {score_type}")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")

"""Exact top-k inner products through vector approximations."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagemill.llm import blocks
from passagemill.llm.hard_negatives import takes_part

CELLS = 64
STEP = 64
#: Scores stay below this in 64-bit arithmetic; beyond it Python's whole numbers take over.
SAFE = 2.0**62


def _whole(rows: np.ndarray) -> np.ndarray:
    return np.array([int(x) for x in rows.ravel()], dtype=object).reshape(rows.shape)


def approximation_searcher(k: int, cells: int = CELLS):
    """A block's quantised cells, and the search that reads exact rows in the order of their bounds."""

    def prepare(ids: np.ndarray, given: np.ndarray):
        rows = given
        sizes = np.abs(rows).max(axis=1, initial=0.0)
        # A few huge rows would leave no resolution to the others: they are always read exactly.
        huge = np.flatnonzero(sizes >= 2.0**28)
        rows = np.where((sizes >= 2.0**28)[:, None], 0.0, rows) if len(huge) else rows
        largest = np.abs(rows).max(initial=1.0) * max(1, rows.shape[1])
        exact = rows.astype(np.int64)
        low = rows.min(axis=0)
        width = np.maximum((rows.max(axis=0) - low) / cells, 1e-9)
        codes = np.minimum((rows - low) / width, cells - 1).astype(np.uint8)
        middles = low + (codes + 0.5) * width
        slack = width * (0.5 + 1e-6)

        def find(query_ids: np.ndarray, queries: np.ndarray):
            for query_id, query in zip(query_ids, queries):
                if np.abs(query).max(initial=0.0) * largest >= SAFE:
                    yield whole(query_id, query, np.flatnonzero(ids != query_id))
                elif len(huge):
                    at, scores = read(query_id, query)
                    more, others = whole(query_id, query, huge[ids[huge] != query_id])
                    yield np.concatenate([at, more]), np.concatenate([scores.astype(object), others])
                else:
                    yield read(query_id, query)

        def whole(query_id: int, query: np.ndarray, at: np.ndarray):
            return at, (_whole(given[at]) * _whole(query)).sum(axis=1) if given.shape[1] else np.zeros(len(at), dtype=np.int64)

        def read(query_id: int, query: np.ndarray):
            numbers = query.astype(np.int64)
            bounds = middles @ query + np.abs(query) @ slack + 1e-6 * (1 + np.abs(query).sum())
            bounds[ids == query_id] = -np.inf
            bounds[huge] = -np.inf
            order = np.argsort(-bounds, kind="stable")
            order = order[: np.isfinite(bounds).sum()]
            at, scores, step = 0, np.empty(0, dtype=np.int64), STEP
            while at < len(order):
                scores = np.concatenate([scores, (exact[order[at : at + step]] * numbers).sum(axis=1)])
                at, step = at + step, step * 2
                if at < len(order) and len(scores) >= k and np.partition(scores, -k)[-k] > bounds[order[at]]:
                    break
            return order[: len(scores)], scores

        return find

    return prepare


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: float = 256.0, cells: int = CELLS) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's k rows of the largest integer inner product, exactly.

    ``vectors`` has ``vec_id`` and ``embedding``; components become floor(scale * x). Within a block
    every component is known by one of ``cells`` cells; its middle and half width bound a row's
    score from above. Exact rows are read in the order of these bounds until the k-th exact score is
    above the next bound, so equal scores are all seen and go by the smaller id. Rows with a null id or
    a vector that is null or holds null or non-finite components take no part; empty vectors score 0. Components of any
    finite size are exact; a returned score that no long holds raises an error. Equal rows count once per copy.
    An empty table gives nothing, other columns are not read.
    """
    v = F.transform("embedding", lambda x: x.cast("double"))
    given = vectors.select("vec_id", v.alias("v")).filter(F.col("vec_id").isNotNull() & takes_part(F.col("v")))
    # As doubles, where whole numbers of any size stay exact. Scaling by a power of two loses nothing.
    down = given.withColumn("v", F.transform("v", lambda x: F.when(F.abs(x) < 2.0**50, F.floor(x * F.lit(scale)).cast("double")).otherwise(x * F.lit(scale))))
    return blocks.search_blocks(down, is_query, k, approximation_searcher(k, cells), "long")

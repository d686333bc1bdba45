"""Approximate nearest neighbours by counting collisions in query-centred windows of single projections."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagemill.llm import blocks

PROJECTIONS = 128
SHARE = 0.7
VERIFIED = 0.1
LEAST_VERIFIED = 10
GROWTH = 1.12
SEED = 20


def collision_searcher(
    scale: float, longest: float, k: int, projections: int = PROJECTIONS, share: float = SHARE, verified: float = VERIFIED, growth: float = GROWTH
):
    """A block's sorted projections and the search over them.

    Vectors are divided by ``scale``, so that squares of any finite components are finite. Rows get one more
    component, sqrt(longest**2 - |x|**2), and queries are scaled to ``longest``:
    the Euclidean order of the lifted vectors is then the order of inner products.
    """

    def prepare(ids: np.ndarray, rows: np.ndarray):
        directions = np.random.default_rng(SEED).standard_normal((rows.shape[1] + 1, projections))
        scaled = rows / scale
        rest = np.sqrt(np.maximum(0.0, longest**2 - (scaled**2).sum(axis=1)))
        values = scaled @ directions[:-1] + np.outer(rest, directions[-1])
        order = np.ascontiguousarray(np.argsort(values, axis=0, kind="stable").T)
        arrays = np.take_along_axis(values.T, order, axis=1)
        # Each row's place in every array, in the least unsigned type: differences below zero wrap to large numbers.
        places = np.empty(order.shape, dtype=np.min_scalar_type(len(ids) + 1))
        np.put_along_axis(places, order, np.arange(len(ids), dtype=places.dtype)[None, :], axis=1)
        behind, inside = np.empty_like(places), np.empty(places.shape, dtype=bool)
        tally = np.min_scalar_type(projections)
        enough, goal = int(np.ceil(share * projections)), min(len(ids), 1 + int(max(LEAST_VERIFIED * k, verified * len(ids))))

        def find(query_ids: np.ndarray, queries: np.ndarray):
            unit = queries / np.abs(queries).max(axis=1, keepdims=True)
            centres = (unit * (longest / np.sqrt((unit**2).sum(axis=1, keepdims=True)))) @ directions[:-1]
            halves, windows = [longest / 16], {}

            def window(level: int):
                """Where the windows of a radius begin and end in each sorted array, for every query."""
                while len(halves) <= level:
                    halves.append(halves[-1] * growth)
                if level not in windows:
                    half = halves[level]
                    first = np.stack([np.searchsorted(a, c - half) for a, c in zip(arrays, centres.T)], axis=1)
                    last = np.stack([np.searchsorted(a, c + half, side="right") for a, c in zip(arrays, centres.T)], axis=1)
                    windows[level] = (first, last)
                return windows[level]

            def collisions(i: int, level: int) -> np.ndarray:
                """In how many windows each row lies: its place in a sorted array, less the window's first, is below the window's length."""
                first, last = (edge[i].astype(places.dtype)[:, None] for edge in window(level))
                np.subtract(places, first, out=behind)
                np.less(behind, last - first, out=inside)
                return np.add.reduce(inside.view(np.uint8), axis=0, dtype=tally)

            def enter(i: int, level: int) -> np.ndarray | None:
                """The rows that collide often enough, if they are as many as asked for."""
                close = collisions(i, level) >= enough
                return close if np.count_nonzero(close) >= goal else None

            start = 0
            for i, query_id in enumerate(query_ids):
                # Virtual rehashing: the same arrays serve every radius. The smallest one that meets the
                # goal is near the one of the query before.
                step, level, met = 1, start, enter(i, start)
                low, high = (-1, level) if met is not None else (level, None)
                while high is None:
                    level, step = low + step, 2 * step
                    low, high, met = (low, level, found) if (found := enter(i, level)) is not None else (level, None, None)
                while high - low > 1:
                    level = max(high - step, (low + high) // 2)
                    found = enter(i, level)
                    low, high, met = (level, high, met) if found is None else (low, level, found)
                    step *= 2
                start = high
                close = np.flatnonzero(met)
                close = close[ids[close] != query_id]
                yield close, np.einsum("ij,j->i", rows[close], queries[i])

        return find

    return prepare


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, **options) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's k rows with the largest inner product.

    ``vectors`` has ``vec_id`` and ``embedding``. Every row is indexed: its block holds one sorted array
    per projection. A query opens a window around its own value in each array and widens all of them
    until enough rows lie in ``SHARE`` of the windows; exactly those are compared, in double precision.
    Rows with a null id or a vector that is null, empty, zero or holds null or non-finite components take
    no part. Rows with the query's id are its own. Equal scores go by the smaller id, and equal rows count once
    per copy. A block with fewer rows than asked for is compared whole. An empty table gives nothing; other
    columns are not read.
    """
    given = vectors.select("vec_id", F.col("embedding").alias("v")).filter(F.col("vec_id").isNotNull())
    given = given.filter(blocks.usable(F.col("v"), float("inf")) & F.exists("v", lambda x: x != 0))
    # Divided by the largest component, squares of any finite number are finite.
    scale = given.agg(F.max(F.array_max(F.transform("v", lambda x: F.abs(x.cast("double")))))).first()[0] or 1.0
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + (x.cast("double") / scale) * (x.cast("double") / scale)))
    longest = given.agg(F.max(norm)).first()[0] or 1.0
    return blocks.search_blocks(given, is_query, k, collision_searcher(scale, longest, k, **options), "double")

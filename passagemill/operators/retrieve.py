"""Exact top-K retrieval and reranking.

Search compares every query with every point, but no pair of rows is ever
formed: each task scores blocks of points against blocks of queries as
matrix products and keeps the best k, so only those reach the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passagemill.functions import vectors as vx
from passagemill.sources.blocks import read_blocks, write_blocks

# Scores are rounded before ranking so equal vectors tie exactly, whatever the block shape.
SCORE_DIGITS = 9
# Queries read at a time, bytes of points held at a time, points of one product and scores held at once.
QUERIES_PER_BLOCK = 1024
POINT_BYTES = 32 << 20
POINTS_PER_PRODUCT = 4096
_CELLS_PER_PRODUCT = 1_000_000

# Rerank settings.
MMR_LAMBDA = 0.7
MMR_FETCH_FACTOR = 3


def _matrix(column, dims: int) -> np.ndarray:
    """List column as a float matrix; rows that are null or of another length become zeros."""
    import pyarrow as pa
    import pyarrow.compute as pc

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = np.asarray(pc.fill_null(pc.list_value_length(column), -1))
    good = lengths == dims
    if dims == 0:
        return np.zeros((len(column), 0))
    if good.all():
        values = column.flatten().to_numpy(zero_copy_only=False)
        return np.nan_to_num(values.astype(np.float64, copy=False)).reshape(len(column), dims)
    out = np.zeros((len(column), dims))
    if good.any():
        picked = column.filter(pa.array(good))
        out[good] = picked.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
    return out


def _by_width(vectors) -> list[tuple[np.ndarray, np.ndarray]]:
    """``(places, matrix)`` of the vectors of each length; null vectors count as empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    lengths = np.asarray(pc.fill_null(pc.list_value_length(vectors), 0))
    out = []
    for width in np.unique(lengths):
        places = np.flatnonzero(lengths == width)
        out.append((places, _matrix(vectors.take(pa.array(places)), int(width))))
    return out


def _closeness(points: np.ndarray, queries: np.ndarray, distance: str) -> np.ndarray:
    """``queries × points`` scores."""
    if distance in ("Cosine", "Dot"):
        raw = queries @ points.T
        if distance == "Dot":
            return raw
        scale = np.outer(np.linalg.norm(queries, axis=1), np.linalg.norm(points, axis=1))
        return np.divide(raw, scale, out=np.zeros_like(raw), where=scale > 0)
    out = np.empty((len(queries), len(points)))
    for i, query in enumerate(queries):
        gap = np.abs(points - query)
        out[i] = np.sqrt((gap * gap).sum(axis=1)) if distance == "Euclid" else gap.sum(axis=1)
    return out


def first_k(keys: np.ndarray, k: int) -> np.ndarray:
    """Mask of the k smallest keys per row; among equal keys the leftmost win."""
    if keys.shape[1] <= k:
        return np.ones(keys.shape, dtype=bool)
    limit = np.partition(keys, k - 1, axis=1)[:, k - 1 : k]
    below = keys < limit
    level = keys == limit
    room = k - below.sum(axis=1, keepdims=True)
    return below | (level & (np.cumsum(level, axis=1) <= room))


class _Held:
    """A block of points in id order, so that the leftmost of equal scores has the smallest id."""

    def __init__(self, table, id_col: str, vector_col: str):
        import pyarrow.compute as pc

        self.order = pc.sort_indices(table, sort_keys=[(id_col, "ascending")]).to_numpy()
        self.table, self.vectors = table, table.column(vector_col)
        self.width = None

    def of_width(self, width: int) -> None:
        """Reads the vectors at this width: as they are, their norms and, in single precision, at unit length."""
        if width != self.width:
            self.points = _matrix(self.vectors, width)[self.order]
            self.norms = np.linalg.norm(self.points, axis=1)
            self.unit = _unit(self.points, self.norms)
            self.width = width

    def take(self, column: str, places: np.ndarray):
        import pyarrow as pa

        return self.table.column(column).take(pa.array(self.order[places])).combine_chunks()


def _unit(vectors: np.ndarray, norms: np.ndarray) -> np.ndarray | None:
    """Unit vectors in single precision; None where a norm is too large or small for them."""
    if not ((norms == 0) | ((norms > 1e-100) & (norms < 1e100))).all():
        return None
    out = np.empty(vectors.shape, dtype=np.float32)
    return np.divide(vectors, np.where(norms == 0, 1.0, norms)[:, None], out=out, casting="same_kind")


def _all_scores(queries: np.ndarray, points: np.ndarray, distance: str, k: int) -> tuple:
    """``query, place, score`` of the k closest points per query, from the scores of all pairs, some at a time."""
    found = []
    rows = max(1, _CELLS_PER_PRODUCT // max(len(points), 1))
    for start in range(0, len(queries), rows):
        scores = np.round(_closeness(points, queries[start : start + rows], distance), SCORE_DIGITS)
        q, p = np.nonzero(first_k(-scores if vx.HIGHER_IS_CLOSER[distance] else scores, k))
        found.append((q + start, p, scores[q, p]))
    return tuple(np.concatenate(c) for c in zip(*found))


def _near(queries, norms, unit, held: _Held, start: int, end: int, low: np.ndarray, k: int) -> tuple | None:
    """Exact scores of all points from ``start`` to ``end`` that may be among a query's k most similar ones and above ``low``.

    Products in single precision pick the points; None where these are too many to be scored one by one.
    """
    rough = unit @ held.unit[start:end].T
    margin = (held.width + 4) * 1.2e-7 + 10.0**-SCORE_DIGITS
    low = low - margin
    fresh = np.flatnonzero(np.isneginf(low))
    if len(fresh) and end - start > k:
        low[fresh] = np.partition(rough[fresh], -k, axis=1)[:, -k] - 2 * margin
    wanted = rough >= low.astype(np.float32)[:, None] - np.float32(1e-7)
    if np.count_nonzero(wanted) > len(queries) * k * 8 + 10_000:
        return None
    q, p = np.nonzero(wanted)
    p += start
    scale = norms[q] * held.norms[p]
    raw = np.einsum("ij,ij->i", queries[q], held.points[p])
    return q, p, np.round(np.divide(raw, scale, out=np.zeros_like(raw), where=scale > 0), SCORE_DIGITS)


def _best(held: _Held, queries: np.ndarray, distance: str, k: int, floor: np.ndarray) -> tuple:
    """``query, place, score`` of the k closest points of a block per query.

    For Cosine, scores below ``floor`` are left out, and it is raised to the k-th best score of each query.
    """
    held.of_width(queries.shape[1])
    norms = np.linalg.norm(queries, axis=1)
    unit = _unit(queries, norms) if distance == "Cosine" and held.unit is not None else None
    sign = -1 if vx.HIGHER_IS_CLOSER[distance] else 1
    best = (np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), np.empty(0))
    for start in range(0, len(held.points), POINTS_PER_PRODUCT):
        end = min(start + POINTS_PER_PRODUCT, len(held.points))
        found = None if unit is None else _near(queries, norms, unit, held, start, end, floor, k)
        if found is None:
            q, p, score = _all_scores(queries, held.points[start:end], distance, k)
            found = q, p + start, score
        q, p, score = (np.concatenate(c) for c in zip(best, found))
        order = np.lexsort((p, sign * score, q))
        q, p, score = q[order], p[order], score[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q, side="left")
        best = tuple(c[rank < k] for c in (q, p, score))
        if distance == "Cosine":
            last = rank == k - 1
            floor[q[last]] = np.fmax(floor[q[last]], score[last])
    return best


def top_k(
    points: DataFrame,
    queries: DataFrame,
    k: int,
    distance: str = "Cosine",
    *,
    id_col: str = "chunk_id",
    vector_col: str = "vector",
    query_id: str = "query_id",
    query_vector: str = "query_vector",
    carry: Sequence[str] = (),
    queries_per_block: int = QUERIES_PER_BLOCK,
    point_bytes: int = POINT_BYTES,
) -> DataFrame:
    """The k closest points per query: ``query_id, <id>, score, rank`` and the carried columns.

    Cosine and Dot rank high scores first, the distances low ones; ties go to the
    smaller id. Every query meets the points at its own length; points of another length
    count as zero vectors, a null query as an empty one.

    One plan for every size: the queries are written to the shared folder once, and each task
    streams them past the points it has read, ``queries_per_block`` against ``point_bytes`` at a time, so
    neither side is sent, shuffled or counted. Of each pair of blocks only the k best per query go on. For Cosine
    products in single precision find the points whose exact scores are worth computing.
    Search a written points table rather than a plan that still has to embed.
    """
    distance = vx.distance_name(distance)
    carry = list(carry)
    queries = queries.select(query_id, query_vector)
    points = points.select(id_col, vector_col, *[c for c in carry if c != vector_col])
    fields = {f.name: f for f in points.schema.fields}
    schema = T.StructType(
        [
            queries.schema[query_id],
            fields[id_col],
            T.StructField("score", T.DoubleType()),
            *[fields[c] for c in carry],
        ]
    )
    names = schema.names
    address = write_blocks(queries)

    def best(held: list, floors: dict) -> Iterator:
        import pyarrow as pa

        block = _Held(pa.Table.from_batches(held), id_col, vector_col)
        for number, asked in enumerate(read_blocks(address, queries_per_block)):
            ids, vectors = (asked.column(c).combine_chunks() for c in (query_id, query_vector))
            floor = floors.setdefault(number, np.full(len(ids), -np.inf))
            for places, matrix in _by_width(vectors):
                raised = floor[places]
                q, p, score = _best(block, matrix, distance, k, raised)
                floor[places] = raised
                taken = [ids.take(pa.array(places[q])), block.take(id_col, p), pa.array(score), *(block.take(c, p) for c in carry)]
                yield from pa.Table.from_arrays(taken, names=names).to_batches()

    def scan(batches: Iterator) -> Iterator:
        held, size, floors = [], 0, {}
        for batch in batches:
            if len(batch):
                held.append(batch)
                size += batch.nbytes
            if size >= point_bytes:
                yield from best(held, floors)
                held, size = [], 0
        if held:
            yield from best(held, floors)

    local = points.mapInArrow(scan, schema)
    towards = F.desc("score") if vx.HIGHER_IS_CLOSER[distance] else F.asc("score")
    window = Window.partitionBy(query_id).orderBy(towards, F.asc(id_col))
    return local.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= k)


def mmr_rerank(
    ranked: DataFrame,
    k: int,
    lam: float = MMR_LAMBDA,
    *,
    id_col: str = "chunk_id",
    vector_col: str = "vector",
    query_id: str = "query_id",
) -> DataFrame:
    """Greedy diversity rerank of ranked candidates to k rows per query.

    Picks the highest ``lam · score − (1 − lam) · max(0, closest already picked)``;
    ties go to the earlier candidate. Lists of at most k stay as they are. A list
    has the fetch size (3 k in the search strategy), so it is one bounded row.
    """
    @F.pandas_udf("array<int>")
    def pick(scores: pd.Series, vectors: pd.Series) -> pd.Series:
        return pd.Series([_greedy(np.asarray(s, dtype=float), v, k, lam) for s, v in zip(scores, vectors)])

    rest = [c for c in ranked.columns if c not in (query_id, "rank")]
    lists = ranked.groupBy(query_id).agg(
        F.array_sort(F.collect_list(F.struct("rank", *rest))).alias("cands")
    )
    picked = lists.withColumn("picks", pick(F.col("cands.score"), F.col(f"cands.{vector_col}")))
    return picked.select(
        query_id, "cands", F.posexplode("picks").alias("_at", "_pick")
    ).select(
        query_id,
        (F.col("_at") + 1).alias("rank"),
        *[F.get("cands", F.col("_pick"))[c].alias(c) for c in rest],
    )


def _greedy(scores: np.ndarray, vectors, k: int, lam: float) -> list[int]:
    n = len(scores)
    if n <= k or k <= 0:
        return list(range(n))
    matrix = np.vstack([np.asarray(v, dtype=float) for v in vectors])
    norms = np.linalg.norm(matrix, axis=1)
    unit = matrix / np.where(norms == 0, 1.0, norms)[:, None]
    nearest = np.zeros(n)
    open_ = np.ones(n, dtype=bool)
    picks: list[int] = []
    while len(picks) < k:
        value = np.where(open_, np.round(lam * scores - (1 - lam) * nearest, 12), -np.inf)
        best = int(np.argmax(value))
        picks.append(best)
        open_[best] = False
        nearest = np.maximum(nearest, unit @ unit[best])
    return picks


def mmr_search(points: DataFrame, queries: DataFrame, k: int, lam: float = MMR_LAMBDA, **kw) -> DataFrame:
    """Fetch three times k by cosine, then :func:`mmr_rerank`."""
    vector_col = kw.get("vector_col", "vector")
    carry = list(dict.fromkeys([*kw.pop("carry", ()), vector_col]))
    found = top_k(points, queries, k * MMR_FETCH_FACTOR, "Cosine", carry=carry, **kw)
    return mmr_rerank(
        found, k, lam, id_col=kw.get("id_col", "chunk_id"), vector_col=vector_col,
        query_id=kw.get("query_id", "query_id"),
    )


def candidate_similarity(
    ranked: DataFrame, *, id_col: str = "chunk_id", vector_col: str = "vector", query_id: str = "query_id"
) -> DataFrame:
    """Cosine of every two candidates of a query (``rank_a < rank_b``); lists are of fetch size."""
    entry = F.struct(F.col("rank"), F.col(id_col).alias("id"), F.col(vector_col).alias("vector"))
    lists = ranked.groupBy(query_id).agg(F.array_sort(F.collect_list(entry)).alias("c"))
    pairs = F.flatten(
        F.transform(
            "c",
            lambda a: F.transform(
                F.filter("c", lambda b: b["rank"] > a["rank"]),
                lambda b: F.struct(
                    a["rank"].alias("rank_a"),
                    b["rank"].alias("rank_b"),
                    a["id"].alias("id_a"),
                    b["id"].alias("id_b"),
                    vx.cosine(a["vector"], b["vector"]).alias("similarity"),
                ),
            ),
        )
    )
    return lists.select(query_id, F.inline(pairs))


def sources(ranked: DataFrame, query_id: str = "query_id") -> DataFrame:
    """Per result: path, score and the page address from its metadata."""
    return ranked.select(
        query_id, "rank", "document_path", "score", F.element_at("metadata", "source_url").alias("source_url")
    )


def assemble_context(ranked: DataFrame, style: str = "evaluation", query_id: str = "query_id") -> DataFrame:
    """One text per query from its ranked chunks, labelled by page address or else path."""
    # The two layouts.
    lead, gap = {
        "evaluation": ("\nContent:\n", "\n\n---\n\n"),
        "chat": ("\n", "\n\n"),
    }[style]
    url = F.element_at("metadata", "source_url")
    label = F.coalesce(F.when(url != "", url), F.col("document_path"))
    part = F.concat(F.lit("Document: "), label, F.lit(lead), F.col("content"))
    parts = F.array_sort(F.collect_list(F.struct("rank", part.alias("text"))))
    return ranked.groupBy(query_id).agg(
        F.array_join(F.transform(parts, lambda p: p["text"]), gap).alias("context")
    )

"""Hard negatives by Four-Russians scoring: table lookups and shifts in place of products.

Vectors become whole numbers. An anchor's components are cut into groups of eight, and for every
group all 256 subset sums are written down once. A candidate's components are written in two's
complement and read plane by plane: the bits that eight components have at one place are one byte,
and that byte looks up what these components add to the score at that place. Planes are shifted
and added, the sign plane is subtracted, so every score is exact.

Anchors are a stated query set: rows and anchors are dealt into blocks of fixed size, and each pair
of blocks is scored in one task. One pass finds an anchor's positives, a second one the rows of
other labels in the window below each positive.

Results by case. Rows with a null id, label or vector or with a null or non-finite component take no
part; empty vectors do, with score 0, and vectors of different lengths never meet. Equal rows are
counted once per copy, as positives and as negatives; rows with the anchor's own id are never its
candidates; equal anchors answer once. Ties go to the smaller id. Components of any finite size are
exact, beyond 62 bits with Python's whole numbers; a returned score that no long holds raises an error.
An anchor without positives, or a window without rows, gives no rows; an empty table gives none.
Other columns are not read, whatever their names.
"""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passagemill.session import cut_lineage

GROUP = 8
ROWS_PER_BLOCK = 8_192
ANCHORS_PER_BLOCK = 16_384
#: Anchors scored at a time: their tables stay in a core's cache.
STRIP = 256
_SCALE = 256


def takes_part(vector: Column) -> Column:
    """Not null and every component a finite number."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite, F.lit(False))


def whole(column: pd.Series) -> np.ndarray:
    """``rows x components`` of floor(256 * x); Python integers where 62 bits are too few."""
    values = np.stack(column.to_numpy()).astype(np.float64)
    if values.size == 0 or np.abs(values).max() < 2.0**53:
        return np.floor(values * _SCALE).astype(np.int64)
    exact = [math.floor(Fraction(float(x)) * _SCALE) for x in values.ravel()]
    return np.array(exact, dtype=object).reshape(values.shape)


def _grouped(numbers: np.ndarray) -> np.ndarray:
    """``groups x rows x 8``, the last group filled up with zeros."""
    rows, width = numbers.shape
    groups = -(-width // GROUP)
    full = np.zeros((rows, groups * GROUP), dtype=numbers.dtype)
    full[:, :width] = numbers
    return full.reshape(rows, groups, GROUP).transpose(1, 0, 2)


def bit_planes(numbers: np.ndarray) -> np.ndarray:
    """``planes x groups x rows`` bytes of two's complement, the lowest plane first, the sign plane last."""
    largest = max((abs(int(x)) for x in (numbers.min(), numbers.max())), default=0) if numbers.size else 0
    grouped = _grouped(numbers)
    planes = [((grouped >> place) & 1).astype(np.uint8) for place in range(largest.bit_length() + 1)]
    return np.stack([np.packbits(bits, axis=2, bitorder="little")[:, :, 0] for bits in planes])


def subset_sums(anchors: np.ndarray) -> np.ndarray:
    """``groups x 256 x anchors``: at a byte, the sum of the components whose bits it has."""
    grouped = _grouped(anchors)
    sums = np.zeros((len(grouped), 1 << GROUP, len(anchors)), dtype=anchors.dtype)
    for j in range(GROUP):
        half = 1 << j
        sums[:, half : 2 * half] = sums[:, :half] + grouped[:, None, :, j]
    return sums


def lookup_scores(sums: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """``rows x anchors`` scores from lookups alone, from the sign plane down."""
    total = None
    for plane in planes[::-1]:
        level = np.zeros((planes.shape[2], sums.shape[2]), dtype=sums.dtype)
        for table, byte in zip(sums, plane):
            level += table[byte]
        total = -level if total is None else (total << 1) + level
    return total


def _narrowest(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The anchors in the smallest kind of number that holds every score and every partial sum."""
    largest = [max((abs(int(x)) for x in (m.min(), m.max())), default=0) if m.size else 0 for m in (anchors, rows)]
    bits = (2 * largest[0] * (largest[1] + 1) * max(1, anchors.shape[1])).bit_length()
    return anchors.astype(np.int32 if bits < 31 else np.int64 if bits < 63 else object)


def _ranked(ids: np.ndarray, scores: np.ndarray) -> np.ndarray:
    """Places by falling score, equal ones by id."""
    if scores.dtype == object:
        return np.array(sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i])), dtype=np.int64)
    return np.lexsort((ids, -scores))


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    if len(scores) > 4 * k:
        bound = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= bound)
        return at[_ranked(ids[at], scores[at])[:k]]
    return _ranked(ids, scores)[:k]


def _copied(at: np.ndarray, copies: np.ndarray, k: int) -> np.ndarray:
    """The first k rows when every place stands for its copies."""
    return np.repeat(at, np.minimum(copies[at], k))[:k]


def _positives_of(k: int):
    """For a pair of blocks: each anchor's k best rows of its label."""

    def run(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        found = []
        by_label = dict(iter(rows.groupby("label", sort=False)))
        for label, anchors in asked.groupby("label", sort=False):
            same = by_label.get(label)
            if same is None:
                continue
            ids, copies, numbers = same["vec_id"].to_numpy(), same["copies"].to_numpy(), whole(same["v"])
            planes = bit_planes(numbers)
            for start in range(0, len(anchors), STRIP):
                strip = anchors.iloc[start : start + STRIP]
                scores = lookup_scores(subset_sums(_narrowest(whole(strip["v"]), numbers)), planes)
                for j, (anchor, key) in enumerate(zip(strip["vec_id"], strip["anchor_key"])):
                    others = np.flatnonzero(ids != anchor)
                    at = _copied(others[_best(ids[others], scores[others, j], k)], copies, k)
                    found.append((anchor, key, ids[at], scores[at, j]))
        return _table(found, ["anchor_id", "anchor_key"], ["positive_id", "positive_score"])

    return run


def _negatives_of(k: int, low: int, high: int):
    """For a pair of blocks and each positive of an anchor: the k best rows of other labels in its window."""

    def run(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(rows) and len(asked):
            ids, copies, numbers = rows["vec_id"].to_numpy(), rows["copies"].to_numpy(), whole(rows["v"])
            labels, planes = rows["label"].to_numpy(), bit_planes(numbers)
            for start in range(0, len(asked), STRIP):
                strip = asked.iloc[start : start + STRIP]
                scores = lookup_scores(subset_sums(_narrowest(whole(strip["v"]), numbers)), planes)
                each = zip(*(strip[n] for n in ("vec_id", "anchor_key", "label", "places", "positive_ids", "positive_scores")))
                for j, (anchor, key, label, *lists) in enumerate(each):
                    positives = list(zip(*([int(x) for x in values] for values in lists)))
                    # low * positive <= 100 * negative <= high * positive, in whole numbers
                    windows = [(-(-low * p[2] // 100), high * p[2] // 100, p) for p in positives]
                    floor, ceiling = min(w[0] for w in windows), max(w[1] for w in windows)
                    mine = scores[:, j]
                    inside = np.flatnonzero((mine >= floor) & (mine <= ceiling) & (labels != label) & (ids != anchor))
                    inside = inside[_ranked(ids[inside], mine[inside])]
                    falling = mine[inside]
                    for least, most, p in windows:
                        first = np.searchsorted(-falling, -most)
                        at = _copied(inside[first : first + k][falling[first : first + k] >= least], copies, k)
                        found.append((anchor, key, *p, ids[at], mine[at]))
        return _table(found, ["anchor_id", "anchor_key", "place", "positive_id", "positive_score"], ["negative_id", "negative_score"])

    return run


def _table(found: list[tuple], single: list[str], several: list[str]) -> pd.DataFrame:
    """One row per entry of the last two fields of every tuple."""
    found = [f for f in found if len(f[-1])]
    columns = {name: [f[i] for f in found for _ in f[-1]] for i, name in enumerate(single)}
    columns |= {name: [int(x) for f in found for x in f[len(single) + i]] for i, name in enumerate(several)}
    return pd.DataFrame(columns)


def _block_pairs(rows: DataFrame, anchors: DataFrame, n_blocks: int, n_anchor_blocks: int, run, schema: str) -> DataFrame:
    """``run`` on every pair of a block of rows and a block of anchors of equal vector length."""

    def dealt(table: DataFrame, own: str, n: int, other: str, m: int) -> DataFrame:
        # Fresh names: both sides may come from one table.
        return table.select(
            *[F.col(c).alias(c) for c in table.columns],
            F.size("v").alias("width"),
            F.pmod(F.xxhash64("vec_id", "label", "v"), F.lit(n)).cast("int").alias(own),
            F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias(other),
        )

    keys = ["width", "block", "anchor_block"]
    left = dealt(rows, "block", n_blocks, "anchor_block", n_anchor_blocks).groupBy(*keys)
    right = dealt(anchors, "anchor_block", n_anchor_blocks, "block", n_blocks).groupBy(*keys)
    return left.cogroup(right).applyInPandas(run, schema)


def mine_negatives(
    vectors: DataFrame,
    is_anchor: Column,
    positives: int = 5,
    negatives: int = 3,
    low: int = 50,
    high: int = 95,
    rows_per_block: int = ROWS_PER_BLOCK,
    anchors_per_block: int = ANCHORS_PER_BLOCK,
) -> DataFrame:
    """Rows of other labels that score nearly as well as an anchor's positives.

    ``vectors`` has ``vec_id, label, v``. Per anchor and positive (its ``positives`` best other rows of
    the same label) the ``negatives`` best rows of another label whose score lies between ``low`` and ``high``
    hundredths of the positive's: ``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.
    """
    usable = vectors.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & takes_part(F.col("v")))
    # Copies of a row are counted before the shuffle; the table is read four times and so written once.
    rows = cut_lineage(
        usable.groupBy("vec_id", "label", "v").agg(F.count("*").alias("copies"), F.first(is_anchor).alias("is_anchor"))
    )
    anchors = rows.filter("is_anchor").select("vec_id", "label", "v", F.xxhash64("label", "v").alias("anchor_key"))
    sizes = rows.agg(F.count("*").alias("n"), F.count_if("is_anchor").alias("a")).first()
    n_blocks, n_anchor_blocks = max(1, -(-sizes["n"] // rows_per_block)), max(1, -(-sizes["a"] // anchors_per_block))
    rows = rows.select("vec_id", "label", "v", "copies")

    met = _block_pairs(
        rows, anchors, n_blocks, n_anchor_blocks, _positives_of(positives),
        "anchor_id long, anchor_key long, positive_id long, positive_score long",
    )
    order = Window.partitionBy("anchor_id", "anchor_key").orderBy(F.col("positive_score").desc(), "positive_id")
    first = met.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= positives)
    listed = first.groupBy(F.col("anchor_id").alias("vec_id"), "anchor_key").agg(
        F.collect_list(F.struct("place", "positive_id", "positive_score")).alias("p")
    )
    asked = anchors.join(listed, ["vec_id", "anchor_key"]).select(
        "vec_id", "label", "v", "anchor_key", F.col("p.place").alias("places"),
        F.col("p.positive_id").alias("positive_ids"), F.col("p.positive_score").alias("positive_scores"),
    )

    near = _block_pairs(
        rows, asked, n_blocks, n_anchor_blocks, _negatives_of(negatives, low, high),
        "anchor_id long, anchor_key long, place int, positive_id long, positive_score long, negative_id long, negative_score long",
    )
    order = Window.partitionBy("anchor_id", "anchor_key", "place").orderBy(F.col("negative_score").desc(), "negative_id")
    ranked = near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")

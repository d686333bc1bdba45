"""Vector expressions for row-wise scoring (retrieval over a whole table is in operators.retrieve)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DISTANCES = ("Cosine", "Euclid", "Dot", "Manhattan")
HIGHER_IS_CLOSER = {"Cosine": True, "Euclid": False, "Dot": True, "Manhattan": False}


def distance_name(name: str) -> str:
    """Unknown names mean Cosine."""
    return name if name in DISTANCES else "Cosine"


def _fold(a: Column, b: Column, term) -> Column:
    pairs = F.zip_with(a.cast("array<double>"), b.cast("array<double>"), term)
    return F.aggregate(pairs, F.lit(0.0), lambda total, x: total + x)


def dot(a: Column, b: Column) -> Column:
    return _fold(a, b, lambda x, y: x * y)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 for empty vectors, unequal lengths and zero norms."""
    scale = norm(a) * norm(b)
    usable = (F.size(a) > 0) & (F.size(a) == F.size(b)) & (scale > 0)
    return F.coalesce(F.when(usable, dot(a, b) / scale), F.lit(0.0))


def euclid(a: Column, b: Column) -> Column:
    return F.sqrt(_fold(a, b, lambda x, y: (x - y) * (x - y)))


def manhattan(a: Column, b: Column) -> Column:
    return _fold(a, b, lambda x, y: F.abs(x - y))


def score(a: Column, b: Column, distance: str = "Cosine") -> Column:
    chosen = {"Cosine": cosine, "Euclid": euclid, "Dot": dot, "Manhattan": manhattan}
    return chosen[distance_name(distance)](a, b)


def to_float32(vector: Column) -> Column:
    return vector.cast("array<float>")

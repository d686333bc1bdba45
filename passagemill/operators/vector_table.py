"""The vector table: points, upserts, collections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passagemill.functions import ids
from passagemill.functions import vectors as vx

# Payload names with columns of their own.
RESERVED_KEYS = ("content", "document_path", "token_count", "chunk_index", "model")


def to_points(embedded: DataFrame) -> DataFrame:
    """Embedded chunks as points: deterministic id, 32-bit vector, payload columns and metadata.

    A metadata key that equals a payload column stays in the metadata map and
    never overwrites the column.
    """
    return embedded.select(
        ids.uuid5_dns(F.col("chunk_id")).alias("point_id"),
        "chunk_id",
        vx.to_float32(F.col("vector")).alias("vector"),
        "document_path",
        "content",
        "token_count",
        "chunk_index",
        "model",
        "metadata",
    )


def split_payload(payload_col: str = "payload"):
    """``(columns, metadata)`` expressions of a flat payload map."""
    payload = F.col(payload_col)
    columns = [
        F.element_at(payload, key).cast("bigint" if key in ("token_count", "chunk_index") else "string").alias(key)
        for key in RESERVED_KEYS
    ]
    metadata = F.map_filter(payload, lambda k, _: ~k.isin(*RESERVED_KEYS)).alias("metadata")
    return columns, metadata


def latest(versions: DataFrame, key: str, *order) -> DataFrame:
    """Last version per key.

    The rank filter becomes a per-partition limit before the shuffle, so a key
    with very many versions sends one row per partition.
    """
    window = Window.partitionBy(key).orderBy(*order)
    return versions.withColumn("_rank", F.row_number().over(window)).filter("_rank = 1").drop("_rank")


def upsert(existing: DataFrame, incoming: DataFrame, key: str = "point_id", seq: str | None = None) -> DataFrame:
    """Existing points overwritten by incoming ones; within ``incoming`` the highest ``seq`` wins."""
    if seq is not None:
        incoming = latest(incoming, key, F.col(seq).desc()).drop(seq)
    kept = existing.join(incoming.select(key), key, "left_anti")
    return kept.unionByName(incoming, allowMissingColumns=True)


def replace_documents(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Upsert that also removes points of re-indexed documents that no longer exist."""
    redone = incoming.select("document_path").distinct()
    return existing.join(redone, "document_path", "left_anti").unionByName(incoming, allowMissingColumns=True)


def payload_digest(table: DataFrame) -> Column:
    """Digest of what a point is made of: its text and payload, not its vector."""
    names = [c for c in ("content", "token_count", "chunk_index", "model") if c in table.columns]
    parts = [F.col(c) for c in names]
    if "metadata" in table.columns:
        parts.append(F.array_sort(F.map_entries(F.coalesce("metadata", F.create_map().cast("map<string,string>")))).alias("metadata"))
    return F.sha2(F.to_json(F.struct(*parts)), 256)


def chunk_changes(arriving: DataFrame, stored: DataFrame | None, model: str, paths: DataFrame | None = None) -> DataFrame:
    """``chunk_id, point_id, change`` of all chunks that arrive or are stored for the arriving documents.

    ``change`` is new, changed, same or gone. ``stored`` holds the points of the documents that arrive, or, where
    their ``paths`` (``document_path``) are given, of any documents; only digests and ids are joined, texts stay where they are.
    """
    named = arriving.withColumn("model", F.lit(model))
    now = named.select("chunk_id", F.unhex(payload_digest(named)).alias("_now"))
    if stored is None:
        return now.select("chunk_id", ids.uuid5_dns(F.col("chunk_id")).alias("point_id"), F.lit("new").alias("change"))
    held = stored.select(F.col("chunk_id").alias("_id"), F.unhex(payload_digest(stored)).alias("_before"), "document_path")
    if paths is not None:
        # An inner join: a semi join would be moved below the digests, to the texts.
        held = held.join(paths.distinct(), "document_path")
    before = held.select("_id", "_before")
    change = (
        F.when(F.col("_id").isNull(), "new")
        .when(F.col("chunk_id").isNull(), "gone")
        .when(F.col("_now") == F.col("_before"), "same")
        .otherwise("changed")
    )
    both = now.join(before, F.col("chunk_id") == F.col("_id"), "full_outer")
    chunk_id = F.coalesce("chunk_id", "_id")
    return both.select(chunk_id.alias("chunk_id"), ids.uuid5_dns(chunk_id).alias("point_id"), change.alias("change"))


def collection_check(points: DataFrame, declared_size: int, key: str = "collection") -> DataFrame:
    """Per collection: vector count, sizes seen, whether all equal the declared size."""
    size = F.size("vector")
    return (
        points.groupBy(key)
        .agg(F.count("*").alias("vector_count"), F.min(size).alias("min_size"), F.max(size).alias("max_size"))
        .withColumn("declared_size", F.lit(declared_size))
        .withColumn(
            "consistent",
            (F.col("min_size") == F.col("declared_size")) & (F.col("max_size") == F.col("declared_size")),
        )
    )


def collections(points: DataFrame, key: str = "collection", distance: str = "Cosine") -> DataFrame:
    """Catalogue: ``name, vector_count, vector_size, distance``."""
    return points.groupBy(F.col(key).alias("name")).agg(
        F.count("*").alias("vector_count"),
        F.max(F.size("vector")).alias("vector_size"),
        F.lit(vx.distance_name(distance)).alias("distance"),
    )


def delete_collections(points: DataFrame, names: DataFrame, key: str = "collection") -> DataFrame:
    """Points outside the collections listed in ``names`` (column ``name``)."""
    return points.join(names.select(F.col("name").alias(key)), key, "left_anti")

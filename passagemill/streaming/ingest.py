"""Incremental indexing of arriving documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from passagemill.operators import embed
from passagemill.operators import vector_table as vt
from passagemill.plans.index_job import NUMBERING, plan_index
from passagemill.session import cut_lineage
from passagemill.sources.tables import read_points, write_points


def index_stream(
    documents: DataFrame,
    table: str,
    collection: str,
    embedder: embed.Embedder,
    model: str,
    checkpoint: str,
    prepare: Callable[[DataFrame], DataFrame] | None = None,
    trigger: dict | None = None,
    changed_only: bool = False,
    **index_options,
) -> StreamingQuery:
    """Index each micro-batch of ``(path, content)`` documents and replace their points.

    A batch is known by the stream's id, which its checkpoint holds, and its number: it writes a version of its
    own, and replayed after a failure or after compaction it changes nothing. Neither bulk writes nor
    other streams take its place. Chunks that a document no longer has go. A batch costs what it brings, not what the collection holds.
    With ``changed_only`` the digests of a batch's chunks are compared with those stored for its documents, and only new
    and changed chunks are embedded and written; it reads the stored points of these documents.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        docs = prepare(batch) if prepare else batch
        paths = docs.select(F.col("path").alias("document_path"))
        known = {"writer": _stream_id(spark, checkpoint), "seq": batch_id, "unique": _unique(docs, index_options.get("chunker", "fixed"))}
        if not changed_only:
            plan = plan_index(docs, embedder, model, **index_options)
            write_points(plan.points, table, collection, replaces=paths, **known)
            return
        stored = read_points(spark, table, collection)
        changes = {}

        def differing(chunks: DataFrame) -> DataFrame:
            changes["all"] = cut_lineage(vt.chunk_changes(chunks, stored, model, paths).filter("change <> 'same'"))
            return chunks.join(changes["all"].filter("change <> 'gone'").select("chunk_id"), "chunk_id", "left_semi")

        plan = plan_index(docs, embedder, model, only=differing, **index_options)
        write_points(plan.points, table, collection, removed=changes["all"].filter("change = 'gone'").select("point_id"), **known)

    return (
        documents.writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def _unique(docs: DataFrame, chunker: str) -> bool:
    """Whether all chunks get ids of their own: paths do not repeat, and the chunker numbers a path's chunks."""
    return chunker in NUMBERING and docs.groupBy("path").count().filter("count > 1").isEmpty()


def _stream_id(spark: SparkSession, checkpoint: str) -> str:
    """A stream's own id, which stays with its checkpoint and is new with a new one."""
    return spark.read.schema("id string").json(f"{checkpoint.rstrip('/')}/metadata").first()["id"]

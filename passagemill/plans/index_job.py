"""Clean corpus to vector points, with a ledger of what was left out."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagemill.functions import text as tx
from passagemill.operators import embed, vector_table
from passagemill.operators.passages import sieve
from passagemill.plans.registry import CHUNKERS, PARSERS
from passagemill.session import cut_lineage
from passagemill.sources.corpus import index_candidates

#: Chunkers that number a path's chunks, so that their ids are their own where paths do not repeat.
NUMBERING = ("fixed", "recursive")


@dataclass
class IndexPlan:
    chunks: DataFrame
    points: DataFrame
    ledger: DataFrame

    def summary(self) -> DataFrame:
        """``documents, chunks, skipped`` of the job."""
        indexed = self.chunks.agg(
            F.count_distinct("document_path").alias("documents"), F.count("*").alias("chunks")
        )
        skipped = self.ledger.agg(F.count("*").alias("skipped"))
        stacked = indexed.unionByName(skipped, allowMissingColumns=True)
        return stacked.agg(*[F.max(c).alias(c) for c in ("documents", "chunks", "skipped")])


def plan_index(
    docs: DataFrame,
    embedder: embed.Embedder,
    model: str,
    parser: str = "markdown",
    chunker: str = "fixed",
    chunk_config: dict | None = None,
    batch_size: int = 256,
    max_bytes: int | None = None,
    spread: int | None = None,
    only: Callable[[DataFrame], DataFrame] | None = None,
    distinct: bool = False,
) -> IndexPlan:
    """Lazy plan of an index job over ``(path, content)``.

    ``spread`` repartitions chunks before embedding, for corpora where a few huge
    documents would otherwise feed the embedder from a few tasks. ``only`` picks the chunks to embed.
    With ``distinct`` no two points share an id: one of them stays. Paths are counted for this at once, and chunkers that number a path's
    chunks make points anew only where it repeats, so those of all other documents stay where they are made.
    """
    sized = docs if "size" in docs.columns else docs.withColumn("size", tx.byte_size(F.col("content")))
    scanned = index_candidates(sized, max_bytes)
    usable = scanned.filter("skip_reason is null")

    def chunked(part: DataFrame) -> DataFrame:
        return CHUNKERS.run(chunker, PARSERS.get(parser)(part), config={} if chunk_config is None else chunk_config)

    def embedded(wanted: DataFrame) -> DataFrame:
        source = wanted.repartition(spread) if spread else wanted
        return vector_table.to_points(embed.embed_with(source, embedder, model, batch_size))

    chunks = chunked(usable)
    if distinct and only is None and chunker in NUMBERING:
        points = _distinct_points(usable, lambda part: embedded(chunked(part)))
    else:
        points = embedded(only(chunks) if only else chunks)
        points = vector_table.latest(points, "point_id", F.col("chunk_id")) if distinct else points
    too_large = scanned.filter("skip_reason is not null").select("path", "skip_reason")
    # chunk 0 stands for its document, so the lookup side has one row per document
    first = chunks.filter("chunk_index = 0").select(F.col("document_path").alias("path"))
    empty = usable.select("path").join(first, "path", "left_anti").withColumn("skip_reason", F.lit("no chunks"))
    return IndexPlan(chunks, points, too_large.unionByName(empty))


def _distinct_points(docs: DataFrame, points: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``points`` of ``docs``, of which those of repeated paths meet to leave one of each id."""
    repeated = cut_lineage(docs.groupBy("path").agg(F.count("*").alias("_n")).filter("_n > 1").select("path"))
    if repeated.isEmpty():
        return points(docs)
    again = points(sieve(docs, "path", repeated).join(repeated, "path"))
    return points(docs.join(repeated, "path", "left_anti")).unionByName(vector_table.latest(again, "point_id", F.col("chunk_id")))

"""Corpus cleaning operators over a ``(path, content)`` table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagemill.functions import markup as mk
from passagemill.functions import text as tx
from passagemill.operators.passages import sieve
from passagemill.session import cut_lineage


def strip_shortcodes(docs: DataFrame, rules: Mapping[str, str] | None = None) -> DataFrame:
    return docs.withColumn("content", mk.strip_tags(F.col("content"), rules))


def html_to_text(docs: DataFrame) -> DataFrame:
    return docs.withColumn("content", mk.html_to_text(F.col("content")))


def resolve_refs(docs: DataFrame, strict: bool = False, paths: DataFrame | None = None) -> DataFrame:
    """References as links. ``strict`` fails the job, as its rows are computed, at a reference to none of ``paths`` (default: the pages)."""
    if strict:
        missing = dangling_refs(docs, paths).groupBy("path").agg(F.min("target").alias("_missing"))
        wrong = F.raise_error(F.concat(F.lit("reference to a page that does not exist: "), F.col("path"), F.lit(" -> "), F.col("_missing")))
        checked = F.when(F.col("_missing").isNull(), F.col("content")).otherwise(wrong)
        docs = docs.join(missing, "path", "left").withColumn("content", checked).select(*docs.columns)
    return docs.withColumn("content", mk.resolve_refs(F.col("content")))


def dangling_refs(docs: DataFrame, paths: DataFrame | None = None) -> DataFrame:
    """References whose target is not in the corpus, one row per (path, target).

    A page can be the target of a large share of all references. The pairs are
    reduced to distinct targets before the corpus lookup, so the existence test
    sees each target once; AQE splits a hot target in the join back.
    """
    pairs = docs.select(
        "path", F.inline(mk.ref_targets(F.col("content"), F.col("path")))
    ).select("path", "ref_kind", "ref", "target")
    known = (docs if paths is None else paths).select(F.col("path").alias("target"))
    missing = pairs.select("target").distinct().join(known, "target", "left_anti")
    return pairs.join(missing, "target", "left_semi").select("path", "ref_kind", "ref", "target").distinct()


def add_source_url(docs: DataFrame, base_url: str) -> DataFrame:
    return docs.withColumn("source_url", mk.source_url(F.col("path"), base_url))


def split_front_matter(docs: DataFrame) -> DataFrame:
    """Adds ``has_front_matter``, ``front_matter`` (raw block) and ``body``."""
    content = F.col("content")
    return docs.select(
        "*",
        mk.has_front_matter(content).alias("has_front_matter"),
        mk.front_matter(content).alias("front_matter"),
        mk.body(content).alias("body"),
    )


def front_matter_metadata(docs: DataFrame, nested: bool = False) -> DataFrame:
    """Adds ``metadata``, the front matter as a string map; ``nested`` reads lists and maps of scalars."""
    return docs.withColumn("metadata", mk.front_matter_map(mk.front_matter(F.col("content")), nested))


def inject_source_url(docs: DataFrame) -> DataFrame:
    return docs.withColumn("content", mk.inject_source_url(F.col("content"), F.col("source_url")))


def add_size(docs: DataFrame) -> DataFrame:
    return docs.withColumn("size", tx.byte_size(F.col("content")))


def filter_directories(docs: DataFrame, directories: Sequence[str]) -> DataFrame:
    """Documents below the listed folders; a leading ``content/`` of a folder is ignored."""
    if not directories:
        return docs
    prefixes = sorted({d.removeprefix("content/").strip("/") + "/" for d in directories})
    wanted = F.lit(False)
    for prefix in prefixes:
        wanted = wanted | F.col("path").startswith(prefix)
    return docs.filter(wanted)


def missing_directories(docs: DataFrame, directories: Sequence[str]) -> DataFrame:
    """Listed folders that hold no document (``directory``)."""
    spark = docs.sparkSession
    asked = spark.createDataFrame(
        [(d.removeprefix("content/").strip("/"),) for d in directories], "directory string"
    )
    hit = F.explode(
        F.filter(
            F.array(*[F.lit(d.removeprefix("content/").strip("/")) for d in directories]),
            lambda d: F.col("path").startswith(F.concat(d, F.lit("/"))),
        )
    )
    found = docs.select(hit.alias("directory")).distinct()
    return asked.join(found, "directory", "left_anti")


# --- include expansion ---------------------------------------------------------


def _segments(content):
    """Alternating text and include segments of a document, in order."""
    texts = F.split(content, mk.INCLUDE_PATTERN)
    tags = F.regexp_extract_all(content, F.lit(mk.INCLUDE_PATTERN), F.lit(0))
    targets = F.regexp_extract_all(content, F.lit(mk.INCLUDE_PATTERN), F.lit(1))
    # text i stands before tag i; the last text has no tag after it
    return tx.let(
        F.arrays_zip(texts.alias("text"), tags.alias("tag"), targets.alias("target")),
        lambda rows: F.flatten(
            F.transform(
                rows,
                lambda r, i: F.array(
                    F.struct((i * 2).alias("at"), r["text"].alias("text"), F.lit(None).cast("string").alias("target")),
                    F.struct(
                        (i * 2 + 1).alias("at"),
                        r["tag"].alias("text"),
                        tx.clean_path(r["target"]).alias("target"),
                    ),
                ),
            )
        ),
    )


def expand_includes(docs: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Replace include tags by the (expanded) text of the named document.

    Returns ``(path, content)``. A document already being expanded on the current
    chain yields nothing, a missing or non-markdown target leaves the tag. Chains end by
    themselves, as none visits a document twice; ``max_depth`` leaves deeper tags as they are.

    Text travels as ordered segment rows. Documents that something includes are
    picked out once, already cut into segments; each round joins the open include
    segments to them by path, and AQE splits a target that very many documents
    include. Finished segments are set aside, so a round costs as much as its open
    ones, and documents without includes never shuffle. Each round is written to
    the checkpoint folder once.
    """
    docs = docs.select("path", "content")
    has_include = F.col("content").rlike(mk.INCLUDE_PATTERN)
    plain = docs.filter(~has_include)
    named = F.regexp_extract_all("content", F.lit(mk.INCLUDE_PATTERN), F.lit(1))
    targets = (
        docs.filter(has_include)
        .select(F.explode(F.transform(named, tx.clean_path)).alias("path"))
        .filter(tx.is_markdown(F.col("path")))
        .distinct()
    )
    # Most texts that nothing includes stay where they are, however many targets there are.
    library = cut_lineage(
        sieve(docs, "path", targets).join(targets, "path").select(
            F.col("path").alias("lookup"), _segments(F.col("content")).alias("included")
        )
    )

    seg = F.col("seg")
    opened = (
        docs.filter(has_include)
        .select("path", F.explode(_segments(F.col("content"))).alias("seg"))
        .filter(seg["text"].isNotNull())
        .select(
            "path",
            F.array(seg["at"]).alias("sort_key"),
            seg["text"].alias("text"),
            seg["target"].alias("target"),
            F.array().cast("array<string>").alias("visited"),
        )
    )
    finished = [opened.filter("target is null").select("path", "sort_key", "text")]
    pending = cut_lineage(opened.filter("target is not null"))
    depth = 0
    while not pending.isEmpty():
        if max_depth is not None and depth > max_depth:
            finished.append(pending.select("path", "sort_key", "text"))
            break
        depth += 1
        seen = F.array_contains("visited", F.col("target"))
        lookup = F.when(~seen & tx.is_markdown(F.col("target")), F.col("target"))
        joined = pending.withColumn("lookup", lookup).join(library, "lookup", "left")
        # a chain that comes back to an open document ends with empty text
        closed = F.struct(
            F.lit(None).cast("int").alias("at"),
            F.when(seen, F.lit("")).otherwise(F.col("text")).alias("text"),
            F.lit(None).cast("string").alias("target"),
        )
        rows = F.when(F.col("included").isNull(), F.array(closed)).otherwise(F.col("included"))
        # the round is written once; its finished and its open rows are both read from there
        step = cut_lineage(
            joined.select("path", "sort_key", "target", "visited", F.explode(rows).alias("seg"))
            .filter(seg["text"].isNotNull())
            .select(
                "path",
                F.when(seg["at"].isNull(), F.col("sort_key"))
                .otherwise(F.concat("sort_key", F.array(seg["at"])))
                .alias("sort_key"),
                seg["text"].alias("text"),
                seg["target"].alias("target"),
                F.concat("visited", F.array("target")).alias("visited"),
            )
        )
        finished.append(step.filter("target is null").select("path", "sort_key", "text"))
        pending = step.filter("target is not null")

    done = finished[0]
    for part in finished[1:]:
        done = done.unionByName(part)
    ordered = F.array_sort(F.collect_list(F.struct("sort_key", "text")))
    rebuilt = done.groupBy("path").agg(
        F.array_join(F.transform(ordered, lambda s: s["text"]), "").alias("content")
    )
    return plain.unionByName(rebuilt)

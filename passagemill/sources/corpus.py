"""Corpus and file sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagemill.functions import text as tx


def _relative(root: str):
    """Path below the root of the file a row was read from."""
    marker = "/" + root.rstrip("/").lstrip("/").split("://")[-1].lstrip("/") + "/"
    name = F.url_decode(F.regexp_replace(F.col("_metadata.file_path"), r"\+", "%2B"))
    return F.substr(name, F.locate(marker, name) + len(marker))


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows of a scan out to all cores where it comes in fewer partitions than there are cores.

    For CPU-heavy row work on small or single-file inputs. A large scan has more
    partitions than cores and is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def read_corpus(spark: SparkSession, root: str) -> DataFrame:
    """Every markdown file below ``root``: ``path, content, size``, one row per file."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.[mM]*[dDnN]")
        .load(root)
    )
    return (
        files.select(_relative(root).alias("path"), F.decode("content", "UTF-8").alias("content"), F.col("length").alias("size"))
        .filter(tx.is_markdown(F.col("path")))
    )


def index_candidates(docs: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """Documents with ``skip_reason`` (null when indexable); rows that are no input at all are dropped.

    Input are ``.md`` paths (exact case) outside dot folders. Expects ``path, size``. Documents of any
    size are indexable unless ``max_bytes`` is given.
    """
    wanted = F.col("path").endswith(".md") & ~F.col("path").rlike(r"(^|/)\.[^/]+/")
    reason = F.lit(None).cast("string")
    if max_bytes is not None:
        reason = F.when(
            F.col("size") > max_bytes,
            F.format_string(f"%d bytes exceed the limit of {max_bytes}", F.col("size")),
        )
    return docs.filter(wanted).withColumn("skip_reason", reason)


def read_text_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of ``.jsonl`` files: ``dataset, size, modified, line_no, line``.

    Files are split like any text input. ``line_no`` orders the lines of a file: the
    start of the split a line was read from, then its order within the split.
    """
    lines = spark.read.option("pathGlobFilter", "*.jsonl").text(path)
    return lines.select(
        F.col("_metadata.file_name").alias("dataset"),
        F.col("_metadata.file_size").alias("size"),
        F.col("_metadata.file_modification_time").alias("modified"),
        F.struct(
            F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("row")
        ).alias("line_no"),
        F.col("value").alias("line"),
    )


def artifact_catalogue(paths: DataFrame, kind: str = "", tag: str = "") -> DataFrame:
    """Per (type, tag) the number of output ``.md`` files among paths ``type/tag/…``.

    ``file_count`` is null for a tag that has no output folder.
    """
    parts = F.split("path", "/")
    keyed = paths.select(
        F.get(parts, F.lit(0)).alias("type"),
        F.get(parts, F.lit(1)).alias("tag"),
        (F.get(parts, F.lit(2)) == "output").alias("in_output"),
        F.col("path").endswith(".md").alias("is_md"),
    ).filter(F.col("tag").isNotNull())
    if kind:
        keyed = keyed.filter(F.col("type") == kind)
    if tag:
        keyed = keyed.filter(F.col("tag") == tag)
    counted = F.count_if(F.col("in_output") & F.col("is_md"))
    return keyed.groupBy("type", "tag").agg(
        F.when(F.count_if("in_output") > 0, counted).alias("file_count")
    )

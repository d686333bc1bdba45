"""Corpus verification: a source table against its cleaned output (both ``path, content``)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagemill.functions import markup as mk
from passagemill.functions import text as tx

# Limits of the checks.
MIN_CONTENT_BYTES = 50
SIZE_RATIO = (0.5, 2.0)

CHECKS = (
    "file_count_match",
    "directory_structure",
    "no_shortcodes",
    "no_raw_html",
    "minimum_content",
    "total_size",
)


def _markdown(docs: DataFrame) -> DataFrame:
    return docs.filter(tx.is_markdown(F.col("path"), any_case=False))


def path_differences(source: DataFrame, output: DataFrame) -> DataFrame:
    """Paths on one side only: ``(path, problem)`` with problem missing or extra."""
    left = _markdown(source).select("path", F.lit(1).alias("in_source"))
    right = _markdown(output).select("path", F.lit(1).alias("in_output"))
    return (
        left.join(right, "path", "full_outer")
        .filter(F.col("in_source").isNull() | F.col("in_output").isNull())
        .select("path", F.when(F.col("in_output").isNull(), "missing").otherwise("extra").alias("problem"))
    )


def violations(output: DataFrame) -> DataFrame:
    """Offending documents, one row per ``(check_name, path)``; one pass over the output."""
    content = F.col("content")
    broken = F.array_compact(
        F.array(
            F.when(content.rlike(mk.LEFTOVER_TAG_PATTERN), F.lit("no_shortcodes")),
            F.when(content.rlike(mk.RAW_HTML_PATTERN), F.lit("no_raw_html")),
            F.when(F.octet_length(content) < MIN_CONTENT_BYTES, F.lit("minimum_content")),
        )
    )
    return _markdown(output).select(F.explode(broken).alias("check_name"), "path")


def report(source: DataFrame, output: DataFrame) -> DataFrame:
    """One row per check: ``check_name, passed, detail, all_passed``.

    Counts only: the offending paths are rows of :func:`violations` and
    :func:`path_differences`, since their number is not bounded.
    """
    content = F.col("content")
    flags = {
        "n_tags": content.rlike(mk.LEFTOVER_TAG_PATTERN),
        "n_html": content.rlike(mk.RAW_HTML_PATTERN),
        "n_small": F.octet_length(content) < MIN_CONTENT_BYTES,
    }
    src = _markdown(source).select("path", F.lit(1).alias("src_n"), tx.byte_size(content).alias("src_bytes"))
    dst = _markdown(output).select(
        "path",
        F.lit(1).alias("dst_n"),
        tx.byte_size(content).alias("dst_bytes"),
        *[test.cast("int").alias(name) for name, test in flags.items()],
    )
    # Each table is read once; only paths and numbers are shuffled.
    numbers = ["src_n", "src_bytes", "dst_n", "dst_bytes", *flags]
    by_path = (
        src.unionByName(dst, allowMissingColumns=True)
        .groupBy("path")
        .agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in numbers])
    )
    facts = by_path.agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in numbers],
        F.count_if((F.col("src_n") == 0) | (F.col("dst_n") == 0)).alias("n_diff"),
    )

    ratio = F.col("dst_bytes") / F.nullif(F.col("src_bytes"), F.lit(0))
    sized = F.when(F.col("src_bytes") > 0, ratio.between(*SIZE_RATIO)).otherwise(F.col("dst_bytes") > 0)

    def row(name, passed, fmt, *args):
        return F.struct(
            F.lit(name).alias("check_name"), passed.alias("passed"), F.format_string(fmt, *args).alias("detail")
        )

    rows = F.array(
        row(
            CHECKS[0], F.col("src_n") == F.col("dst_n"),
            "%d source pages, %d output pages", F.col("src_n"), F.col("dst_n"),
        ),
        F.struct(
            F.lit(CHECKS[1]).alias("check_name"),
            (F.col("n_diff") == 0).alias("passed"),
            F.when(F.col("n_diff") == 0, F.lit("same paths on both sides"))
            .otherwise(F.format_string("%d paths on one side only", F.col("n_diff")))
            .alias("detail"),
        ),
        row(CHECKS[2], F.col("n_tags") == 0, "%d pages with template tags", F.col("n_tags")),
        row(CHECKS[3], F.col("n_html") == 0, "%d pages with HTML", F.col("n_html")),
        row(
            CHECKS[4], F.col("n_small") == 0,
            f"%d pages under {MIN_CONTENT_BYTES} bytes", F.col("n_small"),
        ),
        row(
            CHECKS[5], sized, "%d bytes before, %d after", F.col("src_bytes"), F.col("dst_bytes")
        ),
    )
    return facts.select(rows.alias("rows")).select(
        F.inline("rows"), F.forall("rows", lambda r: r["passed"]).alias("all_passed")
    )

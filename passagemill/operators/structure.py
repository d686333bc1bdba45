"""Documents to typed elements."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagemill.functions import markdown as md
from passagemill.functions import markup as mk
from passagemill.operators.clean import front_matter_metadata


def parse_markdown(docs: DataFrame) -> DataFrame:
    """``(path, content)`` to ``(path, metadata, elements)``; one row per document, no shuffle."""
    return front_matter_metadata(docs, nested=True).select(
        "path", "metadata", md.elements(mk.body(F.col("content"))).alias("elements")
    )


def parse_plain(docs: DataFrame) -> DataFrame:
    """Plain text: the whole content is one paragraph."""
    element = F.struct(
        F.lit(md.PARAGRAPH).alias("kind"),
        F.col("content").alias("text"),
        F.lit(0).alias("level"),
        F.lit(None).cast("map<string,string>").alias("meta"),
    )
    return docs.select(
        "path", F.lit(None).cast("map<string,string>").alias("metadata"), F.array(element).alias("elements")
    )


def explode_elements(parsed: DataFrame) -> DataFrame:
    """One row per element with its document's metadata: ``path, metadata, pos, kind, text, level, meta``."""
    # The outer form keeps the optimizer from adding a non-empty test on the array
    # below the explode, which would parse every document a second time.
    return (
        parsed.select("path", "metadata", F.posexplode_outer("elements").alias("pos", "element"))
        .filter(F.col("pos").isNotNull())
        .select("path", "metadata", "pos", "element.*")
    )

"""Corpus cleaning as one chain of transforms."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagemill.functions import text as tx
from passagemill.operators import clean


def clean_corpus(
    docs: DataFrame,
    base_url: str = "",
    directories: Sequence[str] = (),
    rules: Mapping[str, str] | None = None,
    refs_first: bool = False,
) -> DataFrame:
    """Markdown documents ``(path, content)`` cleaned: ``path, content, size, source_url``.

    Order: includes, template tags, HTML, references, source address. Tags are
    stripped before references, so reference tags vanish unless ``refs_first``.
    Only include expansion shuffles, and only documents that include something;
    includes may reach outside ``directories``.
    """
    pages = docs.filter(tx.is_markdown(F.col("path")))
    expanded = clean.filter_directories(clean.expand_includes(pages), directories)
    if refs_first:
        expanded = clean.resolve_refs(expanded)
    text = expanded.transform(clean.strip_shortcodes, rules).transform(clean.html_to_text)
    if not refs_first:
        text = clean.resolve_refs(text)
    if base_url:
        text = clean.add_source_url(text, base_url).transform(clean.inject_source_url)
    else:
        text = text.withColumn("source_url", F.lit(""))
    return text.transform(clean.add_size).select("path", "content", "size", "source_url")

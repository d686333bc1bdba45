"""Chunkers over parsed documents (``path, metadata, elements``).

Both stay inside the document's row until the final explode, so chunking a
corpus is one narrow stage. Output: ``chunk_id, document_path, content,
metadata, token_count, chunk_index``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagemill.functions import ids
from passagemill.functions import markdown as md
from passagemill.functions import text as tx

# Fixed value: sentence pattern (possessive where the next class cannot overlap).
SENTENCE_PATTERN = r"[^.!?\n]++[.!?]+[\s\n]*|[^\n]+"


def _number(docs: DataFrame, contents: Column) -> DataFrame:
    return (
        docs.select(
            F.col("path").alias("document_path"), "metadata", F.posexplode(contents).alias("chunk_index", "content")
        )
        .select(
            ids.chunk_id(F.col("document_path"), F.col("chunk_index")).alias("chunk_id"),
            "document_path",
            "content",
            "metadata",
            tx.token_estimate(F.col("content")).alias("token_count"),
            "chunk_index",
        )
    )


def fixed_parameters(size: int, overlap: int) -> tuple[int, int]:
    """Checked ``(size, step)``; an overlap of size or more becomes size - 1."""
    if size <= 0:
        raise ValueError("fixed chunker: size must be > 0")
    return size, max(size - min(overlap, size - 1), 1)


def fixed_chunks(
    parsed: DataFrame, size: int = 512, overlap: int = 64, drop_overlap_tail: bool = False
) -> DataFrame:
    """Windows of ``size`` words over a document's text, stepping ``size - overlap``.

    What remains after the last full window is a chunk of its own, even where it
    only repeats overlap words; ``drop_overlap_tail`` leaves such a tail out.
    """
    size, step = fixed_parameters(size, overlap)
    all_words = F.flatten(F.transform("elements", lambda e: tx.words(e["text"])))

    def windows(w: Column) -> Column:
        n = F.size(w)
        full = F.when(n < size, F.lit(0)).otherwise(F.floor((n - size) / step) + 1).cast("int")
        rest = n - full * step
        tail = (rest > 0) & ((full == 0) | (rest > size - step)) if drop_overlap_tail else rest > 0
        count = full + tail.cast("int")
        return F.when(
            count > 0,
            F.transform(
                F.sequence(F.lit(0), F.greatest(count, F.lit(1)) - 1),
                lambda i: F.array_join(F.slice(w, i * step + 1, F.when(i < full, F.lit(size)).otherwise(n)), " "),
            ),
        )

    return _number(parsed, tx.let(all_words, windows))


def recursive_parameters(max_size: int, overlap: int | None) -> tuple[int, int]:
    """Checked ``(max_size, step)``; default overlap is a fifth of the size."""
    if max_size <= 0:
        raise ValueError("recursive chunker: max_size must be > 0")
    overlap = max_size // 5 if overlap is None else max(overlap, 0)
    if overlap >= max_size:
        overlap = max_size // 5
    return max_size, max(max_size - overlap, 1)


def sections(elements: Column) -> Column:
    """``array<struct<path, items>>``: a heading with all elements up to the next one.

    Elements before the first heading form a section of their own. ``path`` is the
    chain of enclosing headings, outermost first, joined by `` > ``.
    """

    def cut(els: Column) -> Column:
        at = F.filter(
            F.transform(els, lambda e, i: F.when((e["kind"] == md.HEADING) | (i == 0), i)),
            lambda i: i.isNotNull(),
        )
        return tx.let(
            at,
            lambda starts: F.transform(
                starts,
                lambda s, j: F.slice(els, s + 1, F.coalesce(F.get(starts, j + 1), F.size(els)) - s),
            ),
        )

    stack_type = "array<struct<level:int,text:string>>"

    def enter(stack: Column, head: Column) -> Column:
        outer = F.filter(stack, lambda h: h["level"] < head["level"])
        here = F.struct(head["level"].alias("level"), F.trim(head["text"]).alias("text"))
        return F.when(head["kind"] == md.HEADING, F.concat(outer, F.array(here))).otherwise(stack)

    def step(state: Column, items: Column) -> Column:
        return tx.let(
            enter(state["stack"], F.get(items, F.lit(0))),
            lambda stack: F.struct(
                stack.alias("stack"),
                F.array_append(
                    state["paths"], F.array_join(F.transform(stack, lambda h: h["text"]), " > ")
                ).alias("paths"),
            ),
        )

    def with_paths(cuts: Column) -> Column:
        start = F.struct(
            F.array().cast(stack_type).alias("stack"), F.array().cast("array<string>").alias("paths")
        )
        paths = F.aggregate(cuts, start, step, lambda state: state["paths"])
        return F.zip_with(paths, cuts, lambda p, items: F.struct(p.alias("path"), items.alias("items")))

    return tx.let(elements, lambda els: tx.let(cut(els), with_paths))


def _prefixed(path: Column, gap: str, text: Column) -> Column:
    return F.when(path == "", text).otherwise(F.concat(path, F.lit(gap), text))


def _word_windows(words: Column, path: Column, max_size: int, step: int) -> Column:
    n = F.size(words)
    count = F.greatest(F.ceil((n - max_size) / step), F.lit(0)).cast("int")
    return F.transform(
        F.sequence(F.lit(0), count),
        lambda i: _prefixed(path, "\n", F.array_join(F.slice(words, i * step + 1, F.lit(max_size)), " ")),
    )


def section_chunks(section: Column, max_size: int, step: int) -> Column:
    """Chunk texts of one section: whole if it fits, else blocks, sentences, word windows."""
    path, items = section["path"], section["items"]

    def word_count(text: Column) -> Column:
        return F.size(tx.words(text))

    content = F.filter(items, lambda e: e["kind"] != md.HEADING)
    total = F.aggregate(
        F.transform(content, lambda e: word_count(e["text"])), F.lit(0), lambda total, n: total + n
    )
    whole_texts = F.filter(F.transform(items, lambda e: F.trim(e["text"])), lambda t: t != "")
    whole = F.array(_prefixed(path, "\n\n", F.array_join(whole_texts, "\n\n")))
    head = F.get(items, F.lit(0))
    lone = (F.size(content) == 1) & (head["kind"] == md.HEADING)

    def from_sentence(sentence: Column) -> Column:
        return tx.let(
            tx.words(sentence),
            lambda w: F.when(F.size(w) <= max_size, F.array(_prefixed(path, "\n\n", sentence))).otherwise(
                _word_windows(w, path, max_size, step)
            ),
        )

    def from_text(text: Column, kind: Column) -> Column:
        sentences = F.filter(
            F.transform(F.regexp_extract_all(text, F.lit(SENTENCE_PATTERN), F.lit(0)), tx.trim_ws),
            lambda s: s != "",
        )
        headed = F.when(lone, F.concat(head["text"], F.lit("\n\n"), text)).otherwise(text)
        return (
            F.when(text == "", F.array().cast("array<string>"))
            .when(kind.isin(*md.ATOMIC_KINDS), F.array(_prefixed(path, "\n\n", headed)))
            .when(word_count(text) <= max_size, F.array(_prefixed(path, "\n\n", text)))
            .otherwise(F.flatten(F.transform(sentences, from_sentence)))
        )

    def from_block(block: Column) -> Column:
        return tx.let(tx.trim_ws(block["text"]), lambda text: from_text(text, block["kind"]))

    return tx.let(
        total,
        lambda n: F.when(n == 0, F.array().cast("array<string>"))
        .when(n <= max_size, whole)
        .otherwise(F.flatten(F.transform(content, from_block))),
    )


def recursive_chunks(parsed: DataFrame, max_size: int = 512, overlap: int | None = None) -> DataFrame:
    """Structure-aware chunks: sections at every heading, split further only when oversized.

    Code and tables are never split. Chunks start with the heading path.
    """
    max_size, step = recursive_parameters(max_size, overlap)
    contents = F.flatten(
        F.transform(sections(F.col("elements")), lambda s: section_chunks(s, max_size, step))
    )
    return _number(parsed, contents)

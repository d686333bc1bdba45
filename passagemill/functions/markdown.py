"""Markdown structure as expressions: block splitting and inline flattening.

A document is split into blocks by one left-to-right pattern and each block is
turned into an element. Both steps stay inside the document's row, so
structuring a corpus needs no shuffle.

Subset: ATX and setext headings, fenced and indented code, GFM tables, list items
(nested items belong to their parent), quotes (as one paragraph), HTML blocks and
rules (no element), paragraphs (soft breaks become a space).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from passagemill.functions import text as tx
from passagemill.schemas import ELEMENT, STRING_MAP

HEADING, PARAGRAPH, CODE, TABLE, LIST_ITEM = "heading", "paragraph", "code_block", "table", "list_item"
ATOMIC_KINDS = (CODE, TABLE)

# Block-level HTML names that open an HTML block (CommonMark).
HTML_BLOCK_NAMES = """
address article aside base basefont blockquote body caption center col colgroup
dd details dialog dir div dl dt fieldset figcaption figure footer form frame
frameset h1 h2 h3 h4 h5 h6 head header hr html iframe legend li link main menu
menuitem nav noframes ol optgroup option p param pre script search section style
summary table tbody td textarea tfoot th thead title tr track ul
""".split()

_BLANK = r"[ \t]*$"
_ATX = r" {0,3}#{1,6}(?:[ \t][^\n]*)?$"
_FENCE_OPEN = r" {0,3}(?:`{3,}[^`\n]*|~{3,}[^\n]*)$"
_RULE = r" {0,3}(?:(?:\*[ \t]*+){3,}+|(?:-[ \t]*+){3,}+|(?:_[ \t]*+){3,}+)$"
_QUOTE = r" {0,3}>"
_HTML = r" {0,3}<(?:!--|!|\?|/?(?:" + "|".join(HTML_BLOCK_NAMES) + r")(?:[\s>]|/>|$))"
_ITEM = r" {0,3}(?:[-*+]|\d{1,9}[.)])(?:[ \t][^\n]*)?$"
# Only a filled bullet or a list starting at 1 may break into running text.
_ITEM_IN_TEXT = r" {0,3}(?:[-*+]|1[.)])[ \t]+\S"
_SETEXT = r" {0,3}(?:=+|-+)[ \t]*$"
_DELIMITER = r" {0,3}(?=[^\n]*\|)\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*+\|?[ \t]*$"
_TABLE_START = r"[^\n|]*+\|[^\n]*+\n" + _DELIMITER

_BREAKS = "|".join([_BLANK, _ATX, _FENCE_OPEN, _RULE, _QUOTE, _HTML, _ITEM_IN_TEXT])
_LAZY = r"\n(?!" + _BREAKS + r")[^\n]+"

_BLOCK = "(?md)" + "|".join(
    "(?:" + pattern + ")"
    for pattern in [
        r"^ {0,3}(`{3,})[^`\n]*$[\s\S]*?(?:^ {0,3}\1`*[ \t]*$|\z)",
        r"^ {0,3}(~{3,})[^\n]*$[\s\S]*?(?:^ {0,3}\2~*[ \t]*$|\z)",
        r"^" + _ATX,
        r"^" + _RULE,
        # indented code; blank lines inside belong to it when more code follows
        r"^(?: {4}|\t)[^\n]*\S[^\n]*$"
        r"(?:\n(?:(?: {4}|\t)[^\n]*|[ \t]*(?=\n(?:[ \t]*\n)*+(?: {4}|\t)[^\n]*\S)))*+",
        r"^" + _QUOTE + r"[^\n]*(?:\n" + _QUOTE + r"[^\n]*|" + _LAZY + r")*+",
        r"^" + _ITEM + r"(?:\n(?:[ \t]*\n)*+(?: {2,}|\t)[^\n]*\S[^\n]*|\n(?!" + _ITEM + r")(?!"
        + _BREAKS + r")[^\n]+)*+",
        r"^" + _HTML + r"[^\n]*(?:\n[^\n]*\S[^\n]*)*+",
        r"^" + _TABLE_START + r"(?:" + _LAZY + r")*+",
        r"^[^\n]*\S[^\n]*(?:\n(?!" + _BREAKS + r"|" + _SETEXT + r"|" + _TABLE_START
        + r")[^\n]+)*+(?:\n" + _SETEXT + r")?",
    ]
)


def blocks(body: Column) -> Column:
    """Block texts in document order."""
    return F.regexp_extract_all(tx.unix_lines(body), F.lit(_BLOCK), F.lit(0))


def _flattened(text: Column) -> Column:
    out = F.regexp_replace(text, r'!\[\]\(\s*<?([^\s()>]+)>?[^()\n]*\)', "$1")
    out = F.regexp_replace(out, r'!\[([^\]\n]*)\]\(\s*<?([^\s()>]+)>?[^()\n]*\)', "$1 ($2)")
    out = F.regexp_replace(out, r"\[([^\[\]\n]*)\]\(\s*\)", "$1")
    out = F.regexp_replace(out, r'\[([^\[\]\n]*)\]\(\s*<?([^\s()>]+)>?(?:\s+"[^"\n]*")?\s*\)', "$1 ($2)")
    out = F.regexp_replace(out, r"<((?:https?|mailto):[^\s<>]*)>", "$1")
    out = F.regexp_replace(out, r"</?[a-zA-Z][^<>]*>", "")
    out = F.regexp_replace(out, r"\*\*([^*\s](?:[^*\n]*[^*\s])?)\*\*", "$1")
    out = F.regexp_replace(out, r"\*([^*\s](?:[^*\n]*[^*\s])?)\*", "$1")
    out = F.regexp_replace(out, r"(?<!\w)__([^_\s](?:[^_\n]*[^_\s])?)__(?!\w)", "$1")
    out = F.regexp_replace(out, r"(?<!\w)_([^_\s](?:[^_\n]*[^_\s])?)_(?!\w)", "$1")
    out = F.regexp_replace(out, r"~~([^~\n]+)~~", "$1")
    return out


# Markup characters inside code spans stand aside as private-use characters while the rest is flattened.
_MARKUP = "[]()<>*_~!"
_ASIDE = "".join(chr(0xE000 + i) for i in range(len(_MARKUP)))


def _with_code_spans(text: Column) -> Column:
    pieces = F.regexp_extract_all(text, F.lit(r"`+[^`]++`+|[^`]++|`+"), F.lit(0))
    shielded = F.transform(
        pieces,
        lambda p: F.when(
            p.rlike(r"^`+[^`]"), F.translate(F.btrim(p, F.lit("`")), _MARKUP, _ASIDE)
        ).otherwise(p),
    )
    return F.translate(_flattened(F.array_join(shielded, "")), _ASIDE, _MARKUP)


def flatten_inline(text: Column) -> Column:
    """Links as ``text (url)``, images as ``alt (url)``, autolinks as url; markers and tags dropped."""
    return tx.let(
        text,
        lambda t: tx.trim_ws(
            F.when(F.contains(t, F.lit("`")), _with_code_spans(t))
            .when(t.rlike(r"[\[<*~_]"), _flattened(t))
            .otherwise(t)
        ),
    )


def _joined_lines(text: Column) -> Column:
    return tx.let(
        tx.trim_ws(text),
        lambda t: F.when(F.contains(t, F.lit("\n")), F.regexp_replace(t, r"[ \t\\]*+\n\s*+", " ")).otherwise(t),
    )


def _table_text(block: Column) -> Column:
    def cells(row: Column) -> Column:
        inner = F.regexp_replace(F.trim(row), r"^\||\|$", "")
        return F.transform(
            F.split(inner, r"(?<!\\)\|"), lambda c: flatten_inline(F.replace(c, F.lit("\\|"), F.lit("|")))
        )

    def flat(rows: Column) -> Column:
        width = F.size(F.element_at(rows, 1))
        kept = F.filter(rows, lambda _, i: i != 1)
        return F.array_join(
            F.transform(
                kept,
                lambda r: F.array_join(
                    F.slice(F.concat(r, F.array_repeat(F.lit(""), width)), F.lit(1), width), " "
                ),
            ),
            "\n",
        )

    return tx.let(F.transform(F.split(block, "\n"), cells), flat)


def _element(kind: Column | str, text: Column, level: Column | None = None, meta: Column | None = None) -> Column:
    return F.struct(
        F.lit(kind).alias("kind") if isinstance(kind, str) else kind.alias("kind"),
        text.alias("text"),
        (F.lit(0) if level is None else level).cast("int").alias("level"),
        (F.lit(None).cast(STRING_MAP) if meta is None else meta).alias("meta"),
    )


def _fenced(block: Column) -> Column:
    language = F.regexp_extract(block, r"^ {0,3}(?:`{3,}|~{3,})[ \t]*([^\s`]+)", 1)
    inner = F.regexp_replace(block, r"\A[^\n]*(?:\n|\z)", "")
    inner = F.regexp_replace(inner, r"(?:\A|\n) {0,3}(?:`{3,}|~{3,})[ \t]*\z", "")
    meta = F.when(language != "", F.create_map(F.lit("language"), language))
    return _element(CODE, tx.trim_ws(inner), meta=meta)


def _anchored(pattern: str) -> str:
    return r"(?d)\A(?:" + pattern.replace("$", r"(?=\n|\z)") + ")"


def _marked_element(block: Column) -> Column:
    """Element of a block that starts with a marker or holds a table or setext underline."""
    dropped = F.lit(None).cast(ELEMENT)
    heading_text = F.regexp_replace(block, r"^ {0,3}#{1,6}[ \t]*", "")
    heading_text = F.regexp_replace(heading_text, r"(?:^|[ \t])#+[ \t]*$", "")
    list_text = F.regexp_replace(block, r"(?m)^[ \t]*(?:[-*+]|\d{1,9}[.)])(?:[ \t]+|$)", "")
    list_text = F.regexp_replace(list_text, r"(?m)^\[[ xX]\][ \t]+", "")
    quote_text = F.regexp_replace(block, r"(?m)^ {0,3}>[ \t]?", "")
    setext_level = F.when(F.regexp_extract(block, r"\n {0,3}([=-])[=-]*[ \t]*\z", 1) == "=", 1).otherwise(2)
    code_text = F.regexp_replace(block, r"(?m)^(?: {4}|\t)", "")
    return (
        F.when(block.rlike(r"\A(?: {4}|\t)"), _element(CODE, tx.trim_ws(code_text)))
        .when(block.rlike(_anchored(_FENCE_OPEN)), _fenced(block))
        .when(
            block.rlike(_anchored(_ATX)),
            _element(
                HEADING,
                flatten_inline(heading_text),
                F.length(F.regexp_extract(block, r"^ {0,3}(#{1,6})", 1)),
            ),
        )
        .when(block.rlike(_anchored(_RULE)), dropped)
        .when(block.rlike(_anchored(_QUOTE)), _element(PARAGRAPH, flatten_inline(_joined_lines(quote_text))))
        .when(block.rlike(_anchored(_ITEM)), _element(LIST_ITEM, flatten_inline(_joined_lines(list_text))))
        .when(block.rlike(_anchored(_HTML)), dropped)
        .when(block.rlike(_anchored(_TABLE_START)), _element(TABLE, _table_text(block)))
        .when(
            block.rlike(r"(?d)\n {0,3}(?:=+|-+)[ \t]*\z"),
            _element(
                HEADING,
                flatten_inline(_joined_lines(F.regexp_replace(block, r"\n {0,3}[=-]+[ \t]*\z", ""))),
                setext_level,
            ),
        )
        .otherwise(_element(PARAGRAPH, flatten_inline(_joined_lines(block))))
    )


# A block needs the full test only if it starts with white space, a digit or a
# marker, or if it runs over several lines and one of them could be an underline or table row.
_MAYBE_MARKED = r"\A[\s\d#`~>*+_<|-]|\n *[|:=-]"


def to_element(block: Column) -> Column:
    """Typed element of a block; null for blocks that carry no element."""
    return F.when(block.rlike(_MAYBE_MARKED), _marked_element(block)).otherwise(
        _element(PARAGRAPH, flatten_inline(_joined_lines(block)))
    )


def elements(body: Column) -> Column:
    """``array<struct<kind,text,level,meta>>`` of a document body without front matter."""
    parsed = F.transform(blocks(body), to_element)
    return F.filter(
        parsed,
        lambda e: e.isNotNull() & ((e["text"] != "") | (e["kind"] == CODE)),
    )

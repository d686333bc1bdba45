"""Cleaning expressions: template tags, HTML, cross references, front matter, source URLs.

All loops inside the patterns are possessive or run over a single character
class, so the Java matcher iterates instead of recursing on long texts.
"""

from __future__ import annotations

import functools
import html.entities
import operator
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from passagemill.functions import text as tx

REMOVE, STRIP, RESOLVE = "remove", "strip", "resolve"

# The default action per tag name; a name not listed is stripped.
DEFAULT_TAG_RULES = {
    "include": RESOLVE,
    "details": STRIP,
    "alert": STRIP,
    "panel": STRIP,
    "handbook-data-toc": REMOVE,
    "youtube": REMOVE,
    "member-by-name": REMOVE,
    "member-by-gitlab": REMOVE,
    "ref": RESOLVE,
    "relref": RESOLVE,
}

# Tag syntax and report patterns.
INCLUDE_PATTERN = r'\{\{%\s*include\s+"([^"]+)"\s*%\}\}'
REF_PATTERN = r'\{\{<\s*(ref|relref)\s+"([^"]+)"\s*>\}\}'
LEFTOVER_TAG_PATTERN = r"\{\{(?:%|<)"
RAW_HTML_PATTERN = r"<[a-z]+[^>]*>"

# Zero-width: before an opening mark and behind a closing one.
_TAG_EDGES = r"(?=\{\{[<%/])|(?<=[>%]\}\})"
_TAG_HEAD = r"^\{\{(?:[<%]\s*/?|/)[\w-]+"
# Kinds of opening marks, and of the closing marks that end a tag; a bare "{{/" ends at either.
_ANGLE, _PERCENT, _BARE = 1, 2, 3
_BLOCK = 256


def strip_tags(content: Column, rules: Mapping[str, str] | None = None) -> Column:
    """Drop template tags. Names with the remove action lose their enclosed text too.

    One scan from left to right. A tag runs from its opening mark to the next closing mark of its kind; an
    opening mark without one is text. A removed tag takes all text up to the first closing tag of its name with
    it, if there is one behind it. Every other tag, known or not, is dropped alone, which keeps the text
    between a pair and also clears nested and stray tags.

    The text is split once at its marks and the pieces are folded with the open tag as state, so the
    cost grows with the text, whatever is left open.
    """
    rules = DEFAULT_TAG_RULES if rules is None else rules
    removed = [name for name, action in rules.items() if action == REMOVE]
    return tx.let(content, lambda c: F.when(c.contains("{{"), _without_tags(c, removed)).otherwise(c))


def _without_tags(content: Column, removed: list[str]) -> Column:
    names = F.array(*[F.lit(n) for n in removed]).cast("array<string>")

    def kind(piece: Column, i: Column) -> Column:
        def of(head: Column) -> Column:
            lead = (
                F.when(head == "", 0)
                .when(head.startswith("{{<"), _ANGLE)
                .when(head.startswith("{{%"), _PERCENT)
                .otherwise(_BARE)
            )
            number = F.array_position(names, F.regexp_extract(head, r"[\w-]+$", 0)).cast("int")
            return F.struct(
                i.alias("at"),
                lead.alias("lead"),
                F.when(head.contains("/"), 0).otherwise(number).alias("opens"),
                F.when(head.rlike(r"^\{\{(?:[<%] ?)?/"), number).otherwise(0).alias("shuts"),
                F.when(piece.endswith(">}}"), _ANGLE).when(piece.endswith("%}}"), _PERCENT).otherwise(0).alias("ends"),
            )

        return tx.let(F.regexp_extract(piece, _TAG_HEAD, 0), of)

    def last(kinds: Column, test) -> Column:
        return F.coalesce(F.array_max(F.transform(F.filter(kinds, test), lambda k: k["at"])), F.lit(-1))

    def last_end(kinds: Column, mark: Column) -> Column:
        return last(kinds, lambda k: (k["ends"] == mark) | ((mark == _BARE) & (k["ends"] > 0)))

    def last_shut(shuts: Column, number: Column) -> Column:
        """Place of the last closing tag; numbers run over removed names and, for each, both kinds of marks."""

        def test(k: Column) -> Column:
            lead = k["lead"]
            return (k["shuts"] * 2 == number + number % 2) & ((lead == _BARE) | (lead % 2 == number % 2))

        return last(shuts, test)

    def scanned(pieces: Column, kinds: Column) -> Column:
        ends = F.transform(F.array(F.lit(_ANGLE), F.lit(_PERCENT), F.lit(_BARE)), lambda mark: last_end(kinds, mark))
        numbers = F.sequence(F.lit(1), F.lit(2 * len(removed))) if removed else F.array().cast("array<int>")
        return tx.let(
            ends,
            lambda e: tx.let(
                F.filter(kinds, lambda k: (k["shuts"] > 0) & (k["at"] <= F.get(e, F.lit(2)))),
                lambda shuts: tx.let(
                    F.transform(numbers, lambda number: last_shut(shuts, number)), lambda shut: _kept(pieces, kinds, e, shut)
                ),
            ),
        )

    return tx.let(F.split(content, _TAG_EDGES), lambda pieces: tx.let(F.transform(pieces, kind), lambda kinds: scanned(pieces, kinds)))


def _kept(pieces: Column, kinds: Column, ends: Column, shut: Column) -> Column:
    """The pieces outside of tags and removed text.

    State of the fold: ``tag`` the kind of mark that ends the open tag, ``then`` and ``mode`` the removed name (and its
    kind of mark) that tag opened, ``skip`` the removed name whose closing tag is awaited. Flags are
    gathered per block of pieces, so that none is copied more than a few times.
    """

    def step(state: Column, k: Column) -> Column:
        tag, then, mode, skip = (state[n] for n in ("tag", "then", "mode", "skip"))
        at, lead, shuts, end = (k[n] for n in ("at", "lead", "shuts", "ends"))
        free = (tag == 0) & (skip == 0)
        starts = free & (lead > 0) & (at <= F.get(ends, lead - 1))
        closes = (skip > 0) & (shuts == skip) & ((lead == mode) | (lead == _BARE))
        now = F.struct(
            starts.alias("starts"),
            F.when(starts, lead).when(closes, _BARE).otherwise(tag).alias("tag"),
            F.when(starts, k["opens"]).when(closes, 0).otherwise(then).alias("then"),
            F.when(starts, lead).otherwise(mode).alias("mode"),
            F.when(closes, 0).otherwise(skip).alias("skip"),
        )

        def moved(n: Column) -> Column:
            tag, then, mode = (n[name] for name in ("tag", "then", "mode"))
            done = (tag > 0) & (end > 0) & ((tag == _BARE) | (tag == end))
            pair = done & (then > 0) & (at < F.get(shut, 2 * then + mode - 3))
            return F.struct(
                F.when(done, 0).otherwise(tag).alias("tag"),
                F.when(done, 0).otherwise(then).alias("then"),
                mode.alias("mode"),
                F.when(pair, then).otherwise(n["skip"]).alias("skip"),
                F.concat(state["flags"], F.when(free & ~n["starts"], "1").otherwise("0")).alias("flags"),
            )

        return tx.let(now, moved)

    def begun(state: Column | None) -> Column:
        fields = [(F.lit(0) if state is None else state[n]).alias(n) for n in ("tag", "then", "mode", "skip")]
        return F.struct(*fields, F.lit("").alias("flags"))

    def block(state: Column, part: Column) -> Column:
        def joined(inner: Column) -> Column:
            fields = [inner[n].alias(n) for n in ("tag", "then", "mode", "skip")]
            return F.struct(*fields, F.concat(state["flags"], inner["flags"]).alias("flags"))

        return tx.let(F.aggregate(part, begun(state), step), joined)

    parts = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(kinds) - 1) / _BLOCK).cast("int")),
        lambda b: F.slice(kinds, b * _BLOCK + 1, F.lit(_BLOCK)),
    )
    flags = F.split(F.aggregate(parts, begun(None), block)["flags"], "")
    return F.array_join(F.zip_with(pieces, flags, lambda p, flag: F.when(flag == "1", p).otherwise("")), "")


def resolve_refs(content: Column) -> Column:
    """``{{< ref "p#a" >}}`` becomes ``[p#a](p.md#a)``; ``.md`` is appended once."""
    pattern = r'\{\{<\s*(?:ref|relref)\s+"([^"#]*?)(?:\.md)?(#[^"]*)?"\s*>\}\}'
    return F.regexp_replace(content, pattern, "[$1$2]($1.md$2)")


def ref_targets(content: Column, path: Column) -> Column:
    """Array of ``struct(ref_kind, ref, target)``; relative references start at the page's folder."""
    kinds = F.regexp_extract_all(content, F.lit(REF_PATTERN), F.lit(1))
    refs = F.regexp_extract_all(content, F.lit(REF_PATTERN), F.lit(2))

    def resolve(kind: Column, ref: Column) -> Column:
        bare = F.regexp_replace(ref, r"#.*$", "")
        file = F.when(bare.endswith(".md"), bare).otherwise(F.concat(bare, F.lit(".md")))
        base = F.when(kind == "relref", tx.parent_dir(path)).otherwise(F.lit(""))
        return F.struct(
            kind.alias("ref_kind"), ref.alias("ref"), tx.join_path(base, file).alias("target")
        )

    return F.zip_with(kinds, refs, resolve)


# --- HTML -------------------------------------------------------------------

# Character references by name, from the standard library's HTML 4 table.
_ENTITIES = {name: chr(point) for name, point in html.entities.name2codepoint.items()}
_ENTITIES["apos"] = "'"
def _entity_map() -> Column:
    """A constant: no reference contains the separators."""
    return F.str_to_map(F.lit("\n".join(f"{name}\t{char}" for name, char in _ENTITIES.items())), F.lit("\n"), F.lit("\t"))


def decode_entities(content: Column) -> Column:
    """Named (HTML 4) and numeric character references, each decoded once, left to right."""

    def decode(piece: Column) -> Column:
        ref = F.regexp_extract(piece, r"^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});", 1)
        rest = F.substr(piece, F.length(ref) + 2)
        # conv() keeps every numeric reference inside four bytes.
        point = F.when(
            F.lower(F.substr(ref, F.lit(1), F.lit(2))) == "#x", F.upper(F.substr(ref, F.lit(3)))
        ).when(F.substr(ref, F.lit(1), F.lit(1)) == "#", F.conv(F.substr(ref, F.lit(2)), 10, 16))
        number = F.conv(point, 16, 10).cast("bigint")
        valid = (number > 0) & (number <= 0x10FFFF) & ~number.between(0xD800, 0xDFFF)
        numeric = F.decode(F.unhex(F.lpad(point, 8, "0")), "UTF-32")
        return (
            F.when(ref == "", F.concat(F.lit("&"), piece))
            .when(ref == "amp", F.concat(F.lit("&"), rest))
            .when(ref == "lt", F.concat(F.lit("<"), rest))
            .when(ref == "gt", F.concat(F.lit(">"), rest))
            .when(ref == "quot", F.concat(F.lit('"'), rest))
            .when(point.isNotNull(), F.concat(F.when(valid, numeric).otherwise(F.lit("�")), rest))
            .otherwise(
                F.coalesce(F.concat(F.element_at(_entity_map(), ref), rest), F.concat(F.lit("&"), piece))
            )
        )

    def decoded(c: Column) -> Column:
        return tx.let(
            F.split(c, "&"),
            lambda p: F.concat(
                F.element_at(p, 1), F.array_join(F.transform(F.slice(p, F.lit(2), F.size(p)), decode), "")
            ),
        )

    return tx.let(content, lambda c: F.when(c.contains("&"), decoded(c)).otherwise(c))


# Noncharacters that mark places in a text while it is worked on; a text's own ones are replaced first.
_MARKS = "\ufdd0\ufdd1\ufdd2\ufdd3\ufdd4\ufdd5\ufdd6\ufdd7\ufdd8"
_HREF, _HREF_END, _TEXT, _ANCHOR_END, _ADDRESS_END, _TABLE, _TABLE_END, _TAG, _OFF = _MARKS
# Elements whose body is not text.
RAW_ELEMENTS = ("script", "style", "iframe")
_RAW_OPEN = r"(?i)<({names})(?=[\s>/])[^>]*+(?<!/)>"
_MARKUP = r"<(?!https?:|mailto:)(?:/?[a-zA-Z]|!(?!--)|\?)[^>]*+>"


def html_to_text(content: Column) -> Column:
    """Text of an HTML or mixed markdown page.

    Comments, doctype, instructions and script, style and iframe bodies go; an anchor becomes
    ``text [href]`` (or its href if it has no text), an image its alt text, a table one line; other
    tags are dropped and their text kept. ``<https://…>`` autolinks stay. An anchor, table, comment or body that
    is never closed loses its tag alone (a comment not even that). An anchor inside another one is a dropped tag.

    Tags are cut out once and replaced by marks; pairs of marks are then joined in front of the
    last closing mark only, where each search ends at the next one, so all steps are linear.
    """

    def cleaned(c: Column) -> Column:
        # Plain searches cost a fraction of a pattern's.
        marked = functools.reduce(operator.or_, [c.contains(mark) for mark in _MARKS])
        own = F.when(marked, F.translate(c, _MARKS, "\ufffd" * len(_MARKS))).otherwise(c)
        return decode_entities(F.when(c.contains(">"), _markup_to_text(_without_raw(own))).otherwise(c))

    return tx.let(content, lambda c: F.when(c.rlike("[<&]"), cleaned(c)).otherwise(c))


def _up_to_last(content: Column, mark: str, change) -> Column:
    """``change`` applied up to the last ``mark``; the rest stays."""

    def parts(c: Column) -> Column:
        return tx.let(
            F.length(c) - F.length(F.substring_index(c, mark, -1)),
            lambda n: F.concat(change(F.left(c, n)), F.substr(c, n + 1)),
        )

    return tx.let(content, lambda c: F.when(c.contains(mark), parts(c)).otherwise(c))


def _bound(change, *settings):
    return lambda c: change(c, *settings)


def _without_raw(content: Column) -> Column:
    """Comments and the bodies of raw elements out, whichever begins first.

    Openings behind the last end of their kind are disarmed by a mark, so that no search runs to the end of the text.
    """

    def disarmed(c: Column, opening: str, start: str, end: str, instead: str) -> Column:
        head = F.regexp_extract(c, r"^[\s\S]*" + end, 0)
        rest = tx.let(head, lambda h: F.concat(h, F.regexp_replace(F.substr(c, F.length(h) + 1), start, instead)))
        return F.when(F.lower(c).contains(opening), rest).otherwise(c)

    out = tx.let(content, lambda c: disarmed(c, "<!--", "<!--", "-->", f"<{_OFF}!--"))
    for name in RAW_ELEMENTS:
        start, end = rf"(?i)<(?={name}[\s>/])", rf"(?i:</{name}\s*>)"
        out = tx.let(out, _bound(disarmed, f"<{name}", start, end, f"<{_OFF}"))
    pattern = r"<!--[\s\S]*?-->|" + _RAW_OPEN.format(names="|".join(RAW_ELEMENTS)) + r"[\s\S]*?</\1\s*>"
    return tx.let(
        out, lambda c: F.when(c.contains("<!--") | c.rlike(r"(?i)<(?:script|style|iframe)"), F.regexp_replace(c, pattern, "")).otherwise(c)
    )


def _attribute(tag: Column, name: str) -> Column:
    """Value of an attribute: in double or single quotes, or bare; null if it is absent."""
    start = rf"(?i)^[^>]*?[\s\"']{name}\s*=\s*"
    value = F.regexp_extract(tag, start + r"(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", 0)
    inner = F.regexp_replace(value, start, "")
    return F.when(value != "", F.when(inner.rlike("^[\"']"), F.substr(inner, F.lit(2), F.length(inner) - 2)).otherwise(inner))


def _marked(tag: Column) -> Column:
    """What stands for a tag: marks of anchors and tables, an image's text, or the mark of a dropped tag."""

    def of(name: Column) -> Column:
        anchor = tx.let(_attribute(tag, "href"), lambda href: F.coalesce(F.concat(F.lit(_HREF), href, F.lit(_HREF_END)), F.lit(_TAG)))
        return (
            F.when(name == "a", anchor)
            .when(name == "/a", _ANCHOR_END)
            .when(name == "img", F.coalesce(_attribute(tag, "alt"), F.lit("")))
            .when(name == "table", _TABLE)
            .when(name == "/table", _TABLE_END)
            .otherwise(_TAG)
        )

    return tx.let(F.lower(F.regexp_extract(tag, "^<" + _OFF + r"?(/?[a-zA-Z][^\s/>]*)", 1)), of)


def _markup_to_text(content: Column) -> Column:
    markup = _MARKUP.replace("<", f"<{_OFF}?", 1)

    def of(c: Column) -> Column:
        texts = F.split(c, markup)
        tags = F.transform(F.regexp_extract_all(c, F.lit(markup), F.lit(0)), _marked)
        return F.array_join(F.flatten(F.zip_with(texts, tags, lambda t, m: F.array(t, F.coalesce(m, F.lit(""))))), "")

    out = _up_to_last(content, ">", of)
    out = _up_to_last(out, _ANCHOR_END, _anchors)
    # What is left of anchors has no partner.
    out = tx.let(
        out,
        lambda c: F.when(
            c.contains(_HREF) | c.contains(_ANCHOR_END), F.regexp_replace(c, f"{_HREF}[^{_HREF_END}]*+{_HREF_END}|{_ANCHOR_END}", _TAG)
        ).otherwise(c),
    )
    out = _up_to_last(out, _TABLE_END, _flat_tables)
    for mark in (_TAG, _OFF, _TABLE, _TABLE_END):
        out = F.replace(out, F.lit(mark), F.lit(""))
    return out


def _anchors(content: Column) -> Column:
    """Every opening mark with the next closing one; whitespace around the text goes."""
    opening = f"{_HREF}[^{_HREF_END}]*+{_HREF_END}"
    pair = f"{_HREF}([^{_HREF_END}]*+){_HREF_END}([^{_ANCHOR_END}]*+){_ANCHOR_END}"
    out = F.regexp_replace(content, pair, f"{_TEXT}$2{_ANCHOR_END}$1{_ADDRESS_END}")
    # Openings that are left stand inside an anchor.
    out = F.regexp_replace(out, opening, _TAG)
    gap, address = rf"[\s{_TAG}]*+", f"{_ANCHOR_END}([^{_ADDRESS_END}]*+){_ADDRESS_END}"
    out = F.regexp_replace(out, f"{_TEXT}{gap}{address}", "$1")
    out = F.regexp_replace(out, f"{_TEXT}{gap}", "")
    return F.regexp_replace(out, rf"(?<![\s{_TAG}]){gap}{address}", " [$1]")


def _flat_tables(content: Column) -> Column:
    """Text between table marks as one line in which tags are spaces."""

    def flat(part: Column) -> Column:
        def of(at: Column) -> Column:
            inside = F.translate(F.substr(part, at + 1), _MARKS, " " * len(_MARKS))
            return F.when(at > 0, F.concat(F.left(part, at - 1), tx.collapse_ws(inside))).otherwise(part)

        return tx.let(F.instr(part, _TABLE), of)

    # What stands behind the last mark is empty here.
    return F.array_join(F.transform(F.split(content, _TABLE_END), flat), "")


# --- front matter -----------------------------------------------------------

# The opening mark and the two closing marks.
FRONT_MATTER_OPEN = "---"
FRONT_MATTER_CLOSE = ("\n---", "\n...")
_NEWLINES = "\r\n"
_ENTRY = r"(?m)^[^\s#][^\n]*(?:\n(?:[ \t]|-[ \t])[^\n]*)*+"


def _parts(content: Column) -> Column:
    """``struct<front_matter, body>``, null fields without a closed leading block.

    Plain string searches: a front matter block is found without running a pattern over the text.
    """
    lead = F.ltrim(content, F.lit(_NEWLINES))

    def cut(rest: Column) -> Column:
        at = [F.instr(rest, mark) for mark in FRONT_MATTER_CLOSE]
        end = F.least(*[F.when(i > 0, i) for i in at])
        block = F.btrim(F.substr(rest, F.lit(1), end - 1), F.lit(_NEWLINES))
        below = F.ltrim(F.substr(rest, end + 4), F.lit(_NEWLINES))
        return F.struct(block.alias("front_matter"), below.alias("body"))

    opened = tx.let(F.ltrim(F.substr(lead, F.lit(4)), F.lit(_NEWLINES)), cut)
    return F.when(lead.startswith(FRONT_MATTER_OPEN), opened)


def has_front_matter(content: Column) -> Column:
    return _parts(content)["front_matter"].isNotNull()


def front_matter(content: Column) -> Column:
    """Raw block between the markers, null without one."""
    return _parts(content)["front_matter"]


def body(content: Column) -> Column:
    return F.coalesce(_parts(content)["body"], content)


def _entries(block: Column) -> Column:
    """Top-level entries, each with its indented continuation lines."""
    return F.regexp_extract_all(tx.unix_lines(block), F.lit(_ENTRY), F.lit(0))


def _entry_key(entry: Column) -> Column:
    return F.regexp_replace(F.trim(F.substring_index(entry, ":", 1)), r"^[\"']|[\"']$", "")


_PAIR = r"^[^:\n]+:(?:\s|$)"


def _head_value(entry: Column) -> Column:
    """What stands behind the colon."""
    return tx.trim_ws(F.regexp_replace(entry, r"^[^:\n]+:", ""))


def _unquoted(raw: Column) -> Column:
    """A quoted value's inside; of other values what stands before a comment."""
    plain = F.regexp_replace(raw, r"(?:^|\s+)#[^\n]*$", "")
    return F.when(raw.rlike(r"^([\"'])[^\n]*\1$"), F.substr(raw, F.lit(2), F.length(raw) - 2)).otherwise(plain)


# How null, lists and maps are shown.
_NULL, _LIST, _MAP = "<nil>", ("[", "]"), ("map[", "]")
_FLOW_ITEM = r"\"[^\"]*+\"|'[^']*+'|[^,\s\"'][^,]*+"


def _scalar(raw: Column) -> Column:
    value = _unquoted(raw)
    quoted = raw.rlike(r"^[\"']")
    return (
        F.when(~quoted & value.isin("", "~", "null", "Null", "NULL"), F.lit(_NULL))
        .when(~quoted & value.isin("True", "TRUE", "False", "FALSE"), F.lower(value))
        .otherwise(value)
    )


def _shown_list(items: Column) -> Column:
    return F.concat(F.lit(_LIST[0]), F.array_join(F.transform(items, _scalar), " "), F.lit(_LIST[1]))


def _shown_map(items: Column) -> Column:
    """Entries by key, the last one of a key."""
    pairs = F.transform(items, lambda e: F.struct(_entry_key(e).alias("key"), _scalar(_head_value(e)).alias("value")))
    last = F.filter(
        pairs, lambda p, i: F.forall(F.slice(pairs, i + 2, F.size(pairs)), lambda later: later["key"] != p["key"])
    )
    shown = F.transform(F.array_sort(last), lambda p: F.concat(p["key"], F.lit(":"), p["value"]))
    return F.concat(F.lit(_MAP[0]), F.array_join(shown, " "), F.lit(_MAP[1]))


def _nested_value(entry: Column) -> Column:
    """A scalar, or a list or map of scalars as blocks or in brackets; deeper or folded values stay raw."""
    lines = F.filter(
        F.slice(F.split(entry, "\n"), F.lit(2), F.size(F.split(entry, "\n"))), lambda line: ~line.rlike(r"^\s*(?:#|$)")
    )
    level = F.size(F.array_distinct(F.transform(lines, lambda line: F.regexp_extract(line, r"^[ \t]*", 0)))) <= 1

    def shown(parts: Column) -> Column:
        head, items = parts["head"], parts["items"]
        bare = F.transform(items, lambda i: tx.trim_ws(F.substr(i, F.lit(2), F.length(i))))
        inside = F.regexp_extract_all(F.substr(head, F.lit(2), F.length(head) - 2), F.lit(_FLOW_ITEM), F.lit(0))
        flow = F.transform(inside, tx.trim_ws)
        # An item is a scalar unless it opens another list or map.
        scalars = F.forall(bare, lambda i: ~i.rlike(r"^(?:[\[{|>]|-\s)|^[^\"'][^:]*:(?:\s|$)"))
        values = F.forall(items, lambda i: i.rlike(_PAIR) & ~i.rlike(r"^-\s") & ~_head_value(i).rlike(r"^[\[{|>]"))
        flat = ~F.substr(head, F.lit(2), F.length(head) - 2).rlike(r"[\[\]{}]")
        block = (head == "") & parts["level"]
        return (
            F.when(F.size(items) == 0, F.when(head.rlike(r"^\[[\s\S]*\]$") & flat, _shown_list(flow))
                   .when(head.rlike(r"^\{[\s\S]*\}$") & flat & F.forall(flow, lambda i: i.rlike(_PAIR)), _shown_map(flow))
                   .otherwise(_scalar(head)))
            .when(block & F.forall(items, lambda i: i.rlike(r"^-(?:\s|$)")) & scalars, _shown_list(bare))
            .when(block & values, _shown_map(items))
            .otherwise(_unquoted(parts["raw"]))
        )

    head = _head_value(F.substring_index(entry, "\n", 1))
    return tx.let(
        F.struct(
            F.regexp_replace(head, r"^#.*$|(?<=[\]}])\s+#.*$", "").alias("head"),
            F.transform(lines, tx.trim_ws).alias("items"),
            level.alias("level"),
            _head_value(entry).alias("raw"),
        ),
        shown,
    )


def front_matter_map(block: Column, nested: bool = False) -> Column:
    """``key: value`` entries as a string map (last entry of a key wins); malformed → null.

    Flat values are taken as they stand; ``nested`` reads lists and maps of scalars too.
    """
    value = _nested_value if nested else lambda entry: _unquoted(_head_value(entry))

    def pair(entry: Column) -> Column:
        return F.struct(_entry_key(entry).alias("key"), value(entry).alias("value"))

    def last_per_key(pairs: Column) -> Column:
        keys = F.array_distinct(F.transform(pairs, lambda p: p["key"]))
        return F.map_from_arrays(
            keys,
            F.transform(
                keys, lambda k: F.element_at(F.filter(pairs, lambda p: p["key"] == k), -1)["value"]
            ),
        )

    return tx.let(
        _entries(block),
        lambda entries: F.when(
            F.forall(entries, lambda e: e.rlike(_PAIR)), tx.let(F.transform(entries, pair), last_per_key)
        ),
    )


def inject_source_url(content: Column, url: Column) -> Column:
    """Set ``source_url`` in the front matter, creating the block if there is none.

    Entries are written sorted by key. A malformed block stays in the text below
    a new block. An empty URL leaves the content alone.
    """

    def rebuild(parts: Column, entries: Column) -> Column:
        usable = F.coalesce(F.forall(entries, lambda e: e.rlike(_PAIR)), F.lit(False))
        kept = F.when(usable, F.filter(entries, lambda e: _entry_key(e) != "source_url")).otherwise(
            F.array().cast("array<string>")
        )
        lines = F.array_sort(F.concat(kept, F.array(F.concat(F.lit("source_url: "), url))))
        rest = F.when(usable, parts["body"]).otherwise(content)
        return F.concat(
            F.lit("---\n"), F.array_join(lines, "\n"), F.lit("\n---\n"),
            F.when(rest != "", F.concat(rest, F.lit("\n"))).otherwise(F.lit("")),
        )

    rebuilt = tx.let(
        _parts(content),
        lambda parts: tx.let(_entries(parts["front_matter"]), lambda entries: rebuild(parts, entries)),
    )
    return F.when(url.isNull() | (url == ""), content).otherwise(rebuilt)


def source_url(path: Column, base_url: str) -> Column:
    """Public address of a page; ``index`` and ``_index`` pages stand for their folder."""
    page = F.regexp_replace(path, r"\.md$", "")
    page = F.regexp_replace(page, r"(^|/)_index$", "")
    page = F.regexp_replace(page, r"(^|/)index$", "")
    joined = F.concat(F.lit(base_url.rstrip("/") + "/"), page)
    return F.when(joined.endswith("/"), joined).otherwise(F.concat(joined, F.lit("/")))

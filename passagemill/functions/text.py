"""Text and path expressions. Everything here is a plain Column expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: characters with the Unicode White_Space property.
WHITE = (
    " \t\n\u000b\u000c\r\u0085\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# The same set; measured three times as fast as the explicit class.
WHITESPACE = r"(?U)\s+"


def words(text: Column) -> Column:
    """Whitespace-separated words without empty entries."""
    # After trimming, only an empty text leaves an empty entry.
    return F.array_remove(F.split(trim_ws(text), WHITESPACE), "")


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body``.

    Higher-order functions are interpreted without common-subexpression
    elimination, so an expensive value used twice is bound through a one-element array.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def trim_ws(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITE))


def collapse_ws(text: Column) -> Column:
    return trim_ws(F.regexp_replace(text, WHITESPACE, " "))


def unix_lines(text: Column) -> Column:
    return F.replace(text, F.lit("\r\n"), F.lit("\n"))


def byte_size(text: Column) -> Column:
    return F.octet_length(text).cast("bigint")


def token_estimate(text: Column) -> Column:
    """A quarter of the UTF-8 byte length, rounded down."""
    return F.floor(F.octet_length(text) / 4).cast("bigint")


def clean_path(path: Column) -> Column:
    """Drop ``.`` segments and fold ``..`` into its parent."""
    folded = F.aggregate(
        F.split(path, "/"),
        F.array().cast("array<string>"),
        lambda done, seg: F.when((seg == "") | (seg == "."), done)
        .when(seg == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))))
        .otherwise(F.concat(done, F.array(seg))),
    )
    return F.array_join(folded, "/")


def parent_dir(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def join_path(base: Column, rest: Column) -> Column:
    return clean_path(F.concat(base, F.lit("/"), rest))


def is_markdown(path: Column, any_case: bool = True) -> Column:
    return path.rlike(r"(?i)\.(md|markdown)$" if any_case else r"\.(md|markdown)$")

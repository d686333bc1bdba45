"""Small helpers the corpus operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagemill.functions import text as tx

LONGS = "array<bigint>"
BLOCK = 128


def packed(docs: DataFrame) -> DataFrame:
    """All columns as one struct ``row``, so that working columns never clash with a table's own."""
    return docs.select(F.struct("*").alias("row"))


def unpacked(columns: list[str], added: list[str], row: str = "row") -> list[Column]:
    """The table's columns and then the operator's; of two equal names the operator's stays."""
    taken = {name.lower() for name in added}
    kept = [F.col(row).getField(name).alias(name) for name in columns if name.lower() not in taken]
    return kept + [F.col(name) for name in added]


def running_sums(values: Column) -> Column:
    """Sums up to and including each entry, in blocks so that long arrays stay near linear."""

    def within(block: Column) -> Column:
        return F.aggregate(
            block,
            F.array().cast(LONGS),
            lambda done, x: F.concat(done, F.array(x + F.coalesce(F.get(done, F.size(done) - 1), F.lit(0).cast("bigint")))),
        )

    def joined(sums: Column) -> Column:
        def moved(totals: Column) -> Column:
            def by(s: Column, b: Column) -> Column:
                before = F.coalesce(F.get(totals, b - 1), F.lit(0).cast("bigint"))
                return tx.let(before, lambda base: F.transform(s, lambda v: v + base))

            return F.flatten(F.transform(sums, by))

        return tx.let(within(F.transform(sums, lambda s: F.get(s, F.size(s) - 1))), moved)

    def summed(numbers: Column) -> Column:
        blocks = F.transform(
            F.sequence(F.lit(0), F.floor((F.size(numbers) - 1) / BLOCK).cast("int")),
            lambda b: F.slice(numbers, b * BLOCK + 1, F.lit(BLOCK)),
        )
        return F.when(F.size(numbers) > 0, tx.let(F.transform(blocks, within), joined)).otherwise(F.array().cast(LONGS))

    return tx.let(values.cast(LONGS), summed)


SPANS = "array<struct<start:bigint,end:bigint,hit:string,before:string,after:string>>"


def spans(text: Column, pattern: str, context: int) -> Column:
    """A pattern's leftmost matches as :data:`SPANS`, in code points, with up to ``context`` characters before and one after.

    The gaps that a split leaves and the matches themselves alternate, so running sums
    of their lengths are the positions. Each is made once per text: inside a lambda it would be made again for every match.
    """

    def tail(piece: Column) -> Column:
        return F.substring(piece, -context, context)

    def placed(hits: Column, gaps: Column, tails: Column) -> Column:
        steps = F.transform(
            hits, lambda hit, i: F.length(F.get(gaps, i)) + F.when(i > 0, F.length(F.get(hits, i - 1))).otherwise(0)
        )

        def entry(at: Column, i: Column) -> Column:
            hit, gap = F.get(hits, i), F.get(tails, i)
            earlier = F.transform(
                F.sequence(F.greatest(i - context, F.lit(0)), i - 1), lambda j: F.concat(F.get(tails, j), tail(F.get(hits, j)))
            )
            near = (i == 0) | (F.length(gap) == context)
            before = F.when(near, gap).otherwise(tail(F.concat(F.array_join(earlier, ""), gap)))
            after = F.substring(F.concat(F.get(gaps, i + 1), F.coalesce(F.get(hits, i + 1), F.lit(""))), 1, 1)
            return F.struct(
                at.alias("start"), (at + F.length(hit)).alias("end"), hit.alias("hit"), before.alias("before"), after.alias("after")
            )

        return F.transform(running_sums(steps), entry)

    def split(hits: Column) -> Column:
        cut = tx.let(F.split(text, pattern, -1), lambda gaps: tx.let(F.transform(gaps, tail), lambda tails: placed(hits, gaps, tails)))
        return F.when(F.size(hits) > 0, cut).otherwise(F.array().cast(SPANS))

    return tx.let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), split)

"""Mixing sources to target weights by repeating and thinning documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passagemill.llm.rows import packed, unpacked
from passagemill.session import cut_lineage

WEIGHTS = (1, 2, 3)
MOST = 3
SEEDS = 16
WORD_GAP = r"[\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    """Words between ASCII white space; 0 for null."""
    parts = F.split(text, WORD_GAP)
    blank = F.lit(0)
    first = F.when(F.get(parts, F.lit(0)) == "", 1).otherwise(blank)
    last = F.when((F.size(parts) > 1) & (F.get(parts, F.size(parts) - 1) == ""), 1).otherwise(blank)
    return F.when(text.isNull(), 0).otherwise(F.size(parts) - first - last).cast("bigint")


def draw(doc_id: Column, seed: int) -> Column:
    """A number below 2**32 from the id's digest; the seed says where in the digest it is read."""
    digest = F.md5(F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(digest, seed + 1, 8), 16, 10).cast("bigint")


def source_targets(sizes: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """``source, source_size, target`` of a table ``source, size``: one row per source.

    Sources in code point order, null last, weigh ``weights`` in turn and share the whole size. No
    target is above ``most`` times its source's size; what is left over goes to the others by weight.
    With sources in order of size per weight, the capped ones are a prefix, and the common share
    is the largest one that any prefix gives. The two windows see one row per source.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    weight = F.get(F.array(*[F.lit(w) for w in weights]), turn).cast("bigint")
    ordered = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    shares = (
        totals.withColumn("weight", weight)
        .withColumn("total", F.sum("source_size").over(everything))
        .withColumn("weights", F.sum("weight").over(everything))
        .withColumn("rest", F.col("total") - most * F.coalesce(F.sum("source_size").over(before), F.lit(0)))
        .withColumn("open", F.col("weights") - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn(
            "best",
            F.max(F.struct((F.col("rest") / F.col("open")).alias("share"), "rest", "open")).over(everything),
        )
    )
    share = F.col("weight") * F.col("best.rest") / F.col("best.open")
    return shares.select(
        "source", "source_size", F.least((most * F.col("source_size")).cast("double"), share).alias("target")
    )


def _copies(rate: Column, doc_id: Column, seed: int) -> Column:
    whole = F.floor(rate)
    return (whole + F.when(draw(doc_id, seed) < (rate - whole) * float(2**32), 1).otherwise(0)).cast("bigint")


def mix(docs: DataFrame, weights=WEIGHTS, most: int = MOST, seeds: int = SEEDS) -> DataFrame:
    """``docs`` with ``size, source_size, target, copies, taken`` per row.

    A row's rate is its source's target over the source's size. It is taken floor(rate) times, and
    once more where a number hashed from its doc_id is below the fraction. For each source the seed
    of that hash is the one of ``seeds`` that comes nearest to the target (the smallest of equals),
    summed in one pass, so reruns agree and small sources are hit well too.

    Null texts and texts without words have size 0 and a source of size 0 gets rate 0. Null sources
    are a source of their own, the last. Rows with one doc_id share their draw, so equal rows are taken equally often;
    a null id draws as an empty one. An empty table stays empty; of columns named like the results the results stay. Of a
    text only its number of words goes on. Only narrow rows (id, source, size) are aggregated; the per-source figures are one
    row per source, and hot sources are summed before the exchange.
    """
    wide = packed(docs)
    doc_id, source = F.col("row.doc_id"), F.col("row.source")
    sizes = cut_lineage(wide.select(doc_id.alias("doc_id"), source.alias("source"), n_words(F.col("row.text")).alias("size")))
    targets = cut_lineage(
        source_targets(sizes, weights, most).withColumn(
            "rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
        )
    )
    renamed = targets.withColumnRenamed("source", "of_source")
    same = F.col("source").eqNullSafe(F.col("of_source"))
    tried = [F.sum(F.col("size") * _copies(F.col("rate"), F.col("doc_id"), j)).alias(f"s{j}") for j in range(seeds)]
    missed = F.array(*[F.struct(F.abs(F.col(f"s{j}") - F.col("target")).alias("by"), F.lit(j).alias("seed")) for j in range(seeds)])
    chosen = (
        sizes.join(renamed, same)
        .groupBy("of_source")
        .agg(F.first("target").alias("target"), *tried)
        .select(F.col("of_source").alias("seed_of"), F.array_min(missed)["seed"].alias("seed"))
    )
    plan = cut_lineage(renamed.join(chosen, F.col("of_source").eqNullSafe(F.col("seed_of"))).drop("seed_of"))
    seeded = F.coalesce(*[F.when(F.col("seed") == j, _copies(F.col("rate"), doc_id, j)) for j in range(seeds)])
    added = ["size", "source_size", "target", "copies", "taken"]
    out = (
        wide.withColumn("size", n_words(F.col("row.text")))
        .join(plan, source.eqNullSafe(F.col("of_source")), "left")
        .withColumn("copies", seeded)
        .withColumn("taken", F.col("size") * F.col("copies"))
    )
    return out.select(*unpacked(docs.columns, added))


def emit(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """Each row of ``mix`` as often as it is taken."""
    repeats = F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))
    return mixed.filter("copies > 0").withColumn("_copy", repeats).select(*columns)

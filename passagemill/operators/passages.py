"""Which documents contain which passages, and the sieve that keeps rows without a partner out of shuffles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passagemill.functions import text as tx
from passagemill.session import cut_lineage

#: Bits of a sieve, whatever it holds: at most 262,144 rows of 64, some 20 MB as the hash table that is sent.
SIEVE_BITS = 1 << 24
#: Words of a run, and characters of a gram.
RUN = 4
GRAM = 3


def sieve(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """``rows`` without most of those whose ``key`` is not in ``wanted``; none that is in it goes.

    A bitmap of the wanted keys' hashes is joined to the rows where they are, in front of any
    shuffle. Its size is fixed: with more keys than bits it lets more rows through, the result of a join behind it stays the
    same. (An inner join: a semi join would be moved in front of the sieve.)
    """
    place = F.pmod(F.xxhash64(F.col(key)), F.lit(SIEVE_BITS))
    marks = (
        wanted.select(place.alias("_place"))
        .groupBy(F.shiftright("_place", 6).alias("_cell"))
        .agg(F.expr("bit_or(shiftleft(1L, cast(_place % 64 as int)))").alias("_bits"))
    )
    marked = rows.withColumn("_place", place).withColumn("_cell", F.shiftright("_place", 6))
    hit = marked.join(F.broadcast(marks), "_cell").filter("shiftright(_bits, cast(_place % 64 as int)) & 1 = 1")
    return hit.select(*rows.columns)


def _runs(words: Column, first: int, spare: int) -> Column:
    """Hashes of the runs of ``RUN`` words from word ``first`` on that end ``spare`` words before the last."""

    def of(w: Column) -> Column:
        last = F.size(w) - RUN - spare
        starts = F.when(last >= first, F.sequence(F.lit(first), last)).otherwise(F.array().cast("array<int>"))
        return F.array_distinct(F.transform(starts, lambda i: F.xxhash64(*[F.get(w, i + n) for n in range(RUN)])))

    return tx.let(words, of)


def _grams(word: Column, length: Column) -> Column:
    starts = F.sequence(F.lit(1), F.greatest(F.length(word) - length + 1, F.lit(1)))
    return F.array_distinct(F.transform(starts, lambda i: F.substr(word, i, length)))


def _rarest(asked: DataFrame, hits: DataFrame, key: str) -> DataFrame:
    """The least frequent key of each passage; one that nothing holds comes first."""
    counts = hits.groupBy(key).agg(F.count("*").alias("_n"))
    rare = Window.partitionBy("id").orderBy(F.coalesce("_n", F.lit(0)), key)
    return asked.join(counts, key, "left").withColumn("_place", F.row_number().over(rare)).filter("_place = 1").select("id", key)


def _by_runs(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """Candidates of passages with a run of inner words, which stand as they are in any text around them."""
    asked = cut_lineage(passages.select("id", F.explode(_runs(tx.words(F.col("text")), 1, 1)).alias("run")))
    held = docs.select("path", F.explode(_runs(tx.words(F.col("content")), 0, 0)).alias("run"))
    hits = cut_lineage(sieve(held, "run", asked))
    return hits.join(_rarest(asked, hits, "run"), "run").select("id", "path")


def _by_grams(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """Candidates of short passages: their longest word is part of a word of the text.

    The words that hold it are found by a gram index of the corpus's distinct words, then the documents of those words.
    """
    words = tx.words(F.col("text"))
    longest = F.array_max(F.transform(words, lambda w: F.struct(F.length(w).alias("n"), w.alias("word"))))["word"]
    pieces = passages.select("id", longest.alias("piece"))
    grams = F.explode(_grams(F.col("piece"), F.least(F.length("piece"), F.lit(GRAM)))).alias("gram")
    asked = cut_lineage(pieces.select("id", "piece", grams))
    said = docs.select("path", F.explode(F.array_distinct(tx.words(F.col("content")))).alias("word"))
    indexed = said.select("word").distinct().select(
        "word", F.explode(F.flatten(F.array(*[_grams(F.col("word"), F.lit(n)) for n in range(1, GRAM + 1)]))).alias("gram")
    )
    hits = cut_lineage(sieve(indexed, "gram", asked))
    rare = _rarest(asked, hits, "gram").join(pieces, "id")
    words_met = cut_lineage(hits.join(rare, "gram").filter(F.contains("word", "piece")).select("id", "word").distinct())
    return sieve(said, "word", words_met).join(words_met, "word").select("id", "path")


def find_passages(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """``id, path`` of every document ``(path, content)`` whose text contains the passage ``(id, text)``.

    A passage of six words or more is looked up by its rarest run of inner words, a shorter one by its longest
    word; then the texts of the candidates are read. Passages without a word are found nowhere.
    """
    n_words = F.size(tx.words(F.col("text")))
    known = passages.filter(n_words > 0)
    candidates = _by_runs(docs, known.filter(n_words >= RUN + 2))
    short = known.filter(n_words < RUN + 2)
    if not short.isEmpty():
        candidates = candidates.union(_by_grams(docs, short))
    candidates = cut_lineage(candidates.distinct())
    return (
        sieve(docs.select("path", "content"), "path", candidates)
        .join(candidates, "path").join(known.select("id", "text"), "id")
        .filter(F.contains("content", "text")).select("id", "path")
    )

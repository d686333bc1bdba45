"""Keyword search over an inverted index, and its fusion with vector search.

The index is made of segments of some thousand chunks and a table of terms. A segment is one row: the
chunks' ids and lengths, the segment's terms, and per term the places of the chunks that hold it with their counts.
Terms have their document and inverse document frequency over all segments. A search goes through the
segments where they lie: each is scored against all queries in whole, so only a query's best k chunks of a segment
leave its task, and neither postings nor scored pairs are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passagemill.operators import retrieve
from passagemill.session import cut_lineage, settings
from passagemill.sources.blocks import read_blocks, write_blocks

# BM25's saturation and length norm, and the constant of rank fusion.
K1, B = 1.2, 0.75
RRF_K = 60
FETCH_FACTOR = 3
#: Contributions are whole billionths, so that sums do not depend on their order.
_UNIT = 1_000_000_000
#: Chunks and words of a segment, at most (one chunk may have more words), queries read and postings scored at a time.
SEGMENT_CHUNKS, SEGMENT_WORDS = 2048, 1 << 20
QUERIES_PER_BLOCK = 512
#: Segments of a file, at most: they may be megabytes each, and a scan decodes thousands of rows of a file at once.
SEGMENTS_PER_FILE = 16
_FILES = {"maxRecordsPerFile": SEGMENTS_PER_FILE}
_POSTINGS_PER_STEP = 1 << 20


def terms_of(text: Column) -> Column:
    """Runs of letters and digits in lower case."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def _cuts(lengths: np.ndarray, chunks: int, words: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows within both limits, of one row at least."""
    ends = np.cumsum(lengths)
    start = 0
    while start < len(lengths):
        within = np.searchsorted(ends, ends[start] - lengths[start] + words, side="right")
        end = max(start + 1, min(start + chunks, int(within)))
        yield start, end
        start = end


def _segment(rows) -> list:
    """Columns of one segment of ``id, many, words`` rows: its chunks in id order, its postings term by term."""
    import pyarrow as pa
    import pyarrow.compute as pc

    rows = rows.take(pc.sort_indices(rows, sort_keys=[("id", "ascending")], null_placement="at_start"))
    ids, many, words = (rows.column(c).combine_chunks() for c in ("id", "many", "words"))
    lengths = np.asarray(pc.list_value_length(words))
    coded = words.flatten().dictionary_encode()
    postings = coded.indices.to_numpy().astype(np.int64) * len(rows) + np.repeat(np.arange(len(rows)), lengths)
    postings, counts = np.unique(postings, return_counts=True)
    term, place = np.divmod(postings, len(rows))
    sizes = np.bincount(term, minlength=len(coded.dictionary))
    return [ids, many, *(pa.array(v.astype(np.int32)) for v in (lengths, sizes, place, counts)), coded.dictionary]


def _segments(batches: Iterator) -> Iterator:
    import pyarrow as pa
    import pyarrow.compute as pc

    names = ["ids", "many", "lengths", "sizes", "places", "counts", "terms"]
    for batch in batches:
        table = pa.Table.from_batches([batch])
        for start, end in _cuts(np.asarray(pc.list_value_length(batch.column("words"))), SEGMENT_CHUNKS, SEGMENT_WORDS):
            lists = [pa.ListArray.from_arrays([0, len(c)], c) for c in _segment(table.slice(start, end - start))]
            yield pa.RecordBatch.from_arrays(lists, names=names)


@dataclass
class KeywordIndex:
    """``segments (ids, many, lengths, sizes, places, counts, terms)`` and ``terms (term, frequency, idf, mean)``.

    ``many`` marks ids that several chunks have, ``mean`` is the mean length of all chunks.
    """

    segments: DataFrame
    terms: DataFrame

    def write(self, path: str) -> None:
        folder = path.rstrip("/")
        self.segments.write.options(**_FILES).mode("overwrite").parquet(f"{folder}/segments")
        self.terms.write.mode("overwrite").parquet(f"{folder}/terms")


def read_index(spark: SparkSession, path: str) -> KeywordIndex:
    folder = path.rstrip("/")
    return KeywordIndex(spark.read.parquet(f"{folder}/segments"), spark.read.parquet(f"{folder}/terms"))


def build_index(chunks: DataFrame, id_col: str = "chunk_id", text_col: str = "content", path: str | None = None) -> KeywordIndex:
    """Index of a chunk table; chunks without words count in the averages and have no postings.

    Words are counted where the chunks lie, so making postings shuffles nothing but the chunks' ids, of which
    those are looked for that several chunks have. The segments are written once, to ``path`` where it is given,
    else to the checkpoint folder, in files of a few, so that a task that reads them holds a few at a time.
    """
    spark = chunks.sparkSession
    repeated = cut_lineage(chunks.groupBy(F.col(id_col).alias("_id")).agg(F.count("*").alias("_n")).filter("_n > 1").select("_id", F.lit(True).alias("_many")))
    read = chunks.select(F.col(id_col).alias("id"), F.col(text_col).alias("_text")).join(repeated, F.col("id").eqNullSafe(F.col("_id")), "left")
    read = read.select("id", F.coalesce("_many", F.lit(False)).alias("many"), terms_of(F.col("_text")).alias("words"))
    whole = ("lengths", "sizes", "places", "counts")
    schema = T.StructType(
        [T.StructField("ids", T.ArrayType(read.schema["id"].dataType)), T.StructField("many", T.ArrayType(T.BooleanType()))]
        + [T.StructField(c, T.ArrayType(T.IntegerType())) for c in whole]
        + [T.StructField("terms", T.ArrayType(T.StringType()))]
    )
    made = read.mapInArrow(_segments, schema)
    if path is None:
        segments = cut_lineage(made, **_FILES)
    else:
        made.write.options(**_FILES).mode("overwrite").parquet(f"{path.rstrip('/')}/segments")
        segments = spark.read.schema(schema).parquet(f"{path.rstrip('/')}/segments")
    words = F.aggregate("lengths", F.lit(0).cast("bigint"), lambda n, x: n + x)
    sized = segments.agg(F.sum(F.size("lengths")).alias("total"), (F.sum(words) / F.sum(F.size("lengths"))).alias("mean"))
    seen = segments.select(F.inline(F.arrays_zip("terms", "sizes"))).groupBy(F.col("terms").alias("term")).agg(F.sum("sizes").alias("frequency"))
    idf = F.log(1 + (F.col("total") - F.col("frequency") + 0.5) / (F.col("frequency") + 0.5))
    index = KeywordIndex(segments, seen.crossJoin(F.broadcast(sized)).select("term", "frequency", idf.alias("idf"), "mean"))
    if path is None:
        return index
    index.terms.write.mode("overwrite").parquet(f"{path.rstrip('/')}/terms")
    return read_index(spark, path)


class _Scorer:
    """One segment, ready to be scored."""

    def __init__(self, row, mean: float):
        self.ids, self.terms = row["ids"], row["terms"]
        self.many = np.asarray(row["many"]).astype(bool)
        lengths, self.sizes, self.places, n = (np.asarray(row[c]) for c in ("lengths", "sizes", "places", "counts"))
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.weight = n * (K1 + 1) / (n + K1 * (1 - B + B * lengths[self.places] / mean))

    def asked(self, terms, idf: np.ndarray, query: np.ndarray, n: int) -> Iterator[tuple]:
        """The asked terms that the segment holds, for as many of the ``n`` queries at a time as have few enough postings."""
        import pyarrow.compute as pc

        at = pc.fill_null(pc.index_in(terms, value_set=self.terms), -1).to_numpy(zero_copy_only=False)
        held = at >= 0
        at, idf, query = at[held], idf[held], query[held]
        postings = np.bincount(query, weights=self.sizes[at], minlength=n).astype(np.int64)
        for first, last in _cuts(postings, n, _POSTINGS_PER_STEP):
            here = slice(*np.searchsorted(query, [first, last]))
            yield first, last, at[here], idf[here], query[here] - first

    def best(self, at: np.ndarray, idf: np.ndarray, query: np.ndarray, k: int, floor: np.ndarray) -> tuple:
        """``query, place, worth`` of the best k chunks per query and of all chunks whose ids others have; raises ``floor`` to the k-th best."""
        n, shape = self.sizes[at], (len(floor), len(self.ids))
        posting = np.arange(n.sum()) + np.repeat(self.starts[at] - (np.cumsum(n) - n), n)
        cell = np.repeat(query, n) * shape[1] + self.places[posting]
        worth = np.floor(np.repeat(idf, n) * self.weight[posting] * _UNIT + 0.5)
        scores = np.bincount(cell, weights=worth, minlength=shape[0] * shape[1]).reshape(shape)
        hit = np.bincount(cell, minlength=shape[0] * shape[1]).reshape(shape) > 0
        keys = np.where(hit & ~self.many, -scores, np.inf)
        taken = retrieve.first_k(keys, k) & np.isfinite(keys) & (-keys >= floor[:, None])
        if shape[1] >= k:
            np.maximum(floor, -np.partition(keys, k - 1, axis=1)[:, k - 1], out=floor)
        query, place = np.nonzero(taken | (hit & self.many))
        return query, place, scores[query, place]


def keyword_search(
    index: KeywordIndex, queries: DataFrame, k: int, *, id_col: str = "chunk_id", query_id: str = "query_id", query_text: str = "question"
) -> DataFrame:
    """The k best chunks per query by BM25: ``query_id, <id>, score, rank``; ties go to the smaller id.

    Only chunks that hold a term of the query are found, and a term counts once however often a query names it. Chunks
    of one id are one chunk with the sum of their scores, rows of one query id likewise; queries without an id find nothing.
    """
    asked = queries.select(F.col(query_id).alias("q"), F.explode(F.array_distinct(terms_of(F.col(query_text)))).alias("term"))
    asked = asked.filter("q is not null").join(index.terms, "term").groupBy("q")
    address = write_blocks(asked.agg(F.max("mean").alias("mean"), F.collect_list("term").alias("terms"), F.collect_list("idf").alias("idfs")))
    schema = T.StructType([
        T.StructField("q", queries.schema[query_id].dataType), T.StructField("id", index.segments.schema["ids"].dataType.elementType),
        T.StructField("worth", T.LongType()), T.StructField("many", T.BooleanType()),
    ])

    def scan(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        floors: dict[int, np.ndarray] = {}
        for batch in batches:
            for row in range(batch.num_rows):
                lists = {c: batch.column(c)[row].values for c in batch.schema.names}
                scorer = None
                for number, block in enumerate(read_blocks(address, QUERIES_PER_BLOCK)):
                    ids, terms, idfs = (block.column(c).combine_chunks() for c in ("q", "terms", "idfs"))
                    scorer = scorer or _Scorer(lists, block.column("mean")[0].as_py())
                    floor = floors.setdefault(number, np.full(len(ids), -np.inf))
                    query = np.repeat(np.arange(len(ids)), np.asarray(pc.list_value_length(terms)))
                    for first, last, *part in scorer.asked(terms.flatten(), idfs.flatten().to_numpy(), query, len(ids)):
                        q, place, worth = scorer.best(*part, k, floor[first:last])
                        found = [ids.take(pa.array(first + q)), scorer.ids.take(pa.array(place)), pa.array(worth.astype(np.int64)), pa.array(scorer.many[place])]
                        yield pa.RecordBatch.from_arrays(found, names=schema.names)

    # A segment may take megabytes: tasks are handed one at a time.
    with settings(queries.sparkSession, spark__sql__execution__arrow__maxRecordsPerBatch="1"):
        found = cut_lineage(index.segments.mapInArrow(scan, schema))
    summed = found.filter("many").groupBy("q", "id").agg(F.sum("worth").alias("worth"))
    total = found.filter("not many").select("q", "id", "worth").unionByName(summed)
    order = Window.partitionBy("q").orderBy(F.desc("worth"), F.asc("id"))
    ranked = total.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select(F.col("q").alias(query_id), F.col("id").alias(id_col), (F.col("worth") / _UNIT).alias("score"), "rank")


def fuse(first: DataFrame, second: DataFrame, k: int, *, id_col: str = "chunk_id", query_id: str = "query_id", constant: int = RRF_K) -> DataFrame:
    """Reciprocal-rank fusion of two ranked lists: the k highest sums of ``1 / (constant + rank)`` per query."""
    keys = [query_id, id_col]
    both = first.select(*keys, F.col("rank").alias("_a")).join(second.select(*keys, F.col("rank").alias("_b")), keys, "full_outer")
    part = [F.coalesce(1 / (constant + F.col(c)), F.lit(0.0)) for c in ("_a", "_b")]
    order = Window.partitionBy(query_id).orderBy(F.desc("score"), F.asc(id_col))
    fused = both.select(*keys, (part[0] + part[1]).alias("score"))
    return fused.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def hybrid_search(
    points: DataFrame,
    queries: DataFrame,
    k: int,
    *,
    id_col: str = "chunk_id",
    vector_col: str = "vector",
    text_col: str = "content",
    query_id: str = "query_id",
    query_vector: str = "query_vector",
    query_text: str = "question",
    carry: Sequence[str] = (),
    index: KeywordIndex | None = None,
) -> DataFrame:
    """Vector search and keyword search, each for three times k, fused by rank: the columns of ``retrieve.top_k``.

    Give the stored ``index`` of the points to save building it.
    """
    fetch = k * FETCH_FACTOR
    index = build_index(points, id_col, text_col) if index is None else index
    dense = retrieve.top_k(points, queries, fetch, "Cosine", id_col=id_col, vector_col=vector_col, query_id=query_id, query_vector=query_vector)
    words = keyword_search(index, queries, fetch, id_col=id_col, query_id=query_id, query_text=query_text)
    fused = fuse(dense, words, k, id_col=id_col, query_id=query_id)
    payload = [c for c in carry if c != id_col]
    if payload:
        fused = fused.join(points.select(id_col, *payload), id_col)
    return fused.select(query_id, id_col, "score", *payload, "rank")

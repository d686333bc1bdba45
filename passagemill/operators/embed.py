"""Embedding a chunk table."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passagemill.functions import text as tx

Embedder = Callable[[Sequence[str]], np.ndarray]

VECTOR_FIELDS = (
    T.StructField("vector", T.ArrayType(T.DoubleType())),
    T.StructField("model", T.StringType()),
    T.StructField("dimensions", T.IntegerType()),
)


def embed_with(
    chunks: DataFrame, embedder: Embedder, model: str, batch_size: int = 256, text_col: str = "content"
) -> DataFrame:
    """Append ``vector, model, dimensions`` computed by ``embedder`` on batches of texts.

    Rows stay with their vectors inside one Arrow batch, so no join by position is
    needed. A wrong number of vectors fails the task. A model that works on columns
    (``append_to``) is asked for them instead and starts no Python worker.
    """
    if hasattr(embedder, "append_to"):
        return embedder.append_to(chunks, model, text_col)
    schema = T.StructType([*chunks.schema.fields, *VECTOR_FIELDS])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            texts = batch.column(text_col).to_pylist()
            parts = []
            for start in range(0, len(texts), batch_size):
                asked = ["" if t is None else t for t in texts[start : start + batch_size]]
                vectors = np.asarray(embedder(asked), dtype=np.float64)
                if vectors.ndim != 2 or len(vectors) != len(asked):
                    raise ValueError(f"embedder returned {vectors.shape} for {len(asked)} texts")
                parts.append(vectors)
            if not parts:
                continue
            matrix = np.vstack(parts)
            n, dims = matrix.shape
            offsets = pa.array(np.arange(0, (n + 1) * dims, dims, dtype=np.int32))
            columns = [
                *batch.columns,
                pa.ListArray.from_arrays(offsets, pa.array(matrix.ravel())),
                pa.array([model] * n),
                pa.array(np.full(n, dims, dtype=np.int32)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema.fields])

    return chunks.mapInArrow(run, schema)


class WordBuckets:
    """Deterministic stand-in model: word counts in md5 buckets, scaled to unit length.

    Tables get their vectors by expressions and Spark's own feature transformers, without Python
    workers; a call with a list of texts gives the same numbers for a few texts at hand.
    """

    def __init__(self, dims: int):
        self.dims = dims

    def append_to(self, texts: DataFrame, model: str, text_col: str) -> DataFrame:
        from pyspark.ml.feature import CountVectorizerModel

        def bucket(word):
            return (F.conv(F.substring(F.md5(word), 1, 8), 16, 10).cast("bigint") % self.dims).cast("string")

        numbers = [str(i) for i in range(self.dims)]
        count = CountVectorizerModel.from_vocabulary(numbers, inputCol="_words", outputCol="_counts")
        words = F.transform(tx.words(F.coalesce(F.col(text_col), F.lit(""))), bucket)
        return _unit_vectors(count.transform(texts.withColumn("_words", words)), texts.columns, model, self.dims)

    def __call__(self, texts: Sequence[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dims))
        for row, text in enumerate(texts):
            for word in text.split():
                out[row, int(hashlib.md5(word.encode()).hexdigest()[:8], 16) % self.dims] += 1
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norms == 0, 1.0, norms)


def md5_bag_of_words(dims: int = 64) -> WordBuckets:
    return WordBuckets(dims)


def _unit_vectors(counted: DataFrame, columns: Sequence[str], model: str, dims: int) -> DataFrame:
    """``_counts`` at unit length as ``vector``, with the model's name and size."""
    from pyspark.ml.feature import Normalizer
    from pyspark.ml.functions import vector_to_array

    scaled = Normalizer(p=2.0, inputCol="_counts", outputCol="_unit").transform(counted)
    return scaled.select(
        *columns, vector_to_array("_unit").alias("vector"), F.lit(model).alias("model"), F.lit(dims).alias("dimensions")
    )


def hashed_vectors(chunks: DataFrame, dims: int = 256, text_col: str = "content") -> DataFrame:
    """Hashed bag-of-words vectors by Spark's own feature transformers (no Python workers)."""
    from pyspark.ml.feature import HashingTF

    words = tx.words(F.coalesce(F.col(text_col), F.lit("")))
    counted = HashingTF(numFeatures=dims, inputCol="_words", outputCol="_counts").transform(chunks.withColumn("_words", words))
    return _unit_vectors(counted, chunks.columns, "hashing-tf", dims)


def dimension_check(vectors: DataFrame, vector_col: str = "vector") -> DataFrame:
    """``n, min_dims, max_dims, consistent`` of a vector table."""
    size = F.size(vector_col)
    return vectors.agg(
        F.count("*").alias("n"), F.min(size).alias("min_dims"), F.max(size).alias("max_dims")
    ).withColumn("consistent", F.col("min_dims") == F.col("max_dims"))

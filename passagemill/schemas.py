"""Explicit schemas of the tables the operators exchange."""

from pyspark.sql import types as T

STRING_MAP = T.MapType(T.StringType(), T.StringType())

DOCUMENT = T.StructType([
    T.StructField("path", T.StringType(), False),
    T.StructField("content", T.StringType()),
    T.StructField("size", T.LongType()),
    T.StructField("source_url", T.StringType()),
])

ELEMENT = T.StructType([
    T.StructField("kind", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("level", T.IntegerType()),
    T.StructField("meta", STRING_MAP),
])

JUDGMENT = T.StructType([
    T.StructField("document_path", T.StringType()),
    T.StructField("grade", T.IntegerType()),
])

QUESTION = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("difficulty", T.StringType()),
    T.StructField("question", T.StringType()),
    T.StructField("relevance", T.ArrayType(JUDGMENT)),
    T.StructField("expected_answer", T.StringType()),
])

CHUNK = T.StructType([
    T.StructField("chunk_id", T.StringType(), False),
    T.StructField("document_path", T.StringType(), False),
    T.StructField("content", T.StringType()),
    T.StructField("metadata", STRING_MAP),
    T.StructField("token_count", T.LongType()),
    T.StructField("chunk_index", T.IntegerType()),
])

POINT = T.StructType([
    T.StructField("point_id", T.StringType(), False),
    T.StructField("chunk_id", T.StringType(), False),
    T.StructField("vector", T.ArrayType(T.FloatType())),
    T.StructField("document_path", T.StringType()),
    T.StructField("content", T.StringType()),
    T.StructField("token_count", T.LongType()),
    T.StructField("chunk_index", T.IntegerType()),
    T.StructField("model", T.StringType()),
    T.StructField("metadata", STRING_MAP),
])

JUDGE_REPLY = T.StructType([
    T.StructField("score", T.DoubleType()),
    T.StructField("reasoning", T.StringType()),
])

TURN = T.StructType([
    T.StructField("conv_id", T.LongType(), False),
    T.StructField("turn", T.LongType(), False),
    T.StructField("user_text", T.StringType()),
    T.StructField("assistant_text", T.StringType()),
])

"""Harmonic packing of tokenised documents into sequences of a fixed capacity."""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from passagemill.llm.rows import packed
from passagemill.session import cut_lineage

CAPACITY = 1024
SEPARATOR = 0
ROWS_PER_BUCKET = 100_000
LEAST_BUCKETS = 1024
PIECES = "start long, length long, ids_crc32 long, doc_tokens long"


def class_counts(capacity: int = CAPACITY) -> list[int]:
    """How many pieces fill a bin, per class: halves down to sixteenths, then ever smaller rests.

    A class of k holds pieces of at most capacity / k ids. Documents are cut so that pieces of the
    first four classes have just that length and fill their bins; only rests up to a sixteenth vary.
    """
    counts = [k for k in (1, 2, 4, 8, 16) if k <= capacity]
    while counts[-1] < capacity:
        counts.append(min(capacity, max(counts[-1] + 1, counts[-1] * 9 // 8)))
    return counts


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(length, k) of the pieces of ``n`` ids in order: whole bins, reciprocal parts, then the rest."""
    counts = class_counts(capacity)
    exact = [k for k in counts if k in (1, 2, 4, 8, 16) and capacity % k == 0]
    pieces = []
    for k in exact:
        times, n = divmod(n, capacity // k)
        pieces += [(capacity // k, k)] * times
    if n:
        pieces.append((n, max(k for k in counts if capacity // k >= n)))
    return pieces


@functools.lru_cache(maxsize=2)
def encoder(name: str):
    """The tokenizer, made once per worker. Its file is one that every worker has."""
    import base64
    import json
    import os

    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(name), "rb") as lines:
        ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}
    # The full tokenizer file beside the ranks names the added tokens, which stand for themselves in any text.
    full = public_tokenizers.path(name.replace(".tiktoken", ".json"))
    added = {}
    if os.path.exists(full):
        with open(full, encoding="utf-8") as file:
            added = {token["content"]: token["id"] for token in json.load(file)["added_tokens"]}
    return tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)


def _pieces_of(ids: np.ndarray, capacity: int) -> Iterator[tuple[int, int, int, int]]:
    at = 0
    for length, k in cut(len(ids), capacity):
        yield at, length, k, zlib.crc32(ids[at : at + length].astype("<u4").tobytes())
        at += length


def tokenize_and_cut(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: ``doc_id, start, length, k, ids_crc32, doc_tokens``. Narrow."""

    def run(batches):
        encode = encoder(tokenizer).encode_to_numpy
        for batch in batches:
            out = []
            for doc_id, null_id, text in zip(batch["doc_id"], batch["null_id"], batch["text"]):
                ids = np.append(encode(text, allowed_special="all"), np.uint32(SEPARATOR)) if text else np.zeros(1, np.uint32)
                owner = None if null_id else doc_id
                out += [(owner, at, n, k, crc, len(ids)) for at, n, k, crc in _pieces_of(ids, capacity)]
            frame = pd.DataFrame(out, columns=["doc_id", "start", "length", "k", "ids_crc32", "doc_tokens"])
            frame["doc_id"] = frame["doc_id"].astype("Int64")
            yield frame

    named = packed(docs).select(
        F.coalesce(F.col("row.doc_id"), F.lit(0)).cast("long").alias("doc_id"),
        F.col("row.doc_id").isNull().alias("null_id"),
        F.coalesce(F.col("row.text"), F.lit("")).alias("text"),
    )
    return named.mapInPandas(run, "doc_id long, start long, length long, k int, ids_crc32 long, doc_tokens long")


def _pack_rest(capacity: int):
    """First fit, longest first, of the pieces that no full bin took: fewer than the sum of the class counts."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
        free: list[int] = []
        bins, offsets = [], []
        for length in frame["length"]:
            at = next((i for i, room in enumerate(free) if room >= length), len(free))
            if at == len(free):
                free.append(capacity)
            bins.append(at)
            offsets.append(capacity - free[at])
            free[at] -= length
        return frame.drop(columns="together").assign(bin=bins, offset=offsets)

    return run


def pack(docs: DataFrame, tokenizer: str = "byte_bpe_50k.tiktoken", capacity: int = CAPACITY) -> DataFrame:
    """Pieces of all documents with their place: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    A document is its ids and a closing separator. It is cut at whole bins, then at halves, quarters,
    eighths and sixteenths of the capacity; the rest goes to the class of the largest count k whose
    share capacity / k holds it. A class's bins take k pieces each: piece number r of its class lies in
    bin r div k. The number is a running count within (class, bucket of the document's hash) plus the
    pieces of lower buckets, so bins are filled independently and no class meets in one task. Full
    bins of the first four classes have no padding, the others little. What is left over at the end,
    fewer pieces than the class counts add up to, is packed by first fit.

    Null and empty texts are one separator. Rows with one doc_id are documents of their own; null ids
    stay null. Equal rows are packed each. A long text is many pieces, which are dealt on their own. An empty table
    gives no rows; other columns are not read. The pieces carry checksums, so ids are made once and never shuffled.
    """
    pieces = cut_lineage(tokenize_and_cut(docs, tokenizer, capacity))
    n_buckets = max(LEAST_BUCKETS, pieces.count() // ROWS_PER_BUCKET)
    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start"), F.lit(n_buckets)).cast("int"))
    sizes = dealt.groupBy("k", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("k").orderBy("bucket")
    offsets = cut_lineage(
        sizes.select(
            "k",
            "bucket",
            (F.sum("n").over(before) - F.col("n")).alias("earlier"),
            F.sum("n").over(Window.partitionBy("k")).alias("in_class"),
        )
    )
    bases = _bin_bases(offsets)
    order = Window.partitionBy("k", "bucket").orderBy("doc_id", "start", "ids_crc32")
    numbered = (
        dealt.withColumn("number", F.row_number().over(order) - 1)
        .join(offsets, ["k", "bucket"])
        .withColumn("number", F.col("number") + F.col("earlier"))
        .withColumn("bin", F.floor(F.col("number") / F.col("k")))
        .withColumn("full", F.col("bin") < F.floor(F.col("in_class") / F.col("k")))
        .withColumn("slot", F.col("number") % F.col("k"))
    )
    numbered = cut_lineage(numbered.drop("bucket", "earlier", "in_class"))
    base = F.coalesce(*[F.when(F.col("k") == k, F.lit(first)) for k, first in bases["of"].items()], F.lit(0))
    whole = numbered.filter("full").withColumn("sequence_id", (base + F.col("bin")).cast("long"))
    exact = F.col("k").isin(*[k for k in (1, 2, 4, 8) if capacity % k == 0])
    even = whole.filter(exact).withColumn("offset", (F.col("slot") * F.col("length")).cast("long"))
    beside = Window.partitionBy("sequence_id").orderBy("slot")
    rests = whole.filter(~exact).withColumn("offset", F.sum("length").over(beside) - F.col("length"))
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    left = numbered.filter("not full").select("doc_id", *columns[1:5], F.lit(0).alias("together"))
    tail = left.groupBy("together").applyInPandas(
        _pack_rest(capacity), f"doc_id long, {PIECES}, bin long, offset long"
    )
    tail = tail.withColumn("sequence_id", F.col("bin") + F.lit(bases["next"]))
    return even.select(*columns).unionByName(rests.select(*columns)).unionByName(tail.select(*columns))


def _bin_bases(offsets: DataFrame) -> dict:
    """First sequence number of each class's full bins, and the first free one. One row per class is read."""
    of, at = {}, 0
    for row in offsets.groupBy("k").agg(F.first("in_class").alias("n")).orderBy("k").collect():
        of[row["k"]] = at
        at += row["n"] // row["k"]
    return {"of": of, "next": at}

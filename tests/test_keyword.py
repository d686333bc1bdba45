"""Keyword and hybrid search against plain Python."""

import collections
import math
import random
import re

import pytest

from passagemill.operators import keyword, retrieve
from passagemill.plans.registry import RETRIEVERS
from passagemill.session import cut_lineage


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def bm25(chunks, queries, k):
    """Every chunk scored for every query; sums in whole billionths."""
    read = {i: words(t) for i, t in chunks}
    mean = sum(map(len, read.values())) / len(read)
    df = collections.Counter(w for ws in read.values() for w in set(ws))
    out = {}
    for q, text in queries:
        scores = collections.Counter()
        for i, ws in read.items():
            tf = collections.Counter(ws)
            for w in set(words(text)) & set(tf):
                idf = math.log(1 + (len(read) - df[w] + 0.5) / (df[w] + 0.5))
                scores[i] += round(idf * (tf[w] * 2.2 / (tf[w] + 1.2 * (0.25 + 0.75 * len(ws) / mean))) * 1e9)
        out[q] = sorted(scores.items(), key=lambda s: (-s[1], s[0]))[:k]
    return out


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(400):
        # "the" and "of" are in nearly every chunk, rare words in a few
        text = rng.choices(["the", "of"], k=rng.randint(0, 30)) + rng.choices(vocabulary, [1 / (n + 1) for n in range(300)], k=rng.randint(0, 40))
        rng.shuffle(text)
        rows.append((f"c{i:03}", " ".join(text).title()))
    rows += [("same-a", "Twin-text twin"), ("same-b", "twin; TEXT, Twin"), ("none", None), ("blank", " .,! ")]
    return rows, spark.createDataFrame(rows, "chunk_id string, content string")


QUERIES = [("q0", "the of w250"), ("q1", "the"), ("q2", "W7 w8 w9 the the of"), ("q3", "twin"), ("q4", "unheard of"), ("q5", "nothing known"), ("q6", None), ("q7", "the w1 w2 w3 w299 w120")]


@pytest.mark.parametrize("k", [1, 5, 60, 1000])
def test_keyword_search_is_exact(spark, corpus, k, tmp_path):
    rows, chunks = corpus
    keyword.build_index(chunks).write(str(tmp_path))
    index = keyword.read_index(spark, str(tmp_path))
    queries = spark.createDataFrame(QUERIES, "query_id string, question string")
    got = collections.defaultdict(list)
    for r in keyword.keyword_search(index, queries, k).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.chunk_id, round(r.score * 1e9)))
    want = {q: hits for q, hits in bm25(rows, QUERIES, k).items() if hits}
    assert got == want and set(want) == {"q0", "q1", "q2", "q3", "q4", "q7"}


def test_index_counts(corpus):
    rows, chunks = corpus
    got = {r.term: r.frequency for r in keyword.build_index(chunks).terms.collect()}
    assert got == collections.Counter(w for _, t in rows for w in set(words(t)))


def test_nothing_indexed_or_asked(spark, corpus):
    _, chunks = corpus
    none = spark.createDataFrame([], "query_id string, question string")
    assert keyword.keyword_search(keyword.build_index(chunks), none, 3).count() == 0
    asked = spark.createDataFrame(QUERIES, "query_id string, question string")
    assert keyword.keyword_search(keyword.build_index(chunks.limit(0)), asked, 3).count() == 0


def test_fusion_sums_reciprocal_ranks(spark):
    schema = "query_id string, chunk_id string, rank int"
    first = spark.createDataFrame([("q", "a", 1), ("q", "b", 2), ("q", "c", 3)], schema)
    second = spark.createDataFrame([("q", "b", 1), ("q", "a", 2), ("q", "d", 3), ("p", "z", 1)], schema)
    got = [(r.query_id, r.chunk_id, r.rank) for r in keyword.fuse(first, second, 3).orderBy("query_id", "rank").collect()]
    assert got == [("p", "z", 1), ("q", "a", 1), ("q", "b", 2), ("q", "c", 3)]
    assert keyword.fuse(first, second, 1).filter("query_id = 'q'").first().score == pytest.approx(1 / 61 + 1 / 62)


def test_hybrid_strategy_carries_columns(spark, corpus):
    rows, chunks = corpus
    points = chunks.selectExpr("*", "array(double(length(content)), 1d) as vector", "chunk_id as document_path")
    queries = spark.createDataFrame([("q", "twin text", [1.0, 0.5])], "query_id string, question string, query_vector array<double>")
    found = RETRIEVERS.run("hybrid", points, queries, config={"k": 4, "carry": ["document_path"]})
    assert found.columns == ["query_id", "chunk_id", "score", "document_path", "rank"]
    dense = [r.chunk_id for r in retrieve.top_k(points, queries, 12).orderBy("rank").collect()]
    sparse = [i for i, _ in bm25(rows, [("q", "twin text")], 12)["q"]]
    score = {i: sum(1 / (61 + ranks.index(i)) for ranks in (dense, sparse) if i in ranks) for i in {*dense, *sparse}}
    assert [r.chunk_id for r in found.orderBy("rank").collect()] == sorted(score, key=lambda i: (-score[i], i))[:4]


def test_nothing_but_the_best_of_a_segment_leaves_its_task(spark, tmp_path, monkeypatch):
    """Segments of a few chunks, with few postings at a time: every chunk shares words with every query, k per segment are kept."""
    kept = []
    monkeypatch.setattr(keyword, "cut_lineage", lambda df: kept.append(cut_lineage(df)) or kept[-1])
    monkeypatch.setattr(keyword, "_POSTINGS_PER_STEP", 50)
    monkeypatch.setattr(keyword, "SEGMENT_WORDS", 400)
    rows = [(f"c{i:04}", " ".join(["the"] * (i % 5 + 1) + [f"w{i % 7}", f"v{i}"])) for i in range(1500)]
    chunks = spark.createDataFrame(rows, "chunk_id string, content string").coalesce(2)
    queries = [(f"q{i}", f"the w{i} w{i + 1}") for i in range(5)]
    index = keyword.build_index(chunks, path=str(tmp_path))
    found = keyword.keyword_search(index, spark.createDataFrame(queries, "query_id string, question string"), 3)
    got = collections.defaultdict(list)
    for r in found.orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.chunk_id, round(r.score * 1e9)))
    assert got == bm25(rows, queries, 3)
    assert kept[-1].count() <= 3 * len(queries) * index.segments.count() < len(rows) * len(queries)


def test_chunks_of_one_id_and_rows_of_one_query_add_up(spark):
    rows = [("a", "x y"), ("b", "x"), ("a", "x z z"), (None, "y"), (None, "y x"), ("c", "q")]
    chunks = spark.createDataFrame(rows, "chunk_id string, content string").repartition(6)
    asked = [("p", "x y"), ("p", "x"), (None, "x")]
    found = keyword.keyword_search(keyword.build_index(chunks), spark.createDataFrame(asked, "query_id string, question string"), 5)
    single = bm25([(n, text) for n, (_, text) in enumerate(rows)], [("xy", "x y"), ("x", "x")], 9)
    want = collections.Counter()
    for hits in single.values():
        for n, worth in hits:
            want[rows[n][0]] += worth
    assert {r.chunk_id: round(r.score * 1e9) for r in found.collect()} == want
    assert {r.query_id for r in found.collect()} == {"p"}


def test_files_hold_few_segments_and_tasks_are_handed_one(spark, corpus, tmp_path, monkeypatch):
    """A scan decodes a file's rows together, and segments are large rows: neither may grow with the table."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    rows, chunks = corpus
    spark.conf.set(name, "5")
    try:
        index = keyword.build_index(chunks.coalesce(1), path=f"{tmp_path}/a")
        unnamed = keyword.build_index(chunks.coalesce(1))
    finally:
        spark.conf.set(name, before)
    index.write(f"{tmp_path}/b")
    files = [f.removeprefix("file:") for f in unnamed.segments.inputFiles()]
    files += [str(f) for folder in "ab" for f in (tmp_path / folder / "segments").glob("*.parquet")]
    held = [pq.ParquetFile(f).metadata.num_rows for f in files]
    assert max(held) <= keyword.SEGMENTS_PER_FILE and sum(held) == 3 * index.segments.count() >= 3 * len(rows) / 5

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows]})

    seen = []
    monkeypatch.setattr(keyword, "cut_lineage", lambda df: seen.append(index.segments.mapInArrow(sizes, "n long").agg({"n": "max"}).first()[0]) or cut_lineage(df))
    found = keyword.keyword_search(index, spark.createDataFrame(QUERIES, "query_id string, question string"), 5)
    assert seen == [1] and spark.conf.get(name) == before
    got = collections.defaultdict(list)
    for r in found.orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.chunk_id, round(r.score * 1e9)))
    assert got == {q: hits for q, hits in bm25(rows, QUERIES, 5).items() if hits}

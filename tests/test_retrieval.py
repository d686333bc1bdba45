import numpy as np
import pytest
from pyspark.sql import functions as F

from passagemill.functions import ids
from passagemill.operators import embed, retrieve
from passagemill.operators import vector_table as vt


def tables(spark, n=300, n_queries=9, dims=8, seed=1):
    rng = np.random.default_rng(seed)
    matrix = np.round(rng.normal(size=(n, dims)), 2)
    matrix[n // 3 : 2 * n // 3] = matrix[0]  # a third of the points are copies of one
    queries = np.round(rng.normal(size=(n_queries, dims)), 2)
    points = spark.createDataFrame([(f"p{i:04d}", v.tolist()) for i, v in enumerate(matrix)], "chunk_id string, vector array<float>").repartition(5)
    asked = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(queries)], "query_id int, query_vector array<double>")
    return matrix.astype(np.float32).astype(float), queries, points, asked


def brute(matrix, queries, k, distance):
    out = {}
    for q, query in enumerate(queries):
        if distance == "Cosine":
            score = matrix @ query / (np.linalg.norm(matrix, axis=1) * np.linalg.norm(query))
        elif distance == "Dot":
            score = matrix @ query
        elif distance == "Euclid":
            score = np.linalg.norm(matrix - query, axis=1)
        else:
            score = np.abs(matrix - query).sum(axis=1)
        score = np.round(score, 9)
        sign = 1 if distance in ("Euclid", "Manhattan") else -1
        order = sorted(range(len(matrix)), key=lambda i: (sign * score[i], i))[:k]
        out[q] = [(f"p{i:04d}", score[i]) for i in order]
    return out


@pytest.mark.parametrize("distance", ["Cosine", "Dot", "Euclid", "Manhattan"])
@pytest.mark.parametrize("limit", [4096, 4])
def test_top_k_is_exact(spark, distance, limit):
    matrix, queries, points, asked = tables(spark)
    rows = retrieve.top_k(points, asked, 120, distance, queries_per_block=limit, point_bytes=limit * 100).collect()
    got = {}
    for r in sorted(rows, key=lambda r: r["rank"]):
        got.setdefault(r.query_id, []).append((r.chunk_id, r.score))
    want = brute(matrix, queries, 120, distance)
    assert got.keys() == want.keys()
    for q in want:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]]
        assert np.allclose([s for _, s in got[q]], [s for _, s in want[q]], atol=1e-8)


def test_top_k_small_and_empty(spark):
    _, _, points, asked = tables(spark, n=3)
    assert retrieve.top_k(points, asked, 10).count() == 27
    assert retrieve.top_k(points, asked.filter("false"), 10).count() == 0
    assert retrieve.top_k(points.filter("false"), asked, 10).count() == 0


def test_odd_vectors_score_zero(spark):
    points = spark.createDataFrame(
        [("a", [1.0, 0.0]), ("b", [0.0, 0.0]), ("c", [1.0]), ("d", None)], "chunk_id string, vector array<float>"
    )
    asked = spark.createDataFrame([(1, [1.0, 0.0])], "query_id int, query_vector array<double>")
    got = {r.chunk_id: r.score for r in retrieve.top_k(points, asked, 10).collect()}
    assert got == {"a": 1.0, "b": 0.0, "c": 0.0, "d": 0.0}


def test_search_plan(spark):
    _, _, points, asked = tables(spark)
    plan = retrieve.top_k(points, asked, 5)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    # what is shuffled are the best k of each block, nothing of the points or the queries
    assert plan.count("hashpartitioning") == 1 and "hashpartitioning(query_id" in plan


def greedy(scores, vectors, k, lam):
    picked = []
    left = list(range(len(scores)))
    while len(picked) < k:
        def worth(i):
            near = [float(np.dot(vectors[i], vectors[j]) / (np.linalg.norm(vectors[i]) * np.linalg.norm(vectors[j]))) for j in picked]
            return round(lam * scores[i] - (1 - lam) * max([0.0, *near]), 12)
        best = max(left, key=lambda i: (worth(i), -i))
        picked.append(best)
        left.remove(best)
    return picked


def test_mmr_against_greedy(spark):
    matrix, queries, points, asked = tables(spark, n=200, seed=5)
    found = retrieve.top_k(points, asked, 15, carry=["vector"]).cache()
    got = {}
    for r in retrieve.mmr_rerank(found, 5).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.chunk_id)
    for q in range(len(queries)):
        cands = sorted((r for r in found.collect() if r.query_id == q), key=lambda r: r["rank"])
        want = greedy([c.score for c in cands], [np.array(c.vector) for c in cands], 5, 0.7)
        assert got[q] == [cands[i].chunk_id for i in want]


def test_mmr_leaves_short_lists(spark):
    _, _, points, asked = tables(spark, n=3)
    found = retrieve.top_k(points, asked, 9, carry=["vector"])
    kept = retrieve.mmr_rerank(found, 3)
    key = ["query_id", "rank", "chunk_id"]
    assert sorted(map(tuple, kept.select(key).collect())) == sorted(map(tuple, found.select(key).collect()))


def test_uuid5(spark):
    import uuid

    names = [f"src/doc-{i}.md-chunk-0000" for i in range(50)] + ["ü"]
    df = spark.createDataFrame([(n,) for n in names], "n string").select("n", ids.uuid5_dns(F.col("n")).alias("u"))
    assert all(r.u == str(uuid.uuid5(uuid.NAMESPACE_DNS, r.n)) for r in df.collect())


def test_embedder_contract(spark):
    chunks = spark.createDataFrame([("a", "x y"), ("b", ""), ("c", None)], "chunk_id string, content string")
    rows = embed.embed_with(chunks, embed.md5_bag_of_words(4), "m", batch_size=2).collect()
    assert {r.chunk_id: round(float(np.linalg.norm(r.vector)), 6) for r in rows} == {"a": 1.0, "b": 0.0, "c": 0.0}
    with pytest.raises(Exception, match="embedder returned"):
        embed.embed_with(chunks.coalesce(1), lambda texts: np.zeros((1, 2)), "m").collect()


def test_upsert_is_idempotent(spark):
    old = spark.createDataFrame([("a", 1), ("b", 1)], "point_id string, v int")
    new = spark.createDataFrame([("b", 2, 1), ("b", 3, 2), ("c", 4, 1)], "point_id string, v int, seq int")
    once = vt.upsert(old, new, seq="seq")
    twice = vt.upsert(once, new, seq="seq")
    want = [("a", 1), ("b", 3), ("c", 4)]
    assert sorted(map(tuple, once.collect())) == want == sorted(map(tuple, twice.collect()))


def test_reserved_metadata_keys_do_not_overwrite(spark):
    chunks = spark.createDataFrame(
        [("a", "p", "text", 1, 0, "m", [1.0], {"content": "other", "k": "v"})],
        "chunk_id string, document_path string, content string, token_count long, chunk_index int, model string, vector array<double>, metadata map<string,string>",
    )
    row = vt.to_points(chunks).first()
    assert row.content == "text" and row.metadata == {"content": "other", "k": "v"}


def test_context_labels(spark):
    ranked = spark.createDataFrame(
        [(1, 2, "b.md", "B", {}), (1, 1, "a.md", "A", {"source_url": "https://example.com/a/"})],
        "query_id int, rank int, document_path string, content string, metadata map<string,string>",
    )
    assert retrieve.assemble_context(ranked).first().context == (
        "Document: https://example.com/a/\nContent:\nA\n\n---\n\nDocument: b.md\nContent:\nB"
    )
    assert retrieve.assemble_context(ranked, "chat").first().context == "Document: https://example.com/a/\nA\n\nDocument: b.md\nB"


@pytest.mark.parametrize("limit", [4096, 1])
def test_queries_of_several_lengths(spark, limit):
    """Each query is compared at its own length, whatever else is asked and however it is planned."""
    points = spark.createDataFrame([("a", [1.0, 0.0, 0.0]), ("b", [0.0, 1.0, 0.0, 0.0])], "chunk_id string, vector array<float>")
    asked = spark.createDataFrame([(1, [1.0, 0.0, 0.0]), (2, [0.0, 1.0, 0.0, 0.0]), (3, None), (4, [2.0, 0.0, 0.0])], "query_id int, query_vector array<double>")
    rows = retrieve.top_k(points, asked, 2, queries_per_block=limit, point_bytes=limit).collect()
    got = {(r.query_id, r.chunk_id): r.score for r in rows}
    assert got == {(1, "a"): 1, (1, "b"): 0, (2, "a"): 0, (2, "b"): 1, (3, "a"): 0, (3, "b"): 0, (4, "a"): 1, (4, "b"): 0}


def test_a_block_of_scores_is_bounded_and_ties_go_to_the_smaller_id():
    """Many points, many of them equal: all pairs are never held at once, and the best are those of plain scoring."""
    import tracemalloc

    import pyarrow as pa

    rng = np.random.default_rng(5)
    points = rng.normal(size=(12_000, 16)).astype(np.float32)
    points[3000:9000] = points[0]
    points[17] = 0
    queries = np.vstack([points[:200], rng.normal(size=(824, 16))]).astype(np.float64)
    ids = rng.permutation(len(points))
    held = retrieve._Held(pa.table({"id": ids, "v": pa.array(list(points), pa.list_(pa.float32()))}), "id", "v")
    floor = np.full(len(queries), -np.inf)
    tracemalloc.start()
    q, p, score = retrieve._best(held, queries, "Cosine", 5, floor)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 90 << 20 < len(points) * len(queries) * 8
    wide = points.astype(np.float64)
    norms = np.linalg.norm(queries, axis=1)[:, None] * np.linalg.norm(wide, axis=1)
    every = np.round(np.divide(queries @ wide.T, norms, out=np.zeros_like(norms), where=norms > 0), 9)
    best = [np.lexsort((ids, -row))[:5] for row in every]
    assert held.take("id", p).to_pylist() == [i for b in best for i in ids[b]]
    assert score.tolist() == [s for row, b in zip(every, best) for s in row[b]] and (floor == score[4::5]).all()
    # a second block brings only what reaches the first one's scores
    worse = retrieve._Held(pa.table({"id": ids[:5000], "v": pa.array(list(-points[:5000]), pa.list_(pa.float32()))}), "id", "v")
    assert len(retrieve._best(worse, queries[17:18], "Cosine", 5, floor[17:18])[0]) == 5 and (floor[17] == 0).all()


def test_every_vector_as_a_query_is_dealt_to_all_cores(spark, tmp_path, monkeypatch):
    from passagemill.catalog import index_queries

    rows = [(i, [float(i), 1.0], i % 3) for i in range(40)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    seen, search = [], retrieve.top_k
    monkeypatch.setattr(retrieve, "top_k", lambda points, *a, **kw: seen.append(points.rdd.getNumPartitions()) or search(points, *a, **kw))
    assert index_queries.QUERIES["r1_top_k_many_queries"][0](spark, str(tmp_path)).count() == 400
    assert seen == [spark.sparkContext.defaultParallelism]

import pytest
from pyspark.sql import functions as F

from passagemill.catalog import index_queries
from passagemill.operators import embed, history
from passagemill.plans.index_job import plan_index
from passagemill.sources import tables
from passagemill.streaming.history import history_stream
from passagemill.streaming.ingest import index_stream


def test_incremental_index_equals_batch(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        F.concat(F.lit("d/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.col("text").alias("content")
    )
    docs.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    model = embed.md5_bag_of_words(16)
    options = {"parser": "plain", "chunk_config": {"size": 100, "overlap": 10}}
    for _ in range(2):
        query = index_stream(stream, str(tmp_path / "points"), "live", model, "m", str(tmp_path / "ck"), **options)
        query.awaitTermination(180)
        assert query.exception() is None
    got = tables.read_points(spark, str(tmp_path / "points"), "live").select("point_id", "content")
    want = plan_index(docs, model, "m", **options).points.select("point_id", "content")
    assert got.count() == want.count() and got.exceptAll(want).count() == 0


@pytest.mark.parametrize("layout", ["file", "folder"])
def test_streamed_query_reads_a_table_of_one_file_or_of_many(spark, tmp_path, layout):
    docs = spark.createDataFrame([(i, f"word{i} text", "en", "s", 1) for i in range(6)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(str(tmp_path / "documents.parquet" if layout == "folder" else tmp_path / "made"))
    if layout == "file":
        import pyarrow.parquet as pq

        pq.write_table(pq.read_table(str(tmp_path / "made")), str(tmp_path / "documents.parquet"))
    (tmp_path / "labels.parquet").mkdir()
    found = index_queries.QUERIES["x7_incremental_index"][0](spark, str(tmp_path)).select("content").collect()
    assert sorted(r.content for r in found) == [f"word{i} text" for i in range(6)]


def test_stream_replaces_documents_and_respects_other_writers(spark, tmp_path):
    path, options = str(tmp_path / "points"), {"parser": "plain", "chunk_config": {"size": 2, "overlap": 0}}
    model = embed.md5_bag_of_words(4)

    def arrive(name, rows, checkpoint):
        spark.createDataFrame(rows, "path string, content string").coalesce(1).write.mode("append").parquet(str(tmp_path / name))
        stream = spark.readStream.schema("path string, content string").parquet(str(tmp_path / name))
        query = index_stream(stream, path, "live", model, "m", str(tmp_path / checkpoint), **options)
        query.awaitTermination(120)
        assert query.exception() is None

    def held():
        return sorted(r.content for r in tables.read_points(spark, path, "live").collect())

    arrive("one", [("a.md", "a b c d e f"), ("b.md", "p q r")], "ck1")
    assert held() == ["a b", "c d", "e f", "p q", "r"]
    tables.write_points(plan_index(spark.createDataFrame([("c.md", "bulk")], "path string, content string"), model, "m", **options).points, path, "live")
    arrive("one", [("a.md", "z"), ("b.md", "  ")], "ck1")
    assert held() == ["bulk", "z"]
    arrive("two", [("d.md", "new")], "ck2")
    assert held() == ["bulk", "new", "z"]
    tables.compact_points(spark, path, "live")
    arrive("two", [("c.md", "")], "ck2")
    assert held() == ["new", "z"]


def test_only_changed_chunks_are_embedded(spark, tmp_path):
    path, options = str(tmp_path / "points"), {"parser": "plain", "chunk_config": {"size": 2, "overlap": 0}}
    model = embed.md5_bag_of_words(4)

    def arrive(rows):
        spark.createDataFrame(rows, "path string, content string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("path string, content string").parquet(str(tmp_path / "in"))
        query = index_stream(stream, path, "live", model, "m", str(tmp_path / "ck"), changed_only=True, **options)
        query.awaitTermination(120)
        assert query.exception() is None
        return {(r.document_path, r.content, r.version) for r in tables.read_points(spark, path, "live", with_version=True).collect()}

    assert arrive([("a.md", "a b c d e f"), ("b.md", "p q"), ("c.md", "x")]) == {
        ("a.md", "a b", 0), ("a.md", "c d", 0), ("a.md", "e f", 0), ("b.md", "p q", 0), ("c.md", "x", 0)}
    second = {("a.md", "a b", 0), ("a.md", "c z", 1), ("b.md", "p q", 0), ("b.md", "r", 1), ("d.md", "n", 1), ("c.md", "x", 0)}
    assert arrive([("a.md", "a b c z"), ("b.md", "p q r"), ("d.md", "n")]) == second
    tables.compact_points(spark, path, "live")
    assert arrive([("b.md", ""), ("d.md", "n")]) == {r for r in second if r[0] != "b.md"}


@pytest.mark.parametrize("changed_only", [False, True])
def test_paths_that_repeat_in_a_batch_give_a_chunk_once(spark, tmp_path, changed_only, monkeypatch):
    from passagemill.operators import vector_table as vt

    sent, latest = [], vt.latest
    monkeypatch.setattr(vt, "latest", lambda rows, *a: sent.append(rows.columns) or latest(rows, *a))
    options = {"parser": "plain", "chunk_config": {"size": 2, "overlap": 0}, "changed_only": changed_only}

    def arrive(rows):
        spark.createDataFrame(rows, "path string, content string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("path string, content string").parquet(str(tmp_path / "in"))
        index_stream(stream, str(tmp_path / "points"), "live", embed.md5_bag_of_words(4), "m", str(tmp_path / "ck"), **options).awaitTermination(120)
        return sorted(r.chunk_id for r in tables.read_points(spark, str(tmp_path / "points"), "live").collect())

    first = ["a.md-chunk-0000", "a.md-chunk-0001"]
    assert arrive([("a.md", "a b c"), (None, "x")]) == first and not sent  # ids of their own: no text is shuffled
    assert arrive([("b.md", "p"), ("b.md", "p"), (None, "y"), ("c.md", "")]) == sorted([*first, "b.md-chunk-0000"])
    assert any("content" in columns for columns in sent)
    sent.clear()
    tables.read_points(spark, str(tmp_path / "points"), "live")
    assert sent == [["point_id", "version", "gone"]]  # versions are resolved by ids, not by moving texts


def run_memory(df, name, mode="update"):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    query.processAllAvailable()
    query.stop()


def test_history_stream_equals_batch(spark, sf_dir, tmp_path):
    talk = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    for part in range(3):
        talk.filter(f"turn div 2 = {part}" if part < 2 else "turn div 2 >= 2").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(talk.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run_memory(history_stream(stream, max_turns=2), "history_out")
    rows = spark.table("history_out").collect()
    final = {}
    for r in rows:  # a later batch never knows fewer turns
        final.setdefault(r.conv_id, {})[(r.turn)] = r
    want = {}
    for r in history.last_turns(history.pair_turns(talk), 2).collect():
        want.setdefault(r.conv_id, set()).add((r.turn, r.user_text, r.assistant_text))
    got = {
        c: {(t, d[t].user_text, d[t].assistant_text) for t in sorted(d)[-2:]} for c, d in final.items()
    }
    assert got == want


def test_idle_conversations_are_dropped(spark, tmp_path):
    batches = [
        [(1, 0, "user", "u", "2024-01-01 00:00:00"), (1, 1, "assistant", "a", "2024-01-01 00:00:01")],
        [(2, 0, "user", "x", "2024-01-01 03:00:00"), (2, 1, "assistant", "y", "2024-01-01 03:00:01")],
        [(3, 0, "user", "x", "2024-01-01 04:00:00")],
        [(1, 2, "user", "u2", "2024-01-01 05:00:00"), (1, 3, "assistant", "a2", "2024-01-01 05:00:01")],
    ]
    import time

    for rows in batches:
        spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, t string").select(
            "conv_id", "turn", "role", "text", F.col("t").cast("timestamp").alias("ts")
        ).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)  # files are taken in order of modification
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    stream = (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        .withWatermark("ts", "1 minute")
    )
    run_memory(history_stream(stream, max_turns=5, idle_ms=3_600_000), "idle_out")
    turns = [r.turn for r in spark.table("idle_out").filter("conv_id = 1").collect()]
    assert sorted(turns) == [0, 2]  # turn 0 was gone when turn 2 came

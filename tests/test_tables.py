import datetime

import pytest
from pyspark.sql import functions as F

from passagemill.operators import embed, evaluate
from passagemill.plans.eval_job import plan_evaluation
from passagemill.plans.index_job import plan_index
from passagemill.session import cut_lineage
from passagemill.sources import corpus, questions, tables


def docs(spark):
    return spark.createDataFrame(
        [("a/x.md", "alpha beta gamma"), ("a/y.md", "delta epsilon"), ("b/z.md", "alpha zeta"), ("b/empty.md", " ")],
        "path string, content string",
    )


def indexed(spark, content=None):
    return plan_index(docs(spark) if content is None else content, embed.md5_bag_of_words(16), "m", "plain", "fixed", {"size": 4, "overlap": 1})


def test_read_corpus(spark, tmp_path):
    for name in ("a/x.md", "a/deep dir/y.MARKDOWN", "z.txt", ".git/q.md"):
        file = tmp_path / name
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_text("text é")
    rows = {r.path: r for r in corpus.read_corpus(spark, str(tmp_path)).collect()}
    assert {"a/x.md", "a/deep dir/y.MARKDOWN"} <= set(rows) and "z.txt" not in rows
    assert rows["a/x.md"].content == "text é" and rows["a/x.md"].size == 7
    kept = corpus.index_candidates(corpus.read_corpus(spark, str(tmp_path)), max_bytes=6).collect()
    assert [(r.path, r.skip_reason) for r in kept] == [("a/x.md", "7 bytes exceed the limit of 6")]


def test_question_files(spark, tmp_path):
    good = '{"id":"1","question":"q","relevance":[{"document_path":"a.md","grade":2}]}'
    (tmp_path / "good.jsonl").write_text(f"{good}\n\n" + '{"id":"2","question":"r"}\n{"id":"","question":"x"}\n')
    (tmp_path / "bad.jsonl").write_text(f"{good}\n\n{{oops\n")
    lines = corpus.read_text_lines(spark, str(tmp_path))
    got = questions.parse_questions(lines.filter("dataset = 'good.jsonl'"), skip=1).collect()
    assert [r.id for r in got] == ["2"]
    checked = {r.dataset: (r.question_count, r.bad_line) for r in questions.validate_datasets(lines).collect()}
    assert checked == {"good.jsonl": (3, None), "bad.jsonl": (None, 2)}
    listed = {r.name: (r.question_count, r.size) for r in questions.dataset_catalogue(lines).collect()}
    assert listed == {f"{n}.jsonl": (c, (tmp_path / f"{n}.jsonl").stat().st_size) for n, c in (("good", 3), ("bad", 0))}


def test_clean_corpus_table(spark, tmp_path):
    path = str(tmp_path / "clean")
    tables.write_clean_corpus(docs(spark), path, "v1")
    tables.write_clean_corpus(docs(spark).filter("path like 'a/%'"), path, "v2")
    tables.write_clean_corpus(docs(spark), path, "v1")
    assert tables.read_clean_corpus(spark, path, "v1").count() == 4
    tables.delete_artifact(spark, path, "v1")
    assert tables.read_clean_corpus(spark, path, "v1").count() == 0
    assert tables.read_clean_corpus(spark, path, "v2").count() == 2
    with pytest.raises(FileNotFoundError):
        tables.delete_artifact(spark, path, "v1")


def test_points_table(spark, tmp_path):
    path = str(tmp_path / "points")
    assert tables.read_points(spark, path, "c") is None
    first = indexed(spark).points
    tables.write_points(first, path, "c", seq=0, declared_size=16)
    tables.write_points(first, path, "c", seq=0)
    assert tables.read_points(spark, path, "c").count() == first.count() == 3
    changed = spark.createDataFrame([("a/x.md", "omega")], "path string, content string")
    tables.write_points(indexed(spark, changed).points, path, "c", seq=1)
    tables.write_points(first, path, "other")
    want = {"a/x.md-chunk-0000": "omega", "a/y.md-chunk-0000": "delta epsilon", "b/z.md-chunk-0000": "alpha zeta"}
    assert {r.chunk_id: r.content for r in tables.read_points(spark, path, "c").collect()} == want
    tables.compact_points(spark, path, "c")
    assert {r.chunk_id: r.content for r in tables.read_points(spark, path, "c").collect()} == want
    with pytest.raises(ValueError):
        tables.write_points(first, path, "c", seq=2, declared_size=3)
    tables.delete_collection(spark, path, "c")
    assert tables.read_points(spark, path, "c") is None
    assert tables.read_points(spark, path, "other").count() == 3


def test_index_plan(spark):
    plan = indexed(spark)
    assert {(r.path, r.skip_reason) for r in plan.ledger.collect()} == {("b/empty.md", "no chunks")}
    assert tuple(plan.summary().first()) == (3, 3, 1)


def test_distinct_points_stay_where_they_are_made(spark, tmp_path):
    """Only the points of repeated paths are shuffled; what is stored is what an upsert of all of them keeps."""
    import pyarrow.parquet as pq

    def plan(rows, **options):
        docs = spark.createDataFrame(rows, "path string, content string").repartition(4)
        return plan_index(cut_lineage(docs), embed.md5_bag_of_words(8), "m", "markdown", "recursive", {"max_size": 4, "overlap": 2}, **options)

    text = "# T\n\n" + " ".join(f"w{i % 5}" for i in range(40))
    single = [(f"a/{n}.md", f"{text} {n}") for n in range(20)] + [("a/none.txt", "x"), (None, text), (None, text)]
    points = plan(single, distinct=True).points
    shown = points._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in shown and "Window" not in shown and "Join" not in shown
    again = [("a/3.md", f"{text} 3"), ("b/twice.md", text), ("b/twice.md", text)]
    for n, rows in enumerate((single, single + again)):
        made, plain = plan(rows, distinct=True).points, plan(rows).points
        path = f"{tmp_path}/{n}"
        tables.write_points(made, path, "new", declared_size=8, unique=True)
        tables.write_points(plain, path, "old", declared_size=8)
        new, old = (sorted(map(str, tables.read_points(spark, path, c).drop("metadata").collect())) for c in ("new", "old"))
        assert new == old and len(new) == plain.select("point_id").distinct().count() > 100
    stored = next((tmp_path / "0").rglob("collection=new/**/*.parquet"))
    assert pq.ParquetFile(stored).metadata.row_group(0).column(0).compression == "ZSTD"
    one = plan_index(spark.createDataFrame(single + again, "path string, content string"), embed.md5_bag_of_words(8), "m", "markdown", "fixed", distinct=True, only=lambda c: c.filter("chunk_index = 0"))
    assert one.points.count() == 21


def test_run_tables_and_evaluation(spark, tmp_path):
    results, metrics = str(tmp_path / "results"), str(tmp_path / "metrics")
    asked = spark.createDataFrame(
        [("1", "alpha beta gamma", [("a/x.md", 3)]), ("2", "nothing known", [("b/z.md", 1)])],
        "question_id string, question string, relevance array<struct<document_path:string,grade:int>>",
    )
    answers = spark.createDataFrame(
        [("1", "yes", '{"score":0.8,"reasoning":""}')], "question_id string, answer string, judge_reply string"
    )
    points = indexed(spark).points
    run = tables.new_run(spark, "t", {"k": 3}, "v").first()
    assert run.run_id == tables.new_run(spark, "t", {"k": 3}, "v").first().run_id
    for strategy in ("naive-search", "mmr-rerank"):
        plan = plan_evaluation(run.run_id, points, asked, embed.md5_bag_of_words(16), "m", (1, 3), strategy, answers)
        got = {(r.metric, r.k): r.value for r in plan.metrics().collect()}
        assert got["hit_rate", 1] >= 0.5 and got["n_failed", 0] == 1 and got["avg_answer_score", 0] == 0.4
    stamped = plan.questions.withColumn("created_at", F.lit(datetime.datetime(2024, 1, 1)))
    for _ in range(2):
        tables.write_results(stamped, results)
        tables.write_metrics(plan.metrics(), metrics)
    back = tables.read_results(spark, results, run.run_id).collect()
    assert [r.question_id for r in back] == ["1", "2"]
    assert back[0].hit[1] is True and back[0].relevance[0].grade == 3 and "a/x.md" in back[0].retrieved_paths
    tables.delete_run(spark, run.run_id, results, metrics)
    import os

    assert not [d for d in os.listdir(results) if d.startswith("run_id=")]


def test_wide_metrics(spark):
    rows = [("r", "hit_rate", 1, 0.5), ("r", "hit_rate", 3, 1.0), ("r", "mrr", 0, 0.7)]
    row = evaluate.wide_metrics(spark.createDataFrame(rows, "run_id string, metric string, k int, value double")).first()
    assert row.hit_rate == {1: 0.5, 3: 1.0} and row.mrr == 0.7


def _points(spark, *ids):
    rows = [(f"p{i}", f"c{i}", [1.0, 2.0]) for i in ids]
    return spark.createDataFrame(rows, "point_id string, chunk_id string, vector array<float>")


def _ids(spark, path, name):
    return sorted(r.point_id for r in tables.read_points(spark, path, name).collect())


def test_upserts_without_a_version_add_up_and_replays_after_compaction_lose_nothing(spark, tmp_path):
    path, name = str(tmp_path / "points"), "model:small 007"
    tables.write_points(_points(spark, 1, 2, 3), path, name)
    tables.write_points(_points(spark, 4), path, name)
    assert _ids(spark, path, name) == ["p1", "p2", "p3", "p4"]
    tables.compact_points(spark, path, name)
    tables.write_points(_points(spark, 4), path, name, seq=1)
    assert _ids(spark, path, name) == ["p1", "p2", "p3", "p4"]
    tables.delete_collection(spark, path, name)
    assert tables.read_points(spark, path, name) is None


def _texts(spark, path, name):
    return {r.point_id: r.content for r in tables.read_points(spark, path, name).collect()}


def _said(spark, text, *ids):
    return _points(spark, *ids).withColumn("content", F.lit(text)).withColumn("document_path", F.concat(F.lit("d-"), "point_id"))


def test_replays_and_compaction_lose_nothing(spark, tmp_path):
    path = str(tmp_path / "points")
    batch = {"writer": "stream", "seq": 0}
    assert tables.write_points(_said(spark, "stream", 1, 2, 3), path, "c", **batch) == 0
    assert tables.write_points(_said(spark, "bulk", 2, 3), path, "c") == 1
    tables.compact_points(spark, path, "c")
    assert tables.write_points(_said(spark, "b", 3, 4), path, "c") == 3
    # replayed after its version was folded, the batch neither takes b's place nor brings old texts back
    assert tables.write_points(_said(spark, "stream", 1, 2, 3), path, "c", **batch) is None
    want = {"p1": "stream", "p2": "bulk", "p3": "b", "p4": "b"}
    assert _texts(spark, path, "c") == want
    for _ in range(2):
        tables.compact_points(spark, path, "c")
        assert _texts(spark, path, "c") == want
    assert tables.write_points(_said(spark, "other", 1), path, "c", writer="other", seq=0) == 5
    assert _texts(spark, path, "c") == {**want, "p1": "other"}


def test_a_failed_batch_shows_nothing_and_writes_its_version_again(spark, tmp_path):
    path, batch = str(tmp_path / "points"), {"writer": "s", "seq": 7}
    tables.write_points(_said(spark, "old", 1, 2), path, "c")
    with pytest.raises(ValueError):
        tables.write_points(_said(spark, "bad", 1), path, "c", declared_size=9, **batch)
    tables.write_points(_said(spark, "later", 2), path, "c")
    tables.compact_points(spark, path, "c")
    assert _texts(spark, path, "c") == {"p1": "old", "p2": "later"}
    # the batch was claimed before the later write, so that one stays, folded or not
    assert tables.write_points(_said(spark, "batch", 1, 2), path, "c", **batch) == 1
    for _ in range(2):
        assert _texts(spark, path, "c") == {"p1": "batch", "p2": "later"}
        tables.compact_points(spark, path, "c")


def test_two_writers_never_share_a_version(spark, tmp_path):
    from passagemill.sources.commits import CommitTable

    log = CommitTable(spark, str(tmp_path / "log"))
    first, second = log.claim("a", 0), log.claim("b", 0)
    assert (first, second) == (0, 1) and log.read().open_claim("a", 0) == 0 and log.read().live == []
    log.commit(second, "b", 0)
    log.commit(first, "a", 0)
    assert log.read().live == [0, 1] and log.read().has("a", 0) and not log.read().has("a", 1)
    log.commit(log.claim(), folds=[0, 1], written={"a": [(0, 0)], "b": [(0, 3)]})
    log.forget([0, 1])
    assert log.read().live == [2] and log.read().written == {"a": [(0, 0)], "b": [(0, 3)]} and log.claim() == 3


def test_marks_take_points_away_until_they_come_again(spark, tmp_path):
    path = str(tmp_path / "points")
    tables.write_points(_said(spark, "one", 1, 2, 3), path, "c")
    tables.write_points(_said(spark, "two", 9), path, "c", removed=_points(spark, 1), replaces=_said(spark, "", 2).select("document_path"))
    assert _texts(spark, path, "c") == {"p3": "one", "p9": "two"}
    tables.compact_points(spark, path, "c")
    tables.write_points(_said(spark, "back", 1), path, "c")
    assert _texts(spark, path, "c") == {"p1": "back", "p3": "one", "p9": "two"}


def test_run_ids_stay_text(spark, tmp_path):
    path = str(tmp_path / "results")
    rows = spark.createDataFrame([("007", "q1", "2024-01-01"), ("7", "q2", "2024-01-01")], "run_id string, question_id string, created_at string")
    tables.write_results(rows, path)
    assert [r.question_id for r in tables.read_results(spark, path, "007").collect()] == ["q1"]
    assert [r.question_id for r in tables.read_results(spark, path, "7").collect()] == ["q2"]


def test_a_rewritten_corpus_keeps_no_old_sections(spark, tmp_path):
    path, schema = str(tmp_path / "corpus"), "path string, content string"
    tables.write_clean_corpus(spark.createDataFrame([("a/x.md", "1"), ("b/y.md", "2")], schema), path, "v:1")
    tables.write_clean_corpus(spark.createDataFrame([("a/x.md", "3")], schema), path, "v:1")
    assert [(r.path, r.content) for r in tables.read_clean_corpus(spark, path, "v:1").collect()] == [("a/x.md", "3")]


def test_written_runs_score_their_rows_once(spark, sf_dir, monkeypatch):
    from passagemill.catalog import evaluation_queries

    plans, write = [], tables.write_results
    monkeypatch.setattr(tables, "write_results", lambda rows, path: plans.append(rows._jdf.queryExecution().optimizedPlan().toString()) or write(rows, path))
    assert evaluation_queries.QUERIES["w6_w8_written_runs"][0](spark, sf_dir).count() > 0
    assert len(plans) == 2 and not any("Join" in p for p in plans)

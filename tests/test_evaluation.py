import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from passagemill.operators import evaluate, history, jobs, runs
from passagemill.schemas import JUDGMENT
from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("run_id", T.StringType()),
    T.StructField("question_id", T.StringType()),
    T.StructField("retrieved_paths", T.ArrayType(T.StringType())),
    T.StructField("relevance", T.ArrayType(JUDGMENT)),
])


def metrics(spark, questions, ks=(1, 3, 5)):
    rows = [("r", f"q{i}", retrieved, list(judged.items()) if isinstance(judged, dict) else judged) for i, (retrieved, judged) in enumerate(questions)]
    scored = evaluate.score_questions(spark.createDataFrame(rows, SCHEMA), max(ks))
    return {(r.metric, r.k): r.value for r in evaluate.aggregate_metrics(scored, ks).collect()}


def test_hand_cases(spark):
    got = metrics(spark, [(["doc1", "doc2"], {"doc1": 1}), (["doc3"], {"doc4": 1})])
    assert got["hit_rate", 1] == got["hit_rate", 3] == 0.5
    got = metrics(spark, [(["a"], {"a": 1}), (["x", "y", "b"], {"b": 1}), (["x"], {"c": 1})])
    assert got["mrr", 0] == pytest.approx((1 + 1 / 3) / 3)
    got = metrics(spark, [(["doc1", "doc1", "doc1"], {"doc1": 1})])
    assert got["precision", 3] == pytest.approx(1 / 3) and got["ndcg", 3] == 1.0
    got = metrics(spark, [(["doc1", "doc2"], {"doc1": 1}), (["doc3", "doc5"], {"doc3": 1, "doc4": 1})], (2, 5))
    assert got["recall", 2] == got["recall", 5] == 0.75
    got = metrics(spark, [(["doc1", "doc3", "doc2"], {"doc1": 3, "doc2": 1})])
    assert 0.9 < got["ndcg_graded", 3] < 1


def test_no_expected_paths_stay_in_denominator(spark):
    got = metrics(spark, [(["a"], {"a": 1}), (["a"], {"a": 0}), ([], {}), (None, None)])
    assert got["recall", 1] == 0.25 and got["n_questions", 0] == 4


def test_hits_and_first_rank(spark):
    rows = [("r", "q", ["x", "y", "rel"], [("rel", 2)])]
    row = evaluate.score_questions(spark.createDataFrame(rows, SCHEMA), 5).first()
    assert row.hit == {1: False, 2: False, 3: True, 4: True, 5: True} and row.rank_first == 3
    assert row.expected_paths == ["rel"]


def test_first_judgment_wins(spark):
    rows = [("r", "q", ["a"], [("a", 0), ("a", 3)])]
    assert evaluate.score_questions(spark.createDataFrame(rows, SCHEMA), 1).first().grades == [0]


def model(questions, k):
    """Plain averages of the five metrics."""
    out = dict.fromkeys(evaluate.QUESTION_METRICS, 0.0)
    for retrieved, judged in questions:
        top = retrieved[:k]
        expected = [p for p, g in judged if g > 0]
        first = {}
        for i, p in enumerate(top):
            first.setdefault(p, i)
        found = [p for p in first if p in expected]
        grade = {}
        for p, g in judged:
            grade.setdefault(p, g)
        ideal = sorted((g for _, g in judged), reverse=True)[:k]
        ones = min(k, len(retrieved), len(expected))
        best = sum(1 / math.log2(i + 2) for i in range(ones))
        best_graded = sum((2**g - 1) / math.log2(i + 2) for i, g in enumerate(ideal))
        out["hit_rate"] += bool(found)
        out["precision"] += len(found) / k
        out["recall"] += len(found) / len(expected) if expected else 0
        out["ndcg"] += sum(1 / math.log2(first[p] + 2) for p in found) / best if best else 0
        gain = sum((2 ** grade.get(p, 0) - 1) / math.log2(i + 2) for p, i in first.items())
        out["ndcg_graded"] += gain / best_graded if best_graded else 0
    return {m: v / len(questions) for m, v in out.items()}


paths = st.sampled_from("abcdef")
question = st.tuples(st.lists(paths, max_size=7), st.lists(st.tuples(paths, st.integers(0, 3)), max_size=6))


@settings(max_examples=8, deadline=None)
@given(st.lists(question, min_size=1, max_size=30))
def test_against_plain_model(spark, questions):
    ks = (1, 3, 5, 10)
    got = metrics(spark, questions, ks)
    for k in ks:
        for name, value in model(questions, k).items():
            assert got[name, k] == pytest.approx(value, abs=1e-9), (name, k)


def test_judge_replies(spark):
    texts = ['{"score": 0.5, "reasoning": "ok"}', '{"score": 1.5}', "{bad", '{"reasoning": "x"}', '{"score": "a"}', "[1]", None]
    df = spark.createDataFrame(list(enumerate(texts)), "n int, judge_reply string")
    got = [r.judge_score for r in evaluate.parse_judge(df).orderBy("n").collect()]
    assert got == [0.5, None, None, 0.0, None, None, None]


def test_too_many_comparisons(spark):
    table = spark.createDataFrame([("a", "t")], "run_id string, tag string")
    with pytest.raises(ValueError):
        runs.compared_runs(table, "a", list("bcdefg"))


def test_histogram_range(spark):
    scores = spark.createDataFrame([(0.0,), (0.99,), (9.5,), (10.0,), (10.1,), (-1.0,)], "answer_score double")
    got = {r.bin: r.n for r in runs.score_histogram(scores).collect()}
    assert got[0] == 2 and got[9] == 2 and sum(got.values()) == 4 and len(got) == 10
    unit = {r.bin: r.n for r in runs.score_histogram(scores, upper=1.0).collect()}
    assert unit[0] == 1 and unit[9] == 1


def test_job_states(spark):
    row = spark.range(1).select(
        jobs.shown_state(F.lit("discarded")).alias("a"), jobs.shown_state(F.lit("zzz")).alias("b"),
        jobs.stored_state(F.lit("retrying")).alias("c"), jobs.job_tag(F.lit("{}")).alias("d"),
    ).first()
    assert tuple(row) == ("failed", "unknown", "retryable", "")


def talk(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "u1"), (1, 2, "assistant", "a1"), (1, 3, "user", "u2"),
            (1, 4, "assistant", "a2"), (1, 5, "user", ""), (2, 0, "user", "only")]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def test_turns(spark):
    pairs = history.pair_turns(talk(spark))
    assert sorted((r.turn, r.user_text, r.assistant_text) for r in pairs.collect()) == [(1, "u1", "a1"), (3, "u2", "a2")]
    assert [r.turn for r in history.last_turns(pairs, 1).collect()] == [3]
    plan = history.last_turns(pairs, 1)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_query_text_and_prompt(spark):
    assert {r.conv_id: r.query for r in history.query_text(talk(spark)).collect()} == {1: "u2", 2: "only"}
    contexts = spark.createDataFrame([(1, "CTX")], "conv_id long, context string")
    rows = history.prompt_rows(talk(spark), contexts).filter("conv_id = 1").orderBy("section", "position").collect()
    assert [r.text for r in rows][1:] == ["u1", "a1", "u2", "a2", "Context:\nCTX\n\nQuestion: u2"]

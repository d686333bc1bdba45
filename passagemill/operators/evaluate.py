"""Per-question evaluation and aggregate retrieval metrics.

Every question is one row with bounded arrays (its ranked results, at most K),
and all metrics of a question are expressions on that row. Aggregation is one
``groupBy(run)`` with partial averages; K values become columns, not rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passagemill.functions import text as tx
from passagemill.schemas import JUDGE_REPLY

QUESTION_METRICS = ("hit_rate", "ndcg", "ndcg_graded", "precision", "recall")


# --- expressions -------------------------------------------------------------


def expected_paths(relevance: Column) -> Column:
    return F.transform(
        F.filter(relevance, lambda j: j["grade"] > 0), lambda j: j["document_path"]
    )


def grades_of(retrieved: Column, relevance: Column) -> Column:
    """Grade of each retrieved path by its first judgment, 0 without one."""
    return F.transform(
        retrieved,
        lambda p: F.coalesce(
            F.get(F.filter(relevance, lambda j: j["document_path"] == p), F.lit(0))["grade"], F.lit(0)
        ),
    )


def first_seen(retrieved: Column) -> Column:
    """Whether a retrieved path occurs there for the first time."""
    return F.transform(retrieved, lambda p, i: F.array_position(retrieved, p) == i + 1)


def dcg(gains: Column, k: int) -> Column:
    """Discounted gain of the first k grades: sum of (2^grade - 1) / log2(position + 1)."""
    terms = F.transform(
        F.slice(gains, F.lit(1), F.lit(k)),
        lambda g, i: (F.pow(F.lit(2.0), g) - 1) / F.log2((i + 2).cast("double")),
    )
    return F.aggregate(terms, F.lit(0.0), lambda total, t: total + t)


def _share(value: Column, ideal: Column) -> Column:
    return F.when(ideal > 0, value / ideal).otherwise(F.lit(0.0))


def rank_first(relevant: Column) -> Column:
    """Position of the first relevant result, 0 if none."""
    return F.array_position(relevant, True).cast("int")


def _running(values: Column, zero) -> Column:
    """Prefix sums with a leading zero: entry k is the sum of the first k values."""
    start = F.array(F.lit(zero))
    return F.aggregate(
        values, start, lambda done, v: F.array_append(done, F.element_at(done, -1) + v)
    )


def _gain_terms(gains: Column, kmax: int) -> Column:
    return F.transform(
        F.slice(gains, F.lit(1), F.lit(kmax)),
        lambda g, i: (F.pow(F.lit(2.0), g) - 1) / F.log2((i + 2).cast("double")),
    )


def with_prefixes(questions: DataFrame, kmax: int) -> DataFrame:
    """Adds prefix sums over positions (``_found, _dcg, _gdcg, _ideal``), so a metric at any k is a lookup."""
    fresh = F.zip_with("relevant", "first", lambda r, f: (r & f).cast("int"))
    gains = F.zip_with("grades", "first", lambda g, f: F.when(f, g).otherwise(F.lit(0)))
    return questions.withColumn("_fresh", F.slice(fresh, F.lit(1), F.lit(kmax))).select(
        "*",
        _running(F.col("_fresh"), 0).alias("_found"),
        _running(_gain_terms(F.col("_fresh"), kmax), 0.0).alias("_dcg"),
        _running(_gain_terms(gains, kmax), 0.0).alias("_gdcg"),
        _running(_gain_terms(F.col("ideal"), kmax), 0.0).alias("_ideal"),
    )


def _at(prefix: str, k: int) -> Column:
    return F.get(prefix, F.least(F.lit(k), F.size(prefix) - 1))


def question_metric(name: str, k: int) -> Column:
    """Metric of one question at k, on rows of :func:`with_prefixes`."""
    n_expected = F.col("n_expected")
    found = _at("_found", k)
    if name == "hit_rate":
        return (found > 0).cast("double")
    if name == "precision":
        return found / F.lit(float(k))
    if name == "recall":
        return F.when(n_expected > 0, found / n_expected).otherwise(F.lit(0.0))
    if name == "ndcg":
        # the ideal of the binary form is capped by what was retrieved
        best = F.least(F.lit(k), F.size("relevant"), n_expected)
        ones, total = [0.0], 0.0
        for position in range(1, k + 1):
            total += 1 / math.log2(position + 1)
            ones.append(total)
        ideal = F.get(F.array(*[F.lit(x) for x in ones]), best)
        return _share(_at("_dcg", k), ideal)
    if name == "ndcg_graded":
        return _share(_at("_gdcg", k), _at("_ideal", k))
    raise ValueError(f"unknown metric: {name}")


# --- inputs -------------------------------------------------------------------


def collect_results(ranked: DataFrame, *keys: str) -> DataFrame:
    """Retrieved paths and scores per question in rank order (at most K entries each)."""
    lists = F.array_sort(F.collect_list(F.struct("rank", "document_path", "score")))
    return ranked.groupBy(*keys).agg(lists.alias("_r")).select(
        *keys, F.col("_r.document_path").alias("retrieved_paths"), F.col("_r.score").alias("scores")
    )


def score_questions(results: DataFrame, top_k: int) -> DataFrame:
    """Questions with ``retrieved_paths`` and ``relevance`` → evaluation row per question.

    Adds ``expected_paths, relevant, first, grades, ideal, n_expected, hit, rank_first,
    ndcg_graded``. Missing results or judgments count as empty.
    """
    no_paths = F.array().cast("array<string>")
    no_judgments = F.array().cast("array<struct<document_path:string,grade:int>>")
    filled = results.withColumn("retrieved_paths", F.coalesce("retrieved_paths", no_paths)).withColumn(
        "relevance", F.coalesce("relevance", no_judgments)
    )

    def judged(row: Column) -> Column:
        """All per-position arrays; the inputs are bound, so no lambda recomputes them."""
        retrieved, relevance = row["retrieved"], row["relevance"]
        return tx.let(
            expected_paths(relevance),
            lambda expected: F.struct(
                expected.alias("expected_paths"),
                F.transform(retrieved, lambda p: F.array_contains(expected, p)).alias("relevant"),
                first_seen(retrieved).alias("first"),
                grades_of(retrieved, relevance).alias("grades"),
                F.sort_array(F.transform(relevance, lambda j: j["grade"]), asc=False).alias("ideal"),
                F.size(expected).alias("n_expected"),
            ),
        )

    inputs = F.struct(F.col("retrieved_paths").alias("retrieved"), F.col("relevance"))
    scored = filled.withColumn("_judged", tx.let(inputs, judged)).select("*", "_judged.*").drop("_judged")
    ks = F.sequence(F.lit(1), F.lit(top_k))
    ranked = with_prefixes(scored, top_k).withColumn("rank_first", rank_first(F.col("relevant")))
    helpers = ("_fresh", "_found", "_dcg", "_gdcg", "_ideal")
    return ranked.select(
        "*",
        tx.let(
            F.col("rank_first"),
            lambda first: F.map_from_arrays(ks, F.transform(ks, lambda k: (first > 0) & (first <= k))),
        ).alias("hit"),
        question_metric("ndcg_graded", top_k).alias("ndcg_graded"),
    ).drop(*helpers)


def score_ranked(
    ranked: DataFrame, expected: DataFrame, *, query_id: str = "query_id", path_col: str = "document_path"
) -> DataFrame:
    """Evaluation rows from long results carrying a ``grade``, for judgments too many to list.

    ``expected`` has one row per question: ``n_expected`` and ``ideal`` (its highest
    grades, descending, as many as the largest k in use). Questions without results
    keep empty arrays.
    """
    entry = F.struct(F.col("rank"), F.col(path_col).alias("path"), F.col("grade"))
    lists = ranked.groupBy(query_id).agg(F.array_sort(F.collect_list(entry)).alias("_r"))
    joined = expected.join(lists, query_id, "left")
    paths = F.coalesce(F.col("_r.path"), F.array().cast("array<string>"))
    grades = F.coalesce(F.col("_r.grade"), F.array().cast("array<int>"))
    rows = joined.select(
        *expected.columns,
        paths.alias("retrieved_paths"),
        grades.alias("grades"),
        F.transform(grades, lambda g: g > 0).alias("relevant"),
        tx.let(paths, first_seen).alias("first"),
    )
    return rows.withColumn("rank_first", rank_first(F.col("relevant")))


def ideal_grades(judgments: DataFrame, kmax: int, query_id: str = "query_id") -> DataFrame:
    """``query_id, n_expected, ideal`` from long judgments ``(query_id, document_path, grade)``.

    The rank filter turns into a limit per partition, so a question with very
    many judgments sends only its best ``kmax`` grades through the shuffle.
    """
    window = Window.partitionBy(query_id).orderBy(F.desc("grade"), F.asc("document_path"))
    best = (
        judgments.withColumn("_n", F.row_number().over(window))
        .filter(F.col("_n") <= kmax)
        .groupBy(query_id)
        .agg(F.sort_array(F.collect_list("grade"), asc=False).alias("ideal"))
    )
    counts = judgments.groupBy(query_id).agg(F.count_if(F.col("grade") > 0).cast("int").alias("n_expected"))
    return counts.join(best, query_id)


# --- aggregation ---------------------------------------------------------------


def aggregate_metrics(
    questions: DataFrame,
    ks: Sequence[int],
    keys: Sequence[str] = ("run_id",),
    grouping: str = "groupBy",
    metrics: Sequence[str] | None = None,
) -> DataFrame:
    """All metrics, or those named, at all k: ``keys, metric, k, value`` (k is 0 for metrics without one).

    Failed and unanswered questions stay in every denominator. Scalars appear for
    the columns at hand: rank_first → mrr, answer_score, latency and tokens, failed.
    Questions are summed once per key; ``rollup`` and ``cube`` expand these sums and add
    ``grouping_id``, which tells a subtotal from a key that is null.
    """
    ks = sorted(set(ks))
    if not ks or ks[0] < 1:
        raise ValueError("ks must be positive")
    n = F.col("_n")
    sums, scalars = {"_n": F.count("*")}, {}
    have = set(questions.columns)

    def asked(name: str) -> bool:
        return metrics is None or name in metrics

    def scalar(name: str, column: str, summed: Column, value: Column) -> None:
        if asked(name):
            sums[column], scalars[name] = F.sum(summed), value

    by_k = [m for m in QUESTION_METRICS if asked(m)]
    for m in by_k:
        sums.update({f"_{m}_{k}": F.sum(question_metric(m, k)) for k in ks})
    if "rank_first" in have:
        reciprocal = F.when(F.col("rank_first") > 0, 1 / F.col("rank_first")).otherwise(F.lit(0.0))
        scalar("mrr", "_mrr", reciprocal, F.col("_mrr") / F.nullif(n, F.lit(0)))
    if "answer_score" in have:
        mean = F.coalesce(F.col("_answer") / F.nullif(n, F.lit(0)), F.lit(0.0))
        scalar("avg_answer_score", "_answer", F.coalesce("answer_score", F.lit(0.0)), mean)
    for column in ("latency_ms", "prompt_tokens", "completion_tokens"):
        if column in have:
            summed, total = F.coalesce(F.col(column), F.lit(0)), F.col(f"_{column}")
            scalar(f"avg_{column}", f"_{column}", summed, total / F.greatest(n, F.lit(1)))
            scalar(f"total_{column}", f"_{column}", summed, total)
    if "failed" in have:
        scalar("n_failed", "_failed", F.coalesce("failed", F.lit(False)).cast("int"), F.coalesce("_failed", F.lit(0)))
    if asked("n_questions"):
        scalars["n_questions"] = n

    grouped = with_prefixes(questions, ks[-1]).groupBy(*keys).agg(*[total.alias(c) for c, total in sums.items()])
    level = []
    if grouping != "groupBy":
        level = ["grouping_id"]
        grouped = getattr(grouped, grouping)(*keys).agg(
            F.grouping_id().alias("grouping_id"), *[F.sum(c).alias(c) for c in sums]
        )

    def entry(name: str, k: int, value: Column) -> Column:
        return F.struct(F.lit(name).alias("metric"), F.lit(k).alias("k"), value.cast("double").alias("value"))

    long = [entry(m, k, F.col(f"_{m}_{k}") / F.nullif(n, F.lit(0))) for m in by_k for k in ks]
    long += [entry(name, 0, value) for name, value in scalars.items()]
    return grouped.select(*keys, *level, F.inline(F.array(*long)))


def wide_metrics(long: DataFrame, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """One row per key: a ``map<k,value>`` for each metric with k, a double for each scalar."""
    by_k = [
        F.map_from_entries(
            F.array_sort(F.collect_list(F.when(F.col("metric") == m, F.struct("k", "value"))))
        ).alias(m)
        for m in QUESTION_METRICS
    ]
    return long.groupBy(*keys).agg(
        *by_k,
        F.max(F.when(F.col("metric") == "mrr", F.col("value"))).alias("mrr"),
        F.max(F.when(F.col("metric") == "avg_answer_score", F.col("value"))).alias("avg_answer_score"),
    )


def merge_answers(questions: DataFrame, answers: DataFrame, key: str = "question_id") -> DataFrame:
    """Attach generated answers and judge scores.

    ``answers``: key, answer, judge_reply. A question fails when its answer is empty or
    missing, or its reply cannot be read; the score is then 0.
    """
    judged = parse_judge(answers, "judge_reply")
    joined = questions.join(judged.select(key, "answer", "judge_score"), key, "left")
    answered = F.coalesce(F.col("answer"), F.lit("")) != ""
    return (
        joined.withColumn("failed", ~answered | F.col("judge_score").isNull())
        .withColumn("answer_score", F.when(answered, F.coalesce("judge_score", F.lit(0.0))).otherwise(F.lit(0.0)))
        .withColumn("answer", F.coalesce("answer", F.lit("")))
        .drop("judge_score")
    )


def parse_judge(replies: DataFrame, reply_col: str = "judge_reply") -> DataFrame:
    """Adds ``judge_score`` (null for bad JSON or a score outside 0..1) and ``judge_reasoning``.

    An object without a score counts as 0.
    """
    text = F.col(reply_col)
    parsed = F.from_json(text, JUDGE_REPLY, {"mode": "PERMISSIVE"})
    is_object = F.try_parse_json(text).isNotNull() & tx.trim_ws(text).startswith("{")
    raw = F.get_json_object(text, "$.score")
    readable = is_object & (raw.isNull() | parsed["score"].isNotNull())
    score = F.when(readable, F.coalesce(parsed["score"], F.lit(0.0)))
    return replies.withColumn("judge_score", F.when(score.between(0, 1), score)).withColumn(
        "judge_reasoning", parsed["reasoning"]
    )

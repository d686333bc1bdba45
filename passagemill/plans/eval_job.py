"""Questions against a collection: retrieval, per-question rows, metrics."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagemill.operators import embed, evaluate
from passagemill.plans.registry import RETRIEVERS


@dataclass
class EvalPlan:
    ranked: DataFrame
    questions: DataFrame
    ks: Sequence[int]

    def metrics(self, keys: Sequence[str] = ("run_id",)) -> DataFrame:
        return evaluate.aggregate_metrics(self.questions, self.ks, keys)


def retrieve_questions(
    points: DataFrame, questions: DataFrame, embedder: embed.Embedder, model: str, k: int,
    strategy: str = "naive-search", carry: Sequence[str] = ("document_path",),
) -> DataFrame:
    """Ranked chunks for every question (column ``question_id``, text ``question``)."""
    embedded = embed.embed_with(
        questions.select("question_id", "question"), embedder, model, text_col="question"
    )
    return RETRIEVERS.run(
        strategy, points, embedded, config={
            "k": k, "query_id": "question_id", "query_vector": "vector", "carry": list(carry),
        },
    )


def plan_evaluation(
    run_id: str,
    points: DataFrame,
    questions: DataFrame,
    embedder: embed.Embedder,
    model: str,
    ks: Sequence[int] = (1, 3, 5),
    strategy: str = "naive-search",
    answers: DataFrame | None = None,
    judgments: DataFrame | None = None,
) -> EvalPlan:
    """Lazy plan of an evaluation run over ``question_id, question, relevance, …``.

    Retrieves max(ks) chunks per question. Questions without results stay, with
    empty lists, in every denominator. ``judgments`` (``question_id, document_path, grade``), where given, stand
    for the relevance lists: a question may then have any number of them.
    """
    top = max(ks)
    ranked = retrieve_questions(points, questions, embedder, model, top, strategy)
    if judgments is None:
        results = questions.join(evaluate.collect_results(ranked, "question_id"), "question_id", "left")
        scored = evaluate.score_questions(results, top)
    else:
        graded = ranked.join(judgments, ["question_id", "document_path"], "left").withColumn("grade", F.coalesce("grade", F.lit(0)))
        expected = questions.join(evaluate.ideal_grades(judgments, top, "question_id"), "question_id", "left").withColumns({
            "n_expected": F.coalesce("n_expected", F.lit(0)), "ideal": F.coalesce("ideal", F.array().cast("array<int>")),
        })
        scored = evaluate.score_ranked(graded, expected, query_id="question_id")
    scored = scored.withColumn("run_id", F.lit(run_id))
    if answers is not None:
        scored = evaluate.merge_answers(scored, answers)
    return EvalPlan(ranked, scored, ks)

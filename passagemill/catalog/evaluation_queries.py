"""Queries on per-question evaluation, metrics, runs, jobs and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from passagemill.catalog import fixtures as fx
from passagemill.catalog import sql as q
from passagemill.catalog.corpus_queries import _RECURSIVE, MAX_WORDS, OVERLAP, scratch
from passagemill.catalog.index_queries import retrieved, with_url
from passagemill.operators import embed, evaluate, history, jobs, retrieve, runs
from passagemill.plans.eval_job import plan_evaluation
from passagemill.plans.index_job import plan_index
from passagemill.session import cut_lineage
from passagemill.sources import tables
from passagemill.streaming.history import history_stream

QUERIES = {}


def add(name, run, sql=None):
    QUERIES[name] = (run, sql)


def settled(name):
    """Six digits; the nudge keeps exact halves, common in averages, from going either way on summation order."""
    return F.round(F.col(name) + 1e-9, 6)


def r6(*names):
    return [settled(n).alias(n) for n in names]


# --- per question --------------------------------------------------------------------

add("q1_expected_paths",
    lambda s, d: fx.scored_orders(s, d).select("question_id", F.explode("expected_paths").alias("document_path")),
    q.query("SELECT 'q-'||o_orderkey AS question_id, path AS document_path FROM relevance WHERE grade > 0", "relevance"))
add("q2_retrieved_lists",
    lambda s, d: fx.scored_orders(s, d).select("question_id", F.posexplode(F.arrays_zip("retrieved_paths", "scores")).alias("pos", "r"))
    .select("question_id", "pos", F.col("r.retrieved_paths").alias("document_path"), F.round("r.scores", 6).alias("score")),
    q.query("SELECT 'q-'||o_orderkey AS question_id, (rank - 1)::INT AS pos, path AS document_path, round(score, 6) AS score FROM results", "results"))
add("q3_hit_at_k",
    lambda s, d: fx.scored_orders(s, d).select("question_id", F.explode("hit").alias("k", "hit")),
    q.query("""SELECT 'q-'||e.o_orderkey AS question_id, k::INT AS k, coalesce(bool_or(g.rel AND g.rank <= k), false) AS hit
FROM eval_rows e CROSS JOIN (SELECT unnest(range(1, 11)) AS k) LEFT JOIN graded g ON g.o_orderkey = e.o_orderkey GROUP BY e.o_orderkey, k""", "graded", "eval_rows"))
add("q4_first_relevant_rank",
    lambda s, d: fx.scored_orders(s, d).select("question_id", "rank_first"),
    q.query("SELECT question_id, rank_first FROM per_question", "per_question"))
add("q5_graded_ndcg",
    lambda s, d: fx.scored_orders(s, d).select("question_id", *r6("ndcg_graded")),
    q.query("SELECT 'q-'||o_orderkey AS question_id, round(1e-9 + ndcg_graded, 6) AS ndcg_graded FROM per_k WHERE k = 10", "per_k"))
add("q6_path_membership",
    lambda s, d: fx.scored_orders(s, d).select("question_id", F.posexplode("relevant").alias("pos", "relevant")),
    q.query("SELECT 'q-'||o_orderkey AS question_id, (rank - 1)::INT AS pos, rel AS relevant FROM graded", "graded"))
add("q7_grade_lookup",
    lambda s, d: fx.scored_orders(s, d).select("question_id", F.posexplode("grades").alias("pos", "grade")),
    q.query("SELECT 'q-'||o_orderkey AS question_id, (rank - 1)::INT AS pos, grade FROM graded", "graded"))


def replies(spark, sf):
    """Judge replies of every kind, made from the messages of the conversations."""
    turn = F.col("turn")
    score = F.round((turn + F.col("conv_id") % 5) / 8, 3).cast("string")
    reply = (
        F.when(F.col("conv_id") % 6 == 0, F.lit("not json"))
        .when(F.col("conv_id") % 6 == 1, F.lit('{"reasoning":"none"}'))
        .when(F.col("conv_id") % 6 == 2, F.lit('{"score":"high","reasoning":"text"}'))
        .otherwise(F.concat(F.lit('{"score":'), score, F.lit(',"reasoning":"turn '), turn.cast("string"), F.lit('"}')))
    )
    return fx.messages(spark, sf).filter("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("answer"), reply.alias("judge_reply"))


_REPLIES = """SELECT conv_id, turn, text AS answer, CASE conv_id % 6 WHEN 0 THEN 'not json' WHEN 1 THEN '{"reasoning":"none"}' WHEN 2 THEN '{"score":"high","reasoning":"text"}'
  ELSE 'num' END AS kind, round((turn + conv_id % 5) / 8, 3) AS s FROM conversations WHERE role = 'assistant'"""
_JUDGE = """SELECT *, CASE kind WHEN '{"reasoning":"none"}' THEN 0.0 WHEN 'num' THEN CASE WHEN s BETWEEN 0 AND 1 THEN s END END AS judge_score FROM replies"""


def merged_answers(spark, sf):
    asked = fx.messages(spark, sf).filter("role = 'user'").select(
        F.concat_ws("/", "conv_id", (F.col("turn") + 1)).alias("question_id"), F.col("text").alias("question")
    )
    answers = replies(spark, sf).select(F.concat_ws("/", "conv_id", "turn").alias("question_id"), "answer", "judge_reply")
    return evaluate.merge_answers(asked, answers).select("question_id", "answer", "failed", *r6("answer_score"))


add("q8_answer_merge", merged_answers, q.query(
    """SELECT u.conv_id||'/'||(u.turn + 1) AS question_id, coalesce(j.answer, '') AS answer, coalesce(j.answer, '') = '' OR j.judge_score IS NULL AS failed,
  CASE WHEN coalesce(j.answer, '') <> '' THEN round(1e-9 + coalesce(j.judge_score, 0), 6) ELSE 0 END AS answer_score
FROM conversations u LEFT JOIN judge j ON j.conv_id = u.conv_id AND j.turn = u.turn + 1 WHERE u.role = 'user'""",
    extra={"replies": _REPLIES, "judge": _JUDGE}))
add("q9_judge_replies",
    lambda s, d: evaluate.parse_judge(replies(s, d)).select("conv_id", "turn", *r6("judge_score")),
    q.query("SELECT conv_id, turn, round(1e-9 + judge_score, 6) AS judge_score FROM judge", extra={"replies": _REPLIES, "judge": _JUDGE}))


def evaluation_job(spark, sf):
    """All documents indexed, every benchmark question retrieved and graded, all metrics.

    Judgments stay in long form: a passage may stand in any number of documents.
    """
    asked = fx.questions(spark, sf)
    # grades, expected counts and ideal lists all read the judgments, which are found once
    judged = cut_lineage(fx.passage_judgments(spark, sf))
    ranked = retrieved(spark, sf, ["document_path"])
    graded = ranked.join(judged, ["question_id", "document_path"], "left").withColumn(
        "grade", F.coalesce("grade", F.lit(0))
    )
    ideal = evaluate.ideal_grades(judged, fx.TOP_K, "question_id")
    expected = asked.join(ideal, "question_id", "left").select(
        F.lit("benchmark").alias("run_id"), "question_id",
        F.coalesce("n_expected", F.lit(0)).alias("n_expected"),
        F.coalesce("ideal", F.array().cast("array<int>")).alias("ideal"),
    )
    rows = evaluate.score_ranked(graded, expected, query_id="question_id")
    return evaluate.aggregate_metrics(rows, fx.KS).withColumn("value", settled("value"))


_JOB_K = """SELECT q.question_id, ks.k, coalesce(a.hit, 0)::DOUBLE AS hit_rate, coalesce(a.found, 0) / ks.k AS precision,
  CASE WHEN coalesce(x.n_exp, 0) > 0 THEN coalesce(a.found, 0) / x.n_exp ELSE 0 END AS recall,
  CASE WHEN coalesce(b.best, 0) > 0 THEN coalesce(a.dcg, 0) / b.best ELSE 0 END AS ndcg,
  CASE WHEN coalesce(i.best, 0) > 0 THEN coalesce(a.gdcg, 0) / i.best ELSE 0 END AS ndcg_graded
FROM questions q CROSS JOIN ks
LEFT JOIN (SELECT question_id, count(*) AS n_exp FROM judgments GROUP BY 1) x USING (question_id)
LEFT JOIN (SELECT question_id, k, max(rel::INT) AS hit, count(*) FILTER (rel AND first) AS found, count(*) AS n_ret,
   sum(CASE WHEN rel AND first THEN 1.0/log2(rank+1) ELSE 0 END) AS dcg, sum(CASE WHEN first THEN (power(2, grade)-1)/log2(rank+1) ELSE 0 END) AS gdcg
   FROM gr JOIN ks ON rank <= k GROUP BY ALL) a ON a.question_id = q.question_id AND a.k = ks.k
LEFT JOIN (SELECT question_id, k, sum((power(2, grade)-1)/log2(n+1)) AS best FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY grade DESC, document_path) AS n FROM judgments) JOIN ks ON n <= k GROUP BY ALL) i ON i.question_id = q.question_id AND i.k = ks.k
LEFT JOIN (SELECT m, sum(1.0/log2(j+1)) AS best FROM (SELECT unnest(range(1, 11)) AS m) t, (SELECT unnest(range(1, 11)) AS j) u WHERE j <= m GROUP BY m) b ON b.m = least(ks.k, coalesce(a.n_ret, 0), coalesce(x.n_exp, 0))"""
_GR = """SELECT r.question_id, r.rank, coalesce(j.grade, 0) AS grade, j.grade IS NOT NULL AS rel,
  row_number() OVER (PARTITION BY r.question_id, r.document_path ORDER BY r.rank) = 1 AS first FROM retrieved r LEFT JOIN judgments j USING (question_id, document_path)"""


def long_sql(source: str, keys: str, scalars: str = "") -> str:
    parts = [
        f"SELECT {keys}, '{m}' AS metric, k::INT AS k, round(1e-9 + avg({m}), 6) AS value FROM {source} GROUP BY ALL"
        for m in evaluate.QUESTION_METRICS
    ]
    return "\nUNION ALL ".join(parts) + scalars


add("q10_evaluation_job", evaluation_job, q.query(
    long_sql("jk", "'benchmark' AS run_id", """
UNION ALL SELECT 'benchmark', 'mrr', 0, round(1e-9 + avg(coalesce(1.0 / f.r, 0)), 6) FROM questions LEFT JOIN (SELECT question_id, min(rank) AS r FROM gr WHERE rel GROUP BY 1) f USING (question_id)
UNION ALL SELECT 'benchmark', 'n_questions', 0, count(*)::DOUBLE FROM questions"""),
    "retrieved", "judgments", "questions", "ks", extra={"gr": _GR, "jk": _JOB_K}))

def stored_runs(spark, sf):
    """The whole way: markdown to elements, recursive chunks, vectors, stored points; each strategy's run with its rows and metrics stored."""
    path, model, ks = scratch(spark, "runs"), embed.md5_bag_of_words(fx.DIMS), (1, 3, 5)
    plan = plan_index(fx.markdown(spark, sf), model, "md5-bag-of-words", "markdown", "recursive", {"max_size": MAX_WORDS, "overlap": OVERLAP}, distinct=True)
    tables.write_points(plan.points, f"{path}/points", "handbook", declared_size=fx.DIMS, unique=True)
    points = tables.read_points(spark, f"{path}/points", "handbook")
    judged = cut_lineage(fx.passage_judgments(spark, sf))
    found = None
    for strategy in ("naive-search", "mmr-rerank"):
        run_id = tables.new_run(spark, "handbook", {"strategy": strategy}).first()["run_id"]
        run = plan_evaluation(run_id, points, fx.questions(spark, sf), model, "md5-bag-of-words", ks, strategy, judgments=judged)
        rows = cut_lineage(run.questions)
        tables.write_results(rows.withColumn("created_at", F.current_timestamp()), f"{path}/results")
        tables.write_metrics(evaluate.aggregate_metrics(rows, ks), f"{path}/metrics")
        stored = spark.read.parquet(f"{path}/metrics").filter(F.col("run_id") == run_id)
        kept = tables.read_results(spark, f"{path}/results", run_id).agg(
            F.lit("n_rows").alias("metric"), F.lit(0).alias("k"), F.count("*").cast("double").alias("value")
        )
        part = stored.select("metric", "k", settled("value").alias("value")).unionByName(kept).withColumn("strategy", F.lit(strategy))
        found = part if found is None else found.unionByName(part)
    return found


_CHAIN = {
    **_RECURSIVE,
    "rec_chunks": "SELECT path||'-chunk-'||lpad(idx::VARCHAR, 4, '0') AS chunk_id, path AS document_path, content FROM rec",
    "rec_vectors": q._embedded("rec_vectors", "rec_chunks", "chunk_id", "content")[1],
    "near": """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) AS rank FROM (
  SELECT q.question_id, v.chunk_id, v.vector::FLOAT[]::DOUBLE[] AS vector, round(list_cosine_similarity(v.vector::FLOAT[]::DOUBLE[], q.vector), 9) AS score
  FROM question_vectors q, rec_vectors v)) WHERE rank <= 15""",
    "near_kept": "SELECT question_id, chunk_id, vector, score, rank FROM near",
    "mmr": """SELECT question_id, 0 AS step, []::VARCHAR[] AS picked FROM question_vectors
UNION ALL
SELECT p.question_id, p.step + 1, list_append(p.picked, (
  SELECT r.chunk_id FROM near_kept r WHERE r.question_id = p.question_id AND NOT list_contains(p.picked, r.chunk_id)
  ORDER BY round(0.7 * r.score - 0.3 * greatest(0, coalesce((SELECT max(list_cosine_similarity(r.vector, o.vector)) FROM near_kept o
    WHERE o.question_id = r.question_id AND list_contains(p.picked, o.chunk_id)), 0)), 12) DESC, r.rank LIMIT 1))
FROM mmr p WHERE p.step < 5""",
    "hits": """SELECT 'naive-search' AS strategy, question_id, chunk_id, rank FROM near WHERE rank <= 5
UNION ALL SELECT 'mmr-rerank', question_id, unnest(picked), generate_subscripts(picked, 1) FROM mmr WHERE step = 5""",
    "gr": """SELECT h.strategy, h.question_id, h.rank, coalesce(j.grade, 0) AS grade, j.grade IS NOT NULL AS rel,
  row_number() OVER (PARTITION BY h.strategy, h.question_id, c.document_path ORDER BY h.rank) = 1 AS first
FROM hits h JOIN rec_chunks c USING (chunk_id) LEFT JOIN judgments j ON j.question_id = h.question_id AND j.document_path = c.document_path""",
    "asked": "SELECT strategy, question_id, k FROM (SELECT unnest(['naive-search', 'mmr-rerank']) AS strategy), questions, (SELECT unnest([1, 3, 5]) AS k)",
    "jk": """SELECT s.strategy, s.question_id, s.k, coalesce(a.hit, 0)::DOUBLE AS hit_rate, coalesce(a.found, 0) / s.k AS precision,
  CASE WHEN coalesce(x.n_exp, 0) > 0 THEN coalesce(a.found, 0) / x.n_exp ELSE 0 END AS recall,
  CASE WHEN coalesce(b.best, 0) > 0 THEN coalesce(a.dcg, 0) / b.best ELSE 0 END AS ndcg,
  CASE WHEN coalesce(i.best, 0) > 0 THEN coalesce(a.gdcg, 0) / i.best ELSE 0 END AS ndcg_graded
FROM asked s
LEFT JOIN (SELECT question_id, count(*) AS n_exp FROM judgments GROUP BY 1) x USING (question_id)
LEFT JOIN (SELECT strategy, question_id, k, max(rel::INT) AS hit, count(*) FILTER (rel AND first) AS found, count(*) AS n_ret,
   sum(CASE WHEN rel AND first THEN 1.0/log2(rank+1) ELSE 0 END) AS dcg, sum(CASE WHEN first THEN (power(2, grade)-1)/log2(rank+1) ELSE 0 END) AS gdcg
   FROM gr JOIN (SELECT unnest([1, 3, 5]) AS k) ks ON rank <= k GROUP BY ALL) a ON a.strategy = s.strategy AND a.question_id = s.question_id AND a.k = s.k
LEFT JOIN (SELECT question_id, k, sum((power(2, grade)-1)/log2(n+1)) AS best FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY grade DESC, document_path) AS n FROM judgments)
   JOIN (SELECT unnest([1, 3, 5]) AS k) ks ON n <= k GROUP BY ALL) i ON i.question_id = s.question_id AND i.k = s.k
LEFT JOIN (SELECT m, sum(1.0/log2(j+1)) AS best FROM (SELECT unnest(range(1, 11)) AS m) t, (SELECT unnest(range(1, 11)) AS j) u WHERE j <= m GROUP BY m) b ON b.m = least(s.k, coalesce(a.n_ret, 0), coalesce(x.n_exp, 0))""",
}
add("q10_stored_runs", stored_runs, q.query(
    long_sql("jk", "strategy", """
UNION ALL SELECT s.strategy, 'mrr', 0, round(1e-9 + avg(coalesce(1.0 / f.r, 0)), 6) FROM (SELECT DISTINCT strategy, question_id FROM asked) s
  LEFT JOIN (SELECT strategy, question_id, min(rank) AS r FROM gr WHERE rel GROUP BY ALL) f USING (strategy, question_id) GROUP BY 1
UNION ALL SELECT strategy, unnest(['n_questions', 'n_rows']), 0, count(*)::DOUBLE FROM (SELECT DISTINCT strategy, question_id FROM asked) GROUP BY 1"""),
    "elements", "judgments", "questions", "question_vectors", extra=_CHAIN, recursive=True))

# --- metrics ----------------------------------------------------------------------------


def metric(name, *keys, grouping="groupBy"):
    def run(spark, sf):
        long = evaluate.aggregate_metrics(fx.scored_orders(spark, sf), fx.KS, keys or ("run_id",), grouping, name)
        return long.withColumn("value", settled("value"))

    return run


_SCALARS = {
    "mrr": "avg(CASE WHEN rank_first > 0 THEN 1.0 / rank_first ELSE 0 END)",
    "avg_answer_score": "avg(coalesce(answer_score, 0))",
    "avg_latency_ms": "avg(latency_ms)", "total_latency_ms": "sum(latency_ms)",
    "avg_prompt_tokens": "avg(prompt_tokens)", "total_prompt_tokens": "sum(prompt_tokens)",
    "avg_completion_tokens": "avg(completion_tokens)", "total_completion_tokens": "sum(completion_tokens)",
    "n_failed": "count(*) FILTER (failed)", "n_questions": "count(*)",
}


def scalar_sql(keys: str, *names: str) -> str:
    return "\nUNION ALL ".join(
        f"SELECT {keys}, '{n}' AS metric, 0 AS k, round(1e-9 + ({_SCALARS[n]})::DOUBLE, 6) AS value FROM per_question GROUP BY ALL" for n in names
    )


for _id, _m in (("m1_hit_rate", "hit_rate"), ("m3_ndcg", "ndcg"), ("m4_ndcg_graded", "ndcg_graded"),
                ("m5_precision", "precision"), ("m6_recall", "recall")):
    add(_id, metric([_m]), q.query(f"SELECT run_id, '{_m}' AS metric, k::INT AS k, round(1e-9 + avg({_m}), 6) AS value FROM per_k GROUP BY ALL", "per_k"))
add("m2_mrr", metric(["mrr"]), q.query(scalar_sql("run_id", "mrr"), "per_question"))


def raw_dcg(spark, sf):
    rows = fx.scored_orders(spark, sf)
    return rows.select("question_id", *[F.round(evaluate.dcg(F.col("grades"), k), 6).alias(f"dcg_{k}") for k in (3, 10)])


add("m7_dcg", raw_dcg, q.query(
    """SELECT e.question_id, round(coalesce(sum((power(2, grade)-1)/log2(rank+1)) FILTER (rank <= 3), 0), 6) AS dcg_3,
  round(coalesce(sum((power(2, grade)-1)/log2(rank+1)), 0), 6) AS dcg_10 FROM eval_rows e LEFT JOIN graded g USING (o_orderkey) GROUP BY e.question_id""", "graded", "eval_rows"))
add("m8_mean_answer_score", metric(["avg_answer_score"]), q.query(scalar_sql("run_id", "avg_answer_score"), "per_question"))
_COSTS = [n for n in _SCALARS if "latency" in n or "tokens" in n]
add("m9_latency_and_tokens", metric(_COSTS), q.query(scalar_sql("run_id", *_COSTS), "per_question"))
_ALL_SQL = long_sql("per_k", "run_id") + "\nUNION ALL " + scalar_sql("run_id", *_SCALARS)
add("m10_all_metrics", metric(None), q.query(_ALL_SQL, "per_k", "per_question"))


def wide(spark, sf):
    made = evaluate.wide_metrics(fx.run_metrics(spark, sf))
    return made.select("run_id", *[F.round(F.element_at(m, 5), 6).alias(f"{m}_5") for m in evaluate.QUESTION_METRICS], *r6("mrr", "avg_answer_score"))


add("m10_wide_metrics", wide, q.query(
    "SELECT k5.*, m.mrr, m.avg_answer_score FROM (SELECT run_id, " + ", ".join(f"round(1e-9 + avg({m}), 6) AS {m}_5" for m in evaluate.QUESTION_METRICS)
    + " FROM per_k WHERE k = 5 GROUP BY run_id) k5 JOIN (SELECT run_id, round(1e-9 + " + _SCALARS["mrr"] + ", 6) AS mrr, round(1e-9 + " + _SCALARS["avg_answer_score"]
    + ", 6) AS avg_answer_score FROM per_question GROUP BY run_id) m USING (run_id)", "per_k", "per_question"))
add("m11_by_category", metric(None, "run_id", "category", "difficulty"), q.query(
    long_sql("per_k", "run_id, category, difficulty") + "\nUNION ALL " + scalar_sql("run_id, category, difficulty", *_SCALARS), "per_k", "per_question"))


_LEVELS = "SELECT category, difficulty, grouping(category, difficulty)::BIGINT AS grouping_id, "
add("m11_rollup", metric(None, "category", "difficulty", grouping="rollup"), q.query(
    "\nUNION ALL ".join(
        [f"{_LEVELS}'{m}' AS metric, k::INT AS k, round(1e-9 + avg({m}), 6) AS value FROM per_k GROUP BY k, ROLLUP (category, difficulty)" for m in evaluate.QUESTION_METRICS]
        + [f"{_LEVELS}'{n}' AS metric, 0 AS k, round(1e-9 + ({_SCALARS[n]})::DOUBLE, 6) AS value FROM per_question GROUP BY ROLLUP (category, difficulty)" for n in _SCALARS]
    ), "per_k", "per_question"))

# --- run analytics -------------------------------------------------------------------------

_FMT = "strftime({0}, '%Y-%m-%dT%H:%M:%SZ')"
BASE, OTHERS = "3-MEDIUM", ["1-URGENT", "5-LOW", "2-HIGH"]


_M = {"rm": _ALL_SQL}
add("a1_run_list",
    lambda s, d: runs.list_runs(fx.runs(s, d), fx.scored_orders(s, d), limit=3, offset=1),
    q.query(f"""SELECT run_id, tag, strategy, {_FMT.format('created_at')} AS created_at, (SELECT count(*) FROM orders o WHERE o.o_orderpriority = run_id) AS question_count,
  (SELECT count(*) FROM runs) AS total_runs FROM runs ORDER BY runs.created_at DESC, run_id LIMIT 3 OFFSET 1""", "runs"))
add("a2_run_detail",
    lambda s, d: runs.run_detail(fx.runs(s, d), fx.scored_orders(s, d), BASE, 50, 100).select(
        "run_id", "tag", "question_id", "category", "difficulty", "answer_score", "rank_first", "prompt_tokens", "completion_tokens", "latency_ms", "total"),
    q.query(f"""SELECT run_id, 'nightly-evaluation-3' AS tag, question_id, category, difficulty, answer_score, rank_first, prompt_tokens, completion_tokens, latency_ms,
  (SELECT count(*) FROM orders WHERE o_orderpriority = '{BASE}') AS total FROM per_question WHERE run_id = '{BASE}' ORDER BY created_at, question_id LIMIT 50 OFFSET 100""", "per_question"))
add("a3_run_summary",
    lambda s, d: runs.run_summary(fx.runs(s, d), BASE),
    q.query(f"SELECT run_id, tag, strategy, {_FMT.format('created_at')} AS created_at FROM runs WHERE run_id = '{BASE}'", "runs"))


def by_ids(spark, sf):
    busy = fx.scored_orders(spark, sf).groupBy("run_id").agg(F.sum("latency_ms").alias("t"))
    ids = busy.filter(F.col("t") % 2 == 0).select("run_id")
    return runs.runs_by_ids(fx.runs(spark, sf), ids).select("run_id", "tag", "strategy")


add("a4_runs_by_ids", by_ids, q.query(
    "SELECT run_id, tag, strategy FROM runs WHERE run_id IN (SELECT run_id FROM eval_rows GROUP BY 1 HAVING sum(latency_ms) % 2 = 0)", "runs", "eval_rows"))
add("a5_run_comparison",
    lambda s, d: runs.compared_runs(fx.runs(s, d), BASE, [*OTHERS, "no such run"]).select("position", "run_id", "tag", "found"),
    q.query("SELECT (i - 1)::INT AS position, a.run_id, r.tag, r.tag IS NOT NULL AS found FROM (SELECT unnest(['3-MEDIUM','1-URGENT','5-LOW','2-HIGH','no such run']) AS run_id, generate_subscripts([1,2,3,4,5], 1) AS i) a LEFT JOIN runs r USING (run_id)", "runs"))
_COMPARED = "(metric, k) IN (('hit_rate',5),('mrr',0),('ndcg',5),('avg_answer_score',0),('avg_latency_ms',0),('avg_prompt_tokens',0),('avg_completion_tokens',0))"
_UP = "metric NOT IN ('avg_latency_ms','avg_prompt_tokens','avg_completion_tokens')"


def deltas(spark, sf):
    long = fx.run_metrics(spark, sf).withColumn("value", settled("value"))
    return runs.metric_deltas(long, BASE).withColumn("delta", F.round("delta", 6))


add("a6_metric_deltas", deltas, q.query(
    f"""SELECT m.run_id, m.metric, m.k, m.value, b.value AS base_value, round(m.value - b.value, 6) AS delta,
  CASE WHEN abs(m.value - b.value) < 0.001 THEN 'same' WHEN (m.value > b.value) = ({_UP.replace('metric', 'm.metric')}) THEN 'better' ELSE 'worse' END AS label
FROM (SELECT * FROM rm WHERE {_COMPARED}) m JOIN (SELECT * FROM rm WHERE run_id = '{BASE}') b USING (metric, k)""", "per_k", "per_question", extra=_M))


def best(spark, sf):
    long = fx.run_metrics(spark, sf).withColumn("value", settled("value"))
    positions = fx.runs(spark, sf).select("run_id", F.substring("run_id", 1, 1).cast("int").alias("position"))
    return runs.best_runs(long, positions)


add("a7_best_runs", best, q.query(
    f"""SELECT metric, k, run_id, value FROM (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY CASE WHEN {_UP} THEN -value ELSE value END, run_id) AS rn FROM rm WHERE {_COMPARED}) WHERE rn = 1""",
    "per_k", "per_question", extra=_M))


def matrix(spark, sf):
    long = fx.run_metrics(spark, sf).withColumn("value", settled("value"))
    return runs.metric_matrix(long, BASE, OTHERS).withColumn("max_abs_delta", F.round("max_abs_delta", 6))


add("a8_metric_matrix", matrix, q.query(
    "SELECT metric, " + ", ".join(f"max(value) FILTER (run_id = '{r}') AS \"{r}\"" for r in [BASE, *OTHERS]) + ", round(greatest("
    + ", ".join(f"abs(max(value) FILTER (run_id = '{r}') - max(value) FILTER (run_id = '{BASE}'))" for r in OTHERS)
    + "), 6) AS max_abs_delta FROM rm WHERE (metric, k) IN (('hit_rate',5),('mrr',0),('ndcg',5),('avg_answer_score',0)) GROUP BY metric", "per_k", "per_question", extra=_M))
add("a9_category_breakdown",
    lambda s, d: runs.category_breakdown(fx.scored_orders(s, d)).select("category", "n", *r6("avg_score", "avg_rank")),
    q.query("""SELECT CASE WHEN length(category) > 20 THEN substr(category, 1, 20)||'...' ELSE category END AS category, n, avg_score, avg_rank FROM (
  SELECT category, count(*) AS n, round(1e-9 + avg(coalesce(answer_score, 0)), 6) AS avg_score, round(1e-9 + avg(rank_first), 6) AS avg_rank FROM per_question GROUP BY category ORDER BY n DESC, category LIMIT 8)""", "per_question"))
add("a10_score_histogram",
    lambda s, d: runs.score_histogram(fx.scored_orders(s, d)),
    q.query("""SELECT b::INT AS bin, b::DOUBLE AS lower, (b + 1)::DOUBLE AS upper, coalesce(n, 0) AS n FROM (SELECT unnest(range(10)) AS b)
LEFT JOIN (SELECT least(floor(answer_score), 9) AS b, count(*) AS n FROM eval_rows WHERE answer_score BETWEEN 0 AND 10 GROUP BY 1) USING (b)""", "eval_rows"))
add("a11_latency_buckets",
    lambda s, d: runs.latency_buckets(fx.scored_orders(s, d)),
    q.query("""SELECT (i - 1)::INT AS position, bucket, coalesce(n, 0) AS n FROM (SELECT unnest(['<1s','1-3s','3-5s','5-10s','>10s']) AS bucket, generate_subscripts([1,2,3,4,5], 1) AS i)
LEFT JOIN (SELECT CASE WHEN latency_ms < 1000 THEN '<1s' WHEN latency_ms < 3000 THEN '1-3s' WHEN latency_ms < 5000 THEN '3-5s' WHEN latency_ms < 10000 THEN '5-10s' ELSE '>10s' END AS bucket, count(*) AS n FROM eval_rows GROUP BY 1) USING (bucket)""", "eval_rows"))


def trend(spark, sf):
    long = fx.run_metrics(spark, sf).withColumn("value", settled("value"))
    return runs.run_trend(fx.runs(spark, sf), long, last=4).withColumn("hit_rate_change", F.round("hit_rate_change", 6))


add("a12_run_trend", trend, q.query(
    """SELECT row_number() OVER w AS position, CASE WHEN length(tag) > 14 THEN substr(tag, 1, 14)||'...' ELSE tag END AS tag, hit_rate, mrr, ndcg, score, round(hit_rate - lag(hit_rate) OVER w, 6) AS hit_rate_change
FROM (SELECT * FROM runs ORDER BY created_at DESC, run_id LIMIT 4) r JOIN (
  SELECT run_id, max(value) FILTER (metric = 'hit_rate' AND k = 5) AS hit_rate, max(value) FILTER (metric = 'mrr') AS mrr, max(value) FILTER (metric = 'ndcg' AND k = 5) AS ndcg, max(value) FILTER (metric = 'avg_answer_score') AS score FROM rm GROUP BY 1) m USING (run_id)
WINDOW w AS (ORDER BY r.created_at, r.run_id DESC)""", "runs", "per_k", "per_question", extra=_M))
add("a13_table_search",
    lambda s, d: runs.table_search(fx.table(s, d, "part"), "BRAND#1", ["p_name", "p_brand"], "p_retailprice", descending=True, limit=25, page=2, tie_break="p_partkey"),
    "SELECT * FROM part WHERE contains(lower(p_name), 'brand#1') OR contains(lower(p_brand), 'brand#1') ORDER BY p_retailprice DESC, p_partkey LIMIT 25 OFFSET 25")


def dotted(spark, sf):
    nested = fx.table(spark, sf, "events").select(
        "event_id", F.concat(F.lit('{"HitRate":{"5":'), F.col("props"), F.lit('},"MRR":'), F.round("value", 2).cast("string"), F.lit(',"tag":"t"}')).alias("metrics")
    )
    return nested.select(
        "event_id", runs.metric_at("metrics", "HitRate.5.k").alias("hit"), runs.metric_at("metrics", "MRR").alias("mrr"),
        runs.metric_at("metrics", "NDCG.5").alias("none"), runs.metric_at("metrics", "tag").alias("text"),
    )


add("a14_metric_lookup", dotted,
    "SELECT event_id, (props->>'$.k')::DOUBLE AS hit, round(value, 2) AS mrr, NULL::DOUBLE AS none, NULL::DOUBLE AS text FROM events")
add("a15_score_labels",
    lambda s, d: fx.order_results(s, d).groupBy(runs.traffic_light(F.coalesce("answer_score", F.lit(0.0))).alias("label")).agg(F.count("*").alias("n")),
    q.query("SELECT CASE WHEN coalesce(answer_score, 0) >= 7 THEN 'success' WHEN coalesce(answer_score, 0) >= 4 THEN 'warning' ELSE 'destructive' END AS label, count(*) AS n FROM eval_rows GROUP BY 1", "eval_rows"))


def counts(spark, sf):
    docs = fx.documents(spark, sf)
    return runs.overview(
        docs.select("source").distinct(), fx.vectors(spark, sf).select("label").distinct(), fx.runs(spark, sf),
        fx.question_lines(spark, sf).select("dataset").distinct(),
    )


add("a16_overview", counts, """SELECT 'Artifacts' AS label, count(DISTINCT source) AS n FROM documents UNION ALL SELECT 'Indexes', count(DISTINCT label) FROM embeddings
UNION ALL SELECT 'Evaluation Runs', count(DISTINCT o_orderpriority) FROM orders UNION ALL SELECT 'Datasets', count(DISTINCT doc_id % 3) FROM documents""")


def stored_results(spark, sf):
    """Question rows as stored (nested columns as JSON text) and read back."""
    rows = fx.scored_orders(spark, sf)
    nested = ("expected_paths", "retrieved_paths", "relevance", "hit")
    stored = rows.select("run_id", "question_id", "rank_first", "created_at", *[F.to_json(c).alias(c) for c in nested])
    return tables.decode_results(stored).select(
        "run_id", "question_id", "rank_first", F.size("expected_paths").alias("n_expected"), F.size("retrieved_paths").alias("n_retrieved"),
        F.aggregate("relevance", F.lit(0), lambda a, j: a + j["grade"]).alias("grade_sum"), F.element_at("hit", 5).alias("hit_5"),
    )


add("s9_stored_results", stored_results, q.query(
    """SELECT p.run_id, p.question_id, rank_first, coalesce(v.n_exp, 0)::INT AS n_expected, coalesce(g.n, 0)::INT AS n_retrieved, coalesce(v.s, 0)::INT AS grade_sum, rank_first BETWEEN 1 AND 5 AS hit_5
FROM per_question p LEFT JOIN (SELECT o_orderkey, count(*) FILTER (grade > 0) AS n_exp, sum(grade) AS s FROM relevance GROUP BY 1) v USING (o_orderkey) LEFT JOIN (SELECT o_orderkey, count(*) AS n FROM graded GROUP BY 1) g USING (o_orderkey)""",
    "per_question", "relevance"))


def written_runs(spark, sf):
    """Runs created, results and metrics written twice, one run deleted, the rest read back."""
    path = scratch(spark, "runs")
    # scored once: each write and the metrics read the rows again
    rows = cut_lineage(fx.scored_orders(spark, sf))
    for _ in range(2):
        tables.write_results(rows, f"{path}/results")
        tables.write_metrics(evaluate.aggregate_metrics(rows, fx.KS), f"{path}/metrics")
    tables.delete_run(spark, BASE, f"{path}/results", f"{path}/metrics")
    stored = tables.decode_results(spark.read.parquet(f"{path}/results"))
    found = stored.groupBy("run_id").agg(
        F.count("*").alias("questions"), F.sum(F.size("expected_paths")).alias("n_expected")
    )
    hits = spark.read.parquet(f"{path}/metrics").filter("metric = 'hit_rate' and k = 5").select("run_id", "value")
    made = [tables.new_run(spark, "t", {"k": 5}, v).select("run_id") for v in ("a", "a", "b")]
    n_ids = made[0].union(made[1]).union(made[2]).distinct().agg(F.count("*")).scalar()
    return found.join(hits, "run_id").select(
        "run_id", "questions", "n_expected", settled("value").alias("hit_rate_5"), n_ids.alias("run_ids")
    )


add("w6_w8_written_runs", written_runs, q.query(
    f"""SELECT e.run_id, count(*) AS questions, sum(coalesce(v.n, 0))::BIGINT AS n_expected, any_value(h.value) AS hit_rate_5, 2 AS run_ids
FROM eval_rows e LEFT JOIN (SELECT o_orderkey, count(*) FILTER (grade > 0) AS n FROM relevance GROUP BY 1) v USING (o_orderkey)
JOIN (SELECT run_id, round(1e-9 + avg(hit_rate), 6) AS value FROM per_k WHERE k = 5 GROUP BY 1) h ON h.run_id = e.run_id
WHERE e.run_id <> '{BASE}' GROUP BY e.run_id""", "per_k", "eval_rows", "relevance"))


def deleted_run(spark, sf):
    ids = fx.runs(spark, sf).filter(F.substring("run_id", 1, 1).isin("2", "4")).select("run_id")
    left = runs.delete_runs(fx.scored_orders(spark, sf), ids)
    return left.groupBy("run_id").agg(F.count("*").alias("questions"))


add("w9_delete_runs", deleted_run, "SELECT o_orderpriority AS run_id, count(*) AS questions FROM orders WHERE substr(o_orderpriority, 1, 1) NOT IN ('2', '4') GROUP BY 1")

# --- jobs ------------------------------------------------------------------------------------

add("j1_job_list",
    lambda s, d: jobs.list_jobs(fx.jobs(s, d), "eval", "running, failed,retrying,unheard", 100, 40),
    q.query(f"""SELECT id, kind, shown AS state, tag, attempt, max_attempts, {_FMT.format('created_at')} AS created_at, {_FMT.format('finalized_at')} AS finalized_at,
  (SELECT count(*) FROM shown_jobs WHERE kind = 'eval' AND shown IN ('running','failed','retrying')) AS total
FROM shown_jobs WHERE kind = 'eval' AND shown IN ('running','failed','retrying') ORDER BY id LIMIT 100 OFFSET 40""", "shown_jobs"))
add("j2_state_names",
    lambda s, d: fx.jobs(s, d).groupBy(F.col("state").alias("stored"), jobs.shown_state(F.col("state")).alias("shown"),
                                       jobs.stored_state(jobs.shown_state(F.col("state"))).alias("back")).agg(F.count("*").alias("n")),
    q.query("SELECT state AS stored, shown, CASE WHEN shown <> 'unknown' THEN state END AS back, count(*) AS n FROM shown_jobs GROUP BY ALL", "shown_jobs"))
add("j3_job_tags",
    lambda s, d: fx.jobs(s, d).select("id", jobs.job_tag(F.col("args")).alias("tag")),
    q.query("SELECT id, tag FROM shown_jobs", "shown_jobs"))
add("j4_attempt_errors",
    lambda s, d: fx.jobs(s, d).select("id", F.posexplode(jobs.attempt_errors(F.col("errors"))).alias("pos", "error")),
    q.query("SELECT id, (a - 1)::INT AS pos, 'attempt '||a||': timeout after '||v AS error FROM (SELECT id, v, unnest(range(1, k % 4 + 1)) AS a FROM jobs)", "jobs"))
add("j5_active_jobs",
    lambda s, d: jobs.active_jobs(fx.jobs(s, d)).select("id", "kind", "state"),
    q.query("SELECT id, kind, shown AS state FROM shown_jobs WHERE shown IN ('running','retrying','available')", "shown_jobs"))
add("j5_recent_jobs",
    lambda s, d: jobs.recent_jobs(fx.jobs(s, d)).select("id", "kind", "state"),
    q.query("SELECT id, kind, shown AS state FROM shown_jobs ORDER BY created_at DESC, id DESC LIMIT 8", "shown_jobs"))


def catalogue_and_pending(spark, sf):
    index_jobs = fx.jobs(spark, sf).filter("kind = 'index'")
    names = fx.vectors(spark, sf).groupBy((F.col("label") * 7).alias("n")).agg(F.count("*").alias("vector_count"))
    catalogue = names.select(F.concat(F.lit("tag-"), F.col("n").cast("string")).alias("name"), "vector_count")
    return jobs.with_pending(catalogue, index_jobs)


add("j6_catalogue_with_pending", catalogue_and_pending, q.query(
    """SELECT 'tag-'||(label * 7) AS name, count(*) AS vector_count, false AS pending, NULL::BIGINT AS job_id, NULL::VARCHAR AS job_state FROM embeddings GROUP BY label
UNION ALL SELECT tag, NULL, true, id, shown FROM shown_jobs WHERE kind = 'index' AND tag NOT IN (SELECT 'tag-'||(label * 7) FROM embeddings)""", "shown_jobs"))
add("j7_job_status",
    lambda s, d: jobs.job_status(fx.jobs(s, d)).withColumn("errors", F.array_join("errors", "; ")),
    q.query(f"""SELECT id AS job_id, kind, shown AS state, {_FMT.format('attempted_at')} AS attempted_at, {_FMT.format('finalized_at')} AS completed_at,
  array_to_string(list_transform(range(1, k % 4 + 1), lambda a: 'attempt '||a||': timeout after '||v), '; ') AS errors FROM shown_jobs""", "shown_jobs"))

# --- conversations ------------------------------------------------------------------------------

add("h1_last_turns",
    lambda s, d: history.last_turns(history.pair_turns(fx.messages(s, d)), 2),
    q.query("SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS age FROM turns) WHERE age <= 2", "turns"))
add("h2_read_conversation",
    lambda s, d: history.conversation(fx.messages(s, d), 7), "SELECT * FROM conversations WHERE conv_id = 7")


def cleared(spark, sf):
    talk = fx.messages(spark, sf)
    done = talk.groupBy("conv_id").agg(F.max("turn").alias("t")).filter("t >= 5")
    return history.clear(talk, done)


add("h2_clear_conversations", cleared, "SELECT * FROM conversations WHERE conv_id NOT IN (SELECT conv_id FROM conversations GROUP BY conv_id HAVING max(turn) >= 5)")


def purged(spark, sf):
    left = history.purge_idle(fx.table(spark, sf, "events"), "user_id", "ts", "1 day")
    return left.select("event_id", "user_id")


add("h3_purge_idle", purged, """SELECT event_id, user_id FROM events WHERE user_id NOT IN (
  SELECT user_id FROM events GROUP BY user_id HAVING max(ts) < (SELECT max(ts) FROM events) - INTERVAL 1 DAY)""")


add("h3_sessions",
    lambda s, d: history.sessions(fx.table(s, d, "events"), "user_id", "ts", "2 hours"),
    """SELECT user_id, n AS session, min(ts) AS started, max(ts) AS ended, count(*) AS n_rows FROM (
  SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM (
    SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM events)) GROUP BY ALL""")


def asked(spark, sf):
    talk = fx.messages(spark, sf)
    explicit = talk.groupBy("conv_id").agg(
        F.when(F.min("conv_id") % 4 == 0, F.concat(F.lit("explicit "), F.col("conv_id").cast("string"))).otherwise(F.lit("")).alias("query")
    )
    return history.query_text(talk, explicit)


add("h4_query_text", asked, """SELECT conv_id, CASE WHEN conv_id % 4 = 0 THEN 'explicit '||conv_id ELSE coalesce(arg_max(text, turn) FILTER (role = 'user' AND text <> ''), '') END AS query FROM conversations GROUP BY conv_id""")


def message_texts(spark, sf):
    parts = F.array(
        F.struct(F.lit("image").alias("type"), F.lit("i").alias("text")),
        F.struct(F.lit("text").alias("type"), F.concat(F.lit("part "), F.col("turn").cast("string")).alias("text")),
    )
    content = F.when(F.col("role") == "user", F.col("text")).otherwise(F.lit(""))
    return fx.messages(spark, sf).select("conv_id", "turn", history.message_text(content, parts).alias("text"))


add("h5_message_text", message_texts, "SELECT conv_id, turn, CASE WHEN role = 'user' AND text <> '' THEN text ELSE 'part '||turn END AS text FROM conversations")


def prompts(spark, sf):
    """Each conversation's prompt; its context comes from one benchmark question's results."""
    contexts = retrieve.assemble_context(with_url(retrieved(spark, sf, ["document_path", "content"])), "chat", "question_id")
    talk = fx.messages(spark, sf)
    by_conversation = (
        talk.select("conv_id").distinct()
        .withColumn("question_id", F.concat(F.lit("item-"), F.col("conv_id").cast("string")))
        .join(contexts, "question_id").select("conv_id", "context")
    )
    return history.prompt_rows(talk, by_conversation)




def _buffers(spark, batches, idle_ms=None):
    """Newest buffer of every conversation when the batches arrive one after the other, each in a run of its own over the same state."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    path = scratch(spark, "turns")

    def keep(batch, batch_id):
        batch.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{path}/out/n={batch_id}")

    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for n, rows in enumerate(batches):
            rows.write.parquet(f"{path}/in/part={n}")
            arriving = spark.readStream.schema(rows.schema).parquet(f"{path}/in/part=*")
            if idle_ms is not None:
                arriving = arriving.withWatermark("ts", "1 minute")
            (
                history_stream(arriving, max_turns=2, idle_ms=idle_ms).writeStream.outputMode("update").foreachBatch(keep)
                .option("checkpointLocation", f"{path}/progress").trigger(availableNow=True).start().awaitTermination()
            )
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)
    out = spark.read.parquet(f"{path}/out")
    newest = out.groupBy("conv_id").agg(F.max("batch").alias("batch"))
    return out.join(newest, ["conv_id", "batch"]).select("conv_id", "turn", "user_text", "assistant_text", "age")


def streamed_turns(spark, sf):
    """The conversations in three batches that cut through them, into bounded per-conversation buffers."""
    talk = fx.messages(spark, sf)
    part = F.least(F.floor((F.col("turn") + F.col("conv_id") % 2) / 3), F.lit(2))
    return _buffers(spark, [talk.filter(part == n) for n in range(3)])


def evicted_turns(spark, sf):
    """Turns from the fourth on come a day later: what a conversation had before has gone by then."""
    talk = fx.messages(spark, sf).withColumn("ts", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    later = talk.filter("turn >= 4").withColumn("ts", F.lit("2024-01-02 00:00:00").cast("timestamp"))
    # one message in between moves the clock
    clock = talk.filter("turn = 0").agg(
        F.lit(-1).cast("bigint").alias("conv_id"), F.lit(0).cast("bigint").alias("turn"), F.lit("user").alias("role"),
        F.lit("tick").alias("text"), F.lit("2024-01-01 12:00:00").cast("timestamp").alias("ts"),
    )
    return _buffers(spark, [talk.filter("turn < 4"), clock, later], idle_ms=3_600_000)


add("h7_evicted_turns", evicted_turns, q.query(
    """SELECT conv_id, turn, user_text, assistant_text, age FROM (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS age FROM (
    SELECT *, max((turn >= 4)::INT) OVER (PARTITION BY conv_id) AS has_later FROM turns WHERE turn <> 3) WHERE (turn >= 4)::INT = has_later)
WHERE age <= 2""", "turns"))


add("h7_streamed_turns", streamed_turns, q.query(
    "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS age FROM turns) WHERE age <= 2", "turns"))

_URL = "CASE WHEN ends_with(document_path, '1.md') THEN 'https://example.com/'||document_path ELSE document_path END"
add("h6_prompts", prompts, q.query(
    f"""SELECT conv_id, 0 AS section, 0 AS position, 'system' AS role, '{history.SYSTEM_LINE}' AS text FROM conversations GROUP BY conv_id
UNION ALL SELECT c.conv_id, 1, turn, role, text FROM conversations c WHERE role IN ('user','assistant') AND text <> ''
  AND NOT (role = 'user' AND turn = (SELECT max(turn) FROM conversations m WHERE m.conv_id = c.conv_id))
UNION ALL SELECT conv_id, 2, 0, 'user', 'Context:'||chr(10)||coalesce(any_value(x.context), '')||chr(10)||chr(10)||'Question: '||coalesce(arg_max(text, turn) FILTER (role = 'user' AND text <> ''), '')
  FROM conversations LEFT JOIN ctx x ON x.question_id = 'item-'||conv_id GROUP BY conv_id""",
    "retrieved", extra={"ctx": f"SELECT question_id, string_agg('Document: '||{_URL}||chr(10)||content, chr(10)||chr(10) ORDER BY rank) AS context FROM retrieved GROUP BY 1"}))

"""Run analytics over ``eval_runs`` (run_id, tag, strategy, created_at), per-question rows and long metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Metrics of the comparison views as (metric, k, higher is better).
COMPARED_METRICS = (
    ("hit_rate", 5, True),
    ("mrr", 0, True),
    ("ndcg", 5, True),
    ("avg_answer_score", 0, True),
    ("avg_latency_ms", 0, False),
    ("avg_prompt_tokens", 0, False),
    ("avg_completion_tokens", 0, False),
)
MATRIX_METRICS = ("hit_rate", "mrr", "ndcg", "avg_answer_score")
SAME_THRESHOLD = 0.001
MAX_COMPARED = 5
LATENCY_BUCKETS = (("<1s", 0, 1000), ("1-3s", 1000, 3000), ("3-5s", 3000, 5000), ("5-10s", 5000, 10000), (">10s", 10000, None))
RFC3339 = "yyyy-MM-dd'T'HH:mm:ss'Z'"


def rfc3339(ts: Column) -> Column:
    return F.date_format(ts, RFC3339)


def list_runs(runs: DataFrame, questions: DataFrame, limit: int = 20, offset: int = 0) -> DataFrame:
    """Newest runs first, one page (limit 1..100), with question counts and the overall total."""
    limit = limit if 1 <= limit <= 100 else 20
    counts = questions.groupBy("run_id").agg(F.count("*").alias("question_count"))
    page = runs.orderBy(F.desc("created_at"), F.asc("run_id")).offset(max(offset, 0)).limit(limit)
    listed = page.join(counts, "run_id", "left").withColumn("question_count", F.coalesce("question_count", F.lit(0)))
    return _with_total(listed, runs, "total_runs").withColumn("created_at", rfc3339(F.col("created_at")))


def _with_total(page: DataFrame, table: DataFrame, name: str) -> DataFrame:
    """Attach a table's row count as a scalar subquery."""
    return page.withColumn(name, table.agg(F.count("*")).scalar())


def run_detail(runs: DataFrame, questions: DataFrame, run_id: str, limit: int = 50, offset: int = 0) -> DataFrame:
    """One page of a run's question rows in creation order, with the run's tag and total."""
    mine = questions.filter(F.col("run_id") == run_id)
    page = mine.orderBy("created_at", "question_id").offset(offset).limit(limit)
    run = runs.filter(F.col("run_id") == run_id).select("run_id", "tag")
    return _with_total(page.join(run, "run_id"), mine, "total")


def run_summary(runs: DataFrame, run_id: str) -> DataFrame:
    return runs.filter(F.col("run_id") == run_id).withColumn("created_at", rfc3339(F.col("created_at")))


def runs_by_ids(runs: DataFrame, ids: DataFrame) -> DataFrame:
    return runs.join(ids.select("run_id").distinct(), "run_id", "left_semi")


def compared_runs(runs: DataFrame, base: str, others: Sequence[str]) -> DataFrame:
    """Base run and up to five others in request order; ``found`` is false for an unknown id."""
    if len(others) > MAX_COMPARED:
        raise ValueError(f"too many runs to compare, max {MAX_COMPARED}")
    asked = runs.sparkSession.createDataFrame(
        [(i, r) for i, r in enumerate([base, *others])], "position int, run_id string"
    )
    return asked.join(runs, "run_id", "left").withColumn("found", F.col("tag").isNotNull())


def metric_deltas(metrics: DataFrame, base: str) -> DataFrame:
    """Each run's compared metrics against the base run: ``delta`` and better / worse / same."""
    rules = F.array(
        *[
            F.struct(F.lit(m).alias("metric"), F.lit(k).alias("k"), F.lit(up).alias("higher_is_better"))
            for m, k, up in COMPARED_METRICS
        ]
    )
    rule = F.get(F.filter(rules, lambda r: (r["metric"] == F.col("metric")) & (r["k"] == F.col("k"))), F.lit(0))
    shown = metrics.withColumn("higher_is_better", rule["higher_is_better"]).filter("higher_is_better is not null")
    # at most one row per compared metric
    base_rows = shown.filter(F.col("run_id") == base).select("metric", "k", F.col("value").alias("base_value"))
    diff = F.col("value") - F.col("base_value")
    label = (
        F.when(F.col("base_value").isNull() | (F.abs(diff) < SAME_THRESHOLD), "same")
        .when((diff > 0) == F.col("higher_is_better"), "better")
        .otherwise("worse")
    )
    return shown.join(base_rows, ["metric", "k"], "left").select(
        "run_id", "metric", "k", "value", "base_value", diff.alias("delta"), label.alias("label")
    )


def best_runs(metrics: DataFrame, positions: DataFrame) -> DataFrame:
    """Best run per compared metric; ties go to the run listed first (``run_id, position``)."""
    lower = [m for m, _, up in COMPARED_METRICS if not up]
    signed = F.when(F.col("metric").isin(*lower), -F.col("value")).otherwise(F.col("value"))
    window = Window.partitionBy("metric", "k").orderBy(F.desc("signed"), F.asc("position"))
    known = F.struct("metric", "k").isin(*[F.struct(F.lit(m), F.lit(k)) for m, k, _ in COMPARED_METRICS])
    return (
        metrics.filter(known & F.col("value").isNotNull())
        .join(positions, "run_id")
        .withColumn("signed", signed)
        .withColumn("rn", F.row_number().over(window))
        .filter("rn = 1")
        .select("metric", "k", "run_id", "value")
    )


def metric_matrix(metrics: DataFrame, base: str, run_ids: Sequence[str]) -> DataFrame:
    """Rows are the four quality metrics, columns the runs, plus the largest distance from the base."""
    wanted = metrics.filter(
        F.col("metric").isin(*MATRIX_METRICS) & F.col("k").isin(0, 5) & F.col("run_id").isin(base, *run_ids)
    )
    wide = wanted.groupBy("metric").pivot("run_id", [base, *run_ids]).agg(F.first("value"))
    gaps = [F.abs(F.coalesce(F.col(f"`{r}`"), F.lit(0.0)) - F.coalesce(F.col(f"`{base}`"), F.lit(0.0))) for r in run_ids]
    largest = F.greatest(*gaps) if len(gaps) > 1 else (gaps[0] if gaps else F.lit(0.0))
    return wide.withColumn("max_abs_delta", largest)


def shorten(text: Column, width: int) -> Column:
    return F.when(F.length(text) > width, F.concat(F.substring(text, 1, width), F.lit("..."))).otherwise(text)


def category_breakdown(questions: DataFrame, top: int = 8) -> DataFrame:
    """The most frequent categories with mean score and mean first rank."""
    category = F.coalesce(F.col("category"), F.lit("Uncategorized"))
    return (
        questions.groupBy(category.alias("category"))
        .agg(
            F.count("*").alias("n"),
            F.avg(F.coalesce("answer_score", F.lit(0.0))).alias("avg_score"),
            F.avg(F.coalesce("rank_first", F.lit(0))).alias("avg_rank"),
        )
        .orderBy(F.desc("n"), F.asc("category"))
        .limit(top)
        .withColumn("category", shorten(F.col("category"), 20))
    )


def score_histogram(questions: DataFrame, upper: float = 10.0, bins: int = 10) -> DataFrame:
    """Counts of answer scores in equal bins over [0, upper]; empty bins show 0."""
    width = upper / bins
    score = F.col("answer_score")
    counted = (
        questions.filter(score.between(0, upper))
        .groupBy(F.least(F.floor(score / width), F.lit(bins - 1)).cast("int").alias("bin"))
        .agg(F.count("*").alias("n"))
    )
    axis = questions.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return axis.join(counted, "bin", "left").select(
        "bin",
        (F.col("bin") * width).alias("lower"),
        ((F.col("bin") + 1) * width).alias("upper"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def latency_buckets(questions: DataFrame) -> DataFrame:
    """Counts per latency bucket; every bucket is listed."""
    latency = F.col("latency_ms")
    label = F.lit(None).cast("string")
    for name, low, high in reversed(LATENCY_BUCKETS):
        inside = (latency >= low) if high is None else (latency >= low) & (latency < high)
        label = F.when(inside, name).otherwise(label)
    counted = questions.groupBy(label.alias("bucket")).agg(F.count("*").alias("n"))
    axis = questions.sparkSession.createDataFrame(
        [(i, name) for i, (name, _, _) in enumerate(LATENCY_BUCKETS)], "position int, bucket string"
    )
    return axis.join(counted, "bucket", "left").select("position", "bucket", F.coalesce("n", F.lit(0)).alias("n"))


def run_trend(runs: DataFrame, metrics: DataFrame, last: int = 20) -> DataFrame:
    """The newest runs in time order with four metrics each and the change of hit rate."""
    recent = runs.orderBy(F.desc("created_at"), F.asc("run_id")).limit(last).select("run_id", "tag", "created_at")

    def value(metric: str, k: int) -> Column:
        return F.max(F.when((F.col("metric") == metric) & (F.col("k") == k), F.col("value")))

    picked = metrics.groupBy("run_id").agg(
        value("hit_rate", 5).alias("hit_rate"),
        value("mrr", 0).alias("mrr"),
        value("ndcg", 5).alias("ndcg"),
        value("avg_answer_score", 0).alias("score"),
    )
    # a page of runs: the whole window is `last` rows
    page = recent.join(picked, "run_id", "left").withColumn("_page", F.lit(1))
    window = Window.partitionBy("_page").orderBy("created_at", F.desc("run_id"))
    return page.withColumn("position", F.row_number().over(window)).withColumn(
        "hit_rate_change", F.col("hit_rate") - F.lag("hit_rate").over(window)
    ).select(
        "position", shorten(F.col("tag"), 14).alias("tag"), "hit_rate", "mrr", "ndcg", "score", "hit_rate_change"
    )


def table_search(
    table: DataFrame, search: str, columns: Sequence[str], sort_by: str, *, descending: bool = False,
    limit: int = 10, page: int = 1, tie_break: str | None = None,
) -> DataFrame:
    """Case-insensitive substring search over some columns, sorted, one page."""
    hit = F.lit(False)
    for column in columns:
        hit = hit | F.contains(F.lower(F.col(column).cast("string")), F.lit(search.lower()))
    order = [F.desc(sort_by) if descending else F.asc(sort_by)]
    if tie_break:
        order.append(F.asc(tie_break))
    return table.filter(hit).orderBy(*order).offset((page - 1) * limit).limit(limit)


def metric_at(json_col: str, dotted: str) -> Column:
    """Number at a dotted path of a JSON column, null where it is missing or not a number."""
    path = "$" + "".join(f"['{part}']" for part in dotted.split("."))
    return F.get_json_object(F.col(json_col), path).try_cast("double")


def traffic_light(score: Column, good: float = 7.0, fair: float = 4.0) -> Column:
    return F.when(score >= good, "success").when(score >= fair, "warning").otherwise("destructive")


def overview(artifacts: DataFrame, indexes: DataFrame, runs: DataFrame, datasets: DataFrame) -> DataFrame:
    """Row counts of the four catalogues."""
    parts = [("Artifacts", artifacts), ("Indexes", indexes), ("Evaluation Runs", runs), ("Datasets", datasets)]
    rows = [t.agg(F.count("*").alias("n")).select(F.lit(label).alias("label"), "n") for label, t in parts]
    out = rows[0]
    for row in rows[1:]:
        out = out.unionByName(row)
    return out


def delete_runs(table: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of other runs; used on runs, questions and metrics alike (cascade)."""
    return table.join(ids.select("run_id"), "run_id", "left_anti")

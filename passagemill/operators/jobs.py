"""Job history: ``id, kind, state, args, attempt, max_attempts, created_at, attempted_at, finalized_at, errors``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagemill.operators.runs import rfc3339

# Stored state → shown state.
SHOWN_STATES = {
    "available": "available",
    "running": "running",
    "retryable": "retrying",
    "completed": "completed",
    "cancelled": "cancelled",
    "discarded": "failed",
}
ACTIVE_STATES = ("running", "retrying", "available")
RECENT_JOBS = 8
TIMELINE_JOBS = 10


def shown_state(state: Column) -> Column:
    out = F.lit("unknown")
    for stored, shown in SHOWN_STATES.items():
        out = F.when(state == stored, shown).otherwise(out)
    return out


def stored_state(shown: Column) -> Column:
    """Stored name of a shown state; null if there is none."""
    out = F.lit(None).cast("string")
    for stored, name in SHOWN_STATES.items():
        out = F.when(shown == name, stored).otherwise(out)
    return out


def job_tag(args: Column) -> Column:
    return F.coalesce(F.get_json_object(args, "$.tag"), F.lit(""))


def attempt_errors(errors: Column) -> Column:
    return F.transform(errors, lambda e: F.format_string("attempt %d: %s", e["attempt"], e["error"]))


def list_jobs(jobs: DataFrame, kind: str = "", states: str = "", limit: int = 20, offset: int = 0) -> DataFrame:
    """Jobs by kind and comma-separated shown states in id order, one page, with the filtered total.

    Unknown state names are ignored; if none is known, all states match.
    """
    chosen = jobs
    if kind:
        chosen = chosen.filter(F.col("kind") == kind)
    known = {shown: stored for stored, shown in SHOWN_STATES.items()}
    wanted = [known[s.strip()] for s in states.split(",") if s.strip() in known]
    if wanted:
        chosen = chosen.filter(F.col("state").isin(*wanted))
    page = chosen.orderBy("id").offset(offset).limit(limit)
    return page.withColumn("total", chosen.agg(F.count("*")).scalar()).select(
        "id",
        "kind",
        shown_state(F.col("state")).alias("state"),
        job_tag(F.col("args")).alias("tag"),
        "attempt",
        "max_attempts",
        rfc3339(F.col("created_at")).alias("created_at"),
        rfc3339(F.col("finalized_at")).alias("finalized_at"),
        "total",
    )


def active_jobs(jobs: DataFrame) -> DataFrame:
    shown = jobs.withColumn("state", shown_state(F.col("state")))
    return shown.filter(F.col("state").isin(*ACTIVE_STATES))


def recent_jobs(jobs: DataFrame, n: int = RECENT_JOBS) -> DataFrame:
    return jobs.withColumn("state", shown_state(F.col("state"))).orderBy(F.desc("created_at"), F.desc("id")).limit(n)


def with_pending(catalogue: DataFrame, jobs: DataFrame, name_col: str = "name") -> DataFrame:
    """Catalogue entries plus jobs whose tag has no entry yet (``pending`` true)."""
    pending = (
        jobs.select(
            job_tag(F.col("args")).alias(name_col),
            F.col("id").alias("job_id"),
            shown_state(F.col("state")).alias("job_state"),
        )
        .join(catalogue.select(name_col), name_col, "left_anti")
        .withColumn("pending", F.lit(True))
    )
    return catalogue.withColumn("pending", F.lit(False)).unionByName(pending, allowMissingColumns=True)


def job_status(jobs: DataFrame) -> DataFrame:
    """Status view of jobs: shown state, times, formatted errors."""
    return jobs.select(
        F.col("id").alias("job_id"),
        "kind",
        shown_state(F.col("state")).alias("state"),
        rfc3339(F.col("attempted_at")).alias("attempted_at"),
        rfc3339(F.col("finalized_at")).alias("completed_at"),
        attempt_errors(F.col("errors")).alias("errors"),
    )

"""Jobs: event checks, state folds, leases, attempts, checkpoints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# The order of states and the moves between them.
FLOW = ["CREATED", "INSPECTING", "SNAPSHOTTING", "EXTRACTING_EVIDENCE", "BUILDING_CLAIMS", "PLANNING", "RUNNING_TASKS", "VALIDATING_TASKS", "ASSEMBLING", "VALIDATING_FINAL", "PUBLISHING", "COMPLETED"]
TERMINAL = ["COMPLETED", "CANCELLED", "FAILED"]
EXTRA = {
    "VALIDATING_TASKS": ["NEEDS_ATTENTION"],
    "VALIDATING_FINAL": ["NEEDS_ATTENTION"],
    "NEEDS_ATTENTION": ["RUNNING_TASKS", "ASSEMBLING", "CANCELLING", "FAILED"],
    "CANCELLING": ["CANCELLED", "FAILED"],
    "FAILED": ["CREATED"],
}


def moves() -> list[tuple[str, str]]:
    out = {(a, b) for a, b in zip(FLOW, FLOW[1:])} | {(s, t) for s in FLOW[:-1] for t in ("CANCELLING", "FAILED")}
    return sorted(out | {(s, t) for s, ts in EXTRA.items() for t in ts})


def allowed(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(moves(), "from_state string, to_state string")


def sequence_violations(events: DataFrame, key: str, sequence: str, percent: str) -> DataFrame:
    """Events whose sequence is not the next one, or whose percentage falls."""
    w = Window.partitionBy(key).orderBy(sequence)
    e = events.withColumn("prev_sequence", F.lag(sequence).over(w)).withColumn("prev_percent", F.lag(percent).over(w))
    gap = F.col(sequence) != F.coalesce(F.col("prev_sequence"), F.lit(0)) + 1
    falls = F.col(percent) < F.col("prev_percent")
    return e.where(gap | falls).withColumn("violation", F.when(gap, "SEQUENCE").otherwise("PERCENTAGE"))


def transitions(events: DataFrame, key: str, order: list[str], state: str) -> DataFrame:
    """Each state with the one before and whether the move is allowed (the first must be CREATED)."""
    w = Window.partitionBy(key).orderBy(*order)
    t = events.withColumn("from_state", F.lag(state).over(w)).withColumn("to_state", F.col(state))
    ok = F.broadcast(allowed(events.sparkSession).withColumn("ok", F.lit(True)))  # a fixed table
    t = t.join(ok, ["from_state", "to_state"], "left")
    return t.withColumn("ok", F.coalesce("ok", F.when(F.col("from_state").isNull(), F.col("to_state") == "CREATED"), F.lit(False)))


def job_fold(events: DataFrame, key: str, order: list[str], state: str) -> DataFrame:
    """State, version and counters of each job from its event log."""
    return events.groupBy(key).agg(F.max_by(state, F.struct(*order)).alias("state"), F.count("*").alias("record_version"))


def latest_attempt(attempts: DataFrame, task: str = "task_id", attempt: str = "attempt") -> DataFrame:
    """Latest attempt of each task; attempts must run from 1 without a gap."""
    a = attempts.groupBy(task).agg(F.max(attempt).alias("latest"), F.countDistinct(attempt).alias("attempts"), F.min(attempt).alias("first"))
    return a.withColumn("complete", (F.col("first") == 1) & (F.col("latest") == F.col("attempts"))).drop("first")


def attempt_consistency(outputs: DataFrame, validations: DataFrame) -> DataFrame:
    """Outputs against validations per (task, attempt): PAIRED, IN_PROGRESS or ORPHAN."""
    j = outputs.select("task_id", "attempt", F.lit(1).alias("o")).join(validations.select("task_id", "attempt", F.lit(1).alias("v")), ["task_id", "attempt"], "full_outer")
    return j.select("task_id", "attempt", F.when(F.col("v").isNull(), "IN_PROGRESS").when(F.col("o").isNull(), "ORPHAN").otherwise("PAIRED").alias("status"))


def checkpoint(saved: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """MISSING, SAVED, IN_PROGRESS or INVALID for each expected group (``key, total``) from ``key, saved, valid``."""
    j = expected.join(saved, key, "left").withColumns({"saved": F.coalesce("saved", F.lit(0)), "valid": F.coalesce("valid", F.lit(True))})
    status = F.when(~F.col("valid") | (F.col("saved") > F.col("total")), "INVALID").when(F.col("saved") == 0, "MISSING").when(F.col("saved") == F.col("total"), "SAVED").otherwise("IN_PROGRESS")
    return j.withColumn("status", status)


def last_events(events: DataFrame, order: list[str], n: int) -> DataFrame:
    """The last n events."""
    return events.orderBy(*[F.desc(c) for c in order]).limit(n)


def recent(jobs: DataFrame, created: str, key: str, n: int) -> DataFrame:
    if not 1 <= n <= 1000:
        raise ValueError("limit must be 1 to 1000")
    return jobs.orderBy(F.desc(created), F.desc(key)).limit(n)


def runnable(jobs: DataFrame, state: str = "state") -> DataFrame:
    """Jobs with whether they have ended, and whether they may be started."""
    ended = F.col(state).isin(TERMINAL)
    return jobs.withColumns({"terminal": ended, "runnable": ~ended & (F.col(state) != "CANCELLING")})


def generations(events: DataFrame) -> DataFrame:
    """Distinct generations that each job has started."""
    return events.groupBy("job_id").agg(F.countDistinct(F.when(F.col("kind") == "STARTED", F.col("generation_id"))).alias("generations"))


def stream_tail(events: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """The last n events of each job, and whether there were more."""
    total = events.groupBy(key).agg(F.max(order).alias("last"), F.count("*").alias("total"))
    return events.join(total, key).where(F.col(order) > F.col("last") - n).withColumn("truncated", F.col("total") > n).drop("last", "total")

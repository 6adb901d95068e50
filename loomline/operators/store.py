"""The job store as an append-only event log: inserts, compare-and-set moves, progress, leases.

State is never updated in place: a job's state, version and counters are folds of its log, and
a write is a small batch that is checked against those folds and committed only if no other
commit came between (``sources.commits``); else it is checked again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.commits import CommitLog, View
from ..sources.sinks import Conflict
from . import jobs

LOG = "job_id string, version long, kind string, state string, sequence long, percentage long, message string, occurred_at timestamp"


def log(spark: SparkSession, path: str) -> DataFrame:
    """The events of all jobs; empty if nothing was written yet."""
    return CommitLog(spark, path, LOG).now().rows()


def folded(events: DataFrame) -> DataFrame:
    """One row a job: state, version, last sequence and percentage, times."""
    return events.groupBy("job_id").agg(
        F.max_by("state", F.when(F.col("state").isNotNull(), F.col("version"))).alias("state"),
        F.max("version").alias("record_version"),
        F.coalesce(F.max("sequence"), F.lit(0)).alias("last_event_sequence"),
        F.coalesce(F.max("percentage"), F.lit(0)).alias("last_percentage"),
        F.min("occurred_at").alias("created_at"),
        F.max("occurred_at").alias("updated_at"),
    )


def merged(old: DataFrame, new: DataFrame) -> DataFrame:
    """The fold of a log from the fold of its beginning and that of the rest."""
    n = new.select("job_id", *[F.col(c).alias(f"new_{c}") for c in new.columns if c != "job_id"])
    both = {"state": F.coalesce("new_state", "state"), "created_at": F.least("created_at", "new_created_at")}
    both |= {c: F.greatest(c, f"new_{c}") for c in ("record_version", "last_event_sequence", "last_percentage", "updated_at")}
    return old.join(n, "job_id", "full_outer").select("job_id", *[both[c].alias(c) for c in old.columns if c != "job_id"])


def rejected(events: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests that the log does not allow (see ``refused``)."""
    return refused(folded(events), requests)


def refused(state: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests that the folded jobs do not allow, with a ``violation_code``; at most one request a job.

    ``requests``: ``job_id, kind, expected, state, sequence, percentage``.  INSERT needs a new
    job; MOVE the expected state and an allowed move; PROGRESS the next sequence and a
    percentage from 0 to 100 that does not fall.
    """
    now = state.select("job_id", F.col("state").alias("now"), "last_event_sequence", "last_percentage")
    allowed = F.broadcast(jobs.allowed(state.sparkSession).select(F.col("from_state").alias("now"), F.col("to_state").alias("state"), F.lit(True).alias("allowed")))  # a fixed table
    j = requests.join(now, "job_id", "left").join(allowed, ["now", "state"], "left")
    known = F.col("now").isNotNull()
    many = F.count("*").over(Window.partitionBy("job_id")) > 1
    progress = (F.col("sequence") == F.col("last_event_sequence") + 1) & (F.col("percentage") >= F.col("last_percentage")) & F.col("percentage").between(0, 100)
    code = (
        F.when(F.col("many"), "ONE_REQUEST_A_JOB")
        .when(F.col("kind") == "INSERT", F.when(known, "JOB_ALREADY_EXISTS"))
        .when(~known, "JOB_NOT_FOUND")
        .when(F.col("kind") == "MOVE", F.when((F.col("now") != F.col("expected")) | F.col("allowed").isNull(), "JOB_STATE_CONFLICT"))
        .when(F.col("kind") == "PROGRESS", F.when(~F.coalesce(progress, F.lit(False)), "PROGRESS_EVENT_CONFLICT"))
        .otherwise("UNKNOWN_KIND")
    )
    return j.withColumn("many", many).withColumn("violation_code", code).where("violation_code is not null").select("job_id", "kind", "violation_code")


def granted(state: DataFrame, requests: DataFrame) -> DataFrame:
    """The events that allowed requests add to the log."""
    bad = refused(state, requests).select("job_id").distinct()
    good = requests.join(bad, "job_id", "left_anti").join(state.select("job_id", "record_version"), "job_id", "left")
    to = F.when(F.col("kind") == "INSERT", "CREATED").when(F.col("kind") == "MOVE", F.col("state"))
    done = F.when(F.col("kind") == "PROGRESS", F.col("percentage")).when(to == "COMPLETED", F.lit(100).cast("long"))
    sequence = F.when(F.col("kind") == "PROGRESS", F.col("sequence"))
    return good.select("job_id", (F.coalesce("record_version", F.lit(0)) + 1).alias("version"), "kind", to.alias("state"), sequence.alias("sequence"), done.alias("percentage"), "message", "occurred_at")


def append(path: str, requests: DataFrame, every: int = 20) -> DataFrame:
    """Commit all requests or none; returns the jobs as they are afterwards.

    Many may write at once: a commit holds only if the jobs are still those that it was checked
    against.  A copy of the folded jobs is kept at each ``every``-th version, so a check reads
    that and the commits since.
    """
    events = CommitLog(requests.sparkSession, path, LOG)

    def check(view: View) -> DataFrame:
        now = view.state(folded, merged)
        bad = refused(now, requests).limit(1).collect()
        if bad:
            raise Conflict(bad[0]["violation_code"])
        return granted(now, requests)

    view = events.commit(check)
    after = view.state(folded, merged)
    events.keep_state(view, after, every)
    return after


LEASE = "job_id string, at long, seq long, action string, runner_token string, process_id long, lifecycle string, error_code string"


def lease_fold(actions: DataFrame) -> DataFrame:
    """The lease of each job from its actions in order of ``at, seq``: LAUNCH, CLAIM, HEARTBEAT, FINISH.

    A launch begins a new lease.  Other actions count if the runner's token owns the lease, the
    lifecycle allows them, the process is the one that claimed it and time does not go back;
    those that do not are counted as conflicts and change nothing.  A repeated claim or finish
    of the same kind is none.  A job's actions are one array: heartbeats of one job, not of all.
    """
    a = F.struct("at", "seq", "action", "runner_token", "process_id", "lifecycle", "error_code")
    seq = actions.groupBy("job_id").agg(F.array_sort(F.collect_list(a)).alias("s"))
    kinds = "runner_token string, launch_sequence long, process_id long, lifecycle string, heartbeat_at long, finished_at long, error_code string, conflicts long"
    none = {k.split()[0]: F.lit(0 if k.split()[0] in ("launch_sequence", "conflicts") else None).cast(k.split()[1]) for k in kinds.split(", ")}
    start = F.struct(*[v.alias(k) for k, v in none.items()])

    def step(s, x):
        over = s["lifecycle"].isin("EXITED", "FAILED")
        mine = F.coalesce(s["runner_token"] == x["runner_token"], F.lit(False))
        onward = F.coalesce(x["at"] >= s["heartbeat_at"], F.lit(False))
        process = s["process_id"].eqNullSafe(x["process_id"])
        ended = x["lifecycle"].isin("EXITED", "FAILED")
        launch = x["action"] == "LAUNCH"
        claim = (x["action"] == "CLAIM") & mine & (s["lifecycle"] == "LAUNCHING") & onward
        beat = (x["action"] == "HEARTBEAT") & mine & (s["lifecycle"] == "RUNNING") & process & onward
        finish = (x["action"] == "FINISH") & mine & ended & ~over & process & onward
        claimed = (x["action"] == "CLAIM") & mine & (s["lifecycle"] == "RUNNING") & process
        finished = (x["action"] == "FINISH") & mine & over & (s["lifecycle"] == x["lifecycle"]) & process & s["error_code"].eqNullSafe(x["error_code"])
        ok = [F.coalesce(c, F.lit(False)) for c in (launch, claim, beat, finish, claimed | finished)]
        pick = lambda *values: F.when(ok[0], values[0]).when(ok[1], values[1]).when(ok[2], values[2]).when(ok[3], values[3])
        keep = lambda name, *values: pick(*values).otherwise(s[name]).alias(name)
        null = lambda kind: F.lit(None).cast(kind)
        return F.struct(
            keep("runner_token", x["runner_token"], s["runner_token"], s["runner_token"], s["runner_token"]),
            (s["launch_sequence"] + F.when(ok[0], 1).otherwise(0)).cast("long").alias("launch_sequence"),
            keep("process_id", null("long"), x["process_id"], s["process_id"], s["process_id"]),
            keep("lifecycle", F.lit("LAUNCHING"), F.lit("RUNNING"), s["lifecycle"], x["lifecycle"]),
            keep("heartbeat_at", x["at"], x["at"], x["at"], x["at"]),
            keep("finished_at", null("long"), s["finished_at"], s["finished_at"], x["at"]),
            keep("error_code", null("string"), s["error_code"], s["error_code"], x["error_code"]),
            (s["conflicts"] + F.when(ok[0] | ok[1] | ok[2] | ok[3] | ok[4], 0).otherwise(1)).cast("long").alias("conflicts"),
        )

    return seq.select("job_id", F.aggregate("s", start, step).alias("l")).select("job_id", "l.*")


def cancellable(spark: SparkSession, job_id: str):
    """A context in which all Spark jobs of this thread carry the job's tag, for ``cancel``."""
    from contextlib import contextmanager

    @contextmanager
    def tagged():
        sc = spark.sparkContext
        sc.addJobTag(f"job-{job_id}")
        sc.setInterruptOnCancel(True)
        try:
            yield spark
        finally:
            sc.removeJobTag(f"job-{job_id}")

    return tagged()


def cancel(spark: SparkSession, job_id: str) -> None:
    """Stop the streams named after the job and cancel its running Spark jobs; their tasks are interrupted."""
    for q in spark.streams.active:
        if q.name == f"job-{job_id}":
            q.stop()
    spark.sparkContext.cancelJobsWithTag(f"job-{job_id}")

"""Running a plan: attempts and resume, repair, research for tasks, map and reduce through a port.

Model calls are ports: functions from a DataFrame of requests to a DataFrame of answers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ids
from . import graph, jobs, packing

MOST_ATTEMPTS = 3  # fixed value
Port = Callable[[DataFrame], DataFrame]


def attempt_errors(outputs: DataFrame, validations: DataFrame, most: int = MOST_ATTEMPTS) -> DataFrame:
    """Tasks whose stored attempts are not pairs of output and report numbered 1, 2, ... up to ``most`` (must be empty)."""
    pairs = jobs.attempt_consistency(outputs, validations)
    odd = pairs.where("status <> 'PAIRED'").select("task_id", F.lit("UNPAIRED").alias("violation"))
    n = jobs.latest_attempt(pairs)
    gap = n.where(~F.col("complete")).select("task_id", F.lit("GAP").alias("violation"))
    many = n.where(F.col("latest") > most).select("task_id", F.lit("TOO_MANY").alias("violation"))
    return odd.unionByName(gap).unionByName(many).distinct()


def resume(plan: DataFrame, outputs: DataFrame, validations: DataFrame, most: int = MOST_ATTEMPTS) -> DataFrame:
    """For each task of a plan (``task_id, position``): attempts so far, and the next one if it is still to run.

    A stored attempt is accepted whatever its report says, as older reports came from a gate
    that no longer holds tasks back; only tasks without any attempt run.
    """
    done = jobs.attempt_consistency(outputs, validations).where("status = 'PAIRED'").groupBy("task_id").agg(F.max("attempt").alias("latest"))
    j = plan.join(done, "task_id", "left").withColumn("latest", F.coalesce("latest", F.lit(0)).cast("long"))
    return j.withColumn("next_attempt", F.when((F.col("latest") == 0) & (F.lit(most) >= 1), F.lit(1).cast("long")))


def loaded(plan: DataFrame, outputs: DataFrame, validations: DataFrame) -> DataFrame:
    """The results that a finished part of a plan holds: those before the first task without any.

    ``task_id, position, latest`` of the tasks that count; found by one combined minimum.
    """
    state = resume(plan, outputs, validations)
    first = state.agg(F.min(F.when(F.col("latest") == 0, F.col("position"))).alias("first_open")).withColumn("one", F.lit(1))
    j = state.withColumn("one", F.lit(1)).join(F.broadcast(first), "one")  # one row
    return j.where(F.col("first_open").isNull() | (F.col("position") < F.col("first_open"))).select("task_id", "position", "latest")


def run_plan(plan: DataFrame, outputs: DataFrame, validations: DataFrame, generate: Port, validate: Port, most: int = MOST_ATTEMPTS) -> tuple[DataFrame, DataFrame, bool]:
    """Run what is open and return all outputs and reports, and whether the plan is complete.

    ``generate`` takes tasks with ``attempt`` and the previous report (null at first) and
    returns ``task_id, attempt, ...`` outputs; ``validate`` takes outputs and returns
    ``task_id, attempt, valid``.  Rejected outputs run again, up to ``most`` attempts.
    """
    open_ = graph.cut(resume(plan, outputs, validations, most).where("next_attempt is not null").select(*plan.columns, F.col("next_attempt").alias("attempt")).withColumn("previous_valid", F.lit(None).cast("boolean")))
    for _ in range(most):
        if open_.isEmpty():
            break
        made = graph.cut(generate(open_))
        judged = graph.cut(validate(made))
        outputs, validations = outputs.unionByName(made.select(outputs.columns)), validations.unionByName(judged.select(validations.columns))
        again = judged.where(~F.col("valid") & (F.col("attempt") < most)).select("task_id", (F.col("attempt") + 1).alias("attempt"), F.col("valid").alias("previous_valid"))
        open_ = graph.cut(plan.join(again, "task_id"))
    best = validations.groupBy("task_id").agg(F.max_by("valid", "attempt").alias("valid"))
    complete = plan.join(best, "task_id", "left").where(~F.coalesce("valid", F.lit(False))).isEmpty()
    return outputs, validations, complete


def with_repair(requests: DataFrame, generate: Port, accepted: Callable[[DataFrame], DataFrame], key: str) -> tuple[DataFrame, DataFrame]:
    """One more try for answers that are not accepted, with the answer as feedback: (accepted answers, keys given up).

    ``generate`` takes requests with ``feedback`` (null at first) and returns ``key, answer``;
    ``accepted`` keeps the good ones.
    """
    first = graph.cut(generate(requests.withColumn("feedback", F.lit(None).cast("string"))))
    good = accepted(first)
    bad = first.join(good.select(key), key, "left_anti").select(key, F.col("answer").alias("feedback"))
    second = graph.cut(generate(requests.join(bad, key)))
    again = accepted(second)
    return good.unionByName(again.select(good.columns)), second.join(again.select(key), key, "left_anti").select(key)


def with_halving(batches: DataFrame, run: Port, accepted: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Answers of batches (``batch_id, members``); a batch whose answer is not accepted is halved and both halves run again.

    Returns (``batch_id, members, answer`` of what was accepted, ``batch_id, members`` of single
    members given up).  ``run`` takes batches and returns ``batch_id, answer``.  Half a batch has
    its id with L or R behind it; a batch holds a bounded number of members, so rounds are few.
    """
    open_, good, lost = graph.cut(batches.select("batch_id", "members")), None, None
    add = lambda a, b: b if a is None else a.unionByName(b)
    while not open_.isEmpty():
        made = graph.cut(accepted(run(open_)).select("batch_id", "answer"))
        good = add(good, open_.join(made, "batch_id"))
        bad = open_.join(made, "batch_id", "left_anti")
        lost = add(lost, bad.where(F.size("members") <= 1))
        middle = F.floor(F.size("members") / 2).cast("int")
        half = lambda side, part: F.struct(F.concat("batch_id", F.lit(side)).alias("batch_id"), part.alias("members"))
        halves = F.array(half("L", F.slice("members", F.lit(1), middle)), half("R", F.slice("members", middle + 1, F.size("members"))))
        open_ = graph.cut(bad.where(F.size("members") > 1).select(F.explode(halves).alias("h")).select("h.*"))
    if good is None:
        good, lost = batches.limit(0).select("batch_id", "members", F.lit("").alias("answer")), batches.limit(0).select("batch_id", "members")
    return good, lost


def task_research(packets: DataFrame, assessments: DataFrame, status: str = "SEARCHED") -> DataFrame:
    """Tasks (``task_id, owned_claim_ids``) with the assessments of their claims; null where research is off or says nothing."""
    if status == "DISABLED":
        return packets.withColumn("assessments", F.lit(None).cast("array<struct<claim_id:string,verdict:string>>"))
    owned = packets.select("task_id", F.explode("owned_claim_ids").alias("claim_id"))
    found = owned.join(assessments.select("claim_id", "verdict"), "claim_id").groupBy("task_id").agg(F.array_sort(F.collect_list(F.struct("claim_id", "verdict"))).alias("assessments"))
    return packets.join(found, "task_id", "left")


def integrate(chunks: DataFrame, group: list[str], map_port: Port, reduce_port: Port, capacity: int, result_tokens: int, separator: int = 0, overhead: int = 0) -> DataFrame:
    """Map batches of chunks, then rounds of reduces, until each group has one text: ``group, result_id, text, generations``.

    ``chunks``: group, ``ordinal, chunk_id, model_token_count, text``.  The ports take
    ``result_id, parts`` (texts in order) and return ``result_id, text``.
    """
    items = chunks.select(*group, F.col("ordinal").alias("o"), F.col("chunk_id").alias("item"), (F.col("model_token_count") + overhead).alias("size"), "text")
    level, port, generations, before = graph.cut(items), map_port, None, None
    for k in range(50):
        purpose = "map" if k == 0 else "reduce"
        b = packing.next_fit(level, group, "o", "item", "size", capacity, separator)
        b = b.withColumn("result_id", ids.result_id(ids.batch_id(purpose, F.lit(max(0, k - 1)), F.col("batch_ordinal"), F.col("item_ids").cast("array<string>"))))
        parts = b.select("result_id", *group, F.posexplode("item_ids").alias("pos", "item")).join(level.select(*group, "item", "text"), [*group, "item"])
        parts = parts.groupBy("result_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]).alias("parts"))
        made = port(parts)
        level = graph.cut(b.join(made, "result_id").select(*group, F.col("batch_ordinal").alias("o"), F.col("result_id").alias("item"), F.lit(result_tokens).alias("size"), "text"))
        count = level.groupBy(*group).agg(F.count("*").alias("n"))
        generations = count if generations is None else generations.unionByName(count)
        many = count.where("n > 1")
        if many.isEmpty():
            total = generations.groupBy(*group).agg(F.sum("n").alias("generations"))
            return level.join(total, group).select(*group, F.col("item").alias("result_id"), "text", "generations")
        n = level.count()
        if before is not None and n >= before:
            raise ValueError("PLAN_NO_PROGRESS")
        before = n
        port = reduce_port
    raise ValueError("PLAN_NO_PROGRESS")

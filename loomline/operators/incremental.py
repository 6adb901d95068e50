"""What has to run again after a change, and running only that.

Each stage has a version (of its rules, prompts or models) and needs other stages; each input key
has a fingerprint.  A result of a stage for a key is known by the digest of the key's fingerprint
and of the versions of the stage and of all that it needs, directly or not.  What has the same
digest as before is kept, anything else runs; results are added and never overwritten.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import graph


def closure(needs: DataFrame, limit: int = 100_000) -> DataFrame:
    """``stage, upstream``: everything that each stage of ``needs`` (``stage, needs``) needs, by semi-naive rounds.

    A round follows only what the round before found; cycles end, as nothing is found twice.
    """
    step = graph.cut(needs.select("stage", F.col("needs").alias("upstream")).distinct())
    found = frontier = step
    for _ in range(limit):
        further = frontier.select("stage", F.col("upstream").alias("via")).join(step.select(F.col("stage").alias("via"), "upstream"), "via").select("stage", "upstream").distinct()
        frontier = graph.cut(further.join(found, ["stage", "upstream"], "left_anti"))
        if frontier.isEmpty():
            return found
        found = found.unionByName(frontier)
    raise RuntimeError("closure did not settle")


def lineage(stages: DataFrame, needs: DataFrame) -> DataFrame:
    """``stage, lineage``: a digest of the versions (``stages``: ``stage, version``) of each stage and all that it needs."""
    up = closure(needs).unionByName(stages.select("stage", F.col("stage").alias("upstream"))).distinct()
    v = up.join(stages.select(F.col("stage").alias("upstream"), "version"), "upstream", "left")
    entry = F.concat_ws("=", "upstream", F.coalesce("version", F.lit("")))
    return v.groupBy("stage").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(entry)), ";"), 256).alias("lineage"))  # an entry a stage


def affected(needs: DataFrame, changed: DataFrame) -> DataFrame:
    """``stage`` of ``changed`` and of all stages that need one of them, directly or not."""
    below = closure(needs).join(changed.select(F.col("stage").alias("upstream")), "upstream", "left_semi")
    return changed.select("stage").unionByName(below.select("stage")).distinct()


def plan(before: DataFrame, inputs: DataFrame, stages: DataFrame, needs: DataFrame) -> DataFrame:
    """``stage, key, fingerprint, action`` of every stage and key, now or before: RUN, KEEP or GONE.

    ``before``: ``stage, key, fingerprint`` as of the last run; ``inputs``: ``key, fingerprint``;
    stages are a definition of some hundreds at most.
    """
    known = [(r["stage"], r["lineage"]) for r in lineage(stages, needs).collect()]  # a row a stage
    if not known:
        return before.select("stage", "key", "fingerprint", F.lit("GONE").alias("action"))
    each = F.explode(F.array(*[F.struct(F.lit(s).alias("stage"), F.lit(h).alias("lineage")) for s, h in known]))
    now = inputs.select("key", "fingerprint", each.alias("s"))
    now = now.select(F.col("s.stage").alias("stage"), "key", F.sha2(F.concat_ws("|", "s.lineage", "fingerprint"), 256).alias("now"))
    j = now.join(before.select("stage", "key", F.col("fingerprint").alias("was")), ["stage", "key"], "full_outer")
    action = F.when(F.col("now").isNull(), "GONE").when(F.col("now") == F.col("was"), "KEEP").otherwise("RUN")
    return j.select("stage", "key", F.coalesce("now", "was").alias("fingerprint"), action.alias("action"))


def refresh(results: DataFrame, inputs: DataFrame, planned: DataFrame, stage: str, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A stage's ``results`` (``key, ...``) brought up to date: ``compute`` sees the inputs of the keys to run, no others."""
    mine = planned.where(F.col("stage") == stage)
    keys = lambda action: mine.where(F.col("action") == action).select("key")
    return results.join(keys("KEEP"), "key", "left_semi").unionByName(compute(inputs.join(keys("RUN"), "key", "left_semi")))

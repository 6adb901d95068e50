"""Task planning: consolidation of topics, ownership and coverage, packets, references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ordered_unique(pos: Column, value: Column) -> Column:
    """Distinct values of a group in the order of first appearance."""
    return F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct(pos.alias("p"), value.alias("v")))), lambda x: x["v"]))


def consolidate(definitions: DataFrame, key: str, pos: str) -> DataFrame:
    """One task per topic key: first id and title, ordered union of claims and sections, longest objective.

    ``task_id, title, objective, owned_claim_ids, required_sections`` plus ``key`` and ``pos``.
    """
    flat = lambda c: F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.col(c).alias("v")))), lambda x: x["v"])))
    return definitions.groupBy(key).agg(
        F.min_by("task_id", pos).alias("task_id"),
        F.min_by("title", pos).alias("title"),
        F.max_by("objective", F.struct(F.length("objective"), "objective")).alias("objective"),
        flat("owned_claim_ids").alias("owned_claim_ids"),
        flat("required_sections").alias("required_sections"),
        F.min(pos).alias("first_pos"),
    )


def rewritten_dependencies(depends: DataFrame, moved: DataFrame) -> DataFrame:
    """Dependencies ``node, needs`` after tasks moved to their topic's task (``old, new``); none on itself."""
    side = lambda c: moved.select(F.col("old").alias(c), F.col("new").alias(f"{c}_new"))
    j = depends.join(side("node"), "node", "left").join(side("needs"), "needs", "left")
    j = j.select(F.coalesce("node_new", "node").alias("node"), F.coalesce("needs_new", "needs").alias("needs"))
    return j.where("node <> needs").distinct()


def owner_coverage(claims: DataFrame, owned: DataFrame) -> DataFrame:
    """Full outer check of claims against owners: OWNED, MISSING, DUPLICATE or UNKNOWN."""
    o = owned.groupBy("claim_id").agg(F.count("*").alias("owners"), F.min("task_id").alias("owner_task_id"))
    j = claims.select("claim_id", F.lit(1).alias("known")).distinct().join(o, "claim_id", "full_outer")
    status = F.when(F.col("known").isNull(), "UNKNOWN").when(F.col("owners").isNull(), "MISSING").when(F.col("owners") > 1, "DUPLICATE").otherwise("OWNED")
    return j.select("claim_id", "owner_task_id", F.coalesce("owners", F.lit(0)).cast("long").alias("owners"), status.alias("status"))


def evidence_tasks(owned: DataFrame, claim_evidence: DataFrame) -> DataFrame:
    """Sorted tasks of each piece of evidence."""
    return owned.join(claim_evidence, "claim_id").groupBy("evidence_id").agg(F.array_sort(F.collect_set("task_id")).alias("task_ids"))


def context_claims(owned: DataFrame, relations: DataFrame) -> DataFrame:
    """Claims that a task sees through relations but does not own (two equi-joins instead of an OR)."""
    r = relations.select("left_id", "right_id")
    seen = owned.join(r, owned["claim_id"] == r["left_id"]).select("task_id", F.col("right_id").alias("claim_id"))
    seen = seen.union(owned.join(r, owned["claim_id"] == r["right_id"]).select("task_id", F.col("left_id").alias("claim_id"))).distinct()
    return seen.join(owned, ["task_id", "claim_id"], "left_anti")


def visible_relations(visible: DataFrame, relations: DataFrame) -> DataFrame:
    """Relations with both ends visible to a task."""
    left = relations.join(visible.select("task_id", F.col("claim_id").alias("left_id")), "left_id")
    return left.join(visible.select("task_id", F.col("claim_id").alias("right_id")), ["task_id", "right_id"], "left_semi")


def unknown_dependencies(depends: DataFrame, tasks: DataFrame) -> DataFrame:
    return depends.join(tasks.select(F.col("task_id").alias("needs")), "needs", "left_anti")


def compact_refs(rows: DataFrame, group: list[str], order: list[str], prefix: str) -> DataFrame:
    """Short references C000001, C000002, ... in input order."""
    from . import packing

    return packing.ranked(rows, group, order).withColumn("ref", F.format_string(f"{prefix}%06d", F.col("rn") + 1)).drop("rn", "n")


def resolve_refs(used: DataFrame, refs: DataFrame, group: list[str], id_: str) -> DataFrame:
    """Ids of short references (``group, ref``) by ``refs`` (``group, ref, id``); ``known`` is false where there is none."""
    known = refs.select(*group, "ref", F.col(id_)).withColumn("known", F.lit(True))
    return used.join(known, [*group, "ref"], "left").withColumn("known", F.coalesce("known", F.lit(False)))


def shards(owned: DataFrame, most: int = 8) -> DataFrame:
    """Tasks with ``most`` claims or more are halved until each shard has fewer."""
    w = Window.partitionBy("task_id").orderBy("pos")
    n = owned.withColumn("rn", F.row_number().over(w) - 1).withColumn("n", F.count("*").over(Window.partitionBy("task_id")))
    depth = F.greatest(F.lit(0), F.ceil(F.log2((F.col("n") + 1) / most)).cast("int"))
    parts = F.pow(F.lit(2), depth).cast("long")
    return n.withColumn("shard", F.floor(F.col("rn") * parts / F.col("n"))).drop("rn", "n")


MOST_PLAN_CLAIMS = 40  # fixed value


def planner_rows(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """Claims as the planner sees them: kind, statement, sorted source paths, and which lists they have."""
    paths = claims.select("claim_id", F.explode("evidence_ids").alias("evidence_id")).join(evidence.select("evidence_id", "relative_path"), "evidence_id")
    paths = paths.groupBy("claim_id").agg(F.array_sort(F.collect_set("relative_path")).alias("source_paths"))
    has = [(F.size(c) > 0).alias(f"has_{c}") for c in ("preconditions", "commands", "warnings")]
    return claims.select("claim_id", "kind", "statement", *has).join(paths, "claim_id", "left").withColumn("source_paths", F.coalesce("source_paths", F.array().cast("array<string>")))


def planning_batches(claims: DataFrame, plan: str = "plan_id", most: int = MOST_PLAN_CLAIMS) -> DataFrame:
    """Batches of at most ``most`` claims that keep components of relations together.

    ``plan, root, claim_id, first_path, folded``: components go in the order of their first
    claim (path, folded statement, id); one larger than a batch is cut; a part that does not
    fit the open batch starts the next.  A plan is one job's ledger and is folded as one array of parts.
    """
    from . import packing

    key = ["first_path", "folded", "claim_id"]
    rank = F.row_number().over(Window.partitionBy(plan, "root").orderBy(*key)) - 1
    c = claims.withColumn("rn", rank).withColumn("part", F.floor(F.col("rn") / most))
    lead = F.min(F.struct(*key)).over(Window.partitionBy(plan, "root")).alias("lead")
    c = c.select("*", lead)
    parts = c.groupBy(plan, "root", "lead", "part").agg(F.count("*").alias("size"))
    order = F.struct("lead.first_path", "lead.folded", "lead.claim_id", "part")
    parts = parts.withColumns({"order": order, "item": F.struct("root", "part")})
    b = packing.next_fit(parts, [plan], "order", "item", "size", most)
    b = b.select(plan, "batch_ordinal", F.explode("item_ids").alias("i")).select(plan, "batch_ordinal", "i.root", "i.part")
    return c.join(b, [plan, "root", "part"]).select(plan, "batch_ordinal", "claim_id", "root", "rn", *[F.col(f"lead.{k}").alias(f"lead_{k}") for k in key])


def ownership_overlap(packets: DataFrame) -> DataFrame:
    """Tasks that own a claim which is also their context (must be empty)."""
    both = F.array_intersect("owned_claim_ids", "context_claim_ids")
    return packets.select("task_id", F.array_sort(both).alias("claim_ids")).where(F.size("claim_ids") > 0)


def restricted(relations: DataFrame, claims: DataFrame) -> DataFrame:
    """Relations whose two ends are among the claims."""
    left = relations.join(claims.select(F.col("claim_id").alias("left_id")).distinct(), "left_id", "left_semi")
    return left.join(claims.select(F.col("claim_id").alias("right_id")).distinct(), "right_id", "left_semi")


def coverage_matrix(owned: DataFrame, claims: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(claim coverage, evidence coverage) of a plan: the owner of each claim; the tasks that see each piece of evidence.

    ``owned``: ``task_id, claim_id``; ``claims``: ``claim_id, evidence_ids``.  A task sees the
    evidence of what it owns and of what its claims are related to.
    """
    seen = owned.select("task_id", "claim_id").unionByName(context_claims(owned, relations).select("task_id", "claim_id"))
    pairs = claims.select("claim_id", F.explode("evidence_ids").alias("evidence_id"))
    return owner_coverage(claims, owned), evidence_tasks(seen, pairs)


def namespaced(plans: DataFrame, depends: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tasks (``batch, batches, task_id``) and dependencies (``batch, node, needs``) under ids that are unique over batches."""
    short = F.regexp_replace(F.concat(F.format_string("p%03d-%03d-", "batch", "batches"), F.substring("task_id", 1, 55)), "-+$", "")
    named = plans.withColumn("new_id", short)
    side = lambda c: named.select("batch", F.col("task_id").alias(c), F.col("new_id").alias(f"{c}_id"))
    d = depends.join(side("node"), ["batch", "node"]).join(side("needs"), ["batch", "needs"])
    return named, d.select(F.col("node_id").alias("node"), F.col("needs_id").alias("needs"))

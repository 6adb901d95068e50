"""Queries of plans, their execution, the job store and the search index, each with its DuckDB form.

Orders stand for claims, their lines' parts for evidence, messages for task content.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules, text
from ..operators import assembly, claims, execution, graph, jobs, research, store, tasks
from ..sources import commits
from .catalogue import DOCS_SQL, FOLD_SQL, ORACLES, docs, load, query

_EVIDENCE_SQL = "SELECT l_orderkey AS claim_id, list(DISTINCT l_partkey) AS evidence_ids FROM lineitem GROUP BY l_orderkey"
_PATHS_SQL = f"SELECT claim_id, array_to_string(list_sort(list_distinct(list(p_brand || '.md'))), ',') AS paths FROM (SELECT claim_id, unnest(evidence_ids) AS e FROM ({_EVIDENCE_SQL})) JOIN part ON p_partkey = e GROUP BY claim_id"


def _order_claims(spark, sf_dir) -> DataFrame:
    e = load(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("claim_id")).agg(F.collect_set("l_partkey").alias("evidence_ids"))
    some = lambda c: F.when(c, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>"))
    o = load(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("claim_id"),
        F.col("o_orderstatus").alias("kind"),
        F.concat_ws(" ", "o_orderpriority", "o_custkey").alias("statement"),
        some(F.col("o_orderpriority") == "1-URGENT").alias("preconditions"),
        some(F.col("o_totalprice") > 200000).alias("commands"),
        some(F.col("o_orderstatus") == "F").alias("warnings"),
    )
    return o.join(e, "claim_id", "left").withColumn("evidence_ids", F.coalesce("evidence_ids", F.array().cast("array<bigint>")))


def _part_evidence(spark, sf_dir) -> DataFrame:
    return load(spark, sf_dir, "part").select(F.col("p_partkey").alias("evidence_id"), F.concat("p_brand", F.lit(".md")).alias("relative_path"))


@query(f"""SELECT o_orderkey AS claim_id, o_orderstatus AS kind, o_orderpriority = '1-URGENT' AS has_preconditions, o_totalprice > 200000 AS has_commands, o_orderstatus = 'F' AS has_warnings, coalesce(paths, '') AS paths
 FROM orders LEFT JOIN ({_PATHS_SQL}) p ON p.claim_id = o_orderkey""")
def planner_projection(spark, sf_dir):
    p = tasks.planner_rows(_order_claims(spark, sf_dir), _part_evidence(spark, sf_dir))
    return p.select("claim_id", "kind", "has_preconditions", "has_commands", "has_warnings", F.array_join("source_paths", ",").alias("paths"))


@query("""WITH RECURSIVE c AS (SELECT o_custkey % 7 AS plan_id, CASE WHEN o_custkey % 7 = 3 THEN 0 ELSE o_orderkey // 5 END AS root, o_orderkey AS claim_id, o_orderpriority AS path, o_orderstatus AS folded FROM orders),
 r AS (SELECT *, row_number() OVER w - 1 AS rn, first_value(path) OVER w AS l1, first_value(folded) OVER w AS l2, first_value(claim_id) OVER w AS l3 FROM c WINDOW w AS (PARTITION BY plan_id, root ORDER BY path, folded, claim_id)),
 p AS (SELECT plan_id, root, rn // 40 AS part, count(*) AS size, min(l1) AS l1, min(l2) AS l2, min(l3) AS l3 FROM r GROUP BY ALL),
 o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY plan_id ORDER BY l1, l2, l3, part) AS k FROM p),
 f AS (SELECT plan_id, root, part, k, size AS held, 0::BIGINT AS b FROM o WHERE k = 1
  UNION ALL SELECT o.plan_id, o.root, o.part, o.k, CASE WHEN f.held + o.size > 40 THEN o.size ELSE f.held + o.size END, CASE WHEN f.held + o.size > 40 THEN f.b + 1 ELSE f.b END FROM f JOIN o ON o.plan_id = f.plan_id AND o.k = f.k + 1)
 SELECT f.plan_id, f.b AS batch_ordinal, CAST(count(*) AS BIGINT) AS claims, min(claim_id) AS first_claim, max(claim_id) AS last_claim FROM f JOIN r ON r.plan_id = f.plan_id AND r.root = f.root AND r.rn // 40 = f.part GROUP BY f.plan_id, f.b""")
def planning_batches(spark, sf_dir):
    plan = F.col("o_custkey") % 7
    root = F.when(plan == 3, F.lit(0).cast("long")).otherwise(F.floor(F.col("o_orderkey") / 5))
    c = load(spark, sf_dir, "orders").select(plan.alias("plan_id"), root.alias("root"), F.col("o_orderkey").alias("claim_id"), F.col("o_orderpriority").alias("first_path"), F.col("o_orderstatus").alias("folded"))
    return tasks.planning_batches(c).groupBy("plan_id", "batch_ordinal").agg(F.count("*").alias("claims"), F.min("claim_id").alias("first_claim"), F.max("claim_id").alias("last_claim"))


_RELATIONS_SQL = "SELECT o_orderkey % 300 AS left_id, o_custkey AS right_id, ['CONFLICT','COMPLEMENTARY','UNRELATED','EXACT_DUPLICATE','SOMETHING'][(o_orderkey // 300) % 5 + 1] AS relation FROM orders"


def _order_relations(spark, sf_dir) -> DataFrame:
    label = F.element_at(F.array(*[F.lit(x) for x in ("CONFLICT", "COMPLEMENTARY", "UNRELATED", "EXACT_DUPLICATE", "SOMETHING")]), (F.floor(F.col("o_orderkey") / 300) % 5 + 1).cast("int"))
    return load(spark, sf_dir, "orders").select((F.col("o_orderkey") % 300).alias("left_id"), F.col("o_custkey").alias("right_id"), label.alias("relation"))


@query(f"""WITH r AS ({_RELATIONS_SQL}), n AS (SELECT least(left_id, right_id) AS x, greatest(left_id, right_id) AS y, count(*) AS n FROM r GROUP BY ALL), k AS (SELECT c_custkey, c_custkey % 2 AS side FROM customer WHERE c_custkey % 5 <> 4)
 SELECT * FROM (SELECT r.*, CASE WHEN a.c_custkey IS NULL OR b.c_custkey IS NULL THEN 'UNKNOWN_REFERENCE' WHEN relation IN ('UNRELATED', 'SOMETHING') THEN 'NOT_MEANINGFUL' WHEN n.n > 1 THEN 'DUPLICATE_PAIR' WHEN a.side = b.side THEN 'OUTSIDE_PARTITION' END AS violation_code
  FROM r JOIN n ON n.x = least(left_id, right_id) AND n.y = greatest(left_id, right_id) LEFT JOIN k a ON a.c_custkey = left_id LEFT JOIN k b ON b.c_custkey = right_id) WHERE violation_code IS NOT NULL""")
def relation_errors(spark, sf_dir):
    side = F.when(F.col("c_custkey") % 2 == 0, "LEFT").otherwise("RIGHT")
    d = load(spark, sf_dir, "customer").where("c_custkey % 5 <> 4").select(F.col("c_custkey").alias("draft_id"), side.alias("side"))
    return claims.relation_errors(_order_relations(spark, sf_dir), d)


@query("""WITH t AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) <= count(*) OVER (PARTITION BY conv_id) // 2 AS l FROM conversations)
 SELECT x.conv_id, x.turn AS a, y.turn AS b, CASE WHEN x.l AND y.l THEN 'LEFT' WHEN x.l THEN 'CROSS' ELSE 'RIGHT' END AS part FROM t x JOIN t y ON x.conv_id = y.conv_id AND x.turn < y.turn""")
def split_pairs(spark, sf_dir):
    return claims.split_pairs(load(spark, sf_dir, "conversations"), ["conv_id"], "turn")


@query(f"SELECT claim_id AS draft_id, paths FROM ({_PATHS_SQL})")
def draft_paths(spark, sf_dir):
    d = _order_claims(spark, sf_dir).withColumnRenamed("claim_id", "draft_id")
    return claims.draft_paths(d, _part_evidence(spark, sf_dir)).select("draft_id", F.array_join("paths", ",").alias("paths"))


@query("SELECT DISTINCT l_partkey AS evidence_id FROM lineitem JOIN orders ON o_orderkey = l_orderkey")
def reviewed_evidence(spark, sf_dir):
    return claims.reviewed_evidence(_order_claims(spark, sf_dir))


@query("""SELECT query_id, page_id AS pos, url, left(t, 500) AS title, CAST(length(left(s, 4000)) AS BIGINT) AS snippet_chars FROM (SELECT page_id % 40 AS query_id, page_id, 'https://' || split_part(url, '://', 2) AS url,
  trim(regexp_extract(html, '<title>([^<]*)</title>', 1)) AS t, regexp_replace(html, '^\\s+|\\s+$', '', 'g') AS s FROM pages WHERE page_id % 9 <> 0) WHERE t <> '' AND s <> '' QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY page_id) <= 10""")
def search_results(spark, sf_dir):
    """Pages as answers of 40 queries; each ninth has an address that is not secure."""
    p = load(spark, sf_dir, "pages")
    url = F.concat(F.when(F.col("page_id") % 9 == 0, F.lit("http://")).otherwise(F.lit("https://")), F.regexp_replace("url", r"^[a-z]+://", ""))
    r = p.select((F.col("page_id") % 40).alias("query_id"), F.col("page_id").alias("pos"), url.alias("url"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.col("html").alias("content"), F.lit(None).cast("string").alias("published_date"))
    return research.search_results(r).select("query_id", "pos", "url", "title", F.length("snippet").cast("long").alias("snippet_chars"))


@query("SELECT coalesce(c.doc_id, r.doc_id) AS ordinal, c.doc_id AS claim_id, r.quality AS response, CASE WHEN c.doc_id IS NULL OR r.quality IS NULL THEN 'LENGTH' END AS error FROM (SELECT doc_id FROM labels WHERE doc_id % 10 <> 1) c FULL OUTER JOIN (SELECT doc_id, quality FROM labels WHERE doc_id % 10 <> 0) r ON r.doc_id = c.doc_id")
def answered_claims(spark, sf_dir):
    l = load(spark, sf_dir, "labels")  # noqa: E741
    c = l.where("doc_id % 10 <> 1").select(F.col("doc_id").alias("ordinal"), F.col("doc_id").alias("claim_id"))
    return research.answered(c, l.where("doc_id % 10 <> 0").select(F.col("doc_id").alias("ordinal"), F.col("quality").alias("response"))).select("ordinal", "claim_id", "response", "error")


_TAG_SQL = "regexp_extract_all({0}, '[0-9A-Za-z가-힣][0-9A-Za-z가-힣._+-]{{1,31}}')"


@query(f"""WITH t AS (SELECT conv_id, arg_min(text, turn) AS title, arg_max(text, turn) AS objective, list(role || ':' || turn ORDER BY turn) FILTER (turn % 2 = 0) AS headings FROM conversations GROUP BY conv_id),
 d AS (SELECT doc_id, relative_path FROM ({DOCS_SQL})),
 g AS (SELECT conv_id, -1 AS c, unnest({_TAG_SQL.format(FOLD_SQL.format('title'))}) AS tag, unnest(range(0, len({_TAG_SQL.format(FOLD_SQL.format('title'))}))) AS i FROM t
  UNION ALL SELECT conv_id, turn, unnest(list_prepend(role, {_TAG_SQL.format(FOLD_SQL.format('text'))}[1:5])), unnest(range(0, 1 + len({_TAG_SQL.format(FOLD_SQL.format('text'))}[1:5]))) FROM conversations
  UNION ALL SELECT conv_id, 1000000, lpad(CAST(doc_id AS VARCHAR), 8, '0'), 0 FROM t JOIN d ON d.doc_id = conv_id),
 u AS (SELECT conv_id, tag, min((c, i)) AS p FROM g WHERE tag <> '' GROUP BY conv_id, tag QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY min((c, i))) <= 20),
 q AS (SELECT conv_id, s, min(p) AS p FROM (SELECT conv_id, trim(title) AS s, -2 AS p FROM t UNION ALL SELECT conv_id, trim(objective), -1 FROM t UNION ALL SELECT conv_id, trim(text), turn FROM conversations) WHERE s <> '' GROUP BY conv_id, s QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY min(p)) <= 10)
 SELECT t.conv_id AS unit_id, coalesce(array_to_string(t.headings, ','), '') AS headings, (SELECT string_agg(DISTINCT role, ',' ORDER BY role) FROM conversations c WHERE c.conv_id = t.conv_id) AS kinds, (SELECT string_agg(tag, ' ' ORDER BY p) FROM u WHERE u.conv_id = t.conv_id) AS tags,
  (SELECT sha256(string_agg(s, '|' ORDER BY p)) FROM q WHERE q.conv_id = t.conv_id) AS queries_sha256, coalesce((SELECT relative_path FROM d WHERE d.doc_id = t.conv_id), '') AS paths FROM t""")
def retrieval_units(spark, sf_dir):
    c = load(spark, sf_dir, "conversations")
    claim = F.col("conv_id") * 1000 + F.col("turn")
    ledger = c.select(claim.alias("claim_id"), F.col("role").alias("kind"), F.col("text").alias("statement"), F.array("conv_id").alias("evidence_ids"))
    owned = F.transform(F.array_sort(F.collect_list(F.struct("turn", claim.alias("claim_id")))), lambda x: x["claim_id"])
    t = c.groupBy(F.col("conv_id").alias("task_id")).agg(F.min_by("text", "turn").alias("title"), F.max_by("text", "turn").alias("objective"), owned.alias("owned_claim_ids"))
    heads = c.where("turn % 2 = 0").groupBy(F.col("conv_id").alias("task_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", F.concat_ws(":", "role", "turn").alias("h")))), lambda x: x["h"]).alias("headings"))
    e = docs(spark, sf_dir).select(F.col("doc_id").alias("evidence_id"), "relative_path")
    u = assembly.retrieval_units(t, ledger, e, heads, "All")
    return u.select("unit_id", F.array_join("section_headings", ",").alias("headings"), F.array_join("claim_kinds", ",").alias("kinds"), F.array_join("tags", " ").alias("tags"), F.sha2(F.array_join("expected_queries", "|"), 256).alias("queries_sha256"), F.array_join("source_paths", ",").alias("paths"))


_RANK = "row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)"
_ATTEMPT_SQL = f"SELECT user_id, {_RANK} AS a FROM events WHERE user_id % 50 <> 17"


def _attempts(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    e = load(spark, sf_dir, "events")
    plan = e.select(F.col("user_id").alias("task_id")).distinct().withColumn("position", F.col("task_id"))
    rn = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    a = e.where("user_id % 50 <> 17").select(F.col("user_id").alias("task_id"), rn.cast("long").alias("attempt"), "value").where("attempt <= 3")
    return plan, a.select("task_id", "attempt"), a.select("task_id", "attempt", (F.col("value") > 10).alias("valid"))


@query(f"SELECT task_id, coalesce(latest, 0)::BIGINT AS latest, CASE WHEN latest IS NULL THEN 1::BIGINT END AS next_attempt FROM (SELECT DISTINCT user_id AS task_id FROM events) LEFT JOIN (SELECT user_id AS task_id, max(a) AS latest FROM ({_ATTEMPT_SQL}) WHERE a <= 3 GROUP BY user_id) USING (task_id)")
def attempt_resume(spark, sf_dir):
    return execution.resume(*_attempts(spark, sf_dir)).select("task_id", "latest", "next_attempt")


@query(f"SELECT user_id AS task_id, CAST(max(a) AS BIGINT) AS latest FROM ({_ATTEMPT_SQL}) WHERE a <= 3 AND user_id < (SELECT coalesce(min(user_id), 1000000000) FROM events WHERE user_id % 50 = 17) GROUP BY user_id")
def attempts_loaded(spark, sf_dir):
    """Results before the first task that has none."""
    return execution.loaded(*_attempts(spark, sf_dir)).select("task_id", "latest")


@query("SELECT o_custkey AS task_id, array_to_string(list_sort(list_distinct(list(CASE WHEN l_linenumber = 1 THEN o_orderkey END))), ',') AS claims FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_custkey")
def task_research(spark, sf_dir):
    """Customers as tasks; orders with a first line have an assessment."""
    o = load(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("task_id")).agg(F.collect_set("o_orderkey").alias("owned_claim_ids"))
    a = load(spark, sf_dir, "lineitem").where("l_linenumber = 1").select(F.col("l_orderkey").alias("claim_id"), F.lit("CONFIRMED").alias("verdict")).distinct()
    r = execution.task_research(o, a)
    return r.select("task_id", F.coalesce(F.array_join(F.transform("assessments", lambda x: x["claim_id"].cast("string")), ","), F.lit("")).alias("claims"))


@query("SELECT c_custkey AS folder, CAST(sum(o_orderkey) AS BIGINT) AS size_bytes FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def folder_sizes(spark, sf_dir):
    files = load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("folder"), F.col("o_orderkey").alias("byte_count"))
    return research.folder_sizes(load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("folder")), files)


@query("SELECT user_id AS job_id, CAST(count(DISTINCT CASE WHEN event_type = 'click' THEN event_id % 7 END) AS BIGINT) AS generations FROM events GROUP BY user_id")
def generation_counts(spark, sf_dir):
    e = load(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), F.when(F.col("event_type") == "click", "STARTED").otherwise("DELTA").alias("kind"), (F.col("event_id") % 7).alias("generation_id"))
    return jobs.generations(e)


@query("SELECT event_id, user_id, (SELECT count(*) FROM events b WHERE b.user_id = a.user_id) > 5 AS truncated FROM events a QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 5")
def stream_tail(spark, sf_dir):
    rn = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    e = load(spark, sf_dir, "events").withColumn("sequence", rn)
    return jobs.stream_tail(e, "user_id", "sequence", 5).select("event_id", "user_id", "truncated")


_STATES_SQL = "[" + ", ".join(f"'{s}'" for s in [*jobs.FLOW, "NEEDS_ATTENTION", "CANCELLING", "CANCELLED", "FAILED"]) + "]"


@query(f"SELECT o_orderkey AS job_id, s IN ('COMPLETED', 'CANCELLED', 'FAILED') AS terminal, s NOT IN ('COMPLETED', 'CANCELLED', 'FAILED', 'CANCELLING') AS runnable FROM (SELECT o_orderkey, {_STATES_SQL}[o_orderkey % 16 + 1] AS s FROM orders)")
def runnable_jobs(spark, sf_dir):
    states = F.array(*[F.lit(s) for s in [*jobs.FLOW, "NEEDS_ATTENTION", "CANCELLING", "CANCELLED", "FAILED"]])
    o = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_id"), F.element_at(states, (F.col("o_orderkey") % 16 + 1).cast("int")).alias("state"))
    return jobs.runnable(o).select("job_id", "terminal", "runnable")


@query("SELECT l_orderkey AS task_id, array_to_string(list_sort(list(DISTINCT l_partkey)), ',') AS claims FROM (SELECT l_orderkey, l_partkey FROM lineitem INTERSECT SELECT l_orderkey, l_suppkey FROM lineitem) GROUP BY l_orderkey")
def ownership_overlap(spark, sf_dir):
    p = load(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("task_id")).agg(F.collect_set("l_partkey").alias("owned_claim_ids"), F.collect_set("l_suppkey").alias("context_claim_ids"))
    return tasks.ownership_overlap(p).select("task_id", F.array_join(F.col("claim_ids").cast("array<string>"), ",").alias("claims"))


_OWNED_SQL = "SELECT o_custkey % 11 AS task_id, o_orderkey AS claim_id FROM orders WHERE o_orderkey % 20 <> 0"
_LINKS_SQL = "SELECT o_orderkey AS left_id, o_orderkey + 3 AS right_id FROM orders WHERE o_orderkey % 4 = 1"


@query(f"""WITH o AS ({_OWNED_SQL}), r AS ({_LINKS_SQL}), v AS (SELECT task_id, claim_id FROM o UNION SELECT task_id, right_id FROM o JOIN r ON left_id = claim_id UNION SELECT task_id, left_id FROM o JOIN r ON right_id = claim_id)
 SELECT l_partkey AS evidence_id, array_to_string(list_sort(list(DISTINCT task_id)), ',') AS task_ids FROM v JOIN lineitem ON l_orderkey = claim_id JOIN orders ON o_orderkey = claim_id GROUP BY l_partkey""")
def coverage_matrix(spark, sf_dir):
    """Which tasks see each piece of evidence, through their own claims and related ones."""
    owned = load(spark, sf_dir, "orders").where("o_orderkey % 20 <> 0").select((F.col("o_custkey") % 11).alias("task_id"), F.col("o_orderkey").alias("claim_id"))
    links = load(spark, sf_dir, "orders").where("o_orderkey % 4 = 1").select(F.col("o_orderkey").alias("left_id"), (F.col("o_orderkey") + 3).alias("right_id"))
    _, seen = tasks.coverage_matrix(owned, _order_claims(spark, sf_dir), links)
    return seen.select("evidence_id", F.array_join(F.col("task_ids").cast("array<string>"), ",").alias("task_ids"))


@query("""WITH p AS (SELECT conv_id AS batch, turn, regexp_replace(format('p{:03d}-{:03d}-', conv_id, 999) || left(role || '-' || turn || '-' || repeat('x', CAST(turn AS INT) * 20), 55), '-+$', '') AS id FROM conversations)
 SELECT a.id AS node, b.id AS needs FROM p a JOIN p b ON b.batch = a.batch AND b.turn = a.turn - 1""")
def planning_names(spark, sf_dir):
    c = load(spark, sf_dir, "conversations")
    name = F.concat_ws("-", "role", "turn", F.repeat(F.lit("x"), (F.col("turn") * 20).cast("int")))
    p = c.select(F.col("conv_id").alias("batch"), F.lit(999).cast("long").alias("batches"), name.alias("task_id"), "turn")
    before = p.select("batch", F.col("task_id").alias("needs"), (F.col("turn") + 1).alias("turn"))
    return tasks.namespaced(p, p.join(before, ["batch", "turn"]).select("batch", F.col("task_id").alias("node"), "needs"))[1]


_LOG_SQL = f"""SELECT user_id AS job_id, r AS version, CASE WHEN r = 1 THEN 'INSERT' WHEN r % 3 = 2 THEN 'MOVE' ELSE 'PROGRESS' END AS kind, CASE WHEN r = 1 THEN 'CREATED' WHEN r % 3 = 2 THEN {_STATES_SQL}[least(r // 3 + 2, 12)] END AS state,
 CASE WHEN r > 1 AND r % 3 <> 2 THEN r END AS sequence, CASE WHEN r > 1 AND r % 3 <> 2 THEN least(r, 100) END AS percentage, ts AS occurred_at FROM (SELECT *, {_RANK} AS r FROM events)"""


def _job_log(spark, sf_dir) -> DataFrame:
    rn = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long")
    e = load(spark, sf_dir, "events").withColumn("r", rn)
    first, move = F.col("r") == 1, F.col("r") % 3 == 2
    state = F.element_at(F.array(*[F.lit(s) for s in jobs.FLOW]), F.least(F.floor(F.col("r") / 3) + 2, F.lit(12)).cast("int"))
    number = lambda c: F.when(~first & ~move, c)
    return e.select(F.col("user_id").cast("string").alias("job_id"), F.col("r").alias("version"), F.when(first, "INSERT").when(move, "MOVE").otherwise("PROGRESS").alias("kind"), F.when(first, "CREATED").when(move, state).alias("state"), number(F.col("r")).alias("sequence"), number(F.least(F.col("r"), F.lit(100))).alias("percentage"), F.lit(None).cast("string").alias("message"), F.col("ts").alias("occurred_at"))


@query(f"SELECT CAST(job_id AS VARCHAR) AS job_id, arg_max(state, version) FILTER (state IS NOT NULL) AS state, CAST(max(version) AS BIGINT) AS record_version, CAST(coalesce(max(sequence), 0) AS BIGINT) AS last_event_sequence, CAST(coalesce(max(percentage), 0) AS BIGINT) AS last_percentage FROM ({_LOG_SQL}) GROUP BY job_id")
def job_log_fold(spark, sf_dir):
    return store.folded(_job_log(spark, sf_dir)).select("job_id", "state", "record_version", "last_event_sequence", "last_percentage")


@query(ORACLES["job_log_fold"])
def job_store_state(spark, sf_dir):
    """The log committed in six parts to a store of its own, read back from a kept copy of its state and the commits since."""
    path = f"{graph.shared_dir(spark).rstrip('/')}/jobs-{uuid.uuid4().hex}"
    log, events = commits.CommitLog(spark, path, store.LOG), _job_log(spark, sf_dir)
    for k in range(6):
        view = log.commit(lambda _: events.where(F.col("version") % 6 == k))  # noqa: B023
        log.keep_state(view, view.state(store.folded, store.merged), 4)
    out = graph.cut(log.now().state(store.folded, store.merged))
    log.folder.delete()
    return out.select("job_id", "state", "record_version", "last_event_sequence", "last_percentage")


_ALLOWED_SQL = ", ".join(f"('{a}', '{b}')" for a, b in jobs.moves())


@query(f"""WITH f AS (SELECT job_id, arg_max(state, version) FILTER (state IS NOT NULL) AS s, coalesce(max(sequence), 0) AS q, coalesce(max(percentage), 0) AS p FROM ({_LOG_SQL}) GROUP BY job_id),
 r AS (SELECT *, ['INSERT', 'MOVE', 'MOVE', 'PROGRESS', 'PROGRESS'][c_custkey % 5 + 1] AS kind, CASE WHEN c_custkey % 5 = 2 THEN 'CREATED' ELSE s END AS expected FROM customer LEFT JOIN f ON f.job_id = c_custkey), m(a, b) AS (VALUES {_ALLOWED_SQL})
 SELECT CAST(c_custkey AS VARCHAR) AS job_id, kind, code AS violation_code FROM (SELECT r.*, CASE WHEN kind = 'INSERT' THEN CASE WHEN s IS NOT NULL THEN 'JOB_ALREADY_EXISTS' END WHEN s IS NULL THEN 'JOB_NOT_FOUND'
  WHEN kind = 'MOVE' THEN CASE WHEN expected <> s OR m.a IS NULL THEN 'JOB_STATE_CONFLICT' END WHEN c_custkey % 5 = 4 THEN 'PROGRESS_EVENT_CONFLICT' END AS code FROM r LEFT JOIN m ON m.a = s AND m.b = 'CANCELLING') WHERE code IS NOT NULL""")
def job_requests_rejected(spark, sf_dir):
    """Requests against the log: inserts, moves with the right and a stale expected state, progress in and out of order."""
    events = _job_log(spark, sf_dir)
    now = store.folded(events).select("job_id", F.col("state").alias("s"), "last_event_sequence", "last_percentage")
    k = F.col("c_custkey") % 5
    c = load(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("job_id"), k.alias("k")).join(now, "job_id", "left")
    kind = F.element_at(F.array(*[F.lit(x) for x in ("INSERT", "MOVE", "MOVE", "PROGRESS", "PROGRESS")]), (F.col("k") + 1).cast("int"))
    sequence = F.coalesce("last_event_sequence", F.lit(0)) + F.when(F.col("k") == 4, 2).otherwise(1)
    r = c.select("job_id", kind.alias("kind"), F.when(F.col("k") == 2, "CREATED").otherwise(F.col("s")).alias("expected"), F.lit("CANCELLING").alias("state"), sequence.cast("long").alias("sequence"), F.coalesce("last_percentage", F.lit(0)).cast("long").alias("percentage"))
    return store.rejected(events, r)


@query(f"SELECT doc_id, sha256(CASE WHEN length(text) > 20000 THEN NULL WHEN trim(text) = '' THEN 'Policy.  ' ELSE 'Policy.' || chr(10) || chr(10) || '{assembly.ADDED_HEAD}' || chr(10) || '<additional_system_instruction process=\"as-policy-data\">' || chr(10) || regexp_replace(text, '^\\s+|\\s+$', '', 'g') || chr(10) || '</additional_system_instruction>' || chr(10) || chr(10) || '{assembly.ADDED_TAIL}' END) AS prompt_sha256 FROM documents")
def system_prompts(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", F.sha2(assembly.system_prompt(F.lit("Policy.  "), F.col("text")), 256).alias("prompt_sha256"))


@query("""SELECT doc_id, regexp_full_match(x, 'job-[0-9a-f]{32}') AS job, regexp_full_match(x, '[a-z0-9][a-z0-9._-]{1,62}[a-z0-9]') AS run, regexp_full_match(x, 'runner-[0-9a-f]{32}') AS runner, regexp_full_match(x, '[A-Za-z0-9][A-Za-z0-9._-]{0,95}/[A-Za-z0-9][A-Za-z0-9._-]{0,95}') AS model
 FROM (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'job-' WHEN 1 THEN 'runner-' WHEN 2 THEN 'Org/' WHEN 3 THEN '-' ELSE '' END || md5(CAST(doc_id AS VARCHAR)) AS x FROM documents)""")
def id_kinds(spark, sf_dir):
    head = F.element_at(F.array(*[F.lit(x) for x in ("job-", "runner-", "Org/", "-", "")]), (F.col("doc_id") % 5 + 1).cast("int"))
    d = load(spark, sf_dir, "documents").select("doc_id", F.concat(head, F.md5(F.col("doc_id").cast("string").cast("binary"))).alias("x"))
    return d.select("doc_id", *[rules.is_id(F.col("x"), k).alias(k) for k in ("job", "run", "runner", "model")])


@query("""SELECT CAST(user_id AS VARCHAR) AS job_id, 'runner-' || ((n - 1) // 9) AS runner_token, CAST((n - 1) // 9 + 1 AS BIGINT) AS launch_sequence, CASE WHEN n % 9 <> 1 THEN (n - 1) // 9 END AS process_id,
 CASE n % 9 WHEN 1 THEN 'LAUNCHING' WHEN 0 THEN 'EXITED' ELSE 'RUNNING' END AS lifecycle, t AS heartbeat_at, CASE WHEN n % 9 = 0 THEN t END AS finished_at, CAST(NULL AS VARCHAR) AS error_code, 0::BIGINT AS conflicts
 FROM (SELECT user_id, count(*) AS n, epoch(date_trunc('second', max(ts)))::BIGINT AS t FROM events GROUP BY user_id)""")
def lease_states(spark, sf_dir):
    """Events of a user as actions on one lease: nine for each launch."""
    action = F.when(F.col("seq") % 9 == 1, "LAUNCH").when(F.col("seq") % 9 == 2, "CLAIM").when(F.col("seq") % 9 == 0, "FINISH").otherwise("HEARTBEAT")
    rn = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long")
    e = load(spark, sf_dir, "events").withColumn("seq", rn)
    a = e.select(F.col("user_id").cast("string").alias("job_id"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("at"), "seq", action.alias("action"), F.concat(F.lit("runner-"), F.floor((F.col("seq") - 1) / 9).cast("string")).alias("runner_token"), F.when(F.col("seq") % 9 != 1, F.floor((F.col("seq") - 1) / 9)).alias("process_id"), F.when(action == "FINISH", "EXITED").alias("lifecycle"), F.lit(None).cast("string").alias("error_code"))
    return store.lease_fold(a)

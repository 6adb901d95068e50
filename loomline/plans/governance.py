"""Queries of clusters, audit chains, retrieval measures and invalidation, each with its DuckDB form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import audit, claims, clusters, incremental, packing, retrieval
from .catalogue import _PART_SQL, _parts, load, query

_PART_CLASSES = f"""WITH RECURSIVE c AS MATERIALIZED ({_PART_SQL}),
 l AS MATERIALIZED (SELECT id, list_sort(list_distinct(list_transform(range(1, greatest(1, length(x) - 2) + 1), lambda i: substr(x, i, 3)))) AS l FROM c),
 k AS MATERIALIZED (SELECT min(id) AS cid, l FROM l GROUP BY l),
 s AS MATERIALIZED (SELECT a.cid AS a, b.cid AS b, len(list_intersect(a.l, b.l)) / (len(a.l) + len(b.l) - len(list_intersect(a.l, b.l))) AS sim FROM k a JOIN k b ON a.cid <> b.cid),
 e AS MATERIALIZED (SELECT a, b, sim FROM s WHERE sim >= 0.5),
 n AS MATERIALIZED (SELECT cid, row_number() OVER (ORDER BY cid) AS i, coalesce((SELECT list(b) FROM e WHERE a = cid), []) AS near FROM k),
 walk AS (SELECT 0::BIGINT AS i, []::BIGINT[] AS heads UNION ALL SELECT n.i, CASE WHEN list_has_any(n.near, heads) THEN heads ELSE list_append(heads, n.cid) END FROM walk JOIN n ON n.i = walk.i + 1),
 h AS MATERIALIZED (SELECT unnest(heads) AS head FROM walk ORDER BY i DESC LIMIT 1000000),
 hs AS MATERIALIZED (SELECT DISTINCT head FROM h),
 m AS (SELECT a AS cid, arg_min(b, (-sim, b)) AS head, max(sim) AS sim FROM e JOIN hs ON hs.head = e.b WHERE a NOT IN (SELECT head FROM hs) GROUP BY a UNION ALL SELECT head, head, 1.0 FROM hs)
 SELECT l.id, m.head AS canonical_id, round(m.sim, 6) AS similarity FROM l JOIN k USING (l) JOIN m USING (cid)"""


@query(_PART_CLASSES)
def part_clusters(spark, sf_dir):
    """Part names in clusters whose members are all within 0.5 of the canonical one."""
    s = claims.complete_pairs(_parts(spark, sf_dir), "id", "statement", 1, 2)
    ranks = s.members.select("class_id").distinct().withColumn("rank", F.col("class_id"))
    return clusters.without_drift(s, ranks).select("id", "canonical_id", F.round("similarity", 6).alias("similarity"))


@query()
def candidate_batches(spark, sf_dir):
    """The batches in which part names are compared, by the narrower block rule; first-fit is held to brute force by a test."""
    blocks = claims.reference_blocks(claims.views(_parts(spark, sf_dir)))
    return packing.candidate_batches(blocks).select("component", "bin", F.size("members").cast("long").alias("size"), F.col("members")[0].alias("first_id"))


_BODY = ["event_id", "event_type", "props"]
_CHAIN_WITH = """WITH RECURSIVE e AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, event_id || '|' || event_type || '|' || props AS body FROM events),
 c AS (SELECT user_id, event_id, i, '' AS before, sha256(chr(10) || body) AS h FROM e WHERE i = 1 UNION ALL SELECT e.user_id, e.event_id, e.i, c.h, sha256(c.h || chr(10) || e.body) FROM c JOIN e ON e.user_id = c.user_id AND e.i = c.i + 1)"""


def _chain(spark, sf_dir) -> DataFrame:
    return audit.chained(load(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_id", F.concat_ws("|", *_BODY))


@query(_CHAIN_WITH + " SELECT event_id, before AS previous_event_hash, h AS event_hash FROM c")
def audit_chain(spark, sf_dir):
    return _chain(spark, sf_dir).select("event_id", "previous_event_hash", "event_hash")


@query(_CHAIN_WITH + """, t AS (SELECT user_id, event_id, i, before, h, lag(h, 1, '') OVER (PARTITION BY user_id ORDER BY i) AS stored, lead(event_id) OVER (PARTITION BY user_id ORDER BY i) AS x FROM c WHERE event_id % 100 <> 13),
 b AS (SELECT user_id, event_id, i, CASE WHEN before <> stored THEN 'LINK' WHEN event_id % 100 = 7 THEN 'CONTENT' END AS code FROM t)
 SELECT user_id, arg_min(event_id, i) AS event_id, arg_min(code, i) AS violation_code FROM b WHERE code IS NOT NULL GROUP BY user_id""")
def audit_breaks(spark, sf_dir):
    """Where the chain first breaks, if some events are taken out and others rewritten."""
    e = load(spark, sf_dir, "events").select("event_id", "ts")
    stored = _chain(spark, sf_dir).join(e, "event_id").where("event_id % 100 <> 13")
    stored = stored.withColumn("body", F.when(F.col("event_id") % 100 == 7, F.concat("body", F.lit("!"))).otherwise(F.col("body")))
    return audit.broken(stored, "user_id", ["ts", "event_id"], "event_id")


_GRADED = "SELECT l_orderkey AS query_id, l_partkey AS item_id, max(greatest(0, CAST(round(l_discount * 100) AS BIGINT) - 5)) AS grade FROM lineitem GROUP BY ALL"
_MEASURES_SQL = f"""WITH j AS MATERIALIZED ({_GRADED}),
 r AS (SELECT l_orderkey AS query_id, l_partkey AS item_id, min(l_linenumber) AS rank FROM lineitem WHERE l_linenumber <= 4 GROUP BY ALL),
 x AS MATERIALIZED (SELECT r.*, coalesce(grade, 0) AS grade, item_id IN (SELECT p_partkey FROM part WHERE p_size > 5) AS may FROM r LEFT JOIN j USING (query_id, item_id)),
 i AS (SELECT query_id, sum((pow(2, grade) - 1) / log2(place + 1)) FILTER (place <= 4) AS ideal, count(*) AS relevant FROM (SELECT query_id, grade, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC) AS place FROM j WHERE grade > 0) GROUP BY query_id),
 g AS (SELECT query_id, count(*) AS returned, count(*) FILTER (NOT may) AS leaked, count(*) FILTER (grade > 0) AS found, min(rank) FILTER (grade > 0) AS first, sum((pow(2, grade) - 1) / log2(rank + 1)) AS dcg FROM x GROUP BY query_id),
 q AS MATERIALIZED (SELECT query_id, coalesce(relevant, 0)::BIGINT AS relevant, coalesce(found, 0)::BIGINT AS found, CASE WHEN relevant > 0 THEN round(coalesce(found, 0) / relevant, 6) END AS recall, round(coalesce(1.0::DOUBLE / first, 0), 6) AS reciprocal_rank, CASE WHEN ideal > 0 THEN round(coalesce(dcg, 0) / ideal, 6) END AS ndcg, coalesce(returned, 0)::BIGINT AS returned, coalesce(leaked, 0)::BIGINT AS leaked FROM g FULL JOIN i USING (query_id))"""


def _measured(spark, sf_dir) -> DataFrame:
    line = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("query_id"), F.col("l_partkey").alias("item_id"), F.col("l_linenumber").alias("rank"), F.greatest(F.lit(0), F.round(F.col("l_discount") * 100).cast("long") - 5).alias("grade"))
    allowed = line.join(load(spark, sf_dir, "part").where("p_size > 5").select(F.col("p_partkey").alias("item_id")), "item_id").select("query_id", "item_id")
    q = retrieval.per_query(line.select("query_id", "item_id", "rank"), line.select("query_id", "item_id", "grade"), allowed, k=4)
    return q.withColumns({c: F.round(c, 6) for c in ("recall", "reciprocal_rank", "ndcg")})


@query(_MEASURES_SQL + " SELECT * FROM q")
def retrieval_measures(spark, sf_dir):
    """An order's lines as ranked results for it, graded by discount; small parts may not be shown."""
    return _measured(spark, sf_dir)


@query(_MEASURES_SQL + " SELECT o_orderpriority, count(*) FILTER (relevant > 0) AS queries, round(avg(recall) FILTER (relevant > 0), 4) AS recall, round(avg(reciprocal_rank) FILTER (relevant > 0), 4) AS mrr, round(avg(ndcg) FILTER (relevant > 0), 4) AS ndcg, round(sum(leaked) / sum(returned), 4) AS leakage FROM q JOIN orders ON o_orderkey = query_id GROUP BY o_orderpriority")
def retrieval_summary(spark, sf_dir):
    q = _measured(spark, sf_dir).join(load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("query_id"), "o_orderpriority"), "query_id")
    return retrieval.overall(q, "o_orderpriority").select("o_orderpriority", "queries", *[F.round(c, 4).alias(c) for c in ("recall", "mrr", "ndcg", "leakage")])


_STAGES = ["SNAPSHOT", "PARSE", "NORMALIZE", "CHUNK", "EMBED", "CLASSIFY_DECIDE", "NEAR_DEDUP", "EXTRACT_CLAIMS", "BUILD_CLAIM_LEDGER", "PLAN_TASKS"]
_NEEDS = [("PARSE", "SNAPSHOT"), ("NORMALIZE", "PARSE"), ("CHUNK", "NORMALIZE"), ("EMBED", "CHUNK"), ("CLASSIFY_DECIDE", "EMBED"), ("NEAR_DEDUP", "CHUNK"), ("EXTRACT_CLAIMS", "CLASSIFY_DECIDE"), ("EXTRACT_CLAIMS", "NEAR_DEDUP"), ("BUILD_CLAIM_LEDGER", "EXTRACT_CLAIMS"), ("PLAN_TASKS", "BUILD_CLAIM_LEDGER")]


@query(f"""WITH RECURSIVE s(stage) AS (VALUES {', '.join(f"('{x}')" for x in _STAGES)}), n(stage, needs) AS (VALUES {', '.join(f"('{a}', '{b}')" for a, b in _NEEDS)}),
 hit AS (SELECT 'EMBED' AS stage UNION SELECT n.stage FROM n JOIN hit ON n.needs = hit.stage),
 d AS (SELECT source, CASE WHEN doc_id % 17 = 0 THEN 'GONE' WHEN doc_id % 23 = 0 THEN 'EDITED' WHEN doc_id % 29 = 0 THEN 'NEW' ELSE 'SAME' END AS kind FROM documents),
 a AS (SELECT stage, source, CASE WHEN kind = 'GONE' THEN 'GONE' WHEN kind IN ('EDITED', 'NEW') OR stage IN (SELECT stage FROM hit) THEN 'RUN' ELSE 'KEEP' END AS action FROM s, d)
 SELECT stage, source, action, count(*) AS documents FROM a GROUP BY ALL""")
def invalidation(spark, sf_dir):
    """What each stage has to do again after some documents went, came or changed, and the embedding model did."""
    d = load(spark, sf_dir, "documents")
    versions = lambda embed: spark.createDataFrame([(s, embed if s == "EMBED" else "1") for s in _STAGES], "stage string, version string")
    needs = spark.createDataFrame(_NEEDS, "stage string, needs string")
    was = d.where("doc_id % 29 <> 0 or doc_id % 17 = 0 or doc_id % 23 = 0").select(F.col("doc_id").alias("key"), F.sha2("text", 256).alias("fingerprint"))
    now = d.where("doc_id % 17 <> 0").select(F.col("doc_id").alias("key"), F.sha2(F.when(F.col("doc_id") % 23 == 0, F.concat("text", F.lit(" edited"))).otherwise(F.col("text")), 256).alias("fingerprint"))
    nothing = spark.createDataFrame([], "stage string, key long, fingerprint string")
    before = incremental.plan(nothing, was, versions("1"), needs).select("stage", "key", "fingerprint")
    after = incremental.plan(before, now, versions("2"), needs)
    return after.join(d.select(F.col("doc_id").alias("key"), "source"), "key").groupBy("stage", "source", "action").agg(F.count("*").alias("documents"))

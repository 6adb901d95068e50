"""Queries of single rules and joins, each with its DuckDB form."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import checks, rules, text
from ..operators import assembly, claims, research, tasks
from .catalogue import DOCS_SQL, docs, load, query
from .planning import _LINKS_SQL, _OWNED_SQL


def _owned(spark, sf_dir):
    return load(spark, sf_dir, "orders").where("o_orderkey % 20 <> 0").select((F.col("o_custkey") % 11).alias("task_id"), F.col("o_orderkey").alias("claim_id"))


def _links(spark, sf_dir):
    return load(spark, sf_dir, "orders").where("o_orderkey % 4 = 1").select(F.col("o_orderkey").alias("left_id"), (F.col("o_orderkey") + 3).alias("right_id"))


_SEEN_SQL = "SELECT task_id, right_id AS claim_id FROM o JOIN r ON left_id = claim_id UNION SELECT task_id, left_id FROM o JOIN r ON right_id = claim_id"


@query(f"WITH o AS ({_OWNED_SQL}), r AS ({_LINKS_SQL}) SELECT * FROM ({_SEEN_SQL}) EXCEPT SELECT task_id, claim_id FROM o")
def context_claims(spark, sf_dir):
    return tasks.context_claims(_owned(spark, sf_dir), _links(spark, sf_dir)).select("task_id", "claim_id")


@query(f"WITH o AS ({_OWNED_SQL}), r AS ({_LINKS_SQL}), v AS (SELECT task_id, claim_id FROM o UNION {_SEEN_SQL}) SELECT a.task_id, left_id, right_id FROM r JOIN v a ON a.claim_id = left_id JOIN v b ON b.claim_id = right_id AND b.task_id = a.task_id")
def visible_relations(spark, sf_dir):
    o, r = _owned(spark, sf_dir), _links(spark, sf_dir)
    seen = o.unionByName(tasks.context_claims(o, r).select("task_id", "claim_id"))
    return tasks.visible_relations(seen, r).select("task_id", "left_id", "right_id")


@query(f"SELECT left_id, right_id FROM ({_LINKS_SQL}) WHERE left_id % 3 = 0 AND right_id % 3 = 0 AND right_id IN (SELECT o_orderkey FROM orders)")
def restricted_relations(spark, sf_dir):
    """The ledger's relations with both ends in a third of the claims."""
    some = load(spark, sf_dir, "orders").where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("claim_id"))
    return tasks.restricted(_links(spark, sf_dir), some).select("left_id", "right_id")


@query("SELECT DISTINCT l_suppkey AS source_id, s_name AS title FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE l_orderkey % 50 = 0")
def report_subset(spark, sf_dir):
    """The sources that the assessments of some claims name."""
    a = load(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("claim_id")).agg(F.collect_set("l_suppkey").alias("source_ids"))
    s = load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("source_id"), F.col("s_name").alias("title"))
    return research.report_for(a, s, load(spark, sf_dir, "orders").where("o_orderkey % 50 = 0").select(F.col("o_orderkey").alias("claim_id")))[1].select("source_id", "title")


@query("SELECT 'm' || p_partkey AS model_id, p_partkey % 3 = 0 AS cached, CAST(CASE WHEN p_partkey % 3 = 0 THEN p_partkey * 7 ELSE p_size END AS BIGINT) AS size_bytes FROM part")
def model_catalogue(spark, sf_dir):
    p = load(spark, sf_dir, "part").select(F.concat(F.lit("m"), "p_partkey").alias("model_id"), F.lit("r").alias("revision"), F.col("p_size").cast("long").alias("size_bytes"), "p_partkey")
    local = p.where("p_partkey % 3 = 0").select("model_id", "revision", (F.col("p_partkey") * 7).alias("size_bytes"))
    return research.catalogue(p, local).select("model_id", "cached", "size_bytes")


@query("SELECT o_orderkey AS left_id, o_orderkey + 2 AS right_id, ['CONFLICT', 'EXACT_DUPLICATE', 'SEMANTIC_EQUIVALENT', 'COMPLEMENTARY'][o_orderkey % 4 + 1] AS relation FROM orders WHERE o_orderkey // 5 = (o_orderkey + 2) // 5 AND o_orderkey % 4 IN (0, 3) AND o_orderkey + 2 IN (SELECT o_orderkey FROM orders)")
def merged_conflicts(spark, sf_dir):
    """Relations that are no duplicates whose two ends were merged, with every five claims merged."""
    o = load(spark, sf_dir, "orders")
    label = F.element_at(F.array(*[F.lit(x) for x in ("CONFLICT", "EXACT_DUPLICATE", "SEMANTIC_EQUIVALENT", "COMPLEMENTARY")]), (F.col("o_orderkey") % 4 + 1).cast("int"))
    r = o.select(F.col("o_orderkey").alias("left_id"), (F.col("o_orderkey") + 2).alias("right_id"), label.alias("relation"))
    roots = o.select(F.col("o_orderkey").alias("node"), F.floor(F.col("o_orderkey") / 5).alias("root"))
    return claims.inconsistent_relations(r, roots).select("left_id", "right_id", "relation")


@query("SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN a.doc_id IS NULL THEN 'RIGHT' ELSE 'LEFT' END AS side FROM (SELECT doc_id FROM documents WHERE doc_id % 7 <> 0) a FULL OUTER JOIN (SELECT doc_id FROM labels) b ON a.doc_id = b.doc_id WHERE a.doc_id IS NULL OR b.doc_id IS NULL")
def unmatched_keys(spark, sf_dir):
    return checks.unmatched(load(spark, sf_dir, "documents").where("doc_id % 7 <> 0"), load(spark, sf_dir, "labels"), "doc_id")


@query("SELECT sha256(text) AS sha256, CAST(count(*) AS BIGINT) AS rows FROM documents GROUP BY text HAVING count(*) > 1")
def duplicate_keys(spark, sf_dir):
    return checks.duplicates(docs(spark, sf_dir).select(F.sha2("text", 256).alias("sha256")), "sha256")


@query("SELECT l_orderkey, min(l_linenumber) AS first, max(l_linenumber) AS last, CAST(count(DISTINCT l_linenumber) AS BIGINT) AS n, CAST(count(*) AS BIGINT) AS rows FROM lineitem GROUP BY l_orderkey HAVING NOT (min(l_linenumber) = 0 AND max(l_linenumber) = count(DISTINCT l_linenumber) - 1 AND count(*) = count(DISTINCT l_linenumber))")
def broken_ordinals(spark, sf_dir):
    return checks.not_contiguous(load(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber")


@query("SELECT (SELECT count(DISTINCT l_partkey) FROM lineitem WHERE l_partkey % 5 <> 0 AND l_partkey IN (SELECT p_partkey FROM part))::BIGINT AS covered_claims, (SELECT count(DISTINCT l_suppkey) FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 2 = 0))::BIGINT AS covered_evidence, (SELECT count(DISTINCT l_orderkey) FROM lineitem)::BIGINT AS tasks")
def final_counters(spark, sf_dir):
    s = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("task_id"), F.array("l_partkey").alias("used_claim_ids"), F.array("l_suppkey").alias("used_evidence_ids"))
    c = load(spark, sf_dir, "part").where("p_partkey % 5 <> 0").select(F.col("p_partkey").alias("claim_id"))
    e = load(spark, sf_dir, "supplier").where("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("evidence_id"))
    return assembly.final_counters(s, c, e)


@query(f"""SELECT doc_id, sha256(x || ' [source:' || relative_path || '] and [evidence:E-] end') AS expanded_sha256 FROM (SELECT doc_id, relative_path, replace(text, ']', ')') AS x FROM ({DOCS_SQL}))""")
def expanded_markers(spark, sf_dir):
    """A known and an unknown evidence mark behind each text."""
    d = docs(spark, sf_dir)
    s = d.select("doc_id", F.concat(F.replace("text", F.lit("]"), F.lit(")")), F.lit(" [evidence:E"), "doc_id", F.lit("] and [evidence:E-] end")).alias("markdown"))
    e = d.select(F.concat(F.lit("E"), "doc_id").alias("evidence_id"), F.col("relative_path").alias("path"))
    return assembly.expand_markers(s, ["doc_id"], "markdown", e).select("doc_id", F.sha2("markdown", 256).alias("expanded_sha256"))


@query("""SELECT doc_id, sha256(trim(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) || chr(10)) AS cleaned_sha256, sha256(trim(text)) AS answer_sha256, sha256(text) AS body_sha256 FROM documents""")
def model_answers(spark, sf_dir):
    """Internal marks, thinking and fences put around texts and taken away again."""
    t = F.col("text")
    marked = F.concat(F.lit("[claim:C1]"), t, F.lit("[evidence:E1]  \n\n\n"))
    thought = F.concat(F.lit("<think>a\nb</think> "), t, F.lit(" <think></think>"))
    fenced = F.concat(F.lit("```json\n"), t, F.lit("\n```\n"))
    return load(spark, sf_dir, "documents").select("doc_id", F.sha2(text.without_internal_marks(marked), 256).alias("cleaned_sha256"), F.sha2(text.strip_thinking(thought), 256).alias("answer_sha256"), F.sha2(text.strip_fence(fenced), 256).alias("body_sha256"))


@query("""SELECT page_id, trim(regexp_replace(s, 'https?://\\S+', '', 'g'))[1:500] AS query, b AS bits, t AS title FROM (SELECT page_id, 'see ' || url || ' for ' || split_part(url, '/', 3) AS s, CASE page_id % 4 WHEN 0 THEN '4-bit' WHEN 1 THEN '8-bit' END AS b, 'some page ' || page_id AS t FROM pages)""")
def names_and_queries(spark, sf_dir):
    """Search texts without addresses, bits in model names, titles from paths."""
    name = F.concat(F.lit("org/Model-7B"), F.element_at(F.array(*[F.lit(x) for x in ("-4bit", "_8-bit-x", "-16bits", "")]), (F.col("page_id") % 4 + 1).cast("int")))
    s = F.concat(F.lit("see "), "url", F.lit(" for "), F.element_at(F.split("url", "/"), 3))
    path = F.concat(F.lit("a/b/some-page-"), "page_id", F.lit(".md"))
    return load(spark, sf_dir, "pages").select("page_id", research.query_text(s).alias("query"), text.quantization(name).alias("bits"), text.stem_title(path).alias("title"))


@query("""SELECT p_partkey, CAST(least(8192 - 1024 - p_size * 40 - 512, floor(8192 * 0.8) - 1024) AS BIGINT) AS capacity, CAST(least(p_size * 300, 8192 // 2) AS BIGINT) AS budget, CAST(30 + round_even(62.0 * (p_partkey % 9) / 8, 0) AS BIGINT) AS percent,
 least(p_size * 40, 100000) * 1.0 > 0 AS positive FROM part""")
def budgets(spark, sf_dir):
    p, size = load(spark, sf_dir, "part"), F.col("p_size")
    return p.select("p_partkey", rules.capacity(F.lit(8192), F.lit(1024), size * 40, F.lit(512), F.lit(0.8)).cast("long").alias("capacity"), rules.output_budget(size * 300, F.lit(8192)).cast("long").alias("budget"), rules.percent(30, 62, F.col("p_partkey") % 9, F.lit(8)).alias("percent"), (size > 0).alias("positive"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'b,c' WHEN doc_id % 3 = 1 THEN '' ELSE 'c' END AS unexpected FROM documents")
def unexpected_fields(spark, sf_dir):
    """JSON objects against the exact fields a and b."""
    from ..sources.files import unexpected_fields as odd

    raw = F.element_at(F.array(*[F.lit(x) for x in ('{"a":1,"c":2}', '{"b":1,"a":null}', '{"a":1,"b":2,"c":3}')]), (F.col("doc_id") % 3 + 1).cast("int"))
    return load(spark, sf_dir, "documents").select("doc_id", raw.alias("raw")).select("doc_id", F.array_join(F.array_sort(odd("raw", ["a", "b"])), ",").alias("unexpected"))


@query("""WITH r AS (SELECT source, doc_id, format('C{:06d}', row_number() OVER (PARTITION BY source ORDER BY doc_id)) AS ref FROM documents), u AS (SELECT source, format('C{:06d}', i) AS ref FROM (SELECT DISTINCT source FROM documents), (SELECT unnest([1, 2, 999999]) AS i))
 SELECT u.source, u.ref, doc_id, doc_id IS NOT NULL AS known FROM u LEFT JOIN r ON r.source = u.source AND r.ref = u.ref""")
def resolved_refs(spark, sf_dir):
    d = load(spark, sf_dir, "documents").select("doc_id", "source")
    refs = tasks.compact_refs(d, ["source"], ["doc_id"], "C")
    used = d.select("source").distinct().select("source", F.explode(F.array(*[F.lit(f"C{i:06d}") for i in (1, 2, 999999)])).alias("ref"))
    return tasks.resolve_refs(used, refs, ["source"], "doc_id")

"""The operators of this subpackage, bound to the driver's tables with production parameters.

What a query returns for null, empty or very long texts, ties, repeated rows, empty tables and
clashing column names is stated in the module of its operator, whose result it hands on.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chroma, context_mix, langid, lexical, mixing, near_dup, packing, quality, quotes, repeats, topk, toxicity, whitening
from .common import fold, held_out, modest_batches
from .common import table as read_table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(modest_batches(spark), sf_dir, name)


def op1_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations written out as quoting mail, then linked and cleaned again."""
    return quotes.link(quotes.as_mail(table(spark, sf_dir, "conversations")))


def op2_chroma_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each embedding read as a melody: window i holds the sizes of components i to i + 11."""
    return chroma.group(chroma.fingerprints(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "vector"))


def op3_rank_order_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from three quarters of them."""
    docs = table(spark, sf_dir, "documents")
    profiles = langid.learn(docs.where(fold("doc_id", 4) != 2))
    return langid.predict(docs.withColumn("held_out", held_out("doc_id", 4, 2)), profiles, ["doc_id", "held_out"])


def op4_residual_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 4096 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op5_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quality score of every document, learned from two thirds of the labels."""
    docs = table(spark, sf_dir, "documents")
    model = quality.fit_quality(docs, table(spark, sf_dir, "labels"), lambda key: fold(key, 3) != 1)
    return quality.score_quality(docs.withColumn("held_out", held_out("doc_id", 3, 1)), model, ["doc_id", "held_out"])


def op6_norm_bucketed_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best inner products of each fiftieth vector with all others."""
    return topk.top_k(topk.whole(table(spark, sf_dir, "embeddings")), F.col("id") % 50 == 0, 5)


def op7_hypergeometric_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents, read off the leaves of the splitting tree."""
    mix = mixing.mix(table(spark, sf_dir, "documents"))
    return mix.taken().select("doc_id", "size", "source_size", "target", "taken", "shard", "rank", "shards")


def op8_hyperminhash_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents whose three-word shingles agree by 0.85 or more."""
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), words=3, num=85, den=100)


def op9_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-probabilities of every document, learned from six sevenths of them."""
    docs = table(spark, sf_dir, "documents")
    return context_mix.score(docs, context_mix.fit(docs, fold("doc_id", 7) != 2), held_out("doc_id", 7, 2))


def op10_pu_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score of every document, learned from four fifths of the labels."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels"), lambda key: fold(key, 5) != 0)
    return toxicity.score_toxicity(docs.withColumn("held_out", held_out("doc_id", 5, 0)), model, ["doc_id", "held_out"])


def op11_prefix_doubling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all documents without the 50-byte strings that documents of smaller ids hold too; odd rows as in ``repeats``."""
    return repeats.digests(repeats.dedup(table(spark, sf_dir, "documents"), length=50))


def op12_tiled_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings on their 32 first principal components, whitened; odd rows as in ``whitening``."""
    out = whitening.whiten(whitening.whole(table(spark, sf_dir, "embeddings")), components=32)
    return out.withColumnRenamed("id", "vec_id")


def op13_block_max_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best of all documents for each item of ``benchmark``; odd rows as in ``lexical``."""
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_quotation_linking,
        op2_chroma_alignment,
        op3_rank_order_language,
        op4_residual_packing,
        op5_pu_quality,
        op6_norm_bucketed_top_k,
        op7_hypergeometric_mix,
        op8_hyperminhash_near_dup,
        op9_context_mixing,
        op10_pu_toxicity,
        op11_prefix_doubling,
        op12_tiled_whitening,
        op13_block_max_search,
    )
}

_OP1_LINE = "regexp_replace(line, '^((?:> ?)*)', '')"

ORACLES: dict[str, str] = {
    "op1_quotation_linking": f"""WITH RECURSIVE mail AS (
  SELECT c.conv_id, c.turn, CASE WHEN p.text IS NULL THEN c.text ELSE CASE WHEN g.text IS NULL THEN '' ELSE '> > ' || replace(g.text, chr(10), chr(10) || '> > ') || chr(10) END
    || '> ' || replace(p.text, chr(10), chr(10) || '> ') || chr(10) || chr(10) || coalesce(c.text, '') END AS text
  FROM conversations c LEFT JOIN conversations p ON p.conv_id = c.conv_id AND p.turn = c.turn - 1 LEFT JOIN conversations g ON g.conv_id = c.conv_id AND g.turn = c.turn - 2),
 raw AS (SELECT conv_id, turn, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(0, len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM mail),
 own_text AS (SELECT conv_id, turn, regexp_replace(string_agg(line, chr(10) ORDER BY pos), '^\\n+|\\n+$', '', 'g') AS text FROM raw WHERE NOT starts_with(line, '>') GROUP BY conv_id, turn),
 l AS (SELECT conv_id, turn, pos, length(replace(regexp_extract(line, '^((?:> ?)*)', 1), ' ', '')) AS level, trim(regexp_replace(lower({_OP1_LINE}), '\\s+', ' ', 'g')) AS body FROM raw),
 b AS (SELECT *, sum(CASE WHEN body = '' OR level IS DISTINCT FROM lag_level OR lag_body = '' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id, turn ORDER BY pos) AS part FROM (SELECT *, lag(level) OVER w AS lag_level, lag(body) OVER w AS lag_body FROM l WINDOW w AS (PARTITION BY conv_id, turn ORDER BY pos))),
 k AS MATERIALIZED (SELECT * FROM (SELECT conv_id, turn, level, part, string_agg(body, ' ' ORDER BY pos) AS body FROM b WHERE body <> '' GROUP BY ALL) WHERE regexp_matches(body, '[\\p{{L}}\\p{{N}}]')),
 kl AS MATERIALIZED (SELECT k.conv_id, k.turn, k.level, k.body AS passage, b.body AS line FROM k JOIN b ON b.conv_id = k.conv_id AND b.turn = k.turn AND b.part = k.part WHERE regexp_matches(b.body, '[\\p{{L}}\\p{{N}}]')),
 near AS (SELECT conv_id, body, min(turn) AS turn FROM k WHERE level = 0 GROUP BY conv_id, body),
 far AS (SELECT body, min((conv_id, turn)) AS m FROM k WHERE level = 0 AND len(string_split(body, ' ')) >= 5 GROUP BY body),
 q AS (SELECT conv_id, turn, level, body, sum(length(body)) AS chars, count(*) AS n FROM k WHERE level > 0 GROUP BY ALL),
 f AS MATERIALIZED (SELECT q.*, CASE WHEN n.turn < q.turn THEN q.conv_id WHEN far.m < (q.conv_id, q.turn) THEN far.m[1] END AS sc, CASE WHEN n.turn < q.turn THEN n.turn WHEN far.m < (q.conv_id, q.turn) THEN far.m[2] END AS st
  FROM q LEFT JOIN near n ON n.conv_id = q.conv_id AND n.body = q.body LEFT JOIN far ON far.body = q.body),
 nl AS (SELECT conv_id, line, min(turn) AS turn FROM kl WHERE level = 0 GROUP BY conv_id, line),
 ql AS (SELECT * FROM kl WHERE level > 0),
 g AS MATERIALIZED (SELECT f.conv_id, f.turn, f.level, f.body, length(ql.line) AS chars, nl.conv_id AS sc, nl.turn AS st FROM f JOIN ql ON ql.conv_id = f.conv_id AND ql.turn = f.turn AND ql.level = f.level AND ql.passage = f.body JOIN nl ON nl.conv_id = f.conv_id AND nl.line = ql.line AND nl.turn < f.turn WHERE f.sc IS NULL),
 counts AS (SELECT conv_id, turn, sum(n) AS n_quoted, sum(CASE WHEN sc IS NOT NULL OR EXISTS (SELECT 1 FROM g WHERE g.conv_id = f.conv_id AND g.turn = f.turn AND g.level = f.level AND g.body = f.body) THEN n ELSE 0 END) AS n_linked, max(level) AS max_level FROM f GROUP BY conv_id, turn),
 votes AS (SELECT conv_id, turn, sc, st, chars FROM f WHERE level = 1 AND sc IS NOT NULL UNION ALL SELECT conv_id, turn, sc, st, chars FROM g WHERE level = 1),
 parent AS MATERIALIZED (SELECT conv_id, turn, sc, st FROM (SELECT conv_id, turn, sc, st, sum(chars) AS c FROM votes GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY c DESC, sc, st) = 1),
 up AS (SELECT m.conv_id, m.turn, m.conv_id AS rc, m.turn AS rt, 0::BIGINT AS depth FROM mail m LEFT JOIN parent p USING (conv_id, turn) WHERE p.sc IS NULL
  UNION ALL SELECT p.conv_id, p.turn, u.rc, u.rt, u.depth + 1 FROM up u JOIN parent p ON p.sc = u.conv_id AND p.st = u.turn)
 SELECT u.conv_id, u.turn, coalesce(t.text, '') AS text, coalesce(n_quoted, 0)::BIGINT AS n_quoted, coalesce(n_linked, 0)::BIGINT AS n_linked, coalesce(max_level, 0)::BIGINT AS max_level, p.sc AS reply_conv, p.st AS reply_turn, u.rc AS root_conv, u.rt AS root_turn, u.depth
 FROM up u LEFT JOIN own_text t USING (conv_id, turn) LEFT JOIN counts USING (conv_id, turn) LEFT JOIN parent p USING (conv_id, turn)""",
    "op6_norm_bucketed_top_k": """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings),
 s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
 SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s QUALIFY rank <= 5""",
    "op8_hyperminhash_near_dup": """WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS l FROM documents),
 sh AS MATERIALIZED (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, unnest(CASE WHEN len(l) = 0 THEN [] WHEN len(l) < 3 THEN [array_to_string(l, ' ')] ELSE list_transform(range(1, len(l) - 1), lambda i: l[i] || ' ' || l[i + 1] || ' ' || l[i + 2]) END) AS s FROM w)),
 n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
 i AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
 p AS MATERIALIZED (SELECT x, y FROM i JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)),
 e AS MATERIALIZED (SELECT x, y FROM p UNION SELECT y, x FROM p),
 r AS (SELECT doc_id AS node, doc_id AS root FROM documents UNION SELECT e.y, r.root FROM r JOIN e ON e.x = r.node),
 c AS (SELECT node, min(root) AS root FROM r GROUP BY node)
 SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.root AS component_id, d.doc_id = c.root AS kept FROM documents d JOIN c ON c.node = d.doc_id LEFT JOIN n USING (doc_id)""",
    "op11_prefix_doubling": """WITH h AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, coalesce(doc_id, 9223372036854775807) AS doc, hex(encode(coalesce(text, ''))) AS x FROM documents),
 w AS MATERIALIZED (SELECT rid, doc, p, substr(x, 2 * p + 1, 100) AS s FROM (SELECT rid, doc, x, unnest(range(0, length(x) // 2 - 49)) AS p FROM h)),
 f AS (SELECT s, min(doc) AS first FROM w GROUP BY s HAVING min(doc) < max(doc)),
 g AS (SELECT rid, p, CASE WHEN p > lag(p) OVER o + 50 THEN 1 ELSE 0 END AS gap FROM w JOIN f USING (s) WHERE doc > first WINDOW o AS (PARTITION BY rid ORDER BY p)),
 spans AS (SELECT rid, min(p) AS a, max(p) + 50 AS b FROM (SELECT rid, p, sum(gap) OVER (PARTITION BY rid ORDER BY p) AS k FROM g) GROUP BY rid, k),
 cuts AS (SELECT rid, b - a AS n, a, b, coalesce(lag(b) OVER (PARTITION BY rid ORDER BY a), 0) AS was FROM spans),
 kept AS (SELECT rid, sum(n) AS n, count(*) AS k, string_agg(substr(x, 2 * was + 1, 2 * (a - was)), '' ORDER BY a) || substr(any_value(x), 2 * max(b) + 1) AS x FROM cuts JOIN h USING (rid) GROUP BY rid)
 SELECT doc_id, (length(h.x) // 2)::BIGINT AS n_bytes, coalesce(n, 0)::BIGINT AS n_removed, coalesce(k, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept.x, h.x))) AS kept_sha256 FROM h LEFT JOIN kept USING (rid)""",
    "op13_block_max_search": r"""WITH t AS MATERIALIZED (SELECT rid, doc_id, unnest(w) AS term FROM (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents)),
 n AS MATERIALIZED (SELECT rid, count(*) AS n FROM t GROUP BY rid),
 s AS MATERIALIZED (SELECT count(*) AS docs, sum(n)::BIGINT AS words FROM n),
 p AS MATERIALIZED (SELECT rid, any_value(doc_id) AS doc_id, term, count(*) AS tf FROM t GROUP BY rid, term),
 w AS MATERIALIZED (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM p, s GROUP BY term, docs),
 q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY ALL),
 r AS (SELECT item_id, rid, any_value(doc_id) AS doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // words))))::BIGINT AS score FROM q JOIN w USING (term) JOIN p USING (term) JOIN n USING (rid), s GROUP BY item_id, rid)
 SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id, rid)::INTEGER AS rank, doc_id, score FROM r WHERE score > 0 QUALIFY rank <= 10""",
}

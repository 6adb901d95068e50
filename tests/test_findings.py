"""Queries on odd tables against their SQL, and bounds that held only on small tables."""

import random

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from loomline.functions import text
from loomline.llm import context_mix
from loomline.operators import chunking, claims, graph, revision
from loomline.plans import catalogue
from loomline.plans.catalogue import ORACLES, QUERIES


def against_sql(spark, folder, name, **tables):
    """Both forms of a query over ``tables`` (rows and a schema); equal rows, repeats counted."""
    con = duckdb.connect()
    for t, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{folder}/{t}.parquet")
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    r = con.sql(ORACLES[name])
    want = sorted(tuple(map(str, x)) for x in r.fetchall())
    got = sorted(tuple(map(str, (x[c] for c in r.columns))) for x in QUERIES[name](spark, str(folder)).collect())
    assert got == want
    return got


def test_noise_quality_counts_every_literal(spark, tmp_path):
    """Items that share an id, items given twice, the sharp s, and letters whose lower case is more than one letter or depends on the place."""
    b = [(0, "0123456789 ssehr gut und noch mehr Text"), (1000000, "sehr gut"), (1000000, "noch mehr"), (7, "ΟΔΟΣ"), (8, "İs"), (9, "none"), (9, "none"), (11, None), (12, "")]
    d = [(1, "0123456789 ssehr gut und noch mehr Text"), (2, "0123456789 ßehr gut"), (3, "οδοσα ΟΔΟΣ is İS none"), (3, "NONE"), (4, None), (5, "")]
    got = against_sql(spark, tmp_path, "noise_quality", benchmark=(b, "item_id long, text string"), documents=(d, "doc_id long, text string"))
    assert got.count(("3", "9")) == 4 and got.count(("1", "1000000")) == 3


def test_pairs_are_scored_in_their_windows(spark, monkeypatch):
    """The scores of all candidate pairs, as by joining the texts to them, and only pairs that reach the least score become rows."""
    r = random.Random(3)
    odd = [None, "", "-", "a", "ab", "A b", "ß", "ss", "🙂🙂🙂🙂", "漢字かな", "x" * 5000, "x" * 4000 + "y" * 3000, "".join(map(chr, range(0x4E00, 0x9000)))]
    rows = [(i, i % 7, f"k{i % 3}", x) for i, x in enumerate(odd + [" ".join(r.choice(["alpha", "beta", "gamma", "delta", "été"]) + str(r.randrange(4)) for _ in range(r.randrange(1, 9))) for _ in range(250)])]
    c = spark.createDataFrame(rows, "id int, path int, kind string, statement string")
    want = {tuple(x) for x in claims.label_pairs(claims.view_pairs(claims.views(c)), c, "id", "statement").select("a", "b", "score").collect()}
    assert {tuple(x) for x in claims.view_scores(claims.views(c), c, "id", "statement", -1.0).collect()} == want
    assert {tuple(x) for x in claims.view_scores(claims.views(c), c, "id", "statement", 0.3).collect()} == {x for x in want if x[2] >= 0.3}
    monkeypatch.setattr(claims, "view_pairs", None)  # these two need no list of all pairs
    assert catalogue._linked(c).count() == len(rows)
    texts = [x or "" for *_, x in rows[:60]]
    assert [x for y in claims._window_scores(texts, np.array([60])) for x in y] == [x for y in claims._window_scores(texts, np.array([60]), 1) for x in y]


def test_texts_go_through_python_some_at_a_time(spark):
    """A task holds a thousand chunks, or twenty diffs, whatever the size of its batches."""
    batch = pa.RecordBatch.from_pylist([{"relative_path": f"p{i}", "revision_id": str(i), "source_sha256": "s", "text": "Some words follow.\r\n" * 500} for i in range(200)])
    sizes = [b.num_rows for b in chunking._run(chunking.Config())(iter([batch]))]
    assert max(sizes) == 1000 and sum(sizes) == 200 * sum(1 for _ in chunking.chunks_of("Some words follow.\n" * 500))
    first = next(chunking._run(chunking.Config())(iter([batch]))).to_pylist()
    assert "\r" not in first[0]["primary_text"]
    for t in ("é\r\n", "a\rb\r\r\nc", "", "\n\r"):
        assert spark.createDataFrame([(t,)], "t string").select(text.normalize(F.col("t"))).first()[0] == text.normalized(t)
    rows = [("a", "x\ny", "x\nz"), ("b", "same", "same"), ("c", None, "new\n"), ("d", None, None), ("e", "old", ""), ("f", "", None)]
    d = spark.createDataFrame(rows, "relative_path string, before string, after string")
    want = {tuple(r) for r in d.select("relative_path", revision.unified_diff("relative_path", "before", "after").alias("diff")).where("diff <> ''").collect()}
    assert {tuple(r) for r in revision.diffs(d).collect()} == want and {p for p, _ in want} == {"a", "c", "e"}


def test_every_text_moves_the_weights():
    """What the mixing weights of heads learn from is all texts, not some groups of them."""
    run = context_mix._read_corpus({}, context_mix.Code(np.ones((1, 256))))

    def learned(second):
        t = pa.RecordBatch.from_pydict({"text": ["some words here"] * 100 + [second] * 100, "learned": [True] * 200})
        return [x for b in run(iter([t])) for x in zip(b.column("w").to_pylist(), b.column("m").to_pylist()) if x[0] is not None]

    (a,), (b,) = learned("some words here"), learned("other things there now")
    assert a[0] != b[0] and a[1] != b[1]


def test_rounds_of_levels_broadcast_nothing(spark, monkeypatch):
    plans, cut = [], graph.cut
    monkeypatch.setattr(graph, "cut", lambda df: (plans.append(df._jdf.queryExecution().executedPlan().toString()), cut(df))[1])
    nodes = spark.range(1, 20).withColumnRenamed("id", "node")
    known, held = graph.levels(nodes, nodes.selectExpr("node", "node div 2 needs").where("needs > 0"))
    assert {r["node"]: r["level"] for r in known.collect()} == {i: i.bit_length() - 1 for i in range(1, 20)} and held.isEmpty()
    assert len(plans) > 8 and not any("Broadcast" in p for p in plans)

"""Clusters, audit chains, retrieval measures, invalidation and leases against brute force."""

import hashlib
import math
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from loomline.operators import audit, clusters, incremental, retrieval, similarity
from loomline.streaming import leases


def walked(ranks, links):
    """What going through the items in order gives."""
    near = {}
    for a, b, s in links:
        if a != b and a in ranks and b in ranks:
            near.setdefault(a, {})[b] = max(s, near.get(a, {}).get(b, 0))
            near.setdefault(b, {})[a] = max(s, near.get(b, {}).get(a, 0))
    heads = []
    for i in sorted(ranks, key=lambda i: (ranks[i], i)):
        if not any(h in near.get(i, {}) for h in heads):
            heads.append(i)
    own = {h: (h, 1.0) for h in heads}
    return own | {i: min(((h, s) for h, s in near[i].items() if h in own), key=lambda x: (-x[1], x[0])) for i in ranks if i not in own}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_clusters_are_those_of_the_walk(spark, seed):
    r = random.Random(seed)
    ranks = {i: r.randrange(10) for i in range(60)}
    links = [(r.randrange(62), r.randrange(62), round(r.random(), 3)) for _ in range(90 * seed)]
    got = clusters.canonical(spark.createDataFrame(list(ranks.items()), "id long, rank int"), spark.createDataFrame(links, "a long, b long, similarity double"))
    assert {x["id"]: (x["canonical_id"], x["similarity"]) for x in got.collect()} == walked(ranks, links)


def test_chains_do_not_drift(spark):
    chain = [(i, [f"t{j}" for j in range(i, i + 20)]) for i in range(12)] + [(50, [f"t{j}" for j in range(20)]), (60, [])]
    s = similarity.join(spark.createDataFrame(chain, "id int, tokens array<string>"), 7, 10)
    sets = {i: set(t) for i, t in chain}
    got = {r["id"]: r["canonical_id"] for r in clusters.without_drift(s, s.members.select("class_id").distinct().withColumn("rank", F.col("class_id"))).collect()}
    assert len(got) == len(chain) and len(set(got.values())) > 2
    for i, c in got.items():
        assert i == c or 10 * len(sets[i] & sets[c]) >= 7 * len(sets[i] | sets[c])


def test_no_clusters(spark):
    none = spark.createDataFrame([], "a long, b long, similarity double")
    assert clusters.canonical(spark.createDataFrame([], "id long, rank int"), none).count() == 0
    assert [tuple(r) for r in clusters.canonical(spark.createDataFrame([(1, None)], "id long, rank int"), none).collect()] == [(1, 1, 1.0)]


def test_chain_and_its_first_broken_link(spark):
    rows = [(i % 3, i, f"body {i}" if i % 5 else None) for i in range(40)]
    e = spark.createDataFrame(rows, "s int, n int, body string").repartition(5)
    got = {r["n"]: (r["previous_event_hash"], r["event_hash"]) for r in audit.chained(e, "s", ["n"], "n", F.col("body")).collect()}
    last = {}
    for s, n, body in rows:
        before = last.get(s, "")
        last[s] = hashlib.sha256(f"{before}\n{body or ''}".encode()).hexdigest()
        assert got[n] == (before, last[s])
    chain = audit.chained(e, "s", ["n"], "n", F.col("body"))
    assert audit.broken(chain, "s", ["n"], "n").count() == 0
    ends = {r["s"]: (r["events"], r["head"]) for r in audit.heads(chain, e, "s", ["n"], "n").collect()}
    assert ends == {s: (sum(x[0] == s for x in rows), h) for s, h in last.items()}
    bad = chain.where("n <> 9").withColumn("body", F.when(F.col("n").isin(13, 19), "forged").otherwise(F.col("body")))
    assert {tuple(r) for r in audit.broken(bad, "s", ["n"], "n").collect()} == {(0, 12, "LINK"), (1, 13, "CONTENT")}
    heads = audit.heads(chain, e, "s", ["n"], "n")
    whole = audit.root(heads, "s", block=2)
    one = [hashlib.sha256(f"{s}\n{last[s]}".encode()).hexdigest() for s in range(3)]
    two = [hashlib.sha256("\n".join(x).encode()).hexdigest() for x in (one[:2], one[2:])]
    assert whole == hashlib.sha256("\n".join(two).encode()).hexdigest()
    assert audit.root(heads.limit(0), "s") == hashlib.sha256(b"").hexdigest()


def test_measures(spark):
    results = [(1, "a", 1), (1, "b", 2), (1, "c", 3), (1, "z", 9), (2, "x", 1), (3, "y", 2), (3, "y", 5)]
    judged = [(1, "b", 2), (1, "c", 1), (1, "d", 3), (1, "a", 0), (3, "y", 1), (4, "q", 1), (1, "b", 1)]
    allowed = [(1, "a"), (1, "b"), (3, "y"), (1, "a")]
    make = lambda rows, schema: spark.createDataFrame(rows, schema)
    q = retrieval.per_query(make(results, "query_id int, item_id string, rank int"), make(judged, "query_id int, item_id string, grade int"), make(allowed, "query_id int, item_id string"), k=3)
    got = {r["query_id"]: tuple(r)[1:] for r in q.collect()}
    gain = lambda g, p: (2**g - 1) / math.log2(p + 1)
    ndcg = (gain(2, 2) + gain(1, 3)) / (gain(3, 1) + gain(2, 2) + gain(1, 3))
    assert got[1] == pytest.approx((3, 2, 2 / 3, 1 / 2, ndcg, 3, 1))
    assert got[2] == (0, 0, None, 0.0, None, 1, 1)
    assert got[3] == pytest.approx((1, 1, 1.0, 0.5, gain(1, 2) / gain(1, 1), 1, 0))
    assert got[4] == (1, 0, 0.0, 0.0, 0.0, 0, 0)
    r = retrieval.overall(q).first()
    assert (r["queries"], r["leakage"]) == (3, 2 / 5) and r["recall"] == pytest.approx((2 / 3 + 1) / 3)


STAGES, NEEDS = ["a", "b", "c", "d"], [("b", "a"), ("c", "b"), ("d", "a")]


def test_only_what_changed_runs(spark):
    needs = spark.createDataFrame(NEEDS, "stage string, needs string")
    stages = lambda **v: spark.createDataFrame([(s, v.get(s, "1")) for s in STAGES], "stage string, version string")
    assert {tuple(r) for r in incremental.closure(needs).collect()} == {("b", "a"), ("c", "b"), ("c", "a"), ("d", "a")}
    changed = spark.createDataFrame([("b",)], "stage string")
    assert {r[0] for r in incremental.affected(needs, changed).collect()} == {"b", "c"}
    loop = spark.createDataFrame([("a", "b"), ("b", "a")], "stage string, needs string")
    assert {tuple(r) for r in incremental.closure(loop).collect()} == {(x, y) for x in "ab" for y in "ab"}
    inputs = spark.range(200).select(F.col("id").alias("key"), F.col("id").cast("string").alias("fingerprint"))
    nothing = spark.createDataFrame([], "stage string, key long, fingerprint string")
    first = incremental.plan(nothing, inputs, stages(), needs)
    assert first.where("action <> 'RUN'").count() == 0 and first.count() == 800
    edited = inputs.where("key <> 7").withColumn("fingerprint", F.when(F.col("key") % 100 == 3, "new").otherwise(F.col("fingerprint")))
    second = incremental.plan(first.select("stage", "key", "fingerprint"), edited, stages(), needs)
    acts = {(r["action"], r["n"]) for r in second.groupBy("action").agg(F.count("*").alias("n")).collect()}
    assert acts == {("RUN", 8), ("GONE", 4), ("KEEP", 788)}
    seen = []

    def compute(rows):
        seen.extend(r["key"] for r in rows.collect())
        return rows.select("key", F.lit("again").alias("result"))

    done = incremental.refresh(inputs.select("key", F.lit("old").alias("result")), edited, second, "c", compute)
    assert sorted(seen) == [3, 103] and {r["result"]: r["n"] for r in done.groupBy("result").agg(F.count("*").alias("n")).collect()} == {"again": 2, "old": 197}
    third = incremental.plan(first.select("stage", "key", "fingerprint"), inputs, stages(b="2"), needs)
    assert {r[0] for r in third.where("action = 'RUN'").select("stage").distinct().collect()} == {"b", "c"}


def test_a_lease_goes_stale_by_a_timer(spark, tmp_path):
    start = datetime(2030, 1, 1)
    folder, schema = tmp_path / "beats", "job_id string, at timestamp, lifecycle string"
    folder.mkdir()
    batches = [
        [("a", 0, "RUNNING"), ("b", 0, "RUNNING"), ("c", 0, "RUNNING")],
        [("b", 10, "RUNNING"), ("c", 5, "EXITED")],
        [("b", 20, "RUNNING")],
        [("b", 21, "RUNNING"), ("a", 40, "RUNNING")],
        [("a", 41, "RUNNING")],
    ]
    for k, rows in enumerate(batches):
        lines = [f'{{"job_id": "{j}", "at": "{(start + timedelta(seconds=s)).isoformat()}", "lifecycle": "{x}"}}' for j, s, x in rows]
        (folder / f"{k}.json").write_text("\n".join(lines))
        query = leases.lease_watch(spark.readStream.schema(schema).json(str(folder)))
        q = query.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    at = lambda s: start + timedelta(seconds=s)
    assert {tuple(r) for r in got} == {("a", "HEALTHY", at(0)), ("b", "HEALTHY", at(0)), ("c", "HEALTHY", at(0)), ("c", "EXITED", at(5)), ("a", "STALE", at(15)), ("a", "HEALTHY", at(40)), ("b", "STALE", at(36))}

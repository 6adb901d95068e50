"""What failed at size in the fourth round."""

import random
from itertools import combinations

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomline.operators import claims, graph, packing, similarity
from loomline.plans import catalogue

from .test_findings_r03 import shuffled


def test_components_without_pairs(spark):
    """Claims of one statement are one class: what is shuffled are claims and classes, not the pairs of copies."""
    r = random.Random(3)
    words = [r.choice("abcdefgh") * 3 + str(k) for k in range(30)]
    kinds = [" ".join(r.sample(words, 4)) for _ in range(12)]
    kinds += [k + " " + words[0] for k in kinds] + ["...", "!!!", "Straße 1", "STRASSE 1", "x"]
    rows = [(i, i % 7, f"k{i % 3}", r.choice(kinds)) for i in range(3000)] + [(5000 + i, i % 9, "k1", " ".join(r.sample(words, 5))) for i in range(600)]
    c = spark.createDataFrame(rows, "id long, path long, kind string, statement string")
    pairs = graph.cut(claims.view_scores(claims.views(c), c, "id", "statement", 0.7 - 1e-6).withColumn("score", F.round("score", 6)).where("score >= 0.7"))
    want = {tuple(x) for x in graph.components(c.select(F.col("id").alias("node")), pairs.select("a", "b")).collect()}
    got = []
    n = shuffled(spark, lambda: got.extend(map(tuple, catalogue._linked(c).collect())))
    assert len(got) == len(rows) and set(got) == want and 20 < len({x for _, x in want}) < len(rows) / 4
    assert n < pairs.count()


def test_components_of_repeated_and_absent_ids(spark):
    rows = [(1, 1, "k", "one statement here"), (1, 2, "k", "quite another thing 77"), (2, 3, "k", "one statement here"), (3, 4, "k", "Quite another thing 77"), (None, 5, "k", "one statement here"), (4, 6, "k", None), (5, 6, "k", None), (6, 6, "k", "zzz")]
    got = sorted((tuple(x) for x in claims.linked(spark.createDataFrame(rows, "id int, path int, kind string, statement string"), 0.7).collect()), key=str)
    assert got == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 5), (6, 6), (None, None)]


@pytest.mark.parametrize("batch", [3, 10_000])
def test_places_of_runs(spark, batch):
    """The place of a run is that of its first item among the items themselves, whatever the batches and parts."""
    r = random.Random(batch)
    rows = [(r.choice(["a", "b", None]), f"g{r.randrange(4)}", i, r.randrange(1, 6)) for i in range(200)] + [("a", "g9", 1000, 2)]
    usual = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = packing.run_places(spark.createDataFrame(rows, "v string, g string, o int, size int"), ["v", "g"], ["o"], "size").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", usual)
    own = lambda v, g: [x for x in rows if x[:2] == (v, g)]
    assert {(x["v"], x["g"], x["o"], x["size"], x["rn"], x["n"]) for x in got} == {(v, g, o, s, sum(x[3] for x in own(v, g) if x[2] < o), sum(x[3] for x in own(v, g))) for v, g, o, s in rows}
    starts = {(x["v"], x["g"]): x["start"] for x in got}
    assert len(got) == len(rows) and len({(x["v"], x["g"], x["start"]) for x in got}) == len(starts) == len(set(starts.values()))


def test_sketches_lose_no_pair():
    """Windows are compared by sketches of their texts; every pair at the score is met, and few others."""
    r = random.Random(8)
    base = ["".join(r.choice("abcdefghij漢字𝒜ß") for _ in range(r.choice([1, 2, 3, 5, 8, 40, 120]))) for _ in range(60)]
    texts = ["", *base, *(t + r.choice("xyz") for t in base), *(t[: len(t) // 2] + "q" + t[len(t) // 2 :] for t in base)]
    texts = list(dict.fromkeys(texts))
    sketch = pa.Table.from_batches(claims._gram_sketches([pa.RecordBatch.from_pydict({"cls": pa.array(range(len(texts)), pa.int64()), "t": texts})]))
    grams = [{t[i : i + 3] for i in range(max(1, len(t) - 2))} if t else set() for t in texts]
    assert sketch["n"].to_pylist() == [len(g) for g in grams]
    rows = sketch.to_pylist()
    windows = [r.sample(range(len(texts)), m) for m in [2, 40, 40, 40, 90, 160, 160, 7]]
    m = pa.array([[rows[k] for k in w] for w in windows], pa.list_(pa.struct([(c, pa.int64()) for c in sketch.column_names])))
    got = {p for b in claims._window_meets(0.7 - 1e-6, 1 << 16)([pa.RecordBatch.from_arrays([m], names=["m"])]) for p in zip(*(c.to_pylist() for c in b.columns))}
    met = {(min(p), max(p)) for w in windows for p in combinations(w, 2)}
    want = {(a, b) for a, b in met if 10 * len(grams[a] & grams[b]) >= 7 * len(grams[a] | grams[b])}
    assert want <= got <= met and len(want) > 60 and len(got) < len(met) / 10


@pytest.mark.parametrize("threshold", ["10m", "-1"])
def test_sets_are_not_shuffled_to_each_block_they_meet(spark, threshold):
    """Blocks are read side by side, whether one side is broadcast or not; what is shuffled grows with the sets, not with the blocks."""
    r = random.Random(11)
    words = [r.getrandbits(63) for _ in range(60)]
    sets = sorted({tuple(sorted(r.sample(words, r.randrange(18, 24)))) for _ in range(400)})
    sets += [x for x in {tuple(sorted({*s[1:], words[k % 60]})) for k, s in enumerate(sets[:200])} if x not in set(sets)]
    df = graph.cut(spark.createDataFrame([(i, len(s), list(s)) for i, s in enumerate(sets)], "cid int, n int, tokens array<long>"))
    usual, got = spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), []
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        n = shuffled(spark, lambda: got.extend(map(tuple, similarity.block_candidates(df, 7, 10, 20).collect())))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", usual)
    want = {(a, b) for a, b in combinations(range(len(sets)), 2) if 10 * len({*sets[a]} & {*sets[b]}) >= 7 * len({*sets[a]} | {*sets[b]})}
    assert want <= set(got) and len(got) == len(set(got)) and len(want) > 100 and n < 2 * len(sets)


def test_copies_that_no_pair_is_made_from_go(spark):
    c = spark.createDataFrame([(i, i % 3, "k", f"words {i % 5} of one block {i // 50}") for i in range(200)], "id long, path long, kind string, statement string")
    known = set(graph._copies)
    made = claims.view_pairs(claims.views(c))
    assert len(set(graph._copies) - known) == 2 and made.count() > 1000  # claims by signature, and the windows of each

"""What failed at size in the third round."""

import random
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomline.functions import text
from loomline.llm import graph, nnpu, repeats
from loomline.operators import claims, similarity
from loomline.plans.catalogue import QUERIES

from .llm.helpers import docs
from .test_findings import against_sql


def test_only_drawn_texts_are_shuffled(spark, monkeypatch):
    """However many ids there are, the sample's texts are found by broadcast of the drawn ids."""
    plans, settle = [], nnpu.settle
    monkeypatch.setattr(nnpu, "settle", lambda df: (plans.append(df._jdf.queryExecution().executedPlan().toString()), settle(df))[1])
    usual = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as where the ids are many
    try:
        d = docs(spark, [(i, f"word{i % 3} text here", "en", "s", 1) for i in range(400)])
        labels = spark.range(0, 400, 4).selectExpr("id doc_id", "1 toxic")
        model = nnpu.fit(d, labels, "toxic", lambda key: F.lit(True), "words", max_positive=50, max_unlabelled=100, rounds=5)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", usual)
    (plan,) = plans
    lines = plan.splitlines()
    assert plan.count("LeftSemi, BuildRight") == 2 and model.prior > 0
    assert not any("SortMergeJoin [key" in x and "LeftSemi" in x and any("text" in y and "Exchange" in y for y in lines[k : k + 4]) for k, x in enumerate(lines))


def test_token_blocks_are_counted_without_a_join(spark, tmp_path):
    d = [(i, f"alpha{i % 3} beta-{i % 4} x yy gamma.{i} ß12 Straße. Zwei Sätze; eins {i % 2}\nalpha0 alpha0 1 22 333 4444 55555 666666 7777777 88888888 999999999") for i in range(40)] + [(40, None), (41, ""), (42, "a b c")]
    assert against_sql(spark, tmp_path, "document_token_blocks", documents=(d, "doc_id long, text string"))
    plan = QUERIES["document_token_blocks"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 2


@pytest.mark.parametrize(("num", "den", "block"), [(7, 10, 40), (7, 10, 1000), (9, 10, 30), (1, 2, 1000), (1, 10, 50), (1, 1, 10)])
def test_sets_that_meet_in_blocks(spark, num, den, block):
    """Every pair at the threshold is met, once, whatever the block; sets of one size level or of neighbouring ones."""
    r = random.Random(num + block)
    words = [r.getrandbits(63) for _ in range(40)]
    sets = {i: set(r.sample(words, r.randrange(1, 30))) for i in range(200)}
    for i in range(200, 300):  # near copies
        s = set(sets[r.randrange(i)])
        s.discard(min(s)) if len(s) > 1 and i % 2 else s.add(r.choice(words))
        sets[i] = s
    sets = {min(i for i, y in sets.items() if y == x): x for x in sets.values()}
    df = spark.createDataFrame([(i, len(s), sorted(s)) for i, s in sets.items()] + [(999, 0, [])], "cid int, n int, tokens array<long>")
    got = [tuple(x) for x in similarity.block_candidates(df, num, den, block).collect()]
    want = {(a, b) for a, b in combinations(sorted(sets), 2) if den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])}
    assert want <= set(got) and len(got) == len(set(got)) and all(a < b for a, b in got)
    assert (len(want) > 20 or num == den) and (den > 10 * num or 2 * num < den or len(got) < 10 * len(want) + 1)


def test_sets_of_few_tokens_meet_in_blocks(spark, monkeypatch):
    """Where each pair of tokens is common, no row is made for each meeting; the links are the same."""
    r = random.Random(5)
    rows = [(i, [f"t{x}" for x in r.sample(range(60), 25)]) for i in range(300)] + [(1000 + i, [f"t{x}" for x in range(i, i + 25)]) for i in range(30)]
    df = spark.createDataFrame(rows, "id int, tokens array<string>")
    links = lambda: {tuple(x) for x in similarity.join(df).links.collect()}
    monkeypatch.setattr(similarity, "crowded", lambda *a: False)
    want = links()
    monkeypatch.undo()
    monkeypatch.setattr(similarity, "candidates", None)
    assert links() == want and len(want) > 50


def test_shingles_in_one_pass(spark):
    texts = [None, "", "a", "ab", "abc", "abcabcd", "𝒜b𝒞d𝒜b𝒞", "a\nb\r\n c", "漢字かな漢字か"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", text.shingles(F.col("t")).alias("s"))
    got = {x["t"]: x["s"] for x in df.collect()}
    assert got == {t: [] if not t else list(dict.fromkeys(t[i : i + 3] for i in range(max(1, len(t) - 2)))) for t in texts}
    assert "lambda" not in df._jdf.queryExecution().optimizedPlan().toString()  # which would work the text out for each gram


def test_a_class_meets_its_label_once(spark, monkeypatch):
    """Not once in each of its bands."""
    plans, settle = [], graph.settle
    monkeypatch.setattr(graph, "settle", lambda df: (plans.append(df._jdf.queryExecution().optimizedPlan().toString()), settle(df))[1])
    bands = spark.createDataFrame([(k, c, 5, 0) for c in range(6) for k in range(4)] + [(9, 0, 5, 0)], "key long, cid long, n long, own long")
    labels = spark.createDataFrame([(c, 0 if c < 5 else c) for c in range(6)], "cid long, label long")
    got = {tuple(x) for x in graph._mixed(bands, labels).select("key", "cid", "n", "own", "label").collect()}
    assert got == {(k, c, 5, 0, 0 if c < 5 else c) for c in range(6) for k in range(4)}
    lines = [x for x in plans[0].splitlines() if "Join" in x or "Generate" in x]
    assert any("Generate inline" in x and "cid" in y and "Join" in y for x, y in zip(lines, lines[1:]))


def shuffled(spark, run) -> int:
    """How many rows the jobs of ``run`` write to shuffles."""
    sc = spark.sparkContext
    stages = lambda: sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    known = {stages().apply(i).stageId() for i in range(stages().size())}
    run()
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    return sum(x.shuffleWriteRecords() for x in (stages().apply(i) for i in range(stages().size())) if x.stageId() not in known)


def test_pairs_are_not_shuffled(spark):
    """A pair is made in the first window that has it, so what is shuffled are members of windows, not pairs."""
    rows = [(i, i % 3, "k", f"words {i % 5} of one block {i // 50}") for i in range(600)]
    c = spark.createDataFrame(rows, "id long, path long, kind string, statement string")
    made = []
    n = shuffled(spark, lambda: made.extend(map(tuple, claims.view_pairs(claims.views(c)).collect())))
    assert len(made) == len(set(made)) > 30_000 and n < len(made)


@pytest.mark.parametrize("bound", [64, 12, 0])
def test_pairs_of_repeated_ids(spark, bound):
    """Claims that share an id, or have none: each pair of ids once, however many windows an id has."""
    r = random.Random(9)
    text = lambda: " ".join(r.choice(["alpha", "beta", "gamma", "delta"]) + str(r.randrange(3)) for _ in range(r.randrange(1, 6)))
    rows = [(i, r.randrange(5), f"k{r.randrange(2)}", text()) for i in [*range(400), *[7] * 60, *[8] * 3, None, None]] + [(900, 1, "k", None), (901, None, None, "")]
    members = graph.settle(claims.views(spark.createDataFrame(rows, "id int, path int, kind string, statement string")))
    windows: dict = {}
    for x in claims.view_windows(members).where("id is not null").collect():
        windows.setdefault((x["view"], x["block"], x["window_start"]), set()).add(x["id"])
    got = [tuple(x) for x in claims.view_pairs(members, bound=bound).collect()]
    assert set(got) == {p for w in windows.values() for p in combinations(sorted(w), 2)} and len(got) == len(set(got)) > 5000


def test_members_that_met_before():
    before = [[1, 2, 3], [], None, [3], [2, 5], [4], [9], [9], [9, 8], [8], [8]]
    size = [6, 2, 3]
    at, want = 0, []
    for n in size:
        want += [bool(set(x or ()) & set(y or ())) for x, y in combinations(before[at : at + n], 2)]
        at += n
    column = pa.array([None, [7]] + before, pa.list_(pa.int32()))[2:]
    for most in (1, 1 << 20):
        assert claims._met(column, np.cumsum(size) - size, np.array(size), most).tolist() == want
    assert not claims._met(pa.array([[], []], pa.list_(pa.int32())), np.array([0]), np.array([2])).any()


def test_texts_meet_their_runs_where_they_lie(spark, monkeypatch):
    """Texts are dealt once, when they are copied; what runs, ranges and cuts join them by shuffles no text."""
    plans, settle = [], repeats.settle
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString().splitlines()
    monkeypatch.setattr(repeats, "settle", lambda df, *by: (plans.append(plan(df)), settle(df, *by))[1])
    usual = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as where the runs are many
    try:
        passage = " ".join(f"word{i}" for i in range(40))
        d = docs(spark, [(i, f"{i} {passage} {i * 7}" if i % 3 else passage, "en", "s", 1) for i in range(60)])
        out = repeats.dedup(d)
        plans.append(plan(out))
        got = {r["doc_id"]: len(r["kept"]) for r in out.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", usual)
    assert got[0] == len(passage) and got[3] == 0 and 0 < got[1] < 20 and len(got) == 60
    assert sum("Exchange" in x for p in plans for x in p) > 10
    assert not any("Exchange" in x and "text#" in p[k + 1] for p in plans for k, x in enumerate(p[:-1]))

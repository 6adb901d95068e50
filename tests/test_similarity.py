"""Set-similarity joins against all pairs."""

import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomline.functions import text
from loomline.operators import claims, similarity


@pytest.mark.parametrize(("num", "den"), [(7, 10), (1, 2), (9, 10), (1, 1), (1, 10)])
def test_all_pairs_of_small_sets(spark, num, den):
    r = random.Random(num * den)
    sets = {i: frozenset(r.sample("abcdefghijkl", r.randrange(1, 9))) for i in range(150)}
    rows = [(i, sorted(s)) for i, s in sets.items()] + [(500, []), (501, []), (502, None)]
    got = similarity.join(spark.createDataFrame(rows, "id int, tokens array<string>"), num, den)
    first = {}
    for i, s in sets.items():
        first.setdefault(s, i)
    assert {r["id"]: r["class_id"] for r in got.members.collect()} == {i: first[s] for i, s in sets.items()} | {500: 500, 501: 500, 502: 500}
    want = {(min(x, y), max(x, y), len(a & b)) for (a, x), (b, y) in combinations(first.items(), 2) if den * len(a & b) >= num * len(a | b)}
    assert {(r["a"], r["b"], r["shared"]) for r in got.links.collect()} == want
    assert sum(r["links"] for r in got.per_item().dropDuplicates(["class_id"]).collect()) == 2 * len(want)


def test_no_sets(spark):
    got = similarity.join(spark.createDataFrame([], "id int, tokens array<string>"))
    assert got.per_item().count() == got.links.count() == 0


def test_statements_lose_no_pair(spark, data):
    """Every pair of statements at 0.7, by a product of all with all."""
    d = claims.sentences(spark.read.parquet(f"{data}/documents.parquet"), "doc_id").select((F.col("doc_id") * 100_000 + F.col("pos")).alias("id"), "statement")
    rows = d.select("id", text.shingles(text.alphanumerics(F.col("statement"))).alias("g")).orderBy("id").collect()
    first: dict[frozenset, int] = {}
    for r in rows:
        first.setdefault(frozenset(r["g"]), r["id"])
    first.pop(frozenset(), None)
    names = {g: k for k, g in enumerate(sorted({g for s in first for g in s}))}
    m = np.zeros((len(first), len(names)), np.float32)
    for k, s in enumerate(first):
        m[k, [names[g] for g in s]] = 1
    size, ids, want = m.sum(1), list(first.values()), set()
    for k in range(0, len(m), 1000):
        shared = m[k : k + 1000] @ m.T
        for a, b in zip(*np.nonzero(10 * shared >= 7 * (size[k : k + 1000, None] + size[None] - shared) - 1e-3)):
            if k + a != b:
                want.add((min(ids[k + a], ids[b]), max(ids[k + a], ids[b])))
    got = {(r["a"], r["b"]) for r in claims.complete_pairs(d, "id", "statement").links.collect()}
    assert got == want and len(want) > 50


def test_blocks_of_the_narrow_rule(spark):
    rows = [(v, b, i, i) for v, b, n in (("token", "big", 161), ("token", "mid", 100), ("minhash", "small", 40), ("token", "one", 1), ("kind", "k", 50)) for i in range(n)]
    got = claims.reference_blocks(spark.createDataFrame(rows, "view string, block string, id int, ord int")).collect()
    windows = {}
    for r in got:
        windows.setdefault((r["block"], r["window_start"]), set()).add(r["id"])
    assert windows == {("mid", s): set(range(s, min(100, s + 40))) for s in (0, 32, 64, 96)} | {("small", 0): set(range(40))}

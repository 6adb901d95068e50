"""Whitening and lexical search against brute force."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomline.llm import lexical, queries, whitening

from .helpers import crowded, docs, odd_rows, sentence


def check_whitened(rows, got, components=32):
    """``rows``: (id, vector) that take part, all of one dimension."""
    x = np.array([[math.floor(64 * float(c)) + 1_000_000 for c in v] for _, v in rows], object)
    n, sums = len(x), x.sum(0)
    centred = np.array([[float(n * a - s) / n for a, s in zip(r, sums)] for r in x])
    cov = centred.T @ centred / n
    e = np.linalg.eigvalsh(cov)[::-1]
    k = min(components, len(e))
    deviation = Counter((i, int(sum((n * a - s) ** 2 for a, s in zip(r, sums)))) for (i, _), r in zip(rows, x))
    assert Counter((r["id"], r["deviation"]) for r in got if r["component"] == 1) == deviation
    assert all(r["n"] == n for r in got) and len(got) == n * k
    by = {}
    for r in got:
        by.setdefault(r["component"], []).append(r)
    assert sorted(by) == list(range(1, k + 1))
    for c, mine in by.items():
        assert all(abs(r["explained"] - e[c - 1] / np.trace(cov)) <= 1e-9 for r in mine)
    z = np.array([[r["whitened"] for r in sorted(by[c], key=lambda r: (r["id"], r["deviation"]))] for c in by])
    real = e[:k] > 1e-12 * np.trace(cov)
    assert np.abs(np.cov(z[real], bias=True) - np.eye(real.sum())).max() < 1e-8 if real.any() else True
    assert max(r["identity_error"] for r in got) < 1e-8
    order = sorted(range(n), key=lambda i: (rows[i][0], sum((n * a - s) ** 2 for a, s in zip(x[i], sums))))
    vectors = np.linalg.eigh(cov)[1][:, ::-1]
    for c in range(k):
        apart = min(abs(e[c] - e[j]) for j in range(len(e)) if j != c) if len(e) > 1 else 1
        if real[c] and apart > 1e-6 * e[0]:
            want = centred[order] @ vectors[:, c] / math.sqrt(e[c])
            assert min(np.abs(z[c] - want).max(), np.abs(z[c] + want).max()) < 1e-6


@pytest.mark.parametrize(("tile", "dims"), [(4, 10), (16, 3), (3, 9)])
def test_whitens(spark, tile, dims):
    rng = np.random.default_rng(tile)
    rows = [(i, (rng.normal(size=dims) * np.arange(1, dims + 1)).tolist()) for i in range(150)]
    rows += [(3, rows[5][1]), (7, rows[7][1])]
    odd = [(900, None), (901, [float("nan")] * dims), (902, [float("inf")] + [0.0] * (dims - 1)), (903, [None] + [0.0] * (dims - 1)), (904, [])]
    df = crowded(spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>"))
    v = whitening.whole(df)
    check_whitened(rows, whitening.whiten(v, components=6, tile=tile).collect(), 6)


def test_moments_in_small_blocks(spark):
    m = np.random.default_rng(1).normal(size=(300, 7))
    df = spark.createDataFrame([(7, r.tolist()) for r in m], "kind long, v array<double>").repartition(3)
    got = whitening.moments(df, tile=2, block_cells=70)[7]
    assert got.n == 300 and np.allclose(got.covariance, np.cov(m.T, bias=True)) and np.allclose(got.sums, m.sum(0))
    with pytest.raises(ValueError, match="most_dims"):
        whitening.moments(df, most_dims=6)


def test_whitening_odd_tables(spark):
    schema = "vec_id long, embedding array<double>"
    one = lambda rows: whitening.whiten(whitening.whole(spark.createDataFrame(rows, schema))).collect()
    assert one([]) == [] and one([(1, None)]) == []
    flat = one([(1, [2.0, 1.0]), (None, [2.0, 1.0])])
    assert len(flat) == 4 and all(r["whitened"] == 0 and r["deviation"] == 0 and r["identity_error"] == 0 for r in flat)
    mixed = one([(i, [float(i % 3), float(i % 5)]) for i in range(20)] + [(50 + i, [float(i)]) for i in range(4)] + [(99, [1e300, -1e300])])
    assert {(r["n"], r["component"]) for r in mixed} == {(21, 1), (21, 2), (4, 1)}


def test_whitening_query(spark, data):
    rows = [(r["vec_id"], list(r["embedding"])) for r in spark.read.parquet(f"{data}/embeddings.parquet").collect()]
    check_whitened(rows, queries.op12_tiled_whitening(spark, data).withColumnRenamed("vec_id", "id").collect())


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def best(documents, items, k=10):
    """item, rank, doc_id, score by scoring every document."""
    split = lambda t: TERM.findall((t or "").translate(LOWER))
    rows = [(i, Counter(w), len(w)) for i, w in ((i, split(t)) for i, t in documents) if w]
    total, df = sum(n for _, _, n in rows), Counter(t for _, c, _ in rows for t in c)
    out = []
    for item, text in items:
        found = []
        for i, c, n in rows:
            m = 25 + (75 * n * len(rows)) // total
            score = sum(math.floor(1000 * math.log((2 * len(rows) + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in split(text) if t in c)
            if score > 0:
                found.append((-score, 1 << 63 if i is None else i, i))
        out += [(item, rank + 1, i, -s) for rank, (s, _, i) in enumerate(sorted(found, key=lambda f: f[:2])[:k])]
    return sorted(out, key=repr)


@pytest.mark.parametrize(("block_docs", "first", "group"), [(512, 16, 5000), (3, 1, 5000), (4, 2, 2)])
def test_search(spark, block_docs, first, group):
    d = [(r[0], r[1]) for r in odd_rows()] + [(200 + i, f"Ünïcode {i} {sentence(i, 30)} x_y A1b2") for i in range(60)] + [(201, "same"), (201, "same"), (300, "same"), (None, "same"), (301, "§§ --- §§")]
    items = [(1, sentence(3, 12)), (2, "same SAME"), (3, "ünïcode Ünïcode a1b2 zzz"), (4, ""), (5, "nowhere"), (6, "§§ x"), (7, "wizards wizards brew"), (8, "12 34")]
    df = crowded(docs(spark, [(i, t, None, None, None) for i, t in d]))
    asked = spark.createDataFrame([*items, (None, "same"), (9, None), (1, "zzz")], "item_id long, text string").withColumn("score", F.lit("clash"))
    items[0] = (1, min(items[0][1], "zzz"))
    got = lexical.search(df, asked, block_docs=block_docs, first=first, group=group)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == best(d, items)


def test_search_skips_blocks(spark):
    d = [(i, sentence(i, 20) + (" rareword" if i in (5, 700) else "")) for i in range(800)]
    got = lexical.search(docs(spark, [(i, t, None, None, None) for i, t in d]).repartitionByRange(2, "doc_id"), spark.createDataFrame([(1, "rareword fox")], "item_id long, text string"), block_docs=8, first=4)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == best(d, [(1, "rareword fox")])


def test_search_empty_tables(spark):
    item = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert lexical.search(docs(spark, []), item).count() == 0
    assert lexical.search(docs(spark, [(1, None, None, None, None)]), item).count() == 0
    assert lexical.search(docs(spark), item.limit(0)).count() == 0

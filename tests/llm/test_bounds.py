"""Bounds and brute force of the learned operators: risk, prior, samples, frequent pairs, anchors, long recordings."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomline.llm import chroma, context_mix, mixing, nnpu

from .helpers import docs


def risk(w, b, p, u, prior):
    """The non-negative risk of feature lists, by its formula, and its two parts."""
    loss = lambda z: math.log1p(math.exp(-z))
    score = lambda x: sum(w[i] for i in x) + b
    plus = prior * sum(loss(score(x)) for x in p) / len(p)
    rest = sum(loss(-score(x)) for x in u) / len(u) - prior * sum(loss(-score(x)) for x in p) / len(p)
    return plus, rest


@pytest.mark.parametrize("prior", [0.2, 0.9])
def test_descent_follows_the_risk(monkeypatch, prior):
    rng = np.random.default_rng(4)
    lists = lambda n, high: [sorted(set(rng.integers(0, high, 4).tolist())) for _ in range(n)]
    p, u = lists(20, 6), lists(40, 10)
    seen = []
    real = nnpu._descend

    def watch(ps, us, slopes, rounds, rate, decay):
        def spy(zp, zu):
            gp, gu = slopes(zp, zu)
            seen.append((zp.copy(), zu.copy(), gp, gu))
            return gp, gu

        return real(ps, us, spy, rounds, rate, decay)

    monkeypatch.setattr(nnpu, "_descend", watch)
    w, b = nnpu.minimise(p, u, 10, prior, rounds=400, decay=0.0)
    signs = set()
    for zp, zu, gp, gu in seen[::40]:
        # As scores are the only way in, the derivative by each score is checked by difference.
        part = lambda zp, zu: (prior * np.logaddexp(0, -zp).mean(), np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean())
        negative = part(zp, zu)[1] < 0
        signs.add(negative)
        goal = lambda zp, zu: -part(zp, zu)[1] if negative else sum(part(zp, zu))  # noqa: B023, E731
        for z, g in ((zp, gp), (zu, gu)):
            for i in (0, len(z) - 1):
                up, down = z.copy(), z.copy()
                up[i] += 1e-5
                down[i] -= 1e-5
                difference = (goal(*((up, zu) if z is zp else (zp, up))) - goal(*((down, zu) if z is zp else (zp, down)))) / 2e-5
                assert abs(difference - g[i]) < 1e-7
    assert signs == {False, True} if prior > 0.5 else False in signs
    plus, rest = risk(w, b, p, u, prior)
    start = risk(np.zeros(10), 0.0, p, u, prior)
    assert plus + max(0, rest) < start[0] + max(0, start[1])


@pytest.mark.parametrize("noise", [0.0, 0.03])
@pytest.mark.parametrize("share", [0.02, 0.1, 0.3, 0.5, 0.7, 0.9, 0.95])
def test_class_prior(share, noise):
    rng = np.random.default_rng(int(share * 100))

    def texts(n, good):
        strong = rng.random((n, 12)) < (0.35 if good else 0.35 * noise)
        weak = rng.random((n, 12)) < (0.35 * noise if good else 0.35)
        return [np.flatnonzero(r).tolist() + [24 + int(k)] for r, k in zip(np.hstack([strong, weak]), rng.integers(0, 6, n))]

    p = texts(3000, True)
    n = int(6000 * share)
    u = texts(n, True) + texts(6000 - n, False)
    got = nnpu.estimate_prior(p, [u[i] for i in rng.permutation(len(u))], 30)
    assert abs(got - share) < 0.05 + 0.05 * (share >= 0.3), got


def test_repeated_ids_add_nothing(spark):
    few = [(i, ("good plain words here " if i % 2 else "bad odd noise there ") + str(i % 7), "en", "s", 1) for i in range(300)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(300)] + [(10_000 + i, 1, 0) for i in range(500)], "doc_id long, quality int, toxic int")
    fit = lambda rows: nnpu.fit(docs(spark, rows), labels, "quality", lambda key: F.lit(True), "words", rounds=50)
    once, often = fit(few), fit(few + [few[1]] * 3000 + [few[2]] * 2000)
    assert once.selected == often.selected and np.array_equal(once.weights, often.weights) and once.prior == often.prior
    assert once.selected


def test_frequent_pairs_keep_their_bound(spark):
    rows = [(0, b"w%d" % i, 5, c, -1.0) for i, c in enumerate([20_000] * 50 + [9_000] * 3 + [5] * 10)]
    rated = spark.createDataFrame(rows, "state int, token binary, c_token long, c_all long, log2 double")
    assert [len(context_mix._heavy(rated, most)[0]) for most in (5, 50, 52, 53, 60, 100)] == [0, 50, 50, 53, 53, 63]
    assert len(context_mix._heavy(rated.limit(0), 5)[0]) == 0


def test_anchors_are_those_of_whole_texts(spark):
    late = [(i, " ".join(f"u{i}x{j}" for j in range(3000)), "en", "s", 1) for i in range(3)] + [(9, "late word late word " * 4000, "en", "s", 1)]
    orders = []
    for parts in (1, 4):
        model = context_mix.fit(docs(spark, late).repartition(parts), F.lit(True))
        orders.append(set(model.groups))
    assert orders[0] == orders[1] and {b"late", b"word"} <= orders[0]


def test_misra_gries_keeps_frequent_words():
    import pyarrow as pa

    words = " ".join(f"rare{i}" if i % 10 else "often" for i in range(40_000))
    out = next(context_mix._frequent(100)(iter([pa.RecordBatch.from_pydict({"text": [words]})] * 2)))
    got = dict(zip(out.column("w").to_pylist(), out.column("n").to_pylist()))
    assert 8000 * (1 - 10 / 100) <= got[b"often"] <= 8000


@pytest.mark.parametrize("minutes", [10, 60])
def test_long_recordings_align(minutes):
    """Codes at 8 a second, a cut of the second recording, and one bit in ten wrong."""
    found = 0
    for seed in range(10):
        rng = np.random.default_rng(seed)
        a = rng.integers(0, 1 << 32, minutes * 60 * 8, np.uint64).astype(np.uint32)
        cut = int(rng.integers(100, len(a) // 2))
        b = a[cut:] ^ np.packbits(rng.random((len(a) - cut, 32)) < 0.1, axis=1).view(np.uint32).ravel()
        got = chroma.align(a, b)
        found += got is not None and got[0] == cut and abs(got[1] - 0.1) < 0.01
    assert found >= 9


def test_alignment_of_one_repeated_code():
    a = np.zeros(6000, np.uint32)
    assert chroma.align(a, a[:3000])[1] == 0


def test_seed_changes_the_order_of_blocks(spark):
    order = lambda salt: [r[0] for r in spark.range(500).select(mixing.permuted(F.col("id"), F.lit(500).cast("long"), F.xxhash64(F.lit(salt)))).collect()]
    a, b = order(1), order(2)
    assert sorted(a) == sorted(b) == list(range(500)) and a != b and order(1) == a
    step = {(y - x) % 500 for x, y in zip(a, a[1:])}, {(y - x) % 500 for x, y in zip(b, b[1:])}
    assert all(len(s) == 1 for s in step)


def test_pairs_are_learned_in_blocks_of_one_size():
    """However few rows a batch has: many small ones cost calls, and moved the weights by shares of few pairs."""
    import pyarrow as pa

    some = [pa.RecordBatch.from_pydict({"x": list(range(k, k + 10))}) for k in range(0, 250, 10)]
    got = list(context_mix.regrouped(iter(some), 100))
    assert [b.num_rows for b in got] == [100, 100, 50] and [x for b in got for x in b.column("x").to_pylist()] == list(range(250))
    assert not list(context_mix.regrouped(iter([]), 100))


def test_words_are_looked_up_once_for_all_texts():
    """A batch asks its vocabulary once for each different word; words and sizes are those of each text alone."""
    import pyarrow as pa

    asked = []

    class Asked(context_mix.Vocabulary):
        def __getitem__(self, w):
            asked.append(w)
            return super().__getitem__(w)

    texts = [b" The the\x0b\x0cx\x1cy ", None, b"", b"\xff the", b"\t\r\n", b"the"] * 50
    known = Asked({})
    ids, size = context_mix.numbered(pa.array([b"left out", *texts], pa.binary()).slice(1), known)
    want = [[*(t or b"").lower().split(), b"\n"] for t in texts]
    assert [known.words[i] for i in ids] == [w for t in want for w in t] and size.tolist() == list(map(len, want))
    assert len(asked) <= 6
    t = context_mix.Texts(texts[:2], known)
    assert t.two.tolist()[:3] == [0, 0, t.one[1]] and t.one[4] == 0 and t.doc.tolist() == [0, 0, 0, 0, 1]


def test_prices_of_one_batch_do_not_depend_on_blocks():
    rng = np.random.default_rng(3)
    known = context_mix.Vocabulary({b"a": 1})
    t = context_mix.Texts([b" ".join(bytes([97 + int(x) % 20, 97 + int(x) % 7]) for x in rng.integers(0, 99, 300)) for _ in range(5)], known)
    code, m = context_mix.Code(np.bincount(t.first, minlength=256).reshape(1, -1).astype(float)), context_mix.Mixer(3)
    plain, side = context_mix.empty_tables(context_mix.HEAD_BITS), context_mix.paired(context_mix.empty_tables(context_mix.HEAD_BITS))
    for tables in (plain, side):
        context_mix.learn_heads(t, code, tables, context_mix.Mixer(3))
    assert all(np.array_equal(a, b) and a.any() for a, b in zip(plain, side))
    prices = context_mix.Prices(side, context_mix.HEAD_BITS)
    assert np.array_equal(context_mix.price_heads(t, code, prices, m, 7), context_mix.price_heads(t, code, prices, m))

"""Operators over documents: odd cases, and brute force."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomline.llm import context_mix, langid, mixing, near_dup, nnpu, packing, quality, toxicity
from loomline.llm.common import fold, held_out
from loomline.llm.queries import tokenizer_path

from .helpers import crowded, docs, odd_rows, sentence

N = len(odd_rows())


@pytest.fixture(scope="module")
def odd(spark):
    return crowded(docs(spark)).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return docs(spark, [])


# ---------------------------------------------------------------- language


def test_language(spark, odd, none):
    prof = langid.learn(odd)
    out = langid.predict(odd, prof, ["doc_id"]).collect()
    assert len(out) == N and all(0 <= r["score"] <= 1 for r in out)
    assert {r["lang_pred"] for r in out if r["doc_id"] in (20, 21, 22, 35)} == {"und"}
    assert langid.learn(none) == {} and langid.predict(none, prof, ["doc_id"]).count() == 0
    assert langid.predict(odd, {}, ["doc_id"]).where("lang_pred <> 'und'").count() == 0


def test_language_distance_is_out_of_place():
    codes, places = langid.table([[5, 6, 7], [9, 5]], 3)
    assert langid.distances(np.array([6, 5, 9]), codes, places, 3).tolist() == [(1 + 1 + 3) / 9, (3 + 0 + 2) / 9]
    assert langid.distances(np.array([1]), *langid.table([], 3), 3).tolist() == []


def test_language_by_brute_force(spark):
    """Profiles, distances and choices, gram by gram in plain Python."""
    rows = [(i, t, lang, "s", 1) for i, (t, lang) in enumerate([("The cat sat. The dog", "en"), ("Der Hund und die Katze", "de"), ("le chat et le chien", "fr"), ("une maison, le chat", "fr"), ("die Maus 12 der Hund!", None), ("the the house", None), ("É à ça 7", None), ("x", None)])]

    def codes(text):
        cp = [0]
        for ch in text.lower() + "\0":
            c = ord(ch) if ch.isalpha() else 0
            if c or cp[-1]:
                cp.append(c)
        if len(cp) < 3:
            return []
        mask, m = (1 << 32) - 1, 0x9E3779B1
        one = [c * 0x85EBCA6B & mask for c in cp]
        two = [(one[i] ^ cp[i + 1] + 77) * m & mask for i in range(len(cp) - 1)]
        three = [(two[i] ^ cp[i + 2] + 1234567) * m & mask for i in range(len(cp) - 2)]
        return [o >> 12 for o, c in zip(one, cp) if c] + [x >> 12 for x in two] + [x >> 12 for x in three]

    def best(counts, top):
        return [c for c, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:top]]

    by = {}
    for _, t, lang, *_ in rows:
        if lang:
            by.setdefault(lang, Counter()).update(codes(t))
    top = 20
    profiles = {lang: best(c, top) for lang, c in by.items()}
    d = docs(spark, rows)
    assert langid.learn(d, top) == profiles
    want = {}
    for i, t, *_ in rows:
        mine = best(Counter(codes(t)), top)
        far = {lang: sum(abs(p.index(c) - k) if c in p else top for k, c in enumerate(mine)) / (top * len(mine)) for lang, p in profiles.items()}
        want[i] = min(sorted(far), key=lambda x: far[x]), round(min(far.values()), 9)
    got = langid.predict(d, profiles, ["doc_id"], top).collect()
    assert {r["doc_id"]: (r["lang_pred"], round(r["distance"], 9)) for r in got} == want


def test_language_held_out(spark, data):
    d = spark.read.parquet(f"{data}/documents.parquet")
    out = langid.predict(d.withColumn("held_out", held_out("doc_id", 4, 2)), langid.learn(d.where(fold("doc_id", 4) != 2)), ["doc_id", "held_out", "lang"]).where("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in out) / len(out) > 0.95


# ---------------------------------------------------------------- packing


def test_packing_is_an_exact_round_trip(spark, odd, none):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    out = packing.pack(odd, tokenizer_path(), hold=5).toPandas()
    want = Counter()
    for d, t, *_ in odd_rows():
        x = tok.encode(t or "", add_special_tokens=False).ids + [1]
        for k in range(0, len(x), 4096):
            want[(d, k // 4096, k, len(x[k : k + 4096]), zlib.crc32(np.asarray(x[k : k + 4096], "<u4").tobytes()))] += 1
    got = Counter((None if np.isnan(r.doc_id) else int(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in out.itertuples())
    assert got == want
    for _, g in out.sort_values("offset").groupby("sequence_id"):
        assert list(g.offset) == [0, *g.length.cumsum()[:-1]] and g.length.sum() <= 4096
    assert out.sequence_id.nunique() <= math.ceil(out.length.sum() / 4096) + 1
    assert packing.pack(none, tokenizer_path()).count() == 0


def test_packing_in_many_groups(spark):
    """Groups bounded in bins and in members still end near the least number of sequences."""
    rows = [(i, sentence(i, 3 + i % 40), None, None, 0) for i in range(600)] + [(1000 + i, "", None, None, 0) for i in range(300)]
    out = packing.pack(docs(spark, rows).repartition(8), tokenizer_path(), seq_len=200, group_bins=20, group_members=300, hold=30).toPandas()
    assert len(out) == len(rows) and out.groupby("sequence_id").length.sum().max() <= 200
    assert out.sequence_id.nunique() <= 1.03 * math.ceil(out.length.sum() / 200) + 1


def test_best_fit():
    bins = packing.best_fit([7, 5, 5, 3], 10)
    assert sorted(sum([7, 5, 5, 3][i] for i in b) for b in bins) == [10, 10]
    assert packing.best_fit([], 10) == []


def test_encoder_equals_the_tokenizer():
    e = packing.Encoder(tokenizer_path(), most=50)
    for t in ("a.b, c.. d., 'S it's I'LL <|endoftext|> <|ENDOFTEXT|> x", "É. ÀÉ, ß. İ. x́. 1. 22, \x1c a\x1cb \xa0z.  q.", " ", "A.\n.B,", sentence(1, 500), "漢字。 가나다, ١٢"):
        assert np.asarray(e.tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes() == e(t) == e(t)


# ---------------------------------------------------------------- PU learning


def test_nnpu_learns_a_rare_mark():
    rng = np.random.default_rng(0)
    p = [[0, 1 + int(x)] for x in rng.integers(0, 5, 200)]
    u = [[1 + int(x)] + [0] * (i % 5 == 0) for i, x in enumerate(rng.integers(0, 5, 1000))]
    w, b = nnpu.minimise(p, u, 6, 0.2, 500)
    assert w[0] + b + w[1:].max() > 0 > b + w[1:].max()


@pytest.mark.parametrize("op,label,modulus,rest", [(quality.fit_quality, "quality", 3, 1), (toxicity.fit_toxicity, "toxic", 5, 0)])
def test_classifiers(spark, data, odd, none, op, label, modulus, rest):
    d, labels = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet")
    score = quality.score_quality if label == "quality" else toxicity.score_toxicity
    model = op(d, labels, lambda k: fold(k, modulus) != rest)
    out = score(odd, model, ["doc_id"]).collect()
    assert len(out) == N and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in out)
    assert score(none, model, ["doc_id"]).count() == 0
    bare = op(odd, labels.where("doc_id < 0"), lambda k: fold(k, modulus) != rest)
    assert score(odd, bare, ["doc_id"]).select("score").distinct().count() == 1


def auc(truth: np.ndarray, score: np.ndarray) -> float:
    rank = score.argsort().argsort() + 1.0
    for s in np.unique(score):
        rank[score == s] = rank[score == s].mean()
    n = truth.sum()
    return (rank[truth].sum() - n * (n + 1) / 2) / (n * (len(truth) - n))


@pytest.mark.parametrize("op,label,modulus,rest,least", [(quality.fit_quality, "quality", 3, 1, 0.97), (toxicity.fit_toxicity, "toxic", 5, 0, 0.8)])
def test_classifiers_on_held_out_labels(spark, op, label, modulus, rest, least):
    """Labels equal to 0 are used nowhere: without them the model is the same."""
    data = "/root/testdata/sf0.01"
    d, labels = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet")
    score = quality.score_quality if label == "quality" else toxicity.score_toxicity
    model = op(d, labels, lambda k: fold(k, modulus) != rest)
    out = score(d, model, ["doc_id"]).join(labels, "doc_id").where(fold("doc_id", modulus) == rest).toPandas()
    assert auc((out[label] == 1).to_numpy(), out.score.to_numpy()) > least
    assert (out.predicted == out[label]).mean() > 0.9
    bare = op(d, labels.where(F.col(label) == 1), lambda k: fold(k, modulus) != rest)
    assert bare.prior == model.prior and np.array_equal(bare.weights, model.weights)


def test_class_prior_from_positives_and_unlabelled():
    rng = np.random.default_rng(2)
    draw = lambda good: [[int(x), 10 + int(y)] for x, y in zip(rng.integers(0, 6 if good else 10, 400), rng.integers(0, 5, 400))]
    good, bad = [draw(True) for _ in range(4)], [draw(False) for _ in range(6)]
    flat = lambda x: [r for s in x for r in s]
    for share in (0.2, 0.5):
        n_good = int(1600 * share)
        u = flat(good)[:n_good] + [[6 + i % 4, 10 + i % 5] for i in range(1600 - n_good)]
        order = rng.permutation(len(u))
        got = nnpu.estimate_prior(flat(good), [u[i] for i in order], 15)
        assert abs(got - share) < 0.08
    assert 0 < len(flat(bad))


# ---------------------------------------------------------------- mixing


def water(sizes: dict, weights: dict) -> dict:
    total, out, open_ = sum(sizes.values()), {}, set(sizes)
    while True:
        level = (total - sum(out.values())) / max(1e-300, sum(weights[s] for s in open_))
        over = {s for s in open_ if level * weights[s] > 3 * sizes[s] * (1 + 1e-12)}
        if not over:
            return out | {s: level * weights[s] for s in open_}
        out |= {s: 3.0 * sizes[s] for s in over}
        open_ -= over


def test_mix_targets_and_reruns(spark, odd, none):
    rows = mixing.mix(odd, block_words=50, shard_blocks=4, bucket_rows=3).taken().toPandas()
    assert len(rows) == N
    sizes = Counter()
    for _, t, _, s, _ in odd_rows():
        sizes[(s is None, s or "")] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    weights = {s: 1 + i % 3 for i, s in enumerate(sorted(sizes))}
    want = water(sizes, weights)
    for s in sizes:
        mine = rows[rows.source.isna()] if s[0] else rows[rows.source == s[1]]
        assert abs(mine.target.iloc[0] - want[s]) < 1e-6 and abs(mine.taken.sum() - want[s]) <= 1 and mine.source_size.iloc[0] == sizes[s]
    assert (rows.taken <= 3 * rows["size"]).all()
    again = mixing.mix(odd, block_words=50, shard_blocks=4, bucket_rows=3).taken().toPandas()
    assert sorted(zip(rows.doc_id.fillna(-1), rows.taken)) == sorted(zip(again.doc_id.fillna(-1), again.taken))
    assert mixing.mix(none).taken().count() == 0


def test_mix_shards_are_exact_and_disjoint(spark, odd):
    m = mixing.mix(odd, block_words=50, shard_blocks=4, bucket_rows=3)
    leaves = m.leaves.toPandas()
    per = leaves.groupby("shard").blocks.sum().sort_index()
    assert (per[:-1] == 4).all() and per.iloc[-1] <= 4
    for _, g in leaves.groupby("sid"):
        spans = sorted(zip(g["first"], g.blocks))
        assert all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:])) and spans[0][0] == 0
    assert m.segments().agg(F.sum("length")).first()[0] == m.taken().agg(F.sum("taken")).first()[0]


def test_mix_is_read_off_the_leaves(spark, odd):
    m = mixing.mix(odd, block_words=50, shard_blocks=4, bucket_rows=3)
    rows = m.taken().toPandas()
    assert m.leaves.select("shard").distinct().count() > 1 and rows.shard.nunique() > 1
    lost = m.leaves.where("shard = 1").agg(F.sum("blocks")).first()[0]
    less = mixing.Mix(m.rows, m.leaves.where("shard <> 1"), m.block_words, m.seed).taken().toPandas()
    gone = rows.taken.sum() - less.taken.sum()
    assert 0 < gone <= 50 * lost and (less.shard.dropna() != 1).all()
    # Each source's drawn blocks are all of its blocks, each once.
    drawn = m.drawn().toPandas()
    for sid, g in drawn.groupby("sid"):
        assert sorted(g.block) == list(range(len(g)))
    # A segment's words are a run of the row's text, and no word of a pass is taken twice.
    seg = m.segments().toPandas().sort_values(["row", "pass", "start"])
    for _, g in seg.groupby(["row", "pass"]):
        assert list(g.start[1:]) == list((g.start + g.length)[:-1])


@pytest.mark.parametrize("n", [1, 2, 3, 97, 1000])
def test_permuted_is_a_bijection(spark, n):
    got = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"))).collect()
    assert sorted(r[0] for r in got) == list(range(n))


def test_hypergeometric_law(spark):
    u = (F.col("id") + 0.5) / 4000
    got = Counter(r[0] for r in spark.range(4000).select(mixing.hypergeometric(F.lit(7), F.lit(12), F.lit(5), u)).collect())
    for x in range(6):
        want = math.comb(7, x) * math.comb(12, 5 - x) / math.comb(19, 5)
        assert abs(got[x] / 4000 - want) < 1e-3
    big = spark.range(400).select(mixing.hypergeometric(F.lit(30000), F.lit(90000), F.lit(20000), (F.col("id") + 0.5) / 400).alias("x")).agg(F.avg("x"), F.stddev("x")).first()
    assert abs(big[0] - 5000) < 1 and abs(big[1] - 55.9) < 2


# ---------------------------------------------------------------- near duplicates


def brute(rows, w, num, den):
    sets = [(d, frozenset(tuple(x[k : k + w]) for k in range(max(1, len(x) - w + 1))) if (x := re.findall(rb"[^\x20\x09-\x0d]+", (t or "").encode().lower())) else frozenset()) for d, t in rows]
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            a, b = sets[i][1], sets[j][1]
            if a and b and den * len(a & b) >= num * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (d, s) in enumerate(sets):
        if s and d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(s), least.get(find(i)) if s else d) for i, (d, s) in enumerate(sets)), key=str)


@pytest.mark.parametrize("w,num", [(3, 85), (5, 80)])
def test_near_duplicates(spark, odd, w, num):
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in near_dup.near_duplicates(odd, w, num, 100).collect()), key=str)
    assert got == brute([(d, t) for d, t, *_ in odd_rows()], w, num, 100)


def test_near_duplicate_chain_and_crowd(spark, none):
    base = sentence(1, 300).split()
    rows = [(i, " ".join(x if (k * 7 + i) % 60 else f"w{i}" for k, x in enumerate(base)), None, None, 0) for i in range(40)]
    rows += [(100 + i, sentence(500 + i, 30) + " " + sentence(1, 60), None, None, 0) for i in range(30)]
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in near_dup.near_duplicates(docs(spark, rows), 3, 85, 100).collect()), key=str)
    assert got == brute([(d, t) for d, t, *_ in rows], 3, 85, 100)
    assert near_dup.near_duplicates(none).count() == 0


def test_sketch_estimates_jaccard():
    rng = np.random.default_rng(1)
    common = rng.integers(0, 1 << 63, 900, dtype=np.uint64)
    a, b = (np.unique(np.concatenate([common, rng.integers(0, 1 << 63, 100, dtype=np.uint64)])) for _ in range(2))
    mixed = [np.unique(near_dup._mix(x)) for x in (a, b)]
    est = near_dup.estimate(near_dup.sketch(mixed[0])[None], near_dup.sketch(mixed[1])[None], np.array([len(a)]), np.array([len(b)]))[0]
    assert abs(est - 900 / 1100) < 0.1


# ---------------------------------------------------------------- language model


def test_language_model(spark, odd, none):
    model = context_mix.fit(odd, fold("doc_id", 7) != 2, heavy=20)
    out = context_mix.score(odd, model, held_out("doc_id", 7, 2)).collect()
    words = lambda t: [*re.findall(rb"[^\x20\x09-\x0d]+", (t or "").encode().lower()), b"\n"]
    train = Counter()
    for d, t, *_ in odd_rows():
        if d is not None and zlib.crc32(str(d).encode()) % 7 != 2:
            train.update(words(t))
    n, v = sum(train.values()), len(train)
    want = sorted((len(words(t)), sum(train[w] > 0 for w in words(t)), round(sum(math.log10((train[w] + 1) / (n + v + 1)) for w in words(t)), 4)) for _, t, *_ in odd_rows())
    assert sorted((r["n_tokens"], r["n_known"], round(r["base_score"], 4)) for r in out) == want
    assert all(r["score"] < 0 and r["train_tokens"] == n for r in out)
    # Looking prices up and joining them is the same, whatever is kept as heavy.
    again = context_mix.score(odd, context_mix.fit(odd, fold("doc_id", 7) != 2, heavy=100_000), held_out("doc_id", 7, 2)).collect()
    key = lambda r: (r["n_tokens"], round(r["score"], 3))
    assert sorted(map(key, out)) == sorted(map(key, again))
    assert context_mix.score(none, model, held_out("doc_id", 7, 2)).count() == 0
    assert context_mix.score(odd, context_mix.fit(odd, F.lit(False)), F.lit(False)).count() == N


def small_model(texts):
    """Head and rest models of a few texts, as ``fit`` makes them, on one machine."""
    known = context_mix.Vocabulary({b"the": 1, b"le": 2})
    t = context_mix.Texts(texts, known)
    count = np.bincount(t.first, minlength=256).reshape(1, -1).astype(float)
    head_code, tables, head = context_mix.Code(count), context_mix.empty_tables(context_mix.HEAD_BITS), context_mix.Mixer(3)
    context_mix.learn_heads(t, head_code, tables, head)
    pairs = Counter(zip(t.state.tolist(), [known.words[i] for i in t.ids]))
    state, token, c = np.array([s for s, _ in pairs]), [w for _, w in pairs], np.array(list(pairs.values()), np.float32)
    r = context_mix.Rests(token, state, np.full(len(token), 4))
    count = np.zeros((256, 256))
    np.add.at(count, (r.before, r.symbol), c[r.token])
    code = context_mix.Code(count)
    fixed = context_mix.empty_tables(context_mix.REST_BITS)
    for at, node, bit in code.steps(r.before, r.symbol):
        for a, x, size in zip(fixed, r.contexts, context_mix.REST_BITS):
            np.add.at(a.reshape(-1), context_mix.slot(x[at], node, size) + bit.astype(np.int64) * a.shape[1], c[r.token[at]])
    own = context_mix.Beginnings(10_000)
    own.add(r, code, c.astype(np.float32))
    m = context_mix.Mixer(5)
    for at, node, bit in code.steps(r.before, r.symbol):
        m.adjust(*context_mix.rest_odds(r, at, node, bit, fixed, own, np.ones(len(token), np.float32)), bit, (c / c.sum())[r.token[at]], len(token))
    return known, (head_code, tables, head), (code, fixed, own, m)


TEXTS = [b"the cat saw the dog and the cat ran", b"le chat voit le chien et le chat court", b"", None, b"the cattle saw a catapult"]


def test_probabilities_sum_to_one():
    """Of all bytes that may come first, and of all that may come next in a token."""
    known, (head_code, tables, head), (code, fixed, own, m) = small_model(TEXTS)
    prices = context_mix.Prices(tables, context_mix.HEAD_BITS)
    for before in (b"", b"the", b"le chat", b"saw unknown"):
        total = 0.0
        for first in set(range(256)) - {9, 10, 11, 12, 13, 32, *range(65, 91)}:  # no token begins with these
            t = context_mix.Texts([before + b" " + bytes([first])], known)
            total += 2 ** context_mix.price_heads(t, head_code, prices, head)[-2]
        t = context_mix.Texts([before], known)
        total += 2 ** context_mix.price_heads(t, head_code, prices, head)[-1]  # the end
        assert 0.98 < total <= 1 + 1e-9
    for start in (b"c", b"cat", b"catap", b"x"):
        total = 0.0
        for nxt in range(256):
            r = context_mix.Rests([start + bytes([nxt])], np.array([1]), np.array([4]))
            upto = context_mix.Rests([start + bytes([nxt]) + b"q"], np.array([1]), np.array([4]))
            assert len(upto.symbol) == len(r.symbol) + 1
            p = 0.0
            for at, node, bit in code.steps(r.before, r.symbol):
                x, g1, g2 = context_mix.rest_odds(r, at, node, bit, fixed, own, np.zeros(1, np.float32))
                p += m.log2(x, g1, g2, bit)[r.place[at] == len(start)].sum()
            total += 2**p
        assert abs(total - 1) < 1e-3


def test_prices_by_brute_force():
    """Bits, counts and log-probabilities of whole texts, one at a time in plain Python."""
    known, (head_code, tables, head), (code, fixed, own, m) = small_model(TEXTS)
    prices = context_mix.Prices(tables, context_mix.HEAD_BITS)
    t = context_mix.Texts([TEXTS[0]], known)
    got = context_mix.price_heads(t, head_code, prices, head)
    states, two = [], [b"", b""]
    words, state = TEXTS[0].split() + [b"\n"], 0
    mask = (1 << 64) - 1

    def mixed(h):
        h = h * int(context_mix._A) & mask
        return h ^ h >> 31

    import xxhash

    def bits(row, symbol, table, contexts, sizes, model, gates):
        size, value, node, total = int(table.size[row, symbol]), int(table.code[row, symbol]), 1, 0.0
        for k in range(size - 1, -1, -1):
            bit = value >> k & 1
            x, sure = [], []
            for c, b, a in zip(contexts, sizes, tables):
                s = ((c ^ (node * int(context_mix._B) & mask)) * int(context_mix._A) & mask) >> (64 - b)
                zero, one = a[0][s], a[1][s]
                x.append(math.log(one + 0.02) - math.log(zero + 0.02))
                sure.append(min(13, int(math.floor(math.log2(zero + one))) + 1 if zero + one >= 1 else 0))
            g1, g2 = gates(sure)
            z = sum((model.w[0][g1][i] + model.w[1][g2][i]) * v for i, v in enumerate([*x, 0.3]))
            z = max(-16.0, min(16.0, z))
            place = (z + 16) * (context_mix.MAP_STEPS - 1) / 32
            low = min(int(place), context_mix.MAP_STEPS - 2)
            centre = lambda i: 1 / (1 + math.exp(16 - i * 32 / (context_mix.MAP_STEPS - 1)))
            row_ = g1 // context_mix.GATES
            refined = [(model.map[0][row_][i] + 20 * centre(i)) / (model.map[1][row_][i] + 20) for i in (low, low + 1)]
            p = 0.5 / (1 + math.exp(-z)) + 0.5 * (refined[0] * (1 - (place - low)) + refined[1] * (place - low))
            p = min(1 - 1e-7, max(1e-7, p))
            total += math.log2(p if bit else 1 - p)
            node = node * 2 + bit
        return total

    for k, w in enumerate(words):
        h = [xxhash.xxh64_intdigest(x, 42) if x else 0 for x in two]
        s = state + 1
        contexts = [mixed(c + int(z) & mask) for c, z in zip((s, h[0], mixed(h[0]) + h[1]), context_mix._SALT)]
        want = bits(0, w[0], head_code, contexts, context_mix.HEAD_BITS, head, lambda sure, s=state: (sure[2] * 14 + sure[1], s * 14 + sure[0]))
        assert abs(want - got[k]) < 1e-3
        states.append(state)
        state = known.groups.get(w, state)
        two = [w, two[0]]
    assert t.state.tolist() == states
    # A rest is priced the same with odds made beforehand.
    r = context_mix.Rests([b"cattle", b"the", b"zq"], np.array([1, 2, 0]), np.array([4, 4, 4]))
    got = context_mix.price_rests(r, code, context_mix.Prices(fixed, context_mix.REST_BITS), own, m, 3)
    want = np.zeros(3)
    for at, node, bit in code.steps(r.before, r.symbol):
        x, g1, g2 = context_mix.rest_odds(r, at, node, bit, fixed, own, np.zeros(3, np.float32))
        want += np.bincount(r.token[at], m.log2(x, g1, g2, bit), 3)
    assert np.allclose(got, want)


def test_order_of_words_matters(spark):
    """A shuffled text is less likely than the text, and word pairs are learned over the corpus."""
    rng = np.random.default_rng(0)
    rows = []
    for i in range(300):
        w = [x for k in rng.integers(0, 8, 40) for x in (f"{'abcdefgh'[k]}first{k}", f"{'hgfedcba'[k]}second{k}")]
        rows.append((i, " ".join(w), None, None, 0))
    rows += [(1000, rows[0][1], None, None, 0), (1001, " ".join(sorted(rows[0][1].split(), key=lambda x: zlib.crc32(x.encode()))), None, None, 0)]
    d = docs(spark, rows)
    out = {r["doc_id"]: r for r in context_mix.score(d, context_mix.fit(d, F.col("doc_id") < 300), F.lit(False)).collect()}
    assert out[1000]["score"] > out[1001]["score"] + 20 and abs(out[1000]["base_score"] - out[1001]["base_score"]) < 1e-6
    assert out[1000]["score"] > out[1000]["base_score"]


def test_pairs_that_begin_alike_are_dealt_deeper(spark):
    rows = [(0, w.encode(), 1, 1, 1) for w in [f"http{i}" for i in range(50)] + ["a", "abc"] + [f"http0000{i}" for i in range(30)]]
    d = context_mix._dealt(spark.createDataFrame(rows, "state int, token binary, c long, c_all long, c_token long"), 20).collect()
    by = {bytes(r["token"]): (r["depth"], bytes(r["deal"])) for r in d}
    assert by[b"a"] == (4, b"a") and by[b"http7"] == (8, b"http7") and by[b"http00001"][0] == 16
    assert len(by) == len({*by})

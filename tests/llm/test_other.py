"""Operators over conversations, media and vectors, and the pipeline."""

import io
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loomline.llm import chroma, graph, langid, near_dup, queries, quotes, topk

from .helpers import crowded, docs, odd_rows, sentence

MESSAGES = "conv_id long, turn long, role string, text string"


def test_quotes_nested_and_linked(spark):
    a, b = "First line here\nSecond thing", "An answer to it"
    rows = [
        (1, 0, "u", a),
        (1, 1, "a", f"> {a.splitlines()[0]}\n> Second   THING\n\n{b}"),
        (1, 2, "u", f"> > First line here\n> {b}\nThanks"),
        (2, 0, "u", ">> First line here\n> nobody said this\nHello"),
        (3, 0, "u", None),
        (4, 0, "u", ""),
        (None, 0, "u", "lost"),
        (5, None, "u", "> lost\nx"),
        (1, 0, "u", a),
        (6, 0, "u", "> ---\nrule"),
    ]
    out = {(r["conv_id"], r["turn"]): r for r in quotes.link(crowded(spark.createDataFrame(rows, MESSAGES))).collect()}
    assert len(out) == 9
    assert out[1, 0]["text"] == a and out[1, 1]["text"] == b and out[1, 2]["text"] == "Thanks"
    assert [(out[1, t]["reply_turn"], out[1, t]["depth"], out[1, t]["root_turn"]) for t in (0, 1, 2)] == [(None, 0, 0), (0, 1, 0), (1, 2, 0)]
    assert out[1, 2]["max_level"] == 2 and out[1, 2]["n_linked"] == 2
    assert (out[2, 0]["n_quoted"], out[2, 0]["n_linked"], out[2, 0]["reply_conv"]) == (2, 0, None)
    assert out[6, 0]["n_quoted"] == 0 and out[3, 0]["text"] == ""
    assert quotes.link(spark.createDataFrame([], MESSAGES)).count() == 0


def test_quotes_round_trip(spark, data):
    c = spark.read.parquet(f"{data}/conversations.parquet")
    j = quotes.link(quotes.as_mail(c)).join(c.select("conv_id", "turn", F.col("text").alias("said")), ["conv_id", "turn"])
    assert j.count() == c.count() == j.where("text = said and depth = turn").count()


def tone(notes: list[float], rate: int = 11025, seconds: float = 0.4) -> bytes:
    t = np.arange(int(rate * seconds)) / rate
    x = np.concatenate([np.sin(2 * np.pi * f * t) + 0.4 * np.sin(4 * np.pi * f * t) for f in notes])
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1), w.setsampwidth(2), w.setframerate(rate)
        w.writeframes((x / np.abs(x).max() * 20000).astype("<i2").tobytes())
    return out.getvalue()


def melody(seed: int, n: int = 40) -> list[float]:
    return [220 * 2 ** (int(k) / 12) for k in np.random.default_rng(seed).integers(0, 24, n)]


def test_chroma_aligns_recordings(spark):
    a = melody(1)
    rows = [(1, tone(a)), (2, tone(a[8:])), (3, tone(melody(2))), (4, tone(a)), (5, None), (6, b"not a wav"), (7, tone(a[:1])), (None, tone(melody(2)))]
    df = crowded(spark.createDataFrame(rows, "rec long, audio binary"))
    out = {r["id"]: r for r in chroma.group(chroma.fingerprints(df, "rec", "audio", "wav")).collect()}
    assert {i: out[i]["group_id"] for i in (1, 2, 3, 4, 5, 6, 7, None)} == {1: 1, 2: 1, 3: 3, 4: 1, 5: 5, 6: 6, 7: 7, None: 3}
    assert out[2]["link_id"] == 1 and out[2]["bit_error"] <= 0.15
    assert abs(abs(out[2]["offset"]) - 8 * 0.4 * 11025 / chroma.STEP) <= 2
    assert chroma.group(chroma.fingerprints(df.limit(0), "rec", "audio", "wav")).count() == 0


def test_integral_image_filters_by_brute_force():
    frames = np.random.default_rng(3).random((30, 12))
    image = frames / np.linalg.norm(frames, axis=1, keepdims=True)
    got = chroma.fingerprint(frames)
    assert len(got) == 30 - chroma.WIDEST + 1
    for at in (0, 7, len(got) - 1):
        for k, (shape, y, h, w) in enumerate(chroma.FILTERS):
            m = lambda f0, f1, c0, c1: image[at + f0 : at + f1, c0:c1].mean()  # noqa: B023, E731
            a, b = (
                (m(0, w, y, y + h // 2), m(0, w, 0, 12)),
                (m(0, w, y + h // 2, y + h), m(0, w, y, y + h // 2)),
                (m(w // 2, w, y, y + h), m(0, w // 2, y, y + h)),
                (m(0, w // 2, y + h // 2, y + h) + m(w // 2, w, y, y + h // 2), m(0, w // 2, y, y + h // 2) + m(w // 2, w, y + h // 2, y + h)),
                (m(0, w, y + h // 3, y + 2 * h // 3), m(0, w, y, y + h)),
                (m(w // 3, 2 * w // 3, y, y + h), m(0, w, y, y + h)),
            )[shape]
            level = int(np.searchsorted(chroma.THRESHOLDS, np.log((0.01 + a) / (0.01 + b))))
            assert (int(got[at]) >> (2 * k)) & 3 == level ^ (level >> 1)


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


@pytest.mark.parametrize("spread", [0.0, 2.0])
def test_top_k_equals_brute_force(spark, spread):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(600, 8)) * np.exp(spread * rng.normal(size=(600, 1)))
    x[100:140] = x[100]
    rows = [(i, [float(v) for v in r], 0) for i, r in enumerate(np.float32(x))]
    rows += [(1000, None, 0), (1050, [float("nan")] * 8, 0), (1100, [None] * 8, 0), (None, [1.0] * 8, 0), (1150, [1.0, 2.0], 0), (1200, [], 0), (3, rows[3][1], 0)]
    out = topk.top_k(topk.whole(crowded(vectors(spark, rows))), F.col("id") % 50 == 0, 5, bucket_rows=64, block_rows=8).toPandas()
    q = np.floor(256.0 * np.array([r[1] for r in rows[:600]], np.float32).astype(float)).astype(int)
    q, ids = np.vstack([q, q[3]]), np.append(np.arange(600), 3)
    for i in range(0, 600, 50):
        s = q @ q[i]
        keep = ids != i
        order = np.lexsort((ids[keep], -s[keep]))[:5]
        g = out[out.query_id == i].sort_values("rank")
        assert list(g.vec_id) == list(ids[keep][order]) and list(g.score) == list(s[keep][order])
    assert set(out.query_id) == set(range(0, 600, 50))
    assert topk.top_k(topk.whole(vectors(spark, [])), F.col("id") % 50 == 0).count() == 0


def test_components(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(50, 51), (51, 52), (60, 60)], "a long, b long")
    got = {r["node"]: r["root"] for r in graph.components(e).collect()}
    assert got == {i: 0 for i in range(1, 31)} | {51: 50, 52: 50}
    assert graph.components(e.limit(0)).count() == 0


def test_pipeline_stages(spark):
    data = "/root/testdata/sf0.01"  # 200 documents are too few to learn quality from
    d = spark.read.parquet(f"{data}/documents.parquet")
    left, stages = {r["doc_id"]: r for r in d.collect()}, dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_classifier", "language_id", "minhash_near_dedup", "mix_to_weights", "best_fit_packing"]
    junk = {r["doc_id"] for r in spark.read.parquet(f"{data}/labels.parquet").where("quality = 0").collect()}
    good = {r["doc_id"] for r in spark.read.parquet(f"{data}/labels.parquet").where("quality = 1").collect()}
    a = stages["quality_classifier"](spark, d, data)
    kept = {r["doc_id"] for r in a.collect()}
    assert a.columns == d.columns and len(good & kept) >= 0.97 * len(good) and len(junk & kept) <= 0.3 * len(junk)
    b = stages["language_id"](spark, a, data)
    assert b.columns == d.columns and b.count() >= 0.99 * len(kept)
    c = stages["minhash_near_dedup"](spark, b, data)
    found = near_dup.near_duplicates(b, 5, 80, 100)
    assert {r["doc_id"] for r in c.collect()} == {r["component_id"] for r in found.collect()}
    m = stages["mix_to_weights"](spark, c, data)
    counts = m.groupBy("doc_id").count().collect()
    assert m.columns == d.columns and max(r["count"] for r in counts) <= 3 and all(left[r["doc_id"]]["text"] == r["text"] for r in m.collect())
    p = stages["best_fit_packing"](spark, m, data)
    assert p.select("sequence_id").distinct().count() > 0 and p.where("piece = 0").count() == m.count()


def test_pipeline_takes_odd_rows(spark, data):
    d = docs(spark)
    for _, stage in corpus_pipeline.STAGES:
        d = stage(spark, d, data)
    assert d.count() > 0
    d = docs(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        d = stage(spark, d, data)
    assert d.count() == 0


def test_language_stage_drops_what_has_no_letters(spark, data):
    rows = [(1, sentence(1, 50), "en", "s", 1), (2, "12 !! ??", "en", "s", 1), (3, None, "en", "s", 1)]
    assert [r["doc_id"] for r in corpus_pipeline.keep_language(spark, docs(spark, rows), data).collect()] == [1]
    assert langid.learn(docs(spark, rows))["en"] and len(odd_rows()) > 3


def test_parts_of_whole_tokens():
    """Words joined by punctuation are all read, and marks are told apart beyond twelve characters."""
    from loomline.llm import nnpu

    words = [f"word{chr(97 + i)}" for i in range(20)]
    assert set(nnpu.word_parts(",".join(words))) == {x for w in words for x in nnpu.word_parts(w)}
    assert nnpu.mark_parts("-" * 12 + "!") != nnpu.mark_parts("-" * 12 + "?")


def test_quotes_keep_every_message(spark):
    """Messages without a thread or number, and different ones of one number, are all kept and quoted."""
    rows = [(None, 1, "alpha one"), (None, 1, "beta two"), (None, 1, "beta two"), (3, None, "gamma"), (3, None, "delta")]
    rows += [(1, 1, "first branch"), (1, 1, "second branch"), (1, 1, "second branch"), (1, 2, "> second branch\n\nyes"), (1, 2, "> first branch\n\nno")]
    d = spark.createDataFrame(rows, "conv_id long, turn long, text string")
    got = quotes.link(d).collect()
    assert sorted(r["text"] for r in got) == sorted(["alpha one", "beta two", "beta two", "gamma", "delta", "first branch", "second branch", "yes", "no"])
    assert {r["text"]: r["n_linked"] for r in got if r["turn"] == 2} == {"yes": 1, "no": 1}
    assert quotes.as_mail(d).count() == len(rows)


def test_rewrapped_and_cut_quotes(spark):
    """A quote that was wrapped anew is found as a passage; one that was cut short by its lines; a common line elsewhere is no source."""
    said = "The first sentence of a long message that goes on\nfor several lines before it comes to its end.\n\nA second paragraph stands here.\nThanks"
    wrapped = "> The first sentence of a\n> long message that goes on for several lines\n> before it comes to its end.\n\nI see."
    rows = [
        (1, 0, "Thanks"),
        (2, 0, said),
        (2, 1, "Another message in between, of no matter."),
        (2, 2, wrapped),
        (2, 3, "> A second paragraph stands here.\n> (rest cut)\n\nRight."),
        (3, 0, "> Thanks\n\nFor what?"),
        (3, 1, wrapped.replace("I see.", "Seen elsewhere.")),
    ]
    out = {(r["conv_id"], r["turn"]): r for r in quotes.link(spark.createDataFrame(rows, "conv_id long, turn long, text string")).collect()}
    assert (out[2, 2]["reply_conv"], out[2, 2]["reply_turn"], out[2, 2]["n_linked"], out[2, 2]["text"]) == (2, 0, 1, "I see.")
    assert (out[2, 3]["reply_turn"], out[2, 3]["n_quoted"], out[2, 3]["n_linked"]) == (0, 1, 1)
    assert out[3, 0]["reply_conv"] is None and out[3, 0]["n_quoted"] == 1
    assert (out[3, 1]["reply_conv"], out[3, 1]["root_turn"], out[3, 1]["depth"]) == (2, 0, 1)


@pytest.fixture(scope="module")
def duck(data):
    import duckdb

    con = duckdb.connect()
    for t in "documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, data, duck, name):
    """Every query runs on the tables as it stands and equals its SQL where it has one."""
    df = queries.QUERIES[name](spark, data)
    columns = sorted(df.columns)
    text = lambda v: "\0" if v is None else f"{v:.9g}" if isinstance(v, float) else str(v)
    got = sorted(tuple(text(r[c]) for c in columns) for r in df.collect())
    assert got
    if name in queries.ORACLES:
        cur = duck.execute(queries.ORACLES[name])
        names = [d[0] for d in cur.description]
        assert sorted(names) == columns
        assert got == sorted(tuple(text(x[names.index(c)]) for c in columns) for x in cur.fetchall())


def test_chroma_recall_against_brute_force(spark):
    """Noisy copies, copies that start inside a frame step, and cuts: found as by aligning all pairs; silence pairs nothing."""
    rng = np.random.default_rng(3)

    def raw(x):
        out = io.BytesIO()
        with wave.open(out, "wb") as w:
            w.setnchannels(1), w.setsampwidth(2), w.setframerate(11025)
            w.writeframes((x / max(1e-9, np.abs(x).max()) * 20000).astype("<i2").tobytes())
        return out.getvalue()

    sound, rows, prints = {}, [], {}
    for k in range(12):
        t = np.arange(4410) / 11025
        sound[k] = np.concatenate([np.sin(2 * np.pi * f * t) + 0.4 * np.sin(4 * np.pi * f * t) for f in melody(100 + k, 20)])
        x = sound[k]
        for i, y in enumerate((x, x + rng.normal(0, 0.3, len(x)), x[300:], x[600:], x[1000:] + rng.normal(0, 0.1, len(x) - 1000), x[9000 : int(0.8 * len(x))])):
            rows.append((10 * k + i, raw(y)))
    rows += [(500 + i, raw(np.zeros(60_000 + 1000 * i))) for i in range(5)]
    rows += [(600 + i, raw(np.sin(2 * np.pi * 440 * np.arange(60_000 + 1000 * i) / 11025))) for i in range(5)]
    for i, data in rows[:72]:
        prints[i] = chroma.fingerprint(chroma.frames_of_wav(data))

    def best(a, b):
        e = 1.0
        for offset in range(16 - len(b), len(a) - 15):
            x, y = a[max(0, offset) :], b[max(0, -offset) :]
            m = min(len(x), len(y))
            if m >= 16:
                e = min(e, float(np.bitwise_count(x[:m] ^ y[:m]).sum() / (32 * m)))
        return e

    out = {r["id"]: r for r in chroma.group(chroma.fingerprints(spark.createDataFrame(rows, "id long, audio binary"), "id", "audio", "wav")).collect()}
    linked = [(i, j) for i in prints for j in prints if i < j and best(prints[i], prints[j]) <= 0.15]
    assert len(linked) > 100
    assert sum(out[i]["group_id"] == out[j]["group_id"] for i, j in linked) >= 0.97 * len(linked)
    apart = [(i, j) for i in prints for j in prints if i // 10 != j // 10]
    assert not any(out[i]["group_id"] == out[j]["group_id"] for i, j in apart)
    assert all(chroma.pair_keys([chroma.fingerprint(chroma.frames_of_wav(d))]).size == 0 for i, d in rows if 500 <= i < 600)
    for i, j in linked:
        e = chroma.align(prints[i], prints[j])
        assert e and abs(e[1] - best(prints[i], prints[j])) < 0.02


def test_pipeline_keeps_clashing_columns(spark, data):
    d = crowded(docs(spark)).withColumns({c: F.lit("clash") for c in ("_kept", "_c0", "_row", "shard", "rank", "at", "f", "lang_pred", "distance", "predicted")})
    names = d.columns
    for name, stage in corpus_pipeline.STAGES:
        d = stage(spark, d, data)
        if name != "best_fit_packing":
            assert d.columns == names and d.where("_kept <> 'clash' or score <> 'clash'").count() == 0
    assert d.count() > 0
    # Repeated rows with one id, or none, count once after deduplication.
    twice = docs(spark).unionByName(docs(spark))
    left = corpus_pipeline.drop_near_duplicates(spark, twice, data)
    assert left.where("doc_id is not null").groupBy("doc_id").count().where("count > 1 and doc_id <> 7").count() == 0

import hashlib

import pytest
from pyspark.sql import functions as F

from loomline.operators import assembly, chunking, claims, graph, jobs, packing, research, revision, tasks
from loomline.sources import files, sinks
from loomline.streaming import streams


def whole_input(text, start, end, context, structure):
    parts = [("document-structure", "context-only", structure), ("context-prefix", "false", text[context:start]), ("primary-range", "true", text[start:end])]
    return "\n".join(f'<{tag} process="{p}">\n{body}\n</{tag}>' for tag, p, body in parts if body or tag == "primary-range")


def rebuilt(text, config=chunking.Config()):
    out = [(s, e, c, whole_input(text, s, e, c, structure)) for s, e, c, structure in chunking.chunks_of(text, config)]
    assert "".join(text[s:e] for s, e, _, _ in out) == text
    assert all(len(m.encode()) <= config.most for *_, m in out)
    assert all(a[1] == b[0] for a, b in zip(out, out[1:]))
    return out


def test_chunks_are_lossless():
    small = chunking.Config(256, 512, 64, 0.2)
    assert len(rebuilt("한국어 문장입니다. Emoji 🙂 here.\nNext line! " * 400, small)) > 40
    rebuilt("x" * 15_000)
    rebuilt("🙂" * 5_000, small)
    assert rebuilt("") == []
    out = rebuilt("# Top\n\n## Sub\n\n" + "Words follow here. " * 200)
    assert "# Top\n## Sub" in out[-1][3] and out[1][2] < out[1][0]


def test_chunk_budget_error():
    with pytest.raises(ValueError):
        list(chunking.chunks_of("x" * 100, chunking.Config(10, 20, 5, 0.1)))


def test_plan_of_hundred_chunks(spark):
    items = spark.range(100).select(F.lit("p").alias("g"), F.col("id").alias("o"), F.col("id").cast("string").alias("item"), F.lit(928).alias("size"))
    b = packing.next_fit(items, ["g"], "o", "item", "size", 2764, 8)
    assert b.count() == 50
    rounds = packing.reduce_rounds(b, ["g"], 640, 2560, 8).groupBy("round_ordinal").count().orderBy("round_ordinal").collect()
    assert [r["count"] for r in rounds] == [50, 17, 6, 2, 1]
    assert packing.too_large(items, "size", 900).count() == 100


def test_count_windows(spark):
    w = packing.count_windows(spark.range(72).withColumn("g", F.lit(1)), ["g"], ["id"], "id").groupBy("window_start").count().orderBy("window_start").collect()
    assert [(r["window_start"], r["count"]) for r in w] == [(0, 40), (32, 40), (64, 8)]


def test_bounded_bins(spark):
    b = spark.createDataFrame([(1, ["a", "b", "c"]), (1, ["c", "d"]), (1, ["e"])], "g int, members array<string>")
    got = sorted(sorted(r["members"]) for r in packing.bounded_bins(b, ["g"], 4).collect())
    assert got == [["a", "b", "c", "d"], ["e"]]


def first_fit(blocks, most):
    bins = []
    for b in sorted(map(sorted, blocks), key=lambda b: (-len(b), b)):
        for x in bins:
            if len(x | set(b)) <= most:
                x |= set(b)
                break
        else:
            bins.append(set(b))
    return [sorted(x) for x in bins]


def test_bounded_bins_by_brute_force(spark):
    import random

    for seed in range(30):
        r = random.Random(seed)
        blocks = [r.sample(range(80), r.randrange(1, 14)) for _ in range(200)]
        fit = packing.FirstFit(12)
        for b in sorted(map(sorted, blocks), key=lambda b: (-len(b), b)):
            fit.add(b)
        assert [sorted(x) for x in fit.bins] == first_fit(blocks, 12)
    rows = [(g, b) for g in (1, 2, None) for b in blocks]
    got = packing.bounded_bins(spark.createDataFrame(rows, "g int, members array<int>").repartition(4), ["g"], 12).collect()
    for g in (1, 2, None):
        assert [r["members"] for r in sorted((r for r in got if r["g"] == g), key=lambda r: r["bin"])] == first_fit(blocks, 12)


def test_candidate_batches(spark):
    rows = [("token", f"w{w}", 0, 100 * (w % 3) + m) for w in range(30) for m in range(w % 5, w % 5 + 3 + w % 4)]
    blocks = {}
    for _, w, _, i in rows:
        blocks.setdefault(w, set()).add(i)
    got = packing.candidate_batches(spark.createDataFrame(rows, "view string, block string, window_start int, id int"), 6).collect()
    want = [b for k in range(3) for b in first_fit({tuple(sorted(b)) for b in blocks.values() if min(b) // 100 == k}, 6)]
    assert sorted(r["members"] for r in got) == sorted(want)
    assert all(any(b <= set(r["members"]) for r in got) for b in blocks.values())


def test_next_fit_of_a_long_group(spark):
    sizes = [(i * 7919) % 97 for i in range(20_000)]
    items = spark.createDataFrame([("g", i, f"i{i}", s) for i, s in enumerate(sizes)] + [(None, 0, "x", 5000)], "g string, o int, item string, size int")
    got = {(r["g"], r["batch_ordinal"]): (r["item_ids"], r["input_tokens"]) for r in packing.next_fit(items, ["g"], "o", "item", "size", 300, 2).collect()}
    want, load = [[]], 0
    for i, s in enumerate(sizes):
        if want[-1] and load + 2 + s > 300:
            want.append([])
        load = load + 2 + s if want[-1] else s
        want[-1].append(i)
    assert got.pop((None, 0)) == (["x"], 5000)
    assert [got["g", k][0] for k in range(len(want))] == [[f"i{i}" for i in b] for b in want]
    assert all(got["g", k][1] == sum(sizes[i] for i in b) + 2 * (len(b) - 1) for k, b in enumerate(want))


def test_graph(spark):
    n = spark.range(8).select(F.col("id").alias("node"))
    e = spark.createDataFrame([(7, 6), (6, 5), (5, 4), (1, 2), (3, 3)], "a long, b long")
    assert {r["node"]: r["root"] for r in graph.components(n, e).collect()} == {0: 0, 1: 1, 2: 1, 3: 3, 4: 4, 5: 4, 6: 4, 7: 4}
    d = spark.createDataFrame([(1, 0), (2, 1), (5, 6), (6, 5)], "node long, needs long")
    done, held = graph.levels(n, d)
    assert {r["node"]: r["level"] for r in done.collect()} == {0: 0, 1: 1, 2: 2, 3: 0, 4: 0, 7: 0}
    assert sorted(r["node"] for r in held.collect()) == [5, 6]
    assert graph.stable_order(["c", "a", "b"], {"c": ["b"], "b": ["a"]}) == ["a", "b", "c"]
    with pytest.raises(ValueError):
        graph.stable_order(["a", "b"], {"a": ["b"], "b": ["a"]})


def test_collapse_rules(spark):
    rows = [
        ("EXACT_DUPLICATE", True, True, True, False, 1.0, True),
        ("EXACT_DUPLICATE", True, False, True, False, 1.0, False),
        ("SEMANTIC_EQUIVALENT", True, False, True, True, 0.0, True),
        ("SEMANTIC_EQUIVALENT", True, False, True, False, 0.2, False),
        ("SEMANTIC_EQUIVALENT", True, False, False, True, 0.9, False),
        ("SEMANTIC_EQUIVALENT", False, False, True, True, 0.9, False),
        ("CONFLICT", True, True, True, True, 1.0, False),
    ]
    df = spark.createDataFrame(rows, "label string, meta boolean, same boolean, terms boolean, has boolean, score double, want boolean")
    bad = df.where(claims.collapsible(F.col("label"), F.col("meta"), F.col("same"), F.col("terms"), F.col("has"), F.col("score")) != F.col("want"))
    assert bad.count() == 0


def test_pairs_of_oversized_blocks(spark):
    """400 claims share their long token: the token block is above the limit, yet neighbours meet."""
    rows = [(i, i % 7, "FACT", f"configuration {chr(97 + i // 26 % 26)}{chr(97 + i % 26)}{'z' * (i // 200)}") for i in range(400)] + [(1000, 8, "WARNING", "--- !!")]
    c = spark.createDataFrame(rows, "id long, path long, kind string, statement string")
    assert claims.candidate_pairs(claims.token_blocks(c.where("id < 200"), "id", "statement", most=160)).count() == 0
    got = {tuple(r) for r in claims.view_pairs(claims.views(c)).collect()}
    assert all(a < b for a, b in got)
    path = [i for i in range(400) if i % 7 == 3]
    assert all((a, b) in got for a in path[:40] for b in path[:40] if a < b)
    whole = sorted(rows, key=lambda r: (r[3], r[0]))
    for k in range(0, len(whole), 32):
        w = sorted(r[0] for r in whole[k : k + 40])
        assert all((a, b) in got for i, a in enumerate(w) for b in w[i + 1 :])
    ranks = packing.wide_windows(c.withColumn("g", F.lit(1)).repartition(5), ["g"], "id", "id").orderBy("rn").select("id", "rn").distinct()
    assert sorted(r["rn"] for r in ranks.collect()) == list(range(401))


def test_signature_is_the_minhash(spark):
    from loomline.functions import text

    d = spark.createDataFrame([("abcdefgh",), ("ab",), ("",), ("한국어 😀 text",)], "t string")
    want = F.array_join(F.transform(text.minhash(text.shingles(F.col("t"))), lambda x: F.substring(x, 1, 16)), "")
    assert all(a == b for a, b in d.select(F.lower(F.hex(text.signature("t"))), want).collect())


def test_ledger_merges_links(spark):
    rows = [("d1", "FACT", "Use port 80.", ["e1"]), ("d2", "FACT", "use PORT 80", ["e2"]), ("d3", "FACT", "The port to use is 80.", ["e3"]), ("d4", "FACT", "Else", ["e3"])]
    none = F.array().cast("array<string>")
    d = spark.createDataFrame(rows, "draft_id string, kind string, statement string, evidence_ids array<string>").withColumns({"preconditions": none, "commands": none, "warnings": none})
    links = spark.createDataFrame([("d1", "d3")], "a string, b string")
    got = {tuple(r["draft_ids"]): (r["statement"], r["evidence_ids"]) for r in claims.ledger(d, links).collect()}
    assert got == {("d1", "d2", "d3"): ("The port to use is 80.", ["e1", "e2", "e3"]), ("d4",): ("Else", ["e3"])}


def test_tasks(spark):
    owned = spark.createDataFrame([("t1", "c1"), ("t1", "c2"), ("t2", "c3")], "task_id string, claim_id string")
    rel = spark.createDataFrame([("c1", "c3"), ("c1", "c2")], "left_id string, right_id string")
    assert sorted(map(tuple, tasks.context_claims(owned, rel).select("task_id", "claim_id").collect())) == [("t1", "c3"), ("t2", "c1")]
    s = spark.range(16).select(F.lit("t").alias("task_id"), F.col("id").alias("pos"))
    assert tasks.shards(s).groupBy("shard").count().agg(F.max("count")).first()[0] < 8
    dep = spark.createDataFrame([("a", "b"), ("a", "c")], "node string, needs string")
    moved = spark.createDataFrame([("b", "a")], "old string, new string")
    assert [tuple(r) for r in tasks.rewritten_dependencies(dep, moved).collect()] == [("a", "c")]


def test_assembly(spark):
    s = spark.createDataFrame([("t", "See [evidence:E1] and [evidence:E9].")], "task_id string, markdown string")
    src = spark.createDataFrame([("E1", "a.md")], "evidence_id string, path string")
    out = assembly.expand_markers(s, ["task_id"], "markdown", src).first()["markdown"]
    assert out == "See [source:a.md] and [evidence:E9]."
    long = "This prose block is repeated and it is more than sixty characters long, really."
    d = spark.createDataFrame([(1, f"# H\n\n{long} [source:a]\n\n- {long}\n\n{long} [source:b]\n\n- {long}\n\nend [claim:C1]")], "k int, markdown string")
    b = assembly.polished_blocks(assembly.blocks(d, ["k"], "markdown"), ["k"])
    text = assembly.assembled(b, ["k"]).first()["markdown"]
    assert text.count(long) == 3 and "[source:a] [source:b]" in text and "[claim:" not in text


def test_revision_and_drift(spark):
    b = spark.createDataFrame([("a", 1, "x"), ("b", 1, "y"), ("c", 1, "z")], "relative_path string, byte_count long, sha256 string")
    a = spark.createDataFrame([("a", 1, "x"), ("b", 1, "q"), ("d", 1, "z")], "relative_path string, byte_count long, sha256 string")
    assert tuple(revision.counts(revision.compare(b, a)).first()) == (1, 1, 1, 1)
    assert revision.drift(b, b).count() == 0 and revision.drift(b, a).count() == 4


def test_jobs(spark):
    e = spark.createDataFrame([("j", 1, 0), ("j", 2, 10), ("j", 4, 5)], "job string, seq long, pct long")
    assert [r["violation"] for r in jobs.sequence_violations(e, "job", "seq", "pct").collect()] == ["SEQUENCE"]
    t = spark.createDataFrame([("j", 1, "CREATED"), ("j", 2, "FAILED"), ("j", 3, "CREATED"), ("j", 4, "PLANNING")], "job string, n long, state string")
    assert [r["ok"] for r in jobs.transitions(t, "job", ["n"], "state").orderBy("n").collect()] == [True, True, True, False]
    with pytest.raises(ValueError):
        jobs.recent(t, "n", "job", 0)


def test_model_input_is_native(spark):
    text = "# Top\n\n## Sub\n\n" + "Words follow here. " * 200
    d = spark.createDataFrame([("a.md", "r", "s", text), ("b.md", "q", "s", "Short")], "relative_path string, revision_id string, source_sha256 string, text string")
    got = [r["model_input"] for r in chunking.chunk(d).orderBy("relative_path", "ordinal").collect()]
    want = [whole_input(t, *x) for t in (text, "Short") for x in chunking.chunks_of(t)]
    assert got == want and len(got) > 4 and "## Sub" in got[2]


def test_qualified_literals(spark):
    rows = [("old-tool is legacy now", True), ("use old-tool", False), ("nothing", True), ("legacy old-tool. " + "x " * 300 + "old-tool", False)]
    df = spark.createDataFrame(rows, "t string, want boolean")
    assert df.where(research.qualified(F.col("t"), F.lit("old-tool"), ["legacy"]) != F.col("want")).count() == 0


def test_qualifiers_by_position_and_case(spark):
    rows = [
        ("Foo bar", "foo", ["required"], False),
        ("foo bar foo REQUIRED", "Foo", ["required"], True),
        ("this is not required here", "not required", ["required"], True),
        ("aaaa", "aa", ["b"], False),
        ("x" * 300 + "foo" + "y" * 238 + "ok", "foo", ["OK"], True),
        ("x" * 300 + "foo" + "y" * 239 + "ok", "foo", ["OK"], False),
        ("ok" + "y" * 238 + "foo", "foo", ["ok"], True),
        ("ok" + "y" * 239 + "foo", "foo", ["ok"], False),
        ("Maße", "MASSE", ["x"], False),
        ("foo", "foo", [], False),
        ("foo", "", [], True),
        ("a.b", "a+b", [], True),
    ]
    df = spark.createDataFrame([(i, t, n, q, w) for i, (t, n, q, w) in enumerate(rows)], "id int, t string, n string, q array<string>, want boolean")
    for i, (_, _, q, want) in enumerate(rows):
        assert df.where(F.col("id") == i).select(research.qualified(F.col("t"), F.col("n"), q)).first()[0] is want
    controls = df.select(F.col("id").alias("control_id"), F.col("n").alias("literal"), F.col("q").alias("qualifiers"))
    for most in (1 << 20, 200):
        got = research.unqualified_literals(df, "id", "t", controls, most_bytes=most).where("id = control_id")
        assert {(r["id"], r["literal"], r["failures"]) for r in got.collect()} == {(i, n, t.lower().replace("ß", "ss").count(n.lower())) for i, (t, n, _, w) in enumerate(rows) if not w}


def test_literal_hits_read_a_text_once(spark):
    import time

    long = spark.createDataFrame([(i, "ab -- " * 30_000 + "+end+") for i in range(4)], "id int, t string")
    lit = spark.createDataFrame([(1, "--"), (2, "+END+"), (3, "no"), (4, ""), (5, "b -- a"), (5, "+E")], "item_id int, literal string")
    research.literal_hits(long.limit(1), "id", "t", lit).collect()
    began = time.time()
    got = research.literal_hits(long, "id", "t", lit, most_bytes=200).collect()
    assert {tuple(r) for r in got} == {(i, k) for i in range(4) for k in (1, 2, 5)}
    assert time.time() - began < 30


def test_sources_and_sinks(spark, tmp_path):
    root = tmp_path / "in"
    (root / "sub").mkdir(parents=True)
    (root / "a.md").write_text("hello")
    (root / "sub/b.txt").write_bytes(b"\xff\xfe bad")
    (root / "c.bin").write_bytes(b"1")
    d = {r["relative_path"]: r for r in files.text_documents(spark, str(root)).collect()}
    assert set(d) == {"a.md", "sub/b.txt"} and d["sub/b.txt"]["error"] == "SOURCE_NOT_UTF8"
    assert d["a.md"]["source_sha256"] == hashlib.sha256(b"hello").hexdigest()
    assert {r["relative_path"] for r in files.inventory(spark, str(root)).collect()} == {"a.md", "sub/b.txt", "c.bin"}
    df, out = spark.range(5), str(tmp_path / "out")
    assert sinks.write_or_verify(df, out) and not sinks.write_or_verify(df, out)
    with pytest.raises(sinks.Conflict):
        sinks.write_or_verify(spark.range(6), out)
    assert files.layered_settings({"a": {"x": 1, "y": 2}}, {"a": {"y": 3}}) == {"a": {"x": 1, "y": 3}}
    raw = spark.createDataFrame([('{"a":1,"c":2}',)], "raw string")
    assert raw.select(files.unexpected_fields("raw", ["a", "b"])).first()[0] == ["c", "b"]


def test_stream_equals_batch(spark, data, tmp_path):
    src = spark.read.parquet(f"{data}/events.parquet")
    folder = str(tmp_path / "events")
    src.repartition(3).write.parquet(folder)
    live = spark.readStream.schema(src.schema).parquet(folder)
    streams.run_available(live, str(tmp_path / "o"), str(tmp_path / "c"))
    assert not sinks.differs(src, spark.read.schema(src.schema).parquet(str(tmp_path / "o")))


def test_once_per_key(spark, tmp_path):
    put = sinks.once_per_key(str(tmp_path / "x"), "id")
    for batch, n in ((0, 3), (1, 5), (1, 5)):
        put(spark.range(n), batch)
    assert spark.read.parquet(str(tmp_path / "x")).count() == 5


def test_coalesced_splits_long_pieces(spark):
    d = spark.createDataFrame([(1, 1, "a" * 100), (1, 2, None), (1, 3, "b" * 5000), (1, 4, "c\n"), (1, 5, "d")], "g int, o int, t string")
    got = [r["piece"] for r in streams.coalesced(d, ["g"], "o", "t").orderBy("ordinal").collect()]
    assert got == ["a" * 100 + "b" * 3996, "b" * 1004, "c\n", "d"]


def test_coalesced_keeps_whole_messages(spark, data):
    from loomline.plans import catalogue

    c = spark.read.parquet(f"{data}/conversations.parquet")
    want, got = {}, {}
    for r in c.orderBy("conv_id", "turn").collect():
        want[r["conv_id"]] = want.get(r["conv_id"], "") + (r["text"] or "")
    for r in catalogue.message_coalesce(spark, data).orderBy("conv_id", "ordinal").collect():
        got[r["conv_id"]] = got.get(r["conv_id"], "") + r["piece"]
    assert got == {k: v for k, v in want.items() if v}

"""Plans and their execution, the job store, workspaces and connectors."""

import hashlib
import json
import threading
import time

import pytest
from pyspark.sql import functions as F

from loomline.operators import assembly, claims, execution, jobs, research, store, tasks
from loomline.sources import connectors, files, workspace
from loomline.sources.sinks import Conflict


def test_attempts_and_resume(spark):
    plan = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "task_id string, position long")
    outs = spark.createDataFrame([("a", 1), ("a", 2)], "task_id string, attempt long")
    reps = spark.createDataFrame([("a", 1, False), ("a", 2, False)], "task_id string, attempt long, valid boolean")
    assert execution.attempt_errors(outs, reps).count() == 0
    assert {r["violation"] for r in execution.attempt_errors(outs.unionByName(spark.createDataFrame([("b", 2)], outs.schema)), reps).collect()} == {"UNPAIRED", "GAP"}
    assert {r["task_id"]: r["next_attempt"] for r in execution.resume(plan, outs, reps).collect()} == {"a": None, "b": 1, "c": 1}
    assert [r["task_id"] for r in execution.loaded(plan, outs, reps).collect()] == ["a"]
    calls = []

    def generate(t):
        calls.append(sorted((r["task_id"], r["attempt"]) for r in t.collect()))
        return t.select("task_id", "attempt")

    good = lambda o: o.withColumn("valid", (F.col("task_id") == "b") | (F.col("attempt") == 2))
    o, v, complete = execution.run_plan(plan, outs, reps, generate, good)
    assert calls == [[("b", 1), ("c", 1)], [("c", 2)]] and not complete  # a's old report stays
    assert o.count() == 5 and v.count() == 5
    assert execution.run_plan(plan, outs.limit(0), reps.limit(0), generate, good)[2]
    bad = lambda o: o.withColumn("valid", F.lit(False))
    assert execution.run_plan(plan, outs.limit(0), reps.limit(0), generate, bad)[1].count() == 9


def test_repair_once(spark):
    requests = spark.createDataFrame([(1, "x"), (2, "bad"), (3, "worse")], "id int, ask string")
    answer = F.when(F.col("feedback").isNull(), F.col("ask")).when(F.col("ask") == "bad", F.lit("mended")).otherwise(F.col("feedback"))
    good, lost = execution.with_repair(requests, lambda r: r.select("id", answer.alias("answer")), lambda a: a.where("answer in ('x', 'mended')"), "id")
    assert sorted(tuple(r) for r in good.collect()) == [(1, "x"), (2, "mended")] and [r["id"] for r in lost.collect()] == [3]


def test_integrate_map_and_reduce(spark):
    chunks = spark.range(7).select(F.lit("g").alias("g"), F.col("id").alias("ordinal"), F.col("id").cast("string").alias("chunk_id"), F.lit(10).alias("model_token_count"), F.concat(F.lit("t"), F.col("id")).alias("text"))
    port = lambda mark: lambda p: p.select("result_id", F.concat(F.lit(mark), F.array_join("parts", "+"), F.lit(")")).alias("text"))
    out = execution.integrate(chunks, ["g"], port("m("), port("r("), 20, 10).first()
    assert out["text"] == "r(r(m(t0+t1)+m(t2+t3))+r(m(t4+t5)+m(t6)))" and out["generations"] == 4 + 2 + 1
    with pytest.raises(ValueError):
        execution.integrate(chunks, ["g"], port("m("), port("r("), 20, 20)


def test_research_of_tasks(spark):
    p = spark.createDataFrame([("t", ["c1", "c2"]), ("u", ["c3"])], "task_id string, owned_claim_ids array<string>")
    a = spark.createDataFrame([("c2", "CONFIRMED"), ("c9", "CONTRADICTED")], "claim_id string, verdict string")
    got = {r["task_id"]: r["assessments"] for r in execution.task_research(p, a).collect()}
    assert got["u"] is None and [(x["claim_id"], x["verdict"]) for x in got["t"]] == [("c2", "CONFIRMED")]
    assert execution.task_research(p, a, "DISABLED").where("assessments is not null").count() == 0


REQUEST = "job_id string, kind string, expected string, state string, sequence long, percentage long, message string, occurred_at timestamp"


def test_job_store(spark, tmp_path):
    path = str(tmp_path / "log")
    ask = lambda *r: store.append(path, spark.createDataFrame([(*x, None, None) for x in r], REQUEST)).orderBy("job_id").collect()
    got = ask(("j1", "INSERT", None, None, None, None), ("j2", "INSERT", None, None, None, None))
    assert [(r["state"], r["record_version"]) for r in got] == [("CREATED", 1)] * 2
    got = ask(("j1", "MOVE", "CREATED", "INSPECTING", None, None), ("j2", "PROGRESS", None, None, 1, 10))
    assert [(r["state"], r["record_version"], r["last_event_sequence"], r["last_percentage"]) for r in got] == [("INSPECTING", 2, 0, 0), ("CREATED", 2, 1, 10)]
    for bad, code in (
        (("j1", "INSERT", None, None, None, None), "JOB_ALREADY_EXISTS"),
        (("j9", "MOVE", "CREATED", "FAILED", None, None), "JOB_NOT_FOUND"),
        (("j1", "MOVE", "CREATED", "FAILED", None, None), "JOB_STATE_CONFLICT"),
        (("j1", "MOVE", "INSPECTING", "COMPLETED", None, None), "JOB_STATE_CONFLICT"),
        (("j2", "PROGRESS", None, None, 3, 20), "PROGRESS_EVENT_CONFLICT"),
        (("j2", "PROGRESS", None, None, 2, 9), "PROGRESS_EVENT_CONFLICT"),
        (("j2", "PROGRESS", None, None, 2, 101), "PROGRESS_EVENT_CONFLICT"),
    ):
        with pytest.raises(Conflict, match=code):
            ask(bad)
    assert store.log(spark, path).count() == 4
    with pytest.raises(Conflict, match="ONE_REQUEST"):
        ask(("j2", "PROGRESS", None, None, 2, 20), ("j2", "PROGRESS", None, None, 3, 30))


def test_leases(spark):
    rows = [
        ("j", 10, 1, "LAUNCH", "r1", None, None, None),
        ("j", 11, 2, "CLAIM", "r1", 7, None, None),
        ("j", 12, 3, "HEARTBEAT", "r2", 7, None, None),  # not the owner
        ("j", 9, 4, "HEARTBEAT", "r1", 7, None, None),  # comes first in time, before the launch
        ("j", 13, 5, "HEARTBEAT", "r1", 8, None, None),  # another process
        ("j", 14, 6, "CLAIM", "r1", 7, None, None),  # repeated: no conflict
        ("j", 15, 7, "FINISH", "r1", 7, "EXITED", None),
        ("j", 16, 8, "FINISH", "r1", 7, "EXITED", None),  # repeated
        ("j", 17, 9, "FINISH", "r1", 7, "FAILED", "E"),
        ("k", 1, 1, "LAUNCH", "r1", None, None, None),
        ("k", 2, 2, "LAUNCH", "r2", None, None, None),
        ("k", 3, 3, "FINISH", "r2", None, "FAILED", "START"),
    ]
    got = {r["job_id"]: r for r in store.lease_fold(spark.createDataFrame(rows, store.LEASE)).collect()}
    j, k = got["j"], got["k"]
    assert (j["lifecycle"], j["process_id"], j["heartbeat_at"], j["finished_at"], j["conflicts"], j["launch_sequence"]) == ("EXITED", 7, 15, 15, 4, 1)
    assert (k["lifecycle"], k["launch_sequence"], k["runner_token"], k["error_code"], k["conflicts"]) == ("FAILED", 2, "r2", "START", 0)


def test_cancel_interrupts_tagged_queries(spark):
    seen = []

    def work():
        with store.cancellable(spark, "x"):
            try:
                spark.range(0, 10**14, 1, 4).where("id % 7 = 9").count()
            except Exception as error:
                seen.append(error)

    t = threading.Thread(target=work)
    t.start()
    for _ in range(120):
        time.sleep(0.25)
        store.cancel(spark, "x")
        if not t.is_alive():
            break
    assert not t.is_alive() and seen and spark.range(3).count() == 3


def test_plan_pieces(spark):
    c = spark.createDataFrame([("p", 0, i, "a" if i < 50 else "b", "s") for i in range(55)] + [("p", 1, 100 + i, "c", "s") for i in range(30)], "plan_id string, root int, claim_id int, first_path string, folded string")
    got = tasks.planning_batches(c).groupBy("batch_ordinal").agg(F.count("*").alias("n"), F.countDistinct("root").alias("roots")).orderBy("batch_ordinal").collect()
    assert [(r["n"], r["roots"]) for r in got] == [(40, 1), (15, 1), (30, 1)]
    r = spark.createDataFrame([("a", "b", "CONFLICT"), ("b", "a", "CONFLICT"), ("a", "z", "CONFLICT"), ("a", "c", "UNRELATED"), ("c", "d", "CONFLICT"), ("a", "d", "CONFLICT")], "left_id string, right_id string, relation string")
    d = spark.createDataFrame([("a", "LEFT"), ("b", "RIGHT"), ("c", "RIGHT"), ("d", "RIGHT")], "draft_id string, side string")
    assert sorted((x["left_id"], x["right_id"], x["violation_code"]) for x in claims.relation_errors(r, d).collect()) == [("a", "b", "DUPLICATE_PAIR"), ("a", "c", "NOT_MEANINGFUL"), ("a", "z", "UNKNOWN_REFERENCE"), ("b", "a", "DUPLICATE_PAIR"), ("c", "d", "OUTSIDE_PARTITION")]
    pairs = claims.split_pairs(spark.range(7).withColumn("g", F.lit(1)), ["g"], "id").collect()
    assert sorted((x["a"], x["b"]) for x in pairs) == [(i, j) for i in range(7) for j in range(i + 1, 7)]
    assert {(x["a"], x["b"]) for x in pairs if x["part"] == "CROSS"} == {(i, j) for i in range(3) for j in range(3, 7)}


def test_search_rules(spark):
    rows = [(1, 0, "https://a", " T ", "c" * 5000, "d" * 200), (1, 1, "http://b", "T", "c", None), (1, 2, "https://c", "  ", "c", None), (1, 3, "https://d", None, "c", None)]
    got = research.search_results(spark.createDataFrame(rows, "query_id int, pos int, url string, title string, content string, published_date string")).collect()
    assert [(r["title"], len(r["snippet"]), len(r["published_date"])) for r in got] == [("T", 4000, 100)]
    s = spark.createDataFrame([("C1", 9, "https://only.example"), ("C2", 8, "   "), ("C3", 7, "version 2.1 at https://x"), ("C4", 6, "my password = x"), ("C5", 5, "plain")], "claim_id string, score int, statement string")
    assert [r["claim_id"] for r in research.select_claims(s, 3).orderBy("claim_id").collect()] == ["C3", "C5"]
    d = spark.createDataFrame([(1, "we saw the QUICK."), (2, "the quick fox"), (3, "a-b+c"), (4, "nothing here")], "id int, t string")
    lit = spark.createDataFrame([(1, "the quick"), (2, "+c"), (3, "OTHING H"), (4, "x")], "item_id int, literal string")
    assert sorted(map(tuple, research.literal_hits(d, "id", "t", lit).collect())) == [(1, 1), (2, 1), (2, 4), (3, 2), (4, 3)]
    long = "This prose block is repeated and it is more than sixty characters long, really."
    m = spark.createDataFrame([(1, f"{long} [claim:C1]\n\nmiddle\n\n{long}")], "k int, t string")
    assert assembly.polished_blocks(assembly.blocks(m, ["k"], "t"), ["k"]).count() == 2


def test_units_and_prompts(spark):
    got = spark.range(1).select(assembly.system_prompt(F.lit("P "), F.lit(" ")), assembly.system_prompt(F.lit("P "), F.lit(" add ")), assembly.system_prompt(F.lit("P"), F.lit("x" * 20001))).first()
    assert got[0] == "P " and got[1].startswith("P\n\n") and "\nadd\n" in got[1] and got[2] is None
    e = spark.createDataFrame([("j", 1, "g1", "STARTED"), ("j", 2, "g1", "DELTA"), ("j", 3, "g2", "STARTED")], "job_id string, sequence int, generation_id string, kind string")
    assert jobs.generations(e).first()["generations"] == 2
    tail = jobs.stream_tail(e, "job_id", "sequence", 2).collect()
    assert len(tail) == 2 and all(r["truncated"] for r in tail)
    assert sorted((r["state"], r["runnable"]) for r in jobs.runnable(spark.createDataFrame([("FAILED",), ("PLANNING",), ("CANCELLING",)], "state string")).collect()) == [("CANCELLING", False), ("FAILED", False), ("PLANNING", True)]


def test_workspace(spark, tmp_path):
    before, after = tmp_path / "before", tmp_path / "after"
    (before / "sub").mkdir(parents=True)
    (before / "a.md").write_text("alpha\n")
    (before / "sub/b.txt").write_text("beta")
    b, a = str(before), str(after)
    m = workspace.prepare_run(spark, b, a, "run-1").first()
    assert (m["state"], m["input_file_count"]) == ("PREPARED", 2)
    with pytest.raises(Conflict, match="RUN_ALREADY_EXISTS"):
        workspace.prepare_run(spark, b, a, "run-1")
    doc = lambda p: spark.createDataFrame([(p, "# New\n")], "relative_path string, text string")
    src = spark.createDataFrame([("a.md", "0" * 64)], "relative_path string, source_sha256 string")
    for p in ("../x.md", "x.txt", "./x.md"):
        with pytest.raises(Conflict, match="OUTPUT_PATH"):
            workspace.write_generated(spark, a, "run-1", doc(p), src)
    with pytest.raises(Conflict, match="OUTPUT_ALREADY_EXISTS"):
        workspace.write_generated(spark, a, "run-1", doc("a.md"), src)
    workspace.write_generated(spark, a, "run-1", doc("new.md"), src, model_id="m")
    got = {r["relative_path"]: r["status"] for r in workspace.compare_run(spark, b, a, "run-1").collect()}
    assert got == {"a.md": "UNCHANGED", "sub/b.txt": "UNCHANGED", "new.md": "ADDED"}
    (before / "a.md").write_text("changed")
    with pytest.raises(Conflict, match="INPUT_HASH_CHANGED"):
        workspace.finalize_run(spark, b, a, "run-1")
    (before / "a.md").write_text("alpha\n")
    assert workspace.finalize_run(spark, b, a, "run-1").first()["state"] == "FINALIZED"
    with pytest.raises(Conflict, match="RUN_ALREADY_FINALIZED"):
        workspace.write_generated(spark, a, "run-1", doc("c.md"), src)
    job = "job-" + "0" * 32
    workspace.job_skeleton(spark, a, job, src)
    with pytest.raises(Conflict, match="JOB_ALREADY_EXISTS"):
        workspace.job_skeleton(spark, a, job, src)
    workspace.publish_result(spark, a, job, ledger="a" * 64, plan="b" * 64, document="c" * 64, report="d" * 64)
    with pytest.raises(Exception):
        workspace.publish_result(spark, a, job, ledger="a" * 64)
    with pytest.raises(Conflict, match="DIGEST"):
        workspace.publish_result(spark, a, job, ledger="x")


def test_folders(spark, tmp_path):
    root = tmp_path / "in"
    (root / "z").mkdir(parents=True)
    with pytest.raises(ValueError, match="SOURCE_EMPTY"):
        files.collected(spark, str(root))
    (root / "b.md").write_text("b")
    (root / "z/a.md").write_text("a")
    assert [r["relative_path"] for r in files.collected(spark, str(root)).collect()] == ["b.md", "z/a.md"]
    assert "content" not in files.listing(spark, str(root)).columns
    (root / "link.md").symlink_to(root / "b.md")
    with pytest.raises(Conflict, match="LINK_NOT_ALLOWED"):
        files.collected(spark, str(root))


def test_typed_relations(spark, tmp_path):
    root = str(tmp_path)
    rows = spark.createDataFrame([("job-1", "a", "b", "CONFLICT")], files.RELATIONS["relations"])
    assert files.save_relation(rows, root, "relations", "job-1") and not files.save_relation(rows, root, "relations", "job-1")
    with pytest.raises(Conflict):
        files.save_relation(rows.withColumn("relation", F.lit("UNRELATED")), root, "relations", "job-1")
    with pytest.raises(ValueError):
        files.save_relation(rows.drop("relation"), root, "relations", "job-1")
    assert files.load_relation(spark, root, "relations", "job-1").collect() == rows.collect()
    got = {r["stage"]: r["status"] for r in files.checkpoints(spark, root, "job-1", {"relations": 2, "tasks": 1}).collect()}
    assert got == {"relations": "IN_PROGRESS", "tasks": "MISSING"}


def test_checkpoints_look_at_what_is_saved(spark, tmp_path):
    root, hex_ = str(tmp_path), "a" * 64
    put = lambda name, *rows: spark.createDataFrame(rows, files.RELATIONS[name]).write.mode("append").parquet(f"{root}/{name}")
    put("final_document", ("good", "text", hashlib.sha256(b"text").hexdigest()), ("bad", "text!", hashlib.sha256(b"text").hexdigest()))
    put("task_validations", ("good", "t", 1, True, []), ("bad", "t", 1, True, ["X"]))
    put("result", ("good", hex_, hex_, hex_, hex_), ("bad", hex_, "x", hex_, None))
    put("relations", ("good", "a", "b", "CONFLICT"), ("good", "a", "c", "CONFLICT"), ("bad", "a", "b", "CONFLICT"), ("bad", "a", "b", "CONFLICT"))
    put("tasks", ("good", "t", 0, "T", "o", ["c"], [], [], [], ["u"]), ("bad", "t", 0, "T", "o", ["c"], [], [], [], ["t"]))
    put("claims", ("good", "c", "FACT", "s", ["e"], ["d"], [], [], []), ("bad", "c", "FACT", "s", [], ["d"], [], [], []))
    expected = {"final_document": 1, "task_validations": 1, "result": 1, "relations": 2, "tasks": 1, "claims": 1}
    status = lambda job: {r["stage"]: r["status"] for r in files.checkpoints(spark, root, job, expected).collect()}
    assert set(status("good").values()) == {"SAVED"} and set(status("bad").values()) == {"INVALID"} and set(status("none").values()) == {"MISSING"}


def test_settings_and_manifests(spark, tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "default.yaml").write_text("a: {x: 1, y: 2}\nlog: {level: INFO}\n")
    (tmp_path / "test.yaml").write_text("a: {y: 3}\n")
    (tmp_path / "local.yaml").write_text("a: {x: 9}\n")
    got = files.settings(str(tmp_path), "test", {"LEVEL": "DEBUG"}, {"LEVEL": "log.level"})
    assert got == {"a": {"x": 9, "y": 3}, "log": {"level": "DEBUG"}, "environment": "test"}
    assert files.settings(str(tmp_path), "production", {}, {})["a"] == {"x": 1, "y": 2}
    with pytest.raises(ValueError):
        files.settings(str(tmp_path), "elsewhere", {}, {})
    (tmp_path / "facts.yaml").write_text("facts:\n- {id: a, terms: [x, y]}\n- {id: b, terms: []}\n")
    assert [r["terms"] for r in files.yaml_records(spark, str(tmp_path / "facts.yaml"), "facts", "id string, terms array<string>").orderBy("id").collect()] == [["x", "y"], []]


def test_connectors(spark, tmp_path):
    snap = tmp_path / "models--org--tiny-4bit" / "snapshots" / ("a" * 40)
    snap.mkdir(parents=True)
    (snap / "config.json").write_text(json.dumps({"quantization": {"bits": 4}, "max_position_embeddings": 4096}))
    (snap / "weights.bin").write_bytes(b"0" * 100)
    (tmp_path / "models--org--empty" / "snapshots" / "b").mkdir(parents=True)
    connectors.register(spark)
    got = {r["model_id"]: r for r in spark.read.format("model_cache").load(str(tmp_path)).collect()}
    assert got["org/tiny-4bit"]["quantization"] == "4-bit" and got["org/tiny-4bit"]["context_tokens"] == 4096 and got["org/tiny-4bit"]["size_bytes"] > 100
    assert got["org/empty"]["size_bytes"] is None
    assert spark.read.format("web_search").option("queries", '["x"]').load().count() == 0

    def client(query, limit):
        if query == "down":
            raise OSError("no route")
        return [{"url": "https://a", "title": query}] * 3 if query == "x" else []

    connectors.register(spark, web_search=client)
    found = spark.read.format("web_search").option("queries", '["x", "none", "down"]').option("limit", 2).load().collect()
    assert sorted((r["query_id"], r["pos"] if r["pos"] is not None else -1, r["error"]) for r in found) == [("down", -1, "OSError: no route"), ("x", 0, None), ("x", 1, None)]
    connectors.register(spark)
    assert spark.read.format("web_search").option("queries", '["x"]').load().count() == 0
    with pytest.raises(Exception, match="MODEL_HUB_UNAVAILABLE"):
        spark.read.format("model_hub").option("query", "x").load().count()


def naive_end(text, start, least, target, most):
    """The end of a chunk without overlap or headings, by trying every place; ASCII text, so bytes are characters."""
    import re

    if len(text) - start <= most:
        return len(text)
    kinds = [r"\n\n+", r"\n", r"[.!?](?:\s+|$)", r"\s+"]
    for kind in kinds:
        ends = [start + min(least, target) + m.end() for m in re.finditer(kind, text[start + min(least, target) : start + target])]
        if ends:
            return ends[-1]
    for kind in kinds:
        m = re.search(kind, text[start + target : start + most])
        if m:
            return start + target + m.end()
    return start + most


def test_chunk_ends_by_brute_force():
    import random

    from loomline.operators import chunking

    room = 400 - len('<primary-range process="true">\n\n</primary-range>')
    config = chunking.Config(120, 400, 20, 0.0)
    for seed in range(40):
        r = random.Random(seed)
        text = "".join(r.choice(["word", "a", "verylongword" * 3, " ", " ", ". ", "\n", "\n\n"]) for _ in range(r.randrange(1, 400)))
        at, want = 0, []
        while at < len(text):
            end = naive_end(text, at, 20, 120, room)
            want.append((at, end))
            at = end
        assert [(s, e) for s, e, _, _ in chunking.chunks_of(text, config)] == want
    assert [(s, e) for s, e, *_ in chunking.chunks_of("x" * 1000)] == [(0, 1000)]


def test_breadcrumb_is_that_of_the_text_before():
    import re

    from loomline.operators import chunking

    text = "# One\n\n" + "w " * 30 + "\n\n## Two words here\n\n\n\n" + "v " * 200 + "\n### Three   \n" + "u " * 200
    for s, _, _, structure in chunking.chunks_of(text, chunking.Config(60, 300, 10, 0.0)):
        trail = {}
        for m in re.finditer(r"(?m)^\s{0,3}(#{1,6})\s+(.+?)\s*$", text[:s]):
            trail = {k: v for k, v in trail.items() if k < len(m[1])} | {len(m[1]): f"{m[1]} {m[2].strip()}"}
        want = "\n".join(trail[k] for k in sorted(trail))
        assert structure == want


def test_halving(spark):
    b = spark.createDataFrame([("a", [1, 2, 3, 4, 5]), ("b", [6]), ("c", [13])], "batch_id string, members array<int>")
    run = lambda x: x.select("batch_id", F.array_join(F.col("members").cast("array<string>"), "+").alias("answer"))
    ok = lambda x: x.where("length(answer) <= 3 and answer <> '13' and answer <> '3'")
    good, lost = execution.with_halving(b, run, ok)
    assert sorted(r["answer"] for r in good.collect()) == ["1+2", "4+5", "6"]
    assert sorted(r["members"][0] for r in lost.collect()) == [3, 13]
    assert execution.with_halving(b.limit(0), run, ok)[0].count() == 0


def test_live_journals(spark, tmp_path):
    from loomline.sources import files, sinks
    from loomline.streaming import streams

    rows = [("j", 1, "g", "STARTED", None), ("j", 2, "g", "DELTA", "a" * 100), ("j", 3, "g", "DELTA", "b" * 5000), ("j", 4, "g", "DELTA", "c\n"), ("j", 6, "g", "DELTA", "tail"), ("j", 7, "g", "COMPLETED", None)]
    e = spark.createDataFrame(rows, "job_id string, sequence long, generation_id string, kind string, text string")
    folder = str(tmp_path / "journal")
    for k in (0, 3):
        e.where(f"sequence > {k} and sequence <= {k + 3 if k == 0 else 99}").coalesce(1).write.mode("append").json(folder)
    live = files.stream_events(spark, folder, live=True)
    run = lambda df, name: df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start().awaitTermination()
    run(streams.sequence_watch(live), "gaps")
    assert [tuple(r) for r in spark.table("gaps").collect()] == [("j", 6, 5)]
    run(streams.coalesced_live(live), "pieces")
    assert [r["piece"] for r in spark.table("pieces").orderBy("ordinal").collect()] == ["a" * 100 + "b" * 3996, "b" * 1004, "c\n", "tail"]
    path = str(tmp_path / "dense")
    sinks.append_dense(e.where("sequence <= 4"), path)
    with pytest.raises(Conflict):
        sinks.append_dense(e.where("sequence >= 6"), path)

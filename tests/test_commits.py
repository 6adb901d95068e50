"""Commits by many writers at once."""

import subprocess
import sys
import threading
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from loomline.operators import store
from loomline.sources import commits, sinks

ROOT = str(Path(__file__).resolve().parent.parent)
REQUEST = "job_id string, kind string, expected string, state string, sequence long, percentage long, message string, occurred_at timestamp"


def request(spark, *rows):
    return spark.createDataFrame([(*r, None, None) for r in rows], REQUEST)


def together(*calls):
    """What each call returned or raised, all started at one moment."""
    start, out = threading.Barrier(len(calls)), [None] * len(calls)

    def run(i, call):
        start.wait()
        try:
            out[i] = call()
        except Exception as e:
            out[i] = e

    threads = [threading.Thread(target=run, args=x) for x in enumerate(calls)]
    [t.start() for t in threads], [t.join() for t in threads]
    return out


def test_one_of_two_moves_wins(spark, tmp_path):
    path = str(tmp_path / "jobs")
    store.append(path, request(spark, ("j", "INSERT", None, None, None, None)))
    move = lambda to: lambda: store.append(path, request(spark, ("j", "MOVE", "CREATED", to, None, None))).count()
    got = together(move("INSPECTING"), move("CANCELLING"))
    assert sorted(type(x).__name__ for x in got) == ["Conflict", "int"]
    assert "JOB_STATE_CONFLICT" in str(next(x for x in got if isinstance(x, Exception)))
    assert store.log(spark, path).where("kind = 'MOVE'").count() == 1


def test_no_event_is_lost(spark, tmp_path):
    path = str(tmp_path / "jobs")
    insert = lambda i: lambda: store.append(path, request(spark, (f"j{i}", "INSERT", None, None, None, None)), every=3).count()
    got = together(*[insert(i) for i in range(6)])
    assert all(isinstance(x, int) for x in got)
    log = commits.CommitLog(spark, path, store.LOG)
    assert log.now().version == 6 and log.now().rows().select("job_id").distinct().count() == 6
    assert [int(n) for n in log.folder.names("state")] == [3, 6]
    assert len(log.folder.names("data")) == 6  # what losers wrote is gone
    # The state comes from the kept copy: the commits before it are not read again.
    log.folder.delete("data", log.entry(1)["data"])
    assert log.now().state(store.folded, store.merged).count() == 6


def test_state_from_a_copy_equals_the_fold(spark, tmp_path):
    path = str(tmp_path / "jobs")
    store.append(path, request(spark, ("a", "INSERT", None, None, None, None), ("b", "INSERT", None, None, None, None)), every=2)
    for k in range(1, 6):
        store.append(path, request(spark, ("a", "PROGRESS", None, None, k, 10 * k)), every=2)
    store.append(path, request(spark, ("b", "MOVE", "CREATED", "INSPECTING", None, None)), every=2)
    view = commits.CommitLog(spark, path, store.LOG).now()
    rows = lambda df: sorted(map(tuple, df.collect()), key=repr)
    assert rows(view.state(store.folded, store.merged)) == rows(store.folded(view.rows()))
    with pytest.raises(sinks.Conflict, match="PROGRESS_EVENT_CONFLICT"):
        store.append(path, request(spark, ("a", "PROGRESS", None, None, 5, 60)))


def test_one_process_puts_a_file(tmp_path):
    code = f"import sys; sys.path.insert(0, {ROOT!r}); from loomline.sources.commits import put_if_absent; print([put_if_absent({str(tmp_path)!r}, str(k), sys.argv[1].encode()) for k in range(200)].count(True))"
    runs = [subprocess.Popen([sys.executable, "-c", code, str(i)], stdout=subprocess.PIPE, text=True) for i in range(4)]
    won = [int(r.communicate()[0].split()[-1]) for r in runs]
    assert sum(won) == 200
    texts = [(tmp_path / str(k)).read_text() for k in range(200)]
    assert [texts.count(str(i)) for i in range(4)] == won
    assert len(list(tmp_path.iterdir())) == 200


def test_writers_that_always_lose_say_so(spark, tmp_path):
    log = commits.CommitLog(spark, str(tmp_path / "x"), "n long")

    def overtaken(view):
        log.folder.put("log", f"{view.version + 1:020d}", '{"data": "none"}')
        return spark.range(1).select(F.col("id").alias("n"))

    with pytest.raises(commits.Lost):
        log.commit(overtaken, tries=3)
    assert log.folder.names("data") == []


def test_dense_journals(spark, tmp_path):
    path, schema = str(tmp_path / "dense"), "job_id string, sequence long, text string"
    rows = lambda *numbers: spark.createDataFrame([("j", n, "t") for n in numbers], schema)
    sinks.append_dense(rows(1, 2, 3), path, every=2)
    got = together(*[lambda: sinks.append_dense(rows(4, 5), path, every=2)] * 2)
    assert sorted(type(x).__name__ for x in got) == ["Conflict", "NoneType"]
    sinks.append_dense(rows(6), path, every=2)
    with pytest.raises(sinks.Conflict):
        sinks.append_dense(rows(8), path)
    assert [r["sequence"] for r in sinks.journal(spark, path, schema).orderBy("sequence").collect()] == [1, 2, 3, 4, 5, 6]


def test_tables_are_replaced_at_once(spark, tmp_path):
    path, old = str(tmp_path / "t"), spark.range(3)
    assert commits.current_table(spark, path, old.schema).count() == 0
    assert commits.replace_table(old, path) == 1
    before = commits.current_table(spark, path, old.schema)
    assert commits.replace_table(spark.range(10, 12), path) == 2
    assert {r[0] for r in before.collect()} == {0, 1, 2} and {r[0] for r in commits.current_table(spark, path, old.schema).collect()} == {10, 11}

"""Groups and orders over edge tables, by rounds of joins with checkpoints between them."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; only a local session without one gets a temporary folder."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="loomline-"))
    return spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage by a copy in the session's shared folder, which any executor can read again (see ``forget``)."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/cut-{uuid.uuid4().hex}"
    names = [f"c{i}" for i in range(len(df.columns))]  # any name is right
    df.toDF(*names).write.parquet(path)
    if not _copies:
        atexit.register(lambda: [_delete(s, p) for s, p in _copies.values()])
    _copies[path.rsplit("/", 1)[-1]] = (spark, path)
    return spark.read.schema(df.toDF(*names).schema).parquet(path).toDF(*df.columns)


def modest_batches(spark: SparkSession, rows: int = 1000, size: str = "8m") -> SparkSession:
    """The session, with at most ``rows`` and about ``size`` of them an Arrow batch where it has Spark's defaults.

    Whole texts are much for one Python worker; a size that somebody chose is kept.
    """
    for key, default, modest in (("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", size)):
        if spark.conf.get(key, None) == default:
            spark.conf.set(key, modest)
    return spark


_copies: dict[str, tuple[SparkSession, str]] = {}


def _delete(spark: SparkSession, path: str) -> None:
    try:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session has ended; its folder goes with the job
        return


def forget(*cuts: DataFrame) -> None:
    """Delete copies of ``cut`` that nothing will read again; what is left goes when Python ends."""
    for df in cuts:
        for name in {f.rsplit("/", 2)[-2] for f in df.inputFiles()} & set(_copies):
            _delete(*_copies.pop(name))


def components(nodes: DataFrame, edges: DataFrame, limit: int = 60) -> DataFrame:
    """``node, root`` with the least node of each component, by labels that also jump to their label's label."""
    both = edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct()
    label = nodes.select(F.col("node"), F.col("node").alias("root"))
    both, before = cut(both), []
    for _ in range(limit):
        offered = both.join(label, both["a"] == label["node"]).groupBy("b").agg(F.min("root").alias("offer"))
        step = label.join(offered, label["node"] == offered["b"], "left").select("node", F.col("root").alias("old"), F.least("root", F.coalesce("offer", "root")).alias("near"))
        jump = label.select(F.col("node").alias("near"), F.col("root").alias("far"))
        step = cut(step.join(jump, "near", "left").select("node", "old", F.least("near", F.coalesce("far", "near")).alias("root")))
        forget(*before)
        before, label = [step], step.select("node", "root")
        if step.where("old <> root").isEmpty():
            forget(both)
            return label
    raise RuntimeError("components did not settle")


def levels(nodes: DataFrame, depends: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Kahn's peeling: (``node, level``, nodes that a cycle holds back), to the end however deep.

    One table holds all nodes with the level they left at; a round joins only what is left.
    Rounds are many, so no side of their joins is broadcast: that would go through the driver each time.
    """
    state = cut(nodes.select("node").distinct().withColumn("level", F.lit(None).cast("long")))
    edges = cut(depends.select("node", "needs").distinct())
    k, before = 0, -1
    while True:
        waits = edges.select("node").distinct().withColumn("waits", F.lit(True))
        older, state = state, cut(state.join(waits.hint("merge"), "node", "left").select("node", F.when(F.col("level").isNull() & F.col("waits").isNull(), F.lit(k).cast("long")).otherwise(F.col("level")).alias("level")))
        forget(older)
        left = state.where("level is null").count()
        if left in (0, before):
            forget(edges)
            return state.where("level is not null"), state.where("level is null").select("node")
        gone = state.where("level is not null").select(F.col("node").alias("needs"))
        older, edges = edges, cut(edges.join(gone.hint("merge"), "needs", "left_anti"))
        forget(older)
        k, before = k + 1, left


def stable_order(tasks: list[str], depends: dict[str, list[str]]) -> list[str]:
    """Depth-first order in definition order (plans of hundreds of tasks, on the driver)."""
    out: list[str] = []
    state: dict[str, int] = {}
    for root in tasks:
        stack = [(root, iter(depends.get(root, ())))]
        if root in state:
            continue
        state[root] = 1
        while stack:
            node, rest = stack[-1]
            for d in rest:
                if state.get(d) == 1:
                    raise ValueError("TASK_PLAN_INVALID: cycle")
                if d not in state:
                    state[d] = 1
                    stack.append((d, iter(depends.get(d, ()))))
                    break
            else:
                state[node] = 2
                out.append(node)
                stack.pop()
    return out


def namespaced(batch: int, total: int, task_id: str) -> str:
    """A task id that is unique over planning batches."""
    return f"p{batch:03d}-{total:03d}-{task_id[:55]}".rstrip("-")

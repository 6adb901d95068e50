"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words, as every contract of this subpackage defines them (ASCII white space splits).
WORD = r"[^\x20\x09-\x0D]+"

_scratch: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Only where the session has none, as in local tests, a temporary folder is set.
    """
    from_conf = spark.conf.get("spark.checkpoint.dir", None)
    if from_conf:
        return from_conf
    got = spark.sparkContext.getCheckpointDir()
    if got is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="loomline-"))
        got = spark.sparkContext.getCheckpointDir()
    return got


#: Rows that go to Python at once while a copy is written: texts and sets of thousands of rows are much for one worker.
BATCH_ROWS = 1000


def modest_batches(spark: SparkSession) -> SparkSession:
    """The session, with ``BATCH_ROWS`` rows an Arrow batch if it has Spark's default of ten times as many.

    For results that go through Python when the caller runs them; a size that somebody chose is kept.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) == 10_000:
        spark.conf.set(key, BATCH_ROWS)
    return spark


def settle(df: DataFrame, by: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet below the shared folder and read it back.

    Cuts the lineage, survives lost executors, and costs one compressed columnar copy.  ``by``:
    the copy is bucketed by that column, as many as shuffles have partitions, so that joins by it
    shuffle only their other side.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/settled-{uuid.uuid4().hex}"
    key, clean = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    usual, kept = spark.conf.get(key), spark.conf.get(clean, "false")
    spark.conf.set(key, min(int(usual), BATCH_ROWS) if int(usual) > 0 else BATCH_ROWS)
    spark.conf.set(clean, "true")  # the copy is all that anybody reads of this job
    buckets, name = int(spark.conf.get("spark.sql.shuffle.partitions")), path.rsplit("/", 1)[-1].replace("-", "_")
    try:
        if by:
            df.repartition(buckets, by).write.bucketBy(buckets, by).sortBy(by).option("path", path).saveAsTable(name)
        else:
            df.write.parquet(path)
    finally:
        spark.conf.set(key, usual)
        spark.conf.set(clean, kept)
    if not _scratch:
        atexit.register(clear_scratch)
    _scratch.append((spark, path))
    if by:
        out = spark.table(name)
        spark.sql(f"DROP TABLE {name}")  # the name alone: the files are a copy like any other
        return out
    return spark.read.schema(df.schema).parquet(path)


def release(since: int = 0, keep: DataFrame | None = None) -> None:
    """Delete what ``settle`` wrote after the first ``since`` copies, but for what ``keep`` still reads."""
    held = {f.rsplit("/", 2)[-2] for f in keep.inputFiles()} if keep is not None else set()
    for spark, path in _scratch[since:]:
        if path.rsplit("/", 1)[-1] in held:
            continue
        _scratch.remove((spark, path))
        try:
            jvm = spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session has ended; its folder goes with the job
            return


def forget(*settled: DataFrame) -> None:
    """Delete settled copies that nothing will read again."""
    gone = {f.rsplit("/", 2)[-2] for df in settled for f in df.inputFiles()}
    for spark, path in [x for x in _scratch if x[1].rsplit("/", 1)[-1] in gone]:
        _scratch.remove((spark, path))
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def clear_scratch() -> None:
    """Delete all that is left (runs by itself when Python ends)."""
    release()


def copies() -> int:
    """How many settled copies there are now; a mark for ``release``."""
    return len(_scratch)


def tidy(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """The operator, which deletes its own settled copies as soon as its result no longer reads them."""

    @wraps(operator)
    def run(*args, **kwargs) -> DataFrame:
        since = copies()
        out = operator(*args, **kwargs)
        release(since, out)
        return out

    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(key: str | Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus`` (null for a null id)."""
    c = F.col(key) if isinstance(key, str) else key
    return F.crc32(c.cast("string").cast("binary")) % F.lit(modulus)


def held_out(key: str | Column, modulus: int, rest: int) -> Column:
    return F.coalesce(fold(key, modulus) == rest, F.lit(False))


def thinned(df: DataFrame, key: str, total: int, bound: int, seed: int) -> DataFrame:
    """About ``bound`` of ``total`` rows, chosen by a hash of ``key``; all if there are no more."""
    if total <= bound:
        return df
    unit = 1 << 20
    return df.where(F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(unit)) < int(unit * bound / total))


def small_join(big: DataFrame, small: DataFrame, keys: list[str], how: str = "inner", most: int = 100_000, most_bytes: int = 16 << 20) -> DataFrame:
    """Join a settled small side: broadcast within ``most`` rows and about ``most_bytes``, else by shuffle."""
    size = F.sum(F.length(F.to_json(F.struct(*small.columns))))
    n, total = small.limit(most + 1).agg(F.count("*"), F.coalesce(size, F.lit(0))).first()
    if n <= most and total <= most_bytes:
        small = F.broadcast(small)
    return big.join(small, keys, how)

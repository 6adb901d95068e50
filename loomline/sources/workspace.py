"""Revision runs: a verified copy of a folder, generated documents beside it, and reports.

A run is a folder ``runs/<run_id>`` with ``documents`` (one row a file), ``reports/*`` and
``manifest``.  It is written below ``staging`` and renamed at its end, so it is there whole or
not at all; nothing in it is ever overwritten, and a finalized run takes no more writes.
"""

from __future__ import annotations

import uuid
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules
from ..operators import revision
from . import files
from .sinks import Conflict, differs, write_once

CONTENT = "relative_path string, byte_count long, sha256 string, content binary"
MANIFEST = "run_id string, state string, at timestamp, input_file_count long, input_sha256 string, report_sha256 string"


def plain_tree(root: str) -> None:
    """Raise if a local tree holds a link or a special file, or leads out of itself (driver-side; object stores have neither)."""
    top = Path(root.removeprefix("file://"))
    if not top.exists():
        return
    if top.is_symlink():
        raise Conflict("LINK_NOT_ALLOWED")
    real = top.resolve()
    for p in top.rglob("*"):
        if p.is_symlink():
            raise Conflict("LINK_NOT_ALLOWED")
        if not (p.is_file() or p.is_dir()):
            raise Conflict("SPECIAL_FILE")
        if not p.resolve().is_relative_to(real):
            raise Conflict("PATH_ESCAPE")


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def publish_folder(spark: SparkSession, staging: str, target: str, code: str) -> None:
    """Rename a finished staging folder to its place; a taken place is an error and the staging is removed."""
    fs, p = _fs(spark, staging)
    _, q = _fs(spark, target)
    fs.mkdirs(q.getParent())
    if fs.exists(q) or not fs.rename(p, q):
        fs.delete(p, True)
        raise Conflict(code)


def listed(tree: DataFrame) -> DataFrame:
    return tree.select("relative_path", "byte_count", "sha256")


def digest(tree: DataFrame) -> str:
    """One SHA-256 for an inventory: of its sorted lines' own digests, folded without collecting it."""
    line = F.sha2(F.concat_ws("\u0000", "relative_path", "byte_count", "sha256"), 256)
    parts = [F.sum(F.conv(F.substring(line, 1 + 15 * k, 15), 16, 10).cast("decimal(38,0)")) for k in range(4)]  # order does not matter, repeats do
    row = tree.agg(F.count("*").alias("n"), *[p.alias(f"p{k}") for k, p in enumerate(parts)])
    return row.select(F.sha2(F.concat_ws("|", *[F.coalesce(F.col(f"p{k}"), F.lit(0)).cast("string") for k in range(4)], F.col("n").cast("string")), 256)).first()[0]


def prepare_run(spark: SparkSession, before: str, after: str, run_id: str) -> DataFrame:
    """Copy the folder ``before`` into a new run, verify every hash, and return the run's manifest."""
    if not spark.range(1).select(rules.is_id(F.lit(run_id), "run")).first()[0]:
        raise Conflict("RUN_ID")
    plain_tree(before)
    target, staging = f"{after}/runs/{run_id}", f"{after}/staging/{run_id}-{uuid.uuid4().hex}"
    if exists(spark, target):
        raise Conflict("RUN_ALREADY_EXISTS")
    first = files.inventory(spark, before)
    write_once(files.contents(spark, before), f"{staging}/documents")
    copy = spark.read.schema(CONTENT).parquet(f"{staging}/documents")
    broken = copy.where((F.sha2("content", 256) != F.col("sha256")) | (F.octet_length("content") != F.col("byte_count")))
    if not broken.isEmpty() or differs(listed(copy), first) or differs(listed(copy), files.inventory(spark, before)):
        fs, p = _fs(spark, staging)
        fs.delete(p, True)
        raise Conflict("INPUT_HASH_CHANGED")
    write_once(listed(copy), f"{staging}/reports/input")
    state = spark.range(1).select(F.lit(run_id).alias("run_id"), F.lit("PREPARED").alias("state"), F.current_timestamp().alias("at"), F.lit(copy.count()).cast("long").alias("input_file_count"), F.lit(digest(copy)).alias("input_sha256"), F.lit(None).cast("string").alias("report_sha256"))
    write_once(state, f"{staging}/manifest/state=prepared")
    publish_folder(spark, staging, target, "RUN_ALREADY_EXISTS")
    return manifest(spark, after, run_id)


def manifest(spark: SparkSession, after: str, run_id: str) -> DataFrame:
    """The run's latest state, one row."""
    try:
        m = spark.read.schema(MANIFEST).option("recursiveFileLookup", "true").parquet(f"{after}/runs/{run_id}/manifest")
    except AnalysisException as error:
        raise Conflict("RUN_NOT_FOUND") from error
    return m.orderBy(F.desc("at")).limit(1)


def _open(spark: SparkSession, after: str, run_id: str) -> DataFrame:
    m = manifest(spark, after, run_id)
    if m.first()["state"] == "FINALIZED":
        raise Conflict("RUN_ALREADY_FINALIZED")
    return m


def documents(spark: SparkSession, after: str, run_id: str) -> DataFrame:
    """The run's files, generated ones too."""
    d = spark.read.schema(CONTENT).parquet(f"{after}/runs/{run_id}/documents")
    made = f"{after}/runs/{run_id}/generated"
    return d.unionByName(spark.read.schema(CONTENT).option("recursiveFileLookup", "true").parquet(made)) if exists(spark, made) else d


def write_generated(spark: SparkSession, after: str, run_id: str, document: DataFrame, sources: DataFrame, **facts) -> None:
    """Add one generated Markdown file (``relative_path, text``) and its synthesis manifest; neither is ever overwritten."""
    _open(spark, after, run_id)
    root = f"{after}/runs/{run_id}"
    d = document.select("relative_path", F.octet_length("text").cast("long").alias("byte_count"), F.sha2("text", 256).alias("sha256"), F.encode("text", "UTF-8").alias("content"))
    if d.count() != 1 or not d.where(~rules.safe_output(F.col("relative_path"))).isEmpty():
        raise Conflict("OUTPUT_PATH_INVALID")
    if exists(spark, f"{root}/reports/synthesis") or not d.join(documents(spark, after, run_id), "relative_path", "left_semi").isEmpty():
        raise Conflict("OUTPUT_ALREADY_EXISTS")
    write_once(d, f"{root}/generated/{uuid.uuid4().hex}")
    named = [F.lit(v).alias(k) for k, v in sorted(facts.items())]
    listing = F.lit(sources.count()).cast("long").alias("source_document_count")
    write_once(sources.select("relative_path", F.col("source_sha256")), f"{root}/reports/synthesis_sources")
    write_once(d.select(F.col("relative_path").alias("output_relative_path"), F.col("sha256").alias("output_sha256"), listing, *named), f"{root}/reports/synthesis")


def compare_run(spark: SparkSession, before: str, after: str, run_id: str) -> DataFrame:
    """The comparison of the folder and the run's files; the folder must be what the run began with."""
    _open(spark, after, run_id)
    return _compared(spark, before, after, run_id)


def _compared(spark: SparkSession, before: str, after: str, run_id: str) -> DataFrame:
    now = files.inventory(spark, before)
    captured = spark.read.parquet(f"{after}/runs/{run_id}/reports/input")
    if differs(now, captured):
        raise Conflict("INPUT_HASH_CHANGED")
    return revision.compare(now, listed(documents(spark, after, run_id)))


def finalize_run(spark: SparkSession, before: str, after: str, run_id: str) -> DataFrame:
    """Store the comparison and close the run; returns its manifest."""
    m = _open(spark, after, run_id)
    root = f"{after}/runs/{run_id}"
    report = _compared(spark, before, after, run_id)
    write_once(report, f"{root}/reports/comparison")
    stored = spark.read.parquet(f"{root}/reports/comparison")
    if differs(stored, report):
        raise Conflict("COMPARISON_INCOMPLETE")
    generated = exists(spark, f"{root}/generated")
    if generated:
        wrong = spark.read.parquet(f"{root}/reports/synthesis").join(documents(spark, after, run_id).select(F.col("relative_path").alias("output_relative_path"), F.col("sha256").alias("output_sha256")), ["output_relative_path", "output_sha256"], "left_anti")
        if not wrong.isEmpty():
            raise Conflict("SYNTHESIS_MANIFEST")
    tree = stored.select("relative_path", F.col("status").alias("byte_count"), F.coalesce("after_sha256", "before_sha256").alias("sha256"))
    write_once(m.withColumns({"state": F.lit("FINALIZED"), "at": F.current_timestamp(), "report_sha256": F.lit(digest(tree))}), f"{root}/manifest/state=finalized")
    return manifest(spark, after, run_id)


def job_skeleton(spark: SparkSession, root: str, job_id: str, definition: DataFrame) -> None:
    """A new job's folder with its definition, staged and renamed; an existing job is an error."""
    if not spark.range(1).select(rules.is_id(F.lit(job_id), "job")).first()[0]:
        raise Conflict("JOB_ID")
    staging = f"{root}/staging/{job_id}-{uuid.uuid4().hex}"
    write_once(definition, f"{staging}/definition")
    publish_folder(spark, staging, f"{root}/jobs/{job_id}", "JOB_ALREADY_EXISTS")


def publish_result(spark: SparkSession, root: str, job_id: str, **digests: str) -> None:
    """The one result record of a job with the digests of its parts; written once."""
    bad = [k for k, v in digests.items() if len(v) != 64 or set(v) - set("0123456789abcdef")]
    if bad:
        raise Conflict(f"DIGEST: {', '.join(sorted(bad))}")
    row = spark.range(1).select(F.lit(job_id).alias("job_id"), *[F.lit(v).alias(f"{k}_sha256") for k, v in sorted(digests.items())], F.current_timestamp().alias("published_at"))
    write_once(row, f"{root}/jobs/{job_id}/result")

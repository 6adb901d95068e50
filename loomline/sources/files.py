"""Sources: text folders, inventories, artifacts, streams, catalogues."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import ids, rules

STREAM_EVENT = "job_id string, sequence long, generation_id string, stage string, kind string, text string, occurred_at timestamp, error_code string"


def inventory(spark: SparkSession, root: str) -> DataFrame:
    """``relative_path, byte_count, sha256`` of every file below ``root``, in path order when sorted."""
    return contents(spark, root).drop("content")


def _relative(root: str):
    full = F.regexp_replace("path", r"^[a-z]+:/+", "/")
    clean = F.regexp_replace(F.regexp_replace(F.lit(root), r"^[a-z]+:/+", "/"), "/+$", "")
    return F.substring(full, F.length(clean) + 2, F.length(full)).alias("relative_path")


def contents(spark: SparkSession, root: str) -> DataFrame:
    """``relative_path, byte_count, sha256, content`` of every file below ``root``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.select(_relative(root), F.col("length").alias("byte_count"), F.sha2("content", 256).alias("sha256"), "content")


def listing(spark: SparkSession, root: str) -> DataFrame:
    """``relative_path, byte_count`` of every file below ``root``; no content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.select(_relative(root), F.col("length").alias("byte_count"))


def collected(spark: SparkSession, root: str, max_bytes: int = 20_000_000) -> DataFrame:
    """All documents of a folder in path order: no link in the tree, at least one file, none in error.

    Each file is read twice and must be the same both times.
    """
    from .workspace import plain_tree

    plain_tree(root)
    d = text_documents(spark, root, max_bytes)
    bad = d.where("error is not null").orderBy("relative_path").limit(1).collect()
    if bad:
        raise ValueError(bad[0]["error"])
    if d.isEmpty():
        raise ValueError("SOURCE_EMPTY")
    changed = d.join(text_documents(spark, root, max_bytes).select("relative_path", "source_sha256"), ["relative_path", "source_sha256"], "left_anti")
    if not changed.isEmpty():
        raise ValueError("SOURCE_CHANGED")
    return d.orderBy(F.encode("relative_path", "UTF-8"))


def text_documents(spark: SparkSession, root: str, max_bytes: int = 20_000_000) -> DataFrame:
    """Supported UTF-8 files with their ids; ``error`` names why a file was not taken."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    prefix = F.lit(root.rstrip("/") + "/")
    path = F.element_at(F.split(F.col("path"), F.concat(F.lit(r"\Q"), prefix, F.lit(r"\E"))), -1)
    d = files.select(path.alias("relative_path"), "length", "content").where(rules.supported(F.col("relative_path")))
    valid = F.is_valid_utf8(F.col("content").cast("string"))
    d = d.withColumn("error", F.when(F.col("length") > max_bytes, "SOURCE_TOO_LARGE").when(~valid, "SOURCE_NOT_UTF8").when(~rules.safe_path(F.col("relative_path")), "UNSAFE_PATH"))
    d = d.withColumn("source_sha256", F.sha2("content", 256)).withColumn("text", F.when(F.col("error").isNull(), F.col("content").cast("string")))
    return d.select("relative_path", "source_sha256", ids.revision_id(F.col("relative_path"), F.col("source_sha256")).alias("revision_id"), "text", "error")


def as_documents(table: DataFrame) -> DataFrame:
    """Rows of a ``documents`` table as text documents of one folder."""
    path = F.concat(F.col("source"), F.lit("/"), F.lpad(F.col("doc_id").cast("string"), 8, "0"), F.lit(".txt"))
    sha = F.sha2("text", 256)
    return table.select("doc_id", path.alias("relative_path"), sha.alias("source_sha256"), ids.revision_id(path, sha).alias("revision_id"), "text")


def json_artifact(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", "true").option("mode", "FAILFAST").json(path)


def markdown_artifact(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.col("value").alias("markdown"))


def relation(spark: SparkSession, root: str, name: str, job_id: str) -> DataFrame:
    """A typed relation of one job (partition pruning)."""
    return spark.read.parquet(f"{root}/{name}").where(F.col("job_id") == job_id)


def stream_events(spark: SparkSession, folder: str, live: bool = False) -> DataFrame:
    reader = spark.readStream if live else spark.read
    return reader.schema(STREAM_EVENT).json(folder)


def unexpected_fields(raw: str, expected: list[str]):
    """Fields of a JSON object that differ from the exact expected set, either way."""
    keys = F.coalesce(F.json_object_keys(F.col(raw)), F.array().cast("array<string>"))
    want = F.array(*[F.lit(x) for x in expected])
    return F.concat(F.array_except(keys, want), F.array_except(want, keys))


#: Typed relations of a job, by name: what they hold and how they are read and written.
RELATIONS = {
    "evidence": "job_id string, evidence_id string, chunk_id string, revision_id string, relative_path string, source_sha256 string, ordinal long, start_char long, end_char long, content_sha256 string, text string",
    "claim_drafts": "job_id string, draft_id string, evidence_id string, pos long, kind string, statement string, preconditions array<string>, commands array<string>, warnings array<string>",
    "claims": "job_id string, claim_id string, kind string, statement string, evidence_ids array<string>, draft_ids array<string>, preconditions array<string>, commands array<string>, warnings array<string>",
    "relations": "job_id string, left_id string, right_id string, relation string",
    "tasks": "job_id string, task_id string, position long, title string, objective string, owned_claim_ids array<string>, context_claim_ids array<string>, allowed_evidence_ids array<string>, required_sections array<string>, depends_on array<string>",
    "task_outputs": "job_id string, task_id string, attempt long, sections array<struct<heading:string,markdown:string,used_claim_ids:array<string>,used_evidence_ids:array<string>>>",
    "task_validations": "job_id string, task_id string, attempt long, valid boolean, error_codes array<string>",
    "web_sources": "job_id string, source_id string, url string, title string, snippet string, claim_ids array<string>",
    "web_assessments": "job_id string, claim_id string, query string, verdict string, source_ids array<string>, explanation string",
    "final_document": "job_id string, markdown string, sha256 string",
    "definition": "job_id string, before_root string, after_root string, instruction string, model_id string, model_revision string",
    "result": "job_id string, ledger_sha256 string, plan_sha256 string, document_sha256 string, report_sha256 string",
}


_HEX = "rlike '^[0-9a-f]{64}$'"
#: What a row of a relation must satisfy to be a valid checkpoint.
SOUND = {
    "evidence": "content_sha256 = sha2(text, 256) AND start_char < end_char AND ordinal >= 0",
    "claim_drafts": "trim(statement) <> '' AND draft_id IS NOT NULL AND evidence_id IS NOT NULL",
    "claims": "trim(statement) <> '' AND size(evidence_ids) > 0 AND size(draft_ids) > 0",
    "relations": "left_id <> right_id AND relation IN ('CONFLICT', 'COMPLEMENTARY', 'CONTEXTUAL_REPEAT', 'SEMANTIC_EQUIVALENT', 'EXACT_DUPLICATE')",
    "tasks": "size(owned_claim_ids) > 0 AND NOT array_contains(depends_on, task_id) AND position >= 0",
    "task_outputs": "attempt >= 1 AND size(sections) > 0 AND forall(sections, s -> trim(s.heading) <> '' AND trim(s.markdown) <> '')",
    "task_validations": "attempt >= 1 AND valid = (size(error_codes) = 0)",
    "web_sources": "url LIKE 'https://%' AND size(claim_ids) > 0",
    "web_assessments": "verdict IN ('CONFIRMED', 'CONTRADICTED', 'INCONCLUSIVE', 'OUTDATED') AND claim_id IS NOT NULL",
    "final_document": "sha256 = sha2(markdown, 256) AND trim(markdown) <> ''",
    "definition": "before_root <> after_root AND trim(model_id) <> ''",
    "result": f"ledger_sha256 {_HEX} AND plan_sha256 {_HEX} AND document_sha256 {_HEX} AND report_sha256 {_HEX}",
}


def load_relation(spark: SparkSession, root: str, name: str, job_id: str) -> DataFrame:
    """A job's relation with its exact types; a missing one is an error."""
    fields = spark.createDataFrame([], RELATIONS[name]).columns
    return spark.read.schema(RELATIONS[name]).parquet(f"{root}/{name}").where(F.col("job_id") == job_id).select(fields)


def save_relation(df: DataFrame, root: str, name: str, job_id: str) -> bool:
    """Write a job's relation once, in canonical order of its columns; the same rows again are no error, others are."""
    from .sinks import write_or_verify

    typed = df.sparkSession.createDataFrame([], RELATIONS[name]).schema
    missing = {f.name for f in typed} ^ set(df.columns)
    if missing:
        raise ValueError(f"fields: {', '.join(sorted(missing))}")
    if not df.where(~F.col("job_id").eqNullSafe(job_id)).isEmpty():
        raise ValueError("job_id")
    return write_or_verify(df.select([F.col(f.name).cast(f.dataType).alias(f.name) for f in typed]), f"{root}/{name}/job={job_id}")


def checkpoints(spark: SparkSession, root: str, job_id: str, expected: dict[str, int]) -> DataFrame:
    """For each stage of a job: expected and saved rows, and MISSING, IN_PROGRESS, SAVED or INVALID.

    INVALID: more rows than expected, a row that its relation's rule (``SOUND``) does not allow, or
    repeated rows.
    """
    from pyspark.errors import AnalysisException

    from ..operators import jobs

    saved = None
    for name in expected:
        try:
            d = spark.read.schema(RELATIONS[name]).parquet(f"{root}/{name}").where(F.col("job_id") == job_id)
            sound = F.coalesce(F.expr(SOUND[name]), F.lit(False))
            rows = d.groupBy(F.xxhash64(F.to_json(F.struct(*d.columns))).alias("h")).agg(F.count("*").alias("n"), F.min(sound).alias("ok"))
            one = rows.agg(F.lit(name).alias("stage"), F.coalesce(F.sum("n"), F.lit(0)).alias("saved"), F.coalesce(F.min(F.col("ok") & (F.col("n") == 1)), F.lit(True)).alias("valid"))
            one.count()
        except AnalysisException:
            continue
        saved = one if saved is None else saved.unionByName(one)
    if saved is None:
        saved = spark.createDataFrame([], "stage string, saved long, valid boolean")
    want = spark.createDataFrame([(k, v) for k, v in expected.items()], "stage string, total long")
    return jobs.checkpoint(saved, want, "stage").select("stage", "total", "saved", "status")


def yaml_records(spark: SparkSession, path: str, field: str | None = None, schema: str | None = None) -> DataFrame:
    """Records of a YAML manifest (a list, or the list under ``field``) as rows; small files, parsed on the driver."""
    import json

    value = yaml_file(path)
    rows = value[field] if field else value
    rows = rows if isinstance(rows, list) else [rows]
    lines = spark.createDataFrame([(json.dumps(r, ensure_ascii=False, default=str),) for r in rows], "v string")
    kind = schema or spark.range(1).select(F.schema_of_json_agg(F.lit(lines.first()[0]))).first()[0] if rows else "STRUCT<>"
    return lines.select(F.from_json("v", kind, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def yaml_file(path: str):
    """A YAML file; needs the optional package ``yaml``."""
    try:
        import yaml
    except ModuleNotFoundError as error:
        raise ValueError("DEPENDENCY_MISSING: PyYAML") from error
    with open(path, encoding="utf-8") as f:
        return yaml.safe_load(f)


def settings(folder: str, environment: str, variables: dict[str, str], names: dict[str, str]) -> dict:
    """Settings of ``default.yaml``, then the environment's file, then ``local.yaml`` (not in production), then variables.

    ``names`` maps a variable to the dotted setting that it gives.
    """
    from pathlib import Path

    if environment not in ("development", "test", "production"):
        raise ValueError("CONFIG_INVALID: environment")
    layers = [yaml_file(f"{folder}/default.yaml")]
    for name in [environment, *(["local"] if environment != "production" else [])]:
        if Path(f"{folder}/{name}.yaml").is_file():
            layers.append(yaml_file(f"{folder}/{name}.yaml"))
    if not all(isinstance(x, dict) for x in layers):
        raise ValueError("CONFIG_INVALID")
    over: dict = {"environment": environment}
    for variable, setting in names.items():
        if variable in variables:
            *path, last = setting.split(".")
            at = over
            for p in path:
                at = at.setdefault(p, {})
            at[last] = variables[variable]
    return layered_settings(*layers, over)


def layered_settings(*layers: dict) -> dict:
    """Later layers win; dictionaries merge key by key."""
    out: dict = {}
    for layer in layers:
        for k, v in layer.items():
            out[k] = layered_settings(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out

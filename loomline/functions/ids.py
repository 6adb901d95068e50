"""Content-addressed identifiers: SHA-256 over NUL-joined or canonical-JSON strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sha(c: Column) -> Column:
    return F.sha2(c, 256)


def joined(*parts: Column) -> Column:
    """Parts as text with NUL between them."""
    return F.concat_ws("\u0000", *[p.cast("string") for p in parts])


def revision_id(path: Column, source_sha: Column) -> Column:
    return F.concat(F.lit("sha256:"), sha(joined(path, source_sha)))


def chunk_id(revision: Column, version: str, ordinal: Column, start: Column, end: Column, content_sha: Column) -> Column:
    return F.concat(F.lit("sha256:"), sha(joined(revision, F.lit(version), ordinal, start, end, content_sha)))


def evidence_id(source_sha: Column, path: Column, start: Column, end: Column, content_sha: Column) -> Column:
    return F.concat(F.lit("evidence:sha256:"), sha(joined(source_sha, path, start, end, content_sha)))


def batch_id(purpose: str, round_: Column, ordinal: Column, ids: Column) -> Column:
    return sha(joined(F.lit(purpose), round_, ordinal, F.array_join(ids, "|")))


def result_id(batch: Column) -> Column:
    return sha(joined(F.lit("result"), batch))


def canonical(**fields: Column) -> Column:
    """Compact JSON with sorted keys and kept nulls."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"})


def claim_id(kind: Column, statement: Column, evidence: Column, preconditions: Column, commands: Column, warnings: Column) -> Column:
    body = canonical(kind=kind, statement=statement, evidence_ids=evidence, preconditions=preconditions, commands=commands, warnings=warnings)
    return F.concat(F.lit("claim:sha256:"), sha(body))


def draft_id(evidence: Column, index: Column, kind: Column, statement: Column, preconditions: Column, commands: Column, warnings: Column) -> Column:
    body = canonical(evidence_id=evidence, index=index, kind=kind, statement=statement, preconditions=preconditions, commands=commands, warnings=warnings)
    return F.concat(F.lit("draft:sha256:"), sha(body))


def web_source_id(url: Column) -> Column:
    return F.concat(F.lit("web:sha256:"), sha(url))

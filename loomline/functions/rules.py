"""Predicates and arithmetic rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
SUFFIXES = [".csv", ".html", ".ini", ".json", ".md", ".rst", ".toml", ".txt", ".xml", ".yaml", ".yml"]
ID_PATTERNS = {
    "job": r"^job-[0-9a-f]{32}$",
    "sha256": r"^[0-9a-f]{64}$",
    "task": r"^[a-z0-9][a-z0-9-]{1,62}[a-z0-9]$",
    "commit": r"^[0-9a-f]{40}$",
    "run": r"^[a-z0-9][a-z0-9._-]{1,62}[a-z0-9]$",
    "runner": r"^runner-[0-9a-f]{32}$",
    "generation": r"^generation-[0-9a-f]{32}$",
    "model": r"^[A-Za-z0-9][A-Za-z0-9._-]{0,95}/[A-Za-z0-9][A-Za-z0-9._-]{0,95}$",
}


def is_id(c: Column, kind: str) -> Column:
    return c.rlike(ID_PATTERNS[kind])


def safe_path(path: Column) -> Column:
    """Relative, not empty, no backslash or NUL, no parent step."""
    bad = (path == "") | path.contains("\\") | path.contains("\u0000") | path.startswith("/") | F.exists(F.split(path, "/"), lambda p: p == "..")
    return ~bad


def safe_output(path: Column) -> Column:
    """A safe path without a step that stays in place, of a Markdown file."""
    return safe_path(path) & ~F.exists(F.split(path, "/"), lambda p: p == ".") & F.lower(path).endswith(".md")


def supported(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1)).isin(SUFFIXES)


def inside(path: Column, root: Column) -> Column:
    return (path == root) | path.startswith(F.concat(root, F.lit("/")))


def overlapping(a: Column, b: Column) -> Column:
    return inside(a, b) | inside(b, a)


def host(url: Column) -> Column:
    """Lower-case host of a web address, without user, password and port."""
    return F.lower(F.regexp_extract(url, r"^https?://(?:[^/?#]*@)?([^/:?#@]+)", 1))


def on_list(host_: Column, domains: list[str]) -> Column:
    """Equal to a listed domain or below it."""
    out = F.lit(False)
    for d in domains:
        out = out | (host_ == d) | host_.endswith("." + d)
    return out


def search_result_ok(url: Column, title: Column, content: Column) -> Column:
    return url.startswith("https://") & (F.length(F.trim(title)) > 0) & (F.length(F.trim(content)) > 0)


def capacity(context: Column, prompt: Column, output: Column, reserved: Column, ratio: Column) -> Column:
    """Tokens left for content: the window less prompt, output and reserve, or the ratio less the prompt."""
    return F.least(context - prompt - output - reserved, F.floor(context * ratio) - prompt)


def output_budget(most: Column, context: Column) -> Column:
    return F.least(most, F.floor(context / 2))


def percent(base: float, span: float, done: Column, total: Column) -> Column:
    return (F.lit(base) + F.bround(F.lit(span) * done / total)).cast("long")


def memory_need(size_bytes: Column) -> Column:
    return F.floor(size_bytes * 1.2).cast("long") + F.lit(4 * 1024**3)


def fit_label(size_bytes: Column, physical: Column, platform_ok: Column) -> Column:
    """How a model fits in memory: up to 70 % and up to 85 % of it."""
    share = memory_need(size_bytes) / physical
    return F.when(~platform_ok, "UNSUPPORTED").when(size_bytes.isNull(), "UNKNOWN").when(share <= 0.70, "SUPPORTED").when(share <= 0.85, "TIGHT").otherwise("TOO_LARGE")


# Names and ends of names of fields that are never logged.
HIDDEN_NAMES = ["api_key", "authorization", "auth_token", "completion", "model_output", "password", "prompt", "prompt_text", "runner_token", "secret", "source_text"]
HIDDEN_ENDS = ["_api_key", "_auth_token", "_password", "_secret"]


def redacted(name: Column, value: Column) -> Column:
    """Values of fields whose names tell of secrets or content are masked; case does not matter."""
    folded = F.lower(name)
    hidden = folded.isin(HIDDEN_NAMES)
    for end in HIDDEN_ENDS:
        hidden = hidden | folded.endswith(end)
    return F.when(hidden, F.lit("[REDACTED]")).otherwise(value)


def health(age_seconds: Column, lifecycle: Column, start_limit: int = 30, stale_limit: int = 15) -> Column:
    """Liveness of a runner from the age of its last sign."""
    return (
        F.when(lifecycle == "EXITED", "EXITED")
        .when(lifecycle == "FAILED", "FAILED")
        .when(lifecycle == "LAUNCHING", F.when(age_seconds <= start_limit, "STARTING").otherwise("STALE"))
        .otherwise(F.when(age_seconds <= stale_limit, "HEALTHY").otherwise("STALE"))
    )


def verdict(ok: Column, bad: Column) -> Column:
    return F.when(ok, "CONFIRMED").when(bad, "CONTRADICTED").otherwise("INCONCLUSIVE")

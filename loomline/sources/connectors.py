"""Python Data Sources: the local model cache, a model hub and a web search.

The last two talk to a client object that the caller registers; there is none by default, so a
read without it gives no rows (search) or an error (hub).  Clients are sent to the task that
reads, one task a query.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

MODEL = "model_id string, revision string, cached boolean, size_bytes long, quantization string, context_tokens long, modified_at double, local_path string"
RESULT = "query_id string, pos long, url string, title string, content string, published_date string, error string"
# Fixed value: how a cached repository's folder is named.
_REPOSITORY = re.compile(r"^models--([^/]+?)--(.+)$")


class _Rows(DataSourceReader):
    def __init__(self, make: Callable[[str], Iterator[tuple]], keys: list[str]):
        self.make, self.keys = make, keys

    def partitions(self):
        return [InputPartition(k) for k in self.keys]

    def read(self, partition):
        if partition is not None:
            yield from self.make(partition.value)


def _cached_models(folder: str) -> Iterator[tuple]:
    """Snapshots of one repository folder with what their files say."""
    root = Path(folder)
    named = _REPOSITORY.match(root.name)
    if not named:
        return
    for snapshot in sorted(p for p in (root / "snapshots").glob("*") if p.is_dir()):
        found = [p.stat() for p in snapshot.rglob("*") if p.is_file()]
        config = {}
        if (snapshot / "config.json").is_file():
            try:
                config = json.loads((snapshot / "config.json").read_text("utf-8"))
            except ValueError:
                config = {}
        bits = (config.get("quantization") or {}).get("bits") if isinstance(config.get("quantization"), dict) else None
        context = config.get("max_position_embeddings")
        yield (
            f"{named[1]}/{named[2]}",
            snapshot.name.lower(),
            True,
            sum(s.st_size for s in found) if found else None,
            f"{bits}-bit" if isinstance(bits, int) else None,
            context if isinstance(context, int) and context > 0 else None,
            max((s.st_mtime for s in found), default=0.0),
            str(snapshot),
        )


class ModelCache(DataSource):
    """``spark.read.format("model_cache").load(folder)``: one row for each cached snapshot."""

    @classmethod
    def name(cls):
        return "model_cache"

    def schema(self):
        return MODEL

    def reader(self, schema):
        root = Path(self.options["path"].removeprefix("file://"))
        return _Rows(_cached_models, sorted(str(p) for p in root.glob("models--*") if p.is_dir()))


class ModelHub(DataSource):
    """``format("model_hub")`` with ``query`` (and ``limit`` 1 to 100) or ``model_id`` and ``revision``."""

    client: Callable | None = None

    @classmethod
    def name(cls):
        return "model_hub"

    def schema(self):
        return MODEL

    def reader(self, schema):
        client = self.client
        if client is None:
            raise ValueError("MODEL_HUB_UNAVAILABLE")
        o = dict(self.options)
        limit = int(o.get("limit", 20))
        if not 1 <= limit <= 100:
            raise ValueError("limit must be 1 to 100")
        exact = o.get("model_id")

        def rows(query: str) -> Iterator[tuple]:
            found = client(query=query, exact=bool(exact), limit=limit)
            for m in list(found)[:limit]:
                if exact and (m["model_id"], m["revision"]) != (exact, o.get("revision")):
                    raise ValueError("MODEL_SELECTION_INVALID")
                yield (m["model_id"], m["revision"], False, m.get("size_bytes"), m.get("quantization"), m.get("context_tokens"), m.get("modified_at"), None)

        return _Rows(rows, [exact or o.get("query", "")])


class WebSearch(DataSource):
    """``format("web_search")`` with ``queries`` (a JSON list) and ``limit`` 1 to 10; without a client, no rows.

    A search that fails gives one row with its ``error`` and no position; one without results gives none.
    """

    client: Callable | None = None

    @classmethod
    def name(cls):
        return "web_search"

    def schema(self):
        return RESULT

    def reader(self, schema):
        client = self.client
        limit = int(self.options.get("limit", 5))
        if not 1 <= limit <= 10:
            raise ValueError("limit must be 1 to 10")
        queries = json.loads(self.options.get("queries", "[]"))

        def rows(query: str) -> Iterator[tuple]:
            try:
                found = list(client(query, limit))[:limit]
            except Exception as e:
                yield (query, None, None, None, None, None, f"{type(e).__name__}: {e}"[:500])
                return
            for k, r in enumerate(found):
                yield (query, k, r.get("url"), r.get("title"), r.get("content"), r.get("published_date"), None)

        return _Rows(rows, queries if client else [])


def register(spark: SparkSession, **clients: Callable) -> None:
    """Make the three formats known; ``model_hub=`` and ``web_search=`` set their clients, which go to the workers with the format."""
    for source in (ModelCache, ModelHub, WebSearch):
        client = clients.get(source.name())
        bound = source if client is None else type(source.__name__ + "WithClient", (source,), {"client": staticmethod(client)})
        spark.dataSource.register(bound)

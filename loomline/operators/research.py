"""Web research, catalogues and quality measures."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from ..functions import ids, rules, text


def claim_score(kind: Column, statement: Column, in_conflict: Column, has_commands: Column) -> Column:
    """100 for a conflict, 40 for a sign of freshness, 20 for some kinds, 5 for commands."""
    one = lambda c, n: F.when(c, n).otherwise(0)
    return one(in_conflict, 100) + one(text.is_fresh(statement), 40) + one(kind.isin("WARNING", "PREREQUISITE", "FACT"), 20) + one(has_commands, 5)


def select_claims(claims: DataFrame, k: int = 8) -> DataFrame:
    """Top 2k claims by ``score``, less the sensitive ones, then the first k."""
    order = [F.desc("score"), F.desc(F.length("statement")), F.col("claim_id")]
    asks = (query_text(F.col("statement")) != "") & ~text.is_sensitive(F.col("statement"))
    return claims.orderBy(*order).limit(2 * k).where(asks).orderBy(*order).limit(k)


def query_text(statement: Column) -> Column:
    """What is searched for: the statement without addresses (empty if nothing else is said)."""
    return F.substring(text.strip(F.regexp_replace(statement, r"https?://\S+", "")), 1, 500)


def sources_by_url(results: DataFrame) -> DataFrame:
    """One source per URL: first title by position, distinct claims in order."""
    from .tasks import ordered_unique

    g = results.groupBy("url").agg(F.min_by("title", "pos").alias("title"), ordered_unique(F.col("pos"), F.col("claim_id")).alias("claim_ids"))
    return g.withColumn("source_id", ids.web_source_id(F.col("url")))


def report_for(assessments: DataFrame, sources: DataFrame, claims: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The part of a report that belongs to some claims, with only the sources it names."""
    a = assessments.join(claims.select("claim_id"), "claim_id", "left_semi")
    named = a.select(F.explode("source_ids").alias("source_id")).distinct()
    return a, sources.join(named, "source_id", "left_semi")


def histogram(rows: DataFrame, column: str, kinds: list) -> DataFrame:
    return rows.agg(*[F.count(F.when(F.col(column) == k, 1)).alias(f"n_{str(k).lower()}") for k in kinds])


def resolve_citations(citations: DataFrame, paths: DataFrame) -> DataFrame:
    """``citation`` to ``path``: the exact path, else the only one with that base name, else null."""
    c = citations.withColumn("wanted", text.citation_base(F.col("citation")))
    exact = paths.select(F.col("path").alias("wanted"), F.col("path").alias("exact")).distinct()
    by_name = paths.select("path").distinct().groupBy(text.basename(F.col("path")).alias("name")).agg(F.count("*").alias("n"), F.min("path").alias("only")).where("n = 1")
    j = c.join(exact, "wanted", "left").withColumn("name", text.basename(F.col("wanted"))).join(by_name.select("name", "only"), "name", "left")
    return j.withColumn("path", F.coalesce("exact", "only")).drop("exact", "only", "wanted", "name")


def catalogue(remote: DataFrame, local: DataFrame) -> DataFrame:
    """Remote models with what is cached of them; local-only models too."""
    r = remote.join(local.select("model_id", "revision", F.lit(True).alias("cached"), F.col("size_bytes").alias("local_size")), ["model_id", "revision"], "left")
    return r.withColumns({"cached": F.coalesce("cached", F.lit(False)), "size_bytes": F.coalesce("local_size", "size_bytes")}).drop("local_size")


def search(models: DataFrame, column: str, query: str, order: list[Column], limit: int) -> DataFrame:
    """Case-folded substring search of 1 to 100 rows."""
    if not 1 <= limit <= 100:
        raise ValueError("limit must be 1 to 100")
    return models.where(F.contains(text.fold(F.col(column)), text.fold(F.lit(query)))).orderBy(*order).limit(limit)


def compatibility(models: DataFrame, physical: int) -> DataFrame:
    return models.withColumn("compatibility", rules.fit_label(F.col("size_bytes"), F.lit(physical), F.col("platform_ok")))


def _literal_groups(literals: DataFrame, columns: list[str], most_bytes: int) -> Iterator[list[Row]]:
    """The rows of ``literals`` in parts of about ``most_bytes`` at most, by hash."""
    n, size = literals.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("literal") + 64), F.lit(0))).first()
    groups = -(-int(size) * 3 // (2 * most_bytes)) or 1
    for g in range(groups if n else 0):
        mine = literals if groups == 1 else literals.where(F.pmod(F.xxhash64("literal"), F.lit(groups)) == g)
        if rows := mine.select(*columns).collect():
            yield rows


def _arrow(kind: str) -> pa.DataType:
    """The Arrow type of an id column."""
    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]


_automata: dict[bytes, object] = {}


def _automaton(literals: list[str]):
    """An Aho-Corasick automaton that gives places in ``literals``; a worker builds it once."""
    import ahocorasick

    key = hashlib.sha256("\0".join(literals).encode("utf-8", "surrogatepass")).digest()
    if key not in _automata:
        _automata.clear()
        found = _automata[key] = ahocorasick.Automaton()
        for i, x in enumerate(literals):
            found.add_word(x, i)
        found.make_automaton()
    return _automata[key]


def _places(literals: list[str]):
    """For a text: the ends of each literal's occurrences (several literals at one place included)."""

    def of(x: str) -> Iterator[tuple[int, int]]:
        return ((i, end + 1) for end, i in _automaton(literals).iter(x))

    return of


def literal_hits(documents: DataFrame, key: str, column: str, literals: DataFrame, most_bytes: int = 16 << 20, fold: Callable[[Column], Column] = text.fold) -> DataFrame:
    """Literals (``item_id, literal``) that whole documents contain, whatever the case: rows ``key, item_id``.

    Each row of ``literals`` counts, so an item with two literals in a document, or one given
    twice, comes twice.  ``fold`` is what both sides are compared in.

    One pass over the texts for every ``most_bytes`` of literals, in time linear in the texts: an
    automaton of all literals at once reads each text from left to right.  Empty literals are in
    no text, null texts hold none.
    """
    lit = literals.select("item_id", fold(F.col("literal")).alias("literal")).where("literal <> ''").groupBy("literal").agg(F.collect_list("item_id").alias("items"))
    kinds = dict(documents.dtypes)[key], dict(literals.dtypes)["item_id"]
    schema = f"`{key}` {kinds[0]}, item_id {kinds[1]}"
    d = documents.select(F.col(key), fold(F.col(column)).alias("x")).where("x is not null")
    out = documents.sparkSession.createDataFrame([], schema)
    for rows in _literal_groups(lit, ["literal", "items"], most_bytes):
        words, items = [r["literal"] for r in rows], [r["items"] for r in rows]

        def run(batches, words=words, items=items):
            places = _places(words)
            for b in batches:
                at, found = [], []
                for i, x in enumerate(b.column("x").to_pylist()):
                    mine = [item for k in {k for k, _ in places(x)} for item in items[k]]
                    at += [i] * len(mine)
                    found += mine
                yield pa.RecordBatch.from_arrays([b.column(key).take(pa.array(at, pa.int64())), pa.array(found, _arrow(kinds[1]))], names=[key, "item_id"])

        out = out.unionByName(d.mapInArrow(run, schema))
    return out


def _unqualified(x: str, needle: str, qualifiers: list[str], window: int, starts: Iterable[int]) -> int:
    """How many occurrences, none overlapping the one before, have no qualifier within the window."""
    free = n = 0
    for s in starts:
        if s >= free:
            free = s + len(needle)
            around = x[max(0, s - window) : free + window]
            n += not any(q in around for q in qualifiers)
    return n


def qualified(x: Column, literal: Column, qualifiers: list[str], window: int = 240) -> Column:
    """Whether every occurrence of a literal, whatever the case, has a qualifier within ``window`` characters on either side or in itself.

    Without qualifiers: whether there is no occurrence.  An empty literal does not occur.
    """
    low = [q.casefold() for q in qualifiers]

    @F.pandas_udf("boolean")
    def judge(texts: pd.Series, needles: pd.Series) -> pd.Series:
        def one(t: str | None, needle: str | None) -> bool | None:
            if t is None or needle is None:
                return None
            starts = (m.start() for m in re.finditer(re.escape(needle), t)) if needle else ()
            return not _unqualified(t, needle, low, window, starts)

        return pd.Series([one(*r) for r in zip(texts, needles)], dtype=object)

    return judge(text.fold(x), text.fold(literal))


def unqualified_literals(documents: DataFrame, key: str, column: str, controls: DataFrame, window: int = 240, most_bytes: int = 16 << 20) -> DataFrame:
    """``key, control_id, literal, failures``: literals that documents hold without a qualifier near them, and how often.

    ``controls``: ``control_id, literal, qualifiers`` (without any, every occurrence counts).
    Occurrences of one literal are taken from left to right and do not overlap; all literals are
    looked for in one pass over a text.
    """
    lit = controls.select("control_id", F.col("literal").alias("named"), text.fold(F.col("literal")).alias("literal"), F.transform("qualifiers", text.fold).alias("qualifiers")).where("literal <> ''")
    kinds = dict(documents.dtypes)[key], dict(controls.dtypes)["control_id"]
    schema = f"`{key}` {kinds[0]}, control_id {kinds[1]}, literal string, failures long"
    d = documents.select(F.col(key), text.fold(F.col(column)).alias("x")).where("x is not null")
    out = documents.sparkSession.createDataFrame([], schema)
    for rows in _literal_groups(lit, ["control_id", "named", "literal", "qualifiers"], most_bytes):
        words = sorted({r["literal"] for r in rows})
        by_word = {w: [(r["control_id"], r["named"], r["qualifiers"] or []) for r in rows if r["literal"] == w] for w in words}

        def run(batches, words=words, by_word=by_word):
            places = _places(words)
            for b in batches:
                found = []
                for i, x in enumerate(b.column("x").to_pylist()):
                    starts: dict[int, list[int]] = {}
                    for k, end in places(x):
                        starts.setdefault(k, []).append(end - len(words[k]))
                    for k, at in starts.items():
                        for control, named, qualifiers in by_word[words[k]]:
                            if n := _unqualified(x, words[k], qualifiers, window, at):
                                found.append((i, control, named, n))
                at, *cols = zip(*found) if found else ((), (), (), ())
                kinds_ = (_arrow(kinds[1]), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(key).take(pa.array(at, pa.int64())), *(pa.array(c, t) for c, t in zip(cols, kinds_))], names=[key, "control_id", "literal", "failures"])

        out = out.unionByName(d.mapInArrow(run, schema))
    return out


def recall(required: DataFrame, hits: DataFrame, key: str) -> DataFrame:
    """Share of required literals found, and leaks, per document."""
    return hits.groupBy(key).agg(F.countDistinct("item_id").alias("found")).withColumn("recall", F.round(F.col("found") / F.lit(float(max(1, required.count()))), 4))


def binary_metrics(rows: DataFrame, truth: str, predicted: str, *group: str) -> DataFrame:
    """Confusion counts, precision, recall and F1."""
    n = lambda t, p: F.count(F.when((F.col(truth) == t) & (F.col(predicted) == p), 1))
    g = rows.groupBy(*group).agg(n(1, 1).alias("tp"), n(0, 1).alias("fp"), n(1, 0).alias("fn"), n(0, 0).alias("tn"))
    ratio = lambda a, b: F.when(b > 0, F.round(a / b, 6))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return g.withColumns({"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn)})


def search_results(results: DataFrame, most: int = 10) -> DataFrame:
    """Valid results ``url, title, content, published_date`` of a query (``query_id, pos``), trimmed and cut, at most ``most`` (1 to 10) each."""
    if not 1 <= most <= 10:
        raise ValueError("limit must be 1 to 10")
    strip = lambda c: text.strip(F.col(c))
    ok = results.where(F.coalesce(rules.search_result_ok(F.col("url"), strip("title"), strip("content")), F.lit(False)))
    rn = F.row_number().over(Window.partitionBy("query_id").orderBy("pos"))
    cut = {"title": F.substring(strip("title"), 1, 500), "snippet": F.substring(strip("content"), 1, 4000), "published_date": F.substring("published_date", 1, 100)}
    return ok.withColumn("rn", rn).where(F.col("rn") <= most).withColumns(cut).select("query_id", "pos", "url", "title", "snippet", "published_date")


def answered(claims: DataFrame, responses: DataFrame) -> DataFrame:
    """Claims with the response of the same ordinal; both lists must be as long as each other."""
    j = claims.join(responses, "ordinal", "full_outer")
    return j.withColumn("error", F.when(F.col("claim_id").isNull() | F.col("response").isNull(), "LENGTH"))


def folder_sizes(folders: DataFrame, files: DataFrame) -> DataFrame:
    """Bytes of each folder's files; null where there are none, as for a model whose files are unknown."""
    return folders.join(files.groupBy("folder").agg(F.sum("byte_count").alias("size_bytes")), "folder", "left")

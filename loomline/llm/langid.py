"""Language ID by rank-order n-gram profiles (Cavnar and Trenkle, 1994).

A profile lists the most frequent character 1- to 3-grams in order.  A document gets the
language whose profile has the least out-of-place distance to the document's own list;
an n-gram that a profile lacks counts ``top`` places.  N-grams are hashed to 20 bits; all
but letters counts as one gap between words.

Null text, empty text and text without letters: ``und`` with score 0.  Null languages
take no part in learning.  No learned language: ``und``.  Ties go to the language that
sorts first, ties between n-grams to the lesser code.  Very long texts are read whole.
Repeated rows are each predicted; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BITS = 20
SPAN = 1 << BITS


@cache
def _letters() -> np.ndarray:
    """For each code point: itself if a letter, else 0."""
    x = np.arange(0x110000, dtype=np.uint32)
    is_letter = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return np.where(is_letter, x, 0).astype(np.uint32)


def grams(text: str) -> np.ndarray:
    """Hashed 1-, 2- and 3-grams of a text, in any order, with repeats."""
    cp = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    cp = _letters()[cp]
    cp = np.concatenate([[np.uint32(0)], cp, [np.uint32(0)]])
    cp = cp[(cp != 0) | np.append(True, cp[:-1] != 0)]  # one gap between words
    if len(cp) < 3:
        return np.empty(0, np.uint32)
    m = np.uint32(0x9E3779B1)
    one = cp * np.uint32(0x85EBCA6B)
    two = (one[:-1] ^ (cp[1:] + np.uint32(77))) * m
    three = (two[:-1] ^ (cp[2:] + np.uint32(1234567))) * m
    return np.concatenate([(one >> 12)[cp != 0], two >> 12, three >> 12])


def ranked(codes: np.ndarray, top: int) -> np.ndarray:
    """The ``top`` most frequent codes, most frequent first, ties by code."""
    if len(codes) < 20_000:
        kinds, n = np.unique(codes, return_counts=True)
    else:
        n = np.bincount(codes, minlength=SPAN)
        kinds = np.flatnonzero(n)
        n = n[kinds]
    return kinds[np.argsort(-n, kind="stable")[:top]]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    by: dict[str, np.ndarray] = {}
    held: dict[str, list[np.ndarray]] = {}

    def add(lang: str) -> None:
        if parts := held.pop(lang, None):
            by[lang] += np.bincount(np.concatenate(parts), minlength=SPAN)

    def out() -> Iterator[pa.RecordBatch]:
        for lang, n in by.items():
            add(lang)
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int64)), pa.array(n[at])], names=["lang", "code", "n"])
        by.clear()

    for b in batches:
        for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist()):
            if len(by) >= 16 and lang not in by:
                yield from out()
            if lang not in by:
                by[lang] = np.zeros(SPAN, np.int64)
            mine = held.setdefault(lang, [])
            mine.append(grams(text))
            if len(mine) >= 64:
                add(lang)
    yield from out()


def learn(docs: DataFrame, top: int = 300) -> dict[str, list[int]]:
    """Profiles of all non-null ``lang`` values over every given text, ``top`` codes each."""
    counts = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("lang", "text").mapInArrow(_count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "code")
    rows = counts.withColumn("r", F.row_number().over(order)).where(F.col("r") <= top).orderBy("lang", "r").collect()  # top codes a language
    out: dict[str, list[int]] = {}
    for r in rows:
        out.setdefault(r["lang"], []).append(r["code"])
    return out


def table(profiles: list[list[int]], top: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted codes of all profiles, and their place in each (``top``: not there); one more column is for other codes."""
    codes = np.unique(np.concatenate([*(np.asarray(p, np.int64) for p in profiles), np.empty(0, np.int64)]))
    places = np.full((len(profiles), len(codes) + 1), top, np.int32)
    for i, p in enumerate(profiles):
        places[i, np.searchsorted(codes, p)] = np.arange(len(p))
    return codes, places


def distances(ranked_codes: np.ndarray, codes: np.ndarray, places: np.ndarray, top: int) -> np.ndarray:
    """Out-of-place distance of a ranked list to each language, as a share of the most possible."""
    at = np.searchsorted(codes, ranked_codes)
    there = np.append(codes, -1)[at] == ranked_codes
    place = places[:, np.where(there, at, len(codes))]
    gap = np.where(place >= top, top, np.abs(place - np.arange(len(ranked_codes))))
    return gap.sum(1) / (top * max(1, len(ranked_codes)))


def predict(docs: DataFrame, profiles: dict[str, list[int]], keep: list[str], top: int = 300) -> DataFrame:
    """``keep``, ``lang_pred``, ``score`` (how much nearer the best is than the next) and ``distance``."""
    langs = sorted(profiles)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, places = table([profiles[lang] for lang in langs], top)
        for b in batches:
            pred, score, far = [], [], []
            for text in b.column("text").to_pylist():
                c = grams(text) if text else np.empty(0, np.uint32)
                if not len(c) or not langs:
                    pred.append("und"), score.append(0.0), far.append(1.0)
                    continue
                d = distances(ranked(c, top), codes, places, top)
                best = int(d.argmin())
                rest = np.delete(d, best).min() if len(langs) > 1 else 1.0
                pred.append(langs[best]), far.append(float(d[best]))
                score.append(float(min(1.0, max(0.0, 1 - d[best] / rest if rest else 0.0))))
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in keep), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(far, pa.float64())], names=[*keep, "lang_pred", "score", "distance"])

    d = docs.select(*keep, *[c for c in ["text"] if c not in keep])
    return d.mapInArrow(run, ", ".join(f"`{n}` {t}" for n, t in d.select(*keep).dtypes) + ", lang_pred string, score double, distance double")

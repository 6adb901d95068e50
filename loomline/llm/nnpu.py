"""Non-negative positive-unlabelled learning of a linear text classifier.

The risk of Kiryo et al. (2017) is minimised with the logistic loss::

    prior * R_P(+1)  +  max(0, R_U(-1) - prior * R_P(-1))

``P`` are trusted positives, ``U`` is text taken without its labels, and ``prior`` is the
estimated share of positives in ``U``.  Where the second part falls below zero its
gradient is reversed.  The prior comes from ``P`` and ``U`` alone, too (``estimate_prior``);
labelled negatives are used nowhere.  Features: presence of hashed word parts, chosen by how
differently ``P`` and ``U`` use them.  Kind ``words`` takes parts of words; kind ``all``
takes also what is no word character in a token, and binned style figures of the whole text.

Fitting takes a bounded sample (``max_positive``, ``max_unlabelled``); scoring runs over
every whole text.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, settle, thinned

SPACE_BITS = 20
N_STYLE, N_BINS = 10, 12
_letters = re.compile(r"[^\W\d_]+")
_residue = re.compile(r"[\w\s]+")
_PUNCT = ".,;:!?\"'()[]{}-"


def _h(s: str) -> int:
    return zlib.crc32(s.encode("utf-8", "surrogatepass")) & ((1 << SPACE_BITS) - 1)


def word_parts(token: str) -> list[int]:
    """Hashed parts of a token's letter runs: the whole, its first four and five and last four letters."""
    t = token.lower()
    if t.isalpha():
        runs = [t]
    else:
        t = t.strip(_PUNCT)
        runs = [t] if t.isalpha() else _letters.findall(t)
    out = []
    for w in runs:
        out.append(_h("w" + w))
        if len(w) > 4:
            out += [_h("4" + w[:4]), _h("e" + w[-4:])]
            if len(w) > 5:
                out.append(_h("5" + w[:5]))
    return out


def mark_parts(token: str) -> list[int]:
    """The hash of what is no word character in a token."""
    if token.isalnum():
        return []
    mark = _residue.sub("", token)
    return [_h("m" + mark)] if mark else []


PARTS = {"words": word_parts, "all": lambda token: word_parts(token) + mark_parts(token)}


def style(text: str, tokens: list[str], distinct: int) -> list[int]:
    """``N_STYLE`` binned figures of a text (bins 0..N_BINS-1)."""
    n, chars = len(tokens), max(1, len(text))
    if not n:
        return [0] * N_STYLE
    raw = text.encode("utf-8", "surrogatepass")
    a = np.frombuffer(raw, np.uint8)
    count = np.bincount(a, minlength=256)
    upper, lower = int(count[65:91].sum()), int(count[97:123].sum())
    digits = int(count[48:58].sum())
    marks = int(count[33:48].sum() + count[58:65].sum() + count[91:97].sum() + count[123:127].sum())
    top_mark = int(max(count[33:48].max(), count[58:65].max(), count[91:97].max(), count[123:127].max()))
    same = sum(map(str.__eq__, tokens, tokens[1:]))
    lines = text.split("\n")
    part = lambda x: 0 if x <= 0 else min(N_BINS - 1, 1 + int(10 * x**0.5))
    return [
        min(N_BINS - 1, int(math.log2(n + 1))),
        part(upper / max(1, upper + lower)),
        part(digits / chars),
        part(marks / chars),
        part(top_mark / chars),
        part(same / n),
        part(distinct / n),
        min(N_BINS - 1, int(chars / n)),
        part(1 - len(set(lines)) / len(lines)),
        min(N_BINS - 1, int(2 * math.log2(1 + n / len(lines)) / 1.5)),
    ]


def _texts(batch: pa.RecordBatch) -> list[str]:
    return [t or "" for t in batch.column("text").to_pylist()]


def _count_features(kind: str):
    parts = PARTS[kind]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((2, 1 << SPACE_BITS), np.int32)
        for b in batches:
            for text, pos in zip(_texts(b), b.column("is_p").to_pylist()):
                got: set[int] = set()
                for t in set(text.split()):
                    got.update(parts(t))
                if got:
                    n[int(pos), np.fromiter(got, np.int64, len(got))] += 1
        at = np.flatnonzero(n.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[1, at].astype(np.int64)), pa.array(n[0, at].astype(np.int64))], names=["f", "p", "u"])

    return count


class Extractor:
    """Selected features of texts; words are looked up in a bounded cache."""

    def __init__(self, selected: dict[int, int], kind: str):
        self.selected, self.kind, self.cache = selected, kind, {}

    def __call__(self, text: str) -> list[int]:
        """Column numbers: selected parts, then (kind ``all``) one for each style figure."""
        tokens = text.split()
        words, cache, got, parts = set(tokens), self.cache, set(), PARTS[self.kind]
        for t in words:
            f = cache.get(t)
            if f is None:
                if len(cache) > 300_000:
                    cache.clear()
                f = cache[t] = tuple({self.selected[x] for x in parts(t) if x in self.selected})
            if f:
                got.update(f)
        if self.kind == "words":
            return sorted(got)
        base = len(self.selected)
        return sorted(got) + [base + i * N_BINS + b for i, b in enumerate(style(text, tokens, len(words)))]


@dataclass
class Model:
    kind: str
    selected: dict[int, int]
    weights: np.ndarray
    bias: float
    prior: float

    def scorer(self, names: list[str]):
        """A function for ``mapInArrow``: the named columns and ``score`` of ``text``."""
        kind, selected, weights, bias = self.kind, self.selected, self.weights, self.bias

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ex = Extractor(selected, kind)
            for b in batches:
                z = np.array([weights[np.asarray(ex(t), np.int64)].sum() for t in _texts(b)], float) + bias
                s = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
                yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(s, pa.float64())], names=[*names, "score"])

        return score


def _collect_rows(selected: dict[int, int], kind: str):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ex = Extractor(selected, kind)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("is_p"), pa.array([ex(t) for t in _texts(b)], pa.list_(pa.int32()))], names=["key", "is_p", "f"])

    return rows


class Sample:
    """Feature lists of texts as flat columns and rows."""

    def __init__(self, texts: list, width: int):
        self.n, self.width = len(texts), width
        self.flat = np.concatenate([np.asarray(x, np.int64) for x in texts]) if texts else np.empty(0, np.int64)
        self.row = np.repeat(np.arange(len(texts)), [len(x) for x in texts])

    def scores(self, w: np.ndarray, b: float) -> np.ndarray:
        return np.bincount(self.row, w[self.flat], self.n) + b

    def back(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.flat, g[self.row], self.width)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def _descend(p: Sample, u: Sample, slopes, rounds: int, rate: float, decay: float) -> tuple[np.ndarray, float]:
    """Full-batch Adam; ``slopes`` gives the risk's derivatives by the scores of ``p`` and ``u``."""
    w, b = np.zeros(p.width), 0.0
    m, v = np.zeros(p.width + 1), np.zeros(p.width + 1)
    for t in range(1, rounds + 1):
        gp, gu = slopes(p.scores(w, b), u.scores(w, b))
        g = np.append(p.back(gp) + u.back(gu) + decay * w, gp.sum() + gu.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        w -= step[:-1]
        b -= step[-1]
    return w, b


def minimise(p: list, u: list, width: int, prior: float, rounds: int, rate: float = 0.05, decay: float = 2e-5) -> tuple[np.ndarray, float]:
    """Weights and bias of the least non-negative risk (deterministic)."""
    p, u = Sample(p, width), Sample(u, width)

    def slopes(zp, zu):
        sp, su = _sigmoid(zp), _sigmoid(zu)
        rest = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        if rest >= 0:
            return prior * (sp - 1) / p.n - prior * sp / p.n, su / u.n
        return prior * sp / p.n, -su / u.n

    return _descend(p, u, slopes, rounds, rate, decay)


def estimate_prior(p: list, u: list, width: int, rounds: int = 100) -> float:
    """Share of positives in ``u``, from positives and unlabelled texts alone.

    Above any threshold of a score, ``u`` holds at least the prior times what ``p`` holds; the
    least such ratio bounds the prior from above and meets it where only positives score (Blanchard,
    Lee and Scott, 2010).  The score separates ``p`` from ``u``; each half of the sample is
    judged by the score fitted on the other.  Of the thresholds from low to high, the first is
    taken from which the ratio stays level while a tenth of ``p`` falls away (two standard
    errors): beyond it, positives that the sample has by chance make ratios too small.  If that
    says that positives are the rarer part, only high thresholds tell them apart from few
    texts, and the one with the least ratio plus two standard errors is taken.  As the
    ratio bounds the prior from above, the mean of both halves is lowered by its standard error.
    """
    found = []
    for k in (0, 1):
        fitted = [Sample(x[k::2], width) for x in (p, u)]
        judged = [Sample(x[1 - k :: 2], width) for x in (p, u)]
        if not all(x.n for x in fitted + judged):
            continue
        a, c = fitted
        w, b = _descend(a, c, lambda zp, zu: ((_sigmoid(zp) - 1) / (2 * a.n), _sigmoid(zu) / (2 * c.n)), rounds, 0.05, 1e-4)  # noqa: B023
        zp, zu = np.sort(judged[0].scores(w, b)), np.sort(judged[1].scores(w, b))
        at = np.quantile(zp, np.arange(0.01, 0.71, 0.01))
        fp, fu = (1 - np.searchsorted(z, at) / len(z) for z in (zp, zu))
        fp, fu = np.maximum(fp, 1 / len(zp)), np.maximum(fu, 1 / len(zu))
        ratio = fu / fp
        error = ratio * np.sqrt((1 - fp) / (fp * len(zp)) + (1 - fu) / (fu * len(zu)))
        level = (ratio[:-10] - ratio[10:] <= 2 * error[:-10]) & (ratio[:-10] + 2 * error[:-10] < 1)
        best = level.argmax()
        if not level.any() or ratio[best] < 0.5:
            best = (ratio + 2 * error).argmin()
        found.append((ratio[best], error[best]))
    if not found:
        return 0.5
    ratio, error = np.array(found).T
    return min(0.98, max(0.002, float(ratio.mean() - np.sqrt((error**2).sum()) / len(error))))


def fit(docs: DataFrame, labels: DataFrame, label: str, in_training, kind: str, seed: int = 7, max_positive: int = 6000, max_unlabelled: int = 12000, max_features: int = 6000, least_z: float = 3.5, rounds: int = 300, decay: float = 2e-4) -> Model:
    """Fit on training rows only.

    ``in_training(key)`` is the column that marks them.  ``max_positive`` and
    ``max_unlabelled`` bound the sample: ids are drawn, by hash, and each drawn id gives one text, so
    rows that repeat an id add nothing.  Of the labels only the positive ones are read.  No
    positive or no text at all: a constant model, whose score is 0.5.
    """
    constant = Model(kind, {}, np.zeros(N_STYLE * N_BINS), 0.0, 0.5)
    text = docs.where(F.col("doc_id").isNotNull() & in_training("doc_id")).select(F.col("doc_id").alias("key"), "text")
    trusted = labels.where((F.col(label) == 1) & F.col("doc_id").isNotNull() & in_training("doc_id")).select(F.col("doc_id").alias("key")).distinct()
    known = text.select("key").distinct()

    def drawn(ids: DataFrame, bound: int, seed: int, positive: bool) -> DataFrame:
        """About ``bound`` of the ids, each with one text: its least."""
        few = thinned(ids, "key", ids.count(), bound, seed)
        few = F.broadcast(few)  # about ``bound`` ids, whatever the input: only texts that are drawn are shuffled
        return text.join(few, "key", "left_semi").groupBy("key").agg(F.min("text").alias("text")).select("key", "text", F.lit(positive).alias("is_p"))

    positives = drawn(trusted.join(known, "key", "left_semi"), max_positive, seed, True)
    sample = settle(positives.unionByName(drawn(known, max_unlabelled, seed + 1, False)))
    size = {r["is_p"]: r["count"] for r in sample.groupBy("is_p").count().collect()}
    n_p, n_u = size.get(True, 0), size.get(False, 0)
    if not n_p or not n_u:
        return constant
    counts = sample.mapInArrow(_count_features(kind), "f long, p long, u long").groupBy("f").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))
    both = (F.col("p") + F.col("u") + 1) / F.lit(float(n_p + n_u))
    z = F.abs(F.col("p") / n_p - F.col("u") / n_u) / F.sqrt(both * F.greatest(F.lit(1e-9), 1 - both) * (1 / n_p + 1 / n_u))
    chosen = counts.where(F.col("p") + F.col("u") >= 4).withColumn("z", z).where(F.col("z") >= least_z).coalesce(4).orderBy(F.desc("z"), "f").limit(max_features).collect()
    selected = {int(r["f"]): i for i, r in enumerate(chosen)}
    width = len(selected) + N_STYLE * N_BINS
    rows = sample.mapInArrow(_collect_rows(selected, kind), "key long, is_p boolean, f array<int>").orderBy("is_p", "key").collect()
    ps, us = [r["f"] for r in rows if r["is_p"]], [r["f"] for r in rows if not r["is_p"]]
    forget(sample)
    prior = estimate_prior(ps, us, width)
    w, b = minimise(ps, us, width, prior, rounds, decay=decay)
    return Model(kind, selected, w, b, prior)


def score(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """``keep`` columns and ``score`` of every row; null text counts as empty."""
    d = docs.select(*keep, *[c for c in ["text"] if c not in keep])
    return d.mapInArrow(model.scorer(keep), ", ".join(f"`{n}` {t}" for n, t in d.select(*keep).dtypes) + ", score double")

"""Quality classifier: positive-unlabelled learning on words, marks and style figures.

Labels equal to 1 are the trusted positives; training text without labels is the rest.
Null text counts as empty; a null ``doc_id`` or label takes no part in fitting but the row
is scored.  Repeated rows are each scored; other columns of ``docs`` are ignored.  Without
any positive the score is 0.5.  ``max_positive`` and ``max_unlabelled`` (see ``nnpu.fit``)
bound the fitting sample.  Very long texts are read whole; a score equal to the threshold
counts as reaching it.  Empty ``documents`` or
``labels`` give a constant model and no row to score, or a score of 0.5 a row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import nnpu

KIND, ROUNDS, DECAY = "all", 2000, 2e-5


def fit_quality(docs: DataFrame, labels: DataFrame, in_training, label: str = "quality", **bounds) -> nnpu.Model:
    return nnpu.fit(docs, labels, label, in_training, KIND, **{"rounds": ROUNDS, "decay": DECAY} | bounds)


def score_quality(docs: DataFrame, model: nnpu.Model, keep: list[str], threshold: float = 0.5) -> DataFrame:
    """``keep``, ``score`` (0 to 1, higher is better) and ``predicted`` (score >= threshold)."""
    return nnpu.score(docs, model, keep).withColumn("predicted", (F.col("score") >= threshold).cast("int"))

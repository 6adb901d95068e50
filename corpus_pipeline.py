"""The corpus pipeline: quality, language, near duplicates, mixing, packing.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns a
DataFrame.  All but the last return the columns of ``documents``.  Rows with a null
``doc_id`` take part in every stage.  Empty input gives empty output.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.llm import langid, mixing, near_dup, packing, quality
from loomline.llm.common import copies, modest_batches, release, settle, table
from loomline.llm.queries import tokenizer_path

#: A text further than this share of the greatest distance from every learned language is none of them.
FARTHEST = 0.85


def _kept(docs: DataFrame, judge: Callable[[DataFrame, list[str]], DataFrame]) -> DataFrame:
    """Rows of ``docs`` that ``judge`` returns; other columns can't clash with what it adds."""
    modest_batches(docs.sparkSession)
    inside = [c if c == "text" else f"_c{i}" for i, c in enumerate(docs.columns)]
    out = judge(docs.toDF(*inside), inside)
    return out.select(*[F.col(i).alias(c) for i, c in zip(inside, docs.columns)])


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier predicts as good; null text counts as empty.

    Whole texts are read, however long; a score of exactly one half is good; repeated rows
    are judged alike; a null id is judged but not learned from.
    """
    model = quality.fit_quality(docs, table(spark, sf_dir, "labels"), lambda key: F.col(key).isNotNull())
    return _kept(docs, lambda d, names: quality.score_quality(d, model, names).where("predicted = 1"))


def keep_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language: those without letters (so null and empty text), or far from all profiles, go.

    Whole texts are read, however long; equal distances go to the language that sorts first;
    repeated rows are judged alike.
    """
    profiles = langid.learn(docs)
    return _kept(docs, lambda d, names: langid.predict(d, profiles, names).where((F.col("lang_pred") != "und") & (F.col("distance") <= FARTHEST)))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, 0.8): its least doc_id.

    Equal rows with one doc_id, or without any, count once.
    """
    found = near_dup.near_duplicates(docs, words=5, num=80, den=100)
    kept = found.where("kept").select(F.col("doc_id").alias("_kept")).distinct()
    left = docs.join(kept, docs["doc_id"].eqNullSafe(kept["_kept"]), "left_semi")
    again = found.where("kept").groupBy("doc_id").count().where("count > 1")
    return left if again.isEmpty() else left.dropDuplicates(["doc_id", "text"])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: one whole copy of a document for each pass that takes words of it, in shard order.

    Copies stand where the first of their blocks was drawn: shards are kept together, and
    inside a shard rows follow its local shuffle.  Documents without words (null, empty or
    blank text) are not drawn.  Repeated rows are drawn each for itself; a very long text is
    one row even if its blocks went to several shards.
    """
    row, shard, rank, at = (f"{c}{'_' * max(map(len, docs.columns))}" for c in ("row", "shard", "rank", "at"))  # longer than any name there
    # A row id, kept as a copy so that a row can be found again by it.
    rows = settle(docs.withColumn(row, F.monotonically_increasing_id()))
    mix = mixing.mix(rows.select(F.col(row).alias("doc_id"), "text", "source"))
    first = mix.segments().groupBy("doc_id", "pass").agg(F.min(F.struct("shard", "rank", "at")).alias("f"))
    places = first.select(F.col("doc_id").alias(row), F.col("f.shard").alias(shard), F.col("f.rank").alias(rank), F.col("f.at").alias(at))
    return rows.join(places, row).repartition(F.col(shard)).sortWithinPartitions(shard, rank, at).select(docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document packed into sequences of 4096 tokens; null text is one end id, longer texts are cut."""
    modest_batches(spark)
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("quality_classifier", keep_quality),
    ("language_id", keep_language),
    ("minhash_near_dedup", drop_near_duplicates),
    ("mix_to_weights", mix_sources),
    ("best_fit_packing", pack_sequences),
]

#: Learned classifiers, sampling and best-fit packing have no SQL form; tests hold them to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    since = copies()
    for _, stage in STAGES:
        df = settle(stage(spark, df, sf_dir))
        release(since, df)
    return df

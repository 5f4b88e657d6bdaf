"""A corpus from raw documents to token ids: five stages, each read from what the one before wrote.

Every stage takes (spark, docs, sf_dir) and returns a table; all but the last keep
the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrapanel.llm import decontamination, minhash, pieces, quality, toxicity
from terrapanel.llm.common import read, send_if_small
from terrapanel.session import cut_lineage, ensure_checkpoint_dir


def _text_keys() -> list[Column]:
    """Two hashes that stand for a text; NULL has its own."""
    return [F.xxhash64(F.lit(3), F.col("text")).alias("_ta"), F.xxhash64(F.lit(4), F.col("text")).alias("_tb")]


def _without(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text is not among the ``rejected`` keys, whatever their ids and other columns.

    A score follows from the text alone, so only its hash and its terms meet the
    scorer, and the row stays where it is.  The rejected keys are broadcast if
    their counted size allows, and shuffled with the rows otherwise.
    """
    rejected = send_if_small(cut_lineage(rejected.distinct()), F.lit(32))
    rows = docs.select(F.struct(*[F.col(f"`{n}`").alias(n) for n in docs.columns]).alias("_row"), *_text_keys())
    return rows.join(rejected, ["_ta", "_tb"], "left_anti").select("_row.*")


def _by_key(docs: DataFrame) -> DataFrame:
    return docs.select(F.struct(*_text_keys()).alias("_key"), F.col("text"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the factorization machine, learnt from the labelled ones among them, scores below one half.

    NULL and empty texts have the score of no terms; equal texts go or stay together;
    of a very long text only its distinct terms are weighed; an empty table, or one
    without labels, loses nothing.
    """
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"))
    scored = toxicity.predict(_by_key(docs), model, "_key")
    return _without(docs, scored.where(F.col("score") >= 0.5).select("_key.*"))


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the weakly supervised scorer keeps.

    NULL, empty and blank texts have no quality and go; equal texts go or stay
    together; very long texts are judged whole; an empty table stays empty.
    """
    _, scorer = quality.fit(docs)
    scored = quality.predict(_by_key(docs), scorer, "_key")
    return _without(docs, scored.where(F.col("score") < quality.KEEP).select("_key.*"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates: the one of the least id; rows without an id belong to classes too.

    Texts without a word, NULL among them, are like no other and all stay.
    """
    return minhash.drop_near_duplicates(docs, unnamed=True)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item; texts without words, and all texts if there are no items, stay."""
    return decontamination.decontaminate(docs, read(spark, sf_dir, "benchmark"), remove="documents")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, round_trip) of every document; NULL and empty texts have no tokens, repeated rows repeat."""
    encoded = pieces.encode(docs, pieces.load_model())
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "round_trip")


STAGES = [
    ("toxicity", drop_toxic),
    ("quality classifier", drop_poor),
    ("MinHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("SentencePiece encoding and decoding", encode),
]

# Learnt models decide two stages, which SQL can't express; tests hold the stages against plain forms.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet to the shared folder and read again."""
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = read(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{number}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

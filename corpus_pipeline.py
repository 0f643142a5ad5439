"""Documents to training tokens: a chain of stages, each an operator over all that its predecessor kept."""

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lapwise.llm import exact_dedup, minhash, mixing, quality, queries
from lapwise.llm.common import scratch_folder

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts, learnt from the labelled ones among them."""
    return quality.select_good(docs, queries.training_labels(spark, sf_dir))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document per text."""
    return exact_dedup.deduplicate(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document per group of near-duplicates."""
    return minhash.deduplicate(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Counts and digests of every document's token ids and of the text they decode to."""
    return queries.token_digests(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality", good), ("exact_dedup", exact), ("minhash", near), ("mixing", mixture), ("bpe", tokens),
]

#: The stages fit a model and draw sketches, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{scratch_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        out = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs

"""From raw documents to packed token windows: five stages, each over all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geowarden.llm.bpe import vocabulary
from geowarden.llm.common import stored
from geowarden.llm.near import keep_unlike
from geowarden.llm.packing import pack
from geowarden.llm.quality import keep_good
from geowarden.llm.secrets import redact_secrets
from geowarden.llm.substrings import remove_repeats

#: Text bytes that a worker of repeated_passages holds; half of the operator's own, as executors still hold the stages before.
PART_BYTES = 4 << 20


def _measured(docs: DataFrame) -> DataFrame:
    """n_chars of the texts as they are now."""
    return docs.withColumn("n_chars", F.length("text").cast("long"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the limits or are outliers of their language and source go."""
    return keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, Jaccard 0.8 or more) one document stays, the one with the smallest id.

    SimHash's positional bytes link first, an exact index over shingles links what they can't.
    """
    return keep_unlike(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 35 words and more that occur again are cut out of the texts."""
    return _measured(remove_repeats(docs, part_bytes=PART_BYTES))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by their kind."""
    return _measured(redact_secrets(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' ids in windows of 4096."""
    return pack(docs, vocabulary("word_bpe_49k.json"))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("secrets", secrets), ("packing", packing)]

#: SQL can express none of fingerprints, estimates and byte-pair merges; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = stored(docs)
    return docs

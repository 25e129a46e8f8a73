"""The stages of the pipeline from raw documents to token ids.

Every stage works on all rows that the one before it kept and returns the
columns of ``documents``, but for the last, which returns token ids.  Each
takes (spark, docs, folder of the tables); no rows give no rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from anchorage.llm import bpe, minhash, mixing, quality, substring
from anchorage.llm.common import delete, delete_at_exit, scratch, shared_folder
from anchorage.llm.queries import VOCABULARY

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go, those with a null or empty text among them; repeated rows all stay or all go."""
    return quality.kept_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one with the smallest id; of repeated rows one stays.

    Documents with a null, empty or blank text, or without an id, are like no other and stay.
    """
    return minhash.kept_documents(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words and more that a document with a smaller id has too go; ``n_chars`` follows the text.

    A document of which nothing is left stays, with an empty text; a null text
    stays null, and a document without an id neither loses nor gives cause to lose.
    Of repeated rows all lose the same.
    """
    shorter = substring.deduplicated(docs)
    if "n_chars" not in docs.columns:
        return shorter
    kind = docs.schema["n_chars"].dataType
    return shorter.withColumn("n_chars", F.char_length(F.coalesce("text", F.lit(""))).cast(kind))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it, from not at all to twice; those with a null, empty or blank text go.

    A null source is one of its own; of repeated rows each comes twice at most.
    """
    return mixing.mixture(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, their number, and digests of the ids and of the bytes they decode to; a null or empty text has none.

    Repeated rows get a row each.
    """
    return bpe.encoded(docs, str(public_tokenizers.path(VOCABULARY)), public_tokenizers.PATTERN, with_ids=True)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("mix_sources", mix_sources),
    ("encode", encode),
]


def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All stages over ``docs``, each written as Parquet to the shared folder and read again.

    What a stage wrote for itself goes once its result is written, and a result
    once the next one is; the last stage's input stays until the driver ends.
    """
    before = None
    for name, stage in STAGES[:-1]:
        with scratch():
            result = stage(spark, docs, sf_dir)
            folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4()}-{name}"
            delete_at_exit(spark, folder)
            result.write.parquet(folder)
        if before is not None:
            delete(spark, before)
        before, docs = folder, spark.read.parquet(folder)
    return STAGES[-1][1](spark, docs, sf_dir)

"""The corpus pipeline: language ID, exact dedup, near-dedup, benchmark decontamination, packing."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tallystone.functions.stages import shared_folder
from tallystone.llm import decontaminate, exact_dedup, language_id, near_dedup, packing
from tallystone.llm.common import table

#: Similarity of near copies in the stage; op5 keeps its own of 85 %.
NEAR_PERCENT = 80
#: A text is in a language if the network gives that one half of its probability or more.
LANGUAGE_FLOOR = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that are in no language go: those without a letter, and those of which the network is sure
    of none. Rows without ``lang`` get the language found. A corpus without labels keeps all texts with a letter."""
    return language_id.drop_unknown(docs, floor=LANGUAGE_FLOOR, named=True)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of texts at a similarity of ``NEAR_PERCENT`` or more stays."""
    return near_dedup.drop_near_copies(docs, percent=NEAR_PERCENT)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's bucket, batch and slot."""
    return packing.pack(docs)


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: Language ID and packing are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    at = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{name}")
        docs = spark.read.parquet(f"{at}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

"""A corpus pipeline of five stages over `documents`, each by one training-data operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.llm.common import checkpoint, table
from ledgerloom.llm.decontamination import decontaminate
from ledgerloom.llm.language import learn, reject_unknown
from ledgerloom.llm.mixing import mix
from ledgerloom.llm.near_dup import deduplicate
from ledgerloom.llm.sharding import assign_shards
from ledgerloom.session import ship

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; the model learns from the stage's own input.

    Null, blank and letterless texts go, and so do texts that no learned language codes better than
    bytes by themselves. Without labelled documents nothing is recognised. Repeated rows, rows without an
    id, a language or a source, and very long texts are judged by their whole text like others.
    """
    ship(spark)
    return reject_unknown(docs.select(COLUMNS), learn(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: five-word shingles, a similarity of 0.8 or more.

    The least doc_id of a class stays, a null one only where all are null; of repeated rows one stays. Rows
    that share an id but not their text are told apart. Null and blank texts are like nothing and stay.
    """
    ship(spark)
    return deduplicate(docs.select(COLUMNS))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Null and blank texts hold none. All rows of an id of which one holds an item go; rows without an id
    stay. An empty benchmark, or items that are null or shorter than a window, take nothing away.
    """
    return decontaminate(docs.select(COLUMNS), table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their sources reads them; those that it does not read go.

    Null and blank texts have no words and go. A null source is a source, and rows without an id take part;
    equal rows share what is read of them. No row is returned more than twice for each time it was there.
    """
    return mix(docs.select(COLUMNS))


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard and slot of every row that is left; null ids come first, null texts count eight bytes, equal rows follow each other."""
    return assign_shards(docs)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]

#: Context trees and MinHash have no equivalent in SQL; tests/llm/test_pipeline.py compares each stage with loops over its input.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over documents; each reads what the one before it left in the checkpoint folder."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = checkpoint(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

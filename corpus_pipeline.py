"""A training corpus from the documents table, in five stages; each is written as Parquet and read again.

Rows that toxicity rejects go; of near-duplicates the least doc_id stays; passages that repeat are cut
from the texts; documents with a test item go; what is left gets rates that mix it to the target weights.

Results for odd input, in every stage: null and blank texts stay (as null or as they are; substring_dedup makes a null text empty), as
nothing is found in them; rows with a null doc_id stay in the stages that reject documents, and so do they in the others; rows that
repeat a doc_id go or stay together, but substring_dedup and mixing take each by its own text; of equal texts the least doc_id
stays, with all its rows; texts of any length are read whole; empty tables give empty tables; other columns than those of documents
are dropped on reading.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import discard, table, written
from tidemark.llm.decontaminate import without_leaks
from tidemark.llm.mixing import label_domains, mix
from tidemark.llm.near_dup import one_of_each
from tidemark.llm.queries import TARGETS
from tidemark.llm.repeats import remove_repeats
from tidemark.llm.toxicity import without_toxic

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_toxic(docs, table(spark, sf_dir, "labels"))


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each(docs)


def repeats_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that lose a passage are the kept words joined by spaces, with their new length."""
    cut = remove_repeats(docs)
    return cut.select("doc_id", "text", "lang", "source", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix(docs, label_domains(table(spark, sf_dir, "labels")), TARGETS)


STAGES = [
    ("toxicity", toxicity_stage),
    ("minhash_near_dup", near_dup_stage),
    ("substring_dedup", repeats_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
]

#: Classifiers and fitted rates are not SQL; tests hold run() against the single operators.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for k, (_, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs)
            discard(before)
    return docs

"""From raw documents to training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as
the next stage's documents. All but the last return the columns of the documents table, and any
other columns that came in. Every stage works on all rows its predecessor kept; empty tables, nulls
and repeated rows have the results their operators define.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from driftline.llm import near_dedup, packing, quality_rules, secret_scan, toxicity
from driftline.llm.common import table
from driftline.llm.queries import WORD_BPE, training_labels
from driftline.session import cut, scratch_scope


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.7 or more for toxicity go."""
    return toxicity.reject_toxic(docs, toxicity.fit(docs, training_labels(spark, sf_dir, "toxic")))


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail a base rule, or an extra rule on a host bad for it, go."""
    return quality_rules.reject_by_rules(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group alike in five-word shingles stays, the one with the smallest id."""
    return near_dedup.drop_near_duplicates(docs, near_dedup.Near(words=5, percent=80))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the texts; every document stays."""
    return secret_scan.mask_secrets(docs, secret_scan.Scanner(secret_scan.build_dictionary(docs)))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 2048 ids."""
    return packing.pack(docs, WORD_BPE)


STAGES = [
    ("toxicity", toxic),
    ("quality rules", rules),
    ("near duplicates", near_duplicates),
    ("secrets", secrets),
    ("packing", sequences),
]

# The learned score, the compressor and the tokenizer have no SQL form; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order. Tables that a stage makes on its way are deleted once its result is written."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        with scratch_scope(spark) as kept:
            docs = cut(stage(spark, docs, sf_dir), kept)
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLES = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}

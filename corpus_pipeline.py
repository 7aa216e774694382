"""The corpus pipeline: five stages from `documents` to a mixed training corpus.

Each stage takes (spark, docs, sf_dir) and returns what it keeps; `run` writes a stage's rows
as Parquet to the shared scratch folder and rereads them as the next one's docs.  All stages
but the last return the columns of `documents`.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedyard.llm import apportion, bayes_quality, hyperminhash, suffixmerge, wumanber
from feedyard.llm.common import prep, stage, table


#: A passage of more words that repeats is cut.
REPEAT_WORDS = 50
#: Bytes that one word more has at least: strings of this length are searched.
REPEAT_BYTES = 2 * (REPEAT_WORDS + 1) - 1


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return bayes_quality.keep_good(docs, table(prep(spark), sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicate texts (five-word shingles, similarity 0.8)."""
    prep(spark)
    return hyperminhash.keep_texts(docs, k=5, percent=80)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the repeated runs of more than `REPEAT_WORDS` words (bytes that strings
    of `REPEAT_BYTES` cover which occur more than once)."""
    prep(spark)
    return suffixmerge.remove(docs, length=REPEAT_BYTES, words=REPEAT_WORDS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark window."""
    return wumanber.clean(docs, table(prep(spark), sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes words of, with size, source_size, target and taken (which
    replace columns of these names)."""
    prep(spark)
    out = apportion.mix(docs, carry=docs.columns).where("taken > 0")
    new = ("size", "source_size", "target", "taken")
    return out.select(*[F.col(f"doc.`{c}`").alias(c) for c in docs.columns if c not in new], *new)


STAGES = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("suffix_dedup", suffix_dedup),
    ("decontaminate", decontaminate),
    ("mix", mix),
]

#: No SQL: the classifier and the banded search have no SQL form; tests hold the stages
#: against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    prep(spark)
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return docs

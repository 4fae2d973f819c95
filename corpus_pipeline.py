"""The corpus pipeline: language ID, exact dedup, near dedup, benchmark decontamination, packing.

Each stage takes the rows that the one before it kept, as a table it can read more than once; all but the last return
the columns of ``documents``. Stages never drop a row but for the reason they stand for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tamarack.llm.common import staged
from tamarack.llm.decontaminate import drop_contaminated
from tamarack.llm.exact_dedup import drop_exact_duplicates
from tamarack.llm.langid import fit_language_model, keep_identified
from tamarack.llm.ngram_join import keep_one_of_each
from tamarack.llm.packing import pack_documents


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified with calibrated confidence."""
    return keep_identified(docs, fit_language_model(docs))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each group of equal documents: that with the largest id."""
    return drop_exact_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each component of documents linked at 0.8 on five-word shingles: that with the smallest id."""
    return keep_one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark passage occurs."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), short_items=True)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document, placed in a sequence of at most 2048 tokens."""
    return pack_documents(docs)


STAGES = [
    ("language ID", language_id),
    ("exact dedup", exact_dedup),
    ("n-gram Jaccard join", near_dedup),
    ("benchmark decontamination", decontaminate),
    ("best-fit packing", pack),
]

#: Language ID and tokenising can't be put in SQL; the tests hold the pipeline against its stages' brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = staged(docs, f"stage-{k}")
    return docs

"""The corpus pipeline: stages over documents, each written and read again before the next.

Documents in no learned language go; one document of each class of near-duplicates stays, whole; passages that stand in
an earlier document are cut; documents that hold a benchmark item go; what is left gets its place in a mix of sources. Every stage takes empty tables, and passes columns that it does not know
as they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from treeblock.llm import contamination, language, mixing, neardup, passages
from treeblock.llm.common import table, written

#: Target weights of the mix; other sources share the rest evenly.
WEIGHTS = {"src0": 0.1}


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is one of the learned ones.

    Null texts and texts without letters go; where no text is labelled, all go. Equal rows all stay or all go."""
    return language.accepted(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates: that of the least doc_id, null ids last.

    Null and empty texts all stay; of rows equal in id and words, one."""
    return neardup.distinct_documents(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, less the passages of 50 bytes or more that one of smaller doc_id holds.

    Null ids count as greater than all others; rows of equal id take nothing from one another. Null texts stay null."""
    return passages.deduplicated(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item.

    Null and empty texts stay; equal rows all stay or all go; an empty benchmark takes nothing out."""
    return contamination.uncontaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its place in the mix, in columns that replace those of their names.

    Null sources are one source; repeated rows have places of their own."""
    return mixing.mixed(docs, WEIGHTS)


STAGES = [
    ("language ID", identify),
    ("near duplicates", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("benchmark decontamination", decontaminate),
    ("mixing", mix),
]

#: No stage but the last can be said in SQL; tests hold the whole against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, f"stage{i}")
    return docs

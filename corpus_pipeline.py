"""The training-corpus pipeline: five operators in a row, each stage written and read again."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lapwing.llm.common import table
from lapwing.llm.line_dedup import without_repeated_lines
from lapwing.llm.mixing import mixed_documents
from lapwing.llm.ngram_join import one_of_each
from lapwing.llm.packing import pack
from lapwing.llm.quality import clean_documents


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line rules reject go; failing lines go from those that stay. A null or empty text is rejected; null and
    repeated ids are carried, row by row; all columns stay; an empty table stays empty."""
    return clean_documents(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines go that stand, equal or within the allowed edits, earlier in the corpus; so do documents left
    without words, or with under a fifth of their characters: what is left of a near copy is no document."""
    return without_repeated_lines(docs, least_chars=1, least_share=0.2)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that of least id. Texts without words are each a group of their own; an empty table stays empty."""
    return one_of_each(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in its order. A null source is a source, after all others; a null text has size 0 and is not
    taken; repeated rows are documents each; an empty table stays empty."""
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the mixed documents in full sequences. A null or empty text is the end id alone; a null id is carried; an empty table has no pieces."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("near duplicates", near_duplicates),
    ("mixing", mixing),
    ("packing", packing),
]

#: Tokenisation, edit joins and MinHash verification have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)

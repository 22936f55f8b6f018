"""The corpus pipeline: documents to mixed, deduplicated token sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return
the columns of documents. The tables of ``sf_dir`` other than documents are labels, from
which the first stage learns.

Defined results: a document with a null or empty text passes the first three stages and
takes no part in the mix, as it has no words; null ids, ids that several documents share
and repeated rows are handled row by row (near copies, equal rows among them, become one);
columns beside those of documents, whatever their names and kinds, are carried up to the
last stage, which replaces text (and a column of that name) by tokens; empty tables give
an empty result; without labels no document is toxic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sextant.llm import op2_substring, op5_toxicity, op6_pieces, op8_mixing, op9_jaccard
from sextant.llm.common import stored, table


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored toxic go."""
    return op5_toxicity.reject_toxic(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays."""
    return op9_jaccard.deduplicate(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of 35-word windows that occur elsewhere go."""
    return op2_substring.remove_repeats(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeat or go as the sources' targets ask, in curriculum order."""
    return op8_mixing.mix(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts become token ids."""
    return op6_pieces.encode(docs)


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("mixing", mixing),
    ("encoding", encoding),
]
#: The stages learn, join and factor: SQL cannot express them. Tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

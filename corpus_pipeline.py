"""The corpus pipeline: documents in, packed training sequences out.

Each stage takes (spark, docs, sf_dir) and works on every row that its predecessor kept.
All but the last return the columns of documents. Extra columns pass through, whatever their names.

Defined cases: a null text is judged as an empty one and stays null; empty texts are equal, so one of them
stays; rows that repeat a doc_id are rows of their own, and of rows that repeat in all columns one stays;
a null doc_id is the last of its group; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestar.llm.common import table, written
from lodestar.llm.packing import pack_documents
from lodestar.llm.simhash import one_of_each
from lodestar.llm.suffix_dedup import without_repeats
from lodestar.llm.toxicity import train, without_toxic

#: Near copies of a similarity of 0.8 or more in shingles of five words differ in more bits of
#: one fingerprint than the radius; with so many views most of them are within it in some view.
#: The contract's, five of long words, ten of all words for texts with few long ones.
VIEWS = 16
#: Links in the views are candidates; documents go by the exact Jaccard similarity of five-word shingles.
SIMILARITY = 0.8
#: A passage has over 50 words; every copy of it goes.
PASSAGE_WORDS = 51


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain calls toxic go."""
    return without_toxic(docs, train(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates one document stays."""
    return one_of_each(docs, views=VIEWS, similarity=SIMILARITY)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that occur more than once are cut out; documents stay, an emptied one with an empty text."""
    return without_repeats(docs, words=PASSAGE_WORDS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents become pieces in sequences."""
    return pack_documents(docs)


STAGES = [("toxicity", toxicity), ("SimHash near-dedup", near_dedup), ("suffix-array dedup", passages), ("best-fit packing", packing)]

#: The stages train a classifier and tokenize; SQL has neither.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage over all that the one before it kept; each result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs)
    return docs

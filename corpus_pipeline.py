"""From raw documents to training sequences: quality rules, near-duplicates, personal data, mixing, packing.

Each stage takes (spark, docs, sf_dir), works on all documents that the one before it kept and, but for the last, returns
the columns of documents, whatever further columns there are and whatever their names. Stages are separated by Parquet
tables in the shared folder, so a lost executor costs no more than a part of one stage. An empty table goes through all
stages and gives no sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from silvan.llm.common import materialise, table
from silvan.llm.minhash import drop_near_duplicates
from silvan.llm.mixing import mixed_documents
from silvan.llm.packing import pack_documents
from silvan.llm.pii import redacted
from silvan.llm.quality import accepted


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects.

    A null text counts as empty, and an empty one has too few words, so both go; very long texts are judged whole; a value
    exactly on a rule's bound is kept; repeated rows are judged one by one and alike; nulls in other columns change nothing;
    an empty table stays empty; all columns are kept as they are.
    """
    return accepted(docs)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, a similarity of 0.8 or more.

    Documents without words (null, empty or blank) are like no other and stay; with fewer than five words the whole
    sequence is compared; very long texts are compared whole; a similarity of exactly 0.8 links; of a group the row with
    the smallest doc_id stays, null last, and of repeated rows one; an empty table stays empty; all columns are kept.
    """
    return drop_near_duplicates(docs, percent=80)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind.

    A null or empty text stays as it is; very long texts are read whole, in time proportional to what they hold; of spans
    that overlap the first counts; repeated rows are changed alike; n_chars counts the new text; an empty table stays
    empty; all other columns are kept as they are.
    """
    return redacted(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document, repeated as often as it is taken.

    A null source is a source of its own; documents without words (null, empty or blank) add nothing and go unless their
    shard is taken whole; of a very long text a run of words may be taken, with the white space inside it; equal quotients
    go to the first; repeated rows are documents of their own; an empty table stays empty; other columns are repeated
    with the text, and n_chars counts the new one.
    """
    return mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences with their ids.

    A null or empty text is the end id alone; very long texts are packed whole; repeated rows have sequences of their own;
    an empty table gives none; columns other than doc_id and text are not read, so null or clashing ones change nothing.
    """
    return pack_documents(docs)


STAGES = [("quality rules", quality), ("MinHash near-dedup", dedup), ("PII", pii), ("mixing", mix), ("packing", pack)]

#: Neither the near-duplicate stage on whole tables nor the tokenizer can be put in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for nth, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if nth < len(STAGES) - 1:
            docs = materialise(docs, f"stage-{nth}")
    return docs

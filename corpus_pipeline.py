"""The corpus pipeline: each stage works on all that the one before it kept, written as Parquet and read again.

All stages take rows with nulls in any column, empty and very long texts, ties, repeated rows, no rows at all, and columns
with any other names, which all but the last pass on. What each does with them:
quality: a row is kept or dropped by its text alone, a null one being scored as empty; without labels all stay.
toxicity: likewise; a text without words has the score of the bias and stays.
near_duplicates: rows that repeat doc_id and text are one; of a group of copies the least doc_id stays, and one without a
doc_id only if no other has one; texts without words are copies of none but rows that repeat them.
decontamination: rows are told apart by doc_id and text, so of rows that share a doc_id only those with a match go; nulls and
empty texts stay.
packing: each row is packed for itself; one without tokens has a row with null bin_id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemill.llm import decontam, packing, quality, simhash, toxicity
from tidemill.llm.space import labels_of, table, written


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, learned from these documents, keeps."""
    model = quality.learn(docs, labels_of(spark, sf_dir, "quality"))
    return quality.kept(docs, model)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity machine, learned from these documents, does not flag."""
    machine = toxicity.learn(docs, labels_of(spark, sf_dir, "toxic"))
    return toxicity.kept(docs, machine)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least doc_id, of each group of near duplicates, compared by text whether or not it has a doc_id."""
    return simhash.deduplicated(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any phrase or close passage of a benchmark item, those without a doc_id searched like others."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes: doc_id, piece, n_tokens, bin_id and place."""
    return packing.pack(docs)


STAGES = [
    ("quality", keep_quality),
    ("toxicity", drop_toxic),
    ("near_duplicates", one_of_each),
    ("decontamination", drop_leaks),
    ("packing", packed),
]
#: Trained models, approximate candidates and greedy packing: no stage is SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name)
    return docs

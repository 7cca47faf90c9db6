"""The corpus pipeline: quality, near duplicates, benchmark passages, mixture, token files.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns a DataFrame that is written as
Parquet and read again as the next stage's docs. All but the last return the columns of documents, whatever their names.

In every stage an empty table gives an empty one, texts are worked on whole, and of equal cases the choice is the same in
every run. Text that is null counts as empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexloom.llm.common import new_folder, settled, tables
from lexloom.llm.decontaminate import drop_contaminated
from lexloom.llm.minhash import keep_one_of_each
from lexloom.llm.mixing import take_mixture
from lexloom.llm.quality import keep_quality
from lexloom.llm.token_arrow import read_documents, write_tokens


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on `labels`, scores 0.5 or more.

    Null and empty texts have the score of the bias alone; rows that repeat a doc_id are scored each; rows without doc_id are
    scored too, but not trained on. Without labels all scores are 0.5, and all documents stay."""
    return keep_quality(docs, tables(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8 or more): the one with the
    smallest doc_id, and of rows that repeat it the one with the smallest hash of its text.

    Null, empty and word-less texts are no duplicates and stay; so do rows without doc_id. Of rows that agree in doc_id and
    text one stays. A text of fewer than five words is one shingle."""
    return keep_one_of_each(docs, n=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a ten-word window of a benchmark item (an item of fewer words is one window).

    Null, empty and word-less texts stay; so do repeated rows and rows without doc_id, each judged by its own text. Items
    without words or item_id match nothing; without a benchmark all documents stay."""
    return drop_contaminated(docs, tables(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents by the target weights, repeated where a leaf has too few tokens.

    Null and empty texts have no tokens and stay where they fit the prefix of their leaf; null languages and sources are the
    leaf '(null)'; rows that repeat a doc_id are documents of their own, ordered by size."""
    return take_mixture(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of what is left, and where each document stands in them: doc_id, start, n_tokens, ids_crc32, shard and
    start_in_shard.

    Null and empty texts are the end id alone; rows without doc_id come first, rows that repeat one stand by their text, each
    with a row of its own; an empty table writes no file."""
    folder = new_folder(spark, "tokens")
    return read_documents(write_tokens(docs, folder), folder).drop("file")


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("mix", mix), ("tokens", tokens)]

# Trained weights, MinHash groups and a tokenizer are beyond SQL: the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settled(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

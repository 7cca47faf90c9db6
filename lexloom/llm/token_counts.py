"""Operator 9: token counts of a corpus for every context limit, from an exact histogram of encoded lengths.

Each task encodes its texts and emits one row per length it met; Spark adds them up to the histogram. All else is
suffix sums over the distinct lengths, whose number is bounded by the longest document: blocks of `block` lengths are
summed first, so that no window holds more than the blocks, or one block.

Result of `length_histogram`: length, n_docs. Result of `limit_table`, one row per distinct length L: n_docs,
docs_at_least, tokens_at_least (of documents of L tokens or more), truncated_tokens (all documents cut to L tokens),
total_tokens, share_at_most (quantile that L is). Any limit between two rows follows from the row above it; see
`truncated_total`.

Edge cases: null and empty texts have length 0, plus 1 if an end id is counted; repeated rows count as often as they
stand; an empty table has no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import chunks, settled, sums, tables
from .token_arrow import chunk_table, numbered, tokenizer_path


def _lengths(path: str, extra: int) -> Callable:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, seen = chunk_table(path), {}
        for _, texts in chunks(batches):
            words, starts = numbered(table, texts)
            size = table.size[words] if len(words) else np.zeros(0, np.int64)
            for length, n in zip(*np.unique(sums(size, starts) + extra, return_counts=True), strict=True):
                seen[int(length)] = seen.get(int(length), 0) + int(n)
        yield pa.record_batch([pa.array(list(seen), pa.int64()), pa.array(list(seen.values()), pa.int64())], names=["length", "n_docs"])

    return count


def length_histogram(docs: DataFrame, path: str | None = None, extra: int = 1) -> DataFrame:
    """How many documents have each encoded length; `extra` ids are counted for each document (its end id)."""
    counted = docs.select("text").mapInArrow(_lengths(path or tokenizer_path(), extra), "length long, n_docs long")
    return counted.groupBy("length").agg(F.sum("n_docs").alias("n_docs"))


def limit_table(histogram: DataFrame, block: int = 1024) -> DataFrame:
    rows = histogram.withColumn("block", F.floor(F.col("length") / block))
    per_block = rows.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum(F.col("n_docs") * F.col("length")).alias("t"))
    after = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    later = per_block.select("block", F.coalesce(F.sum("d").over(after), F.lit(0)).alias("later_d"), F.coalesce(F.sum("t").over(after), F.lit(0)).alias("later_t"), F.sum("d").over(every).alias("all_d"), F.sum("t").over(every).alias("total_tokens"))
    within = Window.partitionBy("block").orderBy(F.desc("length"))
    return (
        rows.join(later, "block")
        .withColumn("docs_at_least", F.col("later_d") + F.sum("n_docs").over(within))
        .withColumn("tokens_at_least", F.col("later_t") + F.sum(F.col("n_docs") * F.col("length")).over(within))
        .select(
            "length", "n_docs", "docs_at_least", "tokens_at_least",
            (F.col("total_tokens") - F.col("tokens_at_least") + F.col("length") * F.col("docs_at_least")).alias("truncated_tokens"),
            "total_tokens",
            ((F.col("all_d") - F.col("docs_at_least") + F.col("n_docs")) / F.col("all_d")).alias("share_at_most"),
        )
    )


def truncated_total(limits: DataFrame, limit: int) -> Column | DataFrame:
    """One row with the tokens left if every document is cut to `limit`, for any limit."""
    return limits.agg(
        F.coalesce(F.min_by(F.col("total_tokens") - F.col("tokens_at_least") + limit * F.col("docs_at_least"), F.when(F.col("length") >= limit, F.col("length"))), F.max("total_tokens")).alias("truncated_tokens")
    )


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return limit_table(settled(length_histogram(tables(spark, sf_dir, "documents")), "lengths"))  # read twice, encoded once

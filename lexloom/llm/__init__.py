"""Corpus operators for training data: deduplication, filtering, mixing, scanning and token output.

Nothing outside this package imports it. Every operator takes DataFrames and returns DataFrames; work on
texts runs in `mapInArrow` tasks over the partitions that Spark deals out, and everything that has to meet
across documents meets in Spark shuffles.
"""

"""Operator 10: benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are the windows of 10 consecutive words of each benchmark item; an item with fewer words is one window. For
each length of pattern a shift table holds, for each block of `BLOCK` words that occurs in the first `m` words of a
pattern (m: that length), how far the search may move on; unknown blocks let it move m - BLOCK + 1 words at once. Where
the shift is 0, the bucket of the block gives the patterns that end in it, and all their words are compared. Words are
numbered by the benchmark's own vocabulary, so any other word ends every pattern.

Spark writes the items in parts (dealt by a hash of item_id) of at most about `max_chars` characters to the shared folder,
and a worker reads one part at a time and keeps its tables from task to task; nothing goes through the driver. A larger
benchmark is searched in several passes over the documents, one a part, and the hits are joined by document; no item and
no document is left out. An item must fit a pass alone.

Edge cases: null and word-less texts have no words and no hits; items without words, or without item_id, match nothing;
repeated rows of documents give a row each; an empty benchmark gives rows without hits; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LETTERS, chunks, held, new_folder, settled, tables

BLOCK = 3
HITS = "n_words long, n_items long, items array<string>, spans array<struct<a: long, b: long>>"


class Patterns:
    """Shift tables and buckets for the windows of some items."""

    def __init__(self, items: list[tuple[str, bytes]], window: int = 10):
        self.ids: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[str]] = defaultdict(set)
        for item, text in items:
            words = [self.ids.setdefault(w, len(self.ids) + 1) for w in text.translate(LETTERS).split()]
            for i in range(max(1, len(words) - window + 1)) if words else ():
                owners[tuple(words[i : i + window])].add(item)
        self.by_length: dict[int, tuple[int, dict, dict]] = {}
        for m in sorted({len(p) for p in owners}):
            b = min(BLOCK, m)
            shift: dict[tuple[int, ...], int] = {}
            bucket: dict[tuple[int, ...], list] = defaultdict(list)
            for p, who in owners.items():
                if len(p) != m:
                    continue
                for j in range(b, m + 1):
                    block = p[j - b : j]
                    shift[block] = min(shift.get(block, m), m - j)
                bucket[p[-b:]].append((p, sorted(who)))
            self.by_length[m] = (b, shift, dict(bucket))

    def search(self, text: bytes | None) -> tuple[int, list[str], list[tuple[int, int]]]:
        """The number of words, the items with a window in the text, and the spans of words that are hit."""
        if not text:
            return 0, [], []
        get = self.ids.get
        words = [get(w, 0) for w in text.translate(LETTERS).split()]
        n, items, spans = len(words), set(), []
        if not any(words):
            return n, [], []
        for m, (b, shift, bucket) in self.by_length.items():
            i, most, look = m, m - b + 1, shift.get
            while i <= n:
                block = tuple(words[i - b : i])
                s = look(block, most)
                if s:
                    i += s
                    continue
                seen = tuple(words[i - m : i])
                for p, who in bucket[block]:
                    if p == seen:
                        items.update(who)
                        spans.append((i - m, i))
                i += 1
        return n, sorted(items), merged(spans)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _patterns(part: tuple[str, int], window: int) -> Patterns:
    """The tables of one part of the items."""
    folder, k = part

    def make() -> Patterns:
        store, root = fs.FileSystem.from_uri(f"{folder}/part={k}")
        files = sorted(x.path for x in store.get_file_info(fs.FileSelector(root, allow_not_found=True)) if x.path.endswith(".parquet") and x.size)
        rows = ds.dataset(files, filesystem=store, format="parquet", partitioning=None).to_table(columns=["item_id", "text"], use_threads=False).to_pylist() if files else []
        return Patterns([(r["item_id"], r["text"].encode()) for r in rows], window)

    return held(f"patterns {folder} {k} {window}", make)


def _searcher(part: tuple[str, int], window: int) -> Callable:
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = _patterns(part, window)
        for batch, texts in chunks(batches):
            found = [patterns.search(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array([n for n, _, _ in found], pa.int64()), pa.array([len(x) for _, x, _ in found], pa.int64()), pa.array([x for _, x, _ in found], pa.list_(pa.string())),
                    pa.array([[{"a": a, "b": b} for a, b in s] for _, _, s in found], pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))),
                ],
                names=["doc_id", "n_words", "n_items", "items", "spans"],
            )

    return search


def _join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sizes of the merged spans and the digest of the sorted items."""
    for b in batches:
        rows = b.to_pydict()
        hit = [sum(y - x for x, y in merged([(s["a"], s["b"]) for s in spans])) for spans in rows["spans"]]
        sha = [hashlib.sha256(",".join(sorted(set(x))).encode()).hexdigest() for x in rows["items"]]
        yield pa.RecordBatch.from_arrays(
            [b.column(0), pa.array(rows["n_words"], pa.int64()), pa.array(hit, pa.int64()), pa.array([len(set(x)) for x in rows["items"]], pa.int64()), pa.array(sha), pa.array([h > 0 for h in hit]), b.column(3)],
            names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items"],
        )


def _passes(benchmark: DataFrame, max_chars: int) -> list[tuple[str, int]]:
    """The folder of the items and the number of each part, of about `max_chars` characters or fewer; one, perhaps empty, at least."""
    items = benchmark.filter("text is not null and item_id is not null").select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = 1 if total <= max_chars else 2 * -(-total // max_chars)
    folder = new_folder(benchmark.sparkSession, "benchmark")
    items.withColumn("part", F.pmod(F.xxhash64("item_id"), F.lit(parts)).cast("int")).repartition("part").write.partitionBy("part").parquet(folder)
    return [(folder, k) for k in range(parts)]


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, max_chars: int = 2_000_000) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated and items for each row of `docs`."""
    passes = _passes(benchmark, max_chars)
    texts = docs.select("doc_id", "text")
    if len(passes) > 1:
        texts = settled(texts.withColumn("row", F.monotonically_increasing_id()), "documents-numbered").select(F.struct("row", "doc_id").alias("doc_id"), "text")
    kind = texts.schema["doc_id"].dataType.simpleString()
    found = [texts.mapInArrow(_searcher(x, window), f"doc_id {kind}, {HITS}") for x in passes]
    one = found[0]
    if len(found) > 1:
        every = reduce(DataFrame.unionByName, found)
        one = every.groupBy("doc_id").agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("items")).alias("items"), F.flatten(F.collect_list("spans")).alias("spans"))
        one = one.select("doc_id.doc_id", "n_words", F.size("items").cast("long").alias("n_items"), "items", "spans")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return one.mapInArrow(_join, f"doc_id {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, items array<string>")


def _clean(part: tuple[str, int], window: int) -> Callable:
    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = _patterns(part, window)
        for batch, texts in chunks(batches):
            yield batch.filter(pa.array([not patterns.search(t)[2] for t in texts], pa.bool_()))

    return clean


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10, max_chars: int = 2_000_000) -> DataFrame:
    """The rows of `docs`, with all their columns, in which no window of the benchmark occurs. Of several passes each works
    on what the one before has left."""
    *earlier, last = _passes(benchmark, max_chars)
    for part in earlier:
        docs = settled(docs.mapInArrow(_clean(part, window), docs.schema), "documents-left")
    return docs.mapInArrow(_clean(last, window), docs.schema)


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_contamination(tables(spark, sf_dir, "documents"), tables(spark, sf_dir, "benchmark"))

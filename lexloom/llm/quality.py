"""Operator 2: quality classifier, a logistic regression over hashed word n-grams trained by FTRL-proximal.

Words are those between ASCII white space. Each gives two tokens: the word itself (lower case, outer punctuation cut
off), and its form (letter case, digits, length class, the punctuation it ends with). Unigrams and bigrams of both, and
the words equal to the one or the last few before them, are hashed to 2^bits weights. A text is the sparse vector of
the shares of its n-grams, and its score is the logistic function of the dot product with the weights.

Training takes labelled documents whose crc32(doc_id as text) mod 3 is not 1. A sample by a hash of doc_id keeps their
number at about `max_docs`. They are dealt to a fixed number of parts; each part runs FTRL over its documents, and the
parts' weights are averaged in Spark (iterative parameter mixing, one round). The weights, at most 2^bits, are broadcast.

Edge cases: null and empty texts get the score of the bias alone; labels without quality or doc_id are left out, a
document labelled twice takes its lowest label; documents without doc_id are scored, held_out false; without any
training document all scores are 0.5; repeated rows give a row each; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordTable, chunks, crc_mod3, held, mixed, sums, tables

PARTS = 4
SCALE = 16.0
PUNCTUATION = bytes(b for b in range(33, 127) if not chr(b).isalnum())


def _describe(words: list[bytes]) -> dict[str, np.ndarray]:
    n = len(words)
    word, form = np.empty(n, np.uint64), np.empty(n, np.uint64)
    for i, w in enumerate(words):
        core = w.strip(PUNCTUATION)
        text = core.decode("utf-8", "replace")
        case = "u" if text.isupper() and len(text) > 1 else "l" if text.islower() else "t" if text.istitle() else "n" if not text else "m"
        digit = any(c.isdigit() for c in text)
        tail = w[len(w.rstrip(PUNCTUATION)) :][:4] if core else w[:4]
        word[i] = xxhash.xxh3_64_intdigest(text.lower().encode())
        form[i] = xxhash.xxh3_64_intdigest(b"%s %d %d %s" % (case.encode(), digit, min(len(text), 24) // 6, tail), 1)
    return {"word": word, "form": form}


def gram_slots(texts: list[bytes | None], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The weights' numbers of all n-grams of the texts, text by text, and where each text's begin."""
    table = held("quality", lambda: WordTable(_describe))
    numbers, starts = table.numbers([t.split() if t else [] for t in texts])
    if not len(numbers):
        return np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64)
    word, form = table.word[numbers], table.form[numbers]
    owner = np.repeat(np.arange(len(texts)), np.diff(starts))
    kinds = [word, form]
    repeat = np.zeros(len(word), np.uint64)
    for back in (4, 3, 2, 1):
        same = np.zeros(len(word), bool)
        same[back:] = (word[back:] == word[:-back]) & (owner[back:] == owner[:-back])
        repeat[same] = back
    kinds.append(repeat + np.uint64(0x7265))
    for x in (word, form):
        two = np.full(len(x), 0x6269, np.uint64)
        inside = owner[1:] == owner[:-1]
        two[1:][inside] = (x[:-1] * np.uint64(0x9E3779B97F4A7C15) + x[1:])[inside]
        kinds.append(two)
    slots = np.stack([mixed(x + np.uint64((k + 1) * 0xD1B54A32D192ED03 & (1 << 64) - 1)) >> np.uint64(64 - bits) for k, x in enumerate(kinds)], 1)
    return slots.astype(np.int64).ravel(), starts * len(kinds)


def _trainer(bits: int, epochs: int, alpha: float, beta: float, l1: float, l2: float) -> Callable:
    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[int, np.ndarray, np.ndarray, int]] = []
        for batch, texts in chunks(batches):
            slots, starts = gram_slots(texts, bits)
            ids, labels = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for i, (a, b) in enumerate(zip(starts[:-1], starts[1:], strict=True)):
                at, n = np.unique(slots[a:b], return_counts=True)
                rows.append((ids[i], at.astype(np.int32), (SCALE * n / max(1, b - a)).astype(np.float32), int(labels[i])))
        if not rows:
            return
        rows.sort(key=lambda r: xxhash.xxh3_64_intdigest(str(r[0])))
        size = (1 << bits) + 1
        z, n = np.zeros(size), np.zeros(size)

        def weights(at: np.ndarray) -> np.ndarray:
            return np.where(np.abs(z[at]) <= l1, 0, -(z[at] - np.sign(z[at]) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2))

        for _ in range(epochs):
            for _, at, x, y in rows:
                at, x = np.append(at, size - 1), np.append(x, 1.0)
                w = weights(at)
                g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - y) * x
                z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha * w
                n[at] += g * g
        w = weights(np.arange(size))
        kept = np.flatnonzero(w)
        yield pa.record_batch([pa.array(kept), pa.array(w[kept])], names=["slot", "weight"])

    return train


def train_quality(docs: DataFrame, labels: DataFrame, bits: int = 18, max_docs: int = 20_000, epochs: int = 3, alpha: float = 0.1, beta: float = 1.0, l1: float = 0.05, l2: float = 0.1) -> np.ndarray:
    """2^bits weights and the bias at last. `max_docs` bounds the labelled documents that are used."""
    known = labels.filter("doc_id is not null and quality is not null").filter(crc_mod3() != 1).groupBy(F.col("doc_id").alias("labelled")).agg(F.min("quality").alias("quality"))
    share = max_docs / max(known.count(), max_docs)
    drawn = lambda c: F.pmod(F.xxhash64(F.lit(2), F.col(c).cast("long")), F.lit(1_000_000)) < int(1_000_000 * share)
    sample = docs.select("doc_id", "text").filter(crc_mod3() != 1).filter(drawn("doc_id")).join(known.filter(drawn("labelled")), F.col("doc_id") == F.col("labelled"))
    parts = sample.select(F.col("doc_id").cast("long"), "text", F.col("quality").cast("int").alias("quality")).repartition(PARTS, F.xxhash64(F.lit(5), "doc_id"))
    got = parts.mapInArrow(_trainer(bits, epochs, alpha, beta, l1, l2), "slot long, weight double").groupBy("slot").agg(F.sum("weight").alias("weight")).toArrow()
    out = np.zeros((1 << bits) + 1)
    out[got.column("slot").to_numpy()] = got.column("weight").to_numpy() / PARTS
    return out


def scores(texts: list[bytes | None], weights: np.ndarray, bits: int) -> np.ndarray:
    slots, starts = gram_slots(texts, bits)
    dot = sums(weights[slots], starts) / np.maximum(1, np.diff(starts)) * SCALE + weights[-1]
    return 1 / (1 + np.exp(-np.clip(dot, -35, 35)))


def _scorer(shared, bits: int) -> Callable:
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores(texts, shared.value, bits))], names=["doc_id", "score"])

    return score


def _keeper(shared, bits: int, least: float) -> Callable:
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches):
            yield batch.filter(pa.array(scores(texts, shared.value, bits) >= least))

    return keep


def quality_scores(docs: DataFrame, labels: DataFrame, bits: int = 18, **training) -> DataFrame:
    """doc_id, held_out, score and predicted for each row of `docs`."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(train_quality(docs, labels, bits, **training))
    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.select("doc_id", "text").mapInArrow(_scorer(shared, bits), f"doc_id {kind}, score double")
    return scored.select("doc_id", F.coalesce(crc_mod3() == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_quality(docs: DataFrame, labels: DataFrame, bits: int = 18, least: float = 0.5, **training) -> DataFrame:
    """The rows of `docs`, with all their columns, that score `least` or more."""
    shared = docs.sparkSession.sparkContext.broadcast(train_quality(docs, labels, bits, **training))
    return docs.mapInArrow(_keeper(shared, bits, least), docs.schema)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(tables(spark, sf_dir, "documents"), tables(spark, sf_dir, "labels"))

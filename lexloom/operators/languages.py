"""Languages of sentences, by a model of letter trigrams that Spark counts in labelled documents.

The model is a naive Bayes classifier: for each language and slot a weight, 1000 times the logarithm of the slot's share of
the language's trigrams (one added to each count), rounded. A trigram's slot is a number made of its three letters, modulo
`slots`, so the model has slots * languages weights at most, whatever the size of the corpus, and goes to every task.
Weights are whole numbers, so that sums have no rounding and ties are ties. A document is scored as a whole where it lies,
in Arrow batches; nothing is shuffled.

Edge cases: documents without language, text or doc_id are not trained on; a sentence without letters takes the language
of the one before, the first ones the default; a null or empty text has no sentences; of equal sums the last name wins.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .periods import sentences_of, spread

LETTERS = regex.compile(r"\p{L}+")


class Languages(NamedTuple):
    langs: list[str]
    weights: np.ndarray  # by slot and language


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept for testing: crc32(doc_id as text) mod 3 = 1."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def trigram_slots(words: list[str], slots: int) -> tuple[np.ndarray, np.ndarray]:
    """The slots of the trigrams of all words, each with an underscore before and after it, and the trigrams' places in the
    row of all words with their underscores."""
    c = np.frombuffer("".join([f"_{w}_" for w in words]).encode("utf-32-le"), np.uint32).astype(np.int64)
    if len(c) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    mark = c == 95
    at = np.flatnonzero(~(mark[:-2] & mark[1:-1]) & ~(mark[1:-1] & mark[2:]))  # none over the bounds of words
    return (c[at] * 961 + c[at + 1] * 31 + c[at + 2]) % slots, at


def _gram_counter(slots: int) -> Callable:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, np.ndarray] = {}
        for batch in batches:
            langs, words, n = (c.to_pylist() for c in batch.columns)
            for lang in set(langs):
                own = [(w, k) for w, k, x in zip(words, n, langs, strict=True) if x == lang]
                slot, at = trigram_slots([w for w, _ in own], slots)
                times = np.repeat([k for _, k in own], [len(w) + 2 for w, _ in own])[at]
                found[lang] = found.get(lang, 0) + np.bincount(slot, times, slots)
        for lang, counts in found.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(counts[at].astype(np.int64))], names=["lang", "slot", "n"])

    return count


def train_languages(docs: DataFrame, slots: int = 4096) -> Languages:
    """docs: doc_id, text, lang; rows that are held out are left out. Words are counted first, so that trigrams are made
    once for each different word of a language."""
    known = docs.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    each = F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))).alias("word")
    words = known.select("lang", each).groupBy("lang", "word").agg(F.count("*").alias("n"))
    grams = words.mapInArrow(_gram_counter(slots), "lang string, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n"))
    counts: dict[str, dict[int, int]] = {}
    for r in grams.collect():  # slots * languages rows at most
        counts.setdefault(r["lang"], {})[r["slot"]] = r["n"]
    langs = sorted(counts)
    totals = [sum(counts[x].values()) + slots for x in langs]
    weight = lambda n, total: math.floor(1000 * math.log((n + 1) / total) + 0.5)
    rows = [[weight(counts[x].get(slot, 0), total) for x, total in zip(langs, totals, strict=True)] for slot in range(slots)]
    return Languages(langs, np.array(rows, np.int64).reshape(slots, len(langs)))


def languages_of(sentences: list[str], model: Languages, default: str) -> list[str]:
    """The language of each sentence of a text."""
    words = [LETTERS.findall(s.lower()) for s in sentences]
    slot, at = trigram_slots([w for ws in words for w in ws], len(model.weights))
    size = np.array([sum(len(w) + 2 for w in ws) for ws in words], np.int64)
    owner = np.repeat(np.arange(len(words)), size)[at]
    if not len(model.langs):
        return [default] * len(sentences)
    sums = np.stack([np.bincount(owner, model.weights[slot, k], len(words)) for k in range(len(model.langs))], 1)
    best = len(model.langs) - 1 - sums[:, ::-1].argmax(1)
    out, now = [], default
    for ws, k in zip(words, best.tolist(), strict=True):
        now = model.langs[k] if ws else now
        out.append(now)
    return out


def sentence_languages(docs: DataFrame, model: Languages, key: str = "doc_id", default: str = "en") -> DataFrame:
    """key, pos, sentence and language_code for each sentence."""

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, pos, sentence, code = [], [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                own = sentences_of(text or "")
                row += [i] * len(own)
                pos += range(len(own))
                sentence += own
                code += languages_of(own, model, default) if own else []
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), pa.array(pos, pa.int32()), pa.array(sentence, pa.string()), pa.array(code, pa.string())], names=[key, "pos", "sentence", "language_code"])

    kind = docs.schema[key].dataType.simpleString()
    return spread(docs.select(key, "text")).mapInArrow(tell, f"`{key}` {kind}, pos int, sentence string, language_code string")

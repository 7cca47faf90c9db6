"""Operator 3: quality rules and n-gram perplexity under a modified Kneser-Ney model per language.

The units are characters and the mark between words (a space), in n-grams of orders 1 to `order` that run over the bounds
of words, back to the begin of the word before. Each place of a text thus has one longest n-gram: `order` units, or
fewer where a text begins or the word before is short. The probability of a place depends on that n-gram alone.

1. Tasks count their words, and the pairs of ends and beginnings of neighbouring words, by language, and turn both into
   counts of longest n-grams. Spark adds them up over all documents, by the n-grams themselves; nothing is cut or merged.
2. Spark derives each lower order from the next higher one: the Kneser-Ney count of an n-gram is the number of distinct
   units before it, or how often it stands where a text or word pair begins.
3. Counts of counts give the discounts D1, D2, D3+ of each language and order (Chen and Goodman). Windows over what
   follows a context give its total and its back-off weight, and interpolated probabilities are built up order by order.
4. The model is a table in the shared folder, sorted by language, order and 64-bit hash. A worker reads the languages that
   it meets as sorted arrays (16 bytes an n-gram) and looks n-grams up by binary search; unknown n-grams back off.
   Nothing of it goes through the driver. The number of n-grams of characters grows far slower than the corpus.
5. A document's perplexity is exp of the mean negative log probability per unit. Per language, the band is the median of
   the log perplexity of documents that pass the base rules, and `spreads` standard deviations on both sides, taken from
   the median absolute deviation, so that junk moves neither as long as it is the smaller part. Both come from a
   histogram in fixed bins; documents outside the band are rejected.

Edge cases: null texts have no words; word-less texts fail the base rules and have no perplexity; a null language is a
language of its own; repeated rows count as often as they stand; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WordTable, batches_of, chunks, gram_hashes, held, let_go, mixed, new_folder, settled, sums, tables, word_hash

SYMBOLS = b"#*$%&|<>"
STEP = 0.001  # of the histogram of log perplexity
MARK = 32  # the unit between words, before the first and after the last
COUNTED = "lang string, gram string, n long"
ROWS = 1000  # of a batch of texts, of which a worker and the JVM hold a copy each
ODD = np.uint64(0x9E3779B97F4A7C15)


# ---- units


def _rule_words(words: list[bytes]) -> dict[str, np.ndarray]:
    n = len(words)
    return word_hash(words) | {
        "chars": np.fromiter((len(w) if w.isascii() else len(w.decode("utf-8", "replace")) for w in words), np.int64, n),
        "symbols": np.fromiter((len(w) - len(w.translate(None, SYMBOLS)) for w in words), np.int64, n),
    }


def _by_language(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes | None], list[str | None]]]:
    for batch, texts in chunks(batches):
        yield batch, texts, batch.column(batch.schema.get_field_index("lang")).to_pylist()


def codes(texts: list[str]) -> np.ndarray:
    """The code points of all texts in a row; NUL, which stands for no unit, becomes U+FFFD."""
    flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").copy()
    flat[flat == 0] = 0xFFFD
    return flat


def gram_keys(grams: np.ndarray) -> np.ndarray:
    """64-bit hashes of the rows of a matrix of units."""
    out = np.full(len(grams), grams.shape[1] + 1, np.uint64)
    for k in range(grams.shape[1]):
        out = (out ^ (out >> np.uint64(29))) * ODD + grams[:, k].astype(np.uint64)
    return mixed(out)


class Words:
    """What the model needs to know of words: the n-grams within each, and its first and last `order - 2` units."""

    def __init__(self, words: list[bytes], order: int):
        m = order - 2
        texts = [f" {w.decode('utf-8', 'replace')} " for w in words]
        flat, size = codes(texts), np.fromiter(map(len, texts), np.int64, len(texts))
        start = np.cumsum(size) - size
        self.units = size - 1  # without the mark before
        self.first, self.last = np.zeros((len(words), m), np.uint32), np.zeros((len(words), m), np.uint32)
        for i in range(m):
            there = size - 1 > i
            self.first[there, i] = flat[start[there] + 1 + i]
            self.last[there, m - 1 - i] = flat[start[there] + size[there] - 2 - i]
        self.owner = np.repeat(np.arange(len(words)), np.maximum(0, size - order + 1))
        inside = np.arange(len(self.owner)) - np.repeat(np.cumsum(np.maximum(0, size - order + 1)) - np.maximum(0, size - order + 1), np.maximum(0, size - order + 1))
        begin = start[self.owner] + inside
        self.grams = flat[begin[:, None] + np.arange(order)] if len(begin) else np.zeros((0, order), np.uint32)


def pair_grams(last: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The longest n-gram of each unit in `first`, after the units in `last` and a mark, and the row it is of. Units that
    are not there are 0, before the others in `last` and after them in `first`."""
    m = first.shape[1]
    row = np.concatenate([last, np.full((len(last), 1), MARK, np.uint32), first], 1)
    there = [np.flatnonzero(first[:, i]) for i in range(m)]
    return np.concatenate([row[at, i : i + m + 2] for i, at in enumerate(there)]), np.concatenate(there)


def neighbours(numbers: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each word: the number of the word before it in its text (-1 for none), and its own."""
    before = np.r_[-1, numbers[:-1]] if len(numbers) else numbers
    before[starts[:-1][np.diff(starts) > 0]] = -1
    return before, numbers


# ---- counts


class Counter:
    """Counts of longest n-grams of one language. Words and pairs are counted first, as there are far fewer of them."""

    def __init__(self, order: int):
        self.order, self.grams, self.n, self.size = order, [], [], 0

    def add(self, lists: list[list[bytes]]) -> None:
        table = WordTable(lambda words: {"none": np.zeros(len(words), np.int8)})
        numbers, starts = table.numbers(lists)
        words = Words(list(table), self.order)
        before, own = neighbours(numbers, starts)
        pair, times = np.unique((before + 1) * len(table) + own, return_counts=True)
        last = np.concatenate([np.zeros((1, self.order - 2), np.uint32), words.last])[pair // len(table)]
        across, row = pair_grams(last, words.first[pair % len(table)])
        self.put(np.concatenate([words.grams, across]), np.concatenate([np.bincount(numbers, minlength=len(table))[words.owner], times[row]]))

    def put(self, grams: np.ndarray, n: np.ndarray) -> None:
        _, first, inverse = np.unique(gram_keys(grams), return_index=True, return_inverse=True)
        self.grams.append(grams[first])
        self.n.append(np.bincount(inverse, n, len(first)).astype(np.int64))
        self.size += len(first)
        if self.size > 600_000 and len(self.n) > 1:
            grams, n = np.concatenate(self.grams), np.concatenate(self.n)
            self.grams, self.n, self.size = [], [], 0
            self.put(grams, n)

    def rows(self, lang: str | None) -> Iterator[pa.RecordBatch]:
        grams, n = np.concatenate(self.grams), np.concatenate(self.n)
        self.grams, self.n, self.size = [], [], 0
        self.put(grams, n)
        grams, n = self.grams[0], self.n[0]
        size = (grams != 0).sum(1)
        for k in np.unique(size).tolist():
            of = np.flatnonzero(size == k)
            for at in np.array_split(of, max(1, len(of) // 50_000)):
                texts = np.ascontiguousarray(grams[at, grams.shape[1] - k :]).view(f"<U{k}").ravel().tolist()
                yield pa.record_batch([pa.array([lang] * len(at), pa.string()), pa.array(texts, pa.string()), pa.array(n[at])], names=["lang", "gram", "n"])


def _count(order: int, most: int = 1_500_000) -> Callable:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()  # the models of an earlier run
        counters: dict[str | None, Counter] = {}
        for _, texts, langs in _by_language(batches):
            for lang in set(langs):
                lists = [t.split() for t, x in zip(texts, langs, strict=True) if t and x == lang]
                if any(lists):
                    counters.setdefault(lang, Counter(order)).add(lists)
            if sum(c.size for c in counters.values()) > most:
                for lang, c in counters.items():
                    yield from c.rows(lang)
                counters.clear()
        for lang, c in counters.items():
            yield from c.rows(lang)

    return count


def count_grams(docs: DataFrame, order: int = 5) -> DataFrame:
    """lang, gram, n: how often each n-gram is the longest one of a place. '' is no language, '=x' is language x."""
    lang = F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit("")).alias("lang")
    rows = docs.filter("text is not null").select(lang, "text").mapInArrow(_count(order), COUNTED)
    with batches_of(docs.sparkSession, ROWS):
        return settled(rows.groupBy("lang", "gram").agg(F.sum("n").alias("n")), "grams")


def kneser_ney_counts(longest: DataFrame, order: int) -> list[DataFrame]:
    """lang, gram, n for orders 1 to `order`; n is the count for the highest order, else the Kneser-Ney count."""
    of = lambda k: longest.filter(F.length("gram") == k).select("lang", "gram", F.col("n").alias("raw"), F.lit(0).cast("long").alias("before"))
    levels = [of(order).select("lang", "gram", F.col("raw").alias("n"))]
    for k in range(order - 1, 0, -1):
        shorter = levels[0].select("lang", F.expr("substring(gram, 2)").alias("gram"), F.lit(0).cast("long").alias("raw"), F.lit(1).cast("long").alias("before"))
        rows = shorter.unionByName(of(k)).groupBy("lang", "gram").agg(F.sum("raw").alias("raw"), F.sum("before").alias("before"))
        levels.insert(0, settled(rows.select("lang", "gram", F.when(F.col("before") > 0, F.col("before")).otherwise(F.col("raw")).alias("n")), f"order-{k}"))
    return levels


# ---- the model


def _discount(n: Column, d: Column) -> Column:
    return F.element_at(d, F.least(n, F.lit(3)).cast("int"))


def discounts(level: DataFrame) -> DataFrame:
    """lang, d: the discounts of n-grams that occur once, twice and more often; size: the number of n-grams."""
    ones = [F.greatest(F.count_if(F.col("n") == i), F.lit(1)).alias(f"n{i}") for i in range(1, 5)]
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
    cut = [F.least(F.greatest(i - (i + 1) * y * F.col(f"n{i + 1}") / F.col(f"n{i}"), F.lit(0.0)), F.lit(top)) for i, top in ((1, 0.95), (2, 1.9), (3, 2.8))]
    return level.groupBy("lang").agg(*ones, F.count("*").alias("size")).select("lang", F.array(*cut).alias("d"), "size")


def _few(df: DataFrame, most: int = 100_000) -> DataFrame:
    """`df` to be broadcast if it is known to be small, so that rows are not dealt by language."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def _hash_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1).to_pylist()
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        out = np.zeros(len(texts), np.uint64)
        for k in np.unique(size).tolist():
            of = np.flatnonzero(size == k)
            out[of] = gram_keys(codes([texts[i] for i in of]).reshape(len(of), k)) if k else gram_keys(np.zeros((len(of), 0), np.uint32))
        level = 2 * size.astype(np.int32) + batch.column(2).to_numpy(zero_copy_only=False)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(level), pa.array(out.view(np.int64)), batch.column(3)], names=["lang", "level", "hash", "value"])


def build_model(docs: DataFrame, order: int = 5) -> str:
    """Writes the model of all documents, by language, and returns its folder. Rows: lang; level, which is 2k for the back-off
    weight of a context of k units and 2k + 1 for the probability of an n-gram of k units; hash; value."""
    parts, below = [], None
    for k, level in enumerate(kneser_ney_counts(count_grams(docs, order), order), 1):
        rows = level.join(_few(discounts(level)), "lang").withColumn("context", F.expr(f"left(gram, {k - 1})"))
        cut, after = _discount(F.col("n"), F.col("d")), Window.partitionBy("lang", "context")
        rows = rows.select("lang", "gram", "context", "size", (F.col("n") - cut).alias("own"), F.sum("n").over(after).alias("total"), F.sum(cut).over(after).alias("left"))
        rows = rows.select("lang", "gram", "context", F.expr("substring(gram, 2)").alias("shorter"), "size", (F.col("own") / F.col("total")).alias("own"), (F.col("left") / F.col("total")).alias("rest"))
        if below is None:
            rows = rows.withColumn("p", F.col("own") + F.col("rest") / (F.col("size") + 1))
            parts.append(rows.groupBy("lang").agg((1 / (F.max("size") + 1)).alias("value")).select("lang", F.lit("").alias("gram"), F.lit(True).alias("is_p"), "value"))
        else:
            rows = rows.join(below, ["lang", "shorter"]).withColumn("p", F.col("own") + F.col("rest") * F.col("shorter_p"))
        rows = settled(rows.select("lang", "gram", "context", "rest", "p"), f"model-{k}")
        below = rows.select("lang", F.col("gram").alias("shorter"), F.col("p").alias("shorter_p"))
        parts += [rows.select("lang", "gram", F.lit(True).alias("is_p"), F.col("p").alias("value")), rows.groupBy("lang", F.col("context").alias("gram")).agg(F.first("rest").alias("value")).select("lang", "gram", F.lit(False).alias("is_p"), "value")]
    every = parts[0]
    for x in parts[1:]:
        every = every.unionByName(x)
    folder = new_folder(docs.sparkSession, "kneser-ney")
    by = ["lang", "level", "hash"]
    every.mapInArrow(_hash_grams, "lang string, level int, hash long, value double").repartitionByRange(*by).sortWithinPartitions(*by).write.parquet(folder)
    return folder


class Model:
    """Sorted hash arrays of one language, by kind and order, from the files of build_model."""

    def __init__(self, folder: str, lang: str | None, order: int):
        store, root = fs.FileSystem.from_uri(folder)
        files = sorted(x.path for x in store.get_file_info(fs.FileSelector(root)) if x.path.endswith(".parquet") and x.size)
        name = "" if lang is None else f"={lang}"
        rows = ds.dataset(files, filesystem=store, format="parquet")
        parts = {i: [(np.zeros(0, np.int64), np.zeros(0))] for i in range(2 * order + 2)}
        few = {"use_threads": False, "batch_readahead": 1, "fragment_readahead": 1}  # a worker has little memory
        for batch in rows.to_batches(columns=["level", "hash", "value"], filter=ds.field("lang") == name, **few) if files else ():
            level, hashes, values = (batch.column(i).to_numpy() for i in range(3))
            for i in np.unique(level).tolist():
                of = level == i
                parts[i].append((hashes[of], values[of]))
        self.order, self.levels = order, {}
        for i in list(parts):
            hashes, values = (np.concatenate(x) for x in zip(*parts.pop(i), strict=True))
            by = np.argsort(hashes, kind="stable")  # files are sorted already
            self.levels[i] = hashes[by], values[by]

    def _look(self, p: bool, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        hashes, values = self.levels[2 * grams.shape[1] + p]
        keys = gram_keys(grams).view(np.int64)
        if not len(hashes):
            return np.zeros(len(keys)), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(hashes, keys), len(hashes) - 1)
        return values[at], hashes[at] == keys

    def log_p(self, grams: np.ndarray) -> np.ndarray:
        """The log probability of the last unit of each row after the others; zeros at the left are no units."""
        out, weight, open_ = np.full(len(grams), np.nan), np.ones(len(grams)), np.arange(len(grams))
        for k in range(self.order, -1, -1):
            if k:
                open_now = open_[grams[open_, self.order - k] != 0]
            else:
                open_now = open_
            part = grams[open_now, self.order - k :]
            value, known = self._look(True, part)
            out[open_now[known]] = np.log(np.maximum(weight[open_now[known]] * value[known], 1e-12))
            if k:
                rest, seen = self._look(False, part[~known][:, :-1])
                weight[open_now[~known][seen]] *= rest[seen]
                open_ = open_[np.isnan(out[open_])]
        return out


class Scorer:
    """Log probabilities of texts of one language. Words and pairs of words are looked up once, as long as they are kept."""

    def __init__(self, model: Model):
        self.model, self.keys, self.logs = model, np.zeros(0, np.uint64), np.zeros(0)
        self.table = WordTable(self.describe, 100_000)

    def describe(self, words: list[bytes]) -> dict[str, np.ndarray]:
        x = Words(words, self.model.order)
        keys, first, inverse = np.unique(gram_keys(x.grams), return_index=True, return_inverse=True)
        inner = np.bincount(x.owner, self.model.log_p(x.grams[first])[inverse], len(words)) if len(keys) else np.zeros(len(words))
        return _rule_words(words) | {"inner": inner, "units": x.units, "first": x.first, "last": x.last, "first_key": gram_keys(x.first), "last_key": gram_keys(x.last)}

    def pairs(self, keys: np.ndarray, last: Callable, first: Callable, limit: int = 1_000_000) -> np.ndarray:
        """The log probabilities of the beginnings of words after the ends of others, by sorted distinct keys."""
        at = np.minimum(np.searchsorted(self.keys, keys), max(0, len(self.keys) - 1))
        fresh = np.flatnonzero(self.keys[at] != keys) if len(self.keys) else np.arange(len(keys))
        out = self.logs[at] if len(self.keys) else np.zeros(len(keys))
        if len(fresh):
            grams, row = pair_grams(last(fresh), first(fresh))
            _, one, inverse = np.unique(gram_keys(grams), return_index=True, return_inverse=True)
            out[fresh] = np.bincount(row, self.model.log_p(grams[one])[inverse], len(fresh))
            if len(self.keys) > limit:
                self.keys, self.logs = keys[fresh], out[fresh]
            else:
                place = np.searchsorted(self.keys, keys[fresh])
                self.keys, self.logs = np.insert(self.keys, place, keys[fresh]), np.insert(self.logs, place, out[fresh])
        return out

    def score(self, lists: list[list[bytes]]) -> dict[str, np.ndarray]:
        """For each text: log probability and units, words, their characters and symbols, and words that repeat."""
        t = self.table
        numbers, starts = t.numbers(lists)
        if not len(numbers):
            none = np.zeros(len(lists), np.int64)
            return {"log": np.full(len(lists), np.nan), **dict.fromkeys(("units", "n_words", "word_chars", "n_symbols", "n_repeat_words"), none)}
        before, own = neighbours(numbers, starts)
        no_word = gram_keys(np.zeros((1, t.last.shape[1]), np.uint32))
        key = mixed(np.where(before < 0, no_word[0], t.last_key[before]) * ODD + t.first_key[own])
        keys, one, inverse = np.unique(key, return_index=True, return_inverse=True)
        last = lambda i: np.where((before[one[i]] < 0)[:, None], 0, t.last[before[one[i]]]).astype(np.uint32)
        logs = t.inner[own] + self.pairs(keys, last, lambda i: t.first[own[one[i]]])[inverse]
        out = {name: sums(x[own], starts) for name, x in (("units", t.units), ("word_chars", t.chars), ("n_symbols", t.symbols))}
        n = np.diff(starts)
        return out | {"log": np.where(n > 0, sums(logs, starts), np.nan), "n_words": n, "n_repeat_words": repeated_words(t.hash[own], starts)}


# ---- scoring


def duplicate_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines))


def repeated_words(hashes: np.ndarray, starts: np.ndarray, n: int = 5) -> np.ndarray:
    """For each text, the words in n-word windows that stand twice or more in it."""
    grams_ = gram_hashes(hashes, n)
    if not len(grams_):
        return np.zeros(len(starts) - 1, np.int64)
    owner = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    place = np.flatnonzero(owner[: len(grams_)] == owner[n - 1 :])
    key = mixed(grams_[place] + owner[place].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(key), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    marks = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(marks, place[twice], 1)
    np.add.at(marks, place[twice] + n, -1)
    return sums((np.cumsum(marks)[:-1] > 0).astype(np.int64), starts)


SCORED = "lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, perplexity double"


def _scorer(folder: str, order: int) -> Callable:
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorers: dict[str | None, Scorer] = held(f"perplexity {folder}", dict)
        for batch, texts, langs in _by_language(batches):
            lists = [t.split() if t else [] for t in texts]
            out = {c: np.zeros(len(texts), np.int64) for c in ("units", "n_words", "word_chars", "n_symbols", "n_repeat_words")} | {"log": np.full(len(texts), np.nan)}
            for lang in set(langs):
                chosen = [i for i, x in enumerate(langs) if x == lang]
                if lang not in scorers:
                    scorers[lang] = Scorer(Model(folder, lang, order))
                for c, x in scorers[lang].score([lists[i] for i in chosen]).items():
                    out[c][chosen] = x
            failed = (out["n_words"] < 10) | (100 * out["n_repeat_words"] > 20 * out["n_words"])
            perplexity = np.exp(-out["log"] / np.maximum(1, out["units"]))
            dup = [duplicate_lines(t) if t else 0 for t in texts]
            rules = [pa.array(out[c]) for c in ("n_words", "word_chars", "n_symbols")] + [pa.array(dup, pa.int64()), pa.array(out["n_repeat_words"])]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(batch.schema.get_field_index("lang")), *rules, pa.array(failed), pa.array(perplexity, from_pandas=True)],
                names=["doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "perplexity"],
            )

    return score


def _middle(rows: list[tuple[int, int]]) -> int:
    """The median of sorted values with their counts."""
    total, run = sum(n for _, n in rows), 0
    for v, n in rows:
        run += n
        if 2 * run >= total:
            return v
    raise ValueError("no rows")


def bands(scored: DataFrame, spreads: float = 3.0) -> list[tuple]:
    """(lang, low, high): the median log perplexity of documents that pass the base rules, and `spreads` standard
    deviations on both sides, each 1.4826 median absolute deviations as in a normal distribution (1.2533 mean ones where
    the median one is 0, as with many copies). Tasks add up a histogram with bins of STEP, so the driver gets some
    thousand rows a language."""
    bins = scored.filter("not base_failed and perplexity is not null").groupBy("lang", F.floor(F.log("perplexity") / STEP).alias("bin")).agg(F.count("*").alias("n"))
    by: dict[str | None, list[tuple[int, int]]] = {}
    for r in bins.collect():
        by.setdefault(r["lang"], []).append((r["bin"], r["n"]))
    out = []
    for lang, rows in by.items():
        middle = _middle(sorted(rows))
        away = sorted((abs(b - middle), n) for b, n in rows)
        spread = 1.4826 * _middle(away) or 1.2533 * sum(d * n for d, n in away) / sum(n for _, n in away)
        out.append((lang, float(np.exp((middle - spreads * spread) * STEP)), float(np.exp((middle + 1 + spreads * spread) * STEP))))
    return out


def quality_rules(docs: DataFrame, order: int = 5, spreads: float = 3.0) -> DataFrame:
    """doc_id, the base counts, base_failed, lang, perplexity, the band of its language, and kept, for each row."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), "text")
    model = build_model(docs, order)
    kind = docs.schema["doc_id"].dataType.simpleString()
    with batches_of(spark, ROWS):
        scored = settled(docs.mapInArrow(_scorer(model, order), f"doc_id {kind}, {SCORED}"), "scored")
    limits = spark.createDataFrame(bands(scored, spreads), "l string, band_low double, band_high double")
    out = scored.join(F.broadcast(limits), F.col("lang").eqNullSafe(F.col("l")), "left").drop("l")
    return out.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("perplexity").between(F.col("band_low"), F.col("band_high")), F.lit(False)))


def op3_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(tables(spark, sf_dir, "documents"))

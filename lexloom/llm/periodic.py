"""Operator 12: periodic runs of words, by an online sparse dynamic programme over diagonals, and texts without the repeats.

A run is a stretch of consecutive words with smallest period q (words q apart are identical) and a length of at least
max(`least`, `times` * q) that neither neighbour extends. On the diagonal of lag q such a stretch is a chain of matches
word[i] = word[i - q]. Going through the words in order, the earlier occurrences of a word say which lags match here: a
lag that also matched at the word before has its match length raised by one, other lags begin, and a diagonal that does not
go on ends; if its length suffices its run is emitted at once.

The programme is sparse in two ways that lose no run. An earlier occurrence counts only if the `K` words that end there are
the same too, where K is the power of two with K / 2 < q <= K (8 at least): as a run has 3q words or more, its chain is
longer than K, and a diagonal begins with K matches instead of 1. And of the occurrences of those K words only the nearest
earlier one counts: K words of a run hold a whole period, which stands in the run at multiples of q alone, so the nearest
is the one at lag q, and lags that are multiples of the smallest period never begin. So a word has at most one lag for
each K, and a text of n words costs O(n log n), one word repeated a million times included.

Occurrences of K words are numbered exactly, by pairs of numbers of K / 2 words; what stands once is left out of the next
step, so prose without repeats ends after a few steps. A text is worked on whole in one task; it needs about 100 bytes a word.

Edge cases: null, empty and word-less texts have no runs and an empty text left; repeated rows give a row each; rows without
doc_id too; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordTable, chunks, held, tables

RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
RUNS = "n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def lags(words: np.ndarray, owner: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places, lags and first match lengths: where the same K words end nearest before, K / 2 < lag <= K (lag <= K for K = 8).

    `words` are numbers, `owner` the text of each place; matches of different texts do not count. `longest` is the largest
    lag asked for."""
    n = len(words)
    at, code = np.arange(n), owner * (int(words.max(initial=0)) + 1) + words
    full = np.full(n, -1, np.int64)
    found = []
    k = 1
    while True:
        order = np.argsort(code, kind="stable")
        same = code[order[1:]] == code[order[:-1]]
        again = np.zeros(len(at), bool)
        again[order[1:]] = same
        if k >= 8:
            before, here = at[order[:-1][same]], at[order[1:][same]]
            lag = here - before
            good = (lag <= k) & ((lag > k // 2) | (k == 8))
            found.append((here[good], lag[good], np.full(good.sum(), k)))
        name = np.empty(len(at), np.int64)
        name[order] = np.cumsum(np.r_[True, ~same])[: len(at)]
        again[order[:-1][same]] = True
        at, name = at[again], name[again]
        if not len(at) or k >= max(8, longest):
            break
        full[:] = -1
        full[at] = name
        inside = at >= k
        at, name = at[inside], name[inside]
        left = full[at - k]
        good = (left >= 0) & (owner[at - k] == owner[at])
        at, code = at[good], left[good] * (n + 1) + name[good]
        k *= 2
    if not found:
        return (np.zeros(0, np.int64),) * 3
    place, lag, first = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((lag, place))
    return place[order], lag[order], first[order]


def runs_of(places: list[int], lag: list[int], first: list[int], least: int, times: int) -> list[tuple[int, int, int]]:
    """The (start, length, period) of all runs, by start and period. The lags come by place; `first` is the match length
    that a diagonal begins with."""
    out: list[tuple[int, int, int]] = []
    active: dict[int, int] = {}

    def ended(q: int, matched: int, last: int) -> None:
        if matched + q >= max(least, times * q):
            out.append((last + 1 - matched - q, matched + q, q))

    now: dict[int, int] = {}
    last = -2
    for i, q, k in zip(places, lag, first, strict=True):
        if i != last:
            for p, matched in active.items():  # what did not go on at `last`
                if p not in now:
                    ended(p, matched, last - 1)
            active, now = now, {}
            if i != last + 1:
                for p, matched in active.items():
                    ended(p, matched, last)
                active = {}
            last = i
        now[q] = active.get(q, k - 1) + 1
    for p, matched in active.items():
        if p not in now:
            ended(p, matched, last - 1)
    for p, matched in now.items():
        ended(p, matched, last)
    return sorted((s, n, q) for s, n, q in out)


def _finder(least: int, times: int) -> Callable:
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = held("periodic", lambda: WordTable(lambda words: {}))
        for batch, texts in chunks(batches):
            lists = [t.split() if t else [] for t in texts]
            words, starts = table.numbers(lists)
            owner = np.repeat(np.arange(len(lists)), np.diff(starts))
            place, lag, first = lags(words, owner, int(np.diff(starts).max(initial=0)) // times)
            bounds = np.searchsorted(place, starts).tolist()
            runs, left = [], []
            for i, ws in enumerate(lists):
                a, b = bounds[i], bounds[i + 1]
                found = runs_of((place[a:b] - starts[i]).tolist(), lag[a:b].tolist(), first[a:b].tolist(), least, times) if a < b else []
                if found:
                    gone = np.zeros(len(ws) + 1, np.int64)
                    for s, n, q in found:
                        gone[s + q] += 1
                        gone[s + n] -= 1
                    ws = [ws[j] for j in np.flatnonzero(np.cumsum(gone[:-1]) == 0).tolist()]
                runs.append([{"start": s, "length": n, "period": q} for s, n, q in found])
                left.append(b" ".join(ws))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(starts)), pa.array(runs, pa.list_(RUN)), pa.array(left, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])

    return find


def periodic_runs(docs: DataFrame, least: int = 24, times: int = 3) -> DataFrame:
    """doc_id, n_words, runs (by start, then period) and collapsed for each row of `docs`.

    `collapsed` is the text without the words that a run contains after its first period, joined by one space. A word
    numbered from 0 is what stands between ASCII white space."""
    if times < 3 or least < 24:
        raise ValueError("runs of fewer than 24 words or 3 periods are not searched")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(_finder(least, times), f"doc_id {kind}, {RUNS}")


def best(runs: Column) -> Column:
    """The run of greatest length / period, exactly; of equals the first."""
    return F.reduce(F.slice(runs, 2, F.greatest(F.size(runs) - 1, F.lit(0))), F.get(runs, F.lit(0)), lambda x, r: F.when(r["length"] * x["period"] > x["length"] * r["period"], r).otherwise(x))


def with_loops(docs: DataFrame) -> DataFrame:
    """doc_id and text; about one text in ten goes round a stretch of its own words from some word on. Which ones, and
    where, follows from crc32(doc_id as text) = h: if h % 10 = 0, g = floor(h / 10), a = g % n and p = 1 + floor((n - a) /
    (3 + g % 8)), each word i >= a of n becomes word a + (i - a) % p. Texts without words, and rows without doc_id, stay."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))

    def looped(words: Column) -> Column:
        g, n = F.floor(h / 10).cast("long"), F.size(words)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(words, F.when(i >= a, a + (i - a) % p).otherwise(i).cast("int"))), " "))

    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    once = F.transform(F.array(words), looped)[0]  # the words are made once a text
    return docs.select("doc_id", F.when(h % 10 == 0, once).otherwise(F.col("text")).alias("text"))


def op12_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(with_loops(tables(spark, sf_dir, "documents"))).withColumn("best", best(F.col("runs")))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.floor(F.lit(1000) * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(F.lit("")).cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"), "n_words",
    )

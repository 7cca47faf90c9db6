"""Operator 1: passages that repeat, by a sparse suffix array over words.

1. Of each text only the suffixes at minimiser positions are kept: places whose `K`-word gram has the smallest hash of
   some `passage - prefix + 1` places in a row. Copies of a passage of `passage` words then keep the same suffix, and
   its first `prefix` words lie inside the passage.
2. Suffixes that share their first `prefix` words with no other end here (a partial aggregate by the hash of these words).
   Of suffixes with the same surroundings (`passage - prefix` words before and `passage` words after) one goes on.
3. The others are sorted by their words and neighbours are compared. For each number of words before, from none to
   `passage - prefix`, suffixes of which a window begins so far before and that agree on these words stand in the order of the words that follow, so that the longest match
   to the right is with a neighbour; where both parts make up `passage` words, the neighbours match as far as they agree.
   Suffixes whose whole surroundings agree with another's are matched at once.
4. Words with the same prefix in more than `RUN` places are not sorted in one task: there, every window of `passage`
   words over the suffix is counted by its hash, which finds the same matches by aggregates.
5. Matches are merged to the longest spans of each document. As every window of `passage` words in a longer repeat is
   found, so is the whole repeat, to its ends.

Prefixes and windows are compared by 64-bit hashes, words in sorted runs by 32 bits of theirs.

Result, one row a span: doc_id, start_word, end_word (exclusive), n_words, first_doc_id (smallest document that has some
of it), removable (no part of it is its first occurrence). Words are those between ASCII white space, as they stand.

Edge cases: null, empty and short texts have no spans; a passage that repeats within one document counts, as do repeated
rows and rows that repeat a doc_id with another text, each of which has spans of its own; documents without doc_id are
left out; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WordTable, chunks, gram_hashes, held, mixed, settled, tables, word_hash

K = 8
BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POWERS: dict[str, np.ndarray] = {}
RUN = 512
SPANS = "row long, doc_id long, at int, a int, b int, first_doc long, is_first boolean"
SUFFIXES = "doc_id long, text_hash long, row long, at int, before int, after int, low int, high int, key long, around long"


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        for name, b in (("up", BASE), ("down", _INVERSE)):
            _POWERS[name] = np.cumprod(np.r_[np.uint64(1), np.full(max(n, 4096) * 2, b)], dtype=np.uint64)
    return _POWERS["up"][:n], _POWERS["down"][:n]


class Windows:
    """Hashes of any run of words of a text in constant time."""

    def __init__(self, hashes: np.ndarray):
        up, self.down = _powers(len(hashes) + 1)
        self.sums = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(hashes * up[:-1], out=self.sums[1:], dtype=np.uint64)

    def hash(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mixed((self.sums[b] - self.sums[a]) * self.down[a] + (b - a).astype(np.uint64))


def _sliding(x: np.ndarray, width: int, fold: np.ufunc) -> np.ndarray:
    """fold over each `width` values in a row."""
    done, out = 1, x
    while done < width:
        step = min(done, width - done)
        out = fold(out[:-step], out[step:])
        done += step
    return out


def minimisers(hashes: np.ndarray, width: int, prefix: int) -> np.ndarray:
    """Places whose K-gram is the smallest of some `width` places in a row, among those with `prefix` words behind them."""
    n = len(hashes) - prefix + 1
    if n < width:
        return np.zeros(0, np.int64)
    grams = gram_hashes(hashes, K)[:n]
    least = _sliding(grams, width, np.minimum)
    edge = np.zeros(width - 1, np.uint64)
    return np.flatnonzero(_sliding(np.concatenate([edge, least, edge]), width, np.maximum) == grams)


def own_windows(hashes: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Of how many words before each place the windows begin of which it is the first smallest of `width` places: from, to.

    So each window belongs to one suffix, the same one in each of its copies."""
    grams = np.pad(gram_hashes(hashes, K), width - 1, constant_values=np.uint64((1 << 64) - 1))
    around = np.lib.stride_tricks.sliding_window_view(grams, 2 * width - 1)[at]
    own = around[:, width - 1 : width]
    back, on = around[:, : width - 1][:, ::-1] <= own, around[:, width:] < own
    high = np.where(back.any(1), back.argmax(1), width - 1)
    return width - 1 - np.where(on.any(1), on.argmax(1), width - 1), high


def _texts(texts: list[bytes | None]) -> Iterator[np.ndarray]:
    table = held("suffixes", lambda: WordTable(word_hash))
    numbers, starts = table.numbers([t.split() if t else [] for t in texts])
    hashes = table.hash[numbers] if len(numbers) else np.zeros(0, np.uint64)
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        yield hashes[a:b]


def _suffixes(passage: int, prefix: int) -> Callable:
    def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 40
        for batch, texts in chunks(batches):
            out: list[tuple[np.ndarray, ...]] = []
            for doc, text_hash, hashes in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), _texts(texts), strict=True):
                row += 1
                if len(hashes) < passage:
                    continue
                at = minimisers(hashes, passage - prefix + 1, prefix)
                before, after = np.minimum(at, passage - prefix), np.minimum(len(hashes) - at, passage)
                low, high = own_windows(hashes, at, passage - prefix + 1)
                low, high = np.maximum(low, passage - after), np.minimum(high, before)
                at, before, after, low, high = (x[low <= high] for x in (at, before, after, low, high))
                w = Windows(hashes)
                around = w.hash(at - before, at + after) + before.astype(np.uint64)
                n = len(at)
                out.append((np.full(n, doc), np.full(n, text_hash), np.full(n, row), at.astype(np.int32), before.astype(np.int32), after.astype(np.int32), low.astype(np.int32), high.astype(np.int32), w.hash(at, at + prefix).view(np.int64), around.view(np.int64)))
            if out:
                yield pa.record_batch([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=[x.split()[0] for x in SUFFIXES.split(", ")])

    return suffixes


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, dict, np.ndarray]]:
    """doc_id, suffix and word hashes of the text, for each suffix that is asked for."""
    for batch, texts in chunks(batches):
        for doc, suffixes, hashes in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), _texts(texts), strict=True):
            for s in suffixes:
                yield doc, s, hashes


def _windows(passage: int) -> Callable:
    """For each suffix of a document: the hashes of its windows of `passage` words, by where they begin."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held, last = [], 0, None
        for doc, s, hashes in _asked(batches):
            if last is None or last[0] is not hashes:
                last = hashes, Windows(hashes)
            begin = np.arange(s["at"] - s["high"], s["at"] - s["low"] + 1)
            n = len(begin)
            out.append((np.full(n, doc), np.full(n, s["row"]), np.full(n, s["at"]), np.full(n, s["many"]), begin, last[1].hash(begin, begin + passage).view(np.int64)))
            held += n
            if held > 200_000:
                yield pa.record_batch([pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*out, strict=True)], names=["doc_id", "row", "at", "many", "begin", "window"])
                out, held = [], 0
        if out:
            yield pa.record_batch([pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*out, strict=True)], names=["doc_id", "row", "at", "many", "begin", "window"])

    return windows


def _contexts(passage: int, prefix: int) -> Callable:
    """For each suffix of a document: the words before it, the nearest first, and from it on, as 32 bits of their hashes."""

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wide, out = passage - prefix, []

        def rows() -> pa.RecordBatch:
            doc, s, left, right = zip(*out, strict=True)
            of = lambda c, kind: pa.array([x[c] for x in s], kind)
            return pa.record_batch([of("key", pa.int64()), pa.array(doc, pa.int64()), of("row", pa.int64()), of("at", pa.int32()), of("before", pa.int32()), of("after", pa.int32()), of("low", pa.int32()), of("high", pa.int32()), of("many", pa.bool_()), pa.array(left, pa.binary()), pa.array(right, pa.binary())], names=["key", "doc_id", "row", "at", "before", "after", "low", "high", "many", "left", "right"])

        for doc, s, hashes in _asked(batches):
            at = s["at"]
            short = (hashes[at - s["before"] : at + s["after"]] >> np.uint64(32)).astype(">u4")
            left, right = np.zeros(wide, ">u4"), np.zeros(passage, ">u4")
            left[: s["before"]] = short[: s["before"]][::-1]
            right[: s["after"]] = short[s["before"] :]
            out.append((doc, s, left.tobytes(), right.tobytes()))
            if len(out) >= 5000:
                yield rows()
                out.clear()
        if out:
            yield rows()

    return contexts


def agreeing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many words at the begin of each row of `a` are those of `b`."""
    same = a == b
    return np.where(same.all(1), a.shape[1], same.argmin(1)) if len(a) else np.zeros(0, np.int64)


def matches(key: np.ndarray, place: np.ndarray, low: np.ndarray, high: np.ndarray, after: np.ndarray, many: np.ndarray, left: np.ndarray, right: np.ndarray, passage: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For suffixes with keys: how many words before and from each on are in a window of `passage` words that stands at
    another's place too, the smallest place with one of these windows, and whether it has one of them first. `place` has
    the order of first occurrences. Of suffixes with `many`, all windows stand elsewhere, at places that are not given."""
    n, none = len(key), np.iinfo(np.int64).max
    lead, reach, first, is_first = np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(n, none), np.zeros(n, bool)
    # A suffix array: the rank of each suffix by its words, and its ranks by the words before it.
    by_right = np.lexsort((*right.T[::-1], key))
    rank = np.empty(n, np.int64)
    rank[by_right] = np.arange(n)
    before_class = np.unique(key, return_inverse=True)[1].astype(np.int64)
    for wide in range(left.shape[1] + 1):
        if wide:
            before_class = np.unique(before_class * (1 << 32) + left[:, wide - 1], return_inverse=True)[1].astype(np.int64)
        able = np.flatnonzero((low <= wide) & (wide <= high))
        order = able[np.lexsort((rank[able], before_class[able]))]
        if not len(order):
            continue
        same = before_class[order[1:]] == before_class[order[:-1]]
        r = np.where(same, np.minimum(agreeing(right[order[1:]], right[order[:-1]]), np.minimum(after[order[1:]], after[order[:-1]])), 0)
        good = wide + r >= passage
        both = np.r_[False, good] | np.r_[good, False]
        longest = np.maximum(np.r_[0, np.where(good, r, 0)], np.r_[np.where(good, r, 0), 0])
        lead[order[both]] = wide
        np.maximum.at(reach, order[both], longest[both])
        run = np.cumsum(np.r_[True, ~good]) - 1  # neighbours that match are one run: the same window
        least = np.full(run[-1] + 1, none)
        np.minimum.at(least, run, place[order])
        first[order[both]] = np.minimum(first[order[both]], least[run][both])
        is_first[order] |= (both | many[order]) & (least[run] == place[order])
    return lead, reach, first, is_first


def _sorted_runs(passage: int) -> Callable:
    """Spans of suffixes, which come in the order of their keys, from matches with their neighbours."""

    def spans(table: pa.Table) -> pa.RecordBatch:
        key, doc, row, at, low, high, after, many = (table.column(c).to_numpy() for c in ("key", "doc_id", "row", "at", "low", "high", "after", "many"))
        left, right = (np.frombuffer(b"".join(table.column(c).to_pylist()), ">u4").reshape(len(key), -1).astype(np.int64) for c in ("left", "right"))
        order = np.lexsort((at, row, doc))
        once = np.r_[True, (row[order[1:]] != row[order[:-1]]) | (at[order[1:]] != at[order[:-1]])]  # a text may have come twice
        order = order[once]
        key, doc, row, at, low, high, after, many, left, right = (x[order] for x in (key, doc, row, at, low, high, after, many, left, right))
        place = np.arange(len(key))
        lead, reach, first, is_first = matches(key, place, low, high, after, many, left, right, passage)
        of = np.flatnonzero((reach > 0) | is_first)
        first_doc = doc[np.minimum(first, place)[of]]
        return pa.record_batch([pa.array(row[of]), pa.array(doc[of]), pa.array(at[of]), pa.array((at - lead)[of].astype(np.int32)), pa.array((at + reach)[of].astype(np.int32)), pa.array(first_doc), pa.array(is_first[of])], names=[x.split()[0] for x in SPANS.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        for batch in batches:
            key = batch.column(0).to_numpy()
            cut = int(np.searchsorted(key, key[-1])) if len(key) else 0  # the last key may go on in the next batch
            if cut and (waiting or cut < len(key)):
                yield spans(pa.Table.from_batches([*waiting, batch.slice(0, cut)]))
                waiting = []
            elif waiting and len(key) and waiting[-1].column(0)[-1].as_py() != key[0]:
                yield spans(pa.Table.from_batches(waiting))
                waiting = []
            waiting.append(batch.slice(cut))
        if sum(map(len, waiting)):
            yield spans(pa.Table.from_batches(waiting))

    return run


def _join_hot(rows: DataFrame, by: DataFrame, key: str, n: str, share: int = 1000, parts: int = 64) -> DataFrame:
    """`rows` joined with `by`, which has one row a key and in `n` how many of the rows have it. Keys with more than a
    `share`-th of the rows, of which there are fewer than `share`, fall in parts."""
    hot = by.filter(F.col(n) * share > rows.count()).select(F.col(key).alias("hot_key"))
    salted = rows.join(F.broadcast(hot), F.col(key) == F.col("hot_key"), "left")
    salted = salted.withColumn("part", F.when(F.col("hot_key").isNotNull(), F.pmod(F.xxhash64("row", "at"), F.lit(parts))).otherwise(0).cast("int")).drop("hot_key")
    spread = by.join(F.broadcast(hot), F.col(key) == F.col("hot_key"), "left")
    spread = spread.withColumn("part", F.explode(F.when(F.col("hot_key").isNotNull(), F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(F.array(F.lit(0))))).drop("hot_key")
    return salted.join(spread, [key, "part"]).drop("part")


def repeated_passages(docs: DataFrame, passage: int = 50, prefix: int = 25, run: int = RUN) -> DataFrame:
    """Spans of `passage` words or more that stand elsewhere too; see the head of this module."""
    text = F.col("text").cast("string")
    docs = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash"))
    suffixes = settled(docs.mapInArrow(_suffixes(passage, prefix), SUFFIXES), "suffixes")
    alike = settled(suffixes.groupBy("key").agg(F.count("*").alias("n"), (F.min("around") != F.max("around")).alias("differ")).filter("n > 1"), "prefixes")
    near = settled(_join_hot(suffixes, alike, "key", "n"), "neighbours")
    place = F.struct("doc_id", "row", "at", "before", "after", "low", "high", "text_hash")
    groups = settled(near.groupBy("key", "around", "differ", (F.col("n") > run).alias("hot")).agg(F.count("*").alias("copies"), F.min(place).alias("first")), "surroundings")

    # One of each surroundings where they differ, with its text.
    suffix = F.struct(*(F.col(f"first.{c}").alias(c) for c in ("row", "at", "before", "after", "low", "high")), "key", (F.col("copies") > 1).alias("many"))
    one = groups.filter("differ").select(F.col("first.doc_id").alias("asked"), F.col("first.text_hash").alias("asked_hash"), "hot", suffix.alias("s"))

    def asked(rows: DataFrame) -> DataFrame:
        lists = rows.groupBy("asked", "asked_hash").agg(F.collect_list("s").alias("suffixes"))
        return docs.join(lists, (F.col("doc_id") == F.col("asked")) & (F.col("text_hash") == F.col("asked_hash"))).select("doc_id", "text", "suffixes")

    contexts = asked(one.filter("not hot")).mapInArrow(_contexts(passage, prefix), "key long, doc_id long, row long, at int, before int, after int, low int, high int, many boolean, left binary, right binary")
    part = contexts.repartition("key").sortWithinPartitions("key").mapInArrow(_sorted_runs(passage), SPANS)
    if one.filter("hot").limit(1).count():
        windows = settled(asked(one.filter("hot")).mapInArrow(_windows(passage), "doc_id long, row long, at long, many long, begin long, window long"), "windows")
        least = windows.groupBy("window").agg(F.min(F.struct("doc_id", "row", "begin")).alias("first"), F.max(F.struct("doc_id", "row", "begin")).alias("last"))
        at_first = (F.col("first.row") == F.col("row")) & (F.col("first.begin") == F.col("begin"))
        hits = windows.join(least, "window").filter("first != last or many = 1")
        part = part.unionByName(hits.select("row", "doc_id", F.col("at").cast("int").alias("at"), F.col("begin").cast("int").alias("a"), (F.col("begin") + passage).cast("int").alias("b"), F.col("first.doc_id").alias("first_doc"), at_first.alias("is_first")))
    part = settled(part, "matches")

    # Whole surroundings that stand at several places; what was found for one of them holds for all.
    earlier = part.groupBy("row", "at").agg(F.min("first_doc").alias("first_doc"))
    several = groups.filter("copies > 1").select("key", "around", "differ", F.col("first.doc_id").alias("doc"), F.col("first.row").alias("first_row"), F.col("first.at").alias("first_at"))
    several = several.join(earlier, (F.col("first_row") == F.col("row")) & (F.col("first_at") == F.col("at")), "left").select("key", "around", "first_row", "first_at", F.least("doc", "first_doc").alias("first_doc"))
    whole = near.join(several, ["key", "around"])
    at_first = ~F.col("differ") & (F.col("first_row") == F.col("row")) & (F.col("first_at") == F.col("at"))
    full = whole.select("row", "doc_id", "at", (F.col("at") - F.col("before")).alias("a"), (F.col("at") + F.col("after")).alias("b"), "first_doc", at_first.alias("is_first"))
    found = full.unionByName(part)

    by_place = Window.partitionBy("row").orderBy("a", "b")
    merged = found.withColumn("reach", F.max("b").over(by_place.rowsBetween(Window.unboundedPreceding, -1))).withColumn("new", (F.col("reach").isNull() | (F.col("a") > F.col("reach"))).cast("int"))
    merged = merged.withColumn("span", F.sum("new").over(by_place.rowsBetween(Window.unboundedPreceding, 0)))
    out = merged.groupBy("row", "span").agg(F.first("doc_id").alias("doc_id"), F.min("a").alias("start_word"), F.max("b").alias("end_word"), F.min("first_doc").alias("first_doc_id"), (~F.bool_or("is_first")).alias("removable"))
    return out.select("doc_id", F.col("start_word").cast("long").alias("start_word"), F.col("end_word").cast("long").alias("end_word"), (F.col("end_word") - F.col("start_word")).cast("long").alias("n_words"), "first_doc_id", "removable")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(tables(spark, sf_dir, "documents"))

"""Operator 11: phrase collocations by SETM, set-oriented mining with joins of sorted occurrence relations.

The relation of length k says which phrase of k words begins at which place. It is written to the shared folder in slices
of some MB of text, and within a slice it is sorted by place: an array holds for each place the number of the phrase that
begins there, or 0. Places count the words of a piece one by one and leave one out between pieces and documents, so that
phrases are adjacent in a piece just if their places are.

1. Words are numbered within each slice; Spark adds up their counts by language, and frequent words get ids.
2. Semi-join: the relation keeps the places whose phrases are frequent; other places become 0.
3. Merge-join by piece and adjacent position: a phrase of k words begins where phrases of k - 1 words begin at a place and
   at the next one. Both are frequent, as each part of a frequent phrase is.
4. Group and count: each slice counts its own phrases, exactly, as pairs of ids of the two parts. The counts are dealt to
   buckets by a hash of the pair, about `bucket` words of text each, added up, and frequent phrases get ids. Then step 2
   again with their numbers, for the next length.

Only counts of different phrases of a slice are shuffled, so a hot phrase has one row a slice. Scores are exact decimals.

Edge cases: null and empty texts have no words; a null language is `und`; repeated rows count as often as they stand; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import LOWER, chunks, mixed, settled, tables

# Lower-cases A-Z, makes a tab a space and every sign between pieces a full stop, which so is never part of a word.
PIECES = bytes(0x20 if b == 0x09 else 0x2E if b in b".,;:!?\n\x0b\x0c\r" else LOWER[b] for b in range(256))
RELATION = "slice long, numbers binary, ids binary"
COUNTS = "bucket long, slice long, number binary, a binary, b binary, n binary"
GROUPS = "slice long, number binary, id binary, phrases array<struct<id: long, a: long, b: long, f: long>>"


def written(df: DataFrame, name: str) -> DataFrame:
    """As settled(), compressed better, as these tables are large."""
    return settled(df, name, compression="zstd")


def squeezed(x: np.ndarray) -> bytes:
    """Whole numbers as compressed bytes, the first bytes of all numbers first."""
    flat = np.ascontiguousarray(x.astype("<i8").view(np.uint8).reshape(-1, 8).T)
    return b"%d " % len(x) + pa.compress(flat.tobytes(), codec="zstd", asbytes=True) if len(x) else b""


def loosed(x: bytes) -> np.ndarray:
    if not x:
        return np.zeros(0, np.int64)
    n, _, rest = x.partition(b" ")
    flat = np.frombuffer(pa.decompress(rest, 8 * int(n), codec="zstd"), np.uint8)
    return np.ascontiguousarray(flat.reshape(8, -1).T).view("<i8").ravel()


class Numbers(dict):
    """Numbers of the words of one language, drawn from a vocabulary that languages share."""

    def __init__(self, lang: str, vocabulary: list[tuple[str, bytes]]):
        super().__init__({b".": 0})
        self.lang, self.vocabulary = lang, vocabulary

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self.vocabulary)
        self.vocabulary.append((self.lang, word))
        return n


def _slicer(size: int) -> Callable:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        slice_id = TaskContext.get().partitionId() << 32
        for batch, texts in chunks(batches, "text", size):
            vocabulary: list[tuple[str, bytes]] = [("", b"")]
            by_lang: dict[str, Numbers] = {}
            parts = []
            for lang, text in zip(batch.column(0).to_pylist(), texts, strict=True):
                if text:
                    words = text.translate(PIECES).replace(b".", b" . ").split()
                    numbers = by_lang.get(lang) or by_lang.setdefault(lang, Numbers(lang, vocabulary))
                    parts.append(map(numbers.__getitem__, words))
                    parts.append((0,))
            numbers = np.fromiter(chain.from_iterable(parts), np.int64)
            n = np.bincount(numbers, minlength=len(vocabulary))[1:]
            kinds = pa.StructArray.from_arrays([pa.array([x for x, _ in vocabulary[1:]], pa.string()), pa.array([w for _, w in vocabulary[1:]], pa.binary()).cast(pa.string()), pa.array(n, pa.int64())], ["lang", "word", "n"])
            yield pa.RecordBatch.from_arrays([pa.array([slice_id], pa.int64()), pa.array([squeezed(numbers)], pa.binary()), pa.ListArray.from_arrays(pa.array([0, len(n)], pa.int32()), kinds)], names=["slice", "numbers", "vocabulary"])
            slice_id += 1

    return cut


def adjacent(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where phrases begin both at a place and at the next, and the two numbers as one."""
    at = np.flatnonzero((numbers[:-1] > 0) & (numbers[1:] > 0))
    return at, numbers[at] * (int(numbers.max(initial=0)) + 1) + numbers[at + 1]


def _counter(buckets: int) -> Callable:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                numbers, ids = loosed(row["numbers"]), loosed(row["ids"])
                codes, n = np.unique(adjacent(numbers)[1], return_counts=True)
                a, b = (ids[x] for x in divmod(codes, int(numbers.max(initial=0)) + 1))
                bucket = (mixed(a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + b.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
                full = np.flatnonzero(np.diff(cut)).tolist()
                parts = [order[cut[k] : cut[k + 1]] for k in full]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(full, pa.int64()), pa.array([row["slice"]] * len(full), pa.int64()), *(pa.array([squeezed(x[p]) for p in parts], pa.binary()) for x in (np.arange(len(codes)), a, b, n))],
                    names=["bucket", "slice", "number", "a", "b", "n"],
                )

    return count


def _adder(least: int) -> Callable:
    def add(table: pa.Table) -> pa.Table:
        """The counts of one bucket from all slices: ids for frequent phrases, and which numbers of each slice have them."""
        slices = table.column("slice").to_numpy()
        number, a, b, n = ([loosed(x) for x in table.column(c).to_pylist()] for c in ("number", "a", "b", "n"))
        ends = np.cumsum([len(x) for x in a])
        a, b, n = np.concatenate(a), np.concatenate(b), np.concatenate(n)
        order = np.lexsort((b, a))
        first = np.r_[True, (a[order[1:]] != a[order[:-1]]) | (b[order[1:]] != b[order[:-1]])]
        begin = np.flatnonzero(first)
        f = np.add.reduceat(n[order], begin)
        frequent = f >= least
        of = np.where(frequent, (table.column("bucket")[0].as_py() << 32) + np.cumsum(frequent), 0)
        ids = np.empty(len(a), np.int64)
        ids[order] = of[np.cumsum(first) - 1]
        lists = []
        for s, x, i in zip(slices.tolist(), number, np.split(ids, ends[:-1]), strict=True):
            if i.any():
                lists.append((s, squeezed(x[i > 0]), squeezed(i[i > 0])))
        at = order[begin[frequent]]
        phrases = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (of[frequent], a[at], b[at], f[frequent])], ["id", "a", "b", "f"])
        empty = len(lists)
        return pa.table([
            pa.array([s for s, _, _ in lists] + [-1], pa.int64()), pa.array([x for _, x, _ in lists] + [None], pa.binary()), pa.array([i for _, _, i in lists] + [None], pa.binary()),
            pa.ListArray.from_arrays(pa.array([0] * (empty + 1) + [len(at)], pa.int32()), phrases),
        ], names=["slice", "number", "id", "phrases"])

    return add


def _semi_join(numbers: np.ndarray, number: np.ndarray, ids: np.ndarray, slice_id: int) -> pa.Table:
    """The relation where only the given numbers stay, numbered anew from 1, with their ids."""
    new = np.zeros(int(numbers.max(initial=0)) + 1, np.int64)
    new[number] = np.arange(1, len(number) + 1)
    row = [pa.array([slice_id], pa.int64()), pa.array([squeezed(new[numbers])], pa.binary()), pa.array([squeezed(np.append(0, ids))], pa.binary())]
    return pa.table(row, names=["slice", "numbers", "ids"])


def _frequent_words(left: pa.Table, right: pa.Table) -> pa.Table:
    if not left.num_rows:
        return pa.table([[], [], []], schema=pa.schema([("slice", pa.int64()), ("numbers", pa.binary()), ("ids", pa.binary())]))
    return _semi_join(loosed(left.column("numbers")[0].as_py()), right.column("number").to_numpy(), right.column("id").to_numpy(), left.column("slice")[0].as_py())


def _frequent_phrases(left: pa.Table, right: pa.Table) -> pa.Table:
    numbers = loosed(left.column("numbers")[0].as_py()) if left.num_rows else np.zeros(0, np.int64)
    at, codes = adjacent(numbers)
    longer = np.zeros(len(numbers), np.int64)
    longer[at] = np.unique(codes, return_inverse=True)[1] + 1
    number, ids = (np.concatenate([np.zeros(0, np.int64), *map(loosed, right.column(c).to_pylist())]) for c in ("number", "id"))
    return _semi_join(longer, number + 1, ids, (left if left.num_rows else right).column("slice")[0].as_py())


def frequent_phrases(docs: DataFrame, longest: int = 3, least: int = 10, slice_bytes: int = 8 << 20, bucket: int = 1_000_000) -> tuple[DataFrame, list[DataFrame]]:
    """lang and n (all its words); and for each length from 1 on a table of its frequent phrases: id, lang, phrase, last (its
    last word), f, and prefixes and suffixes, the counts of its first and last 1, 2, ... words up to all. From 2 on also a
    and b, the ids of its first and last words but one."""
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    occurrences = written(texts.mapInArrow(_slicer(slice_bytes), "slice long, numbers binary, vocabulary array<struct<lang: string, word: string, n: long>>"), "occurrences")
    words = occurrences.select("slice", F.posexplode("vocabulary").alias("at", "w")).select("slice", (F.col("at") + 1).cast("long").alias("number"), "w.lang", "w.word", "w.n")
    totals = written(words.groupBy("lang").agg(F.sum("n").alias("n")), "totals")
    buckets = 1 + (totals.agg(F.sum("n")).first()[0] or 0) // bucket
    frequent = written(words.groupBy("lang", "word").agg(F.sum("n").alias("f")).filter(F.col("f") >= least).withColumn("id", F.monotonically_increasing_id()), "words")
    known = words.join(frequent, ["lang", "word"]).select(F.col("slice").alias("at"), "number", "id")
    relation = occurrences.select("slice", "numbers").groupBy("slice").cogroup(known.groupBy("at")).applyInArrow(_frequent_words, RELATION)
    one = F.array("f")
    levels = [frequent.select("id", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), "f", one.alias("prefixes"), one.alias("suffixes"))]
    for k in range(2, longest + 1):
        relation = written(relation, f"occurrences-{k - 1}")
        counted = relation.mapInArrow(_counter(buckets), COUNTS)
        groups = written(counted.groupBy("bucket").applyInArrow(_adder(least), GROUPS), f"groups-{k}")
        found = groups.filter("slice = -1").select(F.inline("phrases"))
        head = levels[-1].select(F.col("id").alias("a"), "lang", F.col("phrase").alias("head"), "prefixes")
        tail = levels[-1].select(F.col("id").alias("b"), F.col("last").alias("tail"), "suffixes")
        row = found.join(head, "a").join(tail, "b")
        longer = F.array("f")
        levels.append(written(row.select("id", "lang", F.concat_ws(" ", "head", "tail").alias("phrase"), F.col("tail").alias("last"), "f", F.concat("prefixes", longer).alias("prefixes"), F.concat("suffixes", longer).alias("suffixes"), "a", "b"), f"phrases-{k}"))
        if k < longest:
            lists = groups.filter("slice >= 0").select("slice", "number", "id")
            relation = relation.select("slice", "numbers").groupBy("slice").cogroup(lists.groupBy("slice")).applyInArrow(_frequent_phrases, RELATION)
    return totals, levels


def _cut(k: int) -> Column:
    """Of the ways to cut a phrase of k words in two, the one of the lowest score, of equals the first: score, k, l, r."""
    whole = F.col("f").cast("decimal(15,0)")

    def at(c: int) -> Column:
        left, right = F.get("prefixes", F.lit(c - 1)), F.get("suffixes", F.lit(k - c - 1))
        product = left.cast("decimal(15,0)") * right.cast("decimal(15,0)")
        over = F.lit(1_000_000).cast("decimal(7,0)") * (whole * whole)
        return F.struct(F.call_function("div", over, product).cast("long").alias("score"), F.lit(c).alias("k"), left.alias("l"), right.alias("r"))

    return F.array_min(F.array(*map(at, range(1, k))))


def collocations(docs: DataFrame, longest: int = 3, least: int = 10, inside: int = 50, top: int = 2000, **sizes) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's `top` phrases of 2 to `longest` words that stand `least` times or
    more, by the score of their weakest cut. A phrase is left out if a longer one of at least `inside` percent of its
    count holds it; one word more tells, as whatever holds it holds such a phrase that stands as often at least."""
    totals, levels = frequent_phrases(docs, longest, least, **sizes)
    kept = None
    for k in range(2, longest + 1):
        rows = levels[k - 1].select("id", "lang", "phrase", "f", _cut(k).alias("cut"))
        if k < longest:
            longer = levels[k].select(F.explode(F.array("a", "b")).alias("id"), F.col("f").alias("longer")).groupBy("id").agg(F.max("longer").alias("longer"))
            rows = rows.join(longer, "id", "left").filter(F.coalesce(100 * F.col("longer") < inside * F.col("f"), F.lit(True))).drop("longer")
        kept = rows if kept is None else kept.unionByName(rows)
    ranked = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("f"), "phrase"))).filter(F.col("rank") <= top)
    return ranked.join(F.broadcast(totals), "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", F.col("f").alias("a"), "cut.l", "cut.r", "n", "cut.score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(tables(spark, sf_dir, "documents"))

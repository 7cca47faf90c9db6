"""Operator 8: near-duplicate groups by MinHash with tensored banding, every link confirmed on full shingle sets.

1. A task turns each text into its set of distinct `n`-word shingles (64-bit hashes) and takes minima under 2*m*r hash
   functions. Each r of them form a half key: m half keys u and m half keys v. The keys of the m*m tables are all
   pairs (u_i, v_j), so m*m tables cost 2*m*r minima. Two sets of similarity s meet in some table with probability
   (1 - (1 - s^r)^m)^2; m is chosen so that at the threshold less than 1 in 10,000 pairs are missed. Eight bits of each
   minimum are the set's trace: the share of equal bytes of two traces estimates their similarity.
2. Documents with equal sets form a class at once; only one document of a class goes on. Classes have numbers of their
   own, so rows that repeat a doc_id with other texts stay apart.
3. Classes are dealt by their half keys u_i, m rows each. Within a u_i the tables (u_i, v_1), (u_i, v_2), ... are sorted one
   by one, and classes with equal v_j whose traces differ in at most `SLACK` standard deviations more bytes than those of
   sets at the threshold become candidates. The byte distance of traces is a metric, so a table is not compared all with
   all: a pivot removes what is near it, and only what the triangle inequality leaves is compared with those. Of the
   candidates a spanning forest is given out, so that a half key gives fewer links than it has classes. A u_i of more than
   `unit` classes is dealt out as pairs of blocks, each in a task of its own.
4. The components of the candidates are clusters. As candidates are filtered by their traces, texts that only share a
   template (similarity 0.3) make no cluster, however many they are. Within a cluster pairs are compared on full sets, in
   blocks of about `block` shingles, through an index of the rarer shingles of each set (two sets over the threshold share one
   of those), and sets that links have joined already are not compared again. For clusters of several blocks the first round
   compares within blocks and against the classes that are the pivot of most candidates; the second compares the remaining
   pairs of blocks, but none whose classes the first round has already joined in one component. Pairs of classes are never
   written out and no partner is dropped.
5. Components of the confirmed links give each document's component, its smallest doc_id.

Edge cases: texts with fewer than n words, but not none, are one shingle; texts without words (or null) have no set and
are linked with nothing; rows that repeat a doc_id are documents of their own with one id; rows without doc_id are kept
and have no component; doc_id is cast to a whole number, a text id that is none is an error; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import LOWER, WordTable, chunks, gram_hashes, held, mixed, settled, tables, word_hash
from .components import components

SKETCH = "doc_id long, text_hash long, n_shingles long, d1 long, d2 long, u array<long>, v array<long>, trace binary"
SLACK = 5.0


def words_of(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, A-Z lower-cased, and where each text begins."""
    table = held("minhash", lambda: WordTable(word_hash))
    numbers, starts = table.numbers([t.translate(LOWER).split() if t else [] for t in texts])
    return (table.hash[numbers] if len(numbers) else np.zeros(0, np.uint64)), starts


def shingle_sets(texts: list[bytes | None], n: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    hashes, starts = words_of(texts)
    grams, out = gram_hashes(hashes, n), []
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        if b - a >= n:
            out.append(np.unique(grams[a : b - n + 1]))
        else:
            out.append(gram_hashes(hashes[a:b], b - a) ^ np.uint64(b - a) if b > a else np.zeros(0, np.uint64))
    return out


def tables_for(percent: int, r: int = 3, miss: float = 1e-4) -> int:
    """The number m of half keys of each kind that keeps misses at the threshold below `miss`."""
    return max(1, math.ceil(math.log(miss / 2) / math.log(1 - (percent / 100) ** r)))


def _sketcher(n: int, r: int, m: int) -> Callable:
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors = np.random.default_rng(8).integers(1, 1 << 63, 2 * m * r, np.uint64) * np.uint64(2) + np.uint64(1)
        for batch, texts in chunks(batches):
            sets = shingle_sets(texts, n)
            size = np.fromiter(map(len, sets), np.int64, len(sets))
            full = np.flatnonzero(size)
            d1, d2, half = (np.zeros(len(sets), np.uint64), np.zeros(len(sets), np.uint64), np.zeros((len(sets), 2 * m), np.uint64))
            trace = np.zeros((len(sets), 2 * m * r), np.uint8)
            if len(full):
                flat = np.concatenate([sets[i] for i in full])
                at = np.cumsum(size[full]) - size[full]
                d1[full], d2[full] = np.add.reduceat(flat, at), np.add.reduceat(mixed(flat ^ np.uint64(0x5851F42D4C957F2D)), at)
                least = np.empty((len(full), 2 * m * r), np.uint64)
                for k, f in enumerate(factors):
                    least[:, k] = np.minimum.reduceat(flat * f, at)
                part = np.zeros((len(full), 2 * m), np.uint64)
                for k in range(r):
                    part = mixed(part + least[:, k * 2 * m : (k + 1) * 2 * m])
                half[full], trace[full] = part, (mixed(least) >> np.uint64(56)).astype(np.uint8)
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(np.ascontiguousarray(x).view(np.int64).ravel()), m).cast(pa.list_(pa.int64())) for x in (half[:, :m], half[:, m:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(size), pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64)), *lists, pa.array([x.tobytes() for x in trace], pa.binary())], names=["doc_id", "text_hash", "n_shingles", "d1", "d2", "u", "v", "trace"])

    return sketch


def links_within(sets: list[np.ndarray], cluster: np.ndarray, component: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Pairs (places in the lists) of similar sets of one cluster; of those, as many as join components or sets that are
    not joined yet. Sets of size n that are similar to another share one of their n - ceil(n * percent / 100) + 1 rarest
    shingles with it, by any one order; only those are indexed, and what shares one is counted on full sets."""
    n = len(sets)
    size = np.fromiter(map(len, sets), np.int64, n)
    owner = np.repeat(np.arange(n), size)
    flat = np.concatenate(sets) if n else np.zeros(0, np.uint64)
    key = mixed(flat + cluster[owner].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, number, often = np.unique(key, return_inverse=True, return_counts=True)
    order = np.lexsort((number, often[number], owner))  # each set's shingles, the rarest first
    place = np.arange(len(key)) - np.repeat(np.cumsum(size) - size, size)
    first = order[place < np.repeat(size - -(-percent * size // 100) + 1, size)]
    first = first[often[number[first]] > 1]
    by_shingle = first[np.lexsort((owner[first], number[first]))]
    shingle, of = number[by_shingle], owner[by_shingle]
    begin = np.searchsorted(shingle, np.arange(len(often) + 1))
    bounds = np.searchsorted(owner[first], np.arange(n + 1))  # `first` goes by owner
    label, found = np.unique(component, return_inverse=True)[1], []
    for i in range(n):
        mine = number[first[bounds[i] : bounds[i + 1]]]
        if not len(mine):
            continue
        near = np.unique(np.concatenate([of[begin[x] : begin[x + 1]] for x in mine.tolist()]))
        near = near[(near > i) & (cluster[near] == cluster[i]) & (label[near] != label[i])]
        near = near[(100 * size[near] >= percent * size[i]) & (100 * size[i] >= percent * size[near])]
        for j in near.tolist():
            if label[i] == label[j]:
                continue
            common = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if 100 * common >= percent * (size[i] + size[j] - common):
                label[label == label[j]] = label[i]
                found.append((i, j))
    return found


def _linker(n: int, percent: int) -> Callable:
    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("node")
        sets = shingle_sets([t.encode() if t is not None else None for t in pdf["text"]], n)
        node = pdf["node"].to_numpy()
        pairs = links_within(sets, pdf["cluster"].to_numpy(), pdf["component"].to_numpy(), percent)
        return pd.DataFrame({"a": node[[i for i, _ in pairs]], "b": node[[j for _, j in pairs]]}, dtype="int64")

    return link


def most_unequal(percent: int, n: int) -> int:
    """Of n bytes of two traces, how many differ at most for sets at the threshold, but for SLACK standard deviations."""
    p = 1 - percent / 100
    return min(n, math.ceil(n * p + SLACK * math.sqrt(n * p * (1 - p))))


def forest(unit: np.ndarray, v: np.ndarray, trace: np.ndarray, far: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of places with the same unit, an equal v_j and traces that differ in `far` bytes or
    fewer. The units come sorted."""
    core, root, out = far // 2, list(range(len(unit))), []

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    def unite(a: int, b: int) -> None:
        x, y = top(a), top(b)
        if x != y:
            root[max(x, y)] = min(x, y)
            out.append((a, b))

    for j in range(v.shape[1]):
        order = np.lexsort((v[:, j], unit))
        new = np.r_[True, (unit[order[1:]] != unit[order[:-1]]) | (v[order[1:], j] != v[order[:-1], j])]
        begin = np.flatnonzero(new)
        if len(begin) == len(order):
            continue
        tops = np.fromiter((top(x) for x in order.tolist()), np.int64, len(order))
        open_runs = np.flatnonzero(np.minimum.reduceat(tops, begin) != np.maximum.reduceat(tops, begin))
        end = np.r_[begin[1:], len(order)]
        for k in open_runs.tolist():
            rest = np.sort(order[begin[k] : end[k]])
            while len(rest) > 1:
                pivot = int(rest[0])
                differ = np.count_nonzero(trace[rest] != trace[pivot], axis=1)
                for x in rest[differ <= far].tolist():
                    unite(pivot, x)
                inner, shell = rest[differ <= core], rest[(differ > far) & (differ <= far + core)]
                for y in shell.tolist() if len(inner) > 1 else ():
                    apart = np.count_nonzero(trace[inner] != trace[y], axis=1)
                    if apart.min() <= far:
                        unite(int(inner[apart.argmin()]), y)
                rest = rest[differ > core]
    return out


def _seeker(far: int) -> Callable:
    def seek(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by unit; a unit may go on in the next batch."""

        def pairs(table: pa.Table) -> pa.RecordBatch:
            unit, node = table.column("unit").to_numpy(), table.column("node").to_numpy()
            _, group, n = np.unique(unit, return_inverse=True, return_counts=True)
            several = np.flatnonzero(n[group] > 1)
            rows = table.select(["v", "trace"]).take(pa.array(several))
            v, trace = (c.combine_chunks() for c in rows.columns)
            v = np.asarray(v.flatten()).reshape(len(several), -1) if len(several) else np.zeros((0, 0), np.int64)
            trace = np.frombuffer(b"".join(trace.to_pylist()), np.uint8).reshape(len(several), -1) if len(several) else np.zeros((0, 0), np.uint8)
            found = np.array(forest(group[several], v, trace, far), np.int64).reshape(-1, 2)
            a, b = (node[several[found[:, i]]] for i in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], names=["node", "centre"])

        held_back: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([held_back, table]) if held_back is not None else table
            unit = table.column("unit").to_numpy()
            last = int(np.searchsorted(unit, unit[-1])) if len(unit) else 0
            held_back = table.slice(last)
            if last:
                yield pairs(table.slice(0, last))
        if held_back is not None and held_back.num_rows:
            yield pairs(held_back)

    return seek


def candidates(classes: DataFrame, far: int, unit: int) -> DataFrame:
    """node and centre: links that join all classes of one cluster. `classes` has node, u, v and trace."""
    parts = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = classes.select("node", F.posexplode("u").alias("i", "x")).select("node", F.xxhash64("i", "x").alias("key"))
    hot = keys.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > unit).select("key", F.ceil(F.col("n") / unit).cast("int").alias("blocks"))
    rows = classes.select("node", F.posexplode("u").alias("i", "x"), "v", "trace").withColumn("key", F.xxhash64("i", "x")).drop("i", "x")
    rows = rows.join(hot, "key", "left").withColumn("mine", F.pmod(F.xxhash64("node"), F.coalesce("blocks", F.lit(1))))
    other = F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)).alias("other")
    dealt = rows.select("*", other).select(F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other")).alias("unit"), "node", "v", "trace")
    found = dealt.repartition(parts, "unit").sortWithinPartitions("unit").mapInArrow(_seeker(far), "node long, centre long")
    return settled(found.distinct(), "candidates")


def groups(docs: DataFrame, n: int = 5, percent: int = 80, r: int = 3, block: int = 500_000, unit: int = 5_000) -> DataFrame:
    """doc_id, text_hash, n_shingles and first for each row; first is the doc_id and text_hash of the first row of its
    group, null where there is no set or no doc_id. Links are sets with 100 * common >= percent * union.

    `block` bounds the shingles that one comparison task holds (a single longer text may exceed it), `unit` the classes of a
    half key that are looked at together."""
    m = tables_for(percent, r)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64(F.col("text").cast("string")).alias("text_hash"))
    sketch = settled(texts.mapInArrow(_sketcher(n, r, m), SKETCH), "sketch")
    sets = sketch.filter("n_shingles > 0 and doc_id is not null").groupBy("d1", "d2")
    sets = sets.agg(F.min(F.struct("doc_id", "text_hash")).alias("rep"), F.any_value("n_shingles").alias("size"), F.any_value("u").alias("u"), F.any_value("v").alias("v"), F.any_value("trace").alias("trace"))
    classes = settled(sets.withColumn("node", F.monotonically_increasing_id()), "classes")
    near = candidates(classes.select("node", "u", "v", "trace"), most_unequal(percent, 2 * m * r), unit)
    found = components(near.select(F.col("node").alias("a"), F.col("centre").alias("b")))
    clusters = settled(found.select("node", F.col("component").alias("cluster")).join(classes.select("node", "size", "rep"), "node"), "clusters")

    # The number of blocks of each cluster; those of one block share units of about a block.
    total = clusters.groupBy("cluster").agg(F.sum("size").alias("shingles")).withColumn("n_blocks", F.ceil(F.col("shingles") / block))
    units = total.filter("n_blocks = 1").agg(F.ceil(F.coalesce(F.sum("shingles"), F.lit(0)) / block).alias("k")).first()["k"] or 1
    placed = clusters.join(total, "cluster").withColumn("block", F.when(F.col("n_blocks") > 1, F.pmod(F.xxhash64("node"), "n_blocks")).otherwise(-1 - F.pmod(F.xxhash64("cluster"), F.lit(units))))
    placed = placed.select("node", "cluster", F.col("node").alias("component"), "size", "n_blocks", "block", F.col("rep.doc_id").alias("doc_id"), F.col("rep.text_hash").alias("text_hash"))
    member = texts.filter("text is not null").join(placed.hint("merge"), ["doc_id", "text_hash"]).dropDuplicates(["node"])  # rows repeated word for word
    member = settled(member.select("node", "cluster", "component", "size", "n_blocks", "block", "text"), "members")
    large = member.filter("n_blocks > 1")
    centres = near.join(clusters.select(F.col("node").alias("centre"), "cluster"), "centre").groupBy("cluster", "centre").agg(F.count("*").alias("n"))
    pivots = centres.groupBy("cluster", F.pmod(F.xxhash64("centre"), F.lit(16)).alias("s")).agg(F.max_by("centre", F.struct("n", "centre")).alias("node")).select("cluster", "node")
    spread = large.drop("block").join(pivots, ["cluster", "node"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
    unit = F.when(F.col("n_blocks") > 1, F.col("cluster")).otherwise(-1).alias("owner")
    first = member.unionByName(spread).select(F.struct(unit, "block").alias("unit"), "node", "cluster", "component", "text")
    links = settled(first.groupBy("unit").applyInPandas(_linker(n, percent), "a long, b long"), "links")
    if large.limit(1).count():
        links = links.unionByName(_across_blocks(large, links, n, percent, block))
    joined = classes.join(components(links, "groups"), "node", "left").select("d1", "d2", "rep", F.coalesce("component", "node").alias("component"))
    least = joined.groupBy("component").agg(F.min("rep").alias("first"))
    node_of = joined.join(least, "component").select("d1", "d2", "first")
    own = F.when(F.col("doc_id").isNotNull(), F.col("first")).alias("first")
    return sketch.select("doc_id", "text_hash", "n_shingles", "d1", "d2").join(node_of, ["d1", "d2"], "left").select("doc_id", "text_hash", "n_shingles", own)


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80, **sizes) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row; see groups()."""
    found = groups(docs, n, percent, **sizes).withColumn("component_id", F.coalesce("first.doc_id", "doc_id"))
    return found.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _across_blocks(large: DataFrame, links: DataFrame, n: int, percent: int, block: int) -> DataFrame:
    """Links between the blocks of clusters that the first round left in several components.

    A component of over a block's shingles gets blocks of its own, which are not compared with each other."""
    joined = components(links, "joined")
    now = large.drop("component", "block", "n_blocks").join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    per = now.groupBy("cluster", "component").agg(F.sum("size").alias("s"))
    split = per.groupBy("cluster").agg(F.count("*").alias("parts")).filter("parts > 1")
    own = per.filter(F.col("s") > block).select("cluster", "component", F.col("component").alias("home"))
    rows = settled(now.join(split.select("cluster"), "cluster", "left_semi").join(own, ["cluster", "component"], "left").withColumn("home", F.coalesce("home", F.lit(-1))), "rest")
    blocks = rows.groupBy("cluster", "home").agg(F.ceil(F.sum("size") / block).alias("k"))
    rows = rows.join(blocks, ["cluster", "home"]).withColumn("part", F.pmod(F.xxhash64("node"), "k"))
    part = blocks.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1))).select("cluster", F.struct("home", "part").alias("p"))
    pairs = part.join(part.select("cluster", F.col("p").alias("q")), "cluster").filter((F.col("p") < F.col("q")) & (F.col("p.home") != F.col("q.home")) | (F.col("p") <= F.col("q")) & (F.col("p.home") == -1) & (F.col("q.home") == -1))
    pairs = pairs.withColumn("unit", F.struct("cluster", "p", "q")).select("unit", "cluster", F.explode(F.array_distinct(F.array("p", "q"))).alias("p"))
    dealt = rows.withColumn("p", F.struct("home", "part")).join(pairs, ["cluster", "p"]).select("unit", "node", "cluster", "component", "text")
    return settled(dealt.groupBy("unit").applyInPandas(_linker(n, percent), "a long, b long"), "links-across")


def keep_one_of_each(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """The rows of `docs`, with all their columns, of which each group keeps one: the one with the smallest doc_id, of
    those the one with the smallest hash of its text, and one of rows that agree in both. Rows without words or without
    doc_id stay. Columns of any names pass through."""
    found = groups(docs, n, percent).filter("first is not null")
    i, h, row, k = (f"{name}_{uuid.uuid4().hex}" for name in ("id", "hash", "row", "place"))
    same = (F.col("doc_id") == F.col("first.doc_id")) & (F.col("text_hash") == F.col("first.text_hash"))
    seen = settled(found.groupBy(F.col("doc_id").alias(i), F.col("text_hash").alias(h)).agg(F.count("*").alias("rows"), F.max(same).alias("first")), "seen")
    mine = [F.col("doc_id").cast("long") == F.col(i), F.xxhash64(F.col("text").cast("string")) == F.col(h)]
    left = docs.join(seen.filter("not first").select(i, h), mine, "left_anti")
    again = seen.filter("first and rows > 1").select(i, h)
    if not again.limit(1).count():
        return left
    several = docs.join(again, mine, "left_semi").select(F.struct("*").alias(row))
    one = several.withColumn(k, F.row_number().over(Window.partitionBy(f"{row}.doc_id", F.xxhash64(f"{row}.text")).orderBy(F.xxhash64(row))))
    return left.join(again, mine, "left_anti").unionByName(one.filter(F.col(k) == 1).select(f"{row}.*"))


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(tables(spark, sf_dir, "documents"), n=3, percent=85)

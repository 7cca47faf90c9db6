"""Operator 13: token ids packed into windows, by non-negative least squares over combinations of lengths.

1. A task encodes each text once, closes it with the end id and cuts it into pieces of `window` ids and a shorter rest.
   Full pieces are sequences as they are. Each rest is numbered among the rests of its length in its task.
2. Spark counts the rests by length: at most `window` - 1 numbers, whatever the size of the corpus.
3. Shallow combinations of lengths that fill a window exactly (at most `depth` pieces of one or two lengths) are the columns
   of a matrix, the histogram is the right side, and the repeat counts of the combinations solve the non-negative least
   squares by coordinate descent. They are rounded to what the histogram holds.
4. What is left is packed greedily, by counts as well: the largest lengths that fit, and where nothing fits any more the head
   of a longer rest, whose tail is packed later. Each step uses up a length or repeats as often as one allows. The last ids,
   fewer than a window, fill windows of powers of two. So no sequence needs padding.
5. The plan says for ranges of rests of a length which sequence and offset they get; it has some rows a length, is bounded by
   the window and not by the corpus, and is broadcast. A rest's rank among all of its length is its number in its task plus
   the counts of the tasks before, a sum over one row a task and length.

Encoding. Pieces between single spaces are encoded once and kept: a space before something that is not white space always
begins a new pre-token of the byte-level tokenizer. Texts with other white space are cut only at spaces between two
characters that aren't white space; texts that hold a special token are encoded whole.

Edge cases: a null or empty text is the end id alone; repeated rows are packed each; rows without doc_id too; an empty table
gives no pieces; other columns are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from bisect import bisect_right
from collections import defaultdict, deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WordTable, chunks, held, settled, tables
from .token_arrow import _encode_alone, _flat, encoded, tokenizer_path

PIECES = "task long, start long, length int, ids binary, ids_crc32 long, doc_tokens long, number long"
PLAN = "length int, low long, high long, each long, begin int, size int, sequence long, place int"
# White space other than one space or line feed between other characters; UTF-8 of the characters that Unicode says are white.
ODD = (b"  ", b" \n", b"\n ", b"\n\n", b"\t", b"\r", b"\x0b", b"\x0c", b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe2\x80", b"\xe2\x81\x9f", b"\xe3\x80\x80")
SAFE_CUT = re.compile(r"(?<=\S)(?= \S)")


def splitter(special: list[bytes]) -> Callable[[bytes], list[bytes]]:
    """Cuts a text into keys. A key that begins with a space stands for what follows the space; one that begins with a line
    feed for itself; any other for itself with a space before it."""

    def split(text: bytes) -> list[bytes]:
        if any(x in text for x in special):
            return [b" " + text]
        if any(x in text for x in ODD) or text[0] in b" \n" or text[-1] in b" \n":
            return [b" " + x.encode() for x in SAFE_CUT.split(text.decode())]
        keys = text.replace(b"\n", b" \n").split(b" ")
        keys[0] = b" " + keys[0]
        return keys

    return split


def byte_table(path: str) -> tuple[WordTable, Callable[[bytes], list[bytes]]]:
    return held(f"bytes {path}", lambda: _new_table(path))


def _new_table(path: str) -> tuple[WordTable, Callable[[bytes], list[bytes]]]:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    begins = np.zeros(model.get_vocab_size(), bool)
    begins[[i for token, i in model.get_vocab().items() if token.startswith("Ġ")]] = True  # how byte-level tokens write a space

    def describe(keys: list[bytes]) -> dict[str, np.ndarray]:
        size, at = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        plain = [i for i, k in enumerate(keys) if k[:1] not in b" \n"]
        odd = [i for i, k in enumerate(keys) if k[:1] in b" \n"]
        joined = [(b" " + b" ".join(keys[i] for i in plain[j : j + 64])).decode() for j in range(0, len(plain), 64)]
        flat = np.concatenate([np.zeros(0, np.uint32), *(_flat(model.encode_batch_fast(joined[j : j + 32], add_special_tokens=False)) for j in range(0, len(joined), 32))])  # few at once, as encodings are large
        first = np.flatnonzero(begins[flat])
        if len(first) != len(plain):
            raise ValueError(f"{path}: a space does not begin one token")
        alone, n = _encode_alone(model, [(keys[i][1:] if keys[i][:1] == b" " else keys[i]).decode() for i in odd])
        for which, ids, sizes in ((plain, flat, np.diff(np.append(first, len(flat)))), (odd, alone, n)):
            size[which], at[which] = sizes, table.flat_size + np.cumsum(sizes) - sizes
            table.flat.append(ids)
            table.flat_size += len(ids)
        return {"size": size, "at": at}

    table = WordTable(describe, 1_300_000)
    table.flat, table.flat_size = [], 0
    return table, splitter([x.content.encode() for x in model.get_added_tokens_decoder().values()])


def _cutter(path: str, end_id: int, window: int, with_ids: bool) -> Callable:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        (table, split), seen, task = byte_table(path), defaultdict(int), TaskContext.get().partitionId()
        for batch, texts in chunks(batches):
            ids, n = encoded(table, texts, end_id, split)
            raw, base = ids.astype("<u4").tobytes(), 0  # Arrow would keep slices of a memoryview for ever
            rows: dict[str, list] = {k: [] for k in ("row", "start", "length", "ids", "crc", "number")}
            for i, size in enumerate(n.tolist()):
                for start in range(0, size, window):
                    length = min(window, size - start)
                    rows["row"].append(i)
                    rows["start"].append(start)
                    rows["length"].append(length)
                    piece = raw[4 * (base + start) : 4 * (base + start + length)]
                    rows["ids"].append(piece if with_ids or length < window else None)  # rests may be cut
                    rows["crc"].append(zlib.crc32(piece))
                    rows["number"].append(seen[length])
                    seen[length] += 1
                base += size
            row = pa.array(rows["row"], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(row), pa.array([task] * len(row), pa.int64()), pa.array(rows["start"], pa.int64()), pa.array(rows["length"], pa.int32()), pa.array(rows["ids"], pa.binary()), pa.array(rows["crc"], pa.int64()), pa.array(n, pa.int64()).take(row), pa.array(rows["number"], pa.int64())],
                names=["doc_id", "task", "start", "length", "ids", "ids_crc32", "doc_tokens", "number"],
            )

    return cut


def combinations(window: int, depth: int) -> list[tuple[tuple[int, int], ...]]:
    """All ways to fill the window with at most `depth` pieces of one or two lengths, as (length, times) pairs."""
    out = {((window // k, k),) for k in range(2, depth + 1) if window % k == 0}
    for k in range(1, depth):
        for j in range(1, depth - k + 1):
            for a in range(1, window // k + 1):
                b, over = divmod(window - k * a, j)
                if not over and 0 < b < a:
                    out.add(((a, k), (b, j)))
    return sorted(out, reverse=True)


def solved(columns: list[tuple[tuple[int, int], ...]], counts: list[int], sweeps: int = 60) -> list[float]:
    """Non-negative x for which the columns come as near to the counts as can be (least squares), by coordinate descent."""
    x, rest = [0.0] * len(columns), [float(c) for c in counts]
    norm = [sum(m * m for _, m in c) for c in columns]
    for _ in range(sweeps):
        moved = 0.0
        for c, pairs in enumerate(columns):
            step = 0.0
            for length, m in pairs:
                step += m * rest[length]
            step = max(-x[c], step / norm[c])
            if step:
                x[c] += step
                moved = max(moved, abs(step))
                for length, m in pairs:
                    rest[length] -= m * step
        if moved < 0.01:
            break
    return x


class Supply:
    """The rests that are not packed yet, by length: ranges of ranks, and for the tails of cut rests where they begin."""

    def __init__(self, counts: dict[int, int]):
        self.parts: dict[int, deque[list[int]]] = defaultdict(deque)
        self.count: dict[int, int] = {}
        self.sequences, self.plan = 0, []
        for length, n in counts.items():
            self.add(length, length, 0, n, 0)

    def add(self, length: int, whole: int, low: int, high: int, begin: int) -> None:
        if high > low:
            self.parts[length].append([whole, low, high, begin])
            self.count[length] = self.count.get(length, 0) + high - low

    def take(self, length: int, n: int, size: int, sequence: int, place: int, each: int) -> None:
        """Gives the first `size` ids of n rests of one range their places, `each` in a row in a sequence."""
        part = self.parts[length][0]
        whole, low, high, begin = part
        self.plan.append((whole, low, low + n, each, begin, size, sequence, place))
        self.count[length] -= n
        part[1] += n
        if part[1] == high:
            self.parts[length].popleft()
        if not self.count[length]:
            del self.count[length]
        self.add(length - size, whole, low, low + n, begin + size) if size < length else None

    def fill(self, slots: list[tuple[int, int, int]], times: int) -> None:
        """Makes `times` sequences of the slots (length, how many in a row, how many of their ids)."""
        need: dict[int, int] = defaultdict(int)
        for length, m, _ in slots:
            need[length] += m
        while times:
            fits = min((self.parts[x][0][2] - self.parts[x][0][1]) // m for x, m in need.items())
            repeat, place = max(1, min(times, fits)), 0
            for length, m, size in slots:
                while m:  # a range with fewer than a slot needs gives what it has
                    low, high = self.parts[length][0][1:3]
                    now = min(m, high - low) if not fits else m
                    self.take(length, now * repeat, size, self.sequences, place, now)
                    place, m = place + now * size, m - now
            self.sequences += repeat
            times -= repeat


def packed(counts: dict[int, int], window: int = 1024, depth: int = 4) -> tuple[list[tuple], int]:
    """The plan for rests of the given counts by length, and its number of sequences. A row of the plan says that of the
    rests of `length` those of rank low to high - 1, `each` in a row in a sequence, put their ids begin to begin + size - 1
    into the sequences from `sequence` on, from `place` on."""
    supply = Supply(counts)
    columns = [c for c in combinations(window, depth) if all(counts.get(x) for x, _ in c)]
    x = solved(columns, [counts.get(i, 0) for i in range(window)])
    for c in sorted(range(len(columns)), key=lambda c: (-x[c], c)):
        times = min(round(x[c]), min(supply.count.get(length, 0) // m for length, m in columns[c]))
        if times:
            supply.fill([(length, m, length) for length, m in columns[c]], times)
    while supply.count:
        lengths = sorted(supply.count)
        left = sum(length * n for length, n in supply.count.items())
        size = window if left >= window else 1 << (left.bit_length() - 1)
        slots, need, k = [], size, len(lengths)
        while need:
            k = bisect_right(lengths, need, 0, k) - 1
            if k < 0:
                break
            m = min(need // lengths[k], supply.count[lengths[k]])
            slots.append((lengths[k], m, lengths[k]))
            need -= m * lengths[k]
        used = {length: m for length, m, _ in slots}
        if need:  # the head of one that is too long
            longer = next(x for x in reversed(lengths) if supply.count[x] > used.get(x, 0))
            slots.append((longer, 1, need))
            used[longer] = used.get(longer, 0) + 1
        supply.fill(slots, min(supply.count[length] // m for length, m in used.items()) if size == window else 1)
    return supply.plan, supply.sequences


def pack(docs: DataFrame, path: str | None = None, window: int = 1024, end_id: int = 0, depth: int = 4, with_ids: bool = True) -> DataFrame:
    """doc_id, start, length, ids (little-endian unsigned 32-bit), ids_crc32 (of those), doc_tokens, sequence_id and offset
    for each piece. Without `with_ids` the ids are left out, and full pieces are checked where they are encoded."""
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    cut = texts.mapInArrow(_cutter(path or tokenizer_path("byte_bpe_50k.json"), end_id, window, with_ids), f"doc_id {kind}, {PIECES}")
    pieces = settled(cut, "pieces", **{"parquet.block.size": str(8 << 20)})  # writers hold a block each
    rests = pieces.filter(F.col("length") < window)
    tasks = settled(rests.groupBy("length", "task").agg(F.count("*").alias("n")), "rests-by-task")
    counts = {r["length"]: r["n"] for r in tasks.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most window - 1 rows
    rows, sequences = packed(counts, window, depth)
    plan = spark.createDataFrame(rows, PLAN)
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = tasks.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = rests.join(bases, ["length", "task"]).withColumn("rank", F.col("base") + F.col("number"))
    placed = ranked.join(F.broadcast(plan), (ranked["length"] == plan["length"]) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high"))).drop(plan["length"])
    slot = (F.col("rank") - F.col("low")) % F.col("each")
    part = F.expr("substring(ids, 4 * begin + 1, 4 * size)")
    rest = placed.select(
        "doc_id", (F.col("start") + F.col("begin")).alias("start"), F.col("size").cast("long").alias("length"), part.alias("ids"), F.crc32(part).alias("ids_crc32"), "doc_tokens",
        (F.col("sequence") + F.floor((F.col("rank") - F.col("low")) / F.col("each"))).alias("sequence_id"), (F.col("place") + slot * F.col("size")).alias("offset"),
    )
    # Full pieces need no plan: their numbers follow those of the plan, a range of 2^32 for each task.
    full = pieces.filter(F.col("length") == window).select("doc_id", "start", F.col("length").cast("long"), "ids", "ids_crc32", "doc_tokens", (F.lit(sequences) + F.shiftleft("task", 32) + F.col("number")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    both = rest.unionByName(full)
    return both if with_ids else both.drop("ids")


def sequences(pieces: DataFrame) -> DataFrame:
    """sequence_id, length and ids of each sequence: its pieces by offset. A sequence holds at most a window of ids."""
    rows = pieces.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    ids = F.reduce("p", F.lit(b""), lambda x, p: F.concat(x, p["ids"]))
    return rows.select("sequence_id", (F.length(ids) / 4).cast("int").alias("length"), ids.alias("ids"))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(tables(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")

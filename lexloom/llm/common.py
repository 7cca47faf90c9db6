"""What the operators of this package share: the shared folder, Arrow chunks of texts, and word tables."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Lower-cases A-Z only.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
# Lower-cases A-Z and turns every ASCII byte that is neither a letter nor a digit into a space.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def shared_dir(spark: SparkSession) -> str:
    """The folder in `spark.checkpoint.dir`; only where that is unset (tests, one machine) a fresh local one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='lexloom-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def settled(df: DataFrame, name: str, **options: str) -> DataFrame:
    """`df` written to the shared folder and read back: later jobs neither recompute it nor depend on executors."""
    path = new_folder(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Within it, tables are sent to Python in batches of so many rows at most: less memory on both sides for long texts."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def tables(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod3(doc_id: Column | str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 if isinstance(doc_id, str) else F.crc32(doc_id.cast("string").cast("binary")) % 3


def chunks(batches: Iterable[pa.RecordBatch], text: str = "text", max_bytes: int = 2 << 20) -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    """Slices of the batches that hold about `max_bytes` of text, each with its texts as bytes. A text is never cut."""
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(text)).cast(pa.binary()).to_pylist()
        start = size = 0
        for i, t in enumerate(texts):
            size += len(t) if t else 0
            if size >= max_bytes:
                yield batch.slice(start, i + 1 - start), texts[start : i + 1]
                start, size = i + 1, 0
        if start < len(texts):
            yield batch.slice(start), texts[start:]


class WordTable(dict):
    """Numbers the words it meets and keeps arrays of what `describe` says of each, so that work on a word is done
    once a task and not once an occurrence. It forgets everything beyond `limit` words, between two chunks."""

    def __init__(self, describe: Callable[[list[bytes]], dict[str, np.ndarray]], limit: int = 150_000):
        super().__init__()
        self.describe, self.limit, self.fresh, self.arrays, self.known = describe, limit, [], {}, 0

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        self.fresh.append(word)
        return n

    def numbers(self, lists: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of all words in a row, and where each list begins (with the end at last)."""
        if len(self) > self.limit:
            self.clear()
            self.arrays, self.known = {}, 0
        starts = np.zeros(len(lists) + 1, np.int64)
        np.cumsum([len(x) for x in lists], out=starts[1:])
        found = np.fromiter(map(self.__getitem__, chain.from_iterable(lists)), np.int64, int(starts[-1]))
        if self.fresh:
            for k, v in self.describe(self.fresh).items():
                old = self.arrays.get(k)
                if old is None:
                    old = np.zeros((1024, *v.shape[1:]), v.dtype)
                if len(old) < len(self):
                    old = np.concatenate([old, np.zeros((max(len(self), 2 * len(old)) - len(old), *v.shape[1:]), v.dtype)])
                old[self.known : len(self)] = v
                self.arrays[k] = old
            self.known, self.fresh = len(self), []
        return found, starts

    def __getattr__(self, name: str) -> np.ndarray:
        try:
            return self.__dict__["arrays"][name]
        except KeyError:
            raise AttributeError(name) from None


_HELD: dict[str, object] = {}


def held(name: str, make: Callable[[], object]) -> object:
    """What a Python worker keeps from task to task: one operator's table, so that stages that share workers do not add up."""
    if name not in _HELD:
        _HELD.clear()
        _HELD[name] = make()
    return _HELD[name]


def let_go() -> None:
    """Drops what `held` keeps, for tasks that need the memory and no table."""
    if _HELD:
        _HELD.clear()
        gc.collect()  # tables and what describes their words may refer to each other


def word_hash(words: list[bytes]) -> dict[str, np.ndarray]:
    return {"hash": np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))}


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that sums and products of hashes may be used as hashes."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def gram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """The hash of each n words in a row, wherever they begin; windows over the end of a text are for the caller to drop."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(hashes) - n + 1, np.uint64)
    for i in range(n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + hashes[i : len(hashes) - n + 1 + i]
        out ^= out >> np.uint64(29)
    return mixed(out)


def sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The sum of `values` for each text."""
    total = np.zeros(len(values) + 1, np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[starts[1:]] - total[starts[:-1]]

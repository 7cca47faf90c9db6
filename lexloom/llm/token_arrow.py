"""Operator 6: token ids as Arrow files of equal-length sequences; and the tokenising that operator 9 shares.

Layout. Documents are dealt to shards by ranges of doc_id and sorted within them, rows that repeat a doc_id by text; the ids of a shard's documents,
each closed by the end id, run on without gaps and are cut into sequences of `length`. A shard is one Arrow IPC file
whose record batches hold `ids` (fixed-size list of uint16, or uint32 for vocabularies beyond 65,536), `mask`
(fixed-size list of booleans, false on the padding of the last sequence) and `first` (the same, true on the first id of
each document). Buffers are not compressed and every batch
has `rows_per_batch` sequences, so a memory-mapped reader gets sequence k without copying: batch k // rows_per_batch,
row k % rows_per_batch. The index, a Parquet table, says where each document begins.

Recovery. A task writes a file with a name of its own and returns that name with its index rows; the index names only
files of tasks that Spark committed, so retries and lost executors leave at most unnamed files. Executors write
through pyarrow's file systems (shared folders, HDFS, S3), never into folders of their own.

Edge cases: a null or empty text is the end id alone; repeated rows are kept, one result each; rows without doc_id
come first; an empty table writes no shard; other columns are ignored.
"""

from __future__ import annotations

import unicodedata
import uuid
import zlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WordTable, chunks, held, new_folder, settled, tables

SIGNS = ".,;:!?$#%&*"
INDEX = "doc_id long, file string, shard int, place long, start_in_shard long, n_tokens long"


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def chunk_table(path: str) -> WordTable:
    """The ids of pieces between white space, each encoded once. It holds for tokenizers that drop white space and
    never join pieces over it: then the ids of a text are the ids of its pieces in a row."""
    return held(f"pieces {path}", lambda: _new_table(path))


def _new_table(path: str) -> WordTable:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    closes = _closing_ids(model, path)

    def describe(words: list[bytes]) -> dict[str, np.ndarray]:
        texts = [w.decode("utf-8", "replace") for w in words]
        parts = np.fromiter(map(_n_parts, texts), np.int64, len(texts)) if closes is not None else np.zeros(len(texts), np.int64)
        size, at = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        plain = np.flatnonzero(parts)
        together = _encode_together(model, [texts[i] for i in plain], parts[plain], closes)
        if together is None:
            plain, together = plain[:0], (np.zeros(0, np.uint32), np.zeros(0, np.int64))
        rest = np.ones(len(texts), bool)
        rest[plain] = False
        alone = np.flatnonzero(rest)
        for which, (flat, n) in ((plain, together), (alone, _encode_alone(model, [texts[i] for i in alone]))):
            size[which], at[which] = n, table.flat_size + np.cumsum(n) - n
            table.flat.append(flat)
            table.flat_size += len(flat)
        return {"size": size, "at": at}

    table = WordTable(describe, 400_000)
    table.flat, table.flat_size = [], 0
    return table


def _closing_ids(model: object, path: str) -> np.ndarray | None:
    """Which ids close a part of a piece, for tokenizers that part letters from signs and mark the end of each part."""
    import json

    with open(path) as f:
        suffix = json.load(f)["model"].get("end_of_word_suffix")
    if not suffix:
        return None
    closes = np.zeros(model.get_vocab_size(), bool)
    closes[[i for token, i in model.get_vocab().items() if token.endswith(suffix)]] = True
    parts = [closes[x.ids].sum() for x in model.encode_batch_fast(["a", SIGNS, f"a{SIGNS}", f"a{SIGNS[::-1]}"], add_special_tokens=False)]
    return closes if parts == [1, 1, 2, 2] else None


def _n_parts(piece: str) -> int:
    """1 for letters alone, 2 for letters and signs behind them, 0 for all else (also for what becomes more than letters
    once composed and lower-cased)."""
    letters = piece.rstrip(SIGNS)
    if not letters.isalpha() or not (letters.isascii() or unicodedata.normalize("NFC", letters).lower().isalpha()):
        return 0
    return 1 + (len(letters) < len(piece))


def _flat(encodings: list) -> np.ndarray:
    return np.fromiter(chain.from_iterable(x.ids for x in encodings), np.uint32)


def _encode_together(model: object, pieces: list[str], parts: np.ndarray, closes: np.ndarray | None, row: int = 50) -> tuple[np.ndarray, np.ndarray] | None:
    """The ids of all pieces, and how many each has, from calls on many pieces at once; None if the closing ids are not as
    many as the parts, so that it cannot be told where a piece ends."""
    if not pieces:
        return None
    flat = _flat(model.encode_batch_fast([" ".join(pieces[i : i + row]) for i in range(0, len(pieces), row)], add_special_tokens=False))
    ends = np.flatnonzero(closes[flat])
    if len(ends) != parts.sum() or ends[-1] != len(flat) - 1:
        return None
    return flat, np.diff(ends[np.cumsum(parts) - 1], prepend=-1)


def _encode_alone(model: object, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
    found = model.encode_batch_fast(pieces, add_special_tokens=False)
    return _flat(found), np.fromiter(map(len, found), np.int64, len(found))


def numbered(table: WordTable, texts: list[bytes | None], split: Callable[[bytes], list[bytes]] = bytes.split) -> tuple[np.ndarray, np.ndarray]:
    if len(table) > table.limit:
        table.flat, table.flat_size = [], 0
    return table.numbers([split(t) if t else [] for t in texts])


def encoded(table: WordTable, texts: list[bytes | None], end_id: int | None, split: Callable[[bytes], list[bytes]] = bytes.split) -> tuple[np.ndarray, np.ndarray]:
    """All ids of the texts in a row, and how many each text has, the end id counted. `split` makes the table's keys."""
    words, starts = numbered(table, texts, split)
    if len(table.flat) > 1:
        table.flat = [np.concatenate(table.flat)]
    flat = table.flat[0] if table.flat else np.zeros(0, np.uint32)
    size = table.size[words] if len(words) else np.zeros(0, np.int64)
    ends = np.zeros(len(words) + 1, np.int64)
    np.cumsum(size, out=ends[1:])
    place = np.repeat((table.at[words] if len(words) else size) - ends[:-1], size) + np.arange(ends[-1])
    ids, n = flat[place], ends[starts[1:]] - ends[starts[:-1]]
    if end_id is None:
        return ids, n
    return np.insert(ids, ends[starts[1:]], np.uint32(end_id)), n + 1


class ShardFile:
    """One Arrow file of fixed-size lists, written a batch at a time."""

    def __init__(self, folder: str, length: int, rows: int, dtype: str):
        self.store, root = fs.FileSystem.from_uri(folder)
        self.store.create_dir(root, recursive=True)
        self.name = f"shard-{uuid.uuid4().hex}.arrow"
        self.length, self.rows, self.dtype = length, rows, np.dtype(dtype)
        self.schema = pa.schema([("ids", pa.list_(pa.from_numpy_dtype(self.dtype), length)), ("mask", pa.list_(pa.bool_(), length)), ("first", pa.list_(pa.bool_(), length))])
        self.out = self.store.open_output_stream(f"{root}/{self.name}")
        self.file = pa.ipc.new_file(self.out, self.schema)
        self.waiting: list[np.ndarray] = []
        self.marks: list[np.ndarray] = []
        self.held = 0

    def add(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        first = np.zeros(len(ids), bool)
        first[np.cumsum(sizes) - sizes] = True
        self.waiting.append(ids.astype(self.dtype))
        self.marks.append(first)
        self.held += len(ids)
        block = self.length * self.rows
        if self.held >= block:
            rest, marks = np.concatenate(self.waiting), np.concatenate(self.marks)
            while len(rest) >= block:
                self.write(rest[:block], marks[:block], block)
                rest, marks = rest[block:], marks[block:]
            self.waiting, self.marks, self.held = [rest], [marks], len(rest)

    def write(self, ids: np.ndarray, first: np.ndarray, real: int) -> None:
        mask = np.zeros(len(ids), bool)
        mask[:real] = True
        parts = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (ids, mask, first)]
        self.file.write_batch(pa.record_batch(parts, schema=self.schema))

    def close(self) -> None:
        rest = np.concatenate(self.waiting) if self.waiting else np.zeros(0, self.dtype)
        if len(rest):
            more = -len(rest) % self.length
            self.write(np.concatenate([rest, np.zeros(more, self.dtype)]), np.concatenate([*self.marks, np.zeros(more, bool)]), len(rest))
        self.file.close()
        self.out.close()


def _writer(path: str, folder: str, length: int, rows: int, end_id: int, dtype: str) -> Callable:
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        table, file, at, place = chunk_table(path), None, 0, 0
        for batch, texts in chunks(batches):
            if file is None:
                file = ShardFile(folder, length, rows, dtype)
            ids, n = encoded(table, texts, end_id)
            file.add(ids, n)
            start = at + np.cumsum(n) - n
            yield pa.record_batch(
                [batch.column(0).cast(pa.int64()), pa.array([file.name] * len(n)), pa.array(np.full(len(n), TaskContext.get().partitionId(), np.int32)), pa.array(np.arange(place, place + len(n))), pa.array(start), pa.array(n)],
                names=["doc_id", "file", "shard", "place", "start_in_shard", "n_tokens"],
            )
            at, place = at + int(n.sum()), place + len(n)
        if file:
            file.close()

    return write


def write_tokens(docs: DataFrame, folder: str, path: str | None = None, end_id: int = 2, length: int = 2048, rows_per_batch: int = 64, shards: int | None = None) -> DataFrame:
    """Writes the shards to `folder` and returns their index, one row a document (INDEX). Needs doc_id and text."""
    import json

    spark, path = docs.sparkSession, path or tokenizer_path()
    with open(path) as f:
        dtype = "uint16" if max(json.load(f)["model"]["vocab"].values()) < 1 << 16 else "uint32"
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id", "text")
    index = rows.mapInArrow(_writer(path, folder, length, rows_per_batch, end_id, dtype), INDEX)
    index.write.parquet(f"{folder}/index")
    return spark.read.schema(INDEX).parquet(f"{folder}/index")


def read_sequences(folder: str, file: str) -> pa.RecordBatchFileReader:
    """A reader with random access to the batches of one shard, memory-mapped where the folder is local."""
    store, root = fs.FileSystem.from_uri(folder)
    if isinstance(store, fs.LocalFileSystem):
        return pa.ipc.open_file(pa.memory_map(f"{root}/{file}"))
    return pa.ipc.open_file(store.open_input_file(f"{root}/{file}"))


def document_starts(file: pa.RecordBatchFileReader) -> np.ndarray:
    """Where the documents of a shard begin, and at last where the last one ends, as marked in the file."""
    at, out = 0, []
    for b in range(file.num_record_batches):
        held = file.get_batch(b)
        mask, first = (held.column(i).values for i in (1, 2))
        out.append(np.flatnonzero(first.to_numpy(zero_copy_only=False)) + at)
        at += mask.true_count
    return np.concatenate([*out, [at]]).astype(np.int64)


def _reader(folder: str) -> Callable:
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, file = None, None
        for batch in batches:
            rows = batch.to_pydict()
            begin, size, out = [], [], []
            for file_name, place in zip(rows["file"], rows["place"], strict=True):
                if file_name != name:
                    name, file = file_name, read_sequences(folder, file_name)
                    length = file.schema.field("ids").type.list_size
                    block = length * file.get_batch(0).num_rows
                    starts = document_starts(file)
                start, n = int(starts[place]), int(starts[place + 1] - starts[place])
                crc, real = 0, 0
                while real < n:
                    b, off = divmod(start + real, block)
                    held = file.get_batch(b)
                    ids, mask = (held.column(i).values.slice(off, n - real) for i in (0, 1))
                    if mask.true_count != len(mask):
                        raise ValueError(f"{file_name}: padding inside a document")
                    crc = zlib.crc32(ids.to_numpy().astype("<u4").tobytes(), crc)
                    real += len(ids)
                begin.append(start)
                size.append(n)
                out.append(crc)
            known = [batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "file", "shard", "place")]
            yield pa.RecordBatch.from_arrays([*known, pa.array(begin, pa.int64()), pa.array(size, pa.int64()), pa.array(out, pa.int64())], names=[*(x.split()[0] for x in INDEX.split(", ")), "ids_crc32"])

    return read


def read_documents(index: DataFrame, folder: str) -> DataFrame:
    """Each document's start among all ids, its number of ids and their checksum, as read from the files; the index only
    says which document stands where in which file. What the files say is written once, a short row a document.

    The starts of the shards are sums over one row a shard; documents are not gathered anywhere."""
    read = settled(index.mapInArrow(_reader(folder), f"{INDEX}, ids_crc32 long"), "read-documents")
    totals = read.groupBy("shard").agg(F.sum("n_tokens").alias("shard_tokens"))
    bases = totals.withColumn("base", F.sum("shard_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)))
    return read.join(F.broadcast(bases.select("shard", F.coalesce("base", F.lit(0)).alias("base"))), "shard").select(
        "doc_id", (F.col("base") + F.col("start_in_shard")).alias("start"), "n_tokens", "ids_crc32", "file", "shard", "start_in_shard"
    )


def op6_token_arrow(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "tokens")
    return read_documents(write_tokens(tables(spark, sf_dir, "documents"), folder), folder).drop("file")

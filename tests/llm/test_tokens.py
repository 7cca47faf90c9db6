import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from lexloom.llm import token_arrow, token_counts
from lexloom.llm.common import new_folder

from .fixtures import SCHEMA, awkward, rows_of


@pytest.fixture(scope="module")
def model():
    return Tokenizer.from_file(token_arrow.tokenizer_path())


def brute(model, rows):
    start, out = 0, []
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        ids = [*model.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


COLUMNS = ("doc_id", "start", "n_tokens", "ids_crc32")


def test_ids_equal_the_library_on_whole_texts(model):
    texts = [r[1] for r in awkward() if r[1]] + ["<|endoftext|> a<|startoftext|>b x", "It's we're I'LL é ́    x Σας ΑΣ", "\x1c\x1d a\u0085b"]
    table = token_arrow.chunk_table(token_arrow.tokenizer_path())
    ids, n = token_arrow.encoded(table, [t.encode() for t in texts], None)
    for t, part in zip(texts, np.split(ids, np.cumsum(n)[:-1]), strict=True):
        assert part.tolist() == model.encode(t, add_special_tokens=False).ids


def test_joined_pieces_equal_single_ones(model):
    texts = ["İstanbul, K ﬁn! ª ʰa Ǆ ǅ. क़ a\u0301b A\u030a: Å; 한국어 각 ĳ ß ẞ. ﬀ? ١٢ Ⅻ ㎏ a.b a.. .a . ,, </w> a</w> x\u200by \ufffd \u0345a", "Wort, wort Wort. " * 60 + "é! É? " * 60, "a" * 3000 + ". " + "é" * 3000, "ONND!! ätz&&& zubebe,*** $$$ a$b$ a'! a!' a!…  it's.. #1# a<|endoftext|>! A%%%<|endoftext|> <|ENDOFTEXT|>"]
    table = token_arrow._new_table(token_arrow.tokenizer_path())
    ids, n = token_arrow.encoded(table, [t.encode() for t in texts], None)
    for t, part in zip(texts, np.split(ids, np.cumsum(n)[:-1]), strict=True):
        assert part.tolist() == model.encode(t, add_special_tokens=False).ids
    closes = token_arrow._closing_ids(model, token_arrow.tokenizer_path())
    assert closes is not None
    assert token_arrow._encode_together(model, ["a", "b.c"], np.array([1, 1]), closes) is None  # more parts than said: encoded one by one


def test_files_read_back(spark, model):
    rows = [r for r in awkward() if r[0] is not None]
    rows = list({r[0]: r for r in rows}.values())
    docs, folder = spark.createDataFrame(rows, SCHEMA), new_folder(spark, "tokens")
    index = token_arrow.write_tokens(docs, folder, length=16, rows_per_batch=3, shards=3)
    got = token_arrow.read_documents(index, folder)
    assert rows_of(got, *COLUMNS) == sorted(brute(model, [(r[0], r[1]) for r in rows]), key=repr)
    by_file = Counter()
    for r in index.collect():
        by_file[r["file"]] += r["n_tokens"]
    for name, n in by_file.items():
        file = token_arrow.read_sequences(folder, name)
        batches = [file.get_batch(i) for i in range(file.num_record_batches)]
        assert all(b.num_rows == 3 for b in batches[:-1]) and file.schema.field("ids").type.list_size == 16
        assert sum(b.column(1).values.true_count for b in batches) == n
        held = np.concatenate([b.column(0).values.to_numpy() for b in batches])
        assert held.dtype == np.uint16 and not held[n:].any()


def test_query_repeated_rows_and_empty_table(spark, sf, model):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert rows_of(token_arrow.op6_token_arrow(spark, sf), *COLUMNS) == sorted(brute(model, docs), key=repr)
    folder = new_folder(spark, "tokens")
    again = token_arrow.write_tokens(spark.createDataFrame(awkward(), SCHEMA), folder)
    got = token_arrow.read_documents(again, folder)
    assert got.count() == len(awkward()) and got.filter("doc_id is null").count() == 2
    folder = new_folder(spark, "tokens")
    assert token_arrow.read_documents(token_arrow.write_tokens(spark.createDataFrame([], SCHEMA), folder), folder).count() == 0


def test_rows_of_one_id_stand_by_text_and_starts_come_from_the_files(spark, model):
    rows = [(5, "alpha beta"), (5, "a much longer text than that"), (5, None), (4, "x"), (9, "y z")]
    expected = [(r[0], r[1]) for r in sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1] or ""))]
    n = [len(model.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in expected]
    wanted = sorted(((i, sum(n[:k]), n[k]) for k, (i, _) in enumerate(expected)), key=repr)
    for order in (rows, rows[::-1]):
        folder = new_folder(spark, "tokens")
        index = token_arrow.write_tokens(spark.createDataFrame(order, "doc_id long, text string").repartition(4), folder, shards=2)
        assert rows_of(token_arrow.read_documents(index, folder), "doc_id", "start", "n_tokens") == wanted
        wrong = index.selectExpr("doc_id", "file", "shard", "place", "start_in_shard + 7 as start_in_shard", "n_tokens * 3 as n_tokens")
        assert rows_of(token_arrow.read_documents(wrong, folder), "doc_id", "start", "n_tokens") == wanted


def test_length_histogram(spark, sf, model):
    texts = [r[1] for r in awkward()]
    lengths = [len(model.encode(t or "", add_special_tokens=False).ids) + 1 for t in texts]
    found = token_counts.limit_table(token_counts.length_histogram(spark.createDataFrame(awkward(), SCHEMA)), block=8)
    expected = [(x, n, sum(y >= x for y in lengths), sum(y for y in lengths if y >= x), sum(min(x, y) for y in lengths), sum(lengths), sum(y <= x for y in lengths) / len(lengths)) for x, n in Counter(lengths).items()]
    assert rows_of(found, *found.columns) == sorted(expected, key=repr)
    for limit in (0, 1, 2, 37, 500, 10**6):
        assert token_counts.truncated_total(found, limit).first()[0] == sum(min(limit, y) for y in lengths)
    docs = [r[0] for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    query = token_counts.op9_token_counts(spark, sf)
    assert rows_of(query, "length", "n_docs") == sorted(Counter(len(model.encode(t, add_special_tokens=False).ids) + 1 for t in docs).items(), key=repr)
    assert token_counts.limit_table(token_counts.length_histogram(spark.createDataFrame([], SCHEMA))).count() == 0

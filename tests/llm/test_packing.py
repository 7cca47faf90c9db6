import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from lexloom.llm import packing, token_arrow

from .fixtures import SCHEMA, awkward, prose

PATH = token_arrow.tokenizer_path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def model():
    return Tokenizer.from_file(PATH)


SPACES = ["a  b", "a   b", " a", "  a", "a ", "a  ", "a \nb", "a\n b", "a\n\n b", "a\nb", "a\n\nb", "\na", "a\n", "a  b", "a  \nb", "a 　b", "a   b", "\t a\r\n b", " ", "\n", "it's 's I'LL 'll\n'tis", "a<|endoftext|> b", "a\n <|endoftext|>", "a  <|endoftext|>  b", "\x00 \x00a", "\x1c a \x1d b", "“q” – ‘r’ … x y", "Ġ aĠb", "end. end end, (end) end.) x.. é! é̈. 12; ½, …. a'. a's, a-b- .", "it's! it' 's. 'tis, ²) ²"]


def test_ids_equal_the_library_on_whole_texts(model):
    rng = random.Random(5)
    texts = [r[1] for r in awkward() if r[1]] + SPACES
    texts += ["".join(rng.choice(["a", "b'", " ", "\n", " ", "12", "é", "!", "\t", "　", "'s"]) for _ in range(30)) for _ in range(300)]
    table, split = packing._new_table(PATH)
    for t in texts[::3]:  # words that are known when others with signs come
        token_arrow.encoded(table, [t.encode()], None, split)
    ids, n = token_arrow.encoded(table, [t.encode() for t in texts], None, split)
    for t, part in zip(texts, np.split(ids, np.cumsum(n)[:-1]), strict=True):
        assert part.tolist() == model.encode(t, add_special_tokens=False).ids, t


def held_to_contract(rows, model, window=1024):
    """rows: (doc_id, text) and pieces (doc_id, start, length, crc, doc_tokens, sequence_id, offset), for distinct ids."""
    docs, pieces = rows
    whole = {i: [*model.encode(t or "", add_special_tokens=False).ids, 0] for i, t in docs}
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for i, start, length, crc, total, sequence, offset in pieces:
        assert length > 0 and total == len(whole[i])
        assert crc == zlib.crc32(np.array(whole[i][start : start + length], "<u4").tobytes())
        by_doc[i].append((start, length))
        by_sequence[sequence].append((offset, length))
    for i, ids in whole.items():
        at = 0
        for start, length in sorted(by_doc[i]):
            assert start == at
            at += length
        assert at == len(ids)
    padding = 0
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
    return padding


COLUMNS = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def crc(df):
    from pyspark.sql import functions as F

    assert df.filter(F.crc32("ids") != F.col("ids_crc32")).count() == 0
    return [tuple(r) for r in df.select(*COLUMNS).collect()]


def test_query_without_padding(spark, sf, model):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    pieces = [tuple(r[c] for c in COLUMNS) for r in packing.op13_packing(spark, sf).collect()]
    assert held_to_contract((docs, pieces), model) == 0
    assert len(pieces) < 2.2 * len(docs)


def test_awkward_rows_small_windows_and_sequences(spark, model):
    rows = list({r[0]: r for r in awkward() if r[0] is not None}.values())
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    pieces = packing.settled(packing.pack(docs, window=64), "packed")
    assert held_to_contract(([(r[0], r[1]) for r in rows], crc(pieces)), model, 64) == 0
    texts = {r[0]: [*model.encode(r[1] or "", add_special_tokens=False).ids, 0] for r in rows}
    made = {r["sequence_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in packing.sequences(pieces).collect()}
    for r in pieces.collect():
        assert made[r["sequence_id"]][r["offset"] : r["offset"] + r["length"]] == texts[r["doc_id"]][r["start"] : r["start"] + r["length"]]
    assert sum(map(len, made.values())) == sum(map(len, texts.values()))


def test_repeated_rows_and_empty_table(spark, model):
    found = packing.pack(spark.createDataFrame(awkward(), SCHEMA))
    total = sum(len(model.encode(r[1] or "", add_special_tokens=False).ids) + 1 for r in awkward())
    assert sum(r["length"] for r in found.collect()) == total
    assert packing.pack(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("seed", range(12))
def test_plan_of_any_histogram(seed):
    rng = random.Random(seed)
    window = [16, 64, 1024][seed % 3]
    counts = {rng.randrange(1, window): rng.choice([1, 2, 7, 500, 10**7]) for _ in range(rng.choice([1, 3, 40, 400]))}
    if seed == 0:
        counts = {11: 10**9}  # one hot length without a complement
    if seed == 1:
        counts = {1: 10**9 + 1}
    plan, n = packing.packed(counts, window)
    used = Counter()
    ranges = defaultdict(list)
    for length, low, high, each, begin, size, sequence, place in plan:
        used[length] += (high - low) * size
        ranges[length].append((low, high, begin, size))
        assert (high - low) % each == 0 and 0 <= sequence and sequence + (high - low) // each <= n and place + each * size <= window
    assert used == Counter({k: k * v for k, v in counts.items()})
    for length, parts in ranges.items():  # at each rank the parts make the whole rest
        for rank in {x for low, high, _, _ in parts for x in (low, high - 1)}:
            at = 0
            for _, _, begin, size in sorted((p for p in parts if p[0] <= rank < p[1]), key=lambda p: p[2]):
                assert begin == at
                at += size
            assert at == length
    assert n == sum(k * v for k, v in counts.items()) // window + bin(sum(k * v for k, v in counts.items()) % window).count("1")
    assert len(plan) < 40 * window


def test_least_squares_meets_a_planted_solution():
    columns = packing.combinations(64, 3)
    rng = random.Random(1)
    want = [rng.choice([0, 0, 5, 100]) for _ in columns]
    counts = [0] * 64
    for x, c in zip(want, columns, strict=True):
        for length, m in c:
            counts[length] += x * m
    x = packing.solved(columns, counts, 2000)
    assert min(x) >= 0
    got = [0.0] * 64
    for v, c in zip(x, columns, strict=True):
        for length, m in c:
            got[length] += v * m
    assert max(abs(a - b) for a, b in zip(got, counts, strict=True)) < 1
    assert all(sum(a * m for a, m in c) == 64 and sum(m for _, m in c) <= 3 for c in columns)
    assert prose(rng, 3)

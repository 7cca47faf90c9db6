import random

import pytest

from lexloom.llm import suffix_dedup

from .fixtures import SCHEMA, awkward, prose, rows_of, words_of


def brute(rows, passage=50):
    places, texts = {}, {}
    for doc, text in rows:
        texts[doc] = words_of(text, lower=False)
        for i in range(len(texts[doc]) - passage + 1):
            places.setdefault(tuple(texts[doc][i : i + passage]), []).append((doc, i))
    hit = {}
    for at in places.values():
        if len(at) > 1:
            for doc, i in at:
                hit.setdefault(doc, set()).update(range(i, i + passage))
    out = []
    for doc, words in hit.items():
        run = sorted(words)
        a = run[0]
        for x, y in zip(run, [*run[1:], -1], strict=True):
            if y != x + 1:
                out.append((doc, a, x + 1))
                a = y
    return sorted(out, key=repr)


SPAN = ("doc_id", "start_word", "end_word")


def test_spans_equal_brute_force_on_awkward_rows(spark):
    rows = [r for r in {r[0]: r for r in awkward()}.values() if r[0] is not None]
    found = suffix_dedup.repeated_passages(spark.createDataFrame(rows, SCHEMA))
    assert rows_of(found, *SPAN) == brute([(r[0], r[1]) for r in rows])
    assert suffix_dedup.repeated_passages(spark.createDataFrame([], SCHEMA)).count() == 0
    assert suffix_dedup.repeated_passages(spark.createDataFrame(awkward(), SCHEMA)).count() >= found.count()


@pytest.mark.parametrize("seed", range(3))
def test_overlapping_copies_of_random_stretches(spark, seed):
    """Stretches that begin and end anywhere, many below and above 50 words, copied among documents."""
    rng = random.Random(seed)
    source = prose(rng, 600, 3000).split()
    rows = []
    for i in range(60):
        words = prose(rng, rng.randrange(40), 3000).split()
        for _ in range(rng.randrange(4)):
            a, n = rng.randrange(550), rng.randrange(30, 110)
            words += source[a : a + n] + prose(rng, rng.randrange(30), 3000).split()
        rows.append((i, " ".join(words)))
    found = suffix_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string"))
    assert rows_of(found, *SPAN) == brute(rows)
    first = {r["doc_id"] for r in found.collect()}
    assert all(r["first_doc_id"] <= r["doc_id"] and r["first_doc_id"] in first for r in found.collect())
    assert found.filter("not removable").count() > 0


def test_rows_that_repeat_an_id(spark):
    rng = random.Random(8)
    passage = prose(rng, 60, 9999)
    texts = [prose(rng, 10, 9999) + " " + passage + " " + prose(rng, 20, 9999) for _ in range(2)]
    rows = [(1, texts[0]), (1, texts[1]), (2, prose(rng, 90, 9999)), (2, prose(rng, 90, 9999)), (3, texts[0] + " x"), (4, None), (4, "")]
    docs = spark.createDataFrame([(i, t, 7, "k", 1) for i, t in rows], "doc_id long, text string, row long, key string, at int")
    found = suffix_dedup.repeated_passages(docs).select("doc_id", "start_word", "end_word", "first_doc_id", "removable").collect()
    assert sorted(map(tuple, found)) == [(1, 0, 90, 1, False), (1, 10, 70, 1, True), (3, 0, 90, 1, True)] or sorted(map(tuple, found)) == [(1, 0, 90, 1, False), (1, 10, 70, 1, False), (3, 0, 90, 1, True)]
    same = suffix_dedup.repeated_passages(spark.createDataFrame([(9, texts[0])] * 3, "doc_id long, text string"))
    assert sorted((r["doc_id"], r["start_word"], r["end_word"], r["first_doc_id"]) for r in same.collect()) == [(9, 0, 90, 9)] * 3
    assert same.filter("removable").count() == 2


@pytest.mark.parametrize("run", [1, 4096])
def test_sorted_runs_and_counted_windows_agree_with_brute_force(spark, run):
    rng = random.Random(21)
    source = prose(rng, 300, 3000).split()
    rows = []
    for i in range(80):
        words = prose(rng, rng.randrange(30), 3000).split()
        a, n = rng.randrange(250), rng.randrange(20, 120)
        rows.append((i, " ".join(words + source[a : a + n] + prose(rng, rng.randrange(30), 3000).split())))
    found = suffix_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string"), run=run)
    assert rows_of(found, *SPAN) == brute(rows)
    words, windows = {i: words_of(t, lower=False) for i, t in rows}, {}
    for i, w in words.items():
        for k in range(len(w) - 49):
            windows.setdefault(tuple(w[k : k + 50]), []).append((i, k))
    for r in found.collect():
        own = [windows[tuple(words[r["doc_id"]][k : k + 50])] for k in range(r["start_word"], r["end_word"] - 49)]
        own = [(k, x) for k, x in enumerate(own, r["start_word"]) if len(x) > 1]
        assert r["first_doc_id"] == min(x[0][0] for _, x in own)
        assert r["removable"] == all(min(x) != (r["doc_id"], k) for k, x in own)


def test_query(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert rows_of(suffix_dedup.op1_suffix_dedup(spark, sf), *SPAN) == brute(docs)

import random
from collections import defaultdict

import numpy as np
import pytest

from lexloom.llm import minhash

from .fixtures import SCHEMA, awkward, prose, rows_of, words_of


def brute(rows, n, percent):
    sets, root = {}, {}
    for i, t in rows:
        w = words_of(t)
        sets[i] = frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])

    def top(x):
        while root.get(x, x) != x:
            x = root[x]
        return x

    ids, inverted = sorted(sets), defaultdict(list)
    for i in ids:
        common = defaultdict(int)
        for g in sets[i]:
            for j in inverted[g]:
                common[j] += 1
            inverted[g].append(i)
        for j, c in common.items():
            if 100 * c >= percent * (len(sets[i]) + len(sets[j]) - c):
                a, b = top(i), top(j)
                root[max(a, b)] = min(a, b)
    return [(i, len(sets[i]), top(i), top(i) == i) for i in ids]


def got(df):
    return rows_of(df, "doc_id", "n_shingles", "component_id", "kept")


@pytest.mark.parametrize(("n", "percent"), [(3, 85), (5, 80)])
def test_groups_equal_brute_force_on_awkward_rows(spark, n, percent):
    rows = awkward()
    found = minhash.near_duplicates(spark.createDataFrame(rows, SCHEMA), n, percent).collect()
    assert len(found) == len(rows)
    for r in found:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
    expected = brute([(r[0], r[1]) for r in rows if r[0] is not None], n, percent)
    assert sorted({tuple(r[c] for c in ("doc_id", "n_shingles", "component_id", "kept")) for r in found if r["doc_id"] is not None}) == expected


def test_query_equals_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert got(minhash.op8_minhash(spark, sf)) == sorted(brute(docs, 3, 85), key=repr)


@pytest.mark.parametrize("seed", range(2))
def test_large_clusters_in_many_blocks(spark, seed):
    """Blocks far smaller than the clusters: pivots and comparisons across blocks must find every link."""
    rng = random.Random(seed)
    rows = []
    for g in range(3):
        base = prose(rng, 80, 9999).split()
        for _ in range(60):
            w = list(base)
            for _ in range(rng.randrange(9)):
                w[rng.randrange(80)] = f"e{rng.randrange(6)}"
            rows.append((len(rows), " ".join(w)))
    found = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85, block=900)
    assert got(found) == sorted(brute(rows, 3, 85), key=repr)


def test_one_of_each_group_stays_with_all_columns(spark):
    docs = spark.createDataFrame(awkward(), SCHEMA)
    kept = minhash.keep_one_of_each(docs, 5, 80)
    assert kept.schema == docs.schema
    ids = [r["doc_id"] for r in kept.collect()]
    smallest = {c for _, _, c, _ in brute([(r[0], r[1]) for r in awkward() if r[0] is not None], 5, 80)}
    assert sorted(i for i in ids if i is not None) == sorted(smallest) and ids.count(None) == 2


def test_rows_that_repeat_an_id_with_other_texts(spark):
    rng = random.Random(9)
    a, b, c = (prose(rng, 100, 9999) for _ in range(3))
    rows = [(5, a), (5, b), (7, a + " tail"), (9, b + " tail"), (9, b + " tail"), (4, c), (4, c), (4, None), (4, None)]
    docs = spark.createDataFrame([(i, t, 1, True, "x") for i, t in rows], "doc_id long, text string, gone long, first boolean, again string")
    found = [tuple(r) for r in minhash.near_duplicates(docs, 3, 85).select("doc_id", "component_id", "kept").collect()]
    assert sorted(found) == [(4, 4, True)] * 4 + [(5, 5, True)] * 2 + [(7, 5, False)] + [(9, 5, False)] * 2
    kept = minhash.keep_one_of_each(docs, 3, 85)
    assert kept.schema == docs.schema
    assert sorted((r["doc_id"], r["text"] or "") for r in kept.collect()) == sorted([(5, a), (5, b), (4, c), (4, ""), (4, "")])


def test_links_among_texts_of_a_template(spark):
    """Thousands of texts of similarity 0.3 share keys and make one cluster of many blocks; the links in it are found."""
    rng = random.Random(4)
    template = prose(rng, 46, 99999).split()
    texts = [" ".join(template + prose(rng, 54, 99999).split()) for _ in range(3000)]
    texts += [t + " tail" for t in texts[:50]]
    rows = list(enumerate(texts))
    found = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()}
    assert found == {i: i - 3000 if i >= 3000 else i for i, _ in rows}


def test_empty_table(spark):
    assert minhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_recall_of_the_tables_is_as_documented():
    for percent in (80, 85):
        m, s = minhash.tables_for(percent), percent / 100
        assert 1 - (1 - (1 - s**3) ** m) ** 2 < 1e-4


def test_forest_joins_what_is_near_and_no_more():
    """Against all pairs: the same components of pairs with an equal v_j, in one unit, whose traces are near."""
    rng = np.random.default_rng(0)
    for far in (2, 6):
        base = rng.integers(0, 3, (12, 20), dtype=np.uint8)
        trace = base[rng.integers(0, 12, 400)]
        change = rng.random(trace.shape) < 0.12
        trace = np.where(change, rng.integers(0, 3, trace.shape, dtype=np.uint8), trace)
        unit, v = np.sort(rng.integers(0, 4, 400)), rng.integers(0, 3, (400, 2))
        label = {"all": list(range(400)), "forest": list(range(400))}

        def join(kind, a, b, label=label):
            x, y = label[kind][a], label[kind][b]
            label[kind] = [x if z == y else z for z in label[kind]]

        for i in range(400):
            for j in range(i):
                if unit[i] == unit[j] and (v[i] == v[j]).any() and (trace[i] != trace[j]).sum() <= far:
                    join("all", i, j)
        found = minhash.forest(unit, v, trace, far)
        for a, b in found:
            assert (trace[a] != trace[b]).sum() <= far
            join("forest", a, b)
        classes = [len({(x, y) for x, y in zip(label["all"], label["forest"], strict=True)}), len(set(label["all"])), len(set(label["forest"]))]
        assert len(set(classes)) == 1 and len(found) == 400 - classes[0]


@pytest.mark.parametrize("unit", [7, 40])
def test_half_keys_of_many_classes_in_blocks(spark, unit):
    rng = random.Random(unit)
    base = prose(rng, 120, 9999).split()
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(rng.randrange(12)):
            w[rng.randrange(120)] = f"e{rng.randrange(9)}"
        rows.append((i, " ".join(w)))
    found = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85, unit=unit, block=4000)
    assert got(found) == sorted(brute(rows, 3, 85), key=repr)


def test_templates_make_no_links_to_compare():
    """Sets that share a template, similarity 0.3: no candidates, and an index of rare shingles that meets none of them."""
    rng = np.random.default_rng(1)
    for size in (2000, 8000):
        shared = rng.integers(0, 1 << 63, 7).astype(np.uint64)
        sets = [np.unique(np.r_[shared, rng.integers(0, 1 << 63, 8).astype(np.uint64)]) for _ in range(size)]
        assert minhash.links_within(sets, np.zeros(size, np.int64), np.arange(size), 85) == []

import hashlib
import random
import zlib
from fractions import Fraction

import duckdb
import numpy as np
import pytest

from lexloom.llm import periodic, queries

from .fixtures import SCHEMA, WHITE, awkward, prose


def split(text):
    return [w for w in WHITE.split(text or "") if w]


def brute(words, least=24, times=3):
    """Every lag, every stretch of matches, the smallest period of what is long enough."""
    out, n = [], len(words)
    for q in range(1, n // times + 1):
        i = q
        while i < n:
            if words[i] != words[i - q]:
                i += 1
                continue
            j = i
            while j < n and words[j] == words[j - q]:
                j += 1
            s, length = i - q, j - i + q
            if length >= max(least, times * q) and not any(all(words[x] == words[x - p] for x in range(s + p, j)) for p in range(1, q)):
                out.append((s, length, q))
            i = j
    return sorted(out)


def collapsed(words, runs):
    gone = {x for s, n, q in runs for x in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def found_in(lists):
    """What the functions inside the task find in several texts at once."""
    ids, flat, owner, starts = {}, [], [], [0]
    for k, ws in enumerate(lists):
        flat += [ids.setdefault(w, len(ids)) for w in ws]
        owner += [k] * len(ws)
        starts.append(len(flat))
    place, lag, first = periodic.lags(np.array(flat, np.int64), np.array(owner, np.int64), max(map(len, lists), default=0) // 3)
    cut = np.searchsorted(place, starts)
    return [periodic.runs_of((place[a:b] - s).tolist(), lag[a:b].tolist(), first[a:b].tolist(), 24, 3) for a, b, s in zip(cut[:-1], cut[1:], starts, strict=False)]


@pytest.mark.parametrize("seed", range(60))
def test_runs_equal_brute_force(seed):
    rng = random.Random(seed)
    lists = []
    for _ in range(12):
        letters = "ab"[: 1 + seed % 2] if seed % 5 == 0 else "abcdefghij"[: 2 + seed % 8]
        words = [rng.choice(letters) for _ in range(rng.randrange(60))]
        for _ in range(rng.randrange(5)):
            loop = [rng.choice(letters) for _ in range(rng.choice([1, 2, 3, 5, 7, 8, 9, 12, 16, 17, 20, 33]))]
            words += (loop * rng.randrange(2, 10))[: rng.randrange(10, 160)] + [rng.choice(letters) for _ in range(rng.randrange(9))]
        lists.append(words)
    assert found_in(lists) == [brute(ws) for ws in lists]


def test_long_runs_are_cheap():
    words = ["spam"] * 200_000
    assert found_in([words, words[:7], ["a", "b"] * 50_000, list("abc") * 8, []]) == [[(0, 200_000, 1)], [], [(0, 100_000, 2)], [(0, 24, 3)], []]


def expected(doc, text):
    words = split(text)
    n, h = len(words), zlib.crc32(str(doc).encode()) if doc is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute(words)
    top = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None,) * 3)
    sha = [hashlib.sha256(x.encode()).hexdigest() for x in ("".join(f"{s},{n},{q}\n" for s, n, q in runs), collapsed(words, runs))]
    return (doc, len(runs), *top, 1000 * top[1] // top[2] if runs else None, *sha)


COLUMNS = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def test_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(3)
    rows = [r for r in awkward() if r[1] is None or len(r[1]) < 20000]
    rows += [(i, prose(rng, rng.randrange(1, 300), 50), "en", "s", 1, None, None, None, None, None, None) for i in range(1000, 1150)]
    rows += [(2000 + i, "x " * i + "y z " * i, "en", "s", 1, None, None, None, None, None, None) for i in range(10, 40, 3)]
    assert sum(zlib.crc32(str(r[0]).encode()) % 10 == 0 for r in rows) > 8
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r[c] for c in COLUMNS) for r in periodic.op12_periodic(spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted((expected(r[0], r[1]) for r in rows), key=repr)


def test_query_equals_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    rel = con.execute(queries.oracle_sql()["op12_periodic"])
    names = [x[0] for x in rel.description]
    rows = [dict(zip(names, r, strict=True)) for r in rel.fetchall()]
    got = [tuple(r[c] for c in COLUMNS) for r in periodic.op12_periodic(spark, sf).collect()]
    assert sorted(got, key=repr) == sorted((tuple(r[c] for c in COLUMNS) for r in rows), key=repr) and sum(r["n_runs"] > 0 for r in rows) > 5


def test_texts_spans_and_empty_table(spark):
    rows = [(1, "a b  c\n" + "d e f " * 9 + "g"), (2, None), (None, "x " * 30)]
    got = {r["doc_id"]: (r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in periodic.periodic_runs(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (31, [(3, 27, 3)], "a b c d e f g"), 2: (0, [], ""), None: (30, [(0, 30, 1)], "x")}
    assert periodic.periodic_runs(spark.createDataFrame([], SCHEMA)).count() == 0
    with pytest.raises(ValueError):
        periodic.periodic_runs(spark.createDataFrame(rows, "doc_id long, text string"), least=4)

import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from lexloom.llm import collocations, queries

from .fixtures import SCHEMA, awkward, prose, rows_of

COLUMNS = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def brute(rows, longest=3, least=10, inside=50, top=2000):
    f, n = Counter(), Counter()
    for lang, text in rows:
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            words = [w for w in re.split("[\x20\x09]+", piece) if w]
            n[lang or "und"] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    f[lang or "und", tuple(words[i : i + k])] += 1
    candidates = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= least}
    gone = set()
    for (lang, p), a in candidates.items():
        for k in range(2, len(p)):
            for i in range(len(p) - k + 1):
                inner = (lang, p[i : i + k])
                if 100 * a >= inside * candidates[inner]:
                    gone.add(inner)
    out = []
    for (lang, p), a in candidates.items():
        if (lang, p) not in gone:
            score, _, left, right = min((1000000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
            out.append((lang, -score, -a, " ".join(p).encode(), left, right))
    seen, ranked = Counter(), []
    for lang, score, a, p, left, right in sorted(out):
        seen[lang] += 1
        if seen[lang] <= top:
            ranked.append((lang, seen[lang], p.decode(), -a, left, right, n[lang], -score))
    return sorted(ranked, key=repr)


def corpus(seed):
    rng = random.Random(seed)
    phrases = [prose(rng, 3, 500) for _ in range(30)] + [prose(rng, 2, 500) for _ in range(30)] + ["New  York\tCity", "aa aa aa aa", "é ü", "\x00 ."]
    out = []
    for _ in range(300):
        parts = [rng.choice(phrases) if rng.random() < 0.5 else prose(rng, rng.randrange(4), 60) for _ in range(rng.randrange(40))]
        out.append((rng.choice(["en", "en", "de", None, "und"]), "".join(p + rng.choice([" ", " ", " ", ". ", ",", "\n", "\r\n", " ; "]) for p in parts)))
    return out


@pytest.mark.parametrize("seed", range(2))
def test_equals_brute_force(spark, seed):
    rows = corpus(seed) + [(r[2], r[1]) for r in awkward()]
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    for longest, top in ((3, 2000), (4, 25)):
        found = collocations.collocations(docs, longest, 10, 50, top, slice_bytes=4000, bucket=3000)
        expected = brute(rows, longest, 10, 50, top)
        assert len(expected) > 60 and rows_of(found, *COLUMNS) == expected


def test_exact_scores_of_large_counts(spark):
    from pyspark.sql import functions as F

    big = 3_000_000_017
    row = spark.createDataFrame([(big, [big + 2, big], [big + 4, big])], "f long, prefixes array<long>, suffixes array<long>")
    cut = row.select(collocations._cut(2).alias("c")).select("c.*").first()
    assert tuple(cut) == (10**6 * big * big // ((big + 2) * (big + 4)), 1, big + 2, big + 4)
    assert row.select(F.lit(1)).count() == 1


def test_query_equals_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    rel = con.execute(queries.oracle_sql()["op11_collocations"])
    names = [x[0] for x in rel.description]
    expected = sorted((tuple(dict(zip(names, r, strict=True))[c] for c in COLUMNS) for r in rel.fetchall()), key=repr)
    assert expected and rows_of(collocations.op11_collocations(spark, sf), *COLUMNS) == expected
    texts = con.execute("select lang, text from documents").fetchall()
    assert expected == brute(texts)


def test_empty_and_clashing_names(spark):
    assert collocations.collocations(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(i, "a b c", "x", 1, 2) for i in range(12)]
    docs = spark.createDataFrame(rows, "slice long, text string, lang string, id long, f long")
    assert rows_of(collocations.collocations(docs), *COLUMNS) == [("x", 1, "a b c", 12, 12, 12, 36, 1000000)]
    assert collocations.collocations(docs.limit(9)).count() == 0


def test_squeezed_numbers():
    for x in ([], [0], [5, -1, 2**62, -(2**62)], list(range(1000))):
        assert collocations.loosed(collocations.squeezed(np.array(x, np.int64))).tolist() == x

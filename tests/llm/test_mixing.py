import hashlib
import zlib
from collections import defaultdict

from lexloom.llm import mixing

from .fixtures import SCHEMA, awkward, rows_of, words_of


def brute(rows, share=1.0, max_epochs=4, seed=4, buckets=4096, weights=mixing.WEIGHTS):
    docs = []
    for doc, text, lang, source in rows:
        source, lang = source if source is not None else "(null)", lang if lang is not None else "(null)"
        docs.append((doc, (f"d{zlib.crc32(source.encode()) % 4}", lang, source), len(words_of(text))))
    tokens = defaultdict(int)
    for _, leaf, n in docs:
        tokens[leaf] += n
    budgets = {}

    def fill(prefix, budget):
        k = len(prefix)
        if k == 3:
            budgets[prefix] = budget
            return
        cap = defaultdict(int)
        for leaf, n in tokens.items():
            if leaf[:k] == prefix:
                cap[leaf[k]] += n * max_epochs
        weight = {v: weights.get(mixing.LEVELS[k], {}).get(v, 1) for v in cap}
        given, open_, left = {}, dict(weight), budget
        while True:  # children that are full leave, what they leave over goes to their siblings
            total = sum(open_.values())
            full = [v for v in open_ if cap[v] * total <= open_[v] * left]
            if not full:
                break
            for v in full:
                given[v] = cap[v]
                del open_[v]
            left = max(0, left - sum(cap[v] for v in full))
        for v, w in open_.items():
            given[v] = min(cap[v], w * left // sum(open_.values()))
        for v in cap:
            fill((*prefix, v), given[v])

    fill((), int(share * sum(tokens.values())))
    out = []
    by_leaf = defaultdict(list)
    for d in docs:
        by_leaf[d[1]].append(d)
    for leaf, members in by_leaf.items():
        whole, rest = divmod(budgets[leaf], tokens[leaf]) if tokens[leaf] else (0, 0)
        run = 0

        def key(d):
            digest = hashlib.md5(f"{seed}:{whole}:{'' if d[0] is None else d[0]}".encode()).hexdigest()
            return int(digest[:6], 16) % buckets, digest, d[2]

        for d in sorted(members, key=key):
            run += d[2]
            out += [(d[0], *leaf, d[2], e) for e in range(whole + (run <= rest))]
    return budgets, tokens, sorted(out, key=repr)


COLUMNS = ("doc_id", "domain", "lang", "source", "tokens", "epoch")


def test_budgets_and_rows_equal_a_plain_version(spark, sf):
    rows = awkward()
    for share in (0.1, 1.0, 3.0, 9.0):
        found = mixing.mixture(spark.createDataFrame(rows, SCHEMA), share)
        assert rows_of(found, *COLUMNS) == brute([r[:4] for r in rows], share)[2]
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source").collect()]
    budgets, tokens, expected = brute(docs)
    assert rows_of(mixing.op4_mixing(spark, sf), *COLUMNS) == expected
    assert sum(budgets.values()) <= sum(tokens.values()) and sum(budgets.values()) > 0.99 * sum(tokens.values())


def test_rows_are_taken_with_all_their_columns(spark):
    docs = spark.createDataFrame(awkward(), SCHEMA)
    taken = mixing.take_mixture(docs)
    assert taken.schema == docs.schema
    assert rows_of(taken, "doc_id") == sorted(((x[0],) for x in brute([r[:4] for r in awkward()])[2]), key=repr)
    assert mixing.mixture(docs.limit(0)).count() == 0 and mixing.take_mixture(docs.limit(0)).count() == 0

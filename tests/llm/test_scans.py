import hashlib
import random

import pytest

from lexloom.llm import decontaminate, licenses

from .fixtures import SCHEMA, awkward, letter_words, prose, rows_of


def brute_hits(docs, items, window=10):
    patterns = {}
    for item, text in items:
        w = letter_words(text)
        for i in range(max(1, len(w) - window + 1)) if w else ():
            patterns.setdefault(tuple(w[i : i + window]), set()).add(item)
    sizes, out = sorted({len(p) for p in patterns}), []
    for doc, text in docs:
        w = letter_words(text)
        hit, found = set(), set()
        for i in range(len(w)):
            for n in sizes:
                p = tuple(w[i : i + n])
                if len(p) == n and p in patterns:
                    hit.update(range(i, i + n))
                    found |= patterns[p]
        sha = hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
        out.append((doc, len(w), len(hit), len(found), sha, bool(hit)))
    return sorted(out, key=repr)


HIT = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def planted():
    rng = random.Random(3)
    items = [(k, prose(rng, n, 60)) for k, n in enumerate((30, 12, 10, 9, 4, 1, 2, 45, 10))] + [(9, None), (10, ""), (None, "w1 w2"), (11, "!!!"), (12, prose(random.Random(3), 30, 60))]
    rows = awkward()
    for i, (_, text) in enumerate(items[:9]):
        part = text.split()
        rows.append((1000 + i, prose(rng, 50) + " " + ", ".join(part[-10:]).title() + ". " + prose(rng, 20), *rows[0][2:]))
        rows.append((1100 + i, " ".join(part[:9]), *rows[0][2:]))
    return rows, items


def test_decontamination_equals_brute_force(spark):
    rows, items = planted()
    docs, bench = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(items, "item_id long, text string")
    expected = brute_hits([(r[0], r[1]) for r in rows], [x for x in items if x[0] is not None])
    assert rows_of(decontaminate.find_contamination(docs, bench), *HIT) == expected
    assert rows_of(decontaminate.find_contamination(docs, bench, max_chars=100), *HIT) == expected
    for most in (2_000_000, 100):
        clean = decontaminate.drop_contaminated(docs, bench, max_chars=most)
        assert clean.schema == docs.schema and rows_of(clean, "doc_id") == sorted(((x[0],) for x in expected if not x[5]), key=repr)


def test_decontamination_query_and_empty_tables(spark, sf):
    docs, bench = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    expected = brute_hits([tuple(r) for r in docs.select("doc_id", "text").collect()], [tuple(r) for r in bench.select("item_id", "text").collect()])
    assert any(x[5] for x in expected) and rows_of(decontaminate.op10_decontaminate(spark, sf), *HIT) == expected
    assert decontaminate.find_contamination(spark.createDataFrame([], SCHEMA), bench).count() == 0
    assert decontaminate.find_contamination(docs, bench.limit(0)).filter("contaminated").count() == 0


BASE = ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def brute_base(rows):
    out = []
    for doc, text in rows:
        w, at, labels = letter_words(text), [], set()
        for phrase, label in licenses.BASE.items():
            p = phrase.split()
            for i in range(len(w) - len(p) + 1):
                if w[i : i + len(p)] == p:
                    at.append(i)
                    labels.add(label)
        out.append((doc, len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))))
    return sorted(out, key=repr)


def licensed():
    texts = [
        "MIT", "MIT License", "license mit license", "the MIT-License and (Apache) License", "General\nPublic License", "general public public license", "mit " * 5 + "license " * 5,
        "Licensed under the Apache License, Version 2.0.", "This work is licensed under the GNU General Public License, version 3.", "Licensed under CC BY-NC 4.0.", "general public", "license",
    ]
    rows = awkward()
    return rows + [(2000 + i, t, *rows[0][2:]) for i, t in enumerate(texts)]


def test_licences_equal_brute_force(spark, sf):
    rows = licensed()
    found = licenses.scan_licences(spark.createDataFrame(rows, SCHEMA))
    assert rows_of(found, *BASE) == brute_base([(r[0], r[1]) for r in rows])
    by = {r["doc_id"]: r for r in found.collect()}
    assert by[2007]["labels"] == "apache,apache-2.0" and by[2008]["labels"] == "gpl,gpl-3.0" and by[2009]["labels"] == "cc-by-nc-4.0"
    assert by[2007]["score"] > by[2001]["score"] * 0.5 > 0 and by[2000]["score"] == 0
    assert all(set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1 for r in by.values())
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert rows_of(licenses.op5_licenses(spark, sf), *BASE) == brute_base([tuple(r) for r in docs])
    assert licenses.scan_licences(spark.createDataFrame([], SCHEMA)).count() == 0


def plain_labels(text, idf):
    """Labels and score by looking for every segment at every place."""
    words = letter_words(text)

    def found(segment, keys):
        want = segment.split()
        must = set()
        for k in keys:
            i = next(i for i in range(len(want)) if want[i : i + len(k.split())] == k.split())
            must |= set(range(i, i + len(k.split())))
        for b in range(-len(want), len(words)):
            if all(0 <= b + j < len(words) and words[b + j] == want[j] for j in must):
                yield b, b + len(want), sum(idf[w] + 0.1 for j, w in enumerate(want) if 0 <= b + j < len(words) and words[b + j] == w)

    def follow(segments, end):
        if not segments:
            return 0.0
        shares = [w + rest for b, e, w in found(*segments[0]) if b >= end and (rest := follow(segments[1:], e)) is not None]
        return max(shares, default=None)

    labels, score = set(), 0.0
    for label, segments in [(label, [(t, keys)]) for t, label, keys in licenses.STATEMENTS] + licenses.TEXTS:
        weight = follow(segments, -1000)
        if weight is not None:
            labels.add(label)
            score = max(score, weight / sum(idf[w] + 0.1 for t, _ in segments for w in t.split()))
    return labels, min(1.0, score)


def test_labels_and_scores_equal_a_plain_search(spark):
    rng = random.Random(11)
    rows = licensed()
    for n, (_, segments) in enumerate(licenses.TEXTS):
        whole = [prose(rng, 9), *(x for t, _ in segments for x in (t, prose(rng, 5)))]
        changed = [" ".join(w if rng.random() < 0.93 else "other" for w in x.split()) for x in whole]
        for k, parts in enumerate((whole, changed, whole[::-1], whole[:2], [*whole, *changed])):
            rows.append((3000 + 10 * n + k, ". ".join(parts).capitalize(), *rows[0][2:]))
    docs = spark.createDataFrame(rows, SCHEMA)
    idf = licenses.licence_idf(docs)
    seen = {}
    for r in licenses.scan_licences(docs).collect():
        seen.setdefault(r["doc_id"], []).append(r)
    full = 0
    for doc, text in {(r[0], r[1]) for r in rows}:
        labels, score = plain_labels(text, idf)
        base = {label for phrase, label in licenses.BASE.items() if f" {phrase} " in f" {' '.join(letter_words(text))} "}
        assert any(r["labels"] == ",".join(sorted(labels | base)) and abs(r["score"] - score) < 1e-9 for r in seen[doc]), (doc, text, labels, score)
        full += score > 0.99
    assert full >= len(licenses.TEXTS)


def test_every_notice_is_found_and_licences_come_from_a_table(spark):
    assert len({label for _, label, _ in licenses.STATEMENTS} | {label for label, _ in licenses.TEXTS}) >= 40
    rows = [(i, f"Some words. {text.upper()}, more words", label) for i, (text, label, _) in enumerate(licenses.STATEMENTS)]
    for r in licenses.scan_licences(spark.createDataFrame(rows, "doc_id long, text string, label string")).collect():
        assert rows[r["doc_id"]][2] in r["labels"].split(",") and r["score"] > 0.99
    table = spark.createDataFrame([("own", "own-1", 2, "You may not, ever, copy", ["not ever"]), ("own", "own-1", 1, "The Own Licence", ["own licence"]), ("b", "base", 1, "mit license of b", ["license of b"])], "licence string, label string, segment int, text string, keys array<string>")
    docs = spark.createDataFrame([(1, "the own licence: you may not ever copy"), (2, "you may not ever copy the own licence"), (3, "the MIT license of B"), (4, None)], "doc_id long, text string")
    got = {r["doc_id"]: r["labels"] for r in licenses.scan_licences(docs, licenses.licences_of(table)).collect()}
    assert got == {1: "own-1", 2: "", 3: "base,mit", 4: ""}
    with pytest.raises(ValueError):
        licenses.licences_of(table.selectExpr("licence", "label", "segment", "'x' as text", "keys"))
    with pytest.raises(ValueError):
        licenses.licences_of(table, most=2)

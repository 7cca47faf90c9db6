"""Operator 5: licence scan by a positional index of rare licence words.

Templates are licence phrases, notices and texts. A text falls in segments, between which anything may stand (names, years);
each segment has key phrases, which must be there word for word. The words of all templates make up the licence vocabulary,
and a pass over the corpus counts in how many documents each of these words stands, which gives their IDF.

The index holds, for each segment, the places of its `RARE` words of the highest IDF among the mandatory ones. A second pass
notes the places of licence words in each file and looks up those that the index has, rare ones as they are. Each posting says
where the segment's first mandatory word would be; the postings of a segment are intersected by that, so that only places
on which all its indexed words agree are left. There all mandatory words are verified, and the other words count for the score. A template
is found where its segments follow each other. A document's score is the best share of IDF weight that is found of any
template, 0 without one.

Edge cases: null and word-less texts have no places and score 0; repeated rows give a row each; an empty table gives an
empty result; other columns are ignored. The IDF of a word in no document is that of one document.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LETTERS, WordTable, chunks, held, tables

# The base phrases and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
RARE = 3
# Notices, with their label and key phrases. Keys are mandatory and consecutive; all words are compared by place.
STATEMENTS = [
    ("released under the mit license", "mit", ["mit license"]),
    ("licensed under the apache license version 2 0", "apache", ["apache license"]),
    ("licensed under the apache license version 2 0", "apache-2.0", ["apache license version 2 0"]),
    ("this work is licensed under the gnu general public license version 3", "gpl", ["general public license"]),
    ("this work is licensed under the gnu general public license version 3", "gpl-3.0", ["gnu general public license version 3"]),
    ("this work is licensed under the gnu general public license version 2", "gpl-2.0", ["gnu general public license version 2"]),
    ("gnu lesser general public license", "lgpl", ["lesser general public license"]),
    ("gnu affero general public license", "agpl", ["affero general public license"]),
    ("licensed under cc by nc 4 0", "cc-by-nc-4.0", ["cc by nc 4 0"]),
    ("licensed under cc by sa 4 0", "cc-by-sa-4.0", ["cc by sa 4 0"]),
    ("licensed under cc by 4 0", "cc-by-4.0", ["cc by 4 0"]),
    ("creative commons attribution license", "cc-by", ["creative commons attribution"]),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2.0", ["mozilla public license"]),
    ("released under the bsd 3 clause license", "bsd-3-clause", ["bsd 3 clause"]),
    ("released under the bsd 2 clause license", "bsd-2-clause", ["bsd 2 clause"]),
    ("released under the isc license", "isc", ["isc license"]),
    ("eclipse public license version 2 0", "epl-2.0", ["eclipse public license"]),
    ("this is free and unencumbered software released into the public domain", "unlicense", ["free and unencumbered software"]),
    ("all rights reserved", "proprietary", ["all rights reserved"]),
    ("gnu lesser general public license version 2 1", "lgpl-2.1", ["lesser general public license version 2 1"]),
    ("gnu lesser general public license version 3", "lgpl-3.0", ["lesser general public license version 3"]),
    ("gnu affero general public license version 3", "agpl-3.0", ["affero general public license version 3"]),
    ("gnu free documentation license version 1 3", "gfdl-1.3", ["free documentation license"]),
    ("eclipse public license version 1 0", "epl-1.0", ["eclipse public license version 1 0"]),
    ("distributed under the boost software license version 1 0", "bsl-1.0", ["boost software license"]),
    ("to the extent possible under law the author has waived all copyright cc0 1 0 universal", "cc0-1.0", ["cc0 1 0 universal"]),
    ("licensed under cc by nd 4 0", "cc-by-nd-4.0", ["cc by nd 4 0"]),
    ("licensed under cc by nc sa 4 0", "cc-by-nc-sa-4.0", ["cc by nc sa 4 0"]),
    ("licensed under cc by nc nd 4 0", "cc-by-nc-nd-4.0", ["cc by nc nd 4 0"]),
    ("creative commons attribution sharealike license", "cc-by-sa", ["creative commons attribution sharealike"]),
    ("common development and distribution license version 1 0", "cddl-1.0", ["common development and distribution license"]),
    ("the artistic license 2 0", "artistic-2.0", ["artistic license 2 0"]),
    ("european union public licence version 1 2", "eupl-1.2", ["european union public licence"]),
    ("sil open font license version 1 1", "ofl-1.1", ["sil open font license"]),
    ("open database license version 1 0", "odbl-1.0", ["open database license"]),
    ("python software foundation license version 2", "psf-2.0", ["python software foundation license"]),
    ("microsoft public license ms pl", "ms-pl", ["microsoft public license"]),
    ("academic free license version 3 0", "afl-3.0", ["academic free license"]),
    ("do what the fuck you want to public license", "wtfpl", ["fuck you want to public license"]),
    ("released under the zlib license", "zlib", ["zlib license"]),
    ("business source license 1 1", "busl-1.1", ["business source license"]),
]
# Public licence texts by label, in segments with their key phrases; names and conditions of a project may
# stand between segments.
TEXTS: list[tuple[str, list[tuple[str, list[str]]]]] = [
    ("mit", [
        ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions", ["permission is hereby granted free of charge", "modify merge publish distribute sublicense"]),
        ("the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", ["permission notice shall be included"]),
        ("the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement", ["provided as is without warranty"]),
    ]),
    ("isc", [
        ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", ["with or without fee is hereby granted"]),
        ("the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness", ["author disclaims all warranties"]),
    ]),
    ("bsd-2-clause", [
        ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ["redistribution and use in source and binary forms"]),
        ("redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", ["redistributions of source code must retain"]),
        ("redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", ["redistributions in binary form must reproduce"]),
    ]),
    ("bsd-3-clause", [
        ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ["redistribution and use in source and binary forms"]),
        ("redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", ["redistributions in binary form must reproduce"]),
        ("may be used to endorse or promote products derived from this software without specific prior written permission", ["endorse or promote products derived from this software"]),
    ]),
    ("zlib", [
        ("this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", ["in no event will the authors be held liable"]),
        ("the origin of this software must not be misrepresented you must not claim that you wrote the original software", ["must not be misrepresented"]),
        ("altered source versions must be plainly marked as such and must not be misrepresented as being the original software", ["altered source versions must be plainly marked"]),
    ]),
    ("apache-2.0", [
        ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at", ["you may not use this file except in compliance with the license"]),
        ("unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied", ["unless required by applicable law or agreed to in writing"]),
    ]),
    ("gpl", [
        ("you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ["terms of the gnu general public license as published by the free software foundation"]),
        ("in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose", ["in the hope that it will be useful"]),
    ]),
    ("mpl-2.0", [("this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at", ["subject to the terms of the mozilla public license"])]),
    ("unlicense", [
        ("this is free and unencumbered software released into the public domain", ["free and unencumbered software"]),
        ("anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means", ["free to copy modify publish use compile sell or distribute"]),
    ]),
]
RESULT = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, places array<struct<label: string, word: long>>"


Statements = list[tuple[str, str, list[str]]]
Texts = list[tuple[str, list[tuple[str, list[str]]]]]


def licences_of(table: DataFrame, most: int = 50_000) -> tuple[Statements, Texts]:
    """Templates from a table of segments, for scan_licences: licence (a name of its own), label, segment (a number), text and
    keys (key phrases of that text). `most` bounds the segments, as each task holds all of them."""
    rows = table.select("licence", "label", "segment", "text", "keys").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} segments of licences")
    plain = lambda x: " ".join(x.encode().translate(LETTERS).decode().split())
    by: dict[tuple[str, str], list] = {}
    for r in sorted(rows, key=lambda r: (r["licence"], r["label"], r["segment"])):
        keys = [plain(k) for k in r["keys"]]
        if not keys or any(not k or f" {k} " not in f" {plain(r['text'])} " for k in keys):
            raise ValueError(f"{r['licence']}: a segment's key phrases must stand in its text")
        by.setdefault((r["licence"], r["label"]), []).append((plain(r["text"]), keys))
    return [], [(label, segments) for (_, label), segments in by.items()]


def template_words(licences: tuple[Statements, Texts] | None = None) -> dict[str, int]:
    statements, whole = licences or (STATEMENTS, TEXTS)
    texts = [*BASE, *(s for s, _, _ in statements), *(s for _, segments in whole for s, _ in segments)]
    return {w: i for i, w in enumerate(sorted({w for t in texts for w in t.split()}))}


def _vocabulary(ids: dict[str, int]) -> WordTable:
    known = {w.encode(): i for w, i in ids.items()}
    return WordTable(lambda words: {"term": np.fromiter((known.get(w, -1) for w in words), np.int32, len(words))})


def _terms(texts: list[bytes | None], ids: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    table = held(f"licences {hash(tuple(ids))}", lambda: _vocabulary(ids))
    numbers, starts = table.numbers([t.translate(LETTERS).split() if t else [] for t in texts])
    return (table.term[numbers] if len(numbers) else np.zeros(0, np.int32)), starts


def _counter(ids: dict[str, int]) -> Callable:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, docs = np.zeros(len(ids), np.int64), 0
        for _, texts in chunks(batches):
            terms, starts = _terms(texts, ids)
            docs += len(texts)
            at = np.flatnonzero(terms >= 0)
            owner = np.searchsorted(starts, at, "right") - 1
            df += np.bincount(np.unique(owner * len(ids) + terms[at]) % len(ids), minlength=len(ids))
        yield pa.record_batch([pa.array(np.r_[np.arange(len(ids)), -1]), pa.array(np.r_[df, docs])], names=["term", "n"])

    return count


def licence_idf(docs: DataFrame, licences: tuple[Statements, Texts] | None = None) -> dict[str, float]:
    """The IDF of each licence word over all documents. The words are those of the templates, so the result is bounded."""
    ids = template_words(licences)
    counted = docs.select("text").mapInArrow(_counter(ids), "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    n = {r["term"]: r["n"] for r in counted.collect()}
    return {w: math.log((1 + n.get(-1, 0)) / max(1, n.get(i, 0))) for w, i in ids.items()}


class Segment:
    """Words of a segment as terms, their IDF weights, and which of them are mandatory."""

    def __init__(self, text: str, keys: list[str], ids: dict[str, int], idf: dict[str, float]):
        words = text.split()
        at = [next(i for i in range(len(words)) if words[i : i + len(k.split())] == k.split()) for k in keys]
        self.terms = np.array([ids[w] for w in words])
        self.weights = np.array([idf[w] + 0.1 for w in words])
        self.must = np.array(sorted({a + j for a, k in zip(at, keys, strict=True) for j in range(len(k.split()))}))
        rarest = sorted(self.must.tolist(), key=lambda k: (-idf[words[k]], k))
        self.rare = sorted(rarest[:RARE])


class Templates:
    """Templates as lists of segments, and the index from rare words to places in segments."""

    def __init__(self, idf: dict[str, float], licences: tuple[Statements, Texts] | None = None):
        ids = template_words(licences)
        statements, whole = licences or (STATEMENTS, TEXTS)
        self.segments: list[Segment] = []
        self.templates: list[tuple[str, list[int]]] = []
        known: dict[tuple, int] = {}

        def number(text: str, keys: list[str]) -> int:
            if (text, *keys) not in known:
                known[(text, *keys)] = len(self.segments)
                self.segments.append(Segment(text, keys, ids, idf))
            return known[(text, *keys)]

        self.base = [(label, number(phrase, [phrase])) for phrase, label in BASE.items()]
        for text, label, keys in statements:
            self.templates.append((label, [number(text, keys)]))
        for label, segments in whole:
            self.templates.append((label, [number(text, keys) for text, keys in segments]))
        # Places are told from the first mandatory word: what stands before it may lie before the text.
        rows = sorted((int(x.terms[k]), n, k - int(x.must[0])) for n, x in enumerate(self.segments) for k in x.rare)
        self.posting_terms, self.posting_segments, self.posting_offsets = (np.array(x) for x in zip(*rows, strict=True))
        self.needed = np.array([len(x.rare) for x in self.segments])

    def find(self, terms: np.ndarray, starts: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each segment with places: the texts, where it begins in the row of all words, and the weight found there."""
        at = np.flatnonzero(np.isin(terms, self.posting_terms))
        low, high = np.searchsorted(self.posting_terms, terms[at]), np.searchsorted(self.posting_terms, terms[at], "right")
        n = high - low
        posting = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        first = np.repeat(at, n) - self.posting_offsets[posting]
        # The postings of a segment meet where they agree on the place of its first mandatory word.
        key, votes = np.unique((self.posting_segments[posting] << 40) + np.maximum(first, -1) + 1, return_counts=True)
        segment, first = key >> 40, (key & ((1 << 40) - 1)) - 1
        agreed = (votes == self.needed[segment]) & (first >= 0)
        segment, first = segment[agreed], first[agreed]
        out = {}
        for k in np.unique(segment).tolist():
            x = self.segments[k]
            owner = np.searchsorted(starts, first[segment == k], "right") - 1
            begin_k = first[segment == k] - x.must[0]
            place = begin_k[:, None] + np.arange(len(x.terms))
            inside = (place >= starts[owner][:, None]) & (place < starts[owner + 1][:, None])
            same = inside & (terms[np.clip(place, 0, len(terms) - 1)] == x.terms)
            good = same[:, x.must].all(1)
            if good.any():
                out[k] = owner[good], begin_k[good], (same[good] * x.weights).sum(1)
        return out


def best_share(places: list[list[tuple[int, float]]], lengths: list[int], total: float) -> float | None:
    """The largest share of weight of segments that follow each other; places are sorted begins with weights found."""
    reached: list[tuple[int, float]] = [(-(1 << 60), 0.0)]  # ends, and the best weight up to each
    for found, n in zip(places, lengths, strict=True):
        now, i, best = [], 0, None
        for begin, weight in found:
            while i < len(reached) and reached[i][0] <= begin:
                best = max(best or 0.0, reached[i][1])
                i += 1
            if best is not None:
                now.append((begin + n, best + weight))
        reached = now
    return min(1.0, max(w for _, w in reached) / total) if reached else None


def _scanner(idf: dict[str, float], licences: tuple[Statements, Texts] | None = None) -> Callable:
    ids = template_words(licences)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Templates(idf, licences)
        for batch, texts in chunks(batches):
            terms, starts = _terms(texts, ids)
            n = len(texts)
            hits = index.find(terms, starts) if len(terms) else {}
            places: list[list] = [[] for _ in range(n)]
            own: list[set[str]] = [set() for _ in range(n)]
            score = np.zeros(n)
            for label, k in index.base:
                if k in hits:
                    for doc, at, _ in zip(*(x.tolist() for x in hits[k]), strict=True):
                        places[doc].append((label, at - int(starts[doc])))
            for label, parts in index.templates:
                if not all(k in hits for k in parts):
                    continue
                by_doc: list[dict[int, list]] = []
                for k in parts:
                    of: dict[int, list] = {}
                    for doc, at, weight in zip(*(x.tolist() for x in hits[k]), strict=True):
                        of.setdefault(doc, []).append((at, weight))
                    by_doc.append(of)
                segments = [index.segments[k] for k in parts]
                total = float(sum(x.weights.sum() for x in segments))
                for doc in set(by_doc[0]).intersection(*by_doc[1:]):
                    share = best_share([sorted(of[doc]) for of in by_doc], [len(x.terms) for x in segments], total)
                    if share is not None:
                        own[doc].add(label)
                        score[doc] = max(score[doc], share)
            firsts = [[w for _, w in x] for x in places]
            names = [{label for label, _ in x} for x in places]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(np.diff(starts)), pa.array([len(x) for x in places], pa.int64()), pa.array([min(x, default=None) for x in firsts], pa.int64()), pa.array([max(x, default=None) for x in firsts], pa.int64()),
                    pa.array([",".join(sorted(x)) for x in names]), pa.array([",".join(sorted(x | y)) for x, y in zip(names, own, strict=True)]), pa.array(score),
                    pa.array([[{"label": a, "word": b} for a, b in x] for x in places], pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64())]))),
                ],
                names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "places"],
            )

    return scan


def scan_licences(docs: DataFrame, licences: tuple[Statements, Texts] | None = None) -> DataFrame:
    """One row for each row of `docs` (doc_id, text), see RESULT; `places` are the base phrases with their words' starts.
    `licences` are the templates, else STATEMENTS and TEXTS; licences_of reads them from a table."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_scanner(licence_idf(docs, licences), licences), f"doc_id {kind}, {RESULT}")


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licences(tables(spark, sf_dir, "documents")).drop("places")

"""Documents to sentences, languages, and periods of a few sentences."""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# A few very common words by language.
STOP_WORDS = {
    "en": ["the", "of", "and", "to", "in", "is", "that", "was", "for", "it", "with", "as", "are", "this", "be"],
    "de": ["der", "die", "und", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "für", "ist", "im", "ein"],
    "fr": ["le", "de", "la", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans"],
    "es": ["el", "que", "y", "los", "se", "del", "las", "por", "con", "no", "una", "su", "para", "es", "al"],
}


def sentence_array(text: Column) -> Column:
    """Sentences: text up to and with its end marks, trimmed, blanks left out."""
    parts = F.transform(F.regexp_extract_all(text, F.lit("[^.!?]+[.!?]*"), F.lit(0)), lambda s: F.regexp_replace(s, r"^[ \n\t]+|[ \n\t]+$", ""))
    return F.filter(parts, lambda s: s != "")


def split_sentences(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, pos and sentence; see sentence_array."""
    return docs.select(key, F.posexplode(sentence_array(F.col("text"))).alias("pos", "sentence"))


def language_hits(sentence: Column, stop_words: dict[str, list[str]] | None = None) -> dict[str, Column]:
    words = F.split(F.regexp_replace(F.lower(sentence), r"[.,;!?\n]", " "), " ")
    return {lang: F.size(F.filter(words, lambda w: w.isin(stop))) for lang, stop in (stop_words or STOP_WORDS).items()}  # noqa: B023


def detect_language(sentences: DataFrame, key: str = "doc_id", default: str = "en") -> DataFrame:
    """Adds language_code: most stop words, ties by name; without any, that of the sentence before."""
    hits = language_hits(F.col("sentence"))
    best = F.array_max(F.array(*[F.struct(n.alias("n"), F.lit(lang).alias("lang")) for lang, n in sorted(hits.items())]))
    rows = sentences.withColumn("_own", F.when(best["n"] > 0, best["lang"]))
    w = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("language_code", F.coalesce(F.last("_own", True).over(w), F.lit(default))).drop("_own")


def language_islands(sentences: DataFrame, key: str = "doc_id") -> DataFrame:
    """Adds lang_group: consecutive sentences of one language, from 1."""
    w = Window.partitionBy(key).orderBy("pos")
    changed = F.coalesce((F.lag("language_code").over(w) != F.col("language_code")).cast("int"), F.lit(1))
    return sentences.withColumn("_new", changed).withColumn("lang_group", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("_new")


# ---- the same, document by document, up to periods

WORD, SENTENCE, MARKS = re.compile(r"\w+"), re.compile("[^.!?]+[.!?]*"), str.maketrans(".,;!?\n", "      ")


def sentences_of(text: str) -> list[str]:
    return [s for s in (x.strip(" \n\t") for x in SENTENCE.findall(text)) if s]


def languages_of(sentences: list[str], stop_words: dict[str, frozenset[str]], default: str = "en") -> list[str]:
    out, now = [], default
    for s in sentences:
        words = s.lower().translate(MARKS).split(" ")
        n, best = max((sum(w in stop for w in words), lang) for lang, stop in stop_words.items())
        now = best if n else now
        out.append(now)
    return out


def grams_of(text: str) -> set[str]:
    return {text[i : i + 3] for i in range(len(text) - 3)}


def shared_grams(sentences: list[str]) -> np.ndarray:
    """For each sentence but the last how many of grams_of the next one has too.

    A gram is a number by the characters that occur, and with the number of its sentence one key; equal keys, after those
    of the next sentence are moved by one sentence, are shared. Where keys would pass 64 bits, halves are counted."""
    n, size = len(sentences), np.fromiter(map(len, sentences), np.int64, len(sentences))
    letters = np.frombuffer("".join(sentences).encode("utf-32-le"), np.uint32)
    if len(letters) < 4:
        return np.zeros(max(n - 1, 0), np.int32)
    seen = np.zeros(0x110000, bool)
    seen[letters] = True
    kinds = int(seen.sum())
    if (n + 1) * kinds**3 >= 1 << 63:
        return np.concatenate([shared_grams(sentences[: n // 2 + 1]), shared_grams(sentences[n // 2 :])])
    code = np.cumsum(seen)[letters] - 1
    keys = np.repeat(np.arange(n) * kinds**3, size)
    keys[:-2] += (code[:-2] * kinds + code[1:-1]) * kinds + code[2:]
    keys = keys[np.repeat(np.cumsum(size), size) - np.arange(len(letters)) > 3]
    keys.sort()
    keys = keys[np.diff(keys, prepend=-1) != 0]
    both = np.concatenate([keys, keys + kinds**3])
    both.sort(kind="stable")
    return np.bincount(both[1:][both[1:] == both[:-1]] // kinds**3, minlength=n + 1)[1:n].astype(np.int32)


def _shared(batches: Iterator[pa.RecordBatch], chars: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        many = pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy().astype(np.int64)
        doc = np.repeat(np.arange(len(many)), many)
        pos = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
        sentences, start = batch.column(1).flatten(), 0
        so_far = np.cumsum(pc.utf8_length(sentences).to_numpy())
        while start < len(doc) - 1:
            stop = max(int(np.searchsorted(so_far, so_far[start] + chars)), start + 2)
            common = shared_grams(sentences[start:stop].to_pylist())
            rows = np.arange(start, start + len(common))
            rows = rows[doc[rows] == doc[rows + 1]]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc[rows])), pa.array(pos[rows], pa.int32()), pa.array(common[rows - start])], names=[batch.schema.names[0], "pos", "common"])
            start += len(common)


def shared_with_next(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, pos and common: how many different trigrams a sentence shares with the next one of its document. A document is
    worked on where it lies; nothing is shuffled."""
    rows = spread(docs.select(key, "text")).select(key, sentence_array(F.col("text")).alias("sentences"))
    return rows.mapInArrow(_shared, f"`{key}` {rows.schema[key].dataType.simpleString()}, pos int, common int")


def pack(sentences: list[str], least: int = 30, most: int = 50, shared: int = 15) -> list[tuple[str, int, int]]:
    """Text, words and sentences of each period. A period takes sentences while it has under `least` words; a short last
    sentence joins it; it also takes a sentence when both together stay under `most` words and share `shared` trigrams,
    unless that sentence stands just before a short last one. Only the open period is looked at."""
    words = [len(WORD.findall(s)) for s in sentences]
    out: list[tuple[str, int, int]] = []
    parts: list[str] = []
    n = 0
    for i, (s, w) in enumerate(zip(sentences, words, strict=True)):
        joins = n < least or i == len(sentences) - 1 and w < least
        if parts and not joins and n + w < most and not (i == len(sentences) - 2 and words[-1] < least):
            joins = len(grams_of(" ".join(parts)) & grams_of(s)) >= shared
        if parts and not joins:
            out.append((" ".join(parts), n, len(parts)))
            parts, n = [], 0
        parts.append(s)
        n += w
    return [*out, (" ".join(parts), n, len(parts))] if parts else out


def _periods(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    stop = {lang: frozenset(words) for lang, words in STOP_WORDS.items()}
    for batch in batches:
        doc, rows = [], []
        for k, text in enumerate(batch.column(0).to_pylist()):
            sentences = sentences_of(text or "")
            langs = languages_of(sentences, stop)
            first = len(rows)
            groups = [list(g) for _, g in itertools.groupby(range(len(langs)), key=langs.__getitem__)]
            for group, places in enumerate(groups, 1):
                rows += [(group, langs[places[0]], at, *p) for at, p in enumerate(pack([sentences[i] for i in places]))]
            doc += [k] * (len(rows) - first)
            rows[first:] = [(*r, i, len(rows) - first) for i, r in enumerate(rows[first:], 1)]
        columns = list(zip(*rows, strict=True)) if rows else [()] * 8
        kinds = (pa.int64(), pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32())
        kept = pa.Table.from_batches([batch]).take(pa.array(doc, pa.int64())).combine_chunks().columns[1:]
        arrays = [c.combine_chunks() if c.num_chunks != 1 else c.chunk(0) for c in kept]
        yield pa.RecordBatch.from_arrays([*arrays, *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=[*batch.schema.names[1:], *PERIOD_COLUMNS])


PERIOD_COLUMNS = ["lang_group", "language_code", "at", "text", "word_length_i", "sent_length_i", "period_number_i", "parent_document_length_i"]
PERIOD_TYPES = "lang_group long, language_code string, at int, text string, word_length_i int, sent_length_i int, period_number_i int, parent_document_length_i int"


def spread(df: DataFrame) -> DataFrame:
    """`df` in as many partitions as there are cores, if a small table has fewer; large ones stay where they lie."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if not df.isStreaming and df.rdd.getNumPartitions() < cores else df


def pack_periods(docs: DataFrame) -> DataFrame:
    """Periods of documents (text and any other columns, which are kept, but for lang): greedy within each run of
    sentences of one language. A document is worked on as a whole where it lies; nothing is shuffled."""
    fields = [c for c in docs.columns if c not in ("text", "lang")]
    rows = spread(docs.select("text", *fields))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*fields).schema.fields)
    return rows.mapInArrow(_periods, f"{kept}, {PERIOD_TYPES}" if kept else PERIOD_TYPES)


def route_text_field(rows: DataFrame, supported: tuple[str, ...] = ("en",), language: str = "language_code") -> DataFrame:
    """The text goes to text_<language> of a supported language, else (and without a language) to text_xx."""
    known = F.coalesce(F.col(language).isin(*supported), F.lit(False))
    out = rows
    for lang in supported:
        out = out.withColumn(f"text_{lang}", F.when(F.col(language) == lang, F.col("text")))
    return out.withColumn("text_xx", F.when(~known, F.col("text"))).drop("text")


def period_text(rows: DataFrame, supported: tuple[str, ...] = ("en",)) -> Column:
    return F.coalesce(*[F.col(f"text_{lang}") for lang in supported], F.col("text_xx"))


def parent_length(periods: DataFrame, key: str = "doc_id") -> DataFrame:
    """Adds how many periods the document has; they are counted before they meet the rows again."""
    counts = periods.groupBy(F.col(key).alias("_k")).agg(F.count("*").alias("parent_document_length_i"))
    return periods.join(counts, F.col(key) == F.col("_k")).drop("_k")


def to_period_rows(periods: DataFrame) -> DataFrame:
    """The location of each period (its document's address and its number), and the text by language."""
    return route_text_field(periods.drop("at")).withColumn("doc_location", F.concat("url", F.lit("\t"), "period_number_i"))


def periods_of(docs: DataFrame) -> DataFrame:
    """Period rows of documents; docs has doc_id, url, text and others."""
    return to_period_rows(pack_periods(docs))

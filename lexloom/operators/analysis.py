"""Terms of texts as an index and its queries have them: words with positions, without stop words, stemmed by a word list.

Index chain: words, stop words out (in any case), lower case, possessive 's off, protected words kept as they are, stems.
Query chain: the same, but first synonyms of one or several words, the longest match at each place, stand beside what they
match, and stop words go after that. Positions count all words, so a stop word leaves a gap and phrases stay apart.

A stem is the first form of a word, with an ending cut off or changed, that the word list has; a word that the list has no
form of stays. The list is a table of any size: each different word of the corpus gives its forms once, which meet the list
in an equality join, and the texts' words meet the stems by word.

Edge cases: null and empty texts have no terms; an empty list leaves all words as they are; words in the list twice count
once; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What a word's ending may stand for: endings, and what takes their place, in the order in which forms are tried. `2` is
# the word without the ending and without the second of two equal letters before it.
FORMS = (("ies", ("y", "ie")), ("ied", ("y", "ie")), ("sses", ("ss",)), ("es", ("e", "")), ("ss", ()), ("s", ("",)), ("ing", ("e", "", "2")), ("ed", ("e", "", "2")), ("ers", ("e", "", "2", "er")), ("er", ("e", "", "2")), ("ness", ("",)), ("ment", ("",)), ("ly", ("", "le")))


def word_pieces(text: Column) -> Column:
    """The words of a text in a row, each with its position from 1."""
    words = F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}_]+(?:['’]s)?"), F.lit(0))
    return F.transform(words, lambda w, i: F.struct((i + 1).alias("position"), w.alias("word")))


def forms(word: Column) -> Column:
    """The forms that a word may be one of, three letters or more, best first."""
    out = F.array().cast("array<string>")
    cases = F.when(F.lit(False), out)
    for end, tos in FORMS:
        stem = F.substring(word, F.lit(1), F.length(word) - len(end))
        short = F.when(stem.rlike(r"(\p{L})\1$"), F.substring(stem, F.lit(1), F.length(stem) - 1))
        made = [short if to == "2" else F.concat(stem, F.lit(to)) for to in tos]
        cases = cases.when(word.endswith(end), F.filter(F.array_compact(F.array(*made)), lambda f: F.length(f) >= 3) if made else out)
    return F.coalesce(cases, out)


def stems(words: DataFrame, known: DataFrame) -> DataFrame:
    """word and stem, for the different words whose first known form is another one. words: word; known: word."""
    every = words.select("word").filter("word is not null").distinct()
    each = every.select("word", F.posexplode(forms(F.col("word"))).alias("k", "form"))
    found = each.join(known.select(F.lower("word").alias("form")).distinct(), "form")
    return found.groupBy("word").agg(F.min_by("form", "k").alias("stem"))


def _finished(rows: DataFrame, key: str, known: DataFrame | None, protected: tuple[str, ...]) -> DataFrame:
    rows = rows.withColumn("word", F.regexp_replace(F.lower("word"), "['’]s$", ""))
    if known is None:
        return rows.select(key, "position", F.col("word").alias("term"))
    stemmed = stems(rows.filter(~F.col("word").isin(*protected)) if protected else rows, known)
    return rows.join(stemmed, "word", "left").select(key, "position", F.coalesce("stem", "word").alias("term"))


def index_terms(rows: DataFrame, key: str, stop_words: list[str], known: DataFrame | None = None, protected: tuple[str, ...] = (), text: str = "text") -> DataFrame:
    """key, position and term, as texts are indexed."""
    each = rows.select(key, F.explode(word_pieces(F.col(text))).alias("w")).select(key, "w.*")
    return _finished(each.filter(~F.lower("word").isin(*stop_words)), key, known, protected)


def query_terms(rows: DataFrame, key: str, stop_words: list[str], known: DataFrame | None = None, protected: tuple[str, ...] = (), synonyms: dict[str, list[str]] | None = None, text: str = "text") -> DataFrame:
    """key, position and term, as queries are asked: terms of one position stand for each other. Synonyms (a phrase, and
    those that stand beside it, all in lower case) begin at the position of the phrase that they are of; each of their words
    takes a position of its own from there."""
    words = word_pieces(F.col(text))
    if synonyms:
        longest = max(len(p.split()) for p in synonyms)
        table = F.create_map(*[x for p, others in sorted(synonyms.items()) for x in (F.lit(p), F.array(*map(F.lit, others)))])

        def expanded(ws: Column) -> Column:
            def step(state: Column, w: Column) -> Column:
                at = w["position"]
                sizes = [F.when(F.size(ws) - at + 1 >= n, F.array_join(F.transform(F.slice(ws, at, F.lit(n)), lambda x: F.lower(x["word"])), " ")) for n in range(longest, 0, -1)]
                hit = F.get(F.array_compact(F.transform(F.array(*sizes), lambda p: F.when(F.try_element_at(table, p).isNotNull(), p))), F.lit(0))
                free = at >= state["next"]
                more = F.flatten(F.transform(F.coalesce(F.try_element_at(table, hit), F.array().cast("array<string>")), lambda s: F.transform(F.split(s, " "), lambda x, i: F.struct((at + i).alias("position"), x.alias("word")))))
                took = F.when(free & hit.isNotNull(), at + F.size(F.split(hit, " "))).otherwise(state["next"])
                return F.struct(took.cast("int").alias("next"), F.when(free & hit.isNotNull(), F.concat(state["more"], more)).otherwise(state["more"]).alias("more"))

            begin = F.struct(F.lit(1).alias("next"), F.array().cast("array<struct<position: int, word: string>>").alias("more"))
            return F.concat(ws, F.aggregate(ws, begin, step)["more"])

        words = F.transform(F.array(words), expanded)[0]  # queries are short: the fold is quadratic in their words at worst
    each = rows.select(key, F.explode(words).alias("w")).select(key, "w.*")
    return _finished(each.filter(~F.lower("word").isin(*stop_words)), key, known, protected)

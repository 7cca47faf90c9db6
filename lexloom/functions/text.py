"""Text functions: attribute words, clean text, densities, n-grams, queries, rules and highlights."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Codes of the features that rules address, and their columns.
FEATURES = {
    "d": "date_post", "cop": "compound_polarity_f", "wl": "word_length_i", "sl": "sent_length_i", "awl": "average_word_length_f",
    "awtf": "average_word_tf_idf_f", "pos": "positive_polarity_f", "neg": "negative_polarity_f", "neu": "neutral_polarity_f", "non": "nouns_proportion_f", "veb": "verbs_proportion_f",
    "adj": "adjectives_proportion_f", "prpn": "proper_nouns_proportion_f", "pdl": "parent_document_length_i", "pn": "period_number_i", "sld": "sentence_length_deviation_f",
}
PUNCTUATION = ".,;:!?()[]\"'"


def tokens(text: Column) -> Column:
    """Runs of letters, digits and underscores."""
    return F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def boundary_match(attr: Column, word: str) -> Column:
    """Whether `word` stands in an attribute between white space or the ends."""
    return F.array_contains(F.split(attr, r"\s"), word)


def clean_text(text: Column) -> Column:
    """Runs of spaces and of line ends become one; blank text becomes empty."""
    out = F.regexp_replace(F.regexp_replace(text, " +", " "), "\n+", "\n")
    return F.when(out.rlike(r"^[ \n\t]*$"), "").otherwise(out)


def link_density(chars_in_links: Column, text: Column) -> Column:
    """Characters in links by characters; 0 for empty text."""
    return F.when(F.length(text) > 0, chars_in_links / F.length(text)).otherwise(0.0)


def stopword_density(text: Column, stop_words: list[str]) -> Column:
    """Share of space-separated words, without punctuation, that are stop words. Apostrophes go first, so contractions never match."""
    words = F.filter(F.split(F.translate(F.lower(text), PUNCTUATION, ""), " "), lambda w: w != "")
    stop = F.array(*[F.lit(w) for w in stop_words])
    return F.when(F.size(words) > 0, F.size(F.filter(words, lambda w: F.array_contains(stop, w))) / F.size(words)).otherwise(0.0)


# Endings of English words and what becomes of them, the first that fits; a word keeps three letters at least.
ENDINGS = (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("ingly", ""), ("edly", ""), ("ing", ""), ("ed", ""), ("s", ""))


def stemmed(word: Column) -> Column:
    out = word
    for end, to in reversed(ENDINGS):
        out = F.when(word.endswith(end) & (F.length(word) - len(end) + len(to) >= 3), F.concat(F.substring(word, F.lit(1), F.length(word) - len(end)), F.lit(to))).otherwise(out)
    return out


def analysed_text(text: Column, stop_words: list[str], protected: tuple[str, ...] = (), stem: bool = True, synonyms: dict[str, list[str]] | None = None) -> Column:
    """Terms of a text as they are indexed: lower case, without possessive 's and stop words, stemmed but for protected
    words. With `synonyms`, as for queries, those of a term stand beside it."""
    words = F.transform(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+(?:'s)?"), F.lit(0)), lambda w: F.regexp_replace(w, "'s$", ""))
    kept = F.filter(words, lambda w: ~w.isin(stop_words))
    if synonyms:
        table = F.create_map(*[x for w, others in synonyms.items() for x in (F.lit(w), F.array(*map(F.lit, [w, *others])))])
        kept = F.flatten(F.transform(kept, lambda w: F.coalesce(F.try_element_at(table, w), F.array(w))))
    if stem:
        kept = F.transform(kept, lambda w: F.when(w.isin(*protected), w).otherwise(stemmed(w)) if protected else stemmed(w))
    return kept


def char_ngrams(text: Column, n: int) -> Column:
    """Sorted n-grams of characters; the last one is left out."""
    count = F.length(text) - n

    def grams(letters: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: F.array_join(F.slice(letters, i, F.lit(n)), ""))

    made = F.transform(F.array(F.split(text, "")), grams)[0]  # letters are split once, so that long texts take linear time
    return F.when(count > 0, F.array_sort(made)).otherwise(F.array().cast("array<string>"))


def common_count(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def average_word_length(words: Column) -> Column:
    return F.when(F.size(words) > 0, F.aggregate(words, F.lit(0), lambda s, w: s + F.length(w)) / F.size(words))


def default_and(phrase: Column) -> Column:
    """Spaces become AND, unless the phrase has AND or OR."""
    return F.when(phrase.contains(" AND ") | phrase.contains(" OR "), phrase).otherwise(F.replace(phrase, F.lit(" "), F.lit(" AND ")))


def generalized(phrase: Column) -> Column:
    return F.replace(default_and(phrase), F.lit(" AND "), F.lit(" OR "))


def parse_rules(rules: Column) -> Column:
    """`code,min,max,weight;...` as an array of structs; * is an open end (null), unknown codes have no column."""
    columns = F.create_map(*[x for c, name in FEATURES.items() for x in (F.lit(c), F.lit(name))])

    def one(r: Column) -> Column:
        p = F.split(r, ",")
        return F.struct(
            F.try_element_at(columns, F.get(p, F.lit(0))).alias("feature"), F.nullif(F.get(p, F.lit(1)), F.lit("*")).alias("low"), F.nullif(F.get(p, F.lit(2)), F.lit("*")).alias("high"),
            F.get(p, F.lit(3)).try_cast("double").alias("weight"),
        )

    return F.transform(F.filter(F.split(rules, ";"), lambda r: r != ""), one)


NUMBER = r"-?[0-9]+([.][0-9]+)?"
RULE = rf"[a-z]+,([*]|{NUMBER}|[0-9]{{2}}/[0-9]{{2}}/[0-9]{{4}}),([*]|{NUMBER}|[0-9]{{2}}/[0-9]{{2}}/[0-9]{{4}}),{NUMBER}"


def valid_rules(rules: Column) -> Column:
    return rules.rlike(f"^{RULE}(;{RULE})*;?$")


def quoted(term: str) -> str:
    """A pattern that matches a term as it is written."""
    return re.sub(r"([^\w ])", r"\\\1", term)


def highlight(text: Column, terms: list[str]) -> Column:
    """All matches of the terms that no word character borders, in any case, are put between **; of several at a place the
    longest. Terms are taken as they are written."""
    if not terms:
        return text
    pattern = "|".join(quoted(t) for t in sorted(set(terms), key=lambda t: (-len(t), t)))
    return F.regexp_replace(text, rf"(?i)(?<![\p{{L}}\p{{N}}_])({pattern})(?![\p{{L}}\p{{N}}_])", "**$1**")


def slugify(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), r"\s", "-")


def mostly_symbols(text: Column, least: int = 50, share: float = 0.65) -> Column:
    """Text under `least` characters of which `share` or more are neither letters nor underscores."""
    n = F.length(text)
    return (n < least) & (F.length(F.regexp_replace(text, r"[\p{L}_]", "")) >= share * n)


def strip_markup(text: Column) -> Column:
    """Markdown to plain text: code fences, images, links, headings, lists, quotes, emphasis."""
    for pattern, to in ((r"```[^`]*```", ""), (r"!\[([^\]]*)\]\([^)]*\)", "$1"), (r"\[([^\]]*)\]\([^)]*\)", "$1"), (r"(?m)^ {0,3}#{1,6} +", ""), (r"(?m)^ *(?:[-*+]|[0-9]+\.) +", ""), (r"(?m)^ *> ?", ""), (r"(\*\*|__|\*|`|~~)([^*_`~\n]+)\1", "$2"), (r"[ \t]+\n", "\n"), (r"\n{3,}", "\n\n")):
        text = F.regexp_replace(text, pattern, to)
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def parse_date(text: Column) -> Column:
    """A timestamp from the formats seen in posts, or null: ISO, `Oct 15, 2018`, `Sep 20th, 2019 6:35 am`."""
    plain = F.regexp_replace(F.trim(text), r"([0-9])(st|nd|rd|th)\b", "$1")
    upper = F.regexp_replace(F.regexp_replace(plain, r" am$", " AM"), r" pm$", " PM")

    def read(s: Column) -> Column:
        digit, letter, clock = s.rlike("^[-+0-9]"), s.rlike("^[A-Za-z]"), s.contains(":")
        # Each format with what any text that it reads must have, as a format that fails costs much more than a look.
        formats = {
            "yyyy-MM-dd'T'HH:mm:ss'Z'": digit & clock & s.contains("-"), "yyyy-MM-dd HH:mm:ss": digit & clock & s.contains("-"), "yyyy-MM-dd": digit & ~clock & s.contains("-"), "MMM d, yyyy h:mm a": letter & clock & s.contains(","), "MMM d, yyyy": letter & ~clock & s.contains(","),
            "MMMM d, yyyy": letter & ~clock & s.contains(","), "d MMM yyyy": digit & ~clock & s.contains(" "), "MM/dd/yyyy": digit & s.contains("/"),
        }
        return F.coalesce(*[F.when(may, F.try_to_timestamp(s, F.lit(f))) for f, may in formats.items()])

    return F.transform(F.array(upper), read)[0]  # bound by a function, as it stands in many places


def relative_date(text: Column, now: Column) -> Column:
    """`11 months ago` and the like, counted back from `now`."""
    n = F.regexp_extract(text, r"^([0-9]+) ", 1).try_cast("int")
    out = F.lit(None).cast("timestamp")
    for unit, months, days, seconds in (("year", 12, 0, 0), ("month", 1, 0, 0), ("week", 0, 7, 0), ("day", 0, 1, 0), ("hour", 0, 0, 3600), ("minute", 0, 0, 60)):
        back = F.make_interval(months=n * months, days=n * days, secs=(n * seconds).cast("double"))
        out = F.when(text.rlike(rf"^[0-9]+ {unit}s? ago$"), now - back).otherwise(out)
    return out


def trust_label(level: Column) -> Column:
    return F.when(level >= 1000, "base").when(level >= 50, "respected").when(level >= 0, "community").otherwise("spam")


def trust_threshold(label: Column) -> Column:
    return F.when(label == "base", 1000).when(label == "respected", 50).when(label == "community", 0).when(label == "spam", -100000)

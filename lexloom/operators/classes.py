"""Word classes by a hidden Markov model: the best path of each sentence, found by Viterbi's algorithm in Arrow batches.

A grammar has, in whole numbers (about 1000 times a logarithm, so that sums are exact and ties are ties): what each class
costs a word that the lexicon has, a word with one of the endings (the longest counts), a capitalised word that is not the
first of its sentence, and any other word; and what each class costs after each. All of a text is worked on
where it lies; nothing is shuffled. (As a fold in column expressions it took ten times as long.)

Edge cases: texts without words, null ones too, give no row; of equal paths the one through the earlier class wins.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .periods import sentences_of, spread

CLASSES = ("ADJ", "NOUN", "PROPN", "VERB", "X")
SHARES = {"ADJ": "adjectives_proportion_f", "NOUN": "nouns_proportion_f", "PROPN": "proper_nouns_proportion_f", "VERB": "verbs_proportion_f"}
TOKENS, CAPITAL = regex.compile(r"[\p{L}\p{N}_]+"), regex.compile(r"\p{Lu}\p{Ll}")
# Function words of English (X), auxiliaries (VERB) and a few adjectives; a grammar may have any others.
WORDS = {
    "X": "the a an this that these those my your his her its our their i you he she it we they me him us them who whom which what and or but nor so yet if because although while of in on at by for with from to into over under between through during before after above below up down out off again not no very too also just only than then there here when where why how all any both each every as about against without within upon per until since",
    "VERB": "is are was were be been being am have has had do does did will would shall should can could may might must say says said go goes went get gets got make makes made know knows knew see sees saw come comes came take takes took give gives gave think thinks thought",
    "ADJ": "good bad new old big small great long little own other high low large young early late few more most many much some such same first last next",
}
ENDINGS = {"NOUN": "ness ment tion sion ity ism ist ship hood ance ence er or age s", "ADJ": "ous ful less able ible ive ish ic al ary est", "VERB": "ing ed ize ise ify ate", "X": "ly"}


def _costs(own: str, mine: int, other: int) -> tuple[int, ...]:
    return tuple(mine if c == own else other for c in CLASSES)


@dataclass(frozen=True)
class Grammar:
    words: dict[str, tuple[int, ...]] = field(default_factory=lambda: {w: _costs(c, 0, -6000) for c, ws in WORDS.items() for w in ws.split()})
    endings: dict[str, tuple[int, ...]] = field(default_factory=lambda: {e: _costs(c, -300, -2500) for c, es in ENDINGS.items() for e in es.split()})
    capital: tuple[int, ...] = _costs("PROPN", -200, -3000)
    other: tuple[int, ...] = (-1700, -800, -5000, -1500, -2500)
    # From the class of the row to that of the column; `first` is the class that stands before a sentence.
    after: tuple[tuple[int, ...], ...] = ((-2000, -300, -2500, -2800, -1800), (-2800, -1600, -2500, -1000, -700), (-3000, -1700, -900, -900, -900), (-1500, -1500, -1800, -1600, -500), (-1200, -700, -1500, -1500, -1300))
    first: str = "X"

    def costs(self, word: str, begins: bool) -> tuple[int, ...]:
        low = word.lower()
        found = self.words.get(low)
        if found is not None:
            return found
        if not begins and CAPITAL.match(word):
            return self.capital
        ends = [low[i:] for i in range(1, len(low)) if low[i:] in self.endings]
        return self.endings[ends[0]] if ends else self.other


def best_path(words: list[str], grammar: Grammar) -> list[int]:
    """The classes (places in CLASSES) of the words of a sentence, by Viterbi's algorithm."""
    k = range(len(CLASSES))
    scores = [0 if c == grammar.first else -(10**12) for c in CLASSES]
    back: list[list[int]] = []
    into = list(zip(*grammar.after, strict=True))  # by the class that comes
    for i, word in enumerate(words):
        costs, ways, now = grammar.costs(word, i == 0), [], []
        for j in k:
            reach = [s + t for s, t in zip(scores, into[j], strict=True)]
            top = max(reach)
            ways.append(reach.index(top))
            now.append(top + costs[j])
        back.append(ways)
        scores = now
    at = scores.index(max(scores))
    path = [at]
    for ways in reversed(back[1:]):
        at = ways[at]
        path.append(at)
    return path[::-1]


def word_class_proportions(rows: DataFrame, key: str, grammar: Grammar | None = None) -> DataFrame:
    """key and the shares of adjectives, nouns, proper nouns and verbs among the words of `text`."""
    grammar = grammar or Grammar()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, shares = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                counts, total = [0] * len(CLASSES), 0
                for sentence in sentences_of(text or ""):
                    words = TOKENS.findall(sentence)
                    for c in best_path(words, grammar) if words else ():
                        counts[c] += 1
                    total += len(words)
                if total:
                    row.append(i)
                    shares.append([n / total for n in counts])
            columns = [pa.array([s[CLASSES.index(c)] for s in shares], pa.float64()) for c in SHARES]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), *columns], names=[key, *SHARES.values()])

    kind = rows.schema[key].dataType.simpleString()
    found = spread(rows.select(key, "text")).mapInArrow(count, f"`{key}` {kind}, {', '.join(f'{c} double' for c in SHARES.values())}")
    return found.select(key, *[F.round(c, 6).alias(c) for c in SHARES.values()])

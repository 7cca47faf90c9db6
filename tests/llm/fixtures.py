"""Small documents with every awkward case, and plain versions of what the operators compute."""

import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, key string, node long, row string, tokens long, label string"
WHITE = re.compile("[\x20\x09-\x0d]+")


def prose(rng, n, words=400):
    return " ".join(f"w{min(rng.randrange(words), rng.randrange(words))}" for _ in range(n))


def awkward(seed=0):
    rng = random.Random(seed)
    passage = prose(rng, 60, 5000)
    base = prose(rng, 120)
    texts = [None, "", "   \n\t ", "one", "one two", "One  TWO", base, base, base.upper(), base + " tail", base.replace("w1", "x", 1), prose(rng, 20000)]
    texts += [prose(rng, 40) + " " + passage + " " + prose(rng, 30), passage, prose(rng, 5) + "\n" + passage + "\n" + prose(rng, 80), " x   y é́ ñ 中文 𝔘 w1", "a\x1cb c\x85d e\x0bf", "spam spam spam spam spam " * 30]
    for _ in range(20):
        words = base.split()
        for _ in range(rng.randrange(12)):
            words[rng.randrange(len(words))] = f"z{rng.randrange(99)}"
        texts.append(" ".join(words))
    rows = [(i * 7 % 101, t, rng.choice(["en", "de", None]), rng.choice(["s1", "s1", "s2", None]), len(t or ""), 0.5, "k", 3, "r", 9, "x") for i, t in enumerate(texts)]
    return rows + [(None, "no id here " * 9, "en", "s1", 1, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None, None), rows[6]]


def words_of(text, lower=True):
    text = text or ""
    return [w for w in WHITE.split(re.sub("[A-Z]", lambda m: m[0].lower(), text) if lower else text) if w]


def letter_words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.select(*columns).collect()), key=repr)

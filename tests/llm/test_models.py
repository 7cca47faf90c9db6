import gc
import math
import random
import weakref
import zlib

import numpy as np
import pyarrow as pa
import pytest

from lexloom.llm import common, perplexity, quality

from .fixtures import SCHEMA, WHITE, awkward, rows_of, words_of


def brute_base(rows):
    out = []
    for doc, text in rows:
        text = text or ""
        w = words_of(text, lower=False)
        windows = {}
        for i in range(len(w) - 4):
            windows.setdefault(tuple(w[i : i + 5]), []).append(i)
        repeated = {j for at in windows.values() if len(at) > 1 for i in at for j in range(i, i + 5)}
        seen, dup = set(), 0
        for line in text.split("\n"):
            if [x for x in WHITE.split(line) if x]:
                dup += line in seen
                seen.add(line)
        failed = len(w) < 10 or 100 * len(repeated) > 20 * len(w)
        out.append((doc, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(repeated), failed))
    return sorted(out, key=repr)


BASE = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def test_base_rules_equal_brute_force(spark, sf):
    rows = awkward() + [(3000, "a b c\na b c\n \n \n a b c\na b c#*$", "en", *awkward()[0][3:])]
    found = perplexity.quality_rules(spark.createDataFrame(rows, SCHEMA))
    assert rows_of(found, *BASE) == brute_base([(r[0], r[1]) for r in rows])
    assert found.filter("kept and base_failed").count() == 0
    assert found.filter("not base_failed and kept != (perplexity between band_low and band_high)").count() == 0
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert rows_of(perplexity.op3_perplexity(spark, sf), *BASE) == brute_base(docs)
    assert perplexity.quality_rules(spark.createDataFrame([], SCHEMA)).count() == 0


def places(text, order):
    """The longest n-gram of each unit of a text: at most `order` units, and not beyond the begin of the word before."""
    out, bound, mark = [], 0, 0
    units = " " + "".join(w + " " for w in words_of(text, lower=False))
    for i in range(1, len(units)):
        if i > 1 and units[i - 1] == " ":
            bound, mark = mark, i - 1
        out.append(units[max(bound, i - order + 1) : i + 1])
    return out


def plain_kneser_ney(texts, order):
    """Probabilities by dictionaries, straight from the definition."""
    raw, left = [{} for _ in range(order + 1)], [{} for _ in range(order + 1)]
    for text in texts:
        for g in places(text, order):
            for k in range(1, len(g) + 1):
                raw[k][g[-k:]] = raw[k].get(g[-k:], 0) + 1
                if k < len(g):
                    left[k].setdefault(g[-k:], set()).add(g[-k - 1])
    adjusted = [{g: len(left[k][g]) if g in left[k] else n for g, n in raw[k].items()} for k in range(order + 1)]
    discounts, after = [None] * (order + 1), [{} for _ in range(order + 1)]
    for k in range(1, order + 1):
        n = [max(1, sum(1 for v in adjusted[k].values() if v == i)) for i in range(1, 5)]
        y = n[0] / (n[0] + 2 * n[1])
        discounts[k] = [0.0] + [min(max(i - (i + 1) * y * n[i] / n[i - 1], 0), top) for i, top in ((1, 0.95), (2, 1.9), (3, 2.8))]
        for g, v in adjusted[k].items():
            after[k].setdefault(g[:-1], []).append(v)

    def p(g):
        if not g:
            return 1 / (len(adjusted[1]) + 1)
        k = len(g)
        same = after[k].get(g[:-1])
        if not same:
            return p(g[1:])
        cut, own = discounts[k], adjusted[k].get(g, 0)
        return (own - cut[min(own, 3)]) / sum(same) + sum(cut[min(v, 3)] for v in same) / sum(same) * p(g[1:])

    return p


def scored_by(scorer, text):
    found = scorer.score([text.encode().split()])
    return float(found["log"][0]), int(found["units"][0])


@pytest.mark.parametrize("order", [3, 5])
def test_model_equals_plain_kneser_ney(spark, order):
    text = "the cat sat on the mat and then that hat sat there on that cat a b  c " * 2 + "the rat ate oats at ten"
    rows = [(1, text[:60], "en"), (2, text[60:], "en"), (3, "ein hut", "de"), (4, "é\x00 中文 \U0001d518 x", "en"), (5, None, "en"), (6, " ", "en"), (7, "nul is no language", None)]
    folder = perplexity.build_model(spark.createDataFrame(rows, "doc_id long, text string, lang string"), order)
    for lang in ("en", "de", None):
        p = plain_kneser_ney([(t or "").replace("\x00", "\ufffd") for _, t, x in rows if x == lang], order)
        scorer = perplexity.Scorer(perplexity.Model(folder, lang, order))
        for probe in (text, text[:60], "zebra cat", "the", "tac eht", "ein hut", "nul is", "cat the on sat", "é 中 x"):
            expected = [np.log(max(1e-12, p(g))) for g in places(probe, order)]
            got, n = scored_by(scorer, probe)
            assert n == len(expected) and abs(got - sum(expected)) < 1e-8
    assert np.isnan(scored_by(perplexity.Scorer(perplexity.Model(folder, "fr", order)), "x")[0])


def test_perplexity_bands_and_kept_equal_brute_force(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang").collect()]
    found = {r["doc_id"]: r for r in perplexity.op3_perplexity(spark, sf).collect()}
    assert len(found) == len(docs)
    for lang in {x for _, _, x in docs}:
        own = [(i, t) for i, t, x in docs if x == lang]
        p, cache = plain_kneser_ney([t or "" for _, t in own], 5), {}
        value = {}
        for i, t in own:
            at = places(t or "", 5)
            for g in set(at) - cache.keys():
                cache[g] = np.log(max(1e-12, p(g)))
            value[i] = float(np.exp(-sum(cache[g] for g in at) / len(at))) if at else None
            assert value[i] is None and found[i]["perplexity"] is None or abs(found[i]["perplexity"] / value[i] - 1) < 1e-9
        passed = sorted(math.floor(math.log(value[i]) / perplexity.STEP) for i, _ in own if not found[i]["base_failed"])
        if not passed:
            continue
        middle = lambda x: sorted(x)[(len(x) + 1) // 2 - 1]
        spread = 1.4826 * middle([abs(b - middle(passed)) for b in passed])
        low, high = math.exp((middle(passed) - 3 * spread) * perplexity.STEP), math.exp((middle(passed) + 1 + 3 * spread) * perplexity.STEP)
        for i, _ in own:
            assert found[i]["kept"] == (not found[i]["base_failed"] and low <= value[i] <= high)


def test_counting_lets_go_of_models_of_an_earlier_run():
    empty = perplexity.Model.__new__(perplexity.Model)
    empty.order, empty.levels = 5, {i: (np.zeros(0, np.int64), np.zeros(0)) for i in range(12)}
    scorer = perplexity.Scorer(empty)
    common.held("perplexity of an earlier run", dict)["=en"] = scorer
    gone = weakref.ref(scorer)
    gc.collect()
    gc.disable()
    try:
        del scorer
        batch = pa.record_batch([pa.array(["=en"]), pa.array(["a few words"])], names=["lang", "text"])
        assert sum(b.num_rows for b in perplexity._count(5)(iter([batch]))) > 0
        assert gone() is None
    finally:
        gc.enable()
        common.let_go()


def test_texts_come_in_small_batches(spark, monkeypatch):
    def checked(make):
        def made(*args):
            work = make(*args)

            def run(batches):
                def small():
                    for b in batches:
                        if b.num_rows > 1000:
                            raise ValueError("a large batch")
                        yield b

                return work(small())

            return run

        return made

    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    for name in ("_count", "_scorer"):
        monkeypatch.setattr(perplexity, name, checked(getattr(perplexity, name)))
    docs = spark.range(2500).selectExpr("id as doc_id", "'en' as lang", "concat('one of many short texts: ', id) as text").coalesce(1)
    assert perplexity.quality_rules(docs).count() == 2500
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


def test_shuffled_words_score_worse(spark):
    rng = random.Random(5)
    rows = [(i, " ".join("red fox ran far and saw ten old men sit".split()[(i + k) % 10] for k in range(60)), "en") for i in range(30)]
    folder = perplexity.build_model(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    scorer = perplexity.Scorer(perplexity.Model(folder, "en", 5))
    words = rows[0][1].split()
    rng.shuffle(words)
    assert scored_by(scorer, " ".join(words))[0] < 2 * scored_by(scorer, rows[0][1])[0]


def test_junk_does_not_move_the_band(spark):
    rng = random.Random(3)
    parts = ["ba", "lo", "ren", "ti", "sum", "ka", "del", "vo"]
    clean = [" ".join("".join(rng.choices(parts, k=rng.randint(1, 3))) for _ in range(120)) for _ in range(150)]
    junk = [" ".join("".join(rng.choices("bcdfghjklmnpqrstvwxz#$%&", k=rng.randint(3, 9))) for _ in range(120)) for _ in range(60)]
    for n in (10, 60):
        rows = [(i, t, "en") for i, t in enumerate(clean + junk[:n])]
        kept = {r["doc_id"] for r in perplexity.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string")).filter("kept").collect()}
        assert not [i for i in kept if i >= len(clean)] and len(kept) >= 0.9 * len(clean)


def test_band_rejects_labelled_junk(spark):
    sf = "/root/testdata/sf0.01"
    found = perplexity.op3_perplexity(spark, sf).filter("not base_failed and lang = 'en'").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").select("kept", "quality").collect()
    good, bad = (np.mean([r["kept"] for r in found if r["quality"] == q]) for q in (1, 0))
    assert good > 0.9 and bad < 0.7


def test_band_of_equal_documents_keeps_them(spark):
    rows = [(i, "all of these ten words are the same in each", "en") for i in range(20)] + [(20, "xq zkj vvw qpx jjz wqx kzz pqj xxv zwq", "en")]
    found = perplexity.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert {r["doc_id"] for r in found.filter("kept").collect()} == set(range(20))


def test_quality_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    found = quality.op2_quality(spark, sf)
    held = found.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").select("score", "quality", "predicted").collect()
    good, bad = ([r["score"] for r in held if r["quality"] == q] for q in (1, 0))
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in good for b in bad])
    assert auc > 0.97 and np.mean([r["quality"] == r["predicted"] for r in held]) > 0.93
    for r in found.collect():
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and r["predicted"] == (r["score"] >= 0.5)


def test_quality_ignores_held_out_labels_and_awkward_rows(spark):
    rows = awkward()
    docs = spark.createDataFrame(rows, SCHEMA)
    ids = [r[0] for r in rows if r[0] is not None]
    labels = [(i, k % 2, 0) for k, i in enumerate(ids)] + [(None, 1, 0), (5, None, 0)]
    flipped = [(i, 1 - q if q is not None and i is not None and zlib.crc32(str(i).encode()) % 3 == 1 else q, t) for i, q, t in labels]
    schema = "doc_id long, quality int, toxic int"
    a, b = (rows_of(quality.quality_scores(docs, spark.createDataFrame(x, schema)), "doc_id", "score", "predicted", "held_out") for x in (labels, flipped))
    assert a == b and len(a) == len(rows) and all(0 <= x[1] <= 1 for x in a)
    none = quality.quality_scores(docs, spark.createDataFrame([], schema))
    assert {r["score"] for r in none.collect()} == {0.5}
    kept = quality.keep_quality(docs, spark.createDataFrame(labels, schema))
    assert kept.schema == docs.schema and kept.count() == sum(x[2] for x in a)
    assert quality.quality_scores(docs.limit(0), spark.createDataFrame(labels, schema)).count() == 0

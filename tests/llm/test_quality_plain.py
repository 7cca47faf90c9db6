"""The classifier against a plain version of it: n-grams one by one, and FTRL-proximal over dictionaries."""

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from lexloom.llm import quality

from .fixtures import awkward, prose

WORD = (1 << 64) - 1


def mix(x):
    x ^= x >> 33
    x = x * 0xFF51AFD7ED558CCD & WORD
    x ^= x >> 33
    x = x * 0xC4CEB9FE1A85EC53 & WORD
    return x ^ x >> 33


def plain_slots(text, bits):
    described = [{k: int(v[0]) for k, v in quality._describe([w]).items()} for w in (text or "").encode().split()]
    out = []
    for i, d in enumerate(described):
        back = next((b for b in (1, 2, 3, 4) if i >= b and described[i - b]["word"] == d["word"]), 0)
        kinds = [d["word"], d["form"], back + 0x7265]
        for c in ("word", "form"):
            kinds.append((described[i - 1][c] * 0x9E3779B97F4A7C15 + d[c]) & WORD if i else 0x6269)
        out += [mix((x + (k + 1) * 0xD1B54A32D192ED03) & WORD) >> (64 - bits) for k, x in enumerate(kinds)]
    return out


def plain_features(text, bits):
    slots = plain_slots(text, bits)
    return {s: float(np.float32(quality.SCALE * n / max(1, len(slots)))) for s, n in Counter(slots).items()} | {1 << bits: 1.0}


def plain_ftrl(rows, bits, epochs, alpha, beta, l1, l2):
    z, n = Counter(), Counter()

    def weight(i):
        return 0.0 if abs(z[i]) <= l1 else -(z[i] - math.copysign(l1, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)

    for _ in range(epochs):
        for _, text, y in sorted(rows, key=lambda r: xxhash.xxh3_64_intdigest(str(r[0]))):
            x = plain_features(text, bits)
            w = {i: weight(i) for i in x}
            p = 1 / (1 + math.exp(-max(-35.0, min(35.0, sum(w[i] * v for i, v in x.items())))))
            for i, v in x.items():
                g = (p - y) * v
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha * w[i]
                n[i] += g * g
    return {i: w for i in z if (w := weight(i))}


def documents():
    rng = random.Random(8)
    rows = [(i, prose(rng, rng.randrange(1, 80), 60), 1) for i in range(14)] + [(100 + i, " ".join(f"w{rng.randrange(40)}{rng.choice(['###', '!!', ''])} again again" for _ in range(rng.randrange(1, 60))), 0) for i in range(14)]
    return rows + [(i + 1000, t, i % 2) for i, (_, t, *_) in enumerate(awkward()[:12]) if t is None or len(t) < 5000]


@pytest.mark.parametrize("bits", [8, 18])
def test_slots_equal_a_plain_version(bits):
    texts = [t for _, t, _ in documents()]
    slots, starts = quality.gram_slots([t.encode() if t is not None else None for t in texts], bits)
    for t, a, b in zip(texts, starts[:-1], starts[1:], strict=True):
        assert slots[a:b].tolist() == plain_slots(t, bits)


@pytest.mark.parametrize("bits", [8, 16])
def test_weights_and_scores_equal_a_plain_ftrl(bits):
    rows, settings = documents(), {"epochs": 3, "alpha": 0.1, "beta": 1.0, "l1": 0.05, "l2": 0.1}
    batch = pa.RecordBatch.from_pydict({"doc_id": [r[0] for r in rows], "text": [r[1] for r in rows], "quality": [r[2] for r in rows]})
    got = next(quality._trainer(bits, **settings)(iter([batch])))
    weights = dict(zip(got.column(0).to_pylist(), got.column(1).to_pylist(), strict=True))
    expected = plain_ftrl(rows, bits, **settings)
    assert len(expected) > 50 and set(weights) == set(expected)
    assert all(math.isclose(weights[i], expected[i], rel_tol=1e-6, abs_tol=1e-9) for i in expected)
    dense = np.zeros((1 << bits) + 1)
    dense[list(weights)] = list(weights.values())
    for (_, text, _), score in zip(rows, quality.scores([r[1].encode() if r[1] is not None else None for r in rows], dense, bits), strict=True):
        slots = plain_slots(text, bits)
        dot = sum(weights.get(s, 0.0) for s in slots) / max(1, len(slots)) * quality.SCALE + weights.get(1 << bits, 0.0)
        assert math.isclose(score, 1 / (1 + math.exp(-dot)), rel_tol=1e-9)

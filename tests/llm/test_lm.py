"""Deleted interpolation recomputed token by token, and its distribution."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from touchline.llm import interpolation as I


def test_scores_follow_from_the_counts_and_add_up_to_one(spark, monkeypatch):
    rng = np.random.default_rng(4)
    vocabulary = [f"w{i}" for i in range(25)]
    rows = [(i, " ".join(rng.choice(vocabulary, rng.integers(0, 12), p=np.arange(25, 0, -1) / 325))) for i in range(160)]
    rows += [(1000 + i, f"w1 w2 unknown{i} w3") for i in range(20)] + [(2000, None), (None, "w1 w2")]
    learned = {}
    learn = I._learn
    monkeypatch.setattr(I, "_learn", lambda looked: learned.setdefault("weights", learn(looked)))
    got = sorted(((-1 if r.doc_id is None else r.doc_id), r.score) for r in I.score(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    weights = learned["weights"]
    texts = [(i, ["<", *(t or "").split(), ">"]) for i, t in rows]
    train = [t for i, t in texts if zlib.crc32(b"" if i is None else str(i).encode()) % 10]
    single = Counter(w for t in train for w in t[1:])
    double = Counter(p for t in train for p in zip(t[:-1], t[1:], strict=True))
    context = Counter(h for t in train for h in t[:-1])
    total, distinct = sum(single.values()), len(single)

    def bucket(n):
        return n.bit_length()

    def p(h, w):
        mix = weights[bucket(context[h])]
        return mix[0] * double[h, w] / max(context[h], 1) + mix[1] * single[w] / total + mix[2] / (distinct + 1)

    want = sorted(((-1 if i is None else i), sum(math.log10(p(h, w)) for h, w in zip(t[:-1], t[1:], strict=True))) for i, t in texts)
    assert [i for i, _ in got] == [i for i, _ in want]
    assert [s for _, s in got] == pytest.approx([s for _, s in want], abs=1e-9)
    for h in [*context, "never seen"]:
        assert sum(p(h, w) for w in single) + p(h, "unknown") == pytest.approx(1)

    cells = Counter()
    step = lambda q: 0 if q <= 0 else min(max(math.floor(math.log2(q * (distinct + 1)) * 4) + 32, 1), 255)
    for t in train:
        own, own_2 = Counter(t[1:]), Counter(zip(t[:-1], t[1:], strict=True))
        for h, w in zip(t[:-1], t[1:], strict=True):
            n_h = context[h] - (1 if h == "<" else own[h])
            two = (double[h, w] - own_2[h, w]) / n_h if n_h else 0
            cells[bucket(n_h), step(two), step((single[w] - own[w]) / (total - len(t) + 1))] += 1
    b, two, one = (np.array(x) for x in zip(*cells, strict=True))
    assert weights == pytest.approx(I.expectation_maximisation(b, two, one, np.array(list(cells.values()))), abs=1e-6)

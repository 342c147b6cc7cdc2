"""Corpus totals beyond 32 bits."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from touchline.llm import blocks, interpolation

MANY = 2**33


def test_counts_of_either_width_come_back():
    for x in ([], [0, 1, 2**32 - 1], [0, 2**32, 2**40 + 7]):
        assert blocks.unpack_counts(blocks.pack_counts(np.array(x, dtype=np.int64))).tolist() == x


def test_lm_scoring_counts_beyond_32_bits(spark, monkeypatch):
    """Each training token stands for MANY; with given weights both scores follow from the counts."""
    counted = interpolation._counted

    def many(keys, train):
        distinct, n = counted(keys, train)
        return distinct, n * MANY

    monkeypatch.setattr(interpolation, "_counted", many)
    monkeypatch.setattr(interpolation, "_learn", lambda looked: np.tile([0.5, 0.3, 0.2], (48, 1)))
    rows = [(i, "a b a c" if i % 2 else "b a b") for i in range(40)]
    got = {r.doc_id: r for r in interpolation.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    train = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 10]
    texts = {i: [*t.split(), None] for i, t in rows}
    single = Counter(w for i in train for w in texts[i])
    double = Counter((h, w) for i in train for h, w in zip(["<", *texts[i]], texts[i], strict=False))
    total, distinct = sum(single.values()) * MANY, len(single)
    for i, tokens in texts.items():
        base = sum(math.log10((single[w] * MANY + 0.1) / (total + 0.1 * (distinct + 1))) for w in tokens)
        assert got[i].train_tokens == total and got[i].base_score == pytest.approx(base)
        context = [len(train), *(single[w] * MANY for w in tokens[:-1])]  # the first context is counted apart
        p = [0.5 * double[h, w] * MANY / c + 0.3 * single[w] * MANY / total + 0.2 / (distinct + 1) for h, w, c in zip(["<", *tokens], tokens, context, strict=False)]
        assert got[i].score == pytest.approx(sum(map(math.log10, p)))

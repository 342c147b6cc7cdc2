"""The Kneser-Ney models against the formulas, computed gram by gram, and the features of awkward texts."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest

from touchline.llm import toxicity as T

TEXTS = [
    ("the idiot and the idioten", 1), ("an idiotisch thing", 1), ("moron, moron! idiot?", 1), ("clean words are here", 0), ("the thing and the other", 0),
    ("other words and things are clean", 0), ("idle hands here", 0), ("", 0), ("12 !", 1), ("ß éé 日本 x", 0), ("idiot moron 日本", 1), ("there and there", 0),
]


def formula(counted: dict[str, tuple[int, int]], pooled: dict[str, int], context: str, letter: str) -> float:
    """log P(letter | context, toxic) - log P(letter | context, ordinary), from the counts by class and the pooled ones."""
    before = defaultdict(set)  # shorter gram: letters seen before it
    for gram in pooled:
        for k in range(1, len(gram)):
            before[gram[k:]].add(gram[k - 1])
    letters = len({g[-1] for g in pooled}) + 1

    def shared(h: str) -> float:
        rest = shared(h[1:]) if h else 1 / letters
        own = {g: len(s) for g, s in before.items() if g[:-1] == h}
        total = sum(own.values())
        return max(own.get(h + letter, 0) - 0.75, 0) / total + 0.75 * len(own) / total * rest if total else rest

    if not any(g[:-1] == context for g in pooled):
        return 0.0
    follow = {g: n for g, n in pooled.items() if g[:-1] == context}
    total = sum(follow.values())
    low = max(follow.get(context + letter, 0) - 0.75, 0) / total + sum(min(n, 0.75) for n in follow.values()) / total * shared(context[1:])
    p = []
    for k in (0, 1):
        own = {g: counted.get(g, (0, 0))[k] for g in follow}
        n = sum(own.values())
        p.append(max(own.get(context + letter, 0) - 2, 0) / n + sum(min(x, 2) for x in own.values()) / n * low if n else low)
    return math.log(p[1] / p[0])


def test_models_follow_the_formulas(spark):
    rows = [(t, y, i % T.FOLDS) for i, (t, y) in enumerate(TEXTS)] * 3
    sample = spark.createDataFrame(rows, "text string, label int, fold int").repartition(3)
    found = T.counts(sample).cache()
    models = T._collected(T.ratios(found))
    pooled = Counter()
    by_fold = defaultdict(Counter)
    for text, label, fold in rows:
        for part in T.words(text):
            for word in part:
                for gram in T.grams(word):
                    pooled[gram] += 1
                    by_fold[fold][gram, label] += 1
    assert {r.gram: sum(r[f"{k}{f}"] for k in "ot" for f in range(T.FOLDS)) for r in found.collect()} == pooled
    for name, left_out in (("r", None), ("r0", 0), ("r3", 3)):
        counted = {g: tuple(sum(c[g, y] for f, c in by_fold.items() if f != left_out) for y in (0, 1)) for g in pooled}
        evidence = T.Evidence(models[name])
        for word in ("idiot", "idioten", "moron", "there", "日本", "unseen", "x", "idl"):
            bounded = f"^{word}$"
            want = 0.0
            for i in range(1, len(bounded)):
                context = bounded[max(0, i - T.ORDER + 1) : i]
                want += formula(counted, pooled, context, bounded[i])
            assert evidence.words([word])[0] == pytest.approx(want, abs=1e-5), (name, word)


def test_shared_estimates_are_distributions(spark):
    """Over all letters and the unknown one, the last letter's shared probability adds up to 1 after any context."""
    found = T.counts(spark.createDataFrame([(t, y, 0) for t, y in TEXTS], "text string, label int, fold int"))
    low = {r.gram: r.low for r in T.shared(found).collect()}
    assert all(0 < p < 1 for p in low.values())
    by = defaultdict(dict)
    for gram, p in low.items():
        by[gram[1:-1]][gram[-1]] = p
    letters = len({g[-1] for g in low}) + 1
    # The empty context sees every letter: what is left over is the unknown letter's.
    first = by[""]
    shorter = {s for g in low for s in (g[k:] for k in range(1, len(g)))}
    assert set(first) <= {s for s in shorter if len(s) == 1}
    seen = Counter(s[1:] for s in {g[k:] for g in low for k in range(len(g)) if len(g) - k > 1} if len(s) == 2)
    rest = 0.75 * len(seen) / sum(seen.values())
    for letter, p in first.items():
        assert p == pytest.approx(max(seen[letter] - 0.75, 0) / sum(seen.values()) + rest / letters)


def test_features():
    none = T.Model(np.empty(0, np.uint64), np.empty(0, np.float32), np.empty(0, np.uint64), np.empty(0, np.float32))
    x = T.Evidence(none).texts(["", "1 2", "one two", "a" * 10])
    assert x[:, :3].tolist() == [[0.0] * 3] * 4 and x[:, 3].tolist() == [0.0, 0.0, math.log(2), 0.0]
    long = "ab cd " * (T.CHUNK // 3)
    assert sum(len(p) for p in T.words(long)) == 2 * (T.CHUNK // 3) and set(w for p in T.words(long) for w in p) == {"ab", "cd"}
    assert [p for p in T.words("x" * (T.CHUNK + 9) + " y")] == [["x" * (T.CHUNK + 9)], ["y"]]
    grams = sorted(set(T.grams("abc") + T.grams("zebra")))
    keys = T.key_of(grams)
    order = np.argsort(keys)
    model = T.Model(keys[order], np.arange(1, len(grams) + 1, dtype=np.float32)[order], none.contexts, none.by_context)
    evidence = T.Evidence(model)
    value = {g: i + 1 for i, g in enumerate(grams)}
    assert evidence.words(["abc", "zebra", "q"]).tolist() == [sum(value[g] for g in T.grams("abc")), sum(value[g] for g in T.grams("zebra")), 0.0]
    mean, one, three, n = evidence.texts(["abc zebra abc q"])[0]
    a, z = (float(sum(value[g] for g in T.grams(w))) for w in ("abc", "zebra"))
    assert (mean, one, three, n) == ((2 * a + z) / 4, max(a, z), 2 * a + z, math.log(4))


def test_bounds_of_the_sample(spark, monkeypatch):
    monkeypatch.setattr(T, "MOST_BYTES", 100)
    rows = [(i, "w" * 60, i % 2, 0, 60) for i in range(10)]
    kept = T._bounded(spark.createDataFrame(rows, "doc_id long, text string, label int, fold int, size long")).collect()
    assert Counter(r.label for r in kept) == {0: 1, 1: 1}


def test_awkward_rows(spark):
    rows = [(i, "some calm words here" if i % 3 else "some vexuna words vexulip", i) for i in range(90)] + [(None, "vexuna vexulip", 1), (200, None, 1), (201, "", 1), (202, "calm " * 300_000, 1)]
    docs = spark.createDataFrame([*rows, rows[4], rows[4]], "doc_id long, text string, score long")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(60)] + [(None, 1), (3, None), (5, 7)], "doc_id long, toxic int")
    got = T.classify(docs, labels).collect()
    assert len(got) == len(rows) + 2
    by_id = defaultdict(set)
    for r in got:
        by_id[r.doc_id].add((r.score, r.predicted))
    assert all(len(x) == 1 for x in by_id.values())
    assert by_id[200] == by_id[201] and by_id[None] != by_id[201]
    assert all(p == int(i % 3 == 0) for i in range(90) for _, p in by_id[i]) and {p for _, p in by_id[202]} == {0}

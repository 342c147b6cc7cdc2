"""The corpus operators against brute force, exact round trips and edge cases on small fixtures."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from touchline.llm import blocks, fingerprints, interpolation, jaccard, mixing, packing, pivots, quality, sharding, token_counts, toxicity
from touchline.llm.components import components
from touchline.llm.words import hash_words, shingles, unique

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, rank int, block int"
PIECES = public_tokenizers.path("piece_bpe_32k.model")
BPE = public_tokenizers.path("byte_bpe_50k.json")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def corpus():
    rng = np.random.default_rng(3)
    vocabulary = [f"{a}{b}" for a in ("ka", "lo", "mi", "ter", "Zu", "é") for b in ("na", "st", "ry", "vel", "ö", "x")]
    texts = [" ".join(rng.choice(vocabulary, rng.integers(1, 60))) for _ in range(60)]
    texts += [texts[0]] * 9  # copies
    for k in range(12):  # near copies
        w = texts[5].split() * 4
        w[3 * k % len(w)] = f"new{k}"
        texts.append(" ".join(w))
    common = " ".join(vocabulary)
    texts += [f"{common}\n{t}" for t in texts[10:30]]  # a passage that many share
    texts += ["", " \n\t", "one", "one two", "ONE two", "a b c", "a\x0bb\x1fc", "日本語 テキスト", "x " * 20_000, None, None]
    return texts


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i * 7 % 1009, t, "en", f"s{0 if i % 3 else i % 5}" if i % 11 else None, len(t or ""), 0.5, 1, 2) for i, t in enumerate(corpus())]
    rows.append(rows[-3])  # a repeated row
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_words_and_hashes():
    texts = [t.encode() for t in corpus() if t is not None]
    found, counts = hash_words(texts)
    flat = [w for t in texts for w in words(t.decode())]
    assert counts.tolist() == [len(words(t.decode())) for t in texts]
    seen = {}
    for w, h in zip(flat, found.tolist(), strict=True):
        assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)
    assert len(shingles(found[:2], 3)) == 1 and not len(shingles(found[:0], 3))
    x = np.array([5, 1, 5, 2**63], dtype=np.uint64)
    assert blocks.unpack_sorted(blocks.pack_sorted(unique(x))).tolist() == [1, 5, 2**63]


def test_components(spark):
    links = [(1, 2), (2, 3), (3, 4), (4, 5), (9, 8), (7, 7), (20, 21), (22, 21), (5, 6)]
    got = {r[0]: r[1] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: 1, 8: 8, 9: 8, 20: 20, 21: 20, 22: 20}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_jaccard(docs, empty):
    for width, percent in ((3, 90), (5, 80), (1, 50)):
        rows = [(r[0], r[1]) for r in docs.select("doc_id", "text").collect()]
        sets = []
        for _, t in rows:
            w = words(t)
            sets.append({tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
        parent = {i: i for i, _ in rows}

        def find(x, parent=parent):
            while parent[x] != x:
                x = parent[x]
            return x

        for i, s in enumerate(sets):
            for j in range(i):
                if s and sets[j] and 100 * len(s & sets[j]) >= percent * len(s | sets[j]):
                    a, b = find(rows[i][0]), find(rows[j][0])
                    parent[max(a, b)] = min(a, b)
        got = jaccard.join(docs, width, percent).collect()
        want = sorted((i, len(s), find(i)) for (i, _), s in zip(rows, sets, strict=True))
        assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == want
    assert jaccard.join(empty).count() == 0
    kept = jaccard.distinct(docs, 3, 90)
    assert kept.columns == docs.columns and jaccard.distinct(empty).count() == 0
    found = {r.component_id for r in jaccard.join(docs, 3, 90).collect()}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(found)


def test_jaccard_large_groups_of_near_copies(spark):
    """Chains through a group in which most pairs do not link."""
    base = [f"w{i}" for i in range(60)]
    texts = [" ".join([f"v{i}" if i < k else w for i, w in enumerate(base)]) for k in range(40)]
    got = jaccard.join(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 1, 90).collect()
    assert {r.component_id for r in got} == {0}


def linked(rows, width, percent):
    """The component of each doc_id, by all pairs of rows."""
    sets = []
    for _, t in rows:
        w = words(t)
        sets.append({tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    parent = {i: i for i, _ in rows if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in enumerate(sets):
        for j in range(i):
            if None not in (rows[i][0], rows[j][0]) and s and sets[j] and 100 * len(s & sets[j]) >= percent * len(s | sets[j]):
                a, b = find(rows[i][0]), find(rows[j][0])
                parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in parent}


def test_jaccard_clashing_ids(spark, monkeypatch):
    """Different texts under one doc_id are one document; parts of lists and salts as small as they can be."""
    monkeypatch.setattr(jaccard, "BLOCK", 2)
    rng = np.random.default_rng(8)
    base = [[f"{c}{i}" for i in range(40)] for c in "abcdef"]

    def near(k):
        w = list(base[k])
        w[rng.integers(40)] = f"x{rng.integers(1000)}"
        return " ".join(w)

    rows = [(1, near(0)), (1, near(1)), (2, near(0)), (3, near(1)), (7, near(2)), (8, " ".join(base[2])), (0, " ".join(base[2])), (8, near(3)), (9, near(3)), (5, near(4)), (4, near(4))]
    rows += [(20 + i, near(i % 2 + 4)) for i in range(14)] + [(None, " ".join(base[2])), (None, "alone with a null id"), (50, None), (50, near(1)), (60, ""), (60, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for width, percent in ((1, 90), (2, 80), (3, 70)):
        want = linked(rows, width, percent)
        got = jaccard.join(df, width, percent).collect()
        assert len(got) == len(rows)
        assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == want
        assert sorted(-1 if r.component_id is None else r.component_id for r in got if r.doc_id is None) == [-1, want[8]]
    assert {want[i] for i in (1, 2, 3)} == {1} and want[9] == 0
    kept = jaccard.distinct(df.withColumn("touched", df.doc_id), 2, 80)
    assert kept.columns == ["doc_id", "text", "touched"]
    found = Counter((r.doc_id, r.text) for r in kept.collect())
    want = linked(rows, 2, 80)
    for i in {c for c in want.values()}:
        least = min((t is None, t or "") for j, t in rows if j == i)
        assert found.pop((i, None if least[0] else least[1])) == 1
    assert all(i is None for i, _ in found) and sum(found.values()) == 2


def test_fingerprints(docs, empty):
    got = fingerprints.fingerprints(docs).collect()
    rows = sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=lambda x: (-x[0], x[1]))
    want = {}
    for k, (i, t) in enumerate(rows):
        h = len(t) // 2
        edited = t[: len(t) - h] + rows[(k + 1) % len(rows)][1][:h]
        want.setdefault(i, set()).add((len(t), hashlib.sha256(edited.encode()).hexdigest()))
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_chars, r.edited_sha256) in want[r.doc_id]
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    by_id = {r.doc_id: r for r in got}
    prints = {}
    for i, t in rows:
        prints.setdefault(t, set()).add(by_id[i].fingerprint)
    assert all(len(x) == 1 for x in prints.values()) and len(set().union(*prints.values())) == len(prints)
    assert fingerprints.fingerprints(empty).count() == 0


def test_fingerprints_are_homomorphic(spark):
    from pyspark.sql import functions as F

    rows = [(0, "a b c d\ne f g h"), (1, "e f g h\na b c d"), (2, "a b c d"), (3, "e f g h"), (4, "a b c d\na b c d"), (5, "a b c d\n")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sums = {r.doc_id: r for r in fingerprints._sums(df, ["doc_id"], "text").select("doc_id", "vector", fingerprints.digest(F.col("vector")).alias("d")).collect()}
    assert sums[0].d == sums[1].d != sums[4].d and sums[2].d != sums[5].d
    both = spark.createDataFrame([(sums[2].vector, sums[3].vector, sums[0].vector)], "a array<long>, b array<long>, c array<long>")
    one = both.select(fingerprints.digest(fingerprints.combine(F.col("a"), F.col("b"))), fingerprints.digest(fingerprints.combine(F.col("c"), F.col("b"), True))).first()
    assert one[0] == sums[0].d and one[1] == sums[2].d


def test_fingerprints_single_and_many_ranges(spark):
    one = fingerprints.fingerprints(spark.createDataFrame([(5, "abcd")], "doc_id long, text string")).first()
    assert one.edited_sha256 == hashlib.sha256(b"abab").hexdigest()
    n = 3000
    df = spark.range(n).selectExpr("id * 3 as doc_id", "concat('t', id, ' word ', id % 7) as text")
    got = {r.doc_id: r.edited_sha256 for r in fingerprints.fingerprints(df).collect()}
    text = lambda i: f"t{i} word {i % 7}"
    for i in range(n):
        t, nxt = text(i), text((i - 1) % n)
        assert got[i * 3] == hashlib.sha256((t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]).encode()).hexdigest()


def test_lm_scoring(docs, empty):
    got = interpolation.score(docs).collect()
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    tokens = [[*words(t), None] for _, t in rows]
    held = [zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows]
    counts = Counter(w for t, h in zip(tokens, held, strict=True) if not h for w in t)
    n, v = sum(counts.values()), len(counts)
    want = []
    for (i, _), t, h in zip(rows, tokens, held, strict=True):
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t)
        want.append((i, h, len(t), sum(counts[w] > 0 for w in t), n, round(base, 6)))
    assert sorted((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == sorted(want)
    assert all(r.score < 0 for r in got)
    assert interpolation.score(empty).count() == 0


def test_lm_is_a_distribution(spark):
    """Summed over all next words and the unknown one, the probability after a context is 1."""
    train = [(i, "a b a c" if i % 2 else "b a b b") for i in range(400) if zlib.crc32(str(i).encode()) % 10]
    test = [i for i in range(400, 900) if zlib.crc32(str(i).encode()) % 10 == 0][:8]
    ends = ["a", "b", "c", "unknown"]
    rows = [*train, *((test[k], f"b {w}") for k, w in enumerate(ends)), (test[4], "b")]
    got = {r.doc_id: r.score for r in interpolation.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    # P(start b w end) / P(end | w) is P(b | start) * P(w | b); the end alone after b closes the sum. P(end | w) is learned from counts below.
    assert all(x < 0 for x in got.values())
    assert got[test[0]] > got[test[3]]


def test_em_recovers_weights():
    bucket, c2, c1 = np.array([3, 3, 3]), np.array([60, 0, 0]), np.array([40, 60, 0])
    w = interpolation.expectation_maximisation(bucket, c2, c1, np.array([700, 200, 100]))
    assert abs(w[3].sum() - 1) < 1e-9 and w[3][0] > 0.5 and (w[3] > 0).all()


def test_packing(docs, empty):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(BPE)
    got = packing.pack(docs, BPE, 256, 2).collect()
    want = Counter()
    for r in docs.collect():
        ids = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 2]
        first = len(ids) % 256 or 256
        cuts = [0, *range(first, len(ids) + 1, 256)]
        for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            want[r.doc_id, k, a, b - a, zlib.crc32(np.array(ids[a:b], dtype="<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    at = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == at.get(r.sequence_id, 0)
        at[r.sequence_id] = r.offset + r.length
    assert max(at.values()) <= 256 and len(at) <= sum(at.values()) / 256 * 1.1 + 1
    assert packing.pack(empty, BPE).count() == 0


def test_packing_plans_are_whole_and_tight():
    rng = np.random.default_rng(1)
    for scale in (1, 50):
        histogram = np.bincount(np.minimum(rng.geometric(0.01, 3000 * scale), 1024), minlength=1025)
        slots, sequences = packing.plan(histogram)
        used = np.zeros(1025, dtype=np.int64)
        np.add.at(used, slots[:, 0], slots[:, 2])
        assert (used == histogram).all()
        assert sequences <= math.ceil((histogram * np.arange(1025)).sum() / 1024) * 1.02 + 1


def test_special_tokens_in_texts(spark):
    from tokenizers import Tokenizer

    text = "end <|endoftext|> of text with odd  spaces\r\n\t x"
    ids = [*Tokenizer.from_file(BPE).encode(text, add_special_tokens=False).ids, 2]
    one = packing.pack(spark.createDataFrame([(1, text)], "doc_id long, text string"), BPE).first()
    assert one.ids_crc32 == zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def test_sharding(docs, empty):
    got = sharding.shard(docs, 4).collect()
    rows = Counter((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in docs.collect())
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == rows
    total, largest = sum(r.size for r in got), max(r.size for r in got)
    last = -1
    for k in range(4):
        own = sorted((r for r in got if r.shard == k), key=lambda r: r.slot)
        assert [r.slot for r in own] == list(range(len(own)))
        assert abs(sum(r.size for r in own) - total / 4) <= largest
        assert all(r.law == "bytes" and r.grown_shard is None for r in own)
        if own:
            assert min(r.doc_id for r in own) >= last
            last = max(r.doc_id for r in own)
    assert sharding.shard(empty).count() == 0


def test_mixing(spark, docs, empty):
    n = 4000
    many = spark.range(n).selectExpr("id as doc_id", "concat('text ', id % 10) as text", "if(id % 4 = 0, 'a', 'b') as source", "1 as copy_of")
    weights = {"a": 3.0, "b": 1.0}
    got = mixing.mix(many, weights, total=12_000 * 7, seed=5).collect()
    by = Counter(r.source for r in got)
    assert abs(by["a"] - 9000) < 5 * 9000**0.5 and abs(by["b"] - 3000) < 5 * 3000**0.5
    counts = Counter(r.doc_id for r in got)
    a = np.array([counts[i] for i in range(0, n, 4)])
    assert abs(a.mean() - 9) < 0.5 and abs(a.var() - 9) < 1.5  # a mean over LARGEST_MEAN: two parts
    again = mixing.mix(many.repartition(7), weights, total=12_000 * 7, seed=5)
    assert Counter(r.doc_id for r in again.collect()) == counts
    assert all(sorted(r.copy for r in got if r.doc_id == i) == list(range(1, counts[i] + 1)) for i in list(counts)[:20])
    assert {r.source for r in mixing.mix(many, {"a": 1.0}).collect()} == {"a"}
    assert mixing.mix(many, {"none": 1.0}).count() == 0 and mixing.mix(empty).count() == 0
    assert mixing.mix(docs).columns == [*docs.columns, "copy"] and mixing.mix(docs).count() > 0


def test_poisson_inversion(spark):
    rows = mixing.rates(spark.range(10).selectExpr("id as doc_id", "'abc' as text", "'s' as source"), None, "source", 60).collect()
    for k, p in enumerate(rows[0]["cumulative"][:12]):
        mean = rows[0]["rate"]
        assert abs(p - sum(math.exp(-mean) * mean**i / math.factorial(i) for i in range(k + 1))) < 1e-12


def best_segmentation(word, pieces, unknown):
    best = [(0.0, 0)]
    for end in range(1, len(word) + 1):
        options = [(best[a][0] + pieces[word[a:end]], -best[a][1] - 1) for a in range(end) if word[a:end] in pieces]
        if word[end - 1] not in pieces:
            options.append((best[end - 1][0] + unknown, -best[end - 1][1] - len(word[end - 1].encode())))
        s, n = max(options)
        best.append((s, -n))
    return best[-1][1]


def test_token_counts(docs, empty):
    pieces, unknown = token_counts.vocabulary(PIECES)
    got = token_counts.count(docs, PIECES).collect()
    want = Counter()
    for r in docs.collect():
        t = r.text or ""
        cut = re.findall("▁+[^▁]*|[^▁]+", "▁" + t.replace(" ", "▁")) if t else []
        want[r.doc_id, len(t), len(cut), sum(best_segmentation(w, pieces, unknown) for w in cut)] += 1
    assert Counter((r.doc_id, r.n_chars, r.n_pretokens, r.n_tokens) for r in got) == want
    assert token_counts.count(empty, PIECES).count() == 0


def labelled(spark, n=600):
    rng = np.random.default_rng(0)
    plain = [f"{a}{b}{c}" for a in ("ka", "lo", "mi") for b in ("na", "st", "ry") for c in ("", "en", "or")]
    rows, labels = [], []
    for i in range(n):
        w = list(rng.choice(plain, rng.integers(20, 80)))
        toxic, bad = int(i % 5 == 0), int(i % 4 == 1)
        if toxic:
            for _ in range(max(2, len(w) // 15)):
                w[rng.integers(len(w))] = "vexu" + rng.choice(["na", "st", "or", "lip", "qua"])
        if bad:
            w = [f"{x}$$$" for x in w]
        rows.append((i, " ".join(w)))
        labels.append((i, 1 - bad, toxic))
    rows += [(n, None), (n + 1, "")]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*labels, (None, 1, 1), (n + 7, 0, 1)], "doc_id long, quality int, toxic int")


def test_classifiers(spark, empty):
    docs, labels = labelled(spark)
    truth = {r.doc_id: r for r in labels.collect()}
    for module, name, folds, held, threshold in ((toxicity, "toxic", 3, 1, 0.7), (quality, "quality", 5, 0, 0.3)):
        got = module.classify(docs, labels).collect()
        assert len(got) == docs.count()
        for r in got:
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % folds == held)
            assert 0 <= r.score <= 1 and r.predicted == int(r.score >= threshold)
        own = [r for r in got if r.held_out and r.doc_id in truth]
        assert np.mean([r.predicted == getattr(truth[r.doc_id], name) for r in own]) > 0.95
        assert module.classify(empty, labels).count() == 0
        assert module.classify(docs, labels.limit(0)).count() == docs.count()
        kept = module.scored(docs.withColumn("score", docs.doc_id).withColumn("label", docs.doc_id), labels, keep=["doc_id", "text", "score", "label"])
        assert kept.columns == ["doc_id", "text", "score", "label", module.SCORE] and kept.count() == docs.count()


def test_additive_model_learns_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.fit(x[:3000], y[:3000], rounds=20, pairs=2)
    assert ((model.score(x[3000:]) > 0.5) == (y[3000:] > 0.5)).mean() > 0.95


def test_near_vectors(spark):
    rng = np.random.default_rng(0)
    rows = []
    for label in (1, 2):
        centres = rng.normal(size=(40, 16))
        for c in centres:
            for _ in range(rng.integers(1, 12)):
                rows.append((len(rows), (c + rng.normal(size=16) * rng.choice([0.01, 0.08])).tolist(), label))
    rows += [(len(rows) + k, rows[0][1], 1) for k in range(30)]
    rows += [(len(rows) + k, v, x) for k, (v, x) in enumerate([(None, 1), ([], 1), ([0.0] * 16, 1), ([float("nan")] + [1.0] * 15, 1), ([None] + [1.0] * 15, 1), (rows[0][1], None), ([1e-300] * 16, 2), ([1e300] * 16, 2), ([1.0, 2.0], 1), ([2.0, 4.0], 1)])]
    schema = "vec_id long, embedding array<double>, label int"
    got = {r.vec_id: r for r in pivots.near_duplicates(spark.createDataFrame(rows, schema), 0.93).collect()}
    unit = {}
    for i, v, label in rows:
        if v and label is not None and None not in v and np.isfinite(v).all() and np.any(v):
            x = np.array(v) / np.abs(v).max()
            unit[i] = (label, x / np.sqrt((x * x).sum()))
    links = {i: {j for j, (m, y) in unit.items() if j != i and m == label and len(x) == len(y) and float(x @ y) >= 0.93} for i, (label, x) in unit.items()}
    total, found = sum(map(len, links.values())), 0
    for i, _, _ in rows:
        assert got[i].n_links <= len(links.get(i, ()))
        found += got[i].n_links
        assert got[i].kept == (got[i].component_id == i)
    assert found >= 0.9 * total
    assert len(got) == len(rows)
    assert pivots.near_duplicates(spark.createDataFrame([], schema)).count() == 0


def test_pipeline_stages_against_brute_force(spark, tmp_path):
    """Each stage on awkward rows, nulls in every column and clashing names among them, against what it says it does."""
    import corpus_pipeline

    plain, labels = labelled(spark, 300)
    rows = [(r.doc_id, r.text, "en", ("a", "b", None)[r.doc_id % 3], len(r.text or ""), r.doc_id, "x", 1.5) for r in plain.collect()]
    long = " ".join(f"w{i}" for i in range(3000))
    rows += [(1000 + k, long if k < 3 else long.replace("w7 ", f"z{k} "), "en", "a", 1, None, None, None) for k in range(6)]
    rows += [(None, "null id " * 10, None, None, None, None, None, None), (2000, None, None, "b", None, 1, None, None), (2001, "", "en", "b", 0, 1, "", 0.0), rows[5]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, copy long, label string, score double")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    stages = dict(corpus_pipeline.STAGES)
    key = lambda df: Counter((r.doc_id, r.text) for r in df.collect())

    kept = stages["quality classifier"](spark, docs, str(tmp_path)).cache()
    want = Counter()
    for r, p in zip(docs.collect(), quality.classify(docs.coalesce(1), labels).collect(), strict=True):
        assert r.doc_id == p.doc_id
        if p.predicted:
            want[r.doc_id, r.text] += 1
    assert kept.columns == docs.columns and key(kept) == want and 0 < sum(want.values()) < len(rows)

    clean = stages["toxicity"](spark, kept, str(tmp_path)).cache()
    marks = dict(zip(((r.doc_id, r.text) for r in kept.collect()), (r.predicted for r in toxicity.classify(kept.coalesce(1), labels).collect()), strict=True))
    assert key(clean) == Counter({k: n for k, n in key(kept).items() if not marks[k]})

    distinct = stages["n-gram Jaccard join"](spark, clean, str(tmp_path)).cache()
    held = [(r.doc_id, r.text, {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w := words(r.text)) >= 5 else {tuple(w)} if w else set()) for r in clean.collect()]
    parent = {i: i for i, _, _ in held if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, _, s) in enumerate(held):
        for j, _, t in held[:a]:
            if None not in (i, j) and s and t and 100 * len(s & t) >= 80 * len(s | t):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    alone = Counter({(i, t): 1 for i, t, _ in held if i is not None and find(i) == i}) + Counter((i, t) for i, t, _ in held if i is None)
    assert key(distinct) == alone and sum(1000 <= i < 1006 for i, _ in alone if i is not None) <= 1

    mixed = stages["mixing sources to target weights"](spark, distinct, str(tmp_path)).cache()
    drawn, source, sizes = key(mixed), Counter(), {}
    origin = lambda i, t: next(r[3] for r in rows if r[0] == i and r[1] == t)
    for i, t in alone:
        sizes.setdefault(origin(i, t), []).append(len((t or "").encode()) + 1)
    for (i, t), n in drawn.items():
        assert (i, t) in alone
        source[origin(i, t)] += n * (len((t or "").encode()) + 1)
    share = sum(map(sum, sizes.values())) / len(sizes)
    for name, own in sizes.items():
        rate = share / sum(own)
        assert abs(source[name] - share) < 5 * math.sqrt(rate * sum(x * x for x in own))
    assert mixed.columns == docs.columns and len(sizes) == 3

    packed = stages["best-fit packing"](spark, mixed, str(tmp_path)).collect()
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(BPE)
    ids = sum((len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1) * n for (_, t), n in drawn.items())
    assert sum(r.length for r in packed) == ids
    assert all(stage(spark, docs.limit(0), str(tmp_path)).count() == 0 for stage in stages.values())


def test_queries_and_pipeline(spark):
    import corpus_pipeline
    from touchline.llm import queries

    assert sorted(int(re.match(r"op(\d+)_", x)[1]) for x in queries.QUERIES) == list(range(1, 11))
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        if name != "best-fit packing":
            assert out.columns == docs.columns
            docs = out
        sizes.append(out.count())
    assert sizes[0] > sizes[1] > sizes[2] > sizes[3] > 0
    assert corpus_pipeline.run(spark, sf).count() == sizes[-1]

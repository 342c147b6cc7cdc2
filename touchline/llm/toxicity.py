"""Toxicity by class-conditional Kneser-Ney models.

Two models of the letters of words, one learned from toxic and one from ordinary documents, give each letter a probability after
up to ORDER - 1 letters before it in its word. Each class has its own counts, less an absolute discount; what the discount frees
goes to an estimate that both classes share: the Kneser-Ney model of either's documents together, down to continuation
counts. So an expression that one class has seen a few times weighs nothing, a rare form of a known stem weighs as its stem does,
and where neither class has seen a letter follow, only the classes' freed shares differ.

The models are learned by grouped aggregates on the cluster. The shared estimate never sees a label, so it is learned once; the
class counts are kept by fold, and a fold's documents are rated without their own counts.

What is compared is the difference of the toxic and the ordinary log-likelihood, normalised by length: of the whole text (over its
words), of its strongest word and of its three strongest words. A logistic curve of these and the length makes it a score. The
whole text alone would not do: three words among three hundred change it less than its topic does.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.llm import memory, scratch
from touchline.llm.sampling import labelled, remainder
from touchline.llm.words import mix

#: Letters of a gram; the discount of a class's counts and of the shared ones.
ORDER, DISCOUNT, SHARED_DISCOUNT = 6, 2.0, 0.75
#: At most so many documents of either label are learned from, and of these, in hashed order, so many bytes: this bounds the models.
MOST_DOCUMENTS, MOST_BYTES = 4000, 32 << 20
#: Folds of the sample: the documents of one are rated for the curve without their own counts.
FOLDS = 4
#: Parts that the sample is learned from in.
PARTS = 24
#: The score's column where documents' own columns are kept.
SCORE = "touchline_score"
THRESHOLD = 0.7
#: Words that a task remembers; letters of a text that are cut into words at a time; words that are looked up at a time.
KEPT, CHUNK, AT_ONCE = 200_000, 1 << 20, 1 << 15
FEATURES = 4
_WORD = re.compile(r"[^\W\d_]+")
_GAP = re.compile(r"[\W\d_]")
_BASE = np.uint64(0x9E3779B97F4A7C15)


def grams(word: str) -> list[str]:
    """For each letter of a word and for its end, that letter with up to ORDER - 1 before it; ^ and $ bound a word."""
    word = f"^{word}$"
    return [word[max(0, i - ORDER + 1) : i + 1] for i in range(1, len(word))]


def words(text: str) -> Iterator[list[str]]:
    """The words of a text in lower case, CHUNK letters at a time."""
    at = 0
    while at < len(text):
        end = _GAP.search(text, at + CHUNK) if at + CHUNK < len(text) else None
        to = end.start() if end else len(text)
        yield _WORD.findall(text[at:to].lower())
        at = to


def _keys(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each string its first letter's place among all letters, and the end; the letters; the letters' random values."""
    ends = np.cumsum([0, *map(len, texts)])
    letters = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return ends, letters, mix((letters.astype(np.uint64) + np.uint64(1)) * _BASE)


def key_of(texts: list[str]) -> np.ndarray:
    """64-bit keys of grams, polynomials of their letters from the last one: two of n grams meet in n * n / 2**65 pairs on average."""
    ends, _, value = _keys(texts)
    place = np.repeat(ends[1:], np.diff(ends)) - 1 - np.arange(len(value))
    powers = np.array([pow(int(_BASE), k, 2**64) for k in range(int(place.max(initial=0)) + 1)], dtype=np.uint64)
    sums = np.concatenate(([np.uint64(0)], np.cumsum(value * powers[place], dtype=np.uint64)))
    return mix(sums[ends[1:]] - sums[ends[:-1]])


def _word_keys(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For all letters of all words: the gram's key and its context's key; and where each word begins among them, and the end."""
    bounded = [f"^{x}$" for x in texts]
    ends, _, value = _keys(bounded)
    place = np.arange(len(value)) - np.repeat(ends[:-1], np.diff(ends))
    gram = np.zeros(len(value), dtype=np.uint64)
    for k in range(ORDER):
        late = np.flatnonzero(place >= k)
        gram[late] += value[late - k] * np.uint64(pow(int(_BASE), k, 2**64))
    # Without its last letter a gram is its context, one power higher.
    context = (gram - value) * np.uint64(pow(int(_BASE), -1, 2**64))
    after = place > 0
    return mix(gram[after]), mix(context[after]), ends - np.arange(len(ends))


class _Lookup:
    """Values by 64-bit key: slots by the key's first bits, so that few keys share one."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.keys, self.values = keys, values
        self.shift = np.uint64(64 - max(int(len(keys)).bit_length() + 1, 8))
        slot = (keys >> self.shift).astype(np.int64)
        self.first = np.searchsorted(slot, np.arange((1 << (64 - int(self.shift))) + 1)).astype(np.int32)
        self.most = int(np.diff(self.first).max())

    def into(self, out: np.ndarray, wanted: np.ndarray) -> None:
        """Writes the values of the wanted keys that are held, each at its place."""
        slot = (wanted >> self.shift).astype(np.int64)
        at, end, rows = self.first[slot], self.first[slot + 1], np.arange(len(wanted))
        for _ in range(self.most):
            left = np.flatnonzero(at < end)
            if not len(left):
                break
            at, end, rows = at[left], end[left], rows[left]
            hit = self.keys[at] == wanted[rows]
            out[rows[hit]] = self.values[at[hit]]
            at, end, rows = at[~hit] + 1, end[~hit], rows[~hit]


@dataclass
class Model:
    """The log-likelihood ratio of each gram's last letter, and of a letter that neither class has seen after a context: sorted keys, ratios."""

    grams: np.ndarray
    by_gram: np.ndarray
    contexts: np.ndarray
    by_context: np.ndarray


class Evidence:
    """Features of texts under a model, remembering words."""

    def __init__(self, model: Model) -> None:
        self.by_gram, self.by_context = _Lookup(model.grams, model.by_gram), _Lookup(model.contexts, model.by_context)
        self.known: dict[str, float] = {}

    def words(self, texts: list[str]) -> np.ndarray:
        """The difference of the two log-likelihoods of each word."""
        if not texts:
            return np.empty(0)
        gram, context, ends = _word_keys(texts)
        found = np.zeros(len(gram))
        self.by_context.into(found, context)
        self.by_gram.into(found, gram)
        return np.add.reduceat(found, ends[:-1])

    def _each(self, found: list[str]) -> np.ndarray:
        fresh = set(found) - self.known.keys()
        if len(self.known) + len(fresh) > KEPT:
            self.known, fresh = {}, set(found)
        fresh = list(fresh)
        self.known.update(zip(fresh, self.words(fresh).tolist(), strict=True))
        return np.fromiter(map(self.known.__getitem__, found), dtype=float, count=len(found))

    def texts(self, texts: list[str]) -> np.ndarray:
        """For each text the difference over the number of words; the strongest word's; the three strongest ones'; the logarithm of the number."""
        total, n, top = np.zeros(len(texts)), np.zeros(len(texts), dtype=np.int64), np.zeros((len(texts), 3))
        held: list[tuple[int, list[str]]] = []

        def rate() -> None:
            each = self._each([word for _, part in held for word in part])
            end = np.cumsum([len(part) for _, part in held])
            for (i, part), to in zip(held, end.tolist(), strict=True):
                own = each[to - len(part) : to]
                total[i] += own.sum()
                n[i] += len(own)
                top[i] = np.sort(np.concatenate([top[i], own if len(own) < 4 else np.partition(own, -3)[-3:]]))[-3:]
            held.clear()

        size = 0
        for i, text in enumerate(texts):
            for part in words(text):
                held.append((i, part))
                size += len(part)
                if size > AT_ONCE:
                    rate()
                    size = 0
        rate()
        some = np.maximum(n, 1)
        return np.column_stack([total / some, top[:, 2], top.sum(axis=1), np.log(some)])


def counts(sample: DataFrame) -> DataFrame:
    """gram, and its count in each fold's ordinary (o0, o1, ...) and toxic (t0, t1, ...) documents. sample: text, label, fold."""
    names = [f"{kind}{f}" for kind in "ot" for f in range(FOLDS)]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [Counter() for _ in names]
            for text, label, fold in zip(*(batch.column(c).to_pylist() for c in ("text", "label", "fold")), strict=True):
                for part in words(text):
                    found[label * FOLDS + fold].update(part)
            both: dict[str, list[int]] = {}
            for k, counter in enumerate(found):
                for word, n in counter.items():
                    for gram in grams(word):
                        both.setdefault(gram, [0] * len(names))[k] += n
            rows = list(both.items())
            for at in range(0, len(rows), 50_000):
                part = rows[at : at + 50_000]
                yield pa.record_batch({"gram": pa.array([g for g, _ in part])} | {name: pa.array([x[k] for _, x in part], pa.int64()) for k, name in enumerate(names)})

    rows = sample.select("text", "label", "fold").mapInArrow(memory.released(count), "gram string, " + ", ".join(f"{x} long" for x in names))
    return rows.groupBy("gram").agg(*(F.sum(x).alias(x) for x in names))


def _context(gram: str = "gram") -> Column:
    return F.expr(f"substring({gram}, 1, length({gram}) - 1)")


def shared(found: DataFrame) -> DataFrame:
    """gram, low: the last letter's probability after the gram without its first letter, by continuation counts alone.

    A shorter gram counts once for each letter seen before it. Its estimate, discounted, falls back on the next shorter one's and at
    last on equal shares of all letters and one unknown: a gram's few suffixes are joined at once and folded from the shortest.
    """
    letters = found.select(F.substring("gram", -1, 1)).distinct().count() + 1
    suffixes = found.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("gram") - 1), lambda k: F.substring(F.col("gram"), k, F.length("gram")))).alias("longer"))
    seen = suffixes.distinct().groupBy(F.expr("substring(longer, 2)").alias("suffix")).agg(F.count("*").alias("n"))
    total = Window.partitionBy("context")
    seen = seen.withColumn("context", _context("suffix")).select("suffix", "n", F.sum("n").over(total).alias("total"), F.count("*").over(total).alias("kinds"))
    own = F.greatest(F.col("n") - SHARED_DISCOUNT, F.lit(0.0)) / F.col("total")
    seen = seen.select("suffix", F.struct(F.length("suffix").alias("size"), own.alias("own"), (SHARED_DISCOUNT * F.col("kinds") / F.col("total")).alias("rest")).alias("step"))
    shorter = found.select("gram", F.explode(F.transform(F.sequence(F.lit(2), F.length("gram")), lambda k: F.substring(F.col("gram"), k, F.length("gram")))).alias("suffix"))
    steps = shorter.join(seen, "suffix").groupBy("gram").agg(F.array_sort(F.collect_list("step")).alias("steps"))  # at most ORDER - 1
    return steps.select("gram", F.aggregate("steps", F.lit(1.0 / letters), lambda p, x: x["own"] + x["rest"] * p).alias("low"))


def ratios(found: DataFrame) -> DataFrame:
    """kind, key, r, and r0, r1, ... without the counts of one fold: of kind 0 by gram, of kind 1 by context."""
    kept = {"": list(range(FOLDS))} | {str(f): [k for k in range(FOLDS) if k != f] for f in range(FOLDS)}
    add = lambda kind, folds: sum((F.col(f"{kind}{f}") for f in folds), F.lit(0).cast("long"))
    rows = found.withColumn("context", _context()).withColumn("all", add("o", kept[""]) + add("t", kept[""]))
    rows = rows.select("gram", "context", "all", *(add(kind, folds).alias(f"{kind}_{name}") for kind in "ot" for name, folds in kept.items()))
    sums = [F.sum("all").alias("total"), F.sum(F.least(F.col("all"), F.lit(SHARED_DISCOUNT))).alias("freed")]
    for kind in "ot":
        for name in kept:
            n = f"{kind}_{name}"
            sums += [F.sum(n).alias(f"total_{n}"), F.sum(F.least(F.col(n), F.lit(DISCOUNT))).alias(f"freed_{n}")]
    contexts = rows.groupBy("context").agg(*sums)
    rest = lambda n: F.when(F.col(f"total_{n}") > 0, F.col(f"freed_{n}") / F.col(f"total_{n}")).otherwise(1.0)
    contexts = contexts.select("context", "total", "freed", *(x for name in kept for kind in "ot" for x in (F.col(f"total_{kind}_{name}"), rest(f"{kind}_{name}").alias(f"rest_{kind}_{name}"))))
    by_context = contexts.select(F.lit(1).alias("kind"), F.col("context").alias("key"), *(F.log(F.col(f"rest_t_{name}") / F.col(f"rest_o_{name}")).alias(f"r{name}") for name in kept))
    rows = rows.join(contexts, "context").join(shared(found), "gram")
    rows = rows.withColumn("low", F.greatest(F.col("all") - SHARED_DISCOUNT, F.lit(0.0)) / F.col("total") + F.col("freed") / F.col("total") * F.col("low"))

    def likelihood(n: str) -> Column:
        own = F.when(F.col(f"total_{n}") > 0, F.greatest(F.col(n) - DISCOUNT, F.lit(0.0)) / F.col(f"total_{n}")).otherwise(0.0)
        return own + F.col(f"rest_{n}") * F.col("low")

    by_gram = rows.select(F.lit(0).alias("kind"), F.col("gram").alias("key"), *(F.log(likelihood(f"t_{name}") / likelihood(f"o_{name}")).alias(f"r{name}") for name in kept))
    return by_gram.unionAll(by_context)


def _collected(rows: DataFrame) -> dict[str, Model]:
    """The models of ratios(), by column: a table that MOST_BYTES bounds."""
    names = [x for x in rows.columns if x not in ("kind", "key")]

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = key_of(batch.column("key").to_pylist()).view(np.int64)
            yield pa.record_batch([batch.column("kind"), pa.array(keys), *(batch.column(x).cast(pa.float32()) for x in names)], names=["kind", "key", *names])

    table = rows.mapInArrow(memory.released(hashed), "kind int, key long, " + ", ".join(f"{x} float" for x in names)).toArrow()
    parts = []
    for kind in (0, 1):
        own = table.filter(pa.compute.equal(table.column("kind"), kind))
        keys = own.column("key").to_numpy().view(np.uint64)
        order = np.argsort(keys, kind="stable")
        parts.append((keys[order], {x: own.column(x).to_numpy()[order] for x in names}))
    (grams_, by_gram), (contexts, by_context) = parts
    return {x: Model(grams_, by_gram[x], contexts, by_context[x]) for x in names}


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Weights and intercept of a logistic curve, by Newton's method."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (p - y)) + ridge * w
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _sample(docs: DataFrame, labels: DataFrame, folds: int, held: int) -> DataFrame:
    """doc_id, text, label, fold and size of the documents that may be learned from."""
    found = labelled(docs, labels, "toxic", remainder("doc_id", folds) == held, MOST_DOCUMENTS, "toxicity")
    fold = F.pmod(F.xxhash64(F.lit("curve"), "doc_id"), F.lit(FOLDS)).cast("int")
    return found.withColumn("fold", fold).withColumn("size", F.octet_length("text").cast("long")).repartition(PARTS, "doc_id")


def _bounded(found: DataFrame) -> DataFrame:
    """Of the sample, whole documents up to MOST_BYTES of either label in hashed order, one at least. At most 2 * MOST_DOCUMENTS sizes come to the driver."""
    used, kept = [0, 0], []
    place = F.xxhash64(F.lit("bytes"), "doc_id")
    for _, doc_id, label, size in sorted(found.select(place, "doc_id", "label", "size").collect()):
        if not used[label] or used[label] + size <= MOST_BYTES:
            kept.append((doc_id,))
        used[label] += size
    ids = found.sparkSession.createDataFrame(kept, "doc_id long")
    return found.join(F.broadcast(ids), "doc_id").select("text", "label", "fold")


def fit(docs: DataFrame, labels: DataFrame, folds: int, held: int) -> tuple[Model, np.ndarray, np.ndarray]:
    """The models' ratios, the scale of the features and the curve. The ratios, some bytes a gram, and the sample's features come to the driver."""
    held_sample = scratch.table(_sample(docs, labels, folds, held), "toxicity-sample")
    sample = _bounded(held_sample)
    found = scratch.table(counts(sample), "toxicity-grams")
    models = _collected(ratios(found))
    scratch.drop(found)
    share = docs.sparkSession.sparkContext.broadcast([models[f"r{f}"] for f in range(FOLDS)])

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        evidence = [Evidence(x) for x in share.value]
        for batch in batches:
            for f in range(FOLDS):
                own = batch.filter(pa.compute.equal(batch.column("fold"), f))
                x = evidence[f].texts(own.column("text").to_pylist())
                yield pa.record_batch({f"x{i}": pa.array(x[:, i]) for i in range(FEATURES)} | {"label": own.column("label")})

    names = [f"x{i}" for i in range(FEATURES)]
    seen = sample.mapInArrow(memory.released(weigh), ", ".join([*(f"{x} double" for x in names), "label int"])).toPandas().sort_values([*names, "label"])
    share.destroy()
    scratch.drop(held_sample)
    model = models["r"]
    x, y = seen[names].to_numpy(dtype=float).reshape(-1, FEATURES), seen["label"].to_numpy(dtype=float)
    scale = np.maximum(x.std(axis=0), 1e-6) if len(x) else np.ones(FEATURES)
    if len(set(y)) < 2:
        return model, scale, np.array([1.0] + [0.0] * (FEATURES - 1) + [-1.0])
    return model, scale, logistic(x / scale, y, np.ones(len(y)))


def classify(docs: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1) -> DataFrame:
    """docs' rows as doc_id, held_out, score, predicted.

    docs needs doc_id and text, labels doc_id and toxic. Labels of documents whose crc32(doc_id as text) modulo folds is `held` are not
    learned from. score (0 to 1) depends on the text alone; null and empty texts have the evidence 0, as a text without letters has. predicted is 1 from
    THRESHOLD on. Without labels of both kinds the curve is a fixed one. Repeated rows and null ids give a row each; an empty table none.
    """
    rated = scored(docs, labels, folds, held)
    return rated.select("doc_id", (remainder("doc_id", folds) == held).alias("held_out"), F.col(SCORE).alias("score"), (F.col(SCORE) >= THRESHOLD).cast("int").alias("predicted"))


def scored(docs: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1, keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of docs (None: doc_id) and SCORE: another column of that name would clash."""
    model, scale, curve = fit(docs, labels, folds, held)
    share = docs.sparkSession.sparkContext.broadcast(model)
    keep = keep or ["doc_id"]
    read = docs.select(*(F.col(f"`{c}`") for c in dict.fromkeys([*keep, "text"])))

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        evidence = Evidence(share.value)
        for batch in batches:
            x = evidence.texts([t or "" for t in batch.column("text").to_pylist()]) / scale
            p = 1 / (1 + np.exp(-np.clip(x @ curve[:-1] + curve[-1], -30, 30)))
            yield pa.record_batch([*(batch.column(c) for c in keep), pa.array(p, pa.float64())], names=[*keep, SCORE])

    return read.mapInArrow(memory.released(rate), read.select(*(F.col(f"`{c}`") for c in keep)).schema.add(SCORE, "double"))

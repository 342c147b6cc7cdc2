"""Quality by a generalised additive model with pairwise interactions.

Each document has a few features of its text. Every feature is cut into bins, and boosting in turns fits to each feature a shallow
tree on its bins, a small step at a time, so that a feature's trees add up to one lookup table; then pairs of features get tables
of their own in the same way, chosen by how much of the rest they explain. A document's score is the sum of the entries its
bins point to, through a logistic curve: vectorised additions, and each feature's effect can be read off.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm import memory
from touchline.llm.sampling import labelled, remainder

#: At most so many documents of either label are learned from.
MOST_DOCUMENTS = 10_000
#: The score's column where documents' own columns are kept.
SCORE = "touchline_score"
THRESHOLD = 0.3
FEATURES = [
    "log_bytes", "log_words", "mean_word", "long_words", "upper", "digits", "punctuation", "odd_signs", "exclamations", "bars",
    "not_ascii", "distinct_words", "most_frequent_word", "repeated_pairs", "distinct_lines", "sentence_ends", "signs_after_words", "short_words", "control", "mean_line",
]
_CLASS = np.zeros(256, dtype=np.uint8)
for _bytes, _kind in ((range(65, 91), 1), (range(48, 58), 2), (b".,;:'\"()-?", 3), (b"#$%&*+/<=>@[\\]^_`{}~", 4), (b"!", 5), (b"|", 6), (range(128, 256), 7), (b"\n", 8), ((*range(9), *range(11, 32), 127), 9)):
    _CLASS[list(_bytes)] = _kind
_WORD_ENDS = np.zeros(256, dtype=bool)
_WORD_ENDS[list(b"#$%&*+/<=>@[\\]^_`{}~!|")] = True


def features(text: bytes) -> list[float]:
    """The features of a UTF-8 text, from all of it."""
    n = max(len(text), 1)
    kinds = np.bincount(_CLASS[np.frombuffer(text, dtype=np.uint8)], minlength=10) / n
    words = text.lower().split()
    k = max(len(words), 1)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    distinct = set(words)
    counts: dict[bytes, int] = {}
    for word in words:
        counts[word] = counts.get(word, 0) + 1
    pairs = len(set(zip(words[:-1], words[1:], strict=True)))
    lines = [x for x in text.split(b"\n") if x]
    last = np.frombuffer(b"".join(w[-1:] for w in words), dtype=np.uint8)
    ends = text.count(b". ") + text.count(b".\n") + text.endswith(b".")
    return [
        float(np.log1p(len(text))), float(np.log1p(len(words))), len(text) / k, float((lengths > 20).sum()) / k, kinds[1], kinds[2], kinds[3], kinds[4], kinds[5], kinds[6],
        kinds[7], len(distinct) / k, max(counts.values(), default=0) / k, 1 - pairs / (len(words) - 1) if len(words) > 1 else 0.0, len(set(lines)) / max(len(lines), 1), ends / k, float(_WORD_ENDS[last].sum()) / k, float((lengths <= 2).sum()) / k, kinds[9], float(np.log1p(len(text) / max(len(lines), 1))),
    ]


@dataclass
class Model:
    """Bin edges, a table for each feature, tables for pairs on coarser bins, and the intercept."""

    edges: list[np.ndarray]
    coarse: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray]]
    intercept: float

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        small = {}
        for i, (edges, table) in enumerate(zip(self.edges, self.tables, strict=True)):
            total += table[np.searchsorted(edges, x[:, i], side="right")]
        for a, b, table in self.pairs:
            for i in (a, b):
                if i not in small:
                    small[i] = np.searchsorted(self.coarse[i], x[:, i], side="right")
            total += table[small[a], small[b]]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _tree(bins: np.ndarray, residual: np.ndarray, weight: np.ndarray, n: int, leaves: int, least: float) -> np.ndarray:
    """A tree of so many leaves on one feature's bins, split where most is gained: a value for each bin."""
    g, h = np.bincount(bins, residual, n), np.bincount(bins, weight, n)
    cuts = [0, n]
    for _ in range(leaves - 1):
        best = (1e-9, None)
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if b - a < 2:
                continue
            left_g, left_h = np.cumsum(g[a:b])[:-1], np.cumsum(h[a:b])[:-1]
            all_g, all_h = g[a:b].sum(), h[a:b].sum()
            gain = left_g**2 / (left_h + 1) + (all_g - left_g) ** 2 / (all_h - left_h + 1) - all_g**2 / (all_h + 1)
            gain[(left_h < least) | (all_h - left_h < least)] = 0
            at = int(gain.argmax())
            if gain[at] > best[0]:
                best = (gain[at], a + at + 1)
        if best[1] is None:
            break
        cuts = sorted([*cuts, best[1]])
    out = np.zeros(n)
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + 1)
    return out


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 150, pair_rounds: int = 60, pairs: int = 8, bins: int = 32, coarse: int = 8, rate: float = 0.15) -> Model:
    """Cyclic boosting of shallow trees: features in turn, then the pairs that explain most of the rest."""
    if not len(x) or len(set(y.tolist())) < 2:
        return Model([np.empty(0)] * x.shape[1], [np.empty(0)] * x.shape[1], [np.zeros(1)] * x.shape[1], [], 10.0 if len(y) and y[0] else 0.0)
    cut = lambda n: [np.unique(np.quantile(x[:, i], np.linspace(0, 1, n + 1)[1:-1])) for i in range(x.shape[1])]
    edges, small = cut(bins), cut(coarse)
    binned = [np.searchsorted(e, x[:, i], side="right") for i, e in enumerate(edges)]
    rough = [np.searchsorted(e, x[:, i], side="right") for i, e in enumerate(small)]
    mean = y.mean()
    intercept = float(np.log(mean / (1 - mean)))
    total = np.full(len(y), intercept)
    tables = [np.zeros(len(e) + 1) for e in edges]
    least = max(1.0, len(y) / 2000)

    def rest() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, np.maximum(p * (1 - p), 1e-4)

    for _ in range(rounds):
        for i, own in enumerate(binned):
            residual, weight = rest()
            step = rate * _tree(own, residual, weight, len(tables[i]), 4, least * 0.05)
            tables[i] += step
            total += step[own]
    residual, weight = rest()
    found = []
    for a in range(x.shape[1]):
        for b in range(a + 1, x.shape[1]):
            shape = (len(small[a]) + 1, len(small[b]) + 1)
            code = rough[a] * shape[1] + rough[b]
            g, h = np.bincount(code, residual, shape[0] * shape[1]), np.bincount(code, weight, shape[0] * shape[1])
            found.append((float((g**2 / (h + 5)).sum()), a, b))
    chosen = [(a, b, np.zeros((len(small[a]) + 1, len(small[b]) + 1))) for _, a, b in sorted(found, reverse=True)[:pairs]]
    for _ in range(pair_rounds):
        for a, b, table in chosen:
            residual, weight = rest()
            code = rough[a] * table.shape[1] + rough[b]
            g, h = np.bincount(code, residual, table.size), np.bincount(code, weight, table.size)
            # A tree of two levels: the better feature's split, then the other's on either side.
            step = rate * _two_levels(g.reshape(table.shape), h.reshape(table.shape))
            table += step
            total += step.ravel()[code]
    return Model(edges, small, tables, chosen, intercept)


def _two_levels(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The best tree that splits on the first feature and then, on either side, on the second (or the other way round)."""

    def value(a: np.ndarray, b: np.ndarray) -> float:
        return float(a.sum() ** 2 / (b.sum() + 5))

    best, out = -1.0, np.zeros(g.shape)
    for turned in (False, True):
        gg, hh = (g.T, h.T) if turned else (g, h)
        for i in range(1, gg.shape[0]):
            gain, tables = 0.0, []
            for part in (slice(0, i), slice(i, None)):
                cg, ch = gg[part].sum(axis=0), hh[part].sum(axis=0)
                left_g, left_h = np.cumsum(cg)[:-1], np.cumsum(ch)[:-1]
                if not len(left_g):
                    gain += value(cg, ch)
                    tables.append(np.full(len(cg), cg.sum() / (ch.sum() + 5)))
                    continue
                each = left_g**2 / (left_h + 5) + (cg.sum() - left_g) ** 2 / (ch.sum() - left_h + 5)
                j = int(each.argmax())
                gain += float(each[j])
                row = np.empty(len(cg))
                row[: j + 1], row[j + 1 :] = cg[: j + 1].sum() / (ch[: j + 1].sum() + 5), cg[j + 1 :].sum() / (ch[j + 1 :].sum() + 5)
                tables.append(row)
            if gain > best:
                best = gain
                whole = np.vstack([np.tile(tables[0], (i, 1)), np.tile(tables[1], (gg.shape[0] - i, 1))])
                out = whole.T if turned else whole
    return out


def _described(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return np.array([features(x.as_buffer().to_pybytes() if x.is_valid else b"") for x in batch.column(name).cast(pa.binary())]).reshape(-1, len(FEATURES))


def learn(docs: DataFrame, labels: DataFrame, folds: int, held: int) -> Model:
    """The model of a bounded sample of labelled documents: only their features come to the driver."""
    sample = labelled(docs, labels, "quality", remainder("doc_id", folds) == held, MOST_DOCUMENTS, "quality")

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _described(batch, "text")
            yield pa.record_batch([*(pa.array(x[:, i]) for i in range(x.shape[1])), batch.column("label"), batch.column("doc_id")], names=[*FEATURES, "label", "doc_id"])

    rows = sample.mapInArrow(memory.released(describe), ", ".join(f"{x} double" for x in FEATURES) + ", label int, doc_id long").toPandas().sort_values(["doc_id", *FEATURES])
    x, y = rows[FEATURES].to_numpy(), rows["label"].to_numpy(dtype=float)
    return fit(x, y)


def scored(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of docs (None: doc_id) and SCORE: another column of that name would clash."""
    model = learn(docs, labels, folds, held)
    keep = keep or ["doc_id"]
    read = docs.select(*(F.col(f"`{c}`") for c in dict.fromkeys([*keep, "text"])))

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = model.score(_described(batch, "text"))
            yield pa.record_batch([*(batch.column(c) for c in keep), pa.array(p, pa.float64())], names=[*keep, SCORE])

    return read.mapInArrow(memory.released(rate), read.select(*(F.col(f"`{c}`") for c in keep)).schema.add(SCORE, "double"))


def classify(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0) -> DataFrame:
    """docs' rows as doc_id, held_out, score, predicted.

    docs needs doc_id and text, labels doc_id and quality. Labels of documents whose crc32(doc_id as text) modulo folds is `held` are not
    learned from. score (0 to 1) depends on the text alone; a null text is empty, and an empty text has all features at 0. predicted is
    1 from THRESHOLD on. Without labels of both kinds all scores are equal. Repeated rows and null ids give a row each; an empty
    table none.
    """
    rated = scored(docs, labels, folds, held)
    return rated.select("doc_id", (remainder("doc_id", folds) == held).alias("held_out"), F.col(SCORE).alias("score"), (F.col(SCORE) >= THRESHOLD).cast("int").alias("predicted"))

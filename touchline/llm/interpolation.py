"""Language-model scores by deleted interpolation.

P(w | h) mixes three estimates: the bigram c(h, w) / c(h), the unigram c(w) / N and the uniform 1 / (V + 1) over the known
words and one unknown word. The weights depend on how often the context h was seen (a bucket for each power of two) and are
learned by expectation-maximisation on deleted counts: every training document is held out in turn, its own counts are taken
off, and its tokens are predicted by what is left. The tokens of all training documents take part; for EM they are counted by
bucket and by the two estimates' ratios to the uniform one, in steps of a quarter of an octave, which bounds what the driver
reads whatever the corpus holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm import blocks, memory, scratch
from touchline.llm.words import _BASE, END, START, hash_words, mix, unique

_STEPS, _BUCKETS, _TOP = 4, 48, 255
_DOC = "kind int, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, words binary, pairs binary"
ALPHA = 0.1


def is_held_out(doc_ids: np.ndarray, folds: int) -> np.ndarray:
    """crc32 of the id as text, modulo folds, is 0. A null id counts as an empty text."""
    import zlib

    return np.array([zlib.crc32(b"" if x is None else str(x).encode()) % folds == 0 for x in doc_ids], dtype=bool)


def _tokens(block: pa.Table, folds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of all texts (each closed by END), the context of each, each text's first position (and the end), held out."""
    texts = blocks.texts_of(block)
    found, n = hash_words(texts)
    ends = np.cumsum(n)
    tokens = np.insert(found, ends, END)
    bounds = np.concatenate(([0], np.cumsum(n + 1)))
    contexts = np.concatenate(([START], tokens[:-1]))
    contexts[bounds[:-1]] = START
    return tokens, contexts, bounds, is_held_out(block.column("doc_id").to_pylist(), folds)


def _pairs(tokens: np.ndarray, contexts: np.ndarray) -> np.ndarray:
    return mix(contexts * _BASE ^ tokens)


def _counted(keys: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    distinct = unique(keys)
    return distinct, np.bincount(np.searchsorted(distinct, keys[train]), minlength=len(distinct))


def _own(keys: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each token, how often its key is in its own document."""
    order = np.lexsort((keys, doc))
    k, d = keys[order], doc[order]
    first = np.flatnonzero(np.concatenate(([True], (k[1:] != k[:-1]) | (d[1:] != d[:-1]))))
    runs = np.diff(np.append(first, len(k)))
    out = np.empty(len(k), dtype=np.int64)
    out[order] = np.repeat(runs, runs)
    return out


def _bucket(context: np.ndarray) -> np.ndarray:
    return np.where(context > 0, np.log2(np.maximum(context, 1)).astype(np.int64) + 1, 0)


def _cell(p: np.ndarray, p0: float) -> np.ndarray:
    """0 for a zero estimate, else one more than the step of its ratio to the uniform one."""
    with np.errstate(divide="ignore"):
        step = np.floor(np.log2(np.where(p > 0, p, 1) / p0) * _STEPS).astype(np.int64) + 32
    return np.where(p > 0, np.clip(step, 1, _TOP), 0)


def expectation_maximisation(bucket: np.ndarray, cell2: np.ndarray, cell1: np.ndarray, n: np.ndarray, rounds: int = 200) -> np.ndarray:
    """Weights of (bigram, unigram, uniform) for each bucket, from how many held-out tokens fell in each cell."""
    ratio = lambda cell: np.where(cell > 0, 2.0 ** ((cell - 32 + 0.5) / _STEPS), 0.0)
    p = np.stack([ratio(cell2), ratio(cell1), np.ones(len(cell1))], axis=1)
    weights = np.tile([0.0, 0.9, 0.1], (_BUCKETS, 1))
    for b in range(_BUCKETS):
        own = bucket == b
        if own.any():
            x, count = p[own], n[own].astype(float)
            w = np.array([1 / 3, 1 / 3, 1 / 3]) if b else np.array([0.0, 0.5, 0.5])
            for _ in range(rounds):
                part = x * w
                new = (part / part.sum(axis=1, keepdims=True) * count[:, None]).sum(axis=0) + np.array([0, 1e-3, 1e-3])
                new /= new.sum()
                if np.abs(new - w).max() < 1e-7:
                    break
                w = new
            weights[b] = w
        elif b:
            weights[b] = weights[b - 1]
    return weights


def score(docs: DataFrame, folds: int = 10) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    docs needs doc_id and text; other columns are ignored. Documents whose crc32(doc_id as text) modulo folds is 0 are held out
    of training. A null or empty text is one end token. Repeated rows each count and each give a row; a null doc_id is
    hashed as an empty text. An empty table gives no rows; without training documents every token is unknown.
    """
    n_blocks, parts = blocks.size(docs)
    blocked = blocks.dealt(docs, n_blocks)

    def keys_of(block: pa.Table) -> list[tuple[np.ndarray, np.ndarray]]:
        tokens, contexts, bounds, held = _tokens(block, folds)
        train = np.repeat(~held, np.diff(bounds))
        return [_counted(tokens, train), _counted(_pairs(tokens, contexts), train)]

    found = scratch.table(blocks.totals(blocked, keys_of, parts), "ngrams")
    total, distinct = blocks.stats(found).get(0, (0, 0))

    def look_up(block: pa.Table, totals: list[np.ndarray]) -> pa.Table:
        tokens, contexts, bounds, held = _tokens(block, folds)
        n = np.diff(bounds)
        train = np.repeat(~held, n)
        pairs = _pairs(tokens, contexts)
        known = unique(tokens)
        c_w = totals[0][np.searchsorted(known, tokens)].astype(np.int64)
        c_hw = totals[1][np.searchsorted(unique(pairs), pairs)].astype(np.int64)
        base = np.add.reduceat(np.log10((c_w + ALPHA) / (total + ALPHA * (distinct + 1))), bounds[:-1])
        cells = _deleted(tokens, pairs, c_w, c_hw, bounds, train, total, distinct) if train.any() else (np.empty(0, np.int64), np.empty(0, np.int64))
        rows = len(n)
        out = {
            "kind": [0] * rows + [1],
            "doc_id": [*block.column("doc_id").to_pylist(), None],
            "held_out": [*held.tolist(), None],
            "n_tokens": [*n.tolist(), None],
            "n_known": [*np.add.reduceat(c_w > 0, bounds[:-1], dtype=np.int64).tolist(), None],
            "base_score": [*base.tolist(), None],
            "words": [*(blocks.pack_counts(c_w[i:j]) for i, j in zip(bounds[:-1], bounds[1:], strict=True)), blocks.pack(cells[0])],
            "pairs": [*(blocks.pack_counts(c_hw[i:j]) for i, j in zip(bounds[:-1], bounds[1:], strict=True)), blocks.pack(cells[1])],
        }
        return pa.table(out, schema=blocks.arrow_schema(_DOC))

    looked = scratch.table(blocks.with_totals(blocked, found, look_up, _DOC, 2), "looked-up")
    scratch.drop(found)
    weights = _learn(looked)
    # c(START) is c(END): each training document has one of either.
    starts = _documents(docs, folds)

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = []
            for words, pairs in zip(batch.column("words"), batch.column("pairs"), strict=True):
                c_w, c_hw = (blocks.unpack_counts(x.as_py()).astype(np.float64) for x in (words, pairs))
                c_h = np.concatenate(([starts], c_w[:-1]))
                w = weights[np.minimum(_bucket(c_h), _BUCKETS - 1)]
                p = w[:, 0] * c_hw / np.maximum(c_h, 1) + w[:, 1] * c_w / max(total, 1) + w[:, 2] / (distinct + 1)
                scores.append(float(np.log10(p).sum()))
            kept = {x: batch.column(x) for x in ("doc_id", "held_out", "n_tokens", "n_known", "base_score")}
            yield pa.record_batch(kept | {"score": pa.array(scores, pa.float64())})

    rated = looked.where("kind = 0").mapInArrow(memory.released(rate), "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return rated.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")


def _documents(docs: DataFrame, folds: int) -> int:
    text = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return docs.where(F.crc32(text) % folds != 0).count()


def _deleted(tokens, pairs, c_w, c_hw, bounds, train, total, distinct) -> tuple[np.ndarray, np.ndarray]:  # noqa: ANN001
    """The block's training tokens by cell, each document's own counts deleted: cell numbers and how many tokens."""
    n = np.diff(bounds)
    doc = np.repeat(np.arange(len(n)), n)
    own_w, own_hw = _own(tokens, doc), _own(pairs, doc)
    first = np.zeros(len(tokens), dtype=bool)
    first[bounds[:-1]] = True
    # What precedes a token is the token before it; its own count of contexts is that token's count. END is one a document.
    c_h = np.concatenate(([0], c_w[:-1])) - np.concatenate(([0], own_w[:-1]))
    last = bounds[1:] - 1
    c_h[bounds[:-1]] = c_w[last] - 1
    c_h, left_w, left_hw = (np.maximum(x[train], 0) for x in (c_h, c_w - own_w, c_hw - own_hw))
    rest = np.maximum(total - np.repeat(n, n)[train], 1)
    p0 = 1 / (distinct + 1)
    cell2 = _cell(np.where(c_h > 0, left_hw / np.maximum(c_h, 1), 0.0), p0)
    cell1 = _cell(left_w / rest, p0)
    code = (np.minimum(_bucket(c_h), _BUCKETS - 1) * (_TOP + 1) + cell2) * (_TOP + 1) + cell1
    codes = unique(code)
    return codes, np.bincount(np.searchsorted(codes, code), minlength=len(codes)).astype(np.int64)


def _learn(looked: DataFrame) -> np.ndarray:
    """EM on the cells of all blocks; at most one row for each cell comes to the driver."""

    def unroll(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for code, n in zip(batch.column("words"), batch.column("pairs"), strict=True):
                yield pa.record_batch({"code": blocks.unpack(code.as_py(), np.int64), "n": blocks.unpack(n.as_py(), np.int64)})

    cells = looked.where("kind = 1").select("words", "pairs").mapInArrow(memory.released(unroll), "code long, n long")
    rows = cells.groupBy("code").agg(F.sum("n").alias("n")).toPandas()
    code, n = rows["code"].to_numpy(dtype=np.int64), rows["n"].to_numpy(dtype=np.int64)
    width = _TOP + 1
    return expectation_maximisation(code // width // width, code // width % width, code % width, n)



"""Packing documents into sequences by patterns of lengths, chosen by non-negative least squares.

What the driver solves depends on the sequence length alone: the histogram of piece lengths has at most `capacity` entries. Patterns
are multisets of few lengths that fill a sequence; non-negative least squares fits how often to repeat each so that together they
use up the histogram; the repeats are rounded down to what is there, and best fit packs the remaining pieces, many equal ones at
a time. The outcome is a table of slots: length, first rank, how many sequences, first sequence, place. Pieces are ranked within
their length across the cluster, and each finds its slot by its rank.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from touchline.llm import memory, scratch

#: Beyond these characters two libraries' Unicode classes may differ, and texts go to the tokenizer itself.
_RARE = re.compile("[^\\t\\n\\r -\\x7e\\xa1-\\u024f\\u2010-\\u2027]")
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Rows of a bucket in which pieces are ranked.
BUCKET_ROWS = 20_000


def patterns(capacity: int, lengths: np.ndarray) -> np.ndarray:
    """All multisets of one to three of these lengths that fill the capacity exactly, as rows of three lengths (0: none)."""
    have = np.zeros(capacity + 1, dtype=bool)
    have[lengths] = True
    out = [[capacity, 0, 0]] if have[capacity] else []
    two = np.array([[capacity - x, x, 0] for x in range(1, capacity // 2 + 1) if have[x] and have[capacity - x]], dtype=np.int64).reshape(-1, 3)
    three = []
    for x in np.flatnonzero(have[: capacity // 3 + 1]):
        y = np.arange(max(x, 1), (capacity - x) // 2 + 1)
        if x:
            y = y[have[y] & have[capacity - x - y]]
            three.append(np.stack([capacity - x - y, y, np.full(len(y), x)], axis=1))
    return np.concatenate([np.array(out, dtype=np.int64).reshape(-1, 3), two, *three]).astype(np.int64)


def non_negative_least_squares(rows: np.ndarray, target: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Repeats x >= 0 of the patterns that make the used counts of lengths nearest to target, by accelerated projected gradients."""
    n = len(target)
    weight = np.arange(n, dtype=float)
    weight[0] = 0
    weight /= max(n - 1, 1)
    flat = rows.ravel()
    used = lambda x: np.bincount(flat, np.repeat(x, 3), n)
    back = lambda r: r[rows].sum(axis=1)
    scale = weight**2
    v = np.ones(len(rows))
    for _ in range(12):  # the largest curvature, by power iteration
        v = back(scale * used(v))
        norm = np.linalg.norm(v) or 1.0
        v /= norm
    step = 1 / (1.05 * norm)
    x = np.zeros(len(rows))
    ahead, t = x, 1.0
    for _ in range(rounds):
        new = np.maximum(ahead - step * back(scale * (used(ahead) - target)), 0)
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        ahead = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x


def _residual(left: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing on counts: equal pieces go together into equal gaps. [(lengths of a sequence, repeats)]."""
    gaps: dict[int, list[list]] = {}
    open_gaps = np.zeros(capacity + 1, dtype=bool)

    def put(lengths: tuple[int, ...], gap: int, n: int) -> None:
        gaps.setdefault(gap, []).append([lengths, n])
        open_gaps[gap] = True

    for length in range(capacity, 0, -1):
        n = int(left[length])
        while n:
            fits = np.flatnonzero(open_gaps[length:])
            if len(fits):
                gap = int(fits[0]) + length
                group = gaps[gap][-1]
                k = min(n, group[1])
                group[1] -= k
                lengths = group[0]
                if not group[1]:
                    gaps[gap].pop()
                    open_gaps[gap] = bool(gaps[gap])
                put((*lengths, length), gap - length, k)
                n -= k
            else:
                each = capacity // length  # new sequences: as many of this length as fit
                full, rest = divmod(n, each)
                if full:
                    put((length,) * each, capacity - each * length, full)
                if rest:
                    put((length,) * rest, capacity - rest * length, 1)
                n = 0
    return [(lengths, n) for groups in gaps.values() for lengths, n in groups]


def plan(histogram: np.ndarray) -> tuple[np.ndarray, int]:
    """Slots (length, first rank, sequences, first sequence, place), sorted by the first two, and the number of sequences.

    histogram[l] is how many pieces have length l; its last index is the capacity.
    """
    capacity = len(histogram) - 1
    left = histogram.astype(np.int64).copy()
    chosen: list[tuple[tuple[int, ...], int]] = []
    if left[capacity]:
        chosen.append(((capacity,), int(left[capacity])))
        left[capacity] = 0
    lengths = np.flatnonzero(left)
    if len(lengths):
        rows = patterns(capacity, lengths)
        if len(rows):
            x = non_negative_least_squares(rows, left.astype(float))
            for i in np.argsort(-x, kind="stable"):
                n = int(round(x[i]))
                if not n:
                    break
                own = [int(v) for v in rows[i] if v]
                n = min(n, *(int(left[v]) // own.count(v) for v in own))
                if n > 0:
                    for v in own:
                        left[v] -= n
                    chosen.append((tuple(own), n))
        chosen += _residual(left, capacity)
    slots, rank, sequence = [], np.zeros(capacity + 1, dtype=np.int64), 0
    for own, n in chosen:
        place = 0
        for v in own:
            slots.append((v, rank[v], n, sequence, place))
            rank[v] += n
            place += v
        sequence += n
    table = np.array(slots, dtype=np.int64).reshape(-1, 5)
    return table[np.lexsort((table[:, 1], table[:, 0]))], sequence


@lru_cache(maxsize=2)
def _encoder(path: str):  # noqa: ANN202
    """The ids of texts, under the vocabulary file of a byte-level BPE tokenizer."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)
    fast = _same_ids(path, whole)
    if fast:
        return fast
    return lambda texts: [np.array(x.ids, dtype=np.uint32) for x in whole.encode_batch(texts, add_special_tokens=False)]


def _same_ids(path: str, whole):  # noqa: ANN001, ANN202
    """The file's own ranks under tiktoken, which gives the same ids about four times as fast; None if the file has other steps."""
    import json

    import tiktoken

    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    pre = spec.get("pre_tokenizer") or {}
    if spec["model"].get("type", "BPE") != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or spec.get("normalizer") or spec["model"].get("dropout"):
        return None
    special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
    byte_of = _bytes_of_letters()
    ranks = {bytes(byte_of[c] for c in piece): i for piece, i in spec["model"]["vocab"].items() if piece not in special}
    if len(ranks) + len(special) < len(spec["model"]["vocab"]):
        return None
    # The ids must grow in the order of merges for ranks to be ids; the first 256 are single bytes.
    merged = [spec["model"]["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in spec["model"]["merges"]]
    if merged != sorted(merged):
        return None
    split = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    fast = tiktoken.Encoding("own", pat_str=split, mergeable_ranks=ranks, special_tokens={})

    def encode(texts: list[str]) -> list[np.ndarray]:
        out = []
        for text in texts:
            if _RARE.search(text) or any(x in text for x in special):  # special tokens are found in texts
                out.append(np.array(whole.encode(text, add_special_tokens=False).ids, dtype=np.uint32))
            else:
                out.append(np.array(fast.encode_ordinary(text), dtype=np.uint32))
        return out

    return encode


def _bytes_of_letters() -> dict[str, int]:
    """Byte-level BPE writes printable bytes as themselves and the others, in order, as the letters from U+0100."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


def pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int) -> DataFrame:
    """One row per piece: documents' ids and the end id, cut from behind into pieces of the capacity."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer)
        for batch in batches:
            rows: dict[str, list] = {x: [] for x in ("doc_id", "piece", "start", "length", "ids_crc32")}
            for at in range(0, len(batch), 64):
                part = batch.slice(at, 64)
                for doc_id, ids in zip(part.column("doc_id").to_pylist(), encoder(part.column("text").to_pylist()), strict=True):
                    ids = np.append(ids, np.uint32(end_id))
                    cuts = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)]
                    for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                        for name, x in zip(rows, (doc_id, i, a, b - a, zlib.crc32(ids[a:b].astype("<u4").tobytes())), strict=True):
                            rows[name].append(x)
            yield pa.record_batch([pa.array(rows["doc_id"], pa.int64()), pa.array(rows["piece"], pa.int32()), *(pa.array(rows[x], pa.int64()) for x in ("start", "length", "ids_crc32"))], names=list(rows))

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return texts.mapInArrow(memory.released(encode), _PIECES)


def pack(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    docs needs doc_id and text; a null text is empty, and an empty text is its end id alone. Repeated rows are packed once each, also
    under one doc_id. Documents over the capacity are cut into pieces of it, the first of which may be shorter. Sequences are numbered from 0 and filled
    from offset 0 without gaps. An empty table gives no rows. Which of several equally long pieces goes where depends on doc_id,
    piece and checksum only.
    """
    cut = scratch.table(pieces(docs, tokenizer, capacity, end_id), "pieces")
    buckets = cut.count() // BUCKET_ROWS + 1
    cut = cut.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)).cast("int"))
    counts = cut.groupBy("bucket", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = scratch.table(counts.select("bucket", "length", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")), "lengths")
    histogram = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in counts.groupBy("length").agg(F.sum("n")).collect():  # at most `capacity` rows
        histogram[length] = n
    slots, _ = plan(histogram)
    first = np.searchsorted(slots[:, 0], np.arange(capacity + 2))
    order = Window.partitionBy("bucket", "length").orderBy("doc_id", "piece", "ids_crc32", "start")
    ranked = cut.withColumn("row", F.row_number().over(order) - 1).join(counts.drop("n"), ["bucket", "length"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("row")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            at = np.empty(len(length), dtype=np.int64)
            for v in np.unique(length):
                a, b, own = first[v], first[v + 1], length == v
                at[own] = a + np.searchsorted(slots[a:b, 1], rank[own], side="right") - 1
            found = slots[at]
            kept = {x: batch.column(x) for x in ("doc_id", "piece", "start", "length", "ids_crc32")}
            yield pa.record_batch(kept | {"sequence_id": pa.array(found[:, 3] + rank - found[:, 1]), "offset": pa.array(found[:, 4])})

    return ranked.mapInArrow(memory.released(place), f"{_PIECES}, sequence_id long, offset long")

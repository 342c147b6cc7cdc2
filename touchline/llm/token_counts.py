"""Token counts under a unigram model, by dynamic programming over a trie of pre-tokens.

A text is cut into pre-tokens before each run of spaces, which no vocabulary piece crosses. The distinct pre-tokens of many
documents are sorted, which walks their trie in depth-first order: a pre-token keeps the forward scores of the prefix that it
shares with the one before, and only the nodes below are computed. Each node holds the best score of its prefix, the number of
tokens of the best segmentation and the way back; a terminal node's number is stored and counted for all its occurrences.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Documents that share a trie, and distinct pre-tokens whose counts a worker keeps.
DOCUMENTS, KEPT = 4096, 200_000
_SPACE = "▁"
_CUT = re.compile(f"{_SPACE}+[^{_SPACE}]*|[^{_SPACE}]+")
_BYTE = re.compile(r"<0x[0-9A-F]{2}>")


@lru_cache(maxsize=2)
def vocabulary(path: str) -> tuple[dict[str, float], float]:
    """Log-probabilities of the pieces of a sentencepiece file, and that of an unknown character.

    Files of merge ranks have no probabilities: the i-th piece then gets those of Zipf's law, -log(i + 2).
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    scores = [model.get_score(i) for i in pieces]
    ranks = all(s <= 0 and float(s).is_integer() for s in scores)
    table = {model.id_to_piece(i): (-math.log(n + 2) if ranks else s) for n, (i, s) in enumerate(zip(pieces, scores, strict=True))}
    return table, min(table.values()) - 10


def count_pretokens(words: list[str], pieces: dict[str, float], unknown: float) -> list[int]:
    """For sorted distinct pre-tokens, the tokens of each one's best segmentation; on equal scores the one with fewer tokens.

    A character that no piece covers is one token for each of its UTF-8 bytes.
    """
    out = []
    before, score, tokens = "", [0.0], [0]
    by_end: dict[str, list[int]] = {}
    for piece in pieces:
        ends = by_end.setdefault(piece[-1], [])
        if len(piece) not in ends:
            ends.append(len(piece))
    for ends in by_end.values():
        ends.sort()
    none: list[int] = []
    get, infinite = pieces.get, -math.inf
    for word in words:
        n, shared = len(word), 0
        for a, b in zip(before, word, strict=False):
            if a != b:
                break
            shared += 1
        del score[shared + 1 :], tokens[shared + 1 :]
        for end in range(shared + 1, n + 1):
            best, count = infinite, 0
            last = word[end - 1]
            for length in by_end.get(last, none):
                if length > end:
                    break
                p = get(word[end - length : end])
                if p is not None:
                    s = score[end - length] + p
                    if s > best or s == best and tokens[end - length] + 1 < count:
                        best, count = s, tokens[end - length] + 1
            if last not in pieces:
                s = score[end - 1] + unknown
                if s > best:
                    best, count = s, tokens[end - 1] + len(last.encode())
            score.append(best)
            tokens.append(count)
        out.append(tokens[n])
        before = word
    return out


def count(docs: DataFrame, model: str) -> DataFrame:
    """One row per document: doc_id, n_chars, n_pretokens, n_tokens.

    docs needs doc_id and text; model is a sentencepiece file, whose pieces make the vocabulary. A space begins the text, as such files
    expect, and counts as one with the word after it. Null and empty texts have no tokens. Repeated rows give a row each; an empty
    table gives none.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, unknown = vocabulary(model)
        known: dict[str, int] = {}
        for batch in batches:
            for at in range(0, len(batch), DOCUMENTS):
                part = batch.slice(at, DOCUMENTS)
                cut = [_CUT.findall(_SPACE + x.replace(" ", _SPACE)) if x else [] for x in part.column("text").to_pylist()]
                fresh = sorted(set().union(*cut) - known.keys())
                if len(known) + len(fresh) > KEPT:
                    fresh, known = sorted(set().union(*cut)), {}
                known.update(zip(fresh, count_pretokens(fresh, pieces, unknown), strict=True))
                get = known.__getitem__
                yield pa.record_batch(
                    {
                        "doc_id": part.column("doc_id"),
                        "n_chars": part.column("n_chars"),
                        "n_pretokens": pa.array(map(len, cut), pa.int64()),
                        "n_tokens": pa.array([sum(map(get, x)) for x in cut], pa.int64()),
                    }
                )

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return texts.withColumn("n_chars", F.length("text").cast("long")).mapInArrow(counted, "doc_id long, n_chars long, n_pretokens long, n_tokens long")

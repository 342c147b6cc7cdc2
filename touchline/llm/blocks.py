"""Corpus-wide counts of wide key spaces (words, n-grams, shingles), returned to where the keys were read.

Documents are dealt into blocks of about BLOCK_BYTES of text. A block sends each distinct key once,
with its count, to the part that owns the key's range of hashes; the part adds up and sends the totals
back in the block's own order. A frequent key is one entry a block, never a row a document, so no
key makes a task larger than others. Keys travel as sorted differences in byte planes, which the
shuffle's compression shortens.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from touchline.llm import memory

BLOCK_BYTES = 8 << 20
PART_BYTES = 6 << 20
_SENT = "space int, part int, block int, keys binary, counts binary"
_TOTALS = "block int, space int, part int, totals binary"

#: From a block's Arrow table to its key spaces: for each, sorted distinct keys and their counts there.
KeysOf = Callable[[pa.Table], list[tuple[np.ndarray, np.ndarray]]]


def pack(x: np.ndarray) -> bytes:
    """Integers as byte planes."""
    width = x.dtype.itemsize
    return np.ascontiguousarray(np.ascontiguousarray(x).view(np.uint8).reshape(-1, width).T).tobytes()


def unpack(data: bytes, dtype: type) -> np.ndarray:
    """The inverse of pack()."""
    width = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(data, dtype=np.uint8).reshape(width, -1).T).view(dtype).ravel()


def pack_counts(x: np.ndarray) -> bytes:
    """Counts as byte planes of four bytes, or of eight where one does not fit, after a byte that says which."""
    width = 4 if x.max(initial=0) < 2**32 else 8
    return bytes([width]) + pack(x.astype(f"u{width}"))


def unpack_counts(data: bytes) -> np.ndarray:
    """The inverse of pack_counts()."""
    return unpack(memoryview(data)[1:], np.dtype(f"u{data[0]}"))


def pack_sorted(keys: np.ndarray) -> bytes:
    """Sorted unsigned 64-bit keys: first key and differences."""
    return pack(np.diff(keys, prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    """The inverse of pack_sorted()."""
    return np.cumsum(unpack(data, np.uint64), dtype=np.uint64)


def size(docs: DataFrame) -> tuple[int, int]:
    """Blocks and parts for a corpus: they grow with its bytes."""
    total = docs.select(F.sum(F.octet_length(F.coalesce("text", F.lit(""))) + 16)).first()[0] or 0
    return int(total // BLOCK_BYTES + 1), int(total // PART_BYTES + 1)


def dealt(docs: DataFrame, blocks: int) -> DataFrame:
    """doc_id and text (null: empty), with a block by their hash, so that neither a common text nor a common id gathers."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn(
        "block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int")
    )


def texts_of(block: pa.Table) -> list[bytes]:
    """The texts of a block as UTF-8."""
    return [bytes(x) for column in block.column("text").chunks for x in _binaries(column)]


def _binaries(column: pa.Array) -> Iterator[memoryview]:
    for x in column.cast(pa.large_binary()) if pa.types.is_large_string(column.type) else column.cast(pa.binary()):
        yield x.as_buffer()


def _cuts(keys: np.ndarray, parts: int) -> np.ndarray:
    """Where each part's range of hashes begins among sorted keys, and the end."""
    edges = np.array([(i << 64) // parts for i in range(1, parts)], dtype=np.uint64)
    return np.concatenate(([0], np.searchsorted(keys, edges), [len(keys)])).astype(np.int64)


def totals(blocked: DataFrame, keys_of: KeysOf, parts: int) -> DataFrame:
    """For each block, key space and part: the totals over all blocks of its keys there, packed by pack_counts().

    A row with block -1 for each space and part has three int64 instead: the sum of all counts, the distinct keys with a
    count and the largest total.
    """

    def send(key: tuple, block: pa.Table) -> pa.Table:
        memory.release()  # what the group before has freed
        rows: dict[str, list] = {x: [] for x in ("space", "part", "block", "keys", "counts")}
        for space, (keys, counts) in enumerate(keys_of(block)):
            cuts = _cuts(keys, parts)
            for part in np.flatnonzero(np.diff(cuts)):
                a, b = cuts[part], cuts[part + 1]
                rows["space"].append(space)
                rows["part"].append(int(part))
                rows["block"].append(key[0].as_py())
                rows["keys"].append(pack_sorted(keys[a:b]))
                rows["counts"].append(pack_counts(counts[a:b]))
        return pa.table(rows, schema=_arrow(_SENT))

    def add(key: tuple, sent: pa.Table) -> pa.Table:
        memory.release()  # what the group before has freed
        space, part = (x.as_py() for x in key)
        keys = [unpack_sorted(x.as_py()) for x in sent.column("keys")]
        ends = np.cumsum([0] + [len(x) for x in keys])
        counts = np.concatenate([unpack_counts(x.as_py()) for x in sent.column("counts")])
        flat = np.concatenate(keys)
        del keys
        order = np.argsort(flat, kind="stable")
        flat = flat[order]
        first = np.flatnonzero(np.concatenate(([True], flat[1:] != flat[:-1])))
        sums = np.add.reduceat(counts[order].astype(np.int64), first)
        kind = np.uint32 if sums.max() < 2**32 else np.uint64
        back = np.empty(len(flat), dtype=kind)
        back[order] = np.repeat(sums.astype(kind), np.diff(np.append(first, len(flat))))
        blocks = [x.as_py() for x in sent.column("block")]
        stats = np.array([sums.sum(), (sums > 0).sum(), sums.max()], dtype=np.int64)
        rows = {
            "block": [*blocks, -1],
            "space": [space] * (len(blocks) + 1),
            "part": [part] * (len(blocks) + 1),
            "totals": [*(pack_counts(back[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)), stats.tobytes()],
        }
        return pa.table(rows, schema=_arrow(_TOTALS))

    sent = blocked.groupBy("block").applyInArrow(send, _SENT)
    return sent.groupBy("space", "part").applyInArrow(add, _TOTALS)


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "double": pa.float64(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "string": pa.string()}
    return pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in ddl.split(", "))])


arrow_schema = _arrow


def stats(found: DataFrame) -> dict[int, tuple[int, int]]:
    """Per key space: the sum of all counts, and the distinct keys with a count. Reads one short row a part."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [np.frombuffer(v, dtype=np.int64) for v in batch.column("totals").to_pylist()]
            yield pa.record_batch({"space": batch.column("space"), "n": pa.array([int(v[0]) for v in x], pa.int64()), "d": pa.array([int(v[1]) for v in x], pa.int64())})

    rows = found.where("block = -1").mapInArrow(read, "space int, n long, d long").groupBy("space").agg(F.sum("n"), F.sum("d")).collect()
    return {r[0]: (r[1], r[2]) for r in rows}


def with_totals(blocked: DataFrame, found: DataFrame, use: Callable[[pa.Table, list[np.ndarray]], pa.Table], schema: str, spaces: int) -> DataFrame:
    """Apply use(block, totals of each key space in the block's key order) to each block."""

    def apply(key: tuple, block: pa.Table, rows: pa.Table) -> pa.Table:
        memory.release()  # what the group before has freed
        if not len(block):
            return pa.table({x.name: [] for x in _arrow(schema)}, schema=_arrow(schema))
        by = sorted(zip(rows.column("space").to_pylist(), rows.column("part").to_pylist(), rows.column("totals").to_pylist(), strict=True), key=lambda x: x[:2])
        each = [[unpack_counts(t) for s, _, t in by if s == space] for space in range(spaces)]
        return use(block, [np.concatenate(x) if x else np.empty(0, dtype=np.uint32) for x in each])

    kept = found.where("block >= 0").select("block", "space", "part", "totals")
    return blocked.groupBy("block").cogroup(kept.groupBy("block")).applyInArrow(apply, T._parse_datatype_string(schema))

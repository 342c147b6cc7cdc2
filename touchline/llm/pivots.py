"""Near duplicates among embeddings by a pivot-permutation index.

Reference points (pivots) are drawn from the vectors. Each vector is described by its nearest pivots, in order; an inverted list for each
label and pivot holds the vectors that have the pivot among their nearest. Two vectors are candidates when they share enough pivots,
and are then verified by their cosine in double precision. Equal vectors are one entry with a count.

A list is met block by block, so a list of any length is many small tasks, and within a meeting the shared pivots of all pairs are
one matrix product. A pair is looked at in the list of the first pivot that both share and nowhere else, so each vector's links
are counted without writing a pair; of the links themselves only a spanning forest of each meeting goes on to the components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm import blocks, scratch
from touchline.llm.components import components

#: Pivots grow with the root of the number of vectors, up to MOST_PIVOTS, which bounds what each task holds. They come from a hashed sample of the vectors of
#: OVERSAMPLE times as many; one that has a cosine of APART or more with an earlier one is passed over, else a dense group would hold many of them, and
#: which of those are its members' nearest would be chance. Where that leaves less than half of the pivots, because all vectors are near one another, the limit goes
#: half the way to 1, up to TRIES times.
LEAST_PIVOTS, MOST_PIVOTS, OVERSAMPLE, APART, TRIES = 64, 4096, 4, 0.7, 5
#: Nearest pivots that describe a vector, and how many two vectors must share.
NEAREST, SHARED = 10, 4
#: Entries of a block of a list.
BLOCK = 512

_ENTRY = "label int, pivot int, rep long, copies long, nearest array<int>, unit array<double>"


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding as doubles and label, of vectors that may link: with a label, and a finite direction."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("int").alias("label"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return rows.where(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & finite & F.exists("embedding", lambda x: x != 0))


def _unit(batch: pa.RecordBatch, name: str, size: int) -> np.ndarray:
    x = np.asarray(batch.column(name).flatten(), dtype=np.float64).reshape(-1, size)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # else tiny or huge vectors lose their length
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _spread(x: np.ndarray, k: int) -> np.ndarray:
    """The first k unit vectors of which none is near an earlier one."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    x = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    out = np.empty((k, x.shape[1]))
    apart = APART
    for _ in range(TRIES):
        n = 0
        for v in x:
            if n < k and (not n or (out[:n] @ v).max() < apart):
                out[n] = v
                n += 1
        if 2 * n >= min(k, len(x)):
            break
        apart = (1 + apart) / 2
    return out[:n]


def _entries(classes: DataFrame, pivots: dict[int, np.ndarray], nearest: int) -> DataFrame:
    """Each class once for each of its nearest pivots."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for size in sorted(set(batch.column("size").to_pylist())):
                rows = batch.filter(pa.compute.equal(batch.column("size"), size))
                x = _unit(rows, "embedding", size)
                points = pivots[size]
                k = min(nearest, len(points))
                for at in range(0, len(x), 2048):
                    part, held = x[at : at + 2048], rows.slice(at, 2048)
                    near = part @ points.T
                    top = np.argpartition(-near, k - 1, axis=1)[:, :k]
                    top = np.take_along_axis(top, np.argsort(np.take_along_axis(-near, top, axis=1), axis=1, kind="stable"), axis=1).astype(np.int32)
                    repeat = np.repeat(np.arange(len(part)), k)
                    yield pa.record_batch(
                        [
                            *(held.column(c).take(pa.array(repeat)) for c in ("label",)),
                            pa.array(top.ravel()),
                            *(held.column(c).take(pa.array(repeat)) for c in ("rep", "copies")),
                            pa.ListArray.from_arrays(pa.array(np.arange(len(repeat) + 1) * k, pa.int32()), pa.array(top[repeat].ravel())),
                            pa.ListArray.from_arrays(pa.array(np.arange(len(repeat) + 1) * size, pa.int32()), pa.array(part[repeat].ravel())),
                        ],
                        names=["label", "pivot", "rep", "copies", "nearest", "unit"],
                    )

    return classes.mapInArrow(describe, _ENTRY)


def _meet(pivot: int, a: pa.Table, b: pa.Table, shared: int, threshold: float, n_pivots: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of entries of two blocks of a list that share enough pivots, this one first, and are near enough."""

    def held(x: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        rows = x.combine_chunks()
        near = np.asarray(rows.column("nearest").combine_chunks().flatten()).reshape(len(x), -1)
        unit = np.asarray(rows.column("unit").combine_chunks().flatten()).reshape(len(x), -1)
        return near, unit

    (near_a, unit_a), (near_b, unit_b) = held(a), held(b)
    used, flat = np.unique(np.concatenate([near_a.ravel(), near_b.ravel()]), return_inverse=True)
    marks = np.zeros((len(near_a) + len(near_b), len(used)), dtype=np.float32)
    marks[np.repeat(np.arange(len(marks)), near_a.shape[1]), flat] = 1
    mark_a, mark_b = marks[: len(near_a)], marks[len(near_a) :]
    before = used < pivot
    candidates = (mark_a @ mark_b.T >= shared) & (mark_a[:, before] @ mark_b[:, before].T == 0)
    i, j = np.nonzero(candidates)
    near = np.empty(len(i), dtype=bool)
    for at in range(0, len(i), 1 << 16):
        s = slice(at, at + (1 << 16))
        near[s] = (unit_a[i[s]] * unit_b[j[s]]).sum(axis=1) >= threshold
    return i[near], j[near]


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, nearest: int = NEAREST, shared: int = SHARED, n_pivots: int | None = None) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    vectors needs vec_id, embedding and label. Vectors are compared when their labels are equal and not null and their lengths agree, by
    cosine in double precision. Vectors that are null, empty, zero or hold a null or non-finite component link with nothing. n_links counts the other vectors that a
    vector links with; component_id is the smallest vec_id that links reach, kept tells whether that is the vector itself.
    Repeated rows with one vec_id are one vector to the links and give a row each; vectors under a null id link with nothing and
    have a null component. Links are found with the recall that the tests measure, and none below the threshold. An empty table gives no rows.
    """
    rows = usable(vectors)
    held = rows.groupBy("vec_id", "label", "embedding").agg(F.lit(1).alias("one")).drop("one")
    classes = held.groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    classes = scratch.table(classes.withColumn("size", F.size("embedding")), "vectors")
    sizes = {r[0]: r[1] for r in classes.groupBy("size").count().collect()}
    pivots = {}
    for size, n in sizes.items():
        k = min(n, n_pivots or int(min(MOST_PIVOTS, max(LEAST_PIVOTS, 2 * n**0.5))))
        chosen = classes.where(F.col("size") == size).orderBy(F.xxhash64("rep"), "rep").select("embedding").limit(OVERSAMPLE * k).toPandas()
        pivots[size] = _spread(np.stack(chosen["embedding"].to_list()).astype(np.float64), k)
    entries = scratch.table(_entries(classes, pivots, nearest).withColumn("size", F.size("unit")), "entries", codec="lz4")
    lists = entries.groupBy("size", "label", "pivot").count().where("count > 1")
    lists = lists.withColumn("parts", F.ceil(F.col("count") / BLOCK).cast("int")).drop("count")
    # Part p of a list meets parts p..parts - 1: an entry goes to each meeting of its part.
    own = F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int")
    placed = entries.join(lists, ["size", "label", "pivot"]).withColumn("part", own)
    meetings = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda q: F.struct(F.least("part", q).alias("low"), F.greatest("part", q).alias("high")))
    placed = placed.select("size", "label", "pivot", "part", "rep", "copies", "nearest", "unit", F.inline(meetings))
    enough = {size: min(shared, len(x)) for size, x in pivots.items()}

    def meet(key: tuple, rows: pa.Table) -> pa.Table:
        size, _, pivot, low, high = (x.as_py() for x in key)
        part = np.asarray(rows.column("part"))
        a, b = rows.filter(pa.array(part == low)), rows.filter(pa.array(part == high))
        found: dict[str, list] = {"kind": [], "a": [], "b": []}
        if len(a) and len(b):
            i, j = _meet(pivot, a, b, enough[size], threshold, len(pivots[size]))
            if low == high:
                i, j = i[i < j], j[i < j]
            rep_a, rep_b = np.asarray(a.column("rep")), np.asarray(b.column("rep"))
            n_a, n_b = np.asarray(a.column("copies")), np.asarray(b.column("copies"))
            links = dict.fromkeys([*rep_a.tolist(), *rep_b.tolist()], 0)
            for ids, sums in ((rep_a, np.bincount(i, n_b[j], len(rep_a))), (rep_b, np.bincount(j, n_a[i], len(rep_b)))):
                for rep, n in zip(ids.tolist(), sums.astype(np.int64).tolist(), strict=True):
                    links[rep] += n
            counted = [(r, n) for r, n in links.items() if n]
            forest = _forest(rep_a[i], rep_b[j])
            found = {"kind": [0] * len(counted) + [1] * len(forest), "a": [r for r, _ in counted] + [x for x, _ in forest], "b": [n for _, n in counted] + [y for _, y in forest]}
        return pa.table(found, schema=blocks.arrow_schema("kind int, a long, b long"))

    met = placed.groupBy("size", "label", "pivot", "low", "high").applyInArrow(meet, "kind int, a long, b long")
    met = scratch.table(met, "met")
    counts = met.where("kind = 0").groupBy(F.col("a").alias("rep")).agg(F.sum("b").alias("links"))
    near = components(met.where("kind = 1").select("a", "b"))
    known = classes.select("label", "embedding", "rep", "copies").join(counts, "rep", "left").join(near.withColumnRenamed("id", "rep"), "rep", "left")
    known = known.select("label", "embedding", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component_id", "rep").alias("component_id"))
    every = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("int").alias("label"))
    found = held.join(known.where("n_links > 0"), ["label", "embedding"]).groupBy("vec_id").agg(F.sum("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    out = every.select("vec_id").join(found, "vec_id", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))


def _forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect what all given links connect: each id with the smallest it reaches."""
    if not len(a):
        return []
    ids, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a) :]
    label = np.arange(len(ids))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        new = np.minimum(new, new[new])
        if (new == label).all():
            break
        label = new
    return [(int(ids[i]), int(ids[r])) for i, r in enumerate(label.tolist()) if r != i]

"""N-gram Jaccard join by prefix filters under several global orders.

All orders put rare shingles first and break ties differently. If two sets of sizes n and m have a Jaccard likeness of t or
more, the first n - ceil(t * n) + 1 tokens of one and the first m - ceil(t * m) + 1 of the other share a token, under every
order. Candidates must share one under each of the three orders, must have fitting sizes and a fitting place of the shared
token, and are then verified on their whole sets.

A shingle that one document has cannot be shared, so a document whose prefix holds only such tokens links with nothing and
sends nothing on. Equal sets become one class first. Large groups of near copies would still meet in all pairs: so classes are
first linked as stars around the smallest id among those with the same smallest token under a plain hash order, and the prefix
join then only meets classes of different components. A link that it does not look at lies within a component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm import blocks, memory, scratch
from touchline.llm.components import components
from touchline.llm.words import hash_words, mix, shingles

_SALTS = [np.uint64(x) for x in (0, 0xA24BAED4963EE407, 0x9FB21C651E98DF25)]
#: Document frequencies are counted on 48 of a shingle's 64 bits. Where two shingles meet there, both have the sum: still one order.
_MASK = np.uint64(0xFFFFFFFFFFFF0000)
_SETS = "doc_id long, n long, sig_a long, sig_b long, mins array<long>, first array<long>, place array<int>, second array<long>, third array<long>, members binary"


#: Sets of a part of a prefix token's list.
BLOCK = 1024


def _sets(block: pa.Table, width: int) -> list[np.ndarray]:
    hashes, counts = hash_words(blocks.texts_of(block))
    ends = np.cumsum(counts)
    return [shingles(hashes[b - n : b], width) for b, n in zip(ends, counts, strict=True)]


def _signed(x: np.ndarray) -> list[int]:
    return x.view(np.int64).tolist()


def prefix_length(n: int, percent: int) -> int:
    return n - (percent * n + 99) // 100 + 1


def documents(docs: DataFrame, width: int, percent: int) -> tuple[DataFrame, int]:
    """For each document its set's size and signature; if it may link with another set, also its prefixes and the set. And how many salts a hot key needs: it grows with the blocks."""
    n_blocks, parts = blocks.size(docs)
    blocked = blocks.dealt(docs, n_blocks)

    def keys_of(block: pa.Table) -> list[tuple[np.ndarray, np.ndarray]]:
        keys = np.sort(np.concatenate([np.empty(0, np.uint64), *_sets(block, width)]) & _MASK)
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.empty(0, np.int64)
        return [(keys[first], np.diff(np.append(first, len(keys))))]

    def describe(block: pa.Table, totals: list[np.ndarray]) -> pa.Table:
        sets = _sets(block, width)
        (keys, _), frequency = keys_of(block)[0], totals[0]
        rows: dict[str, list] = {x.name: [] for x in blocks.arrow_schema(_SETS)}
        for doc_id, s in zip(block.column("doc_id").to_pylist(), sets, strict=True):
            n = len(s)
            sig_a, sig_b = int(mix(s).sum(dtype=np.uint64).view(np.int64)), int(mix(s ^ _SALTS[1]).sum(dtype=np.uint64).view(np.int64))
            prefixes: list = [None, None, None, None]
            mins = members = None
            p = prefix_length(n, percent)
            if n and 100 * n >= percent * (n + 1):  # else no other set is alike enough, not even one with a single token more
                df = frequency[np.searchsorted(keys, s & _MASK)]
                if (df == 1).sum() < p:
                    ties = [s, mix(s ^ _SALTS[1]), mix(s ^ _SALTS[2])]
                    orders = [np.lexsort((tie, df))[:p] for tie in ties]
                    shared = [x[df[x] > 1] for x in orders]
                    prefixes = [_signed(s[shared[0]]), np.flatnonzero(df[orders[0]] > 1).tolist(), _signed(s[shared[1]]), _signed(s[shared[2]])]
                    mins = [int(mix(s ^ salt + np.uint64(7)).min().view(np.int64)) for salt in _SALTS]
                    members = blocks.pack_sorted(s)
            for name, x in zip(rows, (doc_id, n, sig_a, sig_b, mins, *prefixes, members), strict=True):
                rows[name].append(x)
        return pa.table(rows, schema=blocks.arrow_schema(_SETS))

    found = scratch.table(blocks.totals(blocked, keys_of, parts), "shingles")
    out = scratch.table(blocks.with_totals(blocked, found, describe, _SETS, 1), "sets")
    scratch.drop(found)
    return out, n_blocks + 16


def _shared(rows: DataFrame, keys: list[str], own: list, whole: list, salts: int) -> DataFrame:
    """rows with what all rows of a key have in common, also where one key has a large part of all rows.

    rows have a column salt, which deals each key's rows into at most `salts` groups; own aggregates a group, whole the key's groups.
    """
    groups = rows.groupBy(*keys, "salt").agg(*own)
    known = groups.select(*keys, "salt").join(groups.groupBy(*keys).agg(*whole), keys)
    return rows.join(known, [*keys, "salt"])


def _fetched(pairs: DataFrame, sets: DataFrame, x: str, columns: list[str]) -> DataFrame:
    """pairs with columns of their set x (a or b), which goes to several tasks if many pairs have it. pairs have a column salt."""
    row = sets.select(F.col("set").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in columns))
    return pairs.join(pairs.select(x, "salt").distinct().join(row, x), [x, "salt"])


def _verified(pairs: DataFrame, sets: DataFrame, percent: int, salts: int) -> DataFrame:
    """The pairs (a, b) of sets that share a prefix token under each order, and whose sets are alike enough.

    The prefixes are met first; only what all three filters leave fetches the sets.
    """
    orders = ["first", "second", "third"]
    pairs = pairs.withColumn("salt", F.pmod(F.xxhash64("a"), F.lit(salts)).cast("int"))
    row = lambda x, columns: sets.select(F.col("set").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in columns))
    light = _fetched(pairs.join(row("a", orders), "a"), sets, "b", orders)
    light = light.where(" and ".join(f"arrays_overlap({c}_a, {c}_b)" for c in orders)).select("a", "b", "salt")
    light = scratch.table(light, "candidates")
    both = _fetched(light.join(row("a", ["members"]), "a"), sets, "b", ["members"])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("members_a"), batch.column("members_b"), strict=True):
                s, t = blocks.unpack_sorted(x.as_py()), blocks.unpack_sorted(y.as_py())
                both_n = len(np.intersect1d(s, t, assume_unique=True))
                keep.append(100 * both_n >= percent * (len(s) + len(t) - both_n))
            yield pa.record_batch([batch.column(c) for c in ("a", "b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    out = both.select(F.col("a.rep").alias("a"), F.col("b.rep").alias("b"), "members_a", "members_b").mapInArrow(memory.released(check), "a long, b long")
    out = scratch.table(out.where("a <> b"), "links")
    scratch.drop(light)
    return out


def _fitting(percent: int) -> str:
    """The smaller of two sets that are alike enough has this percentage of the larger one's size."""
    return f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)"


def _stars(sets: DataFrame, salts: int) -> DataFrame:
    """Pairs (a, b) of each set with the least one of those that have the same smallest token under a plain hash order, for each order."""
    keyed = sets.select(F.col("set").alias("a"), F.col("n").alias("n_a"), F.posexplode("mins").alias("order", "least"))
    keyed = keyed.withColumn("salt", F.pmod(F.xxhash64("a"), F.lit(salts)).cast("int"))
    hub = F.min(F.struct(F.col("a").alias("b"), F.col("n_a").alias("n_b")))
    return _shared(keyed, ["order", "least"], [hub.alias("own")], [F.min("own").alias("hub")], salts).select("a", "n_a", "hub.b", "hub.n_b").where("a <> b")


def _meetings(tokens: DataFrame, percent: int, salts: int) -> DataFrame:
    """Pairs (a, b) of sets of different components that share a prefix token at a place that leaves room for enough others.

    tokens: set, n, first, place, near. A token's list is dealt into parts of BLOCK sets, and each two parts meet on their own.
    """
    tokens = tokens.withColumn("salt", F.pmod(F.xxhash64("set"), F.lit(salts)).cast("int"))
    own = [F.min("near").alias("low"), F.max("near").alias("high"), F.count("*").alias("size")]
    tokens = _shared(tokens, ["first"], own, [F.min("low").alias("low"), F.max("high").alias("high"), F.sum("size").alias("size")], salts).where("low < high")
    tokens = tokens.withColumn("parts", F.ceil(F.col("size") / BLOCK).cast("int")).withColumn("part", F.pmod(F.xxhash64("set", F.lit("part")), F.col("parts")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    side = lambda x, parts: tokens.select("first", *parts, *(F.col(c).alias(f"{c}_{x}") for c in ("set", "n", "place", "near")))
    a, b = side("a", [F.col("part").alias("part_a"), every.alias("part_b")]), side("b", [every.alias("part_a"), F.col("part").alias("part_b")])
    room = f"1 + least(n_a - 1 - place_a, n_b - 1 - place_b) >= {percent} * (n_a + n_b) / {100 + percent}"
    met = a.join(b, ["first", "part_a", "part_b"]).where(f"near_a < near_b and {_fitting(percent)} and {room}")
    return met.select(F.col("set_a").alias("a"), F.col("set_b").alias("b")).distinct()


def join(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id.

    docs needs doc_id and text. A-Z in lower case; words are runs without U+0020 and U+0009 to U+000D; the set holds the distinct
    sequences of `width` words, or the whole sequence if it is shorter. Two documents link when 100 * intersection >= percent *
    union; component_id is the smallest doc_id that links reach. Null and empty texts have no set and link with nothing.
    Repeated rows each give a row. Rows with one doc_id are one document to the links, whatever their texts: it links with all that any of them
    links with. A row with a null doc_id gets the component of its set if some document has that set, else null, and joins nothing. An empty table gives no rows.
    """
    described, salts = documents(docs, width, percent)
    same = ["sig_a", "sig_b", "n"]
    classes = described.where("n > 0").groupBy(*same).agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    classes = scratch.table(classes, "classes")
    # Of a class's rows, all with the same set, that of the least doc_id stays; a class is told from others under that id by its signature.
    sets = described.where("members is not null").join(classes.where("rep is not null").drop("copies").withColumnRenamed("rep", "doc_id"), ["doc_id", *same], "left_semi")
    sets = sets.dropDuplicates(["doc_id", *same]).select(F.struct(F.col("doc_id").alias("rep"), F.col("sig_a").alias("sig")).alias("set"), "n", "mins", "first", "place", "second", "third", "members")
    sets = scratch.table(sets, "class-sets")

    pairs = _stars(sets, salts).where(_fitting(percent)).select("a", "b").distinct()
    stars = _verified(pairs, sets, percent, salts)
    mixed = scratch.table(_mixed(described, same), "mixed-ids")
    first_links = stars.unionAll(mixed.where("n > 0").join(classes, same).where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")))
    near = scratch.table(components(first_links).withColumnRenamed("component_id", "near"), "near")

    tokens = sets.select("set", "n", F.explode(F.arrays_zip("first", "place")).alias("t")).select(F.col("set.rep").alias("id"), "set", "n", "t.first", "t.place")
    tokens = scratch.table(tokens.join(near, "id", "left").select("set", "n", "first", "place", F.coalesce("near", "id").alias("near")), "prefix-tokens")
    links = _verified(_meetings(tokens, percent, salts), sets, percent, salts)
    found = links.join(near.withColumnRenamed("id", "a"), "a", "left").withColumn("from", F.coalesce("near", "a")).drop("near")
    found = found.join(near.withColumnRenamed("id", "b"), "b", "left").withColumn("to", F.coalesce("near", "b"))
    far = scratch.table(components(found.select(F.col("from").alias("a"), F.col("to").alias("b"))).withColumnRenamed("component_id", "far"), "far")
    for done in (sets, stars, tokens, links):
        scratch.drop(done)

    known = classes.join(near.withColumnRenamed("id", "rep"), "rep", "left").withColumn("near", F.coalesce("near", "rep"))
    known = known.join(far.withColumnRenamed("id", "near"), "near", "left")
    known = known.select(*same, F.coalesce("far", "near").alias("component_id"), "rep", "copies").where("component_id <> rep or copies > 1")
    known = known.drop("rep", "copies")
    out = described.select("doc_id", *same).where("n > 0").join(known, same, "left").select("doc_id", "n", "component_id")
    beside = mixed.where("n > 0").join(known, same).groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
    out = out.unionAll(described.where("n = 0").select("doc_id", "n").join(beside, "doc_id", "left"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def _mixed(described: DataFrame, same: list[str]) -> DataFrame:
    """The doc_ids that have rows with different sets, or with a set and without, and each of these sets."""
    ids = described.where("doc_id is not null").groupBy("doc_id").agg(F.min("sig_a").alias("low"), F.max("sig_a").alias("high")).where("low < high").select("doc_id")
    return described.select("doc_id", *same).join(ids, "doc_id", "left_semi").distinct()


def distinct(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """docs' rows without near copies: of each component of join() a row of its smallest doc_id stays.

    Of several rows with that id the one with the least text stays (a null text comes last; of equal texts the row with the least hash of its columns).
    Rows with a null doc_id cannot be told apart and all stay.
    """
    kept = join(docs, width, percent).where("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("rows"))
    name, copies = "touchline_kept", "touchline_copies"
    kept = kept.select(F.col("doc_id").cast(docs.schema["doc_id"].dataType).alias(name), F.col("rows").alias(copies))
    rows = docs.where("doc_id is not null").join(kept, F.col("doc_id") == F.col(name))
    every = [F.col(f"`{c}`") for c in docs.columns]
    single = rows.where(F.col(copies) == 1).select(*every)
    order = F.struct(F.col("text").isNull(), F.col("text"), F.xxhash64(F.to_json(F.struct(*every))))
    several = rows.where(F.col(copies) > 1).groupBy(name).agg(F.min_by(F.struct(*every), order).alias("row")).select("row.*")
    return single.unionAll(several).unionAll(docs.where("doc_id is null"))

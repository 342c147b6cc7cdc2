"""Homomorphic multiset fingerprints of documents.

A document is the multiset of its paragraphs (lines). Each paragraph is hashed to a wide vector of numbers, and a document's
fingerprint is their sum modulo powers of two: the order of paragraphs does not matter, and adding or taking off a paragraph
adds or subtracts its vector (combine()). The vector has three sections:

* one number: how many word sequences the paragraph has;
* EXACT numbers modulo 2**32: independent hashes of the whole paragraph. They decide equality;
* WIDE numbers, each of two lanes modulo 2**16 (held in 32 bits each): for every sequence of three words of the paragraph,
  2 * WIDE random bits, one a lane. In the difference of two fingerprints, the lanes' squared distance from half the
  difference in count estimates how many sequences only one of the two has, so near texts have near fingerprints (likeness()).

Only DataFrame functions are used. Texts are dealt once, by ranges of doc_id; all later steps keep that partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.llm.ordering import bounds, held, range_of

EXACT, WIDE = 16, 64
_BOTH, _LOW = 0x0000000100000001, 0xFFFFFFFF
#: Rows of a range of doc_id, which is sorted as one group; ranges outnumber tasks.
RANGE_ROWS = 1024


def _hashes(column: Column, n: int, salt: str) -> list[Column]:
    return [F.xxhash64(F.lit(f"{salt}{i}"), column).bitwiseAND(F.lit(_LOW)) for i in range(n)]


def _sequences(words: Column) -> Column:
    """One hash for each word and the two after it, so that a line of n words has n. words: a column of its own, else it is made anew for each word."""
    return F.transform(words, lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))


def _sums(texts: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Per key the fingerprint of its text, as an array of 1 + EXACT + WIDE longs."""
    lines = texts.select(*keys, F.explode(F.split(F.col(text), "\n")).alias("line"))
    lines = lines.select(*keys, "line", F.filter(F.split("line", " "), lambda w: w != "").alias("words"))
    lines = lines.select(*keys, "line", F.posexplode_outer(_sequences(F.col("words"))).alias("nth", "gram"))
    once = F.coalesce(F.col("nth"), F.lit(0)) == 0
    parts = [F.count("gram").alias("v0")]
    parts += [F.sum(F.when(once, h).otherwise(F.lit(0).cast("long"))).alias(f"v{1 + i}") for i, h in enumerate(_hashes(F.col("line"), EXACT, "paragraph"))]
    # A hash gives 64 lanes: bits k and k + 32 for each k below 32.
    grams = [F.col("gram"), *(F.xxhash64(F.lit(f"bits{i}"), "gram") for i in range(1, WIDE // 32))]
    for k in range(WIDE):
        lanes = F.shiftrightunsigned(grams[k // 32], k % 32).bitwiseAND(F.lit(_BOTH))
        parts.append(F.sum(F.coalesce(lanes, F.lit(0).cast("long"))).alias(f"v{1 + EXACT + k}"))
    sums = lines.groupBy(*keys).agg(*parts)
    return sums.select(*keys, F.array(*(f"v{i}" for i in range(1 + EXACT + WIDE))).alias("vector"))


def combine(left: Column, right: Column, take_off: bool = False) -> Column:
    """The vector of both documents' paragraphs together; with take_off, of the left without the right's."""
    return F.zip_with(left, right, lambda a, b: a - b if take_off else a + b)


def digest(vector: Column) -> Column:
    """A vector as lowercase hexadecimal text: 8 digits for the count and each exact number, 4 for each lane."""
    whole = F.transform(F.slice(vector, 1, 1 + EXACT), lambda x: F.hex(x.bitwiseAND(F.lit(_LOW))))
    lanes = F.transform(F.slice(vector, 2 + EXACT, WIDE), lambda x: F.hex(F.shiftleft(_high(x).bitwiseAND(F.lit(0xFFFF)), 16).bitwiseOR(x.bitwiseAND(F.lit(0xFFFF)))))
    return F.lower(F.array_join(F.transform(F.concat(whole, lanes), lambda x: F.lpad(x, 8, "0")), ""))


def _low(x: Column) -> Column:
    return F.shiftright(F.shiftleft(x, 32), 32)


def _high(x: Column) -> Column:
    return F.shiftright(x - _low(x), 32)


def with_norm(df: DataFrame, vector: str, name: str) -> DataFrame:
    """Adds an estimate of the squared norm of a (difference of) multisets of sequences: the lanes' squares, less half the count each.

    The half is a column of its own, as a function over an array evaluates all it refers to for each element.
    """
    half = f"{name}_half"
    df = df.withColumn(half, F.floor(F.col(vector)[0] / 2).cast("long") * F.lit(_BOTH))

    def add(total: Column, x: Column) -> Column:
        low, high = _low(x - F.col(half)).cast("double"), _high(x - F.col(half)).cast("double")
        return total + low * low + high * high

    return df.withColumn(name, F.aggregate(F.slice(vector, 2 + EXACT, WIDE), F.lit(0.0), add) * (2.0 / WIDE)).drop(half)


def with_likeness(df: DataFrame, left: str, right: str, left_norm: str, right_norm: str, name: str) -> DataFrame:
    """Adds, from 0 to 1, the share of the word sequences that two fingerprints have in common (twice the shared over the sum)."""
    apart = f"{name}_apart"
    df = df.withColumn(f"{name}_difference", combine(F.col(left), F.col(right), take_off=True))
    df = with_norm(df, f"{name}_difference", apart)
    both = F.col(left_norm) + F.col(right_norm)
    near = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col(apart) / F.when(both > 0, both)))
    equal = F.col(left) == F.col(right)
    return df.withColumn(name, F.when(equal, 1.0).otherwise(F.coalesce(near, F.lit(0.0)))).drop(apart, f"{name}_difference")


def _tops(docs: DataFrame, own: Column) -> list[tuple[int, int]]:
    """For each range that has rows its number and largest doc_id, in ascending order."""
    return sorted((r, top) for r, top in docs.groupBy(own.alias("range")).agg(F.max("doc_id")).collect())


def in_order(docs: DataFrame) -> DataFrame:
    """Each document with the next one in descending order of doc_id (after the last: the first).

    Returns range, at (the place in the range), copy, doc_id, text, next_text. A range's first row is also a `copy` in the range
    above, so that the next text is found without another shuffle.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    own = range_of("doc_id", bounds(docs.select("doc_id"), "doc_id", RANGE_ROWS))
    tops = _tops(docs.select("doc_id"), own)
    lower = {above[0]: below[1] for below, above in zip(tops[:-1], tops[1:], strict=True)}
    into = sorted((top, r) for r, top in lower.items() if top is not None)
    homes = F.array(F.struct(own.alias("range"), F.lit(0).alias("copy")))
    first, last = (tops[-1][1], tops[0][0]) if tops else (None, 0)
    if into:
        up = range_of("doc_id", [top for top, _ in into])
        up = F.when(F.get(held([top for top, _ in into]), up) == F.col("doc_id"), F.get(held([r for _, r in into]), up).cast("int"))
        homes = F.when(up.isNotNull(), F.concat(homes, F.array(F.struct(up.alias("range"), F.lit(1).alias("copy"))))).otherwise(homes)
    around = F.col("doc_id").isNull() if first is None else F.col("doc_id") == first
    homes = F.when(around, F.concat(homes, F.array(F.struct(F.lit(last).alias("range"), F.lit(2).alias("copy"))))).otherwise(homes)
    placed = docs.select("doc_id", "text", F.inline(homes))
    order = Window.partitionBy("range").orderBy((F.col("copy") == 2), F.col("doc_id").desc_nulls_last(), F.col("copy"), F.col("text"))
    return placed.select("range", F.row_number().over(order).alias("at"), "copy", "doc_id", "text", F.lead("text").over(order).alias("next_text"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    docs needs doc_id and text. The edited text has its last floor(n_chars / 2) code points replaced by the first as many (or all)
    of the next document in descending order of doc_id; after the last comes the first, and a single document follows itself.
    A null text is empty; an empty text is one empty paragraph. Rows with one doc_id follow each other by text; null doc_ids come
    last. Texts that are equal as multisets of lines have equal fingerprints. An empty table gives no rows.
    """
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    rows = in_order(docs)
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.coalesce(F.substring(F.col("next_text"), F.lit(1), half), F.lit("")))
    rows = rows.withColumn("edited", edited)
    keys = ["range", "at", "copy", "doc_id", "n_chars", "edited_sha256", "edit"]
    both = rows.select("range", "at", "copy", "doc_id", n.cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), F.posexplode(F.when(F.col("copy") == 0, F.array("text", "edited")).otherwise(F.array("text"))).alias("edit", "body"))
    sums = _sums(both, keys, "body")
    sums = with_norm(sums, "vector", "norm")
    order = Window.partitionBy("range").orderBy("at", "edit")
    # After a document's own sum comes that of its edited text, then that of the next document.
    sums = sums.withColumns({f"{name}_{k}": F.lead(name, k).over(order) for name in ("vector", "norm") for k in (1, 2)})
    out = sums.where("edit = 0 and copy = 0")
    for k, name in ((1, "near_edited"), (2, "near_next")):
        out = with_likeness(out, "vector", f"vector_{k}", "norm", f"norm_{k}", name)
    return out.select("doc_id", "n_chars", "edited_sha256", digest(F.col("vector")).alias("fingerprint"), digest(F.col("vector_1")).alias("edited_fingerprint"), "near_edited", "near_next")

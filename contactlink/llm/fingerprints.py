"""Threshold-scaled document fingerprints: every word-shingle hash below a fixed fraction of the hash range is kept.

The sample depends on the hash alone, so sketches of documents of any length can be compared, and the sketch of a union
is the union of the sketches. A text none of whose hashes is small enough keeps its smallest one, so that only texts
without words have an empty sketch. All of it is column expressions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contactlink.llm.tables import exact

SHINGLE_WORDS = 5
FRACTION = 1 / 2
SPACES = "[ \\t\\n\\x0B\\f\\r]+"
SLICE_BITS = 10
LOWEST = -(1 << 63)


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once however often the body uses it, lambdas included."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACES), "")


def shingle_hashes(words_col: Column, size: int = SHINGLE_WORDS) -> Column:
    """Hashes of all runs of ``size`` words; of the whole sequence if it is shorter; none without words."""

    def hashes(w: Column) -> Column:
        n = F.size(w)
        runs = F.transform(F.sequence(F.lit(1), n - size + 1), lambda i: F.xxhash64(F.slice(w, i, size)))
        return F.when(n >= size, runs).when(n > 0, F.array(F.xxhash64(w))).otherwise(F.array().cast("array<bigint>"))

    return bound(words_col, hashes)


def scaled(hashes: Column, fraction: float = FRACTION) -> Column:
    """The sketch of a set of hashes."""
    limit = LOWEST + int(fraction * (1 << 64))

    def kept(all_hashes: Column) -> Column:
        lowest = F.when(F.size(all_hashes) > 0, F.array(F.array_min(all_hashes))).otherwise(all_hashes)
        return bound(F.filter(all_hashes, lambda h: h < F.lit(limit)), lambda small: F.when(F.size(small) > 0, small).otherwise(lowest))

    return F.sort_array(F.array_distinct(bound(hashes, kept)))


def sketch(text: Column, size: int = SHINGLE_WORDS, fraction: float = FRACTION) -> Column:
    """The sketch of a text; null counts as empty."""
    return scaled(shingle_hashes(words(F.coalesce(text, F.lit(""))), size), fraction)


def merged(a: Column, b: Column, fraction: float = FRACTION) -> Column:
    """The sketch of the union of two documents, from their sketches."""
    return scaled(F.array_union(a, b), fraction)


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity, 0 to 1; two empty sketches are equal."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def containment(a: Column, b: Column, fraction: float = FRACTION) -> Column:
    """Estimated share of ``a`` that is in ``b``, however much longer ``b`` is; 1 for an empty ``a`` and for equal sketches.
    Null where ``a`` has only the hash it keeps for want of a small one: a longer text's sketch cannot hold it, so it tells
    nothing."""
    limit = LOWEST + int(fraction * (1 << 64))
    share = F.size(F.array_intersect(a, b)) / F.size(a)
    return F.when((F.size(a) == 0) | (a == b), F.lit(1.0)).when(F.element_at(a, 1) < F.lit(limit), share)


def as_text(sketch_col: Column) -> Column:
    """The sketch as text: 16 hexadecimal digits for each hash."""
    return F.array_join(F.transform(sketch_col, lambda h: F.lower(F.hex(h))), "")


def fingerprint(df: DataFrame, text_col: str = "text", size: int = SHINGLE_WORDS, fraction: float = FRACTION) -> DataFrame:
    """Add ``sketch`` (sorted distinct hashes) and ``fingerprint`` (the same as text). No shuffle."""
    out = df.withColumn("sketch", sketch(exact(text_col), size, fraction))
    return out.withColumn("fingerprint", as_text(F.col("sketch")))


def _next_lower(keys: DataFrame, levels: int) -> DataFrame:
    """For distinct ``k``: the next lower one as ``after``, null for the lowest. Windows hold 2**SLICE_BITS keys each;
    only the heads of these slices go to the next level."""
    if levels == 0:
        return keys.withColumn("after", F.lead("k").over(Window.orderBy(F.desc("k"))))
    sliced = keys.withColumn("s", F.shiftright("k", SLICE_BITS))
    heads = sliced.groupBy("s").agg(F.max("k").alias("head"))
    order = _next_lower(heads.select(F.col("s").alias("k")), levels - 1)
    following = (
        order.filter("after IS NOT NULL").select(F.col("k").alias("s"), F.col("after").alias("s2"))
        .join(heads.select(F.col("s").alias("s2"), F.col("head").alias("next_head")), "s2").select("s", "next_head")
    )
    inside = F.lead("k").over(Window.partitionBy("s").orderBy(F.desc("k")))
    return sliced.withColumn("after", inside).join(following, "s", "left").select("k", F.coalesce("after", "next_head").alias("after"))


def with_next(df: DataFrame, id_col: str, value_col: str, derived: dict[str, Column], prefix: str = "next_") -> DataFrame:
    """Add ``derived`` columns, and ``value_col`` and them of the next row by descending id under ``prefix``; the last
    row is followed by the first.

    ``derived`` are expressions of ``value_col`` alone. Rows are dealt by slices of 2**SLICE_BITS ids, so no window grows
    with the table, and the table is shuffled once; besides, only the first row of each slice is. Derived columns are
    computed after that, for both values of a row, so none is shuffled. Rows without an id come last; rows with equal ids
    are ordered by value.
    """
    following_value = f"{prefix}{value_col}"
    keyed = df.withColumn("_k", F.coalesce(exact(id_col), F.lit(LOWEST))).withColumn("_s", F.shiftright("_k", SLICE_BITS))
    window = Window.partitionBy("_s").orderBy(F.desc("_k"), F.desc(value_col))
    following = keyed.withColumns({following_value: F.lead(value_col).over(window), "_more": F.lead(F.lit(True)).over(window)})
    heads = keyed.withColumn("_n", F.row_number().over(window)).filter("_n = 1").select("_s", F.col(value_col).alias("_head"))
    slices = keyed.select(F.col("_s").alias("k")).distinct()
    first = slices.agg(F.max("k")).first()[0]
    links = _next_lower(slices, 2).select(F.col("k").alias("_s"), F.coalesce("after", F.lit(first)).alias("_s2"))
    next_heads = links.join(heads.withColumnRenamed("_s", "_s2"), "_s2").select("_s", "_head")
    joined = following.join(next_heads, "_s", "left")
    joined = joined.withColumn(following_value, F.when(F.col("_more"), F.col(following_value)).otherwise(F.col("_head")))
    joined = joined.drop("_k", "_s", "_more", "_head")
    turned = joined.withColumnRenamed(value_col, "_own").withColumnRenamed(following_value, value_col)
    turned = turned.withColumns({f"{prefix}{c}": value for c, value in derived.items()})
    return turned.withColumnRenamed(value_col, following_value).withColumnRenamed("_own", value_col).withColumns(derived)


def edited_by_next(text: Column, next_text: Column) -> Column:
    """The last third of the code points replaced by the first as many of the next text."""
    n = F.char_length(text)
    third = F.floor(n / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - third), F.substring(next_text, F.lit(1), third))

"""How a chain of filters would act in every order, from sorted posting lists.

Each filter lists, part by part, the documents that fail it: sorted positions, kept for one range of document ids at a
time. What is left out after some filters is the union of their lists, what one more filter removes is the difference
between its list and that union; both are galloping merges of sorted lists. Sizes of ranges add up, and the numbers of
all orders are read off the sums: an order's step only depends on its filter and the set of filters before it.
"""

from __future__ import annotations

import heapq
import itertools
import math
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactlink.llm.tables import exact, field_type
from contactlink.operators.storage import materialize

#: Documents of one part whose lists are merged at a time.
RANGE_ROWS = 32_768
SPACE = " \\t-\\r"
UPPER, MARKS = "[A-Z]", "[#$%&*|]"


# --- sorted lists ----------------------------------------------------------------------


def gallop(items: list[int], low: int, bound: int) -> int:
    """The first place from ``low`` on whose item is not under ``bound``: doubling steps, then bisection."""
    n, step = len(items), 1
    while low + step < n and items[low + step] < bound:
        step *= 2
    return bisect_left(items, bound, low + step // 2, min(low + step + 1, n))


def union(lists: list[list[int]]) -> list[int]:
    """All items of sorted lists, once each."""
    heads = [(items[0], k, 0) for k, items in enumerate(lists) if items]
    heapq.heapify(heads)
    out: list[int] = []
    while len(heads) > 1:
        first, k, at = heads[0]
        bound = min(h[0] for h in heads[1:3])
        items = lists[k]
        if first == bound:  # the same item heads another list
            stop = at + 1
        else:
            stop = gallop(items, at, bound)
            out += items[at:stop]
        if stop < len(items):
            heapq.heapreplace(heads, (items[stop], k, stop))
        else:
            heapq.heappop(heads)
    for _, k, at in heads:
        out += lists[k][at:]
    return out


def difference(items: list[int], others: list[int]) -> list[int]:
    """The items of one sorted list that another does not have."""
    out: list[int] = []
    at = there = 0
    while at < len(items):
        there = gallop(others, there, items[at]) if there < len(others) else there
        if there >= len(others):
            return out + items[at:]
        if others[there] == items[at]:
            at += 1
        else:
            stop = gallop(items, at, others[there])
            out += items[at:stop]
            at = stop
    return out


def common(items: list[int], others: list[int]) -> int:
    """How many items both sorted lists have."""
    return len(items) - len(difference(items, others))


def range_sums(masks: np.ndarray, good: np.ndarray, toxic: np.ndarray, filters: int) -> list[tuple[int, int, int, int, int, int, int]]:
    """For each filter and set of others before it, over one range: filter, set, documents, documents that fail a filter
    of the set, removed by the filter, and of these good and toxic."""
    postings = [np.flatnonzero(masks >> f & 1).tolist() for f in range(filters)]
    good_list, toxic_list = np.flatnonzero(good).tolist(), np.flatnonzero(toxic).tolist()
    rows = []
    for before in range(1 << filters):
        gone = union([postings[f] for f in range(filters) if before >> f & 1])
        for f in range(filters):
            if not before >> f & 1:
                removed = difference(postings[f], gone)
                rows.append((f, before, len(masks), len(gone), len(removed), common(removed, good_list), common(removed, toxic_list)))
    return rows


# --- filters ---------------------------------------------------------------------------


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, f"[{SPACE}]+"), lambda w: w != "")


def failures(text: Column, copy: Column) -> dict[str, Column]:
    """The five filters of the audit: few words, few distinct words, many capitals, marks, copies."""
    words = words_of(text)
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    # A word list per row is made once: these two conditions share it.
    capitals = F.char_length(text) - F.char_length(F.regexp_replace(text, f"{UPPER}+", ""))
    return {
        "A": n < 200,
        "B": 100 * distinct.cast("long") < 50 * n.cast("long"),
        "C": 100 * capitals.cast("long") > 3 * F.char_length(text).cast("long"),
        "D": text.rlike(MARKS),
        "E": copy,
    }


def with_first_copy(df: DataFrame, id_col: str, digest: str) -> DataFrame:
    """Add ``copy``: whether a smaller id has the same ``digest``. Only digests met more than once are joined, by a written
    table, so that adaptive execution can split the rows of a digest that very many share."""
    several = df.groupBy(digest).agg(F.min(id_col).alias("_first"), F.max(id_col).alias("_last")).filter(F.col("_first") < F.col("_last"))
    several = materialize(several.drop("_last"), "audit-copies")
    return df.join(several, digest, "left").withColumn("copy", F.coalesce(F.col(id_col) > F.col("_first"), F.lit(False))).drop("_first")


# --- the audit -------------------------------------------------------------------------

SUMS = "filter int, before int, n long, gone long, removed long, good long, toxic long"


def part_sums(rows: DataFrame, filters: int, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Sums of ``range_sums`` for each part of ``part, id, mask, good, toxic``.

    Rows are dealt by ranges of part and id, sorted, and merged ``range_rows`` of a part at a time. A position in the
    sorted range stands for a row, so rows that repeat an id, or have none, count one by one; the row's number spreads
    them if they are many.
    """
    numbered = rows.withColumn("_row", F.monotonically_increasing_id())
    placed = numbered.repartitionByRange("part", "id", "_row").sortWithinPartitions("part", "id", "_row").drop("_row", "id")
    schema = "part string, " + SUMS

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def merged(table: pa.Table) -> pa.RecordBatch:
            arrays = [np.asarray(table[c].combine_chunks().cast(pa.int64())) for c in ("mask", "good", "toxic")]
            sums = range_sums(*arrays, filters)
            columns = [pa.array([table["part"][0].as_py()] * len(sums), pa.string()), *(pa.array(c, t) for c, t in zip(zip(*sums), [pa.int32()] * 2 + [pa.int64()] * 5))]
            return pa.RecordBatch.from_arrays(columns, names=["part", *(f.split()[0] for f in SUMS.split(", "))])

        for batch in batches:
            table = pa.Table.from_batches([batch])
            codes = table["part"].combine_chunks().dictionary_encode()
            codes = codes.indices.to_numpy() if isinstance(codes, pa.DictionaryArray) else codes.combine_chunks().indices.to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(codes)) + 1).tolist(), len(codes)] if len(codes) else []
            for a, b in zip(cuts, cuts[1:]):
                run = table.slice(a, b - a)
                if held and held[0]["part"][0].as_py() != run["part"][0].as_py():
                    yield merged(pa.concat_tables(held))
                    held = []
                held.append(run)
                if sum(map(len, held)) >= range_rows:
                    yield merged(pa.concat_tables(held))
                    held = []
        if held:
            yield merged(pa.concat_tables(held))

    sums = placed.mapInArrow(merge, schema)
    return sums.groupBy("part", "filter", "before").agg(*(F.sum(c).alias(c) for c in ("n", "gone", "removed", "good", "toxic")))


def orders(letters: str) -> list[tuple[str, int, int, int]]:
    """For each order and step: the order, the step, its filter and the set of filters before it."""
    out = []
    for order in itertools.permutations(range(len(letters))):
        name = "".join(letters[f] for f in order)
        for step, f in enumerate(order):
            out.append((name, step + 1, f, sum(1 << g for g in order[:step])))
    return out


def filter_audit(rows: DataFrame, letters: str) -> DataFrame:
    """One row per part, order of the filters and step, for ``part, id, <one boolean per letter>, good, toxic``.

    Columns: ``part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley``. A null
    part is the empty string; null flags count as false. Every row is a document, whatever its id. An empty table has no
    parts. Other columns are ignored.
    """
    flag = lambda c: F.coalesce(exact(c).cast("boolean"), F.lit(False)).cast("int")
    mask = F.lit(0)
    for f, letter in enumerate(letters):
        mask = mask + flag(letter) * (1 << f)
    narrow = rows.select(F.coalesce(exact("part").cast("string"), F.lit("")).alias("part"), exact("id").alias("id"), mask.alias("mask"), flag("good").alias("good"), flag("toxic").alias("toxic"))
    n = len(letters)
    sums = materialize(part_sums(materialize(narrow, "audit-rows"), n), "audit-sums")
    # The filter's place in an order with this set before it: so many of all orders.
    times = F.element_at(F.array(*(F.lit(math.factorial(k) * math.factorial(n - 1 - k)) for k in range(n))), F.bit_count("before").cast("int") + 1)
    per_filter = sums.groupBy(F.col("part").alias("p"), F.col("filter").alias("f")).agg(
        F.max(F.when(F.col("before") == 0, F.col("removed"))).alias("failing"),
        F.max(F.when(F.bit_count("before") == n - 1, F.col("removed"))).alias("unique_fails"),
        F.sum(F.col("removed") * times).alias("shapley"),
    )
    # A row for each order and step: as many as the filters have orders, whatever the data.
    steps = rows.sparkSession.createDataFrame(orders(letters), "filter_order string, step int, filter int, before int")
    joined = sums.join(F.broadcast(steps), ["filter", "before"]).join(per_filter, (F.col("part") == F.col("p")) & (F.col("filter") == F.col("f")))
    return joined.select(
        "part", "filter_order", "step",
        (F.col("n") - F.col("gone") - F.col("removed")).alias("kept"), "removed",
        (F.col("failing") - F.col("removed")).alias("redundant"), "unique_fails",
        F.col("good").alias("good_lost"), F.col("toxic").alias("toxic_lost"), "shapley",
    )


def audited_documents(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """The rows that ``filter_audit`` takes: part, id, the five filters' failures, and the labels of the id.

    A null text is empty. A document is a copy if a smaller id has the same text; rows without an id are never copies and
    have no labels. Labels that repeat an id count if any of them does.
    """
    text = F.coalesce(exact(text_col).cast("string"), F.lit(""))
    # Texts are told apart by a digest, so they do not cross the network.
    own = failures(F.col("text"), F.lit(None).cast("boolean"))
    read = documents.select(exact(part_col).cast("string").alias("part"), exact(id_col).alias("id"), text.alias("text"))
    tested = read.select("part", "id", F.sha2(F.col("text").cast("binary"), 256).alias("digest"), *(c.alias(k) for k, c in own.items() if k != "E"))
    marked = with_first_copy(materialize(tested, "audit-tested"), "id", "digest").drop("digest").withColumnRenamed("copy", "E")
    flags = labels.select(exact(id_col).alias("id"), (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic"))
    flags = materialize(flags.filter("id IS NOT NULL").groupBy("id").agg(F.max("good").alias("good"), F.max("toxic").alias("toxic")), "audit-labels")
    # Rows without an id would all meet in one task of the join.
    known, unknown = marked.filter("id IS NOT NULL"), marked.filter("id IS NULL")
    return known.join(flags, "id", "left").unionByName(unknown, allowMissingColumns=True)

"""Packing documents into sequences of fixed length, as a cutting-stock problem.

Documents are cut into whole sequences and a tail, and the tail at a multiple of ``grain``, so there are few lengths
however many documents: ``sequence / grain`` long ones and the short ends. Only how often each length occurs goes to
the driver. There a linear program over patterns (how many pieces of each length fill one sequence) is solved by column
generation: an unbounded knapsack, by dynamic programming, finds the pattern that would improve most at the present
prices. Patterns are rounded down, what is left is filled greedily, and the pieces of each length, ranked in Spark,
are dealt to the patterns' places.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from contactlink.llm.piece_table import ROOM, SLICE_BYTES, byte_table
from contactlink.llm.tables import exact, field_type, shuffle_partitions
from contactlink.operators.storage import materialize

SEQUENCE, GRAIN, END_ID = 1024, 16, 0
EPS = 1e-9
Pattern = dict[int, int]


# --- tokens ----------------------------------------------------------------------------


def cut(n: int, sequence: int, grain: int) -> list[tuple[int, int]]:
    """Start and length of a document's pieces: whole sequences, the tail's multiple of ``grain``, its end."""
    bounds = [*range(0, n + 1, sequence), n - n % sequence % grain, n]
    bounds = sorted(set(bounds))
    return [(a, b - a) for a, b in zip(bounds, bounds[1:])]


def token_pieces(
    df: DataFrame, tokenizer: str, id_col: str, text_col: str, sequence: int = SEQUENCE, grain: int = GRAIN, end_id: int = END_ID,
    keep_ids: bool = False, room: int = ROOM, slice_bytes: int = SLICE_BYTES,
) -> DataFrame:
    """The pieces of all documents: id, ``start``, ``length``, ``ids_crc32``, ``doc_tokens`` and, if asked for, ``ids``
    (little-endian 32-bit). A null text has the end id only."""
    fields = [T.StructField("id", field_type(df, id_col)), *(T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32", "doc_tokens"))]
    schema = T.StructType([*fields, *([T.StructField("ids", T.BinaryType())] if keep_ids else [])])
    end = np.array([end_id], "<u4").tobytes()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = byte_table(tokenizer, room)
        for batch in batches:
            for at, ids, bounds in table.in_slices(batch.column(1), slice_bytes):
                owner, numbers, parts = [], [], []
                for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
                    document = ids[a:b].tobytes() + end
                    n = len(document) // 4
                    for start, length in cut(n, sequence, grain):
                        piece = document[4 * start : 4 * (start + length)]
                        owner.append(at + i)
                        numbers.append((start, length, zlib.crc32(piece), n))
                        if keep_ids:
                            parts.append(piece)
                columns = [batch.column(0).take(pa.array(owner, pa.int64())), *(pa.array(c, pa.int64()) for c in zip(*numbers))]
                names = ["id", "start", "length", "ids_crc32", "doc_tokens"]
                if keep_ids:
                    columns, names = [*columns, pa.array(parts, pa.binary())], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return df.select(exact(id_col).alias("id"), exact(text_col).cast("string").alias("text")).mapInArrow(pieces, schema)


# --- patterns --------------------------------------------------------------------------


def best_pattern(lengths: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable filling of one sequence: unbounded knapsack by dynamic programming."""
    worth = np.zeros(capacity + 1)
    last = np.full(capacity + 1, -1)
    for c in range(1, capacity + 1):
        fits = lengths <= c
        values = np.where(fits, worth[np.maximum(c - lengths, 0)] + prices, -1.0)
        k = int(values.argmax())
        worth[c], last[c] = (values[k], k) if fits.any() and values[k] > worth[c - 1] + EPS else (worth[c - 1], -1)
    counts = np.zeros(len(lengths), np.int64)
    c = capacity
    while c > 0:
        if last[c] < 0:
            c -= 1
        else:
            counts[last[c]] += 1
            c -= lengths[last[c]]
    return float(worth[capacity]), counts


def solve(lengths: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 3000) -> list[tuple[np.ndarray, float]]:
    """Patterns and how often to use each, so that all pieces are placed in the fewest sequences (linear program)."""
    m = len(lengths)
    columns = np.diag(capacity // lengths).astype(float)
    amounts = demand / np.diag(columns)
    for _ in range(rounds):
        inverse = np.linalg.inv(columns)
        amounts = np.maximum(inverse @ demand, 0)
        prices = np.ones(m) @ inverse
        value, pattern = best_pattern(lengths, prices, capacity)
        if value <= 1 + 1e-7:
            break
        direction = inverse @ pattern
        rising = direction > EPS
        ratios = np.where(rising, amounts / np.where(rising, direction, 1), np.inf)
        columns[:, int(ratios.argmin())] = pattern
    return [(columns[:, j].round().astype(np.int64), float(amounts[j])) for j in range(m)]


def plan(counts: dict[int, int], sequence: int) -> list[tuple[Pattern, int]]:
    """Patterns and whole numbers of their use that place every piece exactly once. ``counts``: pieces by length."""
    out = [({sequence: 1}, counts[sequence])] if counts.get(sequence) else []
    left = {length: n for length, n in counts.items() if n and length != sequence}
    if not left:
        return out
    lengths = np.array(sorted(left, reverse=True))
    for pattern, amount in solve(lengths, np.array([left[x] for x in lengths], float), sequence):
        used = {int(x): int(n) for x, n in zip(lengths, pattern) if n}
        times = min([int(amount + 1e-6), *(left[x] // n for x, n in used.items())])
        if times > 0:
            out.append((used, times))
            for x, n in used.items():
                left[x] -= n * times
    while any(left.values()):  # what rounding left over: longest first, as often as the pieces allow
        room, used = sequence, {}
        for x in sorted((x for x, n in left.items() if n), reverse=True):
            n = min(left[x], room // x)
            if n:
                used[x], room = n, room - n * x
        times = min(left[x] // n for x, n in used.items())
        out.append((used, times))
        for x, n in used.items():
            left[x] -= n * times
    return out


def places(patterns: list[tuple[Pattern, int]]) -> list[tuple[int, int, int, int, int, int]]:
    """For each length and pattern: length, first and last rank served, pieces in a sequence, first sequence, offset."""
    served: dict[int, int] = {}
    rows, base = [], 0
    for pattern, times in patterns:
        offset = 0
        for length, n in sorted(pattern.items(), reverse=True):
            low = served.get(length, 0)
            served[length] = low + n * times
            rows.append((length, low, served[length] - 1, n, base, offset))
            offset += n * length
        base += times
    return rows


# --- the operator ----------------------------------------------------------------------


def ranked(pieces: DataFrame) -> DataFrame:
    """Add ``rank``, 0-based among the pieces of one length. Pieces are dealt to slices by a hash of their document, as
    many as suit the cluster; counts by length and slice give where each slice begins."""
    slices = 16 * shuffle_partitions(pieces.sparkSession)
    sliced = pieces.withColumn("slice", F.pmod(F.xxhash64("id"), F.lit(slices)))
    counts = sliced.groupBy("length", "slice").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1))
    counts = materialize(counts.select("length", "slice", F.coalesce(before, F.lit(0)).alias("before")), "packing-slices")
    inside = Window.partitionBy("length", "slice").orderBy("id", "start", "ids_crc32", "doc_tokens")
    return (
        sliced.withColumn("place", F.row_number().over(inside) - 1).join(counts, ["length", "slice"])
        .withColumn("rank", F.col("before") + F.col("place")).drop("slice", "place", "before")
    )


def pack(
    df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", sequence: int = SEQUENCE, grain: int = GRAIN,
    end_id: int = END_ID, keep_ids: bool = False, room: int = ROOM, slice_bytes: int = SLICE_BYTES,
) -> DataFrame:
    """A row per piece: id, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id``, ``offset`` and, if
    asked for, ``ids``.

    A document is the ids of its text and ``end_id``; a null text is empty. Every id lies in one piece, and the pieces
    of a sequence follow each other without gaps from offset 0. Rows that repeat an id are documents of their own. Of
    an empty table nothing comes out. Other columns are ignored. A task holds about ``room`` pieces of text and encodes
    ``slice_bytes`` of it at a time.
    """
    if not 0 < grain <= sequence or sequence % grain:
        raise ValueError("the sequence length must be a multiple of grain")
    spark = df.sparkSession
    pieces = materialize(token_pieces(df, tokenizer, id_col, text_col, sequence, grain, end_id, keep_ids, room, slice_bytes), "packing-pieces")
    # At most sequence / grain + grain lengths.
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    rows = places(plan(counts, sequence))
    served = spark.createDataFrame(rows, "length long, low long, high long, n long, base long, at long")
    number = F.col("rank") - F.col("low")
    # The table of places has at most (lengths x patterns) rows, whatever the number of documents.
    dealt = ranked(pieces).alias("p").join(F.broadcast(served.alias("s")), (F.col("p.length") == F.col("s.length")) & F.col("rank").between(F.col("low"), F.col("high")))
    return dealt.select(
        F.col("p.id").alias(id_col), "start", F.col("p.length").alias("length"), "ids_crc32", "doc_tokens",
        (F.col("base") + F.floor(number / F.col("n"))).alias("sequence_id"),
        (F.col("at") + number % F.col("n") * F.col("p.length")).alias("offset"),
        *(["ids"] if keep_ids else []),
    )

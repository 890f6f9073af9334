"""Asking all documents about hashes without a row for each hash.

Documents are dealt into chunks by a hash of their id, and each chunk lists its distinct hashes in order. The range of
hashes is cut into as many buckets; what a chunk has in a bucket is one row with a packed array. A bucket sees the
arrays of all chunks, answers with one packed array for each of them, and because the chunk's list is sorted and made
the same way again, the answer needs no keys. A hash that a third of all documents share counts once per chunk, so no
hash can fill a bucket.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactlink.llm.tables import exact

#: Bytes of text in a chunk, chunks of small inputs, and chunks for each bucket. A chunk's texts and arrays are in memory
#: at once, so chunks are many; there are at most as many rows as chunks times buckets, so buckets, whose arrays are small,
#: are few. Both follow the texts, not the number of shuffle partitions: many partitions would make rows with their square.
CHUNK_BYTES, MIN_CHUNKS, CHUNKS_PER_BUCKET = 2 << 20, 8, 4


def chunks_and_buckets(df: DataFrame, text_col: str) -> tuple[int, int]:
    size = df.agg(F.sum(F.octet_length(exact(text_col)))).first()[0] or 0
    chunks = max(MIN_CHUNKS, -(-size // CHUNK_BYTES))
    return chunks, -(-chunks // CHUNKS_PER_BUCKET)


def chunk_of(id_col: str, text_col: str, chunks: int) -> Column:
    """A row's chunk; rows without an id are dealt by their text."""
    key = F.coalesce(exact(id_col).cast("string"), exact(text_col), F.lit(""))
    return F.pmod(F.xxhash64(key), F.lit(chunks)).cast("int")


def bucket_bounds(sorted_hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket begins in a sorted array of 64-bit hashes."""
    cuts = np.array([-(-(b << 64) // buckets) for b in range(1, buckets)], np.uint64)
    return np.concatenate([[0], np.searchsorted(sorted_hashes, cuts), [len(sorted_hashes)]]).astype(np.int64)


def slices(bounds: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """The buckets that are not empty: number, begin, end."""
    for b in np.flatnonzero(np.diff(bounds)):
        yield int(b), int(bounds[b]), int(bounds[b + 1])


#: Bits of a hash that are sent besides its bucket, and the two bits of a count or flags below them.
SENT_BITS, NOTE_BITS = 30, 2


def sent(hashes: np.ndarray, notes: np.ndarray) -> np.ndarray:
    """Hashes as 32-bit values with notes of two bits. The top bits are known from the bucket; with buckets that grow
    with the data, different hashes meet as rarely at any size (about one in 10,000)."""
    short = (hashes >> np.uint64(18)) & np.uint64((1 << SENT_BITS) - 1)
    return (short.astype(np.uint32) << np.uint32(NOTE_BITS)) | notes.astype(np.uint32)


def joined_arrays(column, dtype) -> tuple[np.ndarray, np.ndarray]:
    """The packed arrays of a binary column end to end, and how many values each has."""
    parts = [np.frombuffer(v, dtype) for v in column.to_pylist()]
    return np.concatenate(parts) if parts else np.zeros(0, dtype), np.array([len(p) for p in parts], np.int64)


def grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order that sorts keys, begin of each group in it, and the group of each place in it."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    return order, np.flatnonzero(new), np.cumsum(new) - 1

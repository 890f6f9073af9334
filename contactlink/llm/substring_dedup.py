"""Substring deduplication by fixed-block anchors.

The words of every text are cut into blocks of ``window // 2`` that do not overlap; these are the index. Every rolling
window of a block's length probes it. Any repeated window of ``window`` words holds one whole block of its other place,
so the windows around a hit are all that can repeat. They are compared in full length, by 96-bit digests: each learns
whether its words start earlier, and runs of repeated windows grow together to maximal repeats, whose words go.
Texts are shuffled once, by chunk; the two questions travel as packed arrays (see ``exchange``).
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactlink.llm import exchange
from contactlink.llm.hashing import Words, window_hashes
from contactlink.llm.tables import arrow_schema, arrow_table, bytes_of, exact, field_type, packed_rest, unpacked_rest

WINDOW = 20
OWN = ["n_words", "n_removed", "removed", "kept_text"]
NO_ID = np.iinfo(np.int64).max

PROBES = "bucket int, chunk int, entries binary"
HITS = "chunk int, bucket int, question int, answer binary"
REPEATS = "bucket int, chunk int, digest binary, digest2 binary, base long, wide boolean, docs binary"


class Chunk:
    """One chunk of documents in the order of their ids, with its words."""

    def __init__(self, docs: pa.Table, window: int):
        docs = docs.take(pc.sort_indices(docs, sort_keys=[("id", "ascending"), ("text", "ascending")]))
        self.docs, self.window, self.block = docs, window, window // 2
        self.ids = docs["id"].fill_null(NO_ID).to_numpy()
        self.data, self.offsets = bytes_of(docs["text"])
        self.words = Words(self.data, self.offsets)
        self.hashes = self.words.hashes(1)

    def probes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct probe hashes in order, whose number each window has, the words the windows start at, and notes:
        1 if a window is an indexed block, 2 if there are several such windows."""
        hashes, at = window_hashes(self.words, self.hashes, self.block, 1)
        distinct, number = np.unique(hashes, return_inverse=True)
        in_text = at - np.repeat(self.words.first[:-1], self.words.counts)[at]
        notes = np.zeros(len(distinct), np.uint8)
        notes[number[in_text % self.block == 0]] = 1
        notes |= (np.bincount(number, minlength=len(distinct)) > 1).astype(np.uint8) << 1
        return distinct, number, at, notes

    def candidates(self, answers: pa.Table, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Windows of full length around a hit: first words and both digests."""
        distinct, number, at, _ = self.probes()
        hit = np.zeros(len(distinct), bool)
        bounds = exchange.bucket_bounds(distinct, buckets)
        for bucket, mask in zip(answers["bucket"].to_pylist(), answers["answer"].to_pylist()):
            a, b = bounds[bucket], bounds[bucket + 1]
            hit[a:b] = np.unpackbits(np.frombuffer(mask, np.uint8), count=b - a).astype(bool)
        hits = np.zeros(len(self.words) + 1, np.int64)
        hits[at[hit[number]] + 1] = 1
        hits = np.cumsum(hits)
        first, starts = window_hashes(self.words, self.hashes, self.window, 1)
        near = hits[starts + self.window - self.block + 1] > hits[starts]
        starts, first = starts[near], first[near]
        second, every = window_hashes(self.words, self.words.hashes(2), self.window, 2)
        return starts, first, (second[np.searchsorted(every, starts)] >> np.uint64(32)).astype(np.uint32)


def _distinct(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the first of each pair of digests, in the order of digests, and the number of each place's pair."""
    order = np.lexsort((second, first))
    a, b = first[order], second[order]
    new = np.ones(len(order), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    return order[new], number


def _probe_rows(chunk: int, part: Chunk, buckets: int) -> pa.Table:
    distinct, _, _, notes = part.probes()
    entries = exchange.sent(distinct, notes)
    rows = [(b, chunk, entries[x:y].tobytes()) for b, x, y in exchange.slices(exchange.bucket_bounds(distinct, buckets))]
    return arrow_table(rows, _PROBES)


def _hit_rows(bucket: int, rows: pa.Table) -> pa.Table:
    """Which entries are met in two places at least, one of them an indexed block."""
    entries, counts = exchange.joined_arrays(rows["entries"], np.uint32)
    order, begins, group = exchange.grouped(entries >> np.uint32(exchange.NOTE_BITS))
    ordered = entries[order]
    places = np.add.reduceat(1 + ((ordered >> 1) & 1), begins)
    block = np.bitwise_or.reduceat(ordered & 1, begins)
    hit = np.empty(len(entries), bool)
    hit[order] = ((places > 1) & (block == 1))[group]
    masks = np.split(hit, np.cumsum(counts)[:-1])
    return arrow_table([(c, bucket, 1, np.packbits(m).tobytes()) for c, m in zip(rows["chunk"].to_pylist(), masks) if m.any()], _HITS)


def _repeat_rows(chunk: int, part: Chunk, answers: pa.Table, buckets: int) -> pa.Table:
    starts, first, second = part.candidates(answers, buckets)
    places, _ = _distinct(first, second)
    ids = part.ids[part.words.owners()[starts[places]]]
    first, second = first[places], second[places]
    base = int(ids.min()) if len(ids) else 0
    rows = []
    for b, x, y in exchange.slices(exchange.bucket_bounds(first, buckets)):
        wide = int(ids[x:y].max()) - base >= 1 << 32
        packed = ids[x:y] if wide else (ids[x:y] - base).astype(np.uint32)
        rows.append((b, chunk, first[x:y].tobytes(), second[x:y].tobytes(), base, wide, packed.tobytes()))
    return arrow_table(rows, _REPEATS)


def _earlier_rows(bucket: int, rows: pa.Table) -> pa.Table:
    """Which digests have their first place in another chunk."""
    first, counts = exchange.joined_arrays(rows["digest"], np.uint64)
    second, _ = exchange.joined_arrays(rows["digest2"], np.uint32)
    docs = np.concatenate([
        np.frombuffer(d, np.int64) if wide else np.frombuffer(d, np.uint32) + np.int64(base)
        for d, wide, base in zip(rows["docs"].to_pylist(), rows["wide"].to_pylist(), rows["base"].to_pylist())
    ])
    places, number = _distinct(first, second)
    lowest = np.full(len(places), NO_ID)
    np.minimum.at(lowest, number, docs)
    masks = np.split(docs > lowest[number], np.cumsum(counts)[:-1])
    return arrow_table([(c, bucket, 2, np.packbits(m).tobytes()) for c, m in zip(rows["chunk"].to_pylist(), masks) if m.any()], _HITS)


def _kept_rows(part: Chunk, answers: pa.Table, buckets: int, schema: pa.Schema, verbatim: bool) -> pa.Table:
    question = answers["question"]
    starts, first, second = part.candidates(answers.filter(pc.equal(question, 1)), buckets)
    places, number = _distinct(first, second)
    earlier = np.zeros(len(places), bool)
    bounds = exchange.bucket_bounds(first[places], buckets)
    told = answers.filter(pc.equal(question, 2))
    for bucket, mask in zip(told["bucket"].to_pylist(), told["answer"].to_pylist()):
        a, b = bounds[bucket], bounds[bucket + 1]
        earlier[a:b] = np.unpackbits(np.frombuffer(mask, np.uint8), count=b - a).astype(bool)
    is_first = np.zeros(len(starts), bool)
    is_first[places] = True
    gone = starts[~is_first | earlier[number]]
    cover = np.zeros(len(part.words) + 1, np.int64)
    np.add.at(cover, gone, 1)
    np.add.at(cover, gone + part.window, -1)
    removed = np.cumsum(cover)[:-1] > 0
    at = part.words.first
    n_removed = np.add.reduceat(np.append(removed, False), at[:-1]) if len(removed) else np.zeros(len(part.ids), np.int64)
    n_removed = np.where(part.words.counts > 0, n_removed, 0)
    texts, spans = [], []
    raw = part.data.tobytes()
    nulls = part.docs["text"].is_null().to_pylist()
    for i, n in enumerate(n_removed.tolist()):
        text = raw[part.offsets[i] : part.offsets[i + 1]]
        words = text.split() if n or not verbatim else [text]
        span = []
        if n:
            out = removed[at[i] : at[i + 1]]
            words = itertools.compress(words, (~out).tolist())
            edges = np.flatnonzero(np.diff(np.concatenate([[0], out.view(np.int8), [0]])))
            span = [{"start": a, "length": b - a} for a, b in edges.reshape(-1, 2).tolist()]
        texts.append(None if nulls[i] else b" ".join(words).decode())
        spans.append(span)
    return pa.Table.from_arrays(
        [
            part.docs["id"], part.docs["_rest"], pa.array(part.words.counts, pa.int64()), pa.array(n_removed, pa.int64()),
            pa.array(spans, schema.field("removed").type), pa.array(texts, pa.string()),
        ],
        schema=schema,
    )


_PROBES = pa.schema([("bucket", pa.int32()), ("chunk", pa.int32()), ("entries", pa.binary())])
_HITS = pa.schema([("chunk", pa.int32()), ("bucket", pa.int32()), ("question", pa.int32()), ("answer", pa.binary())])
_REPEATS = pa.schema([
    ("bucket", pa.int32()), ("chunk", pa.int32()), ("digest", pa.binary()), ("digest2", pa.binary()),
    ("base", pa.int64()), ("wide", pa.bool_()), ("docs", pa.binary()),
])


def substring_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, verbatim: bool = False) -> DataFrame:
    """Remove every word covered by a window of ``window`` words that also starts earlier.

    Earlier is a smaller id, or the same text and an earlier word. Windows are judged on the given texts. Adds
    ``n_words``, ``n_removed``, ``removed`` (array of start and length, in words) and ``kept_text``, the kept words
    joined by one space; with ``verbatim`` a text that loses nothing is left as it is. A null text has no words and stays null. Rows with one id are taken in the order of their
    texts; rows without an id come last and do not count as earlier than each other unless they share a chunk. Other
    columns are kept; those with the names of new ones are replaced.
    """
    if window < 4 or window % 2:
        raise ValueError("window must be even and at least 4")
    chunks, buckets = exchange.chunks_and_buckets(df, text_col)
    rest, names = packed_rest(df, [id_col, text_col, *OWN])
    docs = df.select(
        exchange.chunk_of(id_col, text_col, chunks).alias("chunk"), exact(id_col).cast("long").alias("id"), exact(text_col).cast("string").alias("text"), rest
    )
    fields = {"n_words": "bigint", "n_removed": "bigint", "removed": "array<struct<start:bigint,length:bigint>>", "kept_text": "string"}
    out = docs.select("id", "_rest", *(F.lit(None).cast(t).alias(c) for c, t in fields.items())).schema
    arrow = arrow_schema(out)

    def probe(key, rows):
        return _probe_rows(key[0].as_py(), Chunk(rows, window), buckets)

    def hits(key, rows):
        return _hit_rows(key[0].as_py(), rows)

    def repeats(key, rows, answers):
        return _repeat_rows(key[0].as_py(), Chunk(rows, window), answers, buckets) if rows.num_rows else arrow_table([], _REPEATS)

    def earlier(key, rows):
        return _earlier_rows(key[0].as_py(), rows)

    def kept(key, rows, answers):
        return _kept_rows(Chunk(rows, window), answers, buckets, arrow, verbatim) if rows.num_rows else arrow.empty_table()

    by_chunk = docs.groupBy("chunk")
    hit = by_chunk.applyInArrow(probe, PROBES).groupBy("bucket").applyInArrow(hits, HITS)
    repeat = by_chunk.cogroup(hit.groupBy("chunk")).applyInArrow(repeats, REPEATS)
    first = repeat.groupBy("bucket").applyInArrow(earlier, HITS)
    result = by_chunk.cogroup(hit.unionByName(first).groupBy("chunk")).applyInArrow(kept, out)
    id_type = field_type(df, id_col)
    return result.select(F.col("id").cast(id_type).alias(id_col), *unpacked_rest(names), *OWN)

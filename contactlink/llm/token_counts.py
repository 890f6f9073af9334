"""Token counts by rank-synchronous merging of ragged arrays.

The text is cut into pre-tokens by the tokenizer's own pattern. Pre-tokens not seen before are held as one flat array
of symbols with sequence bounds. In each step every sequence merges all places of its own lowest-rank pair at once,
and what survives is counted. Merging all places of the lowest rank together equals merging them one by one from the
left, because a pair that contains the new symbol always has a higher rank than the merge that made it.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactlink.llm.pieces import PieceMemory

# The code points that stand for their own byte in a byte-level BPE vocabulary.
PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]

NO_RANK = np.iinfo(np.int32).max
CACHE_WORDS = 250_000
BATCH_SYMBOLS = 1 << 22


def byte_symbols() -> dict[str, int]:
    """The character that stands for each byte: itself if printable, else the next free one from 256 on."""
    rest = [b for b in range(256) if b not in set(PRINTABLE)]
    return {chr(b): b for b in PRINTABLE} | {chr(256 + i): b for i, b in enumerate(rest)}


class RankMerger:
    """Merges of a byte-level BPE vocabulary, looked up for whole arrays of pairs."""

    def __init__(self, vocab: dict[str, int], merges: list, specials: dict[str, int]):
        self.size = max(vocab.values()) + 1
        ids = np.full(256, -1, np.int64)
        for char, byte in byte_symbols().items():
            ids[byte] = vocab[char]
        self.byte_ids = ids
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int32), made[order]
        self.specials = specials

    def _rank(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair and the place of its merge."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NO_RANK), at

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All symbols left of all words, and how many each word has."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        symbols = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        owner = np.repeat(np.arange(len(words)), lengths)
        done_symbols, done_owner = [], []
        while len(symbols):
            rank, at = self._rank(symbols[:-1], symbols[1:])
            rank[owner[:-1] != owner[1:]] = NO_RANK
            rank, at = np.append(rank, NO_RANK), np.append(at, 0)
            starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            lowest = np.minimum.reduceat(rank, starts)
            spans = np.diff(np.append(starts, len(symbols)))
            live = np.repeat(lowest < NO_RANK, spans)
            if not live.all():  # finished sequences leave the arrays
                done_symbols.append(symbols[~live])
                done_owner.append(owner[~live])
                symbols, owner, rank, at = symbols[live], owner[live], rank[live], at[live]
                spans, lowest = spans[lowest < NO_RANK], lowest[lowest < NO_RANK]
                if not len(symbols):
                    break
            hit = rank == np.repeat(lowest, spans)
            # Overlapping places (a pair of equal symbols in a run) merge from the left: every second one of a run.
            places = np.flatnonzero(hit)
            runs = np.append(True, np.diff(places) > 1)
            in_run = np.arange(len(places)) - np.maximum.accumulate(np.where(runs, np.arange(len(places)), 0))
            places = places[in_run % 2 == 0]
            symbols = symbols.copy()
            symbols[places] = self.made[at[places]]
            keep = np.ones(len(symbols), bool)
            keep[places + 1] = False
            symbols, owner = symbols[keep], owner[keep]
        if not done_owner:
            return np.zeros(0, np.int64), np.zeros(len(words), np.int64)
        symbols, owner = np.concatenate(done_symbols), np.concatenate(done_owner)
        order = np.argsort(owner, kind="stable")
        return symbols[order], np.bincount(owner, minlength=len(words))

    def counts(self, words: list[str]) -> list[int]:
        """Tokens of each pre-token, merged in batches of bounded size (one very long word is a batch of its own)."""
        out: list[int] = []
        batch, size = [], 0
        for word in words:
            raw = word.encode("utf-8", "surrogatepass")
            if batch and size + len(raw) > BATCH_SYMBOLS:
                out += self.merge(batch)[1].tolist()
                batch, size = [], 0
            batch.append(raw)
            size += len(raw)
        return out + (self.merge(batch)[1].tolist() if batch else [])


@functools.cache
def load_merger(path: str) -> RankMerger:
    """The vocabulary of a byte-level BPE file of the ``tokenizers`` library."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    before = spec["pre_tokenizer"] or {}
    if spec["model"]["type"] != "BPE" or spec["normalizer"] or before.get("type") != "ByteLevel" or before.get("add_prefix_space"):
        raise ValueError(f"{path}: only byte-level BPE without normalizer and prefix space is supported")
    specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
    return RankMerger(spec["model"]["vocab"], spec["model"]["merges"], specials)


@functools.cache
def _counter(path: str) -> PieceMemory:
    merger = load_merger(path)
    return PieceMemory(merger.counts, sum, dict.fromkeys(merger.specials, 1), CACHE_WORDS)


def count_tokens(df: DataFrame, tokenizer: str, text_col: str = "text", limit: int = 512, slice_bytes: int = 8 << 20) -> DataFrame:
    """Add ``n_bytes``, ``n_tokens`` and ``over_limit`` to every row.

    ``tokenizer`` is the path of a byte-level BPE file, the same on all machines. A null text counts as empty: 0 bytes
    and 0 tokens. Columns of ``df`` with the new names are replaced; all others, repeated rows included, are kept.
    Nothing is shuffled: memory is one Arrow batch, worked off in slices of ``slice_bytes``.
    """
    names = [c for c in df.columns if c.lower() not in ("n_bytes", "n_tokens", "over_limit")]
    kept = df.select(*(F.col(f"`{c}`") for c in names))
    out = kept.withColumn("n_bytes", F.coalesce(F.octet_length(F.col(f"`{text_col}`")), F.lit(0)).cast("long"))
    at = names.index(text_col)
    schema = out.withColumn("n_tokens", F.lit(0).cast("long")).schema

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from contactlink.llm import token_counts

        counter = token_counts._counter(tokenizer)
        for batch in batches:
            sizes = np.cumsum(batch.column(len(names)).to_numpy())
            start = 0
            while start < batch.num_rows:
                before = sizes[start - 1] if start else 0
                stop = max(start + 1, int(np.searchsorted(sizes, before + slice_bytes, "right")))
                part = batch.slice(start, stop - start)
                counts = counter.values([t or "" for t in part.column(at).to_pylist()])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(counts, pa.int64())], names=[*(f"c{i}" for i in range(len(names) + 1)), "n"])
                start = stop

    flat = out.toDF(*(f"c{i}" for i in range(len(names) + 1)))
    inner = flat.withColumn("n", F.lit(0).cast("long")).schema
    counted = flat.mapInArrow(add, inner).toDF(*schema.fieldNames())
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)

"""Hashed word features of texts, and linear classifiers over them, in numpy.

Features are presence of words in a text, and of how longer words begin: runs of letters, digits and bytes over 127,
A-Z folded, hashed to ``2**BITS`` places. A table of features is held as flat arrays: places, and where each text begins.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactlink.llm.hashing import mixed
from contactlink.llm.tables import bytes_of, exact

BITS = 18

LETTER = np.zeros(256, bool)
LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
FOLDED = np.arange(256, dtype=np.uint64)
FOLDED[65:91] = FOLDED[97:123]
LONGEST = 24
BASE = 0x100000001B3
#: Bytes whose folded values are summed at once; powers of the base are kept for as many.
BLOCK = 1 << 16
BEGINNINGS = (4, 6)
#: Words that fewer training texts have get no weight.
SEEN = 3


@functools.cache
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    out = []
    for base in (BASE, pow(BASE, -1, 1 << 64)):
        powers = np.full(BLOCK + LONGEST, base, np.uint64)
        powers[0] = 1
        out.append(np.multiply.accumulate(powers))
    return out[0], out[1]


def _folded(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Each stretch of up to ``LONGEST`` bytes as the 64-bit polynomial of its folded bytes, from differences of running sums.
    Stretches are in order of their starts."""
    powers, inverse = _powers()
    terms_of = FOLDED + np.uint64(1)
    out = np.zeros(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        begin = starts[i]
        j = int(np.searchsorted(starts, begin + BLOCK))
        stop = int(starts[j - 1] + lengths[i:j].max(initial=0) - begin)
        part = data[begin : begin + min(stop, BLOCK + LONGEST)]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(terms_of[part] * inverse[: len(part)], out=sums[1:])
        a = starts[i:j] - begin
        b = a + lengths[i:j]
        out[i:j] = (sums[b] - sums[a]) * powers[b - 1]
        i = j
    return out


def _places(values: np.ndarray, bits: int) -> np.ndarray:
    return (mixed(values) >> np.uint64(64 - bits)).astype(np.int64)


def features(data: np.ndarray, offsets: np.ndarray, bits: int = BITS, distinct: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Places of each text and where each text begins in them: once each, word beginnings included, or (not
    ``distinct``) one for each word.

    Words are folded byte by byte into a 64-bit value; of a word over ``LONGEST`` bytes, every stretch of that many
    counts as a word, so no byte is left out.
    """
    inside = LETTER[data]
    start = inside.copy()
    if len(data):
        start[1:] &= ~inside[:-1]
        heads = offsets[:-1][offsets[:-1] < offsets[1:]]
        start[heads] = inside[heads]
    starts = np.flatnonzero(start)
    end = inside.copy()
    if len(data):
        end[:-1] &= ~inside[1:]
        tails = offsets[1:][offsets[:-1] < offsets[1:]] - 1
        end[tails] = inside[tails]
    ends = np.flatnonzero(end) + 1
    lengths = ends - starts
    if len(lengths) and lengths.max() > LONGEST:
        parts = -(-lengths // LONGEST)
        first = np.repeat(np.cumsum(parts) - parts, parts)
        starts, lengths = np.repeat(starts, parts) + (np.arange(len(first)) - first) * LONGEST, np.repeat(lengths, parts) - (np.arange(len(first)) - first) * LONGEST
        lengths = np.minimum(lengths, LONGEST)
    value = _folded(data, starts, lengths)
    begun, begun_at = [], []
    for k in BEGINNINGS if distinct else ():
        longer = np.flatnonzero(lengths > k)
        begun.append(_folded(data, starts[longer], np.full(len(longer), k)) ^ np.uint64(k << 56))
        begun_at.append(longer)
    if not distinct:
        return _places(value, bits), np.searchsorted(starts, offsets)
    owner = np.searchsorted(offsets, starts, "right") - 1
    place = _places(np.concatenate([value, *begun]), bits)
    owner = np.concatenate([owner, *(owner[at] for at in begun_at)])
    keys = np.unique((owner << bits) | place)
    owner, place = keys >> bits, keys & ((1 << bits) - 1)
    return place, np.searchsorted(owner, np.arange(len(offsets)))


class Rows:
    """Feature rows with a few dense columns."""

    def __init__(self, place: np.ndarray, begins: np.ndarray, dense: np.ndarray):
        self.place, self.begins, self.dense = place, begins, dense
        self.sizes = np.diff(begins)
        self.owner = np.repeat(np.arange(len(self.sizes)), self.sizes)

    def __len__(self) -> int:
        return len(self.sizes)

    def take(self, keep: np.ndarray) -> Rows:
        """The rows where ``keep`` is true."""
        sizes = self.sizes[keep]
        return Rows(self.place[keep[self.owner]], np.concatenate([[0], np.cumsum(sizes)]), self.dense[keep])

    def with_dense(self, *columns: np.ndarray) -> Rows:
        return Rows(self.place, self.begins, np.column_stack([self.dense, *columns]))


class Sums:
    """For each group, the sum of a vector's values at the places of its members. Members are given in order of groups."""

    def __init__(self, group: np.ndarray, place: np.ndarray, size: int):
        self.place, self.size = place, size
        self.filled = np.flatnonzero(np.bincount(group, minlength=size))
        self.starts = np.searchsorted(group, self.filled.astype(group.dtype))

    def __call__(self, values: np.ndarray) -> np.ndarray:
        out = np.zeros(self.size)
        if len(self.filled):
            out[self.filled] = np.add.reduceat(values[self.place], self.starts)
        return out


class Linear:
    """Logistic regression over words, each scaled by its log-odds ratio, and dense columns. A text's words are summed,
    or with ``mean`` averaged.

    The ratios (as in naive Bayes) say how much a word tells at all, so a few telling words are found among very many;
    the regression then weighs them together. Trained by accelerated gradient steps on all given rows.
    """

    def __init__(self, bits: int = BITS, penalty: float = 1e-4, steps: int = 150, mean: bool = False):
        self.size, self.penalty, self.steps, self.mean = 1 << bits, penalty, steps, mean

    def _share(self, rows: Rows) -> np.ndarray:
        return 1 / np.maximum(rows.sizes, 1) if self.mean else np.ones(len(rows))

    def fit(self, rows: Rows, y: np.ndarray) -> Linear:
        y = y.astype(float)
        positive, negative = max(y.sum(), 1.0), max(len(y) - y.sum(), 1.0)
        smooth = 0.5
        hits = np.bincount(rows.place, weights=y[rows.owner], minlength=self.size)
        seen = np.bincount(rows.place, minlength=self.size)
        odds = np.log((hits + smooth) / (positive + 2 * smooth)) - np.log((seen - hits + smooth) / (negative + 2 * smooth))
        self.ratio = np.where(seen >= SEEN, odds, 0.0)
        self.weights = np.zeros(self.size)
        used = np.flatnonzero(self.ratio)
        number = np.zeros(self.size, np.int64)
        number[used] = np.arange(len(used))
        known = self.ratio[rows.place] != 0
        place, owner = number[rows.place[known]].astype(np.int32), rows.owner[known].astype(np.int32)
        ratio, share = self.ratio[used], self._share(rows)
        self.centre, self.spread = rows.dense.mean(0), rows.dense.std(0) + 1e-9
        dense = np.column_stack([np.ones(len(y)), (rows.dense - self.centre) / self.spread])
        w, b = np.zeros(len(used)), np.zeros(dense.shape[1])
        w_old, b_old = w, b
        if self.mean:  # as large as the dense columns
            self.gain = 10.0
        else:
            self.gain = 1.0
        share = share * self.gain
        # A word's value in a text is ratio x share, so both sums of a step are plain sums of one gathered vector.
        by_text = Sums(owner, place, len(y))
        order = np.argsort(place, kind="stable")
        by_word = Sums(place[order], owner[order], len(used))
        norm = (by_text(ratio**2) * share**2).mean() + (dense**2).sum(1).mean()
        rate = 4.0 / max(norm, 1e-9)
        for t in range(self.steps):
            pace = t / (t + 3)
            wv, bv = w + pace * (w - w_old), b + pace * (b - b_old)
            score = by_text(ratio * wv) * share + dense @ bv
            error = (1 / (1 + np.exp(-np.clip(score, -30, 30))) - y) / len(y)
            w_old, b_old = w, b
            w = wv - rate * (by_word(share * error) * ratio + self.penalty * wv)
            b = bv - rate * (dense.T @ error)
        self.weights[used] = w * self.ratio[used] * self.gain
        self.dense_weights = b
        return self

    def predict(self, rows: Rows) -> np.ndarray:
        dense = np.column_stack([np.ones(len(rows)), (rows.dense - self.centre) / self.spread])
        score = np.bincount(rows.owner, weights=self.weights[rows.place], minlength=len(rows)) * self._share(rows) + dense @ self.dense_weights
        return 1 / (1 + np.exp(-np.clip(score, -30, 30)))


def folds_of(ids: np.ndarray, folds: int) -> np.ndarray:
    return (mixed(ids.astype(np.uint64) + np.uint64(77)) % np.uint64(folds)).astype(np.int64)


def style(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Shares of letters, upper case, digits and other visible bytes in each text."""
    visible = ~LETTER & (np.arange(256) > 32) & (np.arange(256) < 127)
    kinds = [LETTER, np.isin(np.arange(256), np.arange(65, 91)), np.isin(np.arange(256), np.arange(48, 58)), visible]
    sizes = np.diff(offsets)
    filled = np.flatnonzero(sizes)
    out = np.zeros((len(sizes), len(kinds)))
    for k in (0, 2):  # two counts in the halves of one sum
        both = kinds[k].astype(np.uint64) | kinds[k + 1].astype(np.uint64) << np.uint64(32)
        total = np.add.reduceat(both[data], offsets[:-1][filled]) if len(filled) else np.zeros(0, np.uint64)
        out[filled, k] = (total & np.uint64(0xFFFFFFFF)) / sizes[filled]
        out[filled, k + 1] = (total >> np.uint64(32)) / sizes[filled]
    return out


def in_slices(batch: pa.RecordBatch, text_at: int, size: int) -> Iterator[pa.RecordBatch]:
    """A batch in parts of about ``size`` bytes of text, one row at least."""
    text = batch.column(text_at)
    total = np.cumsum(pc.binary_length(text).fill_null(0).to_numpy(zero_copy_only=False))
    start = 0
    while start < batch.num_rows:
        before = total[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(total, before + size, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def rows_of(column, bits: int = BITS, distinct: bool = True) -> Rows:
    """The features of a text column."""
    data, offsets = bytes_of(column)
    return Rows(*features(data, offsets, bits, distinct), style(data, offsets))


def sampled_features(sample: DataFrame, id_col: str, text_col: str, labels: list[str], bits: int = BITS, distinct: bool = True) -> tuple[np.ndarray, Rows, dict[str, np.ndarray]]:
    """Features and labels of a bounded sample, brought to the driver, in the order of ids. Texts stay on the executors."""
    schema = "id long, place binary, style binary, " + ", ".join(f"y{i} int" for i in range(len(labels)))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in in_slices(whole, 1, 4 << 20)):
            rows = rows_of(batch.column(1), bits, distinct)
            places = [rows.place[a:b].astype(np.int32).tobytes() for a, b in zip(rows.begins, rows.begins[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(places, pa.binary()), pa.array([r.tobytes() for r in rows.dense], pa.binary()), *batch.columns[2:]],
                names=["id", "place", "style", *(f"y{i}" for i in range(len(labels)))],
            )

    flat = sample.select(exact(id_col).cast("long").alias("id"), exact(text_col).cast("string").alias("text"), *(exact(c).cast("int").alias(f"y{i}") for i, c in enumerate(labels)))
    got = flat.mapInArrow(extract, schema).orderBy("id", F.md5("place")).toArrow()
    places = [np.frombuffer(v, np.int32) for v in got["place"].to_pylist()]
    dense = np.array([np.frombuffer(v) for v in got["style"].to_pylist()]).reshape(len(places), 4)
    begins = np.concatenate([[0], np.cumsum([len(p) for p in places])]).astype(np.int64)
    rows = Rows(np.concatenate(places).astype(np.int64) if places else np.zeros(0, np.int64), begins, dense)
    return got["id"].to_numpy(), rows, {c: got[f"y{i}"].to_numpy() for i, c in enumerate(labels)}

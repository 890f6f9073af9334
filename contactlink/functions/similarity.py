"""String similarity on a 0..100 scale.

The metric is the normalised Indel ratio ``(1 - (n + m - 2*LCS) / (n + m)) * 100``,
by default after sorting the tokens. Spark has no built-in for the longest common
subsequence, and a version made of higher-order functions measured about fifteen
times slower than the Arrow-batched one here, so the LCS length is the library's one
pandas UDF; everything around it is native.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from contactlink.functions import text

_WORD = 64
_CELLS = 1 << 24  # elements of the comparison matrix held at once


def _codes(strings: list[str], width: int, pad: int) -> np.ndarray:
    """Code points of the strings as a padded matrix."""
    out = np.full((len(strings), width), pad, dtype=np.uint32)
    lengths = np.fromiter(map(len, strings), dtype=np.int64, count=len(strings))
    flat = np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    out[np.arange(width) < lengths[:, None]] = flat
    return out


def _lcs_chunk(left: list[str], right: list[str]) -> np.ndarray:
    """LCS lengths by the bit-vector recurrence of Hyyro (2004), over all rows at once."""
    size = np.fromiter(map(len, left), dtype=np.int64, count=len(left))
    words = max(1, -(-int(size.max(initial=0)) // _WORD))
    a = _codes(left, words * _WORD, 0xFFFFFFFE)
    b = _codes(right, max(map(len, right), default=0), 0xFFFFFFFF)
    state = np.full((len(left), words), np.iinfo(np.uint64).max, dtype=np.uint64)
    for j in range(b.shape[1]):
        hits = np.packbits(a == b[:, j : j + 1], axis=1, bitorder="little").view(np.uint64)
        shared = state & hits
        if words == 1:
            state = (state + shared) | (state & ~hits)
            continue
        carry = np.zeros(len(left), dtype=np.uint64)
        for w in range(words):  # addition of multi-word numbers
            old, add = state[:, w], shared[:, w]
            part = old + add
            total = part + carry
            carry = ((part < old) | (total < part)).astype(np.uint64)
            state[:, w] = total | (old & ~hits[:, w])
    # Bits past the end of a string never match, so they stay set.
    return words * _WORD - np.bitwise_count(state).sum(axis=1, dtype=np.int64)


def lcs_lengths(left: pd.Series, right: pd.Series) -> np.ndarray:
    """LCS length of each pair of strings; any length, nulls count as ''."""
    a, b = left.fillna("").tolist(), right.fillna("").tolist()
    # Both sides are padded to the longest of a chunk, so the longer string of a pair counts.
    size = np.fromiter((max(len(x), len(y)) for x, y in zip(a, b)), dtype=np.int64, count=len(a))
    out = np.zeros(len(a), dtype=np.int64)
    order = np.argsort(size, kind="stable")  # similar lengths share a chunk
    start = 0
    while start < len(order):
        stop = len(order)
        while stop > start + 1 and (stop - start) * max(_WORD, int(size[order[stop - 1]])) > _CELLS:
            stop = start + max(1, (stop - start) // 2)
        rows = order[start:stop]
        out[rows] = _lcs_chunk([a[i] for i in rows], [b[i] for i in rows])
        start = stop
    return out


@cache
def _lcs_udf(pairs: int):
    """UDF of 2 * ``pairs`` strings giving a struct of ``pairs`` lengths.

    Several comparisons of a row share one trip to Python. It is declared
    nondeterministic because a filter on a similarity would otherwise be pushed below the
    projection that computes it, and the UDF would run twice.
    """

    def lengths(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for columns in batches:
            yield pd.DataFrame(
                {f"lcs{i}": lcs_lengths(columns[2 * i], columns[2 * i + 1]).astype("int32") for i in range(pairs)}
            )

    lengths.__annotations__ = {"batches": Iterator[tuple[pd.Series, ...]], "return": Iterator[pd.DataFrame]}
    schema = T.StructType([T.StructField(f"lcs{i}", T.IntegerType()) for i in range(pairs)])
    return F.pandas_udf(lengths, schema).asNondeterministic()


def lcs_lengths_of(pairs: Sequence[tuple[Column, Column]]) -> Column:
    """Struct ``lcs0, lcs1, ..`` of the LCS lengths of several pairs of strings."""
    return _lcs_udf(len(pairs))(*(c for pair in pairs for c in pair))


def lcs_length(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence of two strings."""
    return lcs_lengths_of([(a, b)])["lcs0"]


def indel_ratio(a: Column, b: Column, lcs: Column | None = None) -> Column:
    """Indel ratio of two strings as they are; 0 if either is empty."""
    total = (F.length(a) + F.length(b)).cast("double")
    common = lcs_length(a, b) if lcs is None else lcs
    distance = (F.length(a) + F.length(b) - 2 * common).cast("double")
    return F.when((a != "") & (b != ""), (F.lit(1.0) - distance / total) * 100.0).otherwise(F.lit(0.0))


def length_bound(a: Column, b: Column) -> Column:
    """Upper bound of ``indel_ratio`` from the lengths alone."""
    shorter = F.least(F.length(a), F.length(b))
    return F.when((a != "") & (b != ""), shorter * 200.0 / (F.length(a) + F.length(b))).otherwise(F.lit(0.0))


_BAG_BITS = 63  # per half; the sign bit stays free


def bag_signature(value: Column) -> tuple[Column, Column]:
    """Two bit sets over the characters of a string, counted with their occurrence.

    The k-th occurrence of a character is one element. Every bit in which two signatures
    differ stands for an element that one string has and the other lacks, so the number
    of such bits is a lower bound of the Indel distance.
    """
    def slot(char: Column, i: Column) -> Column:
        upto = F.substr(value, F.lit(1), i + 1)
        occurrence = F.length(upto) - F.length(F.replace(upto, char, F.lit("")))
        return F.pmod(F.xxhash64(char, occurrence), F.lit(2 * _BAG_BITS)).cast("int")

    def bits(slots: Column, base: int) -> Column:
        one = F.lit(1).cast("bigint")
        inside = F.filter(slots, lambda s: (s >= base) & (s < base + _BAG_BITS))
        return F.aggregate(
            inside, F.lit(0).cast("bigint"), lambda acc, s: acc.bitwiseOR(F.call_function("shiftleft", one, s - base))
        )

    slots = F.when(value != "", F.transform(F.split(value, ""), slot)).when(value == "", F.array().cast("array<int>"))
    return bits(slots, 0), bits(slots, _BAG_BITS)


def bag_bound(a: Column, b: Column, bags: list[tuple[Column, Column]]) -> Column:
    """Upper bound of ``indel_ratio`` from the bag signatures of both strings."""
    differ = F.bit_count(bags[0][0].bitwiseXOR(bags[0][1])) + F.bit_count(bags[1][0].bitwiseXOR(bags[1][1]))
    total = F.length(a) + F.length(b)
    return F.when(total > 0, (total - differ) * 100.0 / total).otherwise(F.lit(0.0))


def token_sort_ratio(a: Column, b: Column) -> Column:
    return indel_ratio(text.token_sort(a), text.token_sort(b))


def ratio(a: Column, b: Column) -> Column:
    return indel_ratio(text.strip(a), text.strip(b))


_SPACES = re.compile("[" + "".join(map(re.escape, text.SPACE_CHARACTERS)) + "]+")


def _token_set(left: pd.Series, right: pd.Series) -> pd.Series:
    """Scores of stripped texts that are not empty; nulls and empty texts score 0."""
    n = len(left)
    both, only_a, only_b, blank = np.zeros(n), [""] * n, [""] * n, np.zeros(n, bool)
    for i, (x, y) in enumerate(zip(left.fillna(""), right.fillna(""))):
        if not x or not y:
            blank[i] = True
            continue
        a, b = set(_SPACES.split(x)), set(_SPACES.split(y))
        both[i] = len(" ".join(a & b))
        only_a[i], only_b[i] = " ".join(sorted(a - b)), " ".join(sorted(b - a))
    lcs = lcs_lengths(pd.Series(only_a, dtype=object), pd.Series(only_b, dtype=object))
    n_a, n_b = (np.fromiter(map(len, side), np.float64, n) for side in (only_a, only_b))
    shared = both > 0
    with_a, with_b = both + shared + n_a, both + shared + n_b

    def score(distance: np.ndarray, total: np.ndarray) -> np.ndarray:
        return np.where(total > 0, 100.0 - distance * 100.0 / np.maximum(total, 1), 0.0)

    # With a common prefix the Indel distance is that of the remainders.
    best = score(n_a + n_b - 2 * lcs, with_a + with_b)
    for rest, side in ((n_a, with_a), (n_b, with_b)):
        best = np.where(shared, np.maximum(best, score(1 + rest, both + side)), best)
    best[shared & ((n_a == 0) | (n_b == 0))] = 100.0
    return pd.Series(np.where(blank, 0.0, best))


@F.pandas_udf(T.DoubleType())
def _token_set_udf(left: pd.Series, right: pd.Series) -> pd.Series:
    return _token_set(left, right)


def token_set_ratio(a: Column, b: Column) -> Column:
    """Best of the shared tokens against each side, and of the sides without them.

    In one call: as column expressions each use of a token list repeats what it is made of.
    """
    return _token_set_udf(text.strip(a), text.strip(b))


_STRANDS = 1 << 19  # strands followed at once


def _strand_starts(short: list[str], long: list[str]) -> np.ndarray:
    """Semi-local comparison of each pair by a braid of strands (Tiskin): for every column of the longer string, a row
    each, the column where the strand that leaves the grid there came in; negative if it came in from the side.

    Strands enter a grid of the characters from the top and the left, and two that meet cross unless the characters
    are equal or they have crossed before. The window ``[l, r)`` then has a common subsequence of its width less the
    strands that enter at ``l`` or later and leave before ``r``, for all windows out of one pass. The cells of a
    diagonal do not depend on each other, so a step is one diagonal of all pairs.
    """
    m, n = max(map(len, short)), max(map(len, long))
    a = np.ascontiguousarray(_codes(short, m, 0xFFFFFFFE).T[::-1])  # last character first: a diagonal is a slice of both
    b = np.ascontiguousarray(_codes(long, n, 0xFFFFFFFF).T)
    side = np.repeat(np.arange(-m, 0, dtype=np.int32)[:, None], len(short), axis=1)
    down = np.repeat(np.arange(n, dtype=np.int32)[:, None], len(short), axis=1)
    for shift in range(1 - m, n):
        rows = slice(max(0, -shift), min(m, n - shift))
        columns = slice(rows.start + shift, rows.stop + shift)
        h, v = side[rows], down[columns]
        # Padding never matches, and its strands are below all others, so nothing turns there.
        turn = (a[rows] == b[columns]) | (h > v)
        side[rows], down[columns] = np.where(turn, v, h), np.where(turn, h, v)
    return down


def _best_windows(short: list[str], long: list[str]) -> np.ndarray:
    """Best Indel ratio of each short string against the windows of its width in the long one, cut off at both ends."""
    starts = _strand_starts(short, long)
    m = np.fromiter(map(len, short), np.int64, len(short))
    n = np.fromiter(map(len, long), np.int64, len(long))
    column = np.arange(len(starts))[:, None]
    leaves = np.full(starts.shape, len(starts))
    rows, pairs = np.nonzero((starts >= 0) & (column < n))
    leaves[starts[rows, pairs], pairs] = rows

    def ratios(width: np.ndarray, crossing: np.ndarray, valid: np.ndarray) -> np.ndarray:
        total = np.maximum(m + width, 1).astype(np.float64)
        score = (1.0 - (total - 2 * (width - crossing)) / total) * 100.0
        return np.where(valid, score, 0.0).max(axis=0)

    # Windows by their last column: one strand may come in with it, one may fall out with the column left behind.
    behind = np.take_along_axis(leaves, np.maximum(column - m, 0), axis=0)
    gained = starts >= np.maximum(column + 1 - m, 0)
    crossing = np.cumsum(gained.astype(np.int64) - ((column >= m) & (behind < column)), axis=0)
    ending = ratios(np.minimum(column + 1, m), crossing, column < n)
    # Windows cut off by the end, by their first column.
    inside = (leaves < len(starts)) & (column < n)
    crossing = np.cumsum(inside[::-1], axis=0)[::-1]
    return np.maximum(ending, ratios(n - column, crossing, (column > n - m) & (column < n)))


def _partial(left: pd.Series, right: pd.Series) -> pd.Series:
    """Best Indel ratio of the shorter string against any window of its width in the longer; strings of one length are
    tried both ways."""
    best = np.zeros(len(left))
    tries = []
    for i, (x, y) in enumerate(zip(left.fillna(""), right.fillna(""))):
        s, t = (x, y) if len(x) <= len(y) else (y, x)
        if s == t:
            best[i] = 100.0 if s else 0.0
        elif s:
            tries.append((i, s, t))
            if len(s) == len(t):
                tries.append((i, t, s))
    tries.sort(key=lambda one: (len(one[2]), len(one[1])))  # similar lengths share a chunk
    start = 0
    while start < len(tries):
        stop = start + 1
        while stop < len(tries) and (stop + 1 - start) * 2 * len(tries[stop][2]) <= _STRANDS:
            stop += 1
        rows, short, long = zip(*tries[start:stop])
        np.maximum.at(best, np.array(rows), _best_windows(list(short), list(long)))
        start = stop
    return pd.Series(best)


@F.pandas_udf(T.DoubleType())
def _partial_udf(left: pd.Series, right: pd.Series) -> pd.Series:
    return _partial(left, right)


def partial_ratio(a: Column, b: Column) -> Column:
    a, b = text.strip(a), text.strip(b)
    return F.when((a == "") | (b == ""), 0.0).otherwise(_partial_udf(a, b))


_METHODS = {
    "token_sort": token_sort_ratio,
    "ratio": ratio,
    "token_set": token_set_ratio,
    "partial": partial_ratio,
}


def similarity(a: Column, b: Column, method: str = "token_sort") -> Column:
    """Similarity by method name; an unknown name means ``token_sort``."""
    return _METHODS.get(method, token_sort_ratio)(a, b)


def compare_companies(a: Column, b: Column) -> Column:
    return token_sort_ratio(text.company_std(a), text.company_std(b))


def compare_addresses(a: Column, b: Column) -> Column:
    return token_sort_ratio(text.address_std(a), text.address_std(b))


def exact_score(a: Column, b: Column) -> Column:
    """100 if equal and not empty, else 0."""
    return F.when((a == b) & (a != ""), 100.0).otherwise(0.0)


def compare_phones(a: Column, b: Column) -> Column:
    return exact_score(text.phone_std(a), text.phone_std(b))


def compare_emails(a: Column, b: Column) -> Column:
    return exact_score(text.email_std(a), text.email_std(b))


def levenshtein_similarity(a: Column, b: Column) -> Column:
    """Optional comparator: 100 * (1 - edits / longer length)."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when((a != "") & (b != ""), (F.lit(1.0) - F.levenshtein(a, b) / longer.cast("double")) * 100.0).otherwise(0.0)

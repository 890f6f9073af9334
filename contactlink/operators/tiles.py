"""First partners in a group of any size, by tiles of it.

A group is cut into tiles of records. Those that still have no partner are packed into tiles of their own, which meet the
tiles after them (or before them), each pair of tiles in a call of its own. Inside, one matrix product gives for all pairs at once how many
characters their strings have in common, counted with repetition, and another how many pairs of neighbouring characters.
Both bound the longest common subsequence from above, so pairs under the rule's threshold are dropped without comparing
them; the rest is compared by bit vectors, nearest first, and a record leaves as soon as it has its partner. Nothing that
matches is dropped, and no pair leaves the task but the first of each record.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactlink.functions.similarity import lcs_lengths
from contactlink.operators.rules import FUZZY, Rule, RuleSet
from contactlink.operators.skew import SLICE_BITS, with_position

TILE_ROWS = 2048
#: Buckets of characters and of neighbouring characters; more only make the bounds closer.
CHAR_SLOTS, PAIR_SLOTS = 256, 1024
#: Pairs compared at a time, and survivors of a record looked at first.
PAIRS_AT_ONCE, FIRST_TRIES = 1 << 18, 4
_WORD = 64
#: How columns with the keys of earlier blockings begin; see ``matching.by_block``.
MET = "met_"


@dataclass(frozen=True)
class Test:
    """A rule's condition on one comparison column."""

    column: str
    kind: str  # blank, equal, fuzzy
    percentage: float
    include: bool
    blank_allowed: bool


def tests_of(rules: RuleSet, rule: Rule) -> list[Test]:
    out = []
    for c in rule.conditions:
        fuzzy = rules.kind(c.field) in FUZZY and not (c.include and c.percentage >= 100)
        kind = "blank" if c.blank else "fuzzy" if fuzzy else "equal"
        out.append(Test(rules.name(c), kind, c.percentage, c.include, c.blank_allowed))
    return sorted(out, key=lambda t: t.kind == "fuzzy")


def _verdict(score: np.ndarray, test: Test) -> np.ndarray:
    return score >= test.percentage if test.include else score < test.percentage


class Strings:
    """The strings of a tile's column: code points, lengths, and the places of nulls."""

    def __init__(self, values: list[str | None]):
        self.values = [v or "" for v in values]
        self.null = np.array([v is None for v in values], bool)
        self.length = np.fromiter(map(len, self.values), np.int64, len(values))
        self.flat = np.frombuffer("".join(self.values).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.owner = np.repeat(np.arange(len(values)), self.length)
        self.place = np.arange(len(self.flat)) - np.repeat(np.cumsum(self.length) - self.length, self.length)

    def characters(self) -> np.ndarray:
        """How often each k-th occurrence of a character is there, by slots. Where elements share a slot the product of
        two rows only grows."""
        order = np.lexsort((self.place, self.flat, self.owner))
        char, owner = self.flat[order].astype(np.int64), self.owner[order]
        begins = np.ones(len(order), bool)
        begins[1:] = (char[1:] != char[:-1]) | (owner[1:] != owner[:-1])
        occurrence = np.arange(len(order)) - np.maximum.accumulate(np.where(begins, np.arange(len(order)), 0))
        return self._counts(owner, (char * 31 + occurrence * 7919) % CHAR_SLOTS, CHAR_SLOTS)

    def neighbours(self) -> np.ndarray:
        """How often each pair of neighbouring characters is there, by slots."""
        inside = np.flatnonzero(self.owner[1:] == self.owner[:-1])
        pair = self.flat[inside].astype(np.int64) * 1_000_003 + self.flat[inside + 1]
        return self._counts(self.owner[inside], pair % PAIR_SLOTS, PAIR_SLOTS)

    def _counts(self, owner: np.ndarray, slot: np.ndarray, slots: int) -> np.ndarray:
        n = len(self.length)
        return np.bincount(owner * slots + slot, minlength=n * slots).reshape(n, slots).astype(np.float32)


def possible(left: Strings, right: Strings, percentage: float) -> np.ndarray:
    """Pairs whose ratio may reach the percentage, by lengths, common characters and common neighbours."""
    total = left.length[:, None] + right.length[None, :]
    need = percentage / 200 * total - 1e-6  # of the longest common subsequence
    ok = np.minimum(left.length[:, None], right.length[None, :]) >= need
    if ok.any():
        ok &= left.characters() @ right.characters().T >= need
    if ok.any() and percentage > 200 / 3:
        # A subsequence of length n has n - 1 neighbours; each character left out on either side parts at most one.
        ok &= left.neighbours() @ right.neighbours().T >= 3 * need - 1 - total
    return ok


class Lcs:
    """Longest common subsequences of pairs out of two tiles."""

    def __init__(self, left: Strings, right: Strings):
        self.left, self.right = left, right
        self.short = max(left.length.max(initial=0), right.length.max(initial=0)) <= _WORD
        if self.short:
            codes, both = np.unique(np.concatenate([left.flat, right.flat]), return_inverse=True)
            of_left, of_right = both[: len(left.flat)], both[len(left.flat) :]
            # For each left string and character, the bits of its places there.
            self.bits = np.zeros((len(left.length), len(codes) + 1), np.uint64)
            np.bitwise_or.at(self.bits, (left.owner, of_left), np.uint64(1) << left.place.astype(np.uint64))
            self.codes = np.full((len(right.length), int(right.length.max(initial=0))), len(codes), np.int64)
            self.codes[right.owner, right.place] = of_right

    def lengths(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        if not self.short:
            return lcs_lengths(pd.Series([self.left.values[i] for i in a]), pd.Series([self.right.values[j] for j in b]))
        state = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
        for k in range(int(self.right.length[b].max(initial=0))):
            shared = state & (hits := self.bits[a, self.codes[b, k]])
            state = (state + shared) | (state & ~hits)
        return _WORD - np.bitwise_count(state).astype(np.int64)


def first_matches(left: dict[str, list], right: dict[str, list], tests: list[Test], allowed: np.ndarray) -> np.ndarray:
    """For each left record the first right one, by place, that passes all tests; -1 without one. ``allowed`` says which
    pairs count."""
    ok = allowed
    fuzzy: list[tuple[Test, Strings, Strings, Lcs]] = []
    for test in tests:
        if not ok.any():
            break
        a, b = left[test.column], right[test.column]
        none_a, none_b = np.array([v is None for v in a]), np.array([v is None for v in b])
        both = ~none_a[:, None] & ~none_b[None, :]
        if test.kind == "blank":
            ok &= none_a[:, None] & none_b[None, :]
            continue
        if test.kind == "equal":
            score = np.where(_equal(a, b) & (np.array([v != "" for v in a])[:, None]), 100.0, 0.0)
            verdict = _verdict(score, test)
        else:
            strings = Strings(a), Strings(b)
            fuzzy.append((test, *strings, Lcs(*strings)))
            verdict = possible(*strings, test.percentage) if test.include and test.percentage > 0 else np.ones(ok.shape, bool)
        ok &= np.where(both, verdict, test.blank_allowed)
    found = np.full(len(ok), -1, np.int64)
    if not ok.any():
        return found
    # Survivors of each record in order; more of them at a time while it has no partner.
    rows, columns = np.nonzero(ok)
    begins = np.searchsorted(rows, np.arange(len(ok) + 1))
    at, tries = begins[:-1].copy(), FIRST_TRIES
    while len(todo := np.flatnonzero((found < 0) & (at < begins[1:]))):
        per_turn = max(1, PAIRS_AT_ONCE // tries)
        for part in (todo[i : i + per_turn] for i in range(0, len(todo), per_turn)):
            stop = np.minimum(at[part] + tries, begins[part + 1])
            spans = stop - at[part]
            a = np.repeat(part, spans)
            b = columns[np.arange(spans.sum()) + np.repeat(at[part] - np.cumsum(spans) + spans, spans)]
            for test, x, y, lcs in fuzzy:
                total = (x.length[a] + y.length[b]).astype(np.float64)
                with np.errstate(invalid="ignore", divide="ignore"):
                    score = np.where((x.length[a] > 0) & (y.length[b] > 0), (1.0 - (total - 2 * lcs.lengths(a, b)) / total) * 100.0, 0.0)
                passed = np.where(x.null[a] | y.null[b], test.blank_allowed, _verdict(score, test))
                a, b = a[passed], b[passed]
            first = np.unique(a, return_index=True)
            found[first[0]] = b[first[1]]
            at[part] = stop
        tries = min(tries * 4, PAIRS_AT_ONCE)
    return found


def _equal(left: list, right: list) -> np.ndarray:
    """Pairs of equal values; null equals nothing."""
    codes = {v: i for i, v in enumerate(dict.fromkeys([*left, *right]))}
    known = np.array([v is not None for v in left])
    return (np.array([codes[v] for v in left])[:, None] == np.array([codes[v] for v in right])[None, :]) & known[:, None]


def _last_copies(place: np.ndarray, rows: Iterable[tuple]) -> np.ndarray:
    """The place of the last equal row before each row, -1 without one."""
    last: dict[tuple, int] = {}
    out = np.full(len(place), -1, np.int64)
    for i, row in enumerate(rows):
        out[i] = last.get(row, -1)
        last[row] = place[i]
    return out


def packed(todo: DataFrame, on: list[str], tile_rows: int, bits: int = SLICE_BITS) -> DataFrame:
    """Records that search, with the tile ``mine`` of the next ``tile_rows`` of them in their group."""
    ranked = with_position(todo.drop("mine", "n").withColumnRenamed("pos", "_place"), on, "_place", bits)
    return ranked.withColumn("mine", F.floor(F.col("pos") / tile_rows).cast("long")).drop("pos", "n").withColumnRenamed("_place", "pos")


def search(
    todo: DataFrame, everyone: DataFrame, on: list[str], rules: RuleSet, rule: Rule, start: int, backward: bool, tile_rows: int = TILE_ROWS,
    reach: int | None = None
) -> DataFrame:
    """``ord, match_ord`` for records of ``todo`` with a partner more than ``start`` places away in their group, and at most
    ``reach`` further. Both tables have ``ord``, the place ``pos`` in the group, ``first``/``last`` (how far a search goes) and
    comparison columns; ``todo`` is ``packed``."""
    tests = tests_of(rules, rule)
    names = list(dict.fromkeys(t.column for t in tests))
    labelled = "label" in todo.columns
    keys = [F.col(c).alias(f"k{i}") for i, c in enumerate(on)]
    group = [f"k{i}" for i in range(len(on))]
    low = F.col("first") if backward else F.col("pos") + start + 1
    high = F.col("pos") - start - 1 if backward else F.col("last")
    if reach:
        low, high = (F.greatest(low, F.col("pos") - start - reach), high) if backward else (low, F.least(high, F.col("pos") + start + reach))
    tile = lambda c: F.floor(c / tile_rows).cast("long")
    label = F.col("label") if labelled else F.lit(None).cast("long")
    met = [c for c in todo.columns if c.startswith(MET)]
    values = [*(F.col(c).alias(f"v{i}") for i, c in enumerate(names)), *met]
    left = todo.select(*keys, "ord", "mine", low.alias("low"), high.alias("high"), label.alias("label"), *values).filter("low <= high")
    spans = left.groupBy(*group, "mine").agg(F.min(tile(F.col("low"))).alias("from"), F.max(tile(F.col("high"))).alias("upto"))
    asked = spans.select(*group, (F.col("mine") + 0).alias("mine"), F.explode(F.sequence("from", "upto")).alias("theirs"))
    right = everyone.select(*keys, F.col("ord").alias("match_ord"), "pos", label.alias("label"), *values)
    right = right.withColumn("theirs", tile(F.col("pos"))).join(asked, [*group, "theirs"])
    left = left.withColumn("theirs", F.explode(F.sequence(tile(F.col("low")), tile(F.col("high")))))
    columns = [f"v{names.index(t.column)}" for t in tests]
    renamed = [Test(c, t.kind, t.percentage, t.include, t.blank_allowed) for c, t in zip(columns, tests)]
    schema = pa.schema([("ord", pa.int64()), ("match_ord", pa.int64())])

    def meet(key, these: pa.Table, those: pa.Table) -> pa.Table:
        if not these.num_rows or not those.num_rows:
            return schema.empty_table()
        those = those.sort_by("pos")
        place, begin = those["pos"].to_numpy(), these["low"].to_numpy()
        allowed = (place[None, :] >= begin[:, None]) & (place[None, :] <= these["high"].to_numpy()[:, None])
        if labelled:
            allowed &= these["label"].to_numpy()[:, None] != those["label"].to_numpy()[None, :]
        else:
            # An earlier copy in the tile that the record meets has the same verdict.
            allowed &= _last_copies(place, zip(*(those[c].to_pylist() for c in [*dict.fromkeys(columns), *met])))[None, :] < begin[:, None]
        for c in met:
            allowed &= ~_equal(these[c].to_pylist(), those[c].to_pylist())
        used = dict.fromkeys(columns)
        found = first_matches({c: these[c].to_pylist() for c in used}, {c: those[c].to_pylist() for c in used}, renamed, allowed)
        hit = np.flatnonzero(found >= 0)
        return pa.Table.from_arrays([pa.array(these["ord"].to_numpy()[hit]), pa.array(those["match_ord"].to_numpy()[found[hit]])], schema=schema)

    pairs = left.groupBy(*group, "mine", "theirs").cogroup(right.groupBy(*group, "mine", "theirs")).applyInArrow(meet, "ord long, match_ord long")
    return pairs.groupBy("ord").agg(F.min("match_ord").alias("match_ord"))

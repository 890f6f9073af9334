"""First partners inside blocks that fit a task, many blocks at a time.

Records come sorted by block and order. A task takes whole blocks, and for each rule every record without a partner looks
at its next followers in its group, at twice as many the next time, and so on to the end of the group. Pairs are dropped
by the equal and blank conditions, by lengths and by sets of characters, and only the rest is compared. A record leaves
as soon as it has its partner, so groups of similar records cost a few comparisons a row, and no pair leaves the task
but the first of each record. Of blocks that do not fit a task, slices are searched in the same way, each with the slice
after it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactlink.functions.similarity import lcs_lengths
from contactlink.operators.rules import FUZZY, Rule, RuleSet
from contactlink.operators.storage import materialize
from contactlink.operators.tiles import MET, Lcs, Strings, Test, _verdict, tests_of

#: Rows worked on at a time, besides those of a block that is not complete yet; pairs looked at, and compared, at a time.
ROWS_AT_ONCE, PAIRS_AT_ONCE, COMPARED_AT_ONCE = 1 << 14, 1 << 20, 1 << 16
#: Elements up to which the bits of all strings of a column are kept.
BITS_KEPT = 1 << 23


class Column:
    """A comparison column: a code for each row (-1 for null) and the distinct values."""

    def __init__(self, values: pa.ChunkedArray):
        coded = values.combine_chunks().dictionary_encode()
        self.code = coded.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        self.values = coded.dictionary.to_pylist()
        self.blank = np.array([v == "" for v in self.values] + [False])
        self._strings: Strings | None = None

    def _prepare(self) -> None:
        if self._strings is not None:
            return
        self._strings = strings = Strings(self.values)
        self.lengths = np.append(strings.length, 0)
        # Four words of bits over the characters of a string, counted with their occurrence; see ``bag_signature``.
        self.bags = np.zeros((4, len(self.values) + 1), np.uint64)
        slots = strings.characters() > 0
        self.bags[:, :-1] = np.packbits(slots, axis=1, bitorder="little").view(np.uint64).T
        in_word = (strings.length <= 64) & (len(np.unique(strings.flat)) * len(self.values) <= BITS_KEPT)
        self.in_word = np.append(in_word, False)
        short = Strings([v if ok else "" for v, ok in zip(self.values, in_word)])
        self.lcs = Lcs(short, short)

    def bound(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Upper bound of the ratio of pairs of rows, by lengths and characters."""
        self._prepare()
        x, y = self.code[a], self.code[b]
        total = self.lengths[x] + self.lengths[y]
        differ = sum(np.bitwise_count(w[x] ^ w[y]).astype(np.int64) for w in self.bags)
        common = np.minimum(np.minimum(self.lengths[x], self.lengths[y]) * 2, total - differ)
        return np.where(total > 0, common * 100.0 / np.maximum(total, 1), 0.0)

    def ratio(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Indel ratio of pairs of rows; 0 if either is empty or null."""
        self._prepare()
        x, y = self.code[a], self.code[b]
        common = np.zeros(len(x), np.int64)
        quick = self.in_word[x] & self.in_word[y]
        for part in np.array_split(np.flatnonzero(quick), max(1, len(x) // COMPARED_AT_ONCE)):
            if len(part):
                common[part] = self.lcs.lengths(x[part], y[part])
        slow = np.flatnonzero(~quick & (x >= 0) & (y >= 0))
        if len(slow):
            common[slow] = lcs_lengths(pd.Series([self.values[i] for i in x[slow]]), pd.Series([self.values[i] for i in y[slow]]))
        n, m = self.lengths[x], self.lengths[y]
        total = (n + m).astype(np.float64)
        score = (1.0 - (total - 2 * common) / np.maximum(total, 1.0)) * 100.0
        return np.where((n > 0) & (m > 0), score, 0.0)

    def exact(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.where((self.code[a] == self.code[b]) & (self.code[a] >= 0) & ~self.blank[self.code[a]], 100.0, 0.0)

    def null(self, rows: np.ndarray) -> np.ndarray:
        return self.code[rows] < 0


def _groups(*codes: np.ndarray) -> np.ndarray:
    """A number for each distinct combination of codes."""
    out = codes[0]
    for more in codes[1:]:
        _, out = np.unique(out * (more.max(initial=0) + 2) + more + 1, return_inverse=True)
    return out


def _runs(group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows sorted by group: where the row's group begins and ends."""
    begins = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    of = np.cumsum(np.append(True, group[1:] != group[:-1])) - 1
    return begins[of], np.append(begins[1:], len(group))[of]


class Block:
    """Rows of whole blocks, in order, and the rules that look for partners in them. With a column ``slice_no`` the rows are
    of slices, and their order is the place ``pos``."""

    def __init__(self, table: pa.Table, rules: RuleSet):
        self.rules = rules
        self.n = table.num_rows
        self.block = Column(table["block_key"]).code
        self.columns = {name: Column(table[name]) for name in rules.columns.values()}
        self.met = [Column(table[c]) for c in table.column_names if c.startswith(MET)]
        self.order = table["ord"].to_numpy()
        if "slice_no" in table.column_names:
            self.block, self.order = _groups(self.block, table["slice_no"].to_numpy()), table["pos"].to_numpy()
        self.label = table["label"].to_numpy() if "label" in table.column_names else None

    def eligible(self, rule: Rule) -> np.ndarray:
        """The same as ``RuleSet.eligible``."""
        ok = np.ones(self.n, bool)
        for c in rule.conditions:
            column = self.columns[self.rules.name(c)]
            null, empty = column.code < 0, column.blank[column.code]
            if c.blank:
                ok &= null
            elif c.include and c.percentage > 0 and not c.blank_allowed:
                ok &= ~null & ~empty
            elif not c.blank_allowed:
                ok &= ~null
        return ok

    def accepts_copy(self, rule: Rule) -> np.ndarray:
        """The same as ``RuleSet.accepts_copy``."""
        ok = np.ones(self.n, bool)
        for c in rule.conditions:
            column = self.columns[self.rules.name(c)]
            null = column.code < 0
            if c.blank:
                ok &= null
                continue
            score = np.where(null | column.blank[column.code], 0.0, 100.0)
            ok &= np.where(null, c.blank_allowed, score >= c.percentage if c.include else score < c.percentage)
        return ok

    def _allowed(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether pairs of rows are compared here: not with one label, nor with an earlier key in common."""
        ok = np.ones(len(a), bool) if self.label is None else self.label[a] != self.label[b]
        for met in self.met:
            ok &= (met.code[a] != met.code[b]) | met.null(a)
        return ok

    def _passing(self, tests: list[Test], a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which pairs pass all tests, cheap ones first."""
        left = np.arange(len(a))
        for step in ("plain", "bound", "ratio"):
            for t in tests:
                if not len(left) or (t.kind == "fuzzy") != (step != "plain"):
                    continue
                column, x, y = self.columns[t.column], a[left], b[left]
                none = column.null(x) | column.null(y)
                if t.kind == "blank":
                    left = left[column.null(x) & column.null(y)]
                    continue
                if step == "bound":
                    if not t.include or t.percentage <= 0:
                        continue
                    verdict = column.bound(x, y) >= t.percentage - 1e-6
                else:
                    verdict = _verdict(column.exact(x, y) if step == "plain" else column.ratio(x, y), t)
                left = left[np.where(none, t.blank_allowed, verdict)]
        return left

    def search(self, rule: Rule, todo: np.ndarray, backward: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Rows out of ``todo`` (a mask) and the first partner of each after it, or before it."""
        rows = np.flatnonzero(self.eligible(rule))
        names = list(dict.fromkeys(self.rules.name(c, s) for c in rule.conditions for s in (False, True)))
        group = _groups(self.block[rows], *(self.columns[c].code[rows] for c in self.rules.equal_columns(rule)))
        profile = _groups(group, *(self.columns[c].code[rows] for c in names))
        if self.label is not None:
            # Rows that a rule cannot tell apart and that have one label already stand for each other.
            first = np.unique(_groups(profile, np.unique(self.label[rows], return_inverse=True)[1]), return_index=True)[1]
            first.sort()
            rows, group, profile = rows[first], group[first], profile[first]
        if backward:
            rows, group, profile = rows[::-1], group[::-1], profile[::-1]
        order = np.argsort(group, kind="stable")
        rows, group, profile = rows[order], group[order], profile[order]
        if not len(rows):
            return rows, rows
        begin, end = _runs(group)
        number = self.order[rows]
        repeated = bool(((number[1:] == number[:-1]) & (group[1:] == group[:-1])).any())
        place = np.arange(len(rows))
        last = end.copy()
        before = np.full(len(rows), -1)
        if self.label is None and not repeated:
            by_profile = np.argsort(profile, kind="stable")
            same = profile[by_profile][1:] == profile[by_profile][:-1]
            before[by_profile[1:][same]] = by_profile[:-1][same]
            copies = self.accepts_copy(rule)[rows]
            following = np.full(len(rows), len(rows))
            following[by_profile[:-1][same]] = by_profile[1:][same]
            last = np.where(copies, np.minimum(last, following + 1), last)
        wanted = todo[rows] & (end - begin > 1)
        for met in self.met:  # a group that shares an earlier key throughout has been compared there
            code = met.code[rows]
            starts = np.flatnonzero(place == begin)
            one = (np.minimum.reduceat(code, starts) == np.maximum.reduceat(code, starts)) & (code[starts] >= 0)
            wanted &= ~np.repeat(one, np.diff(np.append(starts, len(rows))))
        if self.label is not None:
            value, starts = self.label[rows], np.flatnonzero(place == begin)
            one = np.minimum.reduceat(value, starts) == np.maximum.reduceat(value, starts)
            wanted &= ~np.repeat(one, np.diff(np.append(starts, len(rows))))
        left, at, width = np.flatnonzero(wanted), None, 2
        at = left + 1
        hits: list[tuple[np.ndarray, np.ndarray]] = []
        tests = tests_of(self.rules, rule)
        while len(left):
            found = np.full(len(left), -1)
            per_turn = max(1, PAIRS_AT_ONCE // width)
            for turn in (slice(i, i + per_turn) for i in range(0, len(left), per_turn)):
                mine, low = left[turn], at[turn]
                spans = np.clip(last[mine] - low, 0, width)
                who = np.repeat(np.arange(len(mine)), spans)
                b = np.arange(len(who)) - np.repeat(np.cumsum(spans) - spans, spans) + low[who]
                a = mine[who]
                keep = before[b] <= a  # an earlier copy after the record had the same verdict
                keep &= number[b] < number[a] if backward else number[b] > number[a]
                keep &= self._allowed(rows[a], rows[b])
                who, a, b = who[keep], a[keep], b[keep]
                passed = self._passing(tests, rows[a], rows[b])
                first_who, first = np.unique(who[passed], return_index=True)
                found[np.arange(len(left))[turn][first_who]] = b[passed][first]
            got = found >= 0
            a, b = left[got], found[got]
            hits.append((rows[a], rows[b]))
            while repeated and len(b):  # other records of the partner's number count as much as it does
                more = (b + 1 < end[a]) & (number[np.minimum(b + 1, len(rows) - 1)] == number[b])
                a, b = a[more], b[more] + 1
                passed = self._allowed(rows[a], rows[b])
                passed = np.flatnonzero(passed)[self._passing(tests, rows[a[passed]], rows[b[passed]])]
                hits.append((rows[a[passed]], rows[b[passed]]))
            at = at + width
            rest = ~got & (at < last[left])
            left, at = left[rest], at[rest]
            width *= 2
        return tuple(np.concatenate(side) for side in zip(*hits)) if hits else (rows[:0], rows[:0])

    def scores(self, rule: Rule, a: np.ndarray, b: np.ndarray) -> dict[str, np.ndarray]:
        """The same as ``RuleSet.scores``; NaN for null."""
        out = {}
        for c in rule.conditions:
            column = self.columns[self.rules.name(c, for_score=True)]
            if self.rules.kind(c.field, True) not in FUZZY:
                score = column.exact(a, b)
            elif c.blank:
                score = np.full(len(a), np.nan)
            elif self.rules.needs_lcs(rule, c, for_score=True):
                score = column.ratio(a, b)
            else:
                score = np.full(len(a), 100.0)
            out[c.field] = np.where(column.null(a) | column.null(b), np.nan, score)
        return out


def _whole_blocks(batches: Iterator[pa.RecordBatch], rows: int, key: str = "block_key") -> Iterator[pa.Table]:
    """Tables of about ``rows`` rows that end where a block, or another ``key``, ends."""
    waiting: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        waiting.append(batch)
        size += batch.num_rows
        if size < rows:
            continue
        table = pa.Table.from_batches(waiting)
        keys = table[key].combine_chunks()
        changes = np.flatnonzero(pa.compute.not_equal(keys[1:], keys[:-1]).to_numpy(zero_copy_only=False))
        if len(changes):
            cut = int(changes[-1]) + 1
            yield table.slice(0, cut)
            table = table.slice(cut)
        waiting, size = table.to_batches(), table.num_rows
    if size:
        yield pa.Table.from_batches(waiting)


def _sorted_blocks(records: DataFrame, rules: RuleSet, more: list[str]) -> DataFrame:
    met = [c for c in records.columns if c.startswith(MET)]
    # A record without a number is before and after none.
    chosen = records.filter("ord IS NOT NULL").select("block_key", "ord", *more, *met, *rules.columns.values())
    return chosen.repartition("block_key").sortWithinPartitions("block_key", "ord")


class _Found:
    """The shape of found partners: ``ord, rule_rank, match_ord, [match_given_key], score_0..``."""

    def __init__(self, records: DataFrame, rules: RuleSet):
        self.rules, self.given = rules, "given_key" in records.columns
        self.fields = [f"score_{i}" for i in range(len(rules.score_fields))]
        self.schema = pa.schema([("ord", pa.int64()), ("rule_rank", pa.int32()), ("match_ord", pa.int64()),
                                 *([("match_given_key", pa.string())] if self.given else []), *((f, pa.float64()) for f in self.fields)])
        given = ", match_given_key string" if self.given else ""
        self.text = "ord long, rule_rank int, match_ord long" + given + "".join(f", {f} double" for f in self.fields)

    def batch(self, table: pa.Table, block: Block, rank: int, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        order, scores = table["ord"].to_numpy(), block.scores(self.rules.rules[rank], a, b)
        columns = [pa.array(order[a]), pa.array(np.full(len(a), rank, np.int32)), pa.array(order[b])]
        if self.given:
            columns.append(table["given_key"].combine_chunks().take(pa.array(b)))
        none = np.full(len(a), np.nan)
        columns += [pa.array(scores.get(f, none), pa.float64(), from_pandas=True) for f in self.rules.score_fields]
        return pa.RecordBatch.from_arrays(columns, schema=self.schema)


def first_partners(records: DataFrame, rules: RuleSet) -> DataFrame:
    """``ord, rule_rank, match_ord, [match_given_key], score_0..``: the earliest later record of the block under the best rule.
    A number that several records have comes several times."""
    out = _Found(records, rules)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_blocks(batches, ROWS_AT_ONCE):
            block = Block(table, rules)
            todo = np.ones(table.num_rows, bool)
            for rank, rule in enumerate(rules.rules):
                a, b = block.search(rule, todo)
                todo[a] = False
                yield out.batch(table, block, rank, a, b)

    return _sorted_blocks(records, rules, ["given_key"] if out.given else []).mapInArrow(find, out.text)


def sliced_partners(placed: DataFrame, on: list[str], rules: RuleSet, rank: int, rows: int, backward: bool = False) -> DataFrame:
    """The same, under one rule, for the ``wanted`` records of groups of any size: the first partner in the own slice of
    ``rows`` places or the next one (the one before), so among ``rows`` neighbours at least.

    ``placed`` has the place ``pos`` of a record in the group of its columns ``on``, and may have labels; records that a label
    already joins are no partners.
    """
    out = _Found(placed, rules)
    mine = F.floor(F.col("pos") / rows).cast("long")
    asked = materialize(placed.filter("wanted").select(*on, mine.alias("slice_no")).distinct(), "slices")
    sides = F.array(F.struct(mine.alias("slice_no"), F.col("wanted")), F.struct((mine + (1 if backward else -1)).alias("slice_no"), F.lit(False).alias("wanted")))
    chosen = [c for c in placed.columns if c in ("block_key", "ord", "pos", "given_key", "label", *rules.columns.values()) or c.startswith(MET)]
    seen = placed.select(*chosen, F.explode(sides).alias("_side")).select(*chosen, "_side.*").join(asked, [*on, "slice_no"], "left_semi")
    seen = seen.withColumn("slice_key", F.xxhash64(*on, "slice_no")).repartition("slice_key").sortWithinPartitions("slice_key", "pos")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_blocks(batches, ROWS_AT_ONCE, "slice_key"):
            block = Block(table, rules)
            a, b = block.search(rules.rules[rank], table["wanted"].to_numpy(), backward)
            yield out.batch(table, block, rank, a, b)

    return seen.mapInArrow(find, out.text)


def _joined(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The labels (codes from 0) of rows after those of the pairs became one, the smallest of them."""
    root = np.arange(labels.max(initial=-1) + 1)
    x, y = labels[a], labels[b]
    while len(apart := np.flatnonzero(root[x] != root[y])):
        x, y = root[x[apart]], root[y[apart]]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(further := root[root], root):
            root = further
    return root[labels]


def linking_partners(records: DataFrame, rules: RuleSet) -> DataFrame:
    """``src, dst``: links that join all labels of a block that any chain of partners joins, one for each label, to the
    smallest ``ord`` among them. Of records that a rule cannot tell apart and that have one label, one is looked at."""
    schema = pa.schema([("src", pa.int64()), ("dst", pa.int64())])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_blocks(batches, ROWS_AT_ONCE):
            block, order = Block(table, rules), table["ord"].to_numpy()
            first, before = np.unique(block.label, return_index=True, return_inverse=True)[1:]
            block.label, active = before, np.ones(table.num_rows, bool)
            while active.any():
                pairs = [(before[:0], before[:0])]
                for backward in (False, True):
                    todo = active.copy()
                    for rule in rules.rules:
                        pairs.append(block.search(rule, todo, backward))
                        todo[pairs[-1][0]] = False
                a, b = (np.concatenate(side) for side in zip(*pairs))
                block.label = _joined(block.label, a, b)
                active &= np.isin(block.block, block.block[a])  # where none was found, none is left
            centre = np.full(len(first), np.iinfo(np.int64).max)
            np.minimum.at(centre, block.label, order)
            centre = centre[block.label[first]]
            several = np.bincount(block.label[first], minlength=len(first))[block.label[first]] > 1
            several &= order[first] != centre
            yield pa.RecordBatch.from_arrays([pa.array(order[first][several]), pa.array(centre[several])], schema=schema)

    return _sorted_blocks(records, rules, ["label"]).mapInArrow(find, "src long, dst long")

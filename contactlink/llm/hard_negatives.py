"""Hard negatives by the threshold algorithm of Fagin, Lotem and Naor.

A block of candidates keeps one list of its rows per dimension, sorted by that component. An anchor reads the lists side
by side, from the end that its own component's sign favours, and scores every row it meets by random access. After some
depth, no row unread anywhere can score more than the anchor's product with the values reached in the lists. A window of
scores is done in the block once that threshold lies strictly under its k-th best score, or under the window.

Anchors and candidates are dealt into blocks of bounded size, and every block of anchors meets every block of candidates:
a stated set of queries against all rows. A block gives at most k rows for an anchor and window, so what is joined after
it stays small.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from contactlink.llm.tables import exact
from contactlink.operators.storage import materialize

POSITIVES, NEGATIVES = 5, 3
#: Scores of negatives in hundredths of the positive's score.
LOW, HIGH = 50, 95
SCALE = 256
BLOCK_ROWS, ANCHOR_ROWS = 8192, 2048
FIRST_DEPTH = 16
LONG = np.iinfo(np.int64)
NO_LOW, NO_HIGH = int(LONG.min), int(LONG.max)

#: Lowest and highest score, how many rows are wanted.
WindowOf = tuple[int, int, int]


# --- integers --------------------------------------------------------------------------


def quantised(values: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) of finite doubles: 64-bit integers, or Python's where those do not hold them."""
    with np.errstate(over="ignore"):
        scaled = np.floor(values.astype(np.float64) * scale)
    if not len(scaled) or np.abs(scaled).max() < 2**52:
        return scaled.astype(np.int64)
    return np.array([int(x) * scale if abs(x) >= 2**52 else int(np.floor(x * scale)) for x in values.astype(np.float64).tolist()], object)


def matrix(lists: pa.Array) -> np.ndarray:
    """Vectors as rows of integers; shorter ones end in zeros."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
    offsets = np.asarray(lists.offsets, np.int64)
    lengths = np.diff(offsets)
    flat = quantised(lists.flatten().to_numpy(zero_copy_only=False))
    n, width = len(lists), int(lengths.max()) if len(lengths) else 0
    if (lengths == width).all():
        return flat.reshape(n, width)
    out = np.zeros((n, width), flat.dtype)
    at = np.arange(len(flat)) - np.repeat(offsets[:-1] - offsets[0], lengths)
    out[np.repeat(np.arange(n), lengths), at] = flat
    return out


def _fitting(rows: np.ndarray, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both sides in a type in which sums of products are exact, with as many columns."""
    width = max(rows.shape[1], anchors.shape[1])
    rows, anchors = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (rows, anchors))
    most = lambda m: int(np.abs(m).max()) if m.size else 0
    bound = width * most(rows) * most(anchors)
    kind = np.float64 if bound < 2**53 else np.int64 if bound < 2**63 else object
    return rows.astype(kind), anchors.astype(kind)


def _long(scores: np.ndarray) -> np.ndarray:
    """Exact scores as 64-bit integers; beyond them, their limits."""
    if scores.dtype == object:
        return np.array([min(max(s, LONG.min), LONG.max) for s in scores], np.int64)
    return scores.astype(np.int64)


# --- the threshold algorithm -----------------------------------------------------------


class SortedLists:
    """Candidates with one list of them per dimension, sorted by component."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        lists = np.ascontiguousarray(vectors.T)
        self.order = np.argsort(lists, axis=1, kind="stable").astype(np.int32)
        self.values = np.take_along_axis(lists, self.order, 1)

    def search(self, anchor: np.ndarray, windows: list[WindowOf], skip_id: int, allowed: np.ndarray | None = None) -> list[list[tuple[int, int]]]:
        """For each window its best rows as (score, id): highest score first, then smallest id. Rows with ``skip_id`` and
        those not ``allowed`` are passed over."""
        n = len(self.ids)
        best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in windows]
        open_windows = {w for w, (low, high, k) in enumerate(windows) if low <= high and k > 0}
        dims = np.flatnonzero(anchor)
        dims = dims if len(dims) or not len(anchor) else np.array([0])  # a zero anchor reads any list: all scores are zero
        weights = anchor[dims] if len(dims) else None
        # Lists of positive components are read from their end.
        ends, starts = (dims[weights > 0], dims[~(weights > 0)]) if len(dims) else (dims, dims)
        seen = np.zeros(n, bool)
        depth, step, unseen, every = 0, FIRST_DEPTH, n, None
        # Lists that hold no unseen row any more need not be read on.
        while open_windows and unseen:
            reach = min(n, depth + step)
            met = np.zeros(n, bool)
            if weights is None:
                met[depth:reach] = True
            else:
                met[self.order[ends, n - reach : n - depth].ravel()] = True
                met[self.order[starts, depth:reach].ravel()] = True
            new = np.flatnonzero(met & ~seen)
            seen |= met
            unseen -= len(new)
            depth, step = reach, step * 2
            usable = new[(self.ids[new] != skip_id) & (allowed[new] if allowed is not None else True)]
            # Copies of many rows cost more than their block's product as a whole.
            if every is None and n - unseen > n // 8:
                every = self.vectors @ anchor
            scores = _long(self.vectors[usable] @ anchor if every is None else every[usable])
            ids = self.ids[usable]
            if depth < n and weights is not None:
                ahead = np.where(weights > 0, self.values[dims, n - 1 - depth], self.values[dims, depth])
                threshold = int((weights * ahead).sum())
            else:
                threshold = 0 if weights is None and depth < n else None
            for w in list(open_windows):
                low, high, k = windows[w]
                inside = (scores >= low) & (scores <= high)
                if len(best[w][0]) == k:
                    inside &= scores >= best[w][0][-1]
                if inside.any():
                    both = [np.concatenate(x) for x in zip(best[w], (scores[inside], ids[inside]))]
                    first = np.lexsort((both[1], -both[0] if both[0].min() > LONG.min else [-int(s) for s in both[0]]))[:k]
                    best[w] = both[0][first], both[1][first]
                if threshold is None:
                    continue
                kth = int(best[w][0][-1]) if len(best[w][0]) == k else None
                if threshold < low or (kth is not None and threshold < kth):
                    open_windows.discard(w)
        return [list(zip(s.tolist(), i.tolist())) for s, i in best]


def windows_of(scores: list[int], k: int, low: int, high: int) -> list[WindowOf]:
    """The scores s with low * positive <= 100 * s <= high * positive, for each positive's score."""
    return [(-(-low * s // 100), high * s // 100, k) for s in scores]


# --- blocks ----------------------------------------------------------------------------


def _blocks(rows: int, size: int) -> int:
    return max(1, -(-rows // size))


def _met(anchors: DataFrame, candidates: DataFrame, n_anchor: int, n_candidate: int, search, schema: str) -> DataFrame:
    """Every block of anchors with every block of candidates."""
    left = anchors.withColumn("_c", F.explode(F.sequence(F.lit(0), F.lit(n_candidate - 1)))).groupBy("_a", "_c")
    right = candidates.withColumn("_a", F.explode(F.sequence(F.lit(0), F.lit(n_anchor - 1)))).groupBy("_a", "_c")

    def run(key, these: pa.Table, those: pa.Table) -> pa.Table:
        target = _arrow(schema)
        rows = list(search(these, those)) if these.num_rows and those.num_rows else []
        columns = list(zip(*rows)) or [()] * len(target)
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, target)], schema=target)

    return left.cogroup(right).applyInArrow(run, schema)


def _arrow(schema: str) -> pa.Schema:
    types = {"long": pa.int64(), "int": pa.int32()}
    return pa.schema([(name, types[kind]) for name, kind in (f.split() for f in schema.split(", "))])


def _positives(these: pa.Table, those: pa.Table, k: int) -> Iterator[tuple]:
    ids, labels = those["id"].to_numpy(), those["label"].to_numpy()
    rows, anchors = _fitting(matrix(those["vector"]), matrix(these["vector"]))
    own = these["label"].to_numpy()
    for label in np.unique(own):
        same = np.flatnonzero(labels == label)
        if not len(same):
            continue
        lists = SortedLists(ids[same], rows[same])
        for i in np.flatnonzero(own == label):
            (found,) = lists.search(anchors[i], [(NO_LOW, NO_HIGH, k)], these["id"][int(i)].as_py())
            for score, other in found:
                yield these["row"][int(i)].as_py(), other, score


def _negatives(these: pa.Table, those: pa.Table, k: int, low: int, high: int) -> Iterator[tuple]:
    labels = those["label"].to_numpy()
    rows, anchors = _fitting(matrix(those["vector"]), matrix(these["vector"]))
    lists = SortedLists(those["id"].to_numpy(), rows)
    others: dict[int, np.ndarray] = {}
    for i, (row, own_id, label, scores) in enumerate(zip(*(these[c].to_pylist() for c in ("row", "id", "label", "scores")))):
        allowed = others.setdefault(label, labels != label)
        for place, found in enumerate(lists.search(anchors[i], windows_of(scores, k, low, high), own_id, allowed)):
            for score, other in found:
                yield row, place, other, score


def hard_negatives(
    df: DataFrame, is_anchor: Column, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding",
    positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH,
    block_rows: int = BLOCK_ROWS, anchor_rows: int = ANCHOR_ROWS,
) -> DataFrame:
    """Hard negatives of every anchor and positive: ``anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score``.

    Components count as floor(256 * x); a score is the integer inner product, exact, and held at the limits of a long
    beyond them. An anchor's positives are its ``positives`` best other rows of the same label; for each of them come the
    ``negatives`` best rows of other labels that score from ``low`` to ``high`` hundredths of the positive's score. Higher
    scores come first, equal ones by smaller id; all if there are fewer.

    Rows without id, label or vector, or with a component that is null or not finite, take no part. Rows that repeat an
    id are rows of their own, as anchors and as candidates, but none meets its own id. Shorter vectors end in zeros. An
    empty table gives no rows. Other columns are ignored. A task holds one block of anchors and one of candidates.
    """
    if negatives < 1 or positives < 1:
        raise ValueError("at least one positive and one negative must be asked for")
    finite = F.forall(F.col("vector"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    read = df.select(exact(id_col).cast("long").alias("id"), exact(label_col).cast("long").alias("label"), exact(vector_col).alias("vector"), is_anchor.alias("anchor"))
    usable = read.filter("id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL").filter(finite)
    rows = materialize(usable.withColumn("anchor", F.coalesce("anchor", F.lit(False))), "negative-rows")
    counts = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if("anchor").alias("anchors")).first()
    n_candidate, n_anchor = _blocks(counts["n"], block_rows), _blocks(counts["anchors"], anchor_rows)
    numbered = rows.withColumn("row", F.monotonically_increasing_id())
    block = lambda n: F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")
    candidates = numbered.select("id", "label", "vector", block(n_candidate).alias("_c"))
    anchors = materialize(numbered.filter("anchor").select("row", "id", "label", "vector", block(n_anchor).alias("_a")), "negative-anchors")

    def top(found: DataFrame, by: list[str], k: int, other: str) -> DataFrame:
        order = Window.partitionBy(*by).orderBy(F.desc("score"), other)
        return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    near = _met(anchors, candidates, n_anchor, n_candidate, lambda a, c: _positives(a, c, positives), "row long, positive_id long, score long")
    near = materialize(top(near, ["row"], positives, "positive_id"), "negative-positives")
    # At most ``positives`` entries for each anchor, in order of rank.
    chosen = near.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("rank", "score", "positive_id"))).alias("chosen"))
    asking = materialize(anchors.join(chosen, "row").withColumn("scores", F.col("chosen.score")), "negative-windows")
    found = _met(asking.drop("chosen"), candidates, n_anchor, n_candidate, lambda a, c: _negatives(a, c, negatives, low, high), "row long, place int, negative_id long, score long")
    ranked = top(found, ["row", "place"], negatives, "negative_id")
    told = asking.select("row", F.col("id").alias("anchor_id"), F.posexplode("chosen").alias("place", "positive"))
    return ranked.join(told, ["row", "place"]).select(
        "anchor_id", F.col("positive.positive_id").alias("positive_id"), F.col("rank").cast("int").alias("rank"), "negative_id",
        F.col("positive.score").alias("positive_score"), F.col("score").alias("negative_score"),
    )

"""Near-duplicate vectors by collision counting on one-dimensional projections.

Unit vectors at the similarity threshold are a known distance apart, so on a random direction their difference has a
known spread. Every direction sorts the vectors; a window around each query in that order collides with the vectors
near it. A pair is verified, in double precision, when it collides on enough of the directions; how many is enough
follows from the binomial distribution and the recall asked for.

Equal vectors are folded first. Of the rest, the first direction deals each label into cells as wide as four times the
spread, large cells are split into blocks, and blocks meet in the same and the next cell: a row holds two packed
blocks, and only counts and the links of a spanning forest leave it.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactlink.llm.tables import exact
from contactlink.operators.clusters import components
from contactlink.operators.storage import materialize

THRESHOLD, DIRECTIONS, RECALL = 0.98, 32, 0.999
BLOCK_ROWS = 1024
PAIRS_AT_ONCE = 100_000


def spread(threshold: float, dim: int) -> float:
    """Standard deviation of the projected difference of two unit vectors at the threshold."""
    return math.sqrt(2 - 2 * threshold) / math.sqrt(dim)


@functools.cache
def directions(dim: int, count: int) -> np.ndarray:
    """Random unit directions, the same everywhere."""
    a = np.random.default_rng(dim).normal(size=(dim, count + 1))
    return a / np.linalg.norm(a, axis=0)


def enough(count: int, recall: float, inside: float) -> int:
    """The largest number of collisions that a pair at the threshold reaches with probability ``recall``."""
    below = 0.0
    for n in range(count + 1):
        below += math.comb(count, n) * inside**n * (1 - inside) ** (count - n)
        if below > 1 - recall:
            return n
    return count


def usable(vector: Column) -> Column:
    """Whether a vector takes part: not null, all components finite, not all zero."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(fine & F.exists(vector, lambda x: x != 0), F.lit(False))


class Block:
    def __init__(self, ids: bytes, copies: bytes, vectors: bytes, dim: int):
        self.ids, self.copies = np.frombuffer(ids, np.int64), np.frombuffer(copies, np.int64)
        self.vectors = np.frombuffer(vectors, np.float64).reshape(-1, dim)
        self.norms = np.sqrt((self.vectors**2).sum(1))


def collisions(left: np.ndarray, right: np.ndarray, half: np.ndarray | float) -> np.ndarray:
    """On how many directions each right vector is in the window around each left one."""
    out = np.zeros((len(left), len(right)), np.uint8)
    for j in range(left.shape[1]):
        order = np.argsort(right[:, j])
        place = np.empty(len(right), np.uint16)
        place[order] = np.arange(len(right), dtype=np.uint16)
        line = right[order, j]
        low = np.searchsorted(line, left[:, j] - half, "left").astype(np.uint16)
        width = np.searchsorted(line, left[:, j] + half, "right").astype(np.uint16) - low
        out += (place[None, :] - low[:, None]) < width[:, None]  # unsigned: places before the window wrap around
    return out


def linked_pairs(left: Block, right: Block, same: bool, threshold: float, count: int, recall: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs whose cosine reaches the threshold; each pair once."""
    dim = left.vectors.shape[1]
    lines = directions(dim, count)[:, 1:]
    half = 2 * spread(threshold, dim) + 1e-12
    project = lambda b: (b.vectors / b.norms[:, None]) @ lines
    hits = collisions(project(left), project(right), half) >= enough(count, recall, math.erf(2 / math.sqrt(2)))
    if same:
        hits = np.triu(hits, 1)
    i, k = np.nonzero(hits)
    keep = np.empty(len(i), bool)
    for at in range(0, len(i), PAIRS_AT_ONCE):
        a, b = i[at : at + PAIRS_AT_ONCE], k[at : at + PAIRS_AT_ONCE]
        cosine = np.einsum("ij,ij->i", left.vectors[a], right.vectors[b]) / (left.norms[a] * right.norms[b])
        keep[at : at + len(a)] = cosine >= threshold
    return i[keep], k[keep]


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the links and the smallest node each reaches, without those that are it themselves."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    moved = root != np.arange(len(nodes))
    return nodes[moved], nodes[root[moved]]


def _blocks(vectors: DataFrame, threshold: float, count: int) -> DataFrame:
    """Packed blocks by label, dimension, cell and number in the cell."""
    cells = "id long, label string, copies long, dim int, cell long, vector binary"

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(3)
            dims = np.diff(column.offsets.to_numpy())
            flat = column.flatten().to_numpy()
            begins = np.concatenate([[0], np.cumsum(dims)])
            cell = np.zeros(len(dims), np.int64)
            for dim in np.unique(dims):
                mine = np.flatnonzero(dims == dim)
                v = flat[begins[mine][:, None] + np.arange(dim)]
                line = v @ directions(int(dim), count)[:, 0] / np.sqrt((v**2).sum(1))
                cell[mine] = np.floor(line / (4 * spread(threshold, int(dim)) + 1e-9))
            packed = [flat[a:b].tobytes() for a, b in zip(begins, begins[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(dims, pa.int32()), pa.array(cell), pa.array(packed, pa.binary())],
                names=["id", "label", "copies", "dim", "cell", "vector"],
            )

    placed = materialize(vectors.select("id", "label", "copies", "vector").mapInArrow(place, cells), "vectors-placed")
    keys = ["label", "dim", "cell"]
    parts = placed.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).alias("parts"))
    split = placed.join(materialize(parts, "vectors-cells"), keys).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")))

    def pack(key, rows):
        rows = rows.sort_by("id")
        return pa.Table.from_arrays(
            [*(pa.array([k.as_py()], t) for k, t in zip(key, (pa.string(), pa.int32(), pa.int64(), pa.int64()))),
             *(pa.array([rows[c].to_numpy().tobytes()], pa.binary()) for c in ("id", "copies")), pa.array([b"".join(rows["vector"].to_pylist())], pa.binary())],
            names=["label", "dim", "cell", "part", "ids", "copies", "vectors"],
        )

    return materialize(
        split.groupBy(*keys, "part").applyInArrow(pack, "label string, dim int, cell long, part long, ids binary, copies binary, vectors binary"), "vectors-blocks"
    )


def embedding_dedup(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD,
                    count: int = DIRECTIONS, recall: float = RECALL) -> DataFrame:
    """A row per vector: id, ``n_links`` (other vectors of its label at cosine ``threshold`` or more), ``component_id``
    (smallest id reached by links) and ``kept`` (whether it is that one).

    A vector that is null, zero, or has null or non-finite components, a row without label or id, and vectors of
    different length link with nothing. Rows that repeat an id are vectors of their own with one component. Other
    columns are ignored. A pair that reaches the threshold is found with probability ``recall`` at least, equal vectors
    always; no pair below it is linked.
    """
    rows = df.select(exact(id_col).cast("long").alias("id"), exact(label_col).cast("string").alias("label"), exact(vector_col).cast("array<double>").alias("vector"))
    good = rows.filter(usable(F.col("vector")) & F.col("label").isNotNull() & F.col("id").isNotNull())
    classes = materialize(good.groupBy("label", "vector").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies")), "vectors")
    blocks = _blocks(classes, threshold, count)
    right = blocks.select("label", "dim", F.col("cell").alias("other"), F.col("part").alias("part2"), F.col("ids").alias("ids2"), F.col("copies").alias("copies2"), F.col("vectors").alias("vectors2"))
    met = blocks.withColumn("other", F.explode(F.array("cell", F.col("cell") + 1))).join(right, ["label", "dim", "other"])
    met = met.filter((F.col("other") > F.col("cell")) | (F.col("part2") >= F.col("part")))
    met = met.select("dim", ((F.col("other") == F.col("cell")) & (F.col("part") == F.col("part2"))).alias("same"), "ids", "copies", "vectors", "ids2", "copies2", "vectors2")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                dim, same, *packed = (c[row].as_py() for c in batch.columns)
                a, b = Block(*packed[:3], dim), Block(*packed[3:], dim)
                i, k = linked_pairs(a, b, same, threshold, count, recall)
                ids = np.concatenate([a.ids, b.ids])
                links = np.concatenate([np.bincount(i, b.copies[k], len(a.ids)), np.bincount(k, a.copies[i], len(b.ids))]).astype(np.int64)
                some = links > 0
                node, root = forest(a.ids[i], b.ids[k])
                none = np.zeros(len(node), np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([ids[some], node])), pa.array(np.concatenate([links[some], none])),
                     pa.array(np.concatenate([np.full(some.sum(), -1), root]), mask=np.concatenate([np.ones(some.sum(), bool), none > 0]))],
                    names=["id", "links", "root"],
                )

    found = materialize(met.repartition(F.xxhash64("ids", "ids2")).mapInArrow(compare, "id long, links long, root long"), "vectors-links")
    roots = components(found.filter("root IS NOT NULL").select(F.col("id").alias("src"), F.col("root").alias("dst")))
    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    named = classes.join(counts, "id", "left").join(roots.withColumnRenamed("node", "id"), "id", "left")
    named = materialize(
        named.select("label", "vector", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "id").alias("component")), "vectors-named"
    )
    out = rows.join(named, ["label", "vector"], "left")
    component = F.coalesce(F.when(F.col("id").isNotNull(), F.col("component")), F.col("id"))
    return out.select(
        F.col("id").alias(id_col),
        F.when(F.col("id").isNotNull(), F.coalesce("n_links", F.lit(0))).otherwise(0).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"),
    )

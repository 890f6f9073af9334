"""N-gram Jaccard join with rare-first prefixes.

A document is the set of its distinct word n-grams, ordered rarest first. Two sets that are similar enough share an
n-gram in their prefixes, so only prefix n-grams are joined, and of these only those that more than one document has.
Length, positional and suffix filters reject pairs before their sets meet, and each pair is verified once.

Equal sets are folded first. Of the others a group may still hold thousands of near copies, so pairs are never all
emitted: in each round every member of a prefix group meets a few pivots of the group, the first by size, links merge
components, and pairs inside one component are not looked at again. The first round takes the one pivot a member meets
most often, the next the eight first pivots of each group, and each after that nine times as many; pivots that have met
all members leave their group, and rounds end when no group spans two components. What is left out is only what the
components say already.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from contactlink.llm import exchange
from contactlink.llm.hashing import Words, mixed, window_hashes
from contactlink.llm.tables import arrow_table, bytes_of, exact
from contactlink.operators.clusters import components
from contactlink.operators.storage import materialize

NGRAM = 5
THRESHOLD = 75
GROWTH = 8
BINS = 16

ASKED = "bucket int, chunk int, entries binary"
FREQUENCIES = "chunk int, bucket int, answer binary"
SETS = "id long, n_shingles long, digest binary, copy_of long, prefix array<struct<gram:long,pos:int>>, bins array<int>, grams binary"

_ASKED = pa.schema([("bucket", pa.int32()), ("chunk", pa.int32()), ("entries", pa.binary())])
_FREQUENCIES = pa.schema([("chunk", pa.int32()), ("bucket", pa.int32()), ("answer", pa.binary())])
_SETS = pa.schema([
    ("id", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("copy_of", pa.int64()),
    ("prefix", pa.list_(pa.struct([("gram", pa.int64()), ("pos", pa.int32())]))), ("bins", pa.list_(pa.int32())), ("grams", pa.binary()),
])


class Sets:
    """The n-gram sets of a chunk's documents, one after the other, and the chunk's distinct n-grams."""

    def __init__(self, docs: pa.Table, ngram: int):
        docs = docs.take(pc.sort_indices(docs, sort_keys=[("id", "ascending"), ("text", "ascending")]))
        self.ids = docs["id"]
        words = Words(*bytes_of(docs["text"]))
        hashes = words.hashes(3, fold_case=True)
        grams, at = window_hashes(words, hashes, ngram, 3)
        owner = words.owners()[at]
        short = np.flatnonzero((words.counts > 0) & (words.counts < ngram))
        whole = np.zeros(len(short), np.uint64)  # fewer words than an n-gram: the whole sequence is the one member
        for k in range(ngram - 1):
            there = words.counts[short] > k
            at_k = np.minimum(words.first[short] + k, max(0, len(hashes) - 1))
            whole = np.where(there, mixed(whole * np.uint64(31) + hashes[at_k] + np.uint64(k + 1)), whole)
        owner, grams = np.concatenate([owner, short]), np.concatenate([grams, whole])
        order = np.lexsort((grams, owner))
        owner, grams = owner[order], grams[order]
        new = np.ones(len(grams), bool)
        new[1:] = (owner[1:] != owner[:-1]) | (grams[1:] != grams[:-1])
        self.owner, self.grams = owner[new], grams[new]
        self.sizes = np.bincount(self.owner, minlength=len(words.counts))
        self.begins = np.concatenate([[0], np.cumsum(self.sizes)])
        self.distinct, self.number = np.unique(self.grams, return_inverse=True)


def _asked_rows(chunk: int, docs: pa.Table, ngram: int, buckets: int) -> pa.Table:
    sets = Sets(docs, ngram)
    entries = exchange.sent(sets.distinct, np.minimum(np.bincount(sets.number, minlength=len(sets.distinct)), 3))
    bounds = exchange.bucket_bounds(sets.distinct, buckets)
    return arrow_table([(b, chunk, entries[x:y].tobytes()) for b, x, y in exchange.slices(bounds)], _ASKED)


def _frequency_rows(bucket: int, rows: pa.Table) -> pa.Table:
    """In how many documents each n-gram is, up to 255 (a chunk counts three at most): only the order matters."""
    entries, counts = exchange.joined_arrays(rows["entries"], np.uint32)
    order, begins, group = exchange.grouped(entries >> np.uint32(exchange.NOTE_BITS))
    total = np.add.reduceat((entries[order] & 3).astype(np.int64), begins)
    answer = np.empty(len(entries), np.uint8)
    answer[order] = np.minimum(total, 255)[group]
    parts = np.split(answer, np.cumsum(counts)[:-1])
    return arrow_table([(c, bucket, a.tobytes()) for c, a in zip(rows["chunk"].to_pylist(), parts) if (a > 1).any()], _FREQUENCIES)


def _set_rows(docs: pa.Table, answers: pa.Table, ngram: int, threshold: int, buckets: int) -> pa.Table:
    sets = Sets(docs, ngram)
    n = len(sets.ids)
    often = np.ones(len(sets.distinct), np.uint8)
    bounds = exchange.bucket_bounds(sets.distinct, buckets)
    for bucket, answer in zip(answers["bucket"].to_pylist(), answers["answer"].to_pylist()):
        often[bounds[bucket] : bounds[bucket + 1]] = np.frombuffer(answer, np.uint8)
    frequency = often[sets.number]
    # The n-grams are in the order of their hashes, so a stable sort makes the order (frequency, hash).
    order = np.lexsort((frequency, sets.owner))
    place = np.arange(len(order)) - sets.begins[sets.owner]  # the sort keeps each document's stretch
    size = sets.sizes[sets.owner]
    prefix = size - -(-size * threshold // 100) + 1
    chosen = np.flatnonzero((place < prefix) & (frequency[order] > 1))
    prefix_owner, prefix_gram, prefix_place = sets.owner[chosen], sets.grams[order][chosen].view(np.int64), place[chosen]
    cuts = np.searchsorted(prefix_owner, np.arange(n + 1))
    # Two sums over all members stand for the set; order does not matter to them.
    sums = []
    for seed in (1, 2):
        total = np.concatenate([[0], np.cumsum(mixed(sets.grams + np.uint64(seed)))]).astype(np.uint64)
        sums.append(total[sets.begins[1:]] - total[sets.begins[:-1]])
    digests = np.stack([*sums, sets.sizes.astype(np.uint64)], 1)
    bins = np.zeros((n, BINS), np.int32)
    np.add.at(bins, (sets.owner, (sets.grams >> np.uint64(60)).astype(np.int64)), 1)
    seen: dict[bytes, int] = {}
    rows, listed = [], np.zeros(n, bool)
    for i, doc in enumerate(sets.ids.to_pylist()):
        size = int(sets.sizes[i])
        if not size:
            rows.append((doc, 0, None, None, None, None))
            continue
        digest = digests[i].tobytes()
        known = digest in seen and doc is not None
        copy_of = seen.setdefault(digest, doc) if doc is not None else None
        a, b = cuts[i], cuts[i + 1]
        if known or a == b or doc is None:
            rows.append((doc, size, digest, copy_of, None, None))
        else:
            listed[i] = True
            rows.append((doc, size, digest, copy_of, bins[i].tolist(), sets.grams[sets.begins[i] : sets.begins[i + 1]].tobytes()))
    # Prefixes go from array to array: as Python objects they would take many times the memory of the chunk's texts.
    kept = listed[prefix_owner]
    ends = np.cumsum(np.bincount(prefix_owner[kept], minlength=n))
    values = pa.StructArray.from_arrays([pa.array(prefix_gram[kept], pa.int64()), pa.array(prefix_place[kept], pa.int32())], names=["gram", "pos"])
    at = _SETS.get_field_index("prefix")
    prefixes = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), values, type=_SETS.field(at).type, mask=pa.array(~listed))
    return arrow_table(rows, _SETS.remove(at)).add_column(at, _SETS.field(at), prefixes)


def ngram_sets(df: DataFrame, id_col: str, text_col: str, ngram: int, threshold: int) -> DataFrame:
    """A row per document: size and digest of its set, the first document of the chunk with the same set, and for those
    first ones that share a prefix n-gram with others: prefix, counts by hash range, and the sorted members."""
    chunks, buckets = exchange.chunks_and_buckets(df, text_col)
    docs = df.select(
        exchange.chunk_of(id_col, text_col, chunks).alias("chunk"), exact(id_col).cast("long").alias("id"), exact(text_col).cast("string").alias("text")
    )

    def ask(key, rows):
        return _asked_rows(key[0].as_py(), rows, ngram, buckets)

    def count(key, rows):
        return _frequency_rows(key[0].as_py(), rows)

    def build(key, rows, answers):
        return _set_rows(rows, answers, ngram, threshold, buckets) if rows.num_rows else _SETS.empty_table()

    by_chunk = docs.groupBy("chunk")
    frequencies = by_chunk.applyInArrow(ask, ASKED).groupBy("bucket").applyInArrow(count, FREQUENCIES)
    return by_chunk.cogroup(frequencies.groupBy("chunk")).applyInArrow(build, SETS)


@F.pandas_udf(T.LongType())
def common_members(a, b):
    """Size of the intersection of two packed sets."""
    read = lambda v: np.frombuffer(v, np.uint64)
    return a.combine(b, lambda x, y: len(np.intersect1d(read(x), read(y), assume_unique=True)))


def needed(n_a, n_b, threshold: int):
    """Members two sets must share: the smallest count with 100 * count >= threshold * union."""
    return F.ceil((n_a + n_b) * threshold / (100 + threshold) - 1e-9)


def verified(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """The pairs ``a, b`` that are similar: suffix filter on counts by hash range, then the members themselves."""
    side = lambda s: sets.select(F.col("id").alias(s), *(F.col(c).alias(f"{s}_{c}") for c in ("n_shingles", "bins", "grams")))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    possible = F.aggregate(F.zip_with("a_bins", "b_bins", lambda x, y: F.least(x, y)), F.lit(0), lambda s, x: s + x)
    both = both.filter(possible >= needed(F.col("a_n_shingles"), F.col("b_n_shingles"), threshold))
    both = both.withColumn("total", F.col("a_n_shingles") + F.col("b_n_shingles"))
    common = both.select("a", "b", "total", common_members("a_grams", "b_grams").alias("common"))
    return common.filter(100 * F.col("common") >= threshold * (F.col("total") - F.col("common"))).select("a", "b")


def _met(members: DataFrame, pivots: DataFrame, threshold: int) -> DataFrame:
    """Members with pivots of their group that pass the length and positional filters: ``a`` (pivot, not larger), ``b``."""
    side = lambda df, s: df.select("gram", *(F.col(c).alias(f"{s}{n}") for c, n in (("id", ""), ("n", "_n"), ("pos", "_pos"), ("root", "_root"))))
    left = F.least(F.col("a_n") - F.col("a_pos"), F.col("b_n") - F.col("b_pos"))
    return side(members, "b").join(side(pivots, "a"), "gram").filter(
        (F.struct("b_n", "b") > F.struct("a_n", "a")) & (F.col("a_root") != F.col("b_root"))
        & (100 * F.col("a_n") >= threshold * F.col("b_n")) & (left >= needed(F.col("a_n"), F.col("b_n"), threshold))
    )


def linked(sets: DataFrame, threshold: int) -> DataFrame:
    """``id, root`` for sets linked to others; the root is the smallest id reached.

    A group of any size stays spread: its pivots are the first few of each task's first few, and it meets them, written,
    in a join that adaptive execution can split.
    """
    groups = sets.select("id", F.col("n_shingles").alias("n"), F.explode("prefix").alias("e")).select("e.gram", "id", "n", "e.pos")
    active = materialize(groups.withColumn("root", F.col("id")), "jaccard-groups")
    place = F.row_number().over(Window.partitionBy("gram").orderBy("n", "id"))
    roots: DataFrame | None = None
    met_before: DataFrame | None = None
    first, width = True, 1
    while True:
        pivots = materialize(active.withColumn("place", place).filter(F.col("place") <= width).drop("place"), "jaccard-pivots")
        met = _met(active, pivots, threshold)
        if first:
            # One pivot each, the one met most often: most near copies are merged before any other pair is formed.
            counted = met.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
            pairs = counted.groupBy("b").agg(F.max_by("a", F.struct("n", -F.col("a"))).alias("a")).select("a", "b")
        else:
            # A pair is verified once, whatever n-grams it meets under later.
            pairs = met.select("a", "b").distinct().join(met_before, ["a", "b"], "left_anti")
        pairs = materialize(pairs, "jaccard-pairs")
        met_before = pairs if first else met_before.unionByName(pairs)
        links = materialize(verified(pairs, sets, threshold), "jaccard-links")
        edges = links.select(F.col("a").alias("src"), F.col("b").alias("dst"))
        if roots is not None:
            edges = edges.unionByName(roots.filter("id <> root").select(F.col("id").alias("src"), F.col("root").alias("dst")))
        roots = materialize(components(edges, split_hubs=True).select(F.col("node").alias("id"), "root"), "jaccard-roots")
        left = active.drop("root")
        if not first:
            last = materialize(pivots.groupBy("gram").agg(F.max(F.struct("n", "id")).alias("last")), "jaccard-last")
            left = left.join(last, "gram").filter(F.struct("n", "id") > F.col("last")).drop("last")
        renewed = materialize(left.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id")), "jaccard-left")
        spanning = renewed.groupBy("gram").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).filter("r0 <> r1")
        active = materialize(renewed.join(materialize(spanning.select("gram"), "jaccard-open"), "gram", "left_semi"), "jaccard-groups")
        if active.isEmpty():
            return roots
        width, first = (GROWTH if first else width * (GROWTH + 1)), False


def jaccard_join(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", ngram: int = NGRAM, threshold: int = THRESHOLD) -> DataFrame:
    """Components of documents linked by Jaccard similarity of at least ``threshold`` percent: a row per document with
    id, ``n_shingles``, ``representative`` (smallest id with the same set) and ``component_id`` (smallest id reached).

    Words are runs without white space, A-Z folded. A document with fewer than ``ngram`` words is one n-gram; one
    without words, or null, has none and links with nothing. Ids are integers; rows that repeat an id
    are documents of their own, and one id with several texts may be in several components. A row without an id is given its own row with a
    null component. Other columns are ignored.
    """
    if not 50 < threshold <= 100:
        raise ValueError("threshold must be over 50 percent")
    sets = materialize(ngram_sets(df, id_col, text_col, ngram, threshold), "jaccard-sets")
    firsts = sets.filter("copy_of = id").select("id", "digest").distinct()
    # A class is a set; its number stands for it, so that ids with several texts keep their sets apart.
    classes = firsts.groupBy("digest").agg(F.min("id").alias("representative")).withColumn("class", F.monotonically_increasing_id())
    classes = materialize(classes, "jaccard-classes")
    heads = sets.filter("grams IS NOT NULL").join(classes.withColumnRenamed("representative", "id"), ["digest", "id"]).dropDuplicates(["class"])
    heads = materialize(heads.select(F.col("class").alias("id"), "n_shingles", "prefix", "bins", "grams"), "jaccard-heads")
    roots = linked(heads, threshold)
    rooted = materialize(classes.join(roots.withColumnRenamed("id", "class"), "class", "left").withColumn("root", F.coalesce("root", "class")), "jaccard-rooted")
    smallest = materialize(rooted.groupBy("root").agg(F.min("representative").alias("component_id")), "jaccard-components")
    labels = rooted.join(smallest, "root").select("digest", "representative", "component_id")
    labels = materialize(firsts.withColumnRenamed("id", "copy_of").join(labels, "digest"), "jaccard-labels")
    out = sets.select("id", "n_shingles", "copy_of", "digest").join(labels, ["copy_of", "digest"], "left")
    return out.select(
        F.col("id").alias(id_col), "n_shingles",
        F.coalesce("representative", "id").alias("representative"), F.coalesce("component_id", "id").alias("component_id"),
    )

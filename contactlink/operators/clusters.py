"""Clusters: connected components of records linked by any active rule.

Blocks that fit a task are joined there at once. For larger ones each round gives every record at most two edges to other
components of its block, then merges. A component with any partner left finds one, so components at least halve per
round and edges stay linear in the number of records. Components of an edge list are
found by alternating large-star and small-star steps (Kiveris et al., 2014), unless it consists of stars already.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactlink.functions.keys import minted_key
from contactlink.operators.linking import with_stored_key
from contactlink.operators.matching import linking_edges
from contactlink.operators.rules import RuleSet
from contactlink.operators.storage import materialize
from contactlink.sources.keystore import KeyState


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(
        F.explode(F.array(F.struct(F.col("u"), F.col("v")), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")
    ).select("e.*")


def _large_star(edges: DataFrame, split_hubs: bool) -> DataFrame:
    """Link every larger neighbour of a node to the smallest of node and neighbours."""
    both = _both_ways(edges)
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    low = materialize(low, "minima") if split_hubs else low
    return both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame, split_hubs: bool) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v")
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    low = materialize(low, "minima") if split_hubs else low
    joined = down.join(low, "u")
    return (
        joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        .unionByName(low.select("u", F.col("m").alias("v")))
        .distinct()
    )


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def _are_stars(edges: DataFrame) -> bool:
    """Whether every larger end has one edge and none is a smaller end as well: roots are found then."""
    ends = edges.select(F.explode(F.array(
        F.struct(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")),
        F.struct(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")),
    )).alias("e")).select("e.*")
    nodes = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return nodes.filter((F.col("up") > 1) | ((F.col("up") == 1) & (F.col("down") == 1))).isEmpty()


def components(edges: DataFrame, split_hubs: bool = False, stars: bool = False) -> DataFrame:
    """``node, root`` for every node with an edge; the root is the smallest node reached.

    With ``split_hubs`` the smallest neighbours are written before edges are joined with them, so that adaptive execution
    can split the edges of a hub; it costs three small writes more in each step. ``stars`` says that the edges may be
    stars already, which is looked at first.
    """
    edges = materialize(
        edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).filter("u > v").distinct(),
        "edges",
    )
    before = None if stars and _are_stars(edges) else _signature(edges)
    while before and before[0]:
        large = _large_star(edges, split_hubs)
        large = materialize(large, "large-stars") if split_hubs else large
        edges = materialize(_small_star(large, split_hubs), "stars")
        after = _signature(edges)
        if after == before:
            break
        before = after
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def cluster_labels(records: DataFrame | list[DataFrame], rules: RuleSet, **search: int) -> DataFrame:
    """``ord, cluster`` for records linked to at least one other; the cluster is the
    smallest ``ord`` in it. Several tables are the same records under several block keys."""
    tables = records if isinstance(records, list) else [records]
    labels: DataFrame | None = None
    while True:
        edges, complete = None, True
        for table in tables:
            if labels is None:
                labelled = table.withColumn("label", F.col("ord"))
            else:
                labelled = table.join(labels, "ord", "left").withColumn("label", F.coalesce("cluster", "ord")).drop("cluster")
            found, whole = linking_edges(labelled, rules, **search)
            complete &= whole
            edges = found if edges is None else edges.unionByName(found)
        edges = materialize(edges, "links")
        if edges.isEmpty():
            break
        if labels is not None:
            # Earlier clusters take part as edges of their members.
            edges = edges.unionByName(labels.filter("ord <> cluster").select(F.col("ord").alias("src"), F.col("cluster").alias("dst")))
        roots = components(edges, split_hubs=True, stars=complete)
        labels = materialize(roots.select(F.col("node").alias("ord"), F.col("root").alias("cluster")), "labels")
        if complete:
            break
    if labels is None:
        return tables[0].select("ord", F.col("ord").alias("cluster")).limit(0)
    return labels


def cluster_keys(records: DataFrame, labels: DataFrame, state: KeyState, stored: bool = False) -> DataFrame:
    """``ord, cluster, cluster_size, dedup_key`` for all ``ord, data_hash``; with ``stored`` also ``stored_key``, the one of its hash.

    The key of a cluster is the stored key of its first member that has one, else the key
    minted from the smallest data hash in it. See ``merged_keys`` for clusters with several.
    """
    members = with_stored_key(
        records.join(labels, "ord", "left").withColumn("cluster", F.coalesce("cluster", "ord")), state
    )
    members = materialize(members, "members")
    keys = members.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("cluster_size"),
        F.min_by("stored_key", F.when(F.col("stored_key").isNotNull(), F.col("ord"))).alias("_stored"),
        F.min("data_hash").alias("_hash"),
    )
    keys = materialize(keys.select("cluster", "cluster_size", F.coalesce("_stored", minted_key(F.col("_hash"))).alias("dedup_key")), "cluster-keys")
    more = ["stored_key"] if stored else []
    return members.select("ord", "cluster", *more).join(keys, "cluster").select("ord", "cluster", "cluster_size", "dedup_key", *more)


def merged_keys(records: DataFrame, labels: DataFrame, state: KeyState) -> DataFrame:
    """``alias, dedup_key`` for stored keys that clusters of this run bring together, directly or by way of each other:
    all become the smallest of them. ``records`` are ``ord, data_hash``."""
    members = with_stored_key(records.join(labels, "ord"), state).filter("stored_key IS NOT NULL").select("cluster", "stored_key").distinct()
    first = members.groupBy("cluster").agg(F.min("stored_key").alias("low"), F.max("stored_key").alias("high")).filter("low < high")
    first = materialize(first.select("cluster", "low"), "merged-first")
    pairs = members.join(first, "cluster").filter("stored_key <> low").select(F.col("stored_key").alias("src"), F.col("low").alias("dst"))
    return components(pairs, split_hubs=True, stars=True).filter("node <> root").select(F.col("node").alias("alias"), F.col("root").alias("dedup_key"))


"""Dedup keys of a run.

A record's key is, in this order: the key its matched partner brought along in the input;
the last such key given to an earlier record with the same data hash; the key the store
has for the hash; the key minted for the hash. All of it follows from one summary row
per hash, so no task ever holds all rows of a popular hash or key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from contactlink.functions.keys import minted_key
from contactlink.operators.skew import SLICE_BITS, with_last_before
from contactlink.operators.storage import materialize
from contactlink.sources.keystore import KeyState, MergedState


def with_stored_key(hashes: DataFrame, state: KeyState) -> DataFrame:
    """Add ``stored_key``: the key the store has for ``data_hash``, or null."""
    stored = state.hash_key.select("data_hash", F.col("dedup_key").alias("stored_key"))
    return hashes.join(stored, "data_hash", "left")


def unseen_hashes(hashes: DataFrame, state: KeyState) -> DataFrame:
    return hashes.join(state.hash_key, "data_hash", "left_anti")


def seen_hashes(hashes: DataFrame, state: KeyState) -> DataFrame:
    return hashes.join(state.hash_key, "data_hash", "left_semi")


def resolve_keys(records: DataFrame, state: KeyState, slice_bits: int = SLICE_BITS) -> DataFrame:
    """Add ``dedup_key`` and ``is_new`` to ``ord, data_hash, [explicit_key], ...``.

    ``explicit_key`` is the key of the matched partner if the input had one.
    """
    given = "explicit_key" in records.columns
    order, key = F.col("ord"), F.col("explicit_key") if given else F.lit(None).cast("string")
    hashes = records.groupBy("data_hash").agg(
        F.min(F.when(key.isNull(), order)).alias("_first_plain"),
        F.min(F.when(key.isNotNull(), order)).alias("_first_given"),
        F.min(key).alias("_low_given"),
        F.max(key).alias("_high_given"),
    )
    hashes = with_stored_key(hashes, state)
    mints = (
        F.col("stored_key").isNull()
        & F.col("_first_plain").isNotNull()
        & (F.col("_first_given").isNull() | (F.col("_first_plain") < F.col("_first_given")))
    )
    # Written, so that the join with the records is a broadcast by measured size or one that
    # adaptive execution can split where many records share a hash.
    hashes = materialize(hashes.withColumn("_mints", mints), "hashes")
    rows = records.join(hashes, "data_hash")
    base = F.coalesce(F.col("stored_key"), minted_key(F.col("data_hash")))
    if not given:
        resolved = rows.withColumn("dedup_key", base)
    else:
        # One given key per hash needs no look-back; several need the last one before.
        several = F.col("_low_given") != F.col("_high_given")
        plain = rows.filter(~F.coalesce(several, F.lit(False))).withColumn(
            "_earlier", F.when(F.col("_first_given") < order, F.col("_low_given"))
        )
        mixed = with_last_before(rows.filter(several), ["data_hash"], "ord", "explicit_key", "_earlier", slice_bits)
        resolved = plain.unionByName(mixed).withColumn("dedup_key", F.coalesce("explicit_key", "_earlier", base))
    is_new = F.col("_mints") & (order == F.col("_first_plain"))
    return resolved.withColumn("is_new", F.coalesce(is_new, F.lit(False))).drop(
        "_first_plain", "_first_given", "_low_given", "_high_given", "stored_key", "_mints", "_earlier"
    )


def _links(resolved: DataFrame, item: str) -> DataFrame:
    """First link of every item to its key: rows that matched or minted their key link."""
    return (
        resolved.filter(F.col("is_match") | F.col("is_new"))
        .groupBy("dedup_key", item)
        .agg(F.min("ord").alias("ord"))
    )


def with_matched_ids(resolved: DataFrame, state: KeyState) -> DataFrame:
    """Add ``matched_ids``: identifiers linked to the key up to this record, '' if unmatched.

    Only distinct identifiers are collected, per key and with their first place; each
    record then keeps those not after itself.
    """
    now = _links(resolved, "identifier").select("dedup_key", "identifier", F.struct(F.lit(1).alias("now"), F.col("ord").cast("long").alias("a"), F.lit(0).cast("long").alias("b")).alias("at"))
    wanted = resolved.filter("is_match").select("dedup_key").distinct()
    before = state.key_identifier.join(wanted, "dedup_key", "left_semi").select(
        "dedup_key", "identifier", F.struct(F.lit(0).alias("now"), F.col("run_no").alias("a"), F.col("ord").alias("b")).alias("at")
    )
    first = before.unionByName(now).groupBy("dedup_key", "identifier").agg(F.min("at").alias("at"))
    lists = materialize(first.groupBy("dedup_key").agg(F.sort_array(F.collect_list(F.struct("at", "identifier"))).alias("_ids")), "key-identifiers")
    upto = F.filter(
        "_ids", lambda e: (e["at"]["now"] == 0) | (e["at"]["a"] <= F.col("ord"))
    ).getField("identifier")
    return (
        resolved.join(lists, "dedup_key", "left")
        .withColumn("matched_ids", F.when(F.col("is_match"), F.array_join(upto, "|")).otherwise(""))
        .drop("_ids")
    )


#: Identifiers in a chunk of a key's list, and record numbers in a slice of its windows, as a power of two.
CHUNK_IDS, ID_SLICE_BITS = 1024, 12


def with_id_ranks(resolved: DataFrame, state: KeyState, slice_bits: int = ID_SLICE_BITS) -> tuple[DataFrame, DataFrame]:
    """Identifier lists without lists: the records with ``n_ids``, and the entries ``dedup_key, rank, identifier``.

    A key's entries are ranked in the order they were linked, those of the store first. The list of a matched record is
    the first ``n_ids`` entries of its key; an unmatched one has 0. A record is a pointer, so what a key holds is written
    once, however many records share it. Ranks come from slices of the record order, so no task holds a key's rows.
    """
    wanted = resolved.filter("is_match").select("dedup_key").distinct()
    before = state.key_identifier.join(wanted, "dedup_key", "left_semi").groupBy("dedup_key", "identifier").agg(
        F.min(F.struct(F.col("run_no").alias("a"), F.col("ord").alias("b"))).alias("at")
    )
    now = _links(resolved, "identifier").join(before, ["dedup_key", "identifier"], "left_anti")
    place = lambda old, a, b: [F.lit(old).alias("old"), a.cast("long").alias("a"), b.cast("long").alias("b")]
    events = before.select("dedup_key", "identifier", *place(0, F.col("at.a"), F.col("at.b")), F.lit(1).alias("adds"), F.lit(None).cast("long").alias("ord"))
    events = events.unionByName(now.select("dedup_key", "identifier", *place(1, F.col("ord"), F.lit(0)), F.lit(1).alias("adds"), F.lit(None).cast("long").alias("ord")))
    # A record comes after the entry that it adds itself.
    asks = resolved.filter("is_match").select("dedup_key", F.lit(None).cast("string").alias("identifier"), *place(1, F.col("ord"), F.lit(1)), F.lit(0).alias("adds"), "ord")
    piece = F.struct("old", F.when(F.col("old") == 0, F.col("a")).otherwise(F.shiftright("a", slice_bits)).alias("a"), F.when(F.col("old") == 0, F.shiftright("b", slice_bits)).otherwise(0).alias("b"))
    events = materialize(events.unionByName(asks).withColumn("piece", piece), "id-events")
    ahead = F.sum("n").over(Window.partitionBy("dedup_key").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1))
    pieces = events.groupBy("dedup_key", "piece").agg(F.sum("adds").alias("n"))
    pieces = materialize(pieces.select("dedup_key", "piece", F.coalesce(ahead, F.lit(0)).alias("ahead")), "id-pieces")
    upto = F.sum("adds").over(Window.partitionBy("dedup_key", "piece").orderBy("old", "a", "b", "identifier").rowsBetween(Window.unboundedPreceding, 0))
    counted = materialize(events.withColumn("upto", upto).join(pieces, ["dedup_key", "piece"]).withColumn("n_ids", F.col("ahead") + F.col("upto")), "id-counts")
    entries = counted.filter("adds = 1").select("dedup_key", (F.col("n_ids") - 1).alias("rank"), "identifier")
    records = resolved.join(counted.filter("adds = 0").select("ord", "n_ids"), "ord", "left").withColumn("n_ids", F.coalesce("n_ids", F.lit(0).cast("long")))
    return records, entries


def id_chunks(entries: DataFrame, size: int = CHUNK_IDS) -> DataFrame:
    """``dedup_key, chunk, identifiers``: a key's entries in order, at most ``size`` in a row."""
    rows = F.sort_array(F.collect_list(F.struct("rank", "identifier")))["identifier"]
    return entries.groupBy("dedup_key", F.floor(F.col("rank") / size).alias("chunk")).agg(rows.alias("identifiers"))


def ids_text(records: DataFrame, chunks: DataFrame, size: int = CHUNK_IDS) -> DataFrame:
    """``ord, matched_ids`` of the records asked for (``ord, dedup_key, n_ids``): this is where lists become text."""
    parts = records.filter("n_ids > 0").join(chunks, "dedup_key").filter(F.col("chunk") * size < F.col("n_ids"))
    part = F.slice("identifiers", F.lit(1), F.least(F.lit(size), F.col("n_ids") - F.col("chunk") * size).cast("int"))
    texts = parts.groupBy("ord").agg(F.array_join(F.sort_array(F.collect_list(F.struct("chunk", F.array_join(part, "|").alias("text"))))["text"], "|").alias("matched_ids"))
    return records.select("ord").join(texts, "ord", "left").withColumn("matched_ids", F.coalesce("matched_ids", F.lit("")))


def key_changes(resolved: DataFrame, state: KeyState) -> KeyState:
    """What the run adds to the store; the last given key of a hash wins."""
    given = "explicit_key" in resolved.columns
    last = F.max_by("explicit_key", F.when(F.col("explicit_key").isNotNull(), F.col("ord"))) if given else F.lit(None)
    final = resolved.groupBy("data_hash").agg(
        last.cast("string").alias("_given"),
        F.max(F.when(F.col("is_new"), F.col("dedup_key"))).alias("_minted"),
    )
    zero = F.lit(0).cast("long").alias("run_no")
    hash_key = (
        with_stored_key(final, state)
        .withColumn("dedup_key", F.coalesce("_given", "_minted"))
        .filter(F.col("dedup_key").isNotNull() & ~F.col("dedup_key").eqNullSafe(F.col("stored_key")))
        .select("data_hash", "dedup_key", zero)
    )
    links = []
    for item, old in (("identifier", state.key_identifier), ("data_hash", state.key_hash)):
        new = _links(resolved, item).join(old.select("dedup_key", item), ["dedup_key", item], "left_anti")
        links.append(new.select("dedup_key", item, zero, "ord"))
    return MergedState(hash_key, *links, state.key_alias) if isinstance(state, MergedState) else KeyState(hash_key, *links)

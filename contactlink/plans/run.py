"""A whole run: standardise, match, resolve keys, and the result table."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactlink.functions import keys, quality
from contactlink.functions.keys import field
from contactlink.operators import blocking, clusters, linking, matching
from contactlink.operators.mapping import apply_mapping
from contactlink.operators.rules import Rule, RuleSet, default_rules
from contactlink.operators.standardize import standardize, with_data_hash, with_quality
from contactlink.operators.storage import materialize
from contactlink.sources.files import CORRUPT, ORDER, with_order
from contactlink.sources.keystore import KeyState, KeyStore, LevelledKeyStore, MergedState, empty_state, with_current_key

ENGINE_VERSION = "1.0"


@dataclass
class Run:
    """Result rows, what the run adds to the key store, and how many input records did not fit their header (known if
    the input was read with ``keep_corrupt``). ``identifiers`` are the keys' identifiers in chunks, if asked for."""

    result: DataFrame
    changes: KeyState
    errors: int = 0
    identifiers: DataFrame | None = None


def prepare(df: DataFrame, order: str) -> DataFrame:
    """Standardised records with quality, block key and data hash."""
    return with_data_hash(blocking.with_block_key(with_quality(standardize(df))))


def iso_timestamp(at: datetime):
    return F.lit(at.strftime("%Y-%m-%dT%H:%M:%S.%f"))


def run_match(
    df: DataFrame,
    rules: Iterable[Rule] | None = None,
    order: str | None = None,
    mapping: Mapping[str, str] | None = None,
    state: KeyState | None = None,
    mode: str = "forward",
    at: datetime | None = None,
    strict_email: bool = False,
    points: Mapping[str, Mapping[str, int]] | None = None,
    engine_version: bool = False,
    blocks: list[Callable[[DataFrame], Column]] | None = None,
    confidence: bool = False,
    bands: bool = False,
    id_lists: bool = True,
    **search: int,
) -> Run:
    """Match a table of contact records.

    ``mode="forward"`` gives every record the key of its own data hash (or the key its
    partner brought along); ``mode="cluster"`` gives one key to all records of a cluster.
    ``order`` names the column with the record order; without it records are numbered as
    they are read; it must be unique. ``at`` is the time stamped on the result. ``blocks`` are
    block keys of standardised records, by default the one of company, zip and phone; records
    that share any of them are compared. ``confidence`` and ``bands`` add those columns.

    Records that did not fit their header (input read with ``keep_corrupt``) come out with MATCH_REASON ``ERROR``, the
    record's text in ``ERROR`` and no key; other records may have them as partners. With ``id_lists=False`` a record
    has the number of its key's identifiers up to it in ``MATCHED_RECORD_COUNT`` instead of their text, and
    ``Run.identifiers`` has them once per key, in chunks; see ``linking.ids_text``. In cluster mode stored keys that a
    cluster brings together become the smallest of them, and the store learns what became of the others.
    """
    if mode not in ("forward", "cluster"):
        raise ValueError(f"unknown mode {mode!r}")
    errors = df.agg(F.count(CORRUPT)).first()[0] if CORRUPT in df.columns else 0
    if not errors:
        df = df.drop(CORRUPT)
    df = apply_mapping(df, mapping)
    if order is None:
        order, df = ORDER, (df if ORDER in df.columns else with_order(df))
    state = state or empty_state(df.sparkSession)
    rule_set = RuleSet(default_rules() if rules is None else rules, strict_email)

    # Cleaning is the costly part per record and several steps need it, so the narrow
    # table is written once; the wide record is only touched again for the result.
    clean = with_data_hash(standardize(df))
    given_key = "DEDUP_KEY" if "DEDUP_KEY" in df.columns else None
    identifier = keys.identifier(field(df, "SOURCE_TYPE"), field(df, "SOURCE_ID")).alias("identifier")
    own = ["data_hash", "identifier", "is_bad"]
    is_bad = (F.col(CORRUPT).isNotNull() if errors else F.lit(False)).alias("is_bad")
    blocks = blocks or [matching.record_block_key]
    extra = [F.col("data_hash"), identifier, is_bad, *matching.block_columns(clean, blocks)]
    narrow = materialize(matching.match_columns(clean, rule_set, order, blocks[0](clean), given_key, extra), "narrow")
    if not narrow.groupBy("ord").count().filter((F.col("count") > 1) | F.col("ord").isNull()).isEmpty():
        raise ValueError(f"order column {order!r} has null or repeated values")
    state = state.of_hashes(narrow.select("data_hash"))
    compared = [t.drop(*own) for t in matching.by_block(narrow, len(blocks))]
    matches = matching.best_of_blocks([matching.best_match(t, rule_set, **search) for t in compared])
    best = materialize(matching.named_matches(matches, rule_set), "best")
    records = narrow.filter("NOT is_bad").select("ord", "data_hash", "identifier").join(best, "ord", "left")
    records = records.withColumn("is_match", F.col("match_ord").isNotNull())
    if given_key:
        records = records.withColumnRenamed("match_given_key", "explicit_key")
    if mode == "cluster":
        cluster = clusters.cluster_labels([t.drop("given_key") for t in compared], rule_set, **search)
        hashes = narrow.filter("NOT is_bad").select("ord", "data_hash")
        merged = materialize(clusters.merged_keys(hashes, cluster, state), "merged-keys")
        if not merged.isEmpty():
            current = (with_current_key(t, merged, "dedup_key") for t in (state.hash_key, state.key_identifier, state.key_hash))
            state = MergedState(*current, merged)
        # Keys are settled on narrow rows; the records are joined with them once.
        keyed = clusters.cluster_keys(hashes, cluster, state, stored=True)
        first = F.min(F.when(F.col("stored_key").isNull(), F.col("ord")))
        seen = materialize(keyed.groupBy("dedup_key").agg(first.alias("_first"), F.count("stored_key").alias("_stored")), "cluster-keys")
        is_new = ((F.col("_stored") == 0) & (F.col("ord") == F.col("_first"))).alias("is_new")
        keyed = keyed.join(seen, "dedup_key").select("ord", "dedup_key", is_new, "cluster_size")
        resolved = records.drop("explicit_key").join(keyed, "ord").withColumn(
            "is_match", F.col("is_match") | (F.col("cluster_size") > 1)).drop("cluster_size")
        resolved = resolved.withColumn("explicit_key", F.col("dedup_key"))
    else:
        resolved = linking.resolve_keys(records, state)
    # The result and the store both read this, so it is computed once.
    resolved = materialize(resolved, "resolved")
    state = state.of_keys(resolved.select("dedup_key"))
    changes = linking.key_changes(resolved, state)

    scores = {matching.score_name(f): F.round(matching.score_name(f), 2) for f in rule_set.score_fields}
    reason = F.when(F.col("is_match"), F.coalesce("match_reason", F.lit("CLUSTER"))).otherwise("NEW")
    if id_lists:
        listed, chunks = linking.with_matched_ids(resolved, state).withColumnRenamed("matched_ids", "MATCHED_RECORD_IDS"), None
    else:
        listed, entries = linking.with_id_ranks(resolved, state)
        listed, chunks = listed.withColumnRenamed("n_ids", "MATCHED_RECORD_COUNT"), linking.id_chunks(entries)
    outcome = listed.select(
        F.col("ord").alias("_result_ord"),
        F.col("dedup_key").alias("DEDUP_KEY"),
        reason.alias("MATCH_REASON"),
        "MATCHED_RECORD_IDS" if id_lists else "MATCHED_RECORD_COUNT",
        *(score.alias(name) for name, score in scores.items()),
        "is_new",
    )
    replaced = {"DEDUP_KEY", "MATCH_REASON", "MATCHED_RECORD_IDS", "MATCHED_RECORD_COUNT", "MATCH_TIMESTAMP", *scores, "is_new"}
    wide = with_quality(standardize(df), points)
    wide = wide.drop(*(c for c in wide.columns if c in replaced))
    result = wide.join(outcome, F.col(f"`{order}`").cast("long") == F.col("_result_ord"), "left" if errors else "inner").drop("_result_ord")
    if errors:
        result = result.withColumns({
            "MATCH_REASON": F.coalesce("MATCH_REASON", F.lit("ERROR")), "is_new": F.coalesce("is_new", F.lit(False)),
            "ERROR": F.concat(F.lit("record does not fit its header: "), F.col(CORRUPT)),
        }).drop(CORRUPT)
    if at is not None:
        result = result.withColumn("MATCH_TIMESTAMP", iso_timestamp(at))
    if engine_version:
        result = result.withColumn("MATCHING_ENGINE_VERSION", F.lit(ENGINE_VERSION))
    result = with_confidence(result) if confidence else result
    return Run(with_bands(result) if bands else result, changes, errors, chunks)


def run_with_store(df: DataFrame, store: KeyStore | LevelledKeyStore, output: str, run_id: str | None = None, at: datetime | None = None, **options) -> DataFrame:
    """Match against the store, write the result as Parquet, then commit the keys.

    The result is written before the commit. A run id that is committed already is not
    run again: its result is read as it was written.
    """
    if run_id is not None and store.has_run(run_id):
        return df.sparkSession.read.parquet(output)
    run = run_match(df, state=store.state(), at=at, **options)
    run.result.write.mode("overwrite").parquet(output)
    store.commit(run.changes, run_id, at)
    return df.sparkSession.read.parquet(output)


def with_confidence(result: DataFrame) -> DataFrame:
    """Add the four confidence columns and the overall one, from the scores of a match."""
    score = lambda name: F.col(name) if name in result.columns else F.lit(None).cast("double")
    address = {
        "address1": score("address_line_1_score"),
        "address2": score("address_line_2_score"),
        "city": score("city_score"),
        "state": score("state_score"),
        "zip_code": score("zip_code_score"),
    }
    overall = {
        "company_name": score("company_name_score"),
        "address1": score("address_line_1_score"),
        "email": score("email_address_score"),
        "phone": score("phone_number_score"),
    }
    return result.withColumns(
        {
            "company_confidence": F.coalesce(overall["company_name"], F.lit(0.0)),
            "address_confidence": quality.address_confidence(address),
            "email_confidence": F.when(overall["email"] >= 100, 100.0).otherwise(0.0),
            "phone_confidence": F.when(overall["phone"] >= 100, 100.0).otherwise(0.0),
            "overall_confidence": quality.overall_confidence(overall),
        }
    )


def with_bands(df: DataFrame) -> DataFrame:
    """Add the named bands of the two quality totals."""
    return df.withColumns(
        {
            "email_quality_band": quality.band(F.col("email_quality_total"), quality.EMAIL_BANDS),
            "phone_quality_band": quality.band(F.col("phone_quality_total"), quality.PHONE_BANDS),
        }
    )

"""One query per operator, over the derived contact records or the text tables."""

from __future__ import annotations

import json
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from contactlink.functions import keys, quality, similarity, text
from contactlink.functions.keys import field
from contactlink.operators import blocking, clusters, linking, mapping, matching, reports, standardize
from contactlink.operators.rules import (
    DEFAULT_RULES, FIELD_THRESHOLDS, Condition, Rule, RuleSet, active_rules, comparable, default_rules, load_json, load_rules,
    parse_rules,
)
from contactlink.operators.skew import with_followers, with_position
from contactlink.operators.storage import materialize, scratch_path
from contactlink.plans import run as plan
from contactlink.plans.contacts import contacts, table
from contactlink.sources import catalog as cat
from contactlink.sources import files
from contactlink.sources.keystore import (
    KeyState, KeyStore, LevelledKeyStore, empty_state, hashes_per_key, identifiers_per_key, import_mappings, with_current_key,
)
from contactlink.streaming import incremental

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}
RUN_TIME = datetime(2024, 1, 1)

# Source headers of imported files, by order number; with the words of the documents
# they are what auto-mapping sees.
SOURCE_HEADERS = (
    "company_name", "SRC_ID", "ZIP_SUPP", "ZIP4", "NAME", "ADDRESS", "favourite_colour", " Phone ", "email", ""
)

MAPPING = {
    "COMPANY_NAME": "NAME1",
    "EMAIL_ADDRESS": "CONTACT",
    "PHONE_NUMBER": "CONTACT",
    "ZIP_CODE": "SOURCE_ID",
    "NO_SUCH_COLUMN": "X",
}

CONDITIONS = {
    "company_70": Condition("COMPANY_NAME", 70),
    "address_not_80": Condition("ADDRESS_LINE_1", 80, include=False),
    "address2_80_or_blank": Condition("ADDRESS_LINE_2", 80, blank_allowed=True),
    "zip_blank": Condition("ZIP_CODE", blank=True),
    "zip_100": Condition("ZIP_CODE", 100),
    "phone_100": Condition("PHONE_NUMBER", 100),
    "email_as_address_90": Condition("EMAIL_ADDRESS", 90),
    "email_std_100": Condition("EMAIL_STD", 100),
    "source_any": Condition("SOURCE_TYPE"),
}

#: Records of a file up to which one task writes and reads it.
FILE_RECORDS = 500_000
#: The same for files that arrive in a stream, which cleans what it reads in the tasks that read it.
STREAM_FILE_RECORDS = 50_000

BLOCKS = [matching.record_block_key, blocking.phone_block, blocking.address_block]

LARGE_BLOCK_RULES = {
    "rules": {
        "NAME": {"priority": 1, "conditions": [{"field": "COMPANY_NAME", "percentage": 88}]},
        "NAME_ADDRESS": {"priority": 2, "conditions": [{"field": "COMPANY_NAME", "percentage": 75}, {"field": "ADDRESS_LINE_1", "percentage": 90}]},
    }
}

PLAN_RULES = {
    "rules": {
        "PLACE": {"priority": 1, "conditions": [
            {"field": "COMPANY_NAME", "percentage": 70}, {"field": "ZIP_CODE", "percentage": 100}, {"field": "PHONE_NUMBER", "percentage": 100}]},
        "ADDRESS": {"priority": 2, "conditions": [{"field": "COMPANY_NAME", "percentage": 60}, {"field": "ADDRESS_LINE_1", "percentage": 100}]},
        "NAME": {"priority": 3, "conditions": [{"field": "COMPANY_NAME", "percentage": 88}]},
    }
}

RULES_FILE = {
    "rules": {
        "R90": {
            "match_reason": "NAME_90",
            "conditions": [
                {"field": "COMPANY_NAME", "percentage": "90"},
                {"field": "ADDRESS_LINE_1", "percentage": "80"},
                {"field": "ZIP_CODE", "percentage": "100"},
            ],
        },
        "OFF": {"enabled": False, "conditions": [{"field": "ZIP_CODE", "percentage": ""}]},
    }
}
EDIT_RULES = {
    "rules": {
        "EDITS": {"conditions": [{"field": "COMPANY_NAME", "percentage": 80, "method": "levenshtein"}, {"field": "ZIP_CODE", "percentage": 100}]}
    }
}
SETTINGS_FILE = {
    "quality_scores": {
        "email": {"criteria": {"valid_format": {"max_points": 50}, "non_personal": {"max_points": 7}}},
        "phone": {"criteria": {"has_10_digits": {"max_points": 30}}},
    }
}
COLUMNS_FILE = {
    "company": [
        {"column_name": "ZIP_CODE", "default_selected": True, "sequence": 3},
        {"column_name": "COMPANY_NAME", "default_selected": True, "sequence": 2},
        {"column_name": "PHONE_NUMBER", "default_selected": False, "sequence": 1},
    ],
    "source": [{"column_name": "RID", "default_selected": True, "sequence": 1}, {"column_name": "NOT_THERE", "default_selected": True, "sequence": 9}],
}

THRESHOLD_RULES = {
    "rules": {
        "T1": {
            "match_reason": "BY_THRESHOLD",
            "conditions": [{"field": f} for f in ("COMPANY_NAME", "ADDRESS_LINE_1", "ADDRESS_LINE_2", "ZIP_CODE")],
        }
    }
}


def query(fn: Query) -> Query:
    REGISTRY[fn.__name__] = fn
    return fn


# --- shared inputs ---------------------------------------------------------------------


def _clean(spark: SparkSession, folder: str) -> DataFrame:
    return plan.prepare(contacts(spark, folder), "RID")


def _narrow(df: DataFrame, rules: RuleSet, block=None) -> DataFrame:
    """Comparison columns of contact records, written once."""
    clean = standardize.standardize(df)
    key = matching.record_block_key(clean) if block is None else block(clean)
    return materialize(matching.match_columns(clean, rules, "RID", key), "narrow")


def _best(spark: SparkSession, folder: str, rules=None) -> DataFrame:
    rule_set = RuleSet(default_rules() if rules is None else rules)
    best = matching.best_match(_narrow(contacts(spark, folder), rule_set), rule_set)
    return matching.named_matches(best, rule_set)


def _run(spark: SparkSession, folder: str, **options) -> plan.Run:
    return plan.run_match(contacts(spark, folder), order="RID", at=RUN_TIME, **options)


def _with_given_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Contacts where some records bring a master key along."""
    company = F.floor(F.col("RID") / 4).cast("bigint").cast("string")
    return contacts(spark, folder).withColumn(
        "DEDUP_KEY",
        F.when((F.col("RID") % 4 == 1) & (F.floor(F.col("RID") / 4) % 3 == 0), F.concat(F.lit("M1-"), company))
        .when(F.col("RID") % 4 == 2, F.concat(F.lit("M2-"), company))
        .otherwise(""),
    )


def _crm_state(spark: SparkSession, folder: str) -> KeyState:
    """A key store that knows the records of source CRM under old keys."""
    known = _clean(spark, folder).filter(F.upper(text.strip(F.col("SOURCE_TYPE"))) == "CRM").select("data_hash").distinct()
    empty = empty_state(spark)
    return KeyState(
        known.select("data_hash", F.concat(F.lit("OLD-"), "data_hash").alias("dedup_key"), F.lit(1).cast("long").alias("run_no")),
        empty.key_identifier,
        empty.key_hash,
    )


def _neighbours(spark: SparkSession, folder: str, columns: list[str]) -> DataFrame:
    """Every record with the next one of its block: ``RID, other, l_*, r_*``."""
    clean = materialize(_clean(spark, folder).select("RID", "block_key", *columns), "neighbours")
    pairs = with_followers(clean.select("block_key", "RID"), ["block_key"], "RID").filter("next_later IS NOT NULL")
    pairs = pairs.select("RID", F.col("next_later").alias("other"))
    left = clean.select("RID", *(F.col(c).alias(f"l_{c}") for c in columns))
    right = clean.select(F.col("RID").alias("other"), *(F.col(c).alias(f"r_{c}") for c in columns))
    return pairs.join(left, "RID").join(right, "other")


def _words(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct words of all documents."""
    documents = files.spread(table(spark, folder, "documents").select("text"))
    return documents.select(F.explode(F.split("text", "[ \\t\\n\\r]+")).alias("word")).filter("word <> ''").distinct()


def _stored(spark: SparkSession, folder: str) -> KeyState:
    """The key store after one run over the contacts."""
    store = KeyStore(spark, scratch_path(spark, "store"))
    store.commit(_run(spark, folder).changes, "first", RUN_TIME)
    return store.state()


def _json_file(spark: SparkSession, name: str, document: dict) -> str:
    """A configuration document as a file."""
    path = scratch_path(spark, name)
    spark.createDataFrame([(json.dumps(document),)], "value string").coalesce(1).write.text(path)
    return path


# --- scans, sources, sinks -------------------------------------------------------------


@query
def a1_csv_scan(spark, folder):
    path = scratch_path(spark, "csv")
    files.write_csv(contacts(spark, folder), path)
    return files.read_csv(spark, path, order=None).na.fill("")


@query
def a1_multi_file(spark, folder):
    """Contacts in files of unequal size, whose columns are in different orders; one compressed, one with an upper-case name."""
    path = scratch_path(spark, "csv")
    df = contacts(spark, folder)
    share = F.col("RID") % 10
    n_files = 1 + df.count() // FILE_RECORDS
    parts = {"a": (share == 0, df.columns), "b": ((share > 0) & (share < 8), df.columns[::-1]), "c": (share >= 8, sorted(df.columns))}
    for name, (chosen, columns) in parts.items():
        # Ranges in falling order, so the files of a folder, by name, hold the records in falling order.
        rows = df.filter(chosen).repartitionByRange(n_files, F.desc("RID")).sortWithinPartitions(F.desc("RID")).select(*columns)
        rows.write.options(header=True, quote='"', escape='"', emptyValue="", nullValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, compression="gzip" if name == "c" else "none").csv(f"{path}/{name}")
    listed = [f"{path}/{name}" for name in parts]
    read = files.read_csv(spark, listed).na.fill("")
    placed = with_position(read.withColumn("_share", F.col("RID").cast("long") % 10), ["_share"], files.ORDER)
    return placed.withColumn("place", F.col("pos") + 1).drop(files.ORDER, "_share", "pos", "n")


@query
def a1_many_files(spark, folder):
    """Contacts in some 2,000 files under three headers."""
    path = scratch_path(spark, "csv")
    df = contacts(spark, folder)
    size = max(1, df.count() // 2000)
    for share, columns in enumerate((df.columns, df.columns[::-1], sorted(df.columns))):
        files.write_csv(df.filter(F.col("RID") % 3 == share).select(columns), f"{path}/{share}", max_records=size)
    return files.read_csv(spark, [f"{path}/{share}" for share in range(3)], order=None).na.fill("")


@query
def a2_input_profile(spark, folder):
    names, first, total = files.profile(contacts(spark, folder), "RID", 10)
    return first.select(
        "RID", "COMPANY_NAME", F.lit(len(names) + 1).cast("bigint").alias("n_columns"), F.lit(total).cast("bigint").alias("total_records")
    )


@query
def a3_preview(spark, folder):
    df = contacts(spark, folder)
    return files.preview(df, "RID").withColumn("total_records", F.lit(df.count()).cast("bigint"))


@query
def a4_file_inventory(spark, folder):
    path = scratch_path(spark, "csv")
    files.write_csv(contacts(spark, folder), path)
    return files.inventory(spark, path)


@query
def a4_inventory_order(spark, folder):
    """The inventory of a folder with contacts in seven files, and files of other kinds, by its order."""
    path = scratch_path(spark, "csv")
    files.write_csv(contacts(spark, folder).repartitionByRange(7, "RID"), path)
    listed = files.inventory(spark, path).withColumn("place", F.monotonically_increasing_id())
    newer = F.lag("modified").over(Window.orderBy("place"))  # a row per file
    listed = listed.withColumn("in_order", F.coalesce(newer >= F.col("modified"), F.lit(True)))
    return listed.agg(
        F.count(F.lit(1)).alias("files"), F.count_if(F.col("filename").endswith(".csv") & (F.col("size") > 0)).alias("filled_csv"),
        F.bool_and("in_order").alias("newest_first"),
    )


@query
def a6_rules_source(spark, folder):
    """Best matches by the rules of a file."""
    rules = load_rules(spark, _json_file(spark, "rules", RULES_FILE))
    return _best(spark, folder, rules).select(F.col("ord").alias("RID"), F.col("match_ord").alias("match_rid"), "rule_id", "match_reason")


@query
def a7_settings(spark, folder):
    """Quality totals by the points of a settings file."""
    points = standardize.quality_points(load_json(spark, _json_file(spark, "settings", SETTINGS_FILE)))
    return standardize.with_quality(contacts(spark, folder), points).select("RID", "email_quality_total", "phone_quality_total")


@query
def a9_column_config(spark, folder):
    """Contacts with the columns that a file selects, in its order."""
    table = cat.column_config_table(spark, _json_file(spark, "columns", COLUMNS_FILE))
    chosen = [r["column_name"] for r in table.filter("default_selected").orderBy("sequence", "section").collect()]
    return files.select_output(contacts(spark, folder), chosen)


@query
def a8_column_catalog(spark, folder):
    catalog = cat.default_catalog()
    counts = mapping.blank_counts(contacts(spark, folder), [c.name for c in catalog.columns])
    return (
        cat.catalog_table(spark, catalog)
        .join(counts, F.col("name") == F.col("column_name"))
        .select("name", F.col("group").alias("column_group"), "required",
                F.size("alternate_columns").cast("bigint").alias("n_alternates"), "present", "filled")
    )


@query
def a10_mapping_import(spark, folder):
    clean = _clean(spark, folder).select(
        F.floor(F.col("RID") / 4).alias("document"),
        "data_hash",
        keys.minted_key(F.col("data_hash")).alias("dedup_key"),
        keys.identifier(F.col("SOURCE_TYPE"), F.col("SOURCE_ID")).alias("identifier"),
    )
    per_key = clean.groupBy("document", "dedup_key").agg(
        F.sort_array(F.collect_set("data_hash")).alias("hashes"), F.sort_array(F.collect_set("identifier")).alias("ids")
    )
    documents = per_key.groupBy("document").agg(
        F.to_json(
            F.struct(
                F.map_from_entries(F.collect_list(F.struct(F.col("hashes")[0], "dedup_key"))).alias("data_hash_to_key"),
                F.map_from_entries(F.collect_list(F.struct("dedup_key", "hashes"))).alias("key_to_data_hashes"),
                F.map_from_entries(F.collect_list(F.struct("dedup_key", "ids"))).alias("key_to_identifiers"),
            )
        ).alias("value")
    )
    path = scratch_path(spark, "mappings")
    documents.select("value").write.text(path)
    state = import_mappings(spark.read.text(path))
    listed = identifiers_per_key(state).select("dedup_key", F.array_join("identifiers", "|").alias("identifiers"))
    return state.hash_key.select("data_hash", "dedup_key").join(listed, "dedup_key")


@query
def a11_two_runs(spark, folder):
    store = KeyStore(spark, scratch_path(spark, "store"))
    df = contacts(spark, folder)
    outputs = []
    for name in ("first", "second"):
        outputs.append(plan.run_with_store(df, store, scratch_path(spark, name), name, RUN_TIME, order="RID"))
    first, second = outputs
    return (
        second.select("RID", F.col("DEDUP_KEY").alias("second_key"), "is_new")
        .join(first.select("RID", F.col("DEDUP_KEY").alias("first_key")), "RID")
        .withColumn("total_runs", F.lit(store.total_runs()).cast("bigint"))
    )


@query
def a11_many_runs(spark, folder):
    """Six runs add their records' hashes, and some of the run before, to a levelled store, each asking it first."""
    store = LevelledKeyStore(spark, scratch_path(spark, "store")).hash_key
    clean = materialize(_clean(spark, folder).select("RID", "data_hash"), "hashes")
    told = None
    for run in range(6):
        mine = clean.filter((F.floor(F.col("RID") / 4) % 6 == run) | ((F.floor(F.col("RID") / 4) % 6 == run - 1) & (F.col("RID") % 4 == 2)))
        hashes = mine.select("data_hash").distinct()
        known = store.ask(hashes)
        new = materialize(hashes.join(known.rows, "data_hash", "left_anti").withColumn("dedup_key", keys.minted_key(F.col("data_hash"))), "new-hashes")
        row = new.agg(F.lit(run).alias("run"), F.count(F.lit(1)).alias("new_hashes")).crossJoin(known.rows.agg(F.count(F.lit(1)).alias("known_hashes")))
        told = row if told is None else told.unionByName(row)
        store.add(new, f"run-{run}")
    return told.select("run", "new_hashes", "known_hashes", F.lit(store.rows().count()).alias("stored"))


@query
def a12_sink_roundtrip(spark, folder):
    path = scratch_path(spark, "csv")
    wanted = ["RID", "COMPANY_NAME", "SOURCE_TYPE", "EMAIL_ADDRESS", "PHONE_STD", "DEDUP_KEY", "MATCH_REASON", "NOT_THERE"]
    files.write_csv(files.select_output(_run(spark, folder).result, wanted), path)
    return files.read_csv(spark, path, order=None).na.fill("")


# --- projections, filters, predicates --------------------------------------------------


@query
def b1_auto_map(spark, folder):
    orders = table(spark, folder, "orders")
    names = F.array(*(F.lit(h) for h in SOURCE_HEADERS))
    from_files = orders.select(
        F.element_at(names, (F.col("o_orderkey") % len(SOURCE_HEADERS) + 1).cast("int")).alias("header")
    )
    headers = from_files.unionByName(_words(spark, folder).select(F.col("word").alias("header")))
    return mapping.auto_map(headers, cat.default_catalog())


@query
def b2_apply_mapping(spark, folder):
    return mapping.apply_mapping(contacts(spark, folder), MAPPING)


@query
def b3_standardize(spark, folder):
    return standardize.standardize(contacts(spark, folder)).select("RID", *standardize.STD_COLUMNS)


@query
def b4_select_output(spark, folder):
    df = standardize.standardize(contacts(spark, folder))
    return files.select_output(df, ["COMPANY_NAME_STD", "RID", "MISSING_COLUMN", "zip_code"])


@query
def b5_default_columns(spark, folder):
    return files.select_output(_run(spark, folder).result, cat.default_output_columns(cat.default_catalog()))


@query
def b7_catalog_search(spark, folder):
    terms = _words(spark, folder).select(F.lower("word").alias("term")).distinct()
    hits = cat.search_hits(F.col("term"), cat.default_catalog())
    return terms.select("term", F.array_join(hits, ",").alias("hits")).filter("hits <> ''")


@query
def b8_active_rules(spark, folder):
    rules = parse_rules(
        {"rules": {**DEFAULT_RULES["rules"], "OFF": {"enabled": False, "conditions": [{"field": "CITY"}]}, "NONE": {"conditions": []}}}
    )
    rule_set = RuleSet(rules)
    narrow = _narrow(contacts(spark, folder), rule_set)
    counts = narrow.agg(*(F.count_if(rule_set.eligible(r)).alias(r.id) for r in rule_set.rules))
    return counts.select(
        F.explode(
            F.array(
                *(
                    F.struct(
                        F.lit(rank).cast("bigint").alias("rank"),
                        F.lit(r.id).alias("rule_id"),
                        F.lit(r.priority).cast("bigint").alias("priority"),
                        F.lit(r.match_reason).alias("match_reason"),
                        F.lit(len(r.conditions)).cast("bigint").alias("n_conditions"),
                        F.col(r.id).alias("eligible_records"),
                    )
                    for rank, r in enumerate(active_rules(rules), 1)
                )
            )
        ).alias("r")
    ).select("r.*")


@query
def b9_condition(spark, folder):
    rule_set = RuleSet([Rule(name, (c,), name, position=i) for i, (name, c) in enumerate(CONDITIONS.items())])
    fields = list(dict.fromkeys(c.field for c in CONDITIONS.values()))
    pairs = _neighbours(spark, folder, fields)
    sides = {
        side + alias: comparable(F.col(side + name), kind)
        for (name, kind), alias in rule_set.columns.items()
        for side in ("l_", "r_")
    }
    pairs = pairs.withColumns(sides)
    decided = rule_set.with_similarities(pairs, rule_set.rules, "l_", "r_")
    return decided.select("RID", "other", *(rule_set.matches(r, "l_", "r_").alias(r.id) for r in rule_set.rules))


@query
def b10_rule_scores(spark, folder):
    result = _run(spark, folder).result.filter("MATCH_REASON <> 'NEW'")
    return result.select(
        "RID", "MATCH_REASON", "company_name_score", "address_line_1_score", "address_line_2_score",
        "zip_code_score", "phone_number_score",
    )


@query
def b11_required_report(spark, folder):
    return mapping.required_report(contacts(spark, folder).drop("SOURCE_ID"), cat.default_catalog())


def _unquoted(spark: SparkSession, folder: str) -> str:
    """Contacts with unquoted company names: a comma in one makes a row with a surplus field."""
    line = F.concat_ws(",", F.col("RID").cast("string"), "COMPANY_NAME", "ZIP_CODE")
    path = scratch_path(spark, "csv")
    lines = contacts(spark, folder).select(line.alias("RID,COMPANY_NAME,ZIP_CODE"))
    lines.write.options(header=True, quote="", escapeQuotes=False, sep="\u0001").csv(path)
    return path


@query
def b13_bad_rows(spark, folder):
    return files.count_bad_rows(files.read_csv(spark, _unquoted(spark, folder), order=None, keep_corrupt=True))


@query
def b13_error_rows(spark, folder):
    """A run over records of which some do not fit their header."""
    run = plan.run_match(files.read_csv(spark, _unquoted(spark, folder), keep_corrupt=True))
    stats = reports.run_statistics(run.result).select("total_records", "errors")
    told = run.result.select(
        F.col("RID").cast("bigint").alias("RID"), (F.col("MATCH_REASON") == "ERROR").alias("is_error"),
        F.col("ERROR").contains(F.col("RID")).alias("has_text"), F.col("DEDUP_KEY").isNull().alias("no_key"),
    )
    return told.crossJoin(stats)  # one row


# --- joins -----------------------------------------------------------------------------


@query
def c1_candidate_pairs(spark, folder):
    return blocking.candidates(_clean(spark, folder), "RID").withColumnRenamed("ord", "RID")


@query
def c2_rule_match(spark, folder):
    parts = None
    for rule in active_rules(default_rules()):
        best = _best(spark, folder, [rule]).select(F.col("ord").alias("RID"), "rule_id", F.col("match_ord").alias("match_rid"))
        parts = best if parts is None else parts.unionByName(best)
    return parts


@query
def c3_key_lookup(spark, folder):
    hashes = _clean(spark, folder).select("RID", "data_hash")
    return linking.with_stored_key(hashes, _crm_state(spark, folder))


@query
def c4_new_hashes(spark, folder):
    return linking.unseen_hashes(_clean(spark, folder).select("data_hash").distinct(), _crm_state(spark, folder))


@query
def c5_seen_hashes(spark, folder):
    return linking.seen_hashes(_clean(spark, folder).select("data_hash").distinct(), _crm_state(spark, folder))


@query
def c6_domain_lookup(spark, folder):
    flags = quality.list_flags(F.col("EMAIL_ADDRESS"), F.col("PHONE_NUMBER"))
    return contacts(spark, folder).select("RID", *(c.alias(n) for n, c in flags.items()))


@query
def c9_master_key(spark, folder):
    result = plan.run_match(_with_given_keys(spark, folder), order="RID").result
    return result.select("RID", "DEDUP_KEY", "MATCH_REASON")


# --- aggregates ------------------------------------------------------------------------


@query
def d1_block_stats(spark, folder):
    return reports.block_sizes(_clean(spark, folder))


@query
def d1_block_plan(spark, folder):
    """Comparisons of blocks by the first digit of the zip, rule by rule, and the extra key that saves most."""
    rule_set = RuleSet(parse_rules(PLAN_RULES))
    return blocking.plan(_narrow(contacts(spark, folder), rule_set, _first_of_zip), rule_set)


@query
def d2_run_stats(spark, folder):
    return reports.run_statistics(_run(spark, folder).result)


@query
def d3_key_identifiers(spark, folder):
    listed = identifiers_per_key(_stored(spark, folder))
    return listed.select("dedup_key", F.array_join("identifiers", "|").alias("identifiers"))


@query
def d4_key_hashes(spark, folder):
    listed = hashes_per_key(_stored(spark, folder))
    return listed.select("dedup_key", F.array_join("data_hashes", "|").alias("data_hashes"))


@query
def d6_group_catalog(spark, folder):
    catalog = cat.default_catalog()
    counts = mapping.blank_counts(contacts(spark, folder), [c.name for c in catalog.columns])
    named = cat.groups(spark, catalog).select(F.col("group").alias("column_group"), F.explode("columns").alias("name"))
    return (
        named.join(counts, F.col("name") == F.col("column_name"))
        .groupBy("column_group")
        .agg(F.array_join(F.sort_array(F.collect_list("name")), ",").alias("columns"), F.sum("filled").alias("filled"))
    )


@query
def d8_quality_profile(spark, folder):
    return reports.quality_profile(_clean(spark, folder)).withColumn("avg_points", F.round("avg_points", 6))


@query
def d9_reason_counts(spark, folder):
    return reports.reason_counts(_run(spark, folder).result)


# --- best match, keys, identifiers -----------------------------------------------------


@query
def e1_best_match(spark, folder):
    return _best(spark, folder).select(
        F.col("ord").alias("RID"), F.col("match_ord").alias("match_rid"), "rule_id", "match_reason"
    )


def _first_of_zip(df: DataFrame):
    return F.substring(F.coalesce(field(df, "ZIP_CODE"), F.lit("")), 1, 1)


@query
def e1_large_block(spark, folder):
    """Best matches in eleven blocks, by the first digit of the zip, under rules without equal columns."""
    rule_set = RuleSet(parse_rules(LARGE_BLOCK_RULES))
    best = matching.best_match(_narrow(contacts(spark, folder), rule_set, _first_of_zip), rule_set)
    named = matching.named_matches(best, rule_set)
    return named.select(F.col("ord").alias("RID"), F.col("match_ord").alias("match_rid"), "rule_id", F.round("company_name_score", 6).alias("score"))


@query
def e2_hot_hash(spark, folder):
    """Keys where a third of all records share a data hash and many bring keys along."""
    hot = F.col("RID") % 3 == 0
    same = {"SOURCE_TYPE": "CRM", "SOURCE_ID": "1", "COMPANY_NAME": "Hot Works", "ADDRESS_LINE_1": "1 Main St", "ADDRESS_LINE_2": "", "PHONE_NUMBER": "4155550000"}
    df = contacts(spark, folder).withColumns({name: F.when(hot, F.lit(value)).otherwise(F.col(name)) for name, value in same.items()})
    zip_code = F.lpad((F.floor(F.col("RID") / 6) % 100000).cast("string"), 5, "0")
    df = df.withColumn("ZIP_CODE", F.when(hot, zip_code).otherwise(F.col("ZIP_CODE")))
    given = F.when(hot & (F.col("RID") % 6 == 3), F.concat(F.lit("G"), (F.col("RID") % 7).cast("string"))).otherwise("")
    return plan.run_match(df.withColumn("DEDUP_KEY", given), order="RID").result.select("RID", "DEDUP_KEY", "is_new")


@query
def e3_hot_key(spark, folder):
    """Identifier lists by pointers, where a third of all records get one key."""
    company = F.floor(F.col("RID") / 4)
    hot = (F.col("RID") % 4 == 1) | ((F.col("RID") % 4 == 2) & (company % 3 == 0))
    run = plan.run_match(contacts(spark, folder).withColumn("DEDUP_KEY", F.when(hot, "HOT").otherwise("")), order="RID", id_lists=False)
    last = F.col("MATCHED_RECORD_COUNT") - 1
    asked = run.result.select("RID", "DEDUP_KEY", F.col("MATCHED_RECORD_COUNT").alias("n_ids"), F.floor(last / linking.CHUNK_IDS).alias("chunk"), (last % linking.CHUNK_IDS).cast("int").alias("place"))
    chunks = run.identifiers.withColumnRenamed("dedup_key", "DEDUP_KEY")
    found = asked.join(chunks, ["DEDUP_KEY", "chunk"], "left")
    return found.select("RID", "DEDUP_KEY", "n_ids", F.when(F.col("n_ids") > 0, F.get("identifiers", "place")).alias("last_id"))


@query
def e2_resolve_keys(spark, folder):
    state = _crm_state(spark, folder)
    result = plan.run_match(_with_given_keys(spark, folder), order="RID", state=state).result
    return result.select("RID", "DEDUP_KEY", "is_new")


@query
def e3_matched_ids(spark, folder):
    result = plan.run_match(_with_given_keys(spark, folder), order="RID").result
    return result.select("RID", "MATCHED_RECORD_IDS")


# --- set operations --------------------------------------------------------------------


@query
def f1_result_union(spark, folder):
    result = materialize(
        _run(spark, folder).result.select("RID", "DEDUP_KEY", "MATCH_REASON", "company_name_score"), "result"
    )
    new = result.filter("MATCH_REASON = 'NEW'").drop("company_name_score")
    return result.filter("MATCH_REASON <> 'NEW'").unionByName(new, allowMissingColumns=True)


@query
def f3_mapping_upsert(spark, folder):
    store = KeyStore(spark, scratch_path(spark, "store"))
    store.commit(_crm_state(spark, folder), "old", RUN_TIME)
    changes = plan.run_match(_with_given_keys(spark, folder), order="RID", state=store.state()).changes
    store.commit(changes, "new", RUN_TIME)
    return store.state().hash_key.select("data_hash", "dedup_key")


# --- scalar functions over tables ------------------------------------------------------


@query
def h1_normalize_text(spark, folder):
    documents = files.spread(table(spark, folder, "documents").select("doc_id", "text"))
    return documents.select("doc_id", text.normalize_text(F.col("text")).alias("normalized"))


def _std(source: str, clean, out: str) -> Query:
    return lambda spark, folder: contacts(spark, folder).select("RID", clean(F.col(source)).alias(out))


REGISTRY["h2_company_std"] = _std("COMPANY_NAME", text.company_std, "company_std")
REGISTRY["h3_address_std"] = _std("ADDRESS_LINE_1", text.address_std, "address_std")
REGISTRY["h4_phone_std"] = _std("PHONE_NUMBER", text.phone_std, "phone_std")
REGISTRY["h5_email_std"] = _std("EMAIL_ADDRESS", text.email_std, "email_std")


def _similar(method: str) -> Query:
    def run(spark, folder):
        pairs = _neighbours(spark, folder, ["COMPANY_NAME"])
        score = similarity.similarity(F.col("l_COMPANY_NAME"), F.col("r_COMPANY_NAME"), method)
        return pairs.select("RID", "other", F.round(score, 6).alias("score"))

    return run


REGISTRY["h7_token_sort"] = _similar("token_sort")
REGISTRY["h8_ratio"] = _similar("ratio")
REGISTRY["h9_token_set"] = _similar("token_set")
REGISTRY["h10_partial"] = _similar("partial")


@query
def h11_compare(spark, folder):
    pairs = _neighbours(spark, folder, ["COMPANY_NAME", "ADDRESS_LINE_1"])
    company = similarity.compare_companies(F.col("l_COMPANY_NAME"), F.col("r_COMPANY_NAME"))
    address = similarity.compare_addresses(F.col("l_ADDRESS_LINE_1"), F.col("r_ADDRESS_LINE_1"))
    return pairs.select("RID", "other", F.round(company, 6).alias("company"), F.round(address, 6).alias("address"))


@query
def h12_exact_compare(spark, folder):
    pairs = _neighbours(spark, folder, ["PHONE_NUMBER", "EMAIL_ADDRESS"])
    return pairs.select(
        "RID", "other",
        similarity.compare_phones(F.col("l_PHONE_NUMBER"), F.col("r_PHONE_NUMBER")).alias("phone"),
        similarity.compare_emails(F.col("l_EMAIL_ADDRESS"), F.col("r_EMAIL_ADDRESS")).alias("email"),
    )


@query
def h13_email_quality(spark, folder):
    columns = quality.email_quality(F.col("EMAIL_ADDRESS"))
    return contacts(spark, folder).select("RID", *(c.alias(n) for n, c in columns.items()))


@query
def h14_phone_quality(spark, folder):
    columns = quality.phone_quality(F.col("PHONE_NUMBER"), F.col("PHONE_EXTENSION"))
    return contacts(spark, folder).select("RID", *(c.alias(n) for n, c in columns.items()))


@query
def h15_quality_columns(spark, folder):
    df = standardize.with_quality(contacts(spark, folder))
    return df.select("RID", *(c for c in df.columns if "_quality_" in c))


def _confidence(spark, folder) -> DataFrame:
    return plan.with_confidence(_run(spark, folder).result.filter("MATCH_REASON <> 'NEW'"))


@query
def h16_address_confidence(spark, folder):
    return _confidence(spark, folder).select("RID", "address_confidence")


@query
def h17_overall_confidence(spark, folder):
    return _confidence(spark, folder).select("RID", "overall_confidence")


@query
def h18_block_key(spark, folder):
    return _clean(spark, folder).select("RID", "block_key")


@query
def h19_data_hash(spark, folder):
    return _clean(spark, folder).select("RID", "data_hash")


# --- streams ---------------------------------------------------------------------------


def _dropped(df: DataFrame, drop: str) -> int:
    """Contacts as the files of a drop folder, by ranges of their numbers; the number of files that are half of them."""
    half = 2 * (1 + df.count() // (4 * STREAM_FILE_RECORDS))
    files.write_csv(df.repartitionByRange(2 * half, "RID"), drop)
    return half


@query
def i1_incremental(spark, folder):
    drop, output, store = (scratch_path(spark, n) for n in ("drop", "output", "store"))
    df = contacts(spark, folder)
    files.write_csv(df.repartitionByRange(4, "RID"), drop)
    stream = incremental.read_folder(spark, drop, df.columns, max_files=2)
    stream = stream.withColumn("RID", F.col("RID").cast("bigint"))
    incremental.incremental_dedup(stream, store, output, scratch_path(spark, "progress"), order="RID").awaitTermination()
    return spark.read.parquet(output).select("RID", "DEDUP_KEY")


@query
def i1_levelled(spark, folder):
    """Three micro-batches against a levelled store; the last has records of the others once more."""
    drop, output, store = (scratch_path(spark, n) for n in ("drop", "output", "store"))
    df = contacts(spark, folder)
    half = _dropped(df, drop)
    stream = incremental.read_folder(spark, drop, df.columns, max_files=half).withColumn("RID", F.col("RID").cast("bigint"))
    progress = scratch_path(spark, "progress")
    incremental.incremental_dedup(stream, store, output, progress, order="RID", levelled=True).awaitTermination()
    again = df.filter(F.col("RID") % 7 == 0)
    files.write_csv(again.repartition(half // 2) if half > 2 else again.coalesce(1), drop, mode="append")
    incremental.incremental_dedup(stream, store, output, progress, order="RID", levelled=True).awaitTermination()
    result = spark.read.parquet(output)
    return result.groupBy("RID", "DEDUP_KEY").agg(F.count(F.lit(1)).alias("times"), F.count_if((F.col("batch") == 2) & F.col("is_new")).alias("new_again"))


@query
def i1_stateful(spark, folder):
    """Keys as the state of a stream that starts with the old keys of source CRM; some records arrive a second time."""
    drop, output, progress = (scratch_path(spark, n) for n in ("drop", "output", "progress"))
    df = contacts(spark, folder)
    half = _dropped(df, drop)
    stream = incremental.read_folder(spark, drop, df.columns, max_files=half)
    known = _crm_state(spark, folder)
    incremental.stateful_keys(stream, output, progress, "RID", known).awaitTermination()
    files.write_csv(df.filter(F.col("RID") % 3 == 0).repartition(half), drop, mode="append")
    incremental.stateful_keys(stream, output, progress, "RID", known).awaitTermination()
    keyed = spark.read.schema(incremental.HASH_KEYS).parquet(output)
    return keyed.groupBy("data_hash", "dedup_key").agg(
        F.min("first_ord").alias("first_rid"), F.sum("n_records").alias("n_records"), F.count_if("is_new").alias("times_new"))


@query
def i2_stream_quality(spark, folder):
    drop, output = (scratch_path(spark, n) for n in ("drop", "output"))
    df = contacts(spark, folder)
    df.write.parquet(drop)
    enriched = incremental.enrich_stream(spark.readStream.schema(df.schema).parquet(drop))
    (
        enriched.writeStream.format("parquet").option("path", output)
        .option("checkpointLocation", scratch_path(spark, "progress")).trigger(availableNow=True).start().awaitTermination()
    )
    return spark.read.parquet(output).select("RID", "email_quality_total", "phone_quality_total")


# --- documented features ---------------------------------------------------------------


@query
def k1_clusters(spark, folder):
    rule_set = RuleSet(default_rules())
    clean = standardize.with_data_hash(standardize.standardize(contacts(spark, folder)))
    narrow = materialize(
        matching.match_columns(clean, rule_set, "RID", matching.record_block_key(clean), extra=[F.col("data_hash")]), "narrow"
    )
    labels = clusters.cluster_labels(narrow.drop("data_hash"), rule_set)
    keyed = clusters.cluster_keys(narrow.select("ord", "data_hash"), labels, empty_state(spark))
    return keyed.withColumnRenamed("ord", "RID")


@query
def k1_merge_runs(spark, folder):
    """Stored keys that a later run brings together: the first run knows every fourth record less and links nothing."""
    store = KeyStore(spark, scratch_path(spark, "store"))
    df = contacts(spark, folder)
    outputs = [
        plan.run_with_store(rows, store, scratch_path(spark, name), name, RUN_TIME, order="RID", mode="cluster", rules=rules)
        for name, rows, rules in (("first", df.filter("RID % 4 <> 1"), []), ("second", df, None))
    ]
    first, second = (o.select("RID", "DEDUP_KEY") for o in outputs)
    now = with_current_key(first, store.aliases()).withColumnRenamed("DEDUP_KEY", "first_key_now")
    stored = store.state().hash_key.select("dedup_key").distinct().count()
    return second.withColumnRenamed("DEDUP_KEY", "second_key").join(now, "RID", "left").withColumn("stored_keys", F.lit(stored).cast("bigint"))


def _over_blocks(spark, folder, blocks) -> DataFrame:
    rule_set = RuleSet(default_rules())
    clean = standardize.standardize(contacts(spark, folder))
    narrow = matching.match_columns(clean, rule_set, "RID", blocks[0](clean), extra=matching.block_columns(clean, blocks))
    tables = matching.by_block(materialize(narrow, "narrow"), len(blocks))
    best = matching.named_matches(matching.best_of_blocks([matching.best_match(t, rule_set) for t in tables]), rule_set)
    return best.select(F.col("ord").alias("RID"), F.col("match_ord").alias("match_rid"), "rule_id")


@query
def k2_multi_block(spark, folder):
    return _over_blocks(spark, folder, BLOCKS)


@query
def k2_run(spark, folder):
    """A whole run over several block keys."""
    return _run(spark, folder, blocks=BLOCKS).result.select("RID", "MATCH_REASON", "is_new")


@query
def k2_block_gains(spark, folder):
    """What each further block key adds in comparisons."""
    clean = standardize.standardize(contacts(spark, folder))
    names = [f"key_{i}" for i in range(len(BLOCKS))]
    keyed = materialize(clean.select(*(block(clean).alias(n) for n, block in zip(names, BLOCKS))), "block-keys")
    return reports.block_gains(keyed, names)


@query
def k3_soundex_block(spark, folder):
    return _over_blocks(spark, folder, [blocking.soundex_block])


@query
def k4_levenshtein(spark, folder):
    pairs = _neighbours(spark, folder, ["COMPANY_NAME_STD"])
    score = similarity.levenshtein_similarity(F.col("l_COMPANY_NAME_STD"), F.col("r_COMPANY_NAME_STD"))
    return pairs.select("RID", "other", F.round(score, 6).alias("score"))


@query
def k4_rule_levenshtein(spark, folder):
    """A rule's condition that compares by edits."""
    best = _best(spark, folder, parse_rules(EDIT_RULES))
    return best.select(F.col("ord").alias("RID"), F.col("match_ord").alias("match_rid"), F.round("company_name_score", 6).alias("score"))


@query
def k_engine_version(spark, folder):
    result = _run(spark, folder, engine_version=True).result
    return result.select("RID", "MATCHING_ENGINE_VERSION", "MATCH_TIMESTAMP")


@query
def k5_threshold_fallback(spark, folder):
    rules = parse_rules(THRESHOLD_RULES, FIELD_THRESHOLDS)
    return _best(spark, folder, rules).select(F.col("ord").alias("RID"), F.col("match_ord").alias("match_rid"), "match_reason")


@query
def k6_confidence(spark, folder):
    return _confidence(spark, folder).select(
        "RID", "company_confidence", "address_confidence", "email_confidence", "phone_confidence"
    )


@query
def k7_quality_bands(spark, folder):
    df = plan.with_bands(standardize.with_quality(contacts(spark, folder)))
    return df.select("RID", "email_quality_band", "phone_quality_band")

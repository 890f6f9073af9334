"""Block keys and what they imply for a record."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactlink.functions.keys import field
from contactlink.operators.matching import DIRECT_ROWS, record_block_key
from contactlink.operators.rules import RuleSet
from contactlink.operators.skew import with_followers
from contactlink.operators.storage import materialize


def with_block_key(df: DataFrame) -> DataFrame:
    """Add ``block_key`` to a standardised record."""
    return df.withColumn("block_key", record_block_key(df))


def candidates(df: DataFrame, order: str) -> DataFrame:
    """The candidates of every record, as an interval of its block instead of as pairs.

    A record's candidates are the later rows of its block, so their number, the first
    and the last of them say everything; pairs would grow with the square of the block.
    """
    rows = df.select("block_key", F.col(order).alias("ord"))
    return with_followers(rows, ["block_key"], "ord").select(
        "ord", "block_key",
        F.col("n_later").alias("n_candidates"),
        F.col("next_later").alias("first_candidate"),
        F.col("last_later").alias("last_candidate"),
    )


def plan(records: DataFrame, rules: RuleSet, limit: int = DIRECT_ROWS) -> DataFrame:
    """What each rule has to compare in each block of more than ``limit`` rows, as a written table:
    ``block_key, rule_id, rows, pairs, extra_key, pairs_with_key, pairs_left``.

    ``records`` is the narrow table of matching. ``rows`` may pass the rule by themselves, ``extra_key`` is the field
    that the rule wants equal and that leaves fewest pairs (the first one of the rule if several do, null if the rule
    has none), ``pairs_left`` are those with all such fields, which is what ``matching`` searches. A block whose rules
    still leave many pairs wants a further condition or a finer block key. Only group sizes are made, never pairs.
    """
    able = records.filter(F.col("block_key").isNotNull() & rules.any_eligible())
    large = able.groupBy("block_key").count().filter(F.col("count") > limit).select("block_key")
    rest = materialize(able.join(materialize(large, "large-blocks"), "block_key", "left_semi"), "large-rows")
    fields = {alias: name for (name, _), alias in rules.columns.items()}
    halves = lambda n: (F.sum(n * (n - 1) / 2)).cast("long")
    empty = rest.select("block_key", F.lit("").alias("rule_id"), *(F.lit(0).cast("long").alias(c) for c in ("rows", "pairs")),
                        F.lit("").alias("extra_key"), *(F.lit(0).cast("long").alias(c) for c in ("pairs_with_key", "pairs_left"))).limit(0)
    parts = [empty]
    for rule in rules.rules:
        on = rules.equal_columns(rule)
        groups = rest.filter(rules.eligible(rule)).groupBy("block_key", *on).agg(F.count(F.lit(1)).alias("n"))
        groups = materialize(groups, "plan-groups")
        n = F.col("n")
        whole = groups.groupBy("block_key").agg(F.sum(n).alias("rows"), halves(n).alias("pairs_left"))
        whole = whole.withColumn("pairs", (F.col("rows") * (F.col("rows") - 1) / 2).cast("long"))
        if on:
            each = F.explode(F.array(*(F.struct(F.lit(i).alias("place"), F.col(c).alias("value")) for i, c in enumerate(on))))
            sizes = groups.select("block_key", "n", each.alias("e")).groupBy("block_key", "e").agg(F.sum(n).alias("n"))
            costs = sizes.groupBy("block_key", F.col("e.place").alias("place")).agg(halves(n).alias("cost"))
            best = costs.groupBy("block_key").agg(F.min(F.struct("cost", "place")).alias("best"))
            name = F.element_at(F.array(*(F.lit(fields[c]) for c in on)), F.col("best.place") + 1)
            whole = whole.join(best, "block_key").withColumns({"extra_key": name, "pairs_with_key": F.col("best.cost")}).drop("best")
        else:
            whole = whole.withColumns({"extra_key": F.lit(None).cast("string"), "pairs_with_key": F.col("pairs")})
        parts.append(whole.withColumn("rule_id", F.lit(rule.id)).select(empty.columns))
    return materialize(reduce(DataFrame.unionByName, parts), "block-plan")


def _when_filled(value: Column) -> Column:
    return F.when(value != "", value)


def phone_block(df: DataFrame) -> Column:
    """Whole clean phone number; null, hence no block, without one."""
    return _when_filled(F.col("PHONE_STD"))


def address_block(df: DataFrame) -> Column:
    """Zip and clean address line 1."""
    zip_code = F.substring(F.coalesce(field(df, "ZIP_CODE"), F.lit("")), 1, 5)
    return F.when((zip_code != "") & (F.col("ADDRESS1_STD") != ""), F.concat_ws("_", zip_code, "ADDRESS1_STD"))


def soundex_block(df: DataFrame) -> Column:
    """Sound of the first word of the company, and the zip."""
    word = F.substring_index("COMPANY_NAME_STD", " ", 1)
    zip_code = F.substring(F.coalesce(field(df, "ZIP_CODE"), F.lit("")), 1, 5)
    return F.when(word != "", F.concat_ws("_", F.soundex(word), zip_code))

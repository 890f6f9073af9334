"""Reports over records, blocks and results; all are aggregates with map-side combine."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactlink.functions.quality import EMAIL_POINTS, PHONE_POINTS


def block_sizes(df: DataFrame, key: str = "block_key") -> DataFrame:
    """Rows and comparisons of every block."""
    n = F.count(F.lit(1))
    return df.groupBy(key).agg(n.alias("rows"), (n * (n - 1) / 2).cast("long").alias("pairs"))


def block_gains(df: DataFrame, keys: list[str]) -> DataFrame:
    """``blocking, pairs, compared``: pairs of records that share the key, and those of them that share none of the
    keys before it, which is what adding the blocking costs (see ``matching.by_block``).

    No pair is made: pairs that share a set of keys are counted from group sizes, and sets are added and subtracted by
    inclusion and exclusion. There are 2^n - 1 sets for n blockings, each a narrow aggregate.
    """
    n = F.count(F.lit(1))
    parts = []
    for i, key in enumerate(keys):
        for earlier in (c for k in range(i + 1) for c in combinations(keys[:i], k)):
            both = [key, *earlier]
            sizes = df.dropna(subset=both).groupBy(*both).agg((n * (n - 1) / 2).cast("long").alias("shared"))
            sign = -1 if len(earlier) % 2 else 1
            parts.append(sizes.select(
                F.lit(i).alias("blocking"), (F.lit(0).cast("long") if earlier else F.col("shared")).alias("pairs"), (F.col("shared") * sign).alias("compared")
            ))
    empty = df.sparkSession.createDataFrame([(i, 0, 0) for i in range(len(keys))], "blocking int, pairs long, compared long")
    rows = reduce(DataFrame.unionByName, parts, empty)
    return rows.groupBy("blocking").agg(F.sum("pairs").alias("pairs"), F.sum("compared").alias("compared"))


def run_statistics(result: DataFrame) -> DataFrame:
    """Counts of a run: all records, matched ones, keys minted for unmatched ones, and errors: bad input records, which
    are results marked so."""
    reason = F.col("MATCH_REASON")
    matched = ~reason.isin("NEW", "ERROR")
    return result.agg(
        F.count(F.lit(1)).alias("total_records"),
        F.count_if(matched).alias("matched_existing"),
        F.count_if((reason == "NEW") & F.col("is_new")).alias("new_dedup_keys"),
        F.count_if(reason == "ERROR").alias("errors"),
    )


def reason_counts(result: DataFrame) -> DataFrame:
    return result.groupBy("MATCH_REASON").agg(F.count(F.lit(1)).alias("records"))


def quality_profile(df: DataFrame) -> DataFrame:
    """Per quality column: records with points, lowest, highest and total points."""
    names = [
        *(f"email_quality_{c}" for c in (*EMAIL_POINTS, "total")),
        *(f"phone_quality_{c}" for c in (*PHONE_POINTS, "total")),
    ]
    one_row = df.agg(
        *(
            F.struct(
                F.lit(c).alias("criterion"),
                F.count_if(F.col(c) > 0).alias("records_with_points"),
                F.min(c).alias("min_points"),
                F.max(c).alias("max_points"),
                F.sum(F.col(c).cast("long")).alias("sum_points"),
                F.avg(c).alias("avg_points"),
            ).alias(c)
            for c in names
        )
    )
    return one_row.select(F.explode(F.array(*names)).alias("r")).select("r.*")

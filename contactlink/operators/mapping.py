"""From source headers to the standard vocabulary."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactlink.functions import text
from contactlink.functions.keys import field
from contactlink.sources.catalog import Catalog

# Confidence of an exact, an alternate and a partial hit.
EXACT, ALTERNATE, PARTIAL = 100, 95, 70


def auto_map(headers: DataFrame, catalog: Catalog, header: str = "header") -> DataFrame:
    """``header, standard, confidence`` of the headers that have a match, over any number
    of files.

    The first column in catalog order that is equal to the header or lists it as an
    alternate wins; failing that, the first whose name contains it or is contained in
    it. The catalog is a fixed vocabulary, so it goes into the expression as a literal
    map and array: one projection, no join. Distinct headers are mapped once.
    """
    distinct = headers.select(header).distinct().withColumn("_upper", text.strip(F.upper(F.col(header))))
    name = F.col("_upper")
    known: dict[str, tuple[str, int]] = {}
    for column in catalog.columns:
        known.setdefault(column.name.upper(), (column.name, EXACT))
        for alternate in column.alternates:
            known.setdefault(alternate.upper(), (column.name, ALTERNATE))
    # The empty entries keep the literals typed when the catalog is empty.
    entries = [("", "", 0), *((upper, standard, score) for upper, (standard, score) in known.items())]
    lookup = F.create_map(*(part for e in entries for part in (F.lit(e[0]), _target(*e))))
    partial = F.array(*(_target(c.name.upper(), c.name, PARTIAL) for c in catalog.columns), _target("", "", 0))
    exact = F.filter(F.array(F.try_element_at(lookup, name)), lambda m: m["confidence"] > 0)
    near = F.filter(
        partial, lambda m: (m["confidence"] > 0) & (name.contains(m["upper"]) | m["upper"].contains(name))
    )
    # A generator evaluates the search once; a plain column would be copied into every
    # filter above it.
    return distinct.select(header, F.inline(F.slice(F.concat(exact, near), 1, 1))).drop("upper")


def _target(upper: str, standard: str, score: int) -> Column:
    return F.struct(F.lit(upper).alias("upper"), F.lit(standard).alias("standard"), F.lit(score).alias("confidence"))


def auto_mapping(columns: list[str], catalog: Catalog, spark) -> dict[str, str]:
    """Mapping for the header of one table, in header order."""
    headers = spark.createDataFrame([(c,) for c in columns], "header string")
    found = {r.header: r.standard for r in auto_map(headers, catalog).collect()}
    return {c: found[c] for c in columns if c in found}


def check_names(columns: list[str]) -> None:
    """Headers that differ only by case cannot be told apart by Spark's resolver."""
    seen: dict[str, str] = {}
    for c in columns:
        other = seen.setdefault(c.lower(), c)
        if other != c:
            raise ValueError(f"columns {other!r} and {c!r} differ only by case")


def apply_mapping(df: DataFrame, mapping: Mapping[str, str] | None) -> DataFrame:
    """Rename mapped columns, keep the others.

    Mapped columns come first in mapping order. Where several sources end in one target
    the later one wins, and an unmapped column that has the target's name wins over both.
    """
    if not mapping:
        check_names(df.columns)
        return df
    chosen: dict[str, str] = {}
    for source, target in mapping.items():
        if source in df.columns:
            chosen[target] = source
    for c in df.columns:
        if c not in mapping:
            chosen[c] = c
    check_names(list(chosen))
    return df.select([F.col(f"`{source}`").alias(target) for target, source in chosen.items()])


def required_report(df: DataFrame, catalog: Catalog) -> DataFrame:
    """Per required column: is it there, and how many records leave it blank."""
    names = [c.name for c in catalog.columns if c.required]
    return blank_counts(df, names).withColumnsRenamed({"column_name": "required_column"})


def blank_counts(df: DataFrame, names: list[str]) -> DataFrame:
    """``column_name, present, filled, blank`` in one pass over the table."""
    if not names:
        return df.sparkSession.createDataFrame([], "column_name string, present boolean, filled bigint, blank bigint")
    totals = df.agg(
        F.count(F.lit(1)).alias("n"),
        *(F.count_if(~text.is_blank(field(df, name))).alias(f"f{i}") for i, name in enumerate(names)),
    )

    def row(i: int, name: str) -> Column:
        return F.struct(
            F.lit(name).alias("column_name"),
            F.lit(name in df.columns).alias("present"),
            F.col(f"f{i}").alias("filled"),
            (F.col("n") - F.col(f"f{i}")).alias("blank"),
        )

    return totals.select(F.explode(F.array(*(row(i, n) for i, n in enumerate(names)))).alias("r")).select("r.*")

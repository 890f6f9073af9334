"""Record enrichment: standardised columns, quality columns, data hash, identifier."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame

from contactlink.functions import keys, quality, text
from contactlink.functions.keys import field

STD_COLUMNS = {
    "COMPANY_NAME_STD": ("COMPANY_NAME", text.company_std),
    "ADDRESS1_STD": ("ADDRESS_LINE_1", text.address_std),
    "ADDRESS2_STD": ("ADDRESS_LINE_2", text.address_std),
    "PHONE_STD": ("PHONE_NUMBER", text.phone_std),
    "EMAIL_STD": ("EMAIL_ADDRESS", text.email_std),
}


def standardize(df: DataFrame) -> DataFrame:
    """Add the five ``*_STD`` columns; a missing input column counts as blank."""
    return df.withColumns({name: clean(field(df, source)) for name, (source, clean) in STD_COLUMNS.items()})


def with_quality(df: DataFrame, points: Mapping[str, Mapping[str, int]] | None = None) -> DataFrame:
    """Add email and phone quality columns; ``points`` may override them per criterion."""
    points = points or {}
    return df.withColumns(
        {
            **quality.email_quality(field(df, "EMAIL_ADDRESS"), points.get("email")),
            **quality.phone_quality(field(df, "PHONE_NUMBER"), field(df, "PHONE_EXTENSION"), points.get("phone")),
        }
    )


def quality_points(settings: Mapping) -> dict[str, dict[str, int]]:
    """Points per criterion out of a settings document."""
    out = {}
    for kind, section in (settings.get("quality_scores") or {}).items():
        criteria = section.get("criteria") or {}
        out[kind] = {name: int(c["max_points"]) for name, c in criteria.items() if "max_points" in c}
    return out


def with_data_hash(df: DataFrame) -> DataFrame:
    """Add ``data_hash`` to a standardised record."""
    return df.withColumn(
        "data_hash",
        keys.data_hash(
            field(df, "SOURCE_TYPE"), field(df, "SOURCE_ID"), field(df, "COMPANY_NAME_STD"),
            field(df, "ADDRESS1_STD"), field(df, "PHONE_STD"),
        ),
    )

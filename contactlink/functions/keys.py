"""Keys of a record: block key, data hash, minted dedup key, identifier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactlink.functions import text


def field(df: DataFrame, name: str) -> Column:
    """The column of exactly this name, or '' if the input has none."""
    return F.col(f"`{name}`") if name in df.columns else F.lit("")


def block_key(company_std: Column, zip_code: Column, phone_std: Column) -> Column:
    """First three of the clean company, first five of the zip, last four of the phone."""
    return F.lower(
        F.concat_ws(
            "_",
            F.substring(company_std, 1, 3),
            F.substring(text.or_blank(zip_code), 1, 5),
            F.right(phone_std, F.lit(4)),
        )
    )


def data_hash(source_type: Column, source_id: Column, company_std: Column, address_std: Column, phone_std: Column) -> Column:
    """16 hex digits that are equal for records with the same source and clean content."""
    joined = F.concat_ws(
        "|", F.upper(text.strip(source_type)), text.strip(source_id), company_std, address_std, phone_std
    )
    return F.substring(F.sha2(joined, 256), 1, 16)


def minted_key(hash_column: Column) -> Column:
    """UUID-shaped key derived from the data hash, so a repeated task gives the same key."""
    digest = F.sha2(F.concat(F.lit("dedup-key:"), hash_column), 256)
    part = lambda start, n: F.substring(digest, start, n)
    return F.concat(
        part(1, 8), F.lit("-"), part(9, 4), F.lit("-8"), part(14, 3), F.lit("-a"), part(18, 3), F.lit("-"), part(21, 12)
    )


def identifier(source_type: Column, source_id: Column) -> Column:
    """``SOURCE_TYPE:SOURCE_ID`` exactly as given."""
    return F.concat(text.or_blank(source_type), F.lit(":"), text.or_blank(source_id))

"""The standard vocabulary of contact columns."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from contactlink.operators.rules import load_json


@dataclass(frozen=True)
class CatalogColumn:
    name: str
    label: str = ""
    group: str = "other"
    required: bool = False
    alternates: tuple[str, ...] = ()
    description: str = ""
    data_type: str | None = None
    sequence: int | None = None


@dataclass(frozen=True)
class Catalog:
    """Columns in file order; the order decides ties in auto-mapping."""

    columns: tuple[CatalogColumn, ...]


# The columns of the standard vocabulary, in the order that decides ties: name, label, group, whether
# required, header names that mean it, description, and type and sequence where there are any.
DEFAULT_COLUMNS = (
    CatalogColumn(
        "RECORD_ID", "Record ID", "input-fields", False,
        ("RECID", "RECORDID", "RECORD_ID"),
        "Unique identifier for each record in the dataset", "string",
    ),
    CatalogColumn(
        "SOURCE_TYPE", "Source Type", "input-fields-(source)", True,
        ("SOURCETYPE", "SOURCE_TYPE", "SRC_TYPE", "SRC_TYP_CD"),
        "Data source identifier (e.g., SBA MASTER, SBA BILL TO, SPP MASTER, DNB ACCOUNT, DATA AXLE PLACES, etc. )", "string", 2001,
    ),
    CatalogColumn(
        "SOURCE_ID", "Source ID", "input-fields-(source)", True,
        ("SOURCEID", "SOURCE_ID", "SRC_ID", "SRC_IDENT"),
        "An identifier that represents the specific source from which the data record was obtained. ", "string", 2002,
    ),
    CatalogColumn(
        "COMPANY_NAME", "Company Name", "input-fields", True,
        ("COMPANYNAME", "COMPANY_NAME", "BUSINESS_NAME", "SITE_NAME", "LEGAL_NAME"),
        "Legal or Trading name of the company", "string",
    ),
    CatalogColumn(
        "NAICS_CD", "NAICS Code", "input-fields", False,
        ("NAICSCD", "NAICS_CD", "NAICS_CODE"),
        "NAICS is a classification of business establishments by type of economic activity", "string",
    ),
    CatalogColumn(
        "SIC_CODE", "SIC Code", "input-fields", False,
        ("SICCODE", "SIC_CODE", "SIC"),
        "The Standard Industrial Classification (SIC) is a system for classifying industries by four-digit code, used to standardize industry classification for statistical purposes across agencies.", "string",
    ),
    CatalogColumn(
        "ADDRESS_LINE_1", "Address Line 1", "input-fields-(address)", True,
        ("ADDRESS1", "ADDRESS_1", "ADDRESSLINE1", "ADDRESS_LINE_1", "ADDR_LINE1", "STREET_ADDRESS"),
        "Primary address line (street number and name)", "string",
    ),
    CatalogColumn(
        "ADDRESS_LINE_2", "Address Line 2", "input-fields-(address)", False,
        ("ADDRESS2", "ADDRESS_2", "ADDRESSLINE2", "ADDRESS_LINE_2", "ADDR_LINE2", "STREET_ADDRESS_2"),
        "Secondary address line (suite, apt, floor, etc.)", "string",
    ),
    CatalogColumn(
        "CITY", "City Name", "input-fields-(address)", False,
        ("CITY", "CITY_NAME", "TOWN", "MUNICIPALITY"),
        "City name", "string",
    ),
    CatalogColumn(
        "STATE", "State Code", "input-fields-(address)", False,
        ("STATE", "PROVINCE", "STATE_CODE", "PROV_CODE", "STATE_CD"),
        "State or Province Code", "string",
    ),
    CatalogColumn(
        "ZIP_CODE", "Zip Code", "input-fields-(address)", True,
        ("ZIP_SUPP", "ZIP5", "ZIP", "ZIPCODE", "ZIP_CODE", "POSTAL_CODE", "POSTCODE"),
        "Postal or zip code", "string",
    ),
    CatalogColumn(
        "ZIP4", "Zip Code Supp.", "input-fields-(address)", False,
        ("ZIP4", "ZIP_4", "ZIP4_CODE", "ZIP_4_CODE", "POSTAL_CODE_4", "SUPPLEMENT_ZIP_CODE", "POSTCODE_4"),
        "Postal or zip code Supplement", "string",
    ),
    CatalogColumn(
        "COUNTRY_CODE", "Country Code", "input-fields-(address)", False,
        ("COUNTRY", "COUNTRY_CODE", "COUNTRY_CD", "NATION_CODE"),
        "Standardized code (ISO country codes) that represents the country associated with the record. ", "string",
    ),
    CatalogColumn(
        "ADDRESS_VALID_IND", "Address Valid Indicator", "input-fields-(address)", False,
        ("ADDRESSVALIDIND", "ADDRESS_VALID_IND", "ADDR_VALID_IND"),
        "Indicates whether the address has been validated",
    ),
    CatalogColumn(
        "ADDRESS_LOCATION_TYPE", "Address Location Type", "input-fields-(address)", False,
        ("ADDRESSLOCATIONTYPE", "ADDRESS_LOCATION_TYPE", "ADDR_LOCATION_TYPE", "ADDR_LOC_TYPE"),
        "Type of address location (e.g., residential, commercial, PO Box)",
    ),
    CatalogColumn(
        "ADDRESS_MARKETABLE_IND", "Address Marketable Indicator", "input-fields-(address)", False,
        ("ADDRESSMARKETABLEIND", "ADDRESS_MARKETABLE_IND", "ADDR_MARKETABLE_IND"),
        "Indicates whether the address is suitable for marketing purposes",
    ),
    CatalogColumn(
        "ADDRESS_FAULT_CODE", "Address Fault Code", "input-fields-(address)", False,
        ("ADDRESSFAULTCODE", "ADDRESS_FAULT_CODE", "ADDR_FAULT_CODE"),
        "Code indicating address quality or validation issues",
    ),
    CatalogColumn(
        "RESIDENTIAL_DELIVERY_IND", "Residential Delivery Indicator", "input-fields-(address)", False,
        ("RESIDENTIALDELIVERYIND", "RESIDENTIAL_DELIVERY_IND", "RES_DELIV_IND"),
        "Indicates whether the address is a residential delivery location",
    ),
    CatalogColumn(
        "EMAIL_ADDRESS", "Email Address", "input-fields-(email)", False,
        ("EMAILADDRESS", "EMAIL_ADDRESS", "EMAIL", "EMAILADDR", "E_MAIL"),
        "Email Address",
    ),
    CatalogColumn(
        "EMAIL_MARKETABLE_IND", "Email Marketable Indicator", "input-fields-(email)", False,
        ("EMAILMARKETABLEIND", "EMAIL_MARKETABLE_IND", "EMAIL_MKTABLE_IND"),
        "Indicates whether the email is suitable for marketing purposes",
    ),
    CatalogColumn(
        "EMAIL_UPDATE_DT", "Email Update Date", "input-fields-(email)", False,
        ("EMAILUPDATEDT", "EMAIL_UPDATE_DT", "EMAIL_UPD_DT"),
        "Indicates when the email address information was last updated",
    ),
    CatalogColumn(
        "PHONE_NUMBER", "Phone Number", "input-fields-(phone)", True,
        ("PHONENUMBER", "PHONE_NUMBER", "PHONE", "TEL_NUMBER", "TELEPHONE_NUMBER"),
        "Primary phone number associated with the record",
    ),
    CatalogColumn(
        "PHONE_TYPE", "Phone Type", "input-fields-(phone)", False,
        ("PHONETYPE", "PHONE_TYPE", "TEL_TYPE", "PHONE_TYP_CD"),
        "Type of phone number (e.g., mobile, landline, toll-free)",
    ),
    CatalogColumn(
        "PHONE_EXTENSION", "Phone Extension", "input-fields-(phone)", False,
        ("PHONEEXTENSION", "PHONE_EXTENSION", "TEL_EXTENSION", "PHONE_EXT", "EXTENSION"),
        "Phone extension number (separate from main phone number)",
    ),
    CatalogColumn(
        "PHONE_VALID_IND", "Phone Valid Indicator", "input-fields-(phone)", False,
        ("PHONEVALIDIND", "PHONE_VALID_IND", "TEL_VALID_IND", "PHONE_IS_VALID"),
        "Indicates whether the phone number is valid",
    ),
    CatalogColumn(
        "PHONE_MARKETABLE_IND", "Phone Marketable Indicator", "input-fields-(phone)", False,
        ("PHONEMARKETABLEIND", "PHONE_MARKETABLE_IND", "TEL_MARKETABLE_IND"),
        "Indicates whether the phone number is suitable for marketing purposes.",
    ),
    CatalogColumn(
        "PHONE_UPDATE_DT", "Phone Update Date", "input-fields-(phone)", False,
        ("PHONEUPDATEDT", "PHONE_UPDATE_DT", "TEL_UPDATE_DT"),
        "Indicates when the phone number information was last updated.",
    ),
    CatalogColumn(
        "ADDRESS_UPDATE_DT", "Address Update Date", "input-fields-(address)", False,
        ("ADDRESSUPDATEDT", "ADDRESS_UPDATE_DT", "ADDR_UPDATE_DT"),
        "Indicates when the mailing address information was last updated.",
    ),
    CatalogColumn(
        "DEDUP_KEY", "Deduplication Key", "matching-results", False,
        ("DEDUPKEY", "DEDUP_KEY", "DUPLICATE_KEY"),
        "A unique key generated to identify and eliminate duplicate records within the dataset.",
    ),
    CatalogColumn(
        "COMPANY_CONFIDENCE", "Company Confidence", "confidence-scores", False,
        ("COMPANY_CONFIDENCE", "COMPANYCONFIDENCE", "COMPANY_CONF"),
        "Match confidence for company name (0-100)",
    ),
    CatalogColumn(
        "ADDRESS_CONFIDENCE", "Address Confidence", "confidence-scores", False,
        ("ADDRESS_CONFIDENCE", "ADDRESSCONFIDENCE", "ADDR_CONF"),
        "Match confidence for address (0-100)",
    ),
    CatalogColumn(
        "EMAIL_CONFIDENCE", "Email Confidence", "confidence-scores", False,
        ("EMAIL_CONFIDENCE", "EMAILCONFIDENCE", "EMAIL_CONF"),
        "Match confidence for email based on quality (0-100)",
    ),
    CatalogColumn(
        "PHONE_CONFIDENCE", "Phone Confidence", "confidence-scores", False,
        ("PHONE_CONFIDENCE", "PHONECONFIDENCE", "PHONE_CONF"),
        "Match confidence for phone based on quality (0-100)",
    ),
    CatalogColumn(
        "COMPANY_NAME_SCORE", "Company Name Similarity Score", "similarity-scores", False,
        ("COMPANYNAMESCORE", "COMPANY_NAME_SCORE", "NAME_SCORE"),
        "A numerical score representing the similarity between company names during the matching process.",
    ),
    CatalogColumn(
        "ADDRESS_1_SCORE", "Address Line 1 Similarity Score", "similarity-scores", False,
        ("ADDRESS1SCORE", "ADDRESS_1_SCORE", "ADDR_LINE1_SCORE"),
        "A numerical score representing the similarity between primary address lines during the matching process.",
    ),
    CatalogColumn(
        "ADDRESS_2_SCORE", "Address Line 2 Similarity Score", "similarity-scores", False,
        ("ADDRESS2SCORE", "ADDRESS_2_SCORE", "ADDR_LINE2_SCORE"),
        "A numerical score representing the similarity between secondary address lines during the matching process.",
    ),
    CatalogColumn(
        "COMPANY_NAME_STD", "Company Name", "standardized-fields", False,
        ("COMPANY_NAME_STD", "COMPANYNAMESTD", "STD_COMPANY_NAME"),
        "Standardized company name (suffixes removed, normalized)",
    ),
    CatalogColumn(
        "ADDRESS1_STD", "Address1", "standardized-fields", False,
        ("ADDRESS1_STD", "ADDRESSLINE1STD", "STD_ADDRESS1"),
        "Standardized address line 1 (abbreviations normalized)",
    ),
    CatalogColumn(
        "ADDRESS2_STD", "Address2", "standardized-fields", False,
        ("ADDRESS2_STD", "ADDRESSLINE2STD", "STD_ADDRESS2"),
        "Standardized address line 2 (abbreviations normalized)",
    ),
    CatalogColumn(
        "PHONE_STD", "Phone", "standardized-fields", False,
        ("PHONE_STD", "PHONESTD", "STD_PHONE"),
        "Standardized phone number (formatted as (XXX) XXX-XXXX)",
    ),
    CatalogColumn(
        "PHONE_EXTENSION_STD", "Phone Extension", "standardized-fields", False,
        ("PHONE_EXTENSION_STD", "PHONE_EXT_STD", "STD_PHONE_EXT", "EXTENSION_STD"),
        "Phone extension extracted from phone number during standardization. Contains only digits.",
    ),
)

# Result columns offered besides the catalog, all in one group.
RESULT_GROUP = "matching-results"
RESULT_COLUMNS = ("DEDUP_KEY", "MATCH_REASON", "MATCH_TIMESTAMP", "MATCHED_RECORD_IDS")


def default_catalog() -> Catalog:
    return Catalog(DEFAULT_COLUMNS)


def parse_catalog(document: Mapping[str, Mapping[str, Any]]) -> Catalog:
    """Catalog out of a ``{name: {...}}`` document."""
    return Catalog(
        tuple(
            CatalogColumn(
                name,
                meta.get("display_label") or "",
                meta.get("group") or "other",
                bool(meta.get("required", False)),
                tuple(meta.get("alternate_columns", [])),
                meta.get("description") or "",
                meta.get("data_type"),
                meta.get("sequence"),
            )
            for name, meta in document.items()
        )
    )


def load_catalog(spark: SparkSession, path: str) -> Catalog:
    return parse_catalog(load_json(spark, path) or {})


def catalog_table(spark: SparkSession, catalog: Catalog) -> DataFrame:
    """The catalog as a small table, ``position`` being the file order."""
    rows = [
        (c.name, c.label, c.description, c.group, c.required, c.data_type, c.sequence, list(c.alternates), i)
        for i, c in enumerate(catalog.columns)
    ]
    return spark.createDataFrame(
        rows,
        "name string, display_label string, description string, `group` string, required boolean, "
        "data_type string, sequence int, alternate_columns array<string>, position int",
    )


def column_config_table(spark: SparkSession, path: str) -> DataFrame:
    """Output column configuration: groups of entries, one row per entry."""
    document = load_json(spark, path) or {}
    rows = [
        (section, e.get("column_name"), bool(e.get("default_selected", False)), e.get("sequence"),
         e.get("display_label"), e.get("description"), e.get("group"))
        for section, entries in document.items()
        for e in entries
    ]
    return spark.createDataFrame(
        rows,
        "section string, column_name string, default_selected boolean, sequence int, display_label string, "
        "description string, `group` string",
    )


def default_output_columns(catalog: Catalog) -> list[str]:
    """Required columns and the result group, by group and then name."""
    chosen = {(c.group, c.name) for c in catalog.columns if c.required or c.group == RESULT_GROUP}
    chosen |= {(RESULT_GROUP, name) for name in RESULT_COLUMNS}
    return [name for _, name in sorted(chosen, key=_place)]


def all_output_columns(catalog: Catalog) -> list[str]:
    """Every catalog and result column, by group and then name."""
    chosen = {(c.group, c.name) for c in catalog.columns} | {(RESULT_GROUP, name) for name in RESULT_COLUMNS}
    return [name for _, name in sorted(chosen, key=_place)]


def _place(entry: tuple[str, str]) -> tuple[str, str]:
    """Sort key of (group, name): _ comes before digits and letters, as in a dictionary."""
    return entry[0], entry[1].replace("_", " ")


def search_hits(term: Column, catalog: Catalog, group: str | None = None) -> Column:
    """Names of the catalog columns whose name, label or description contains the term,
    by group and then name."""
    entries = sorted((c for c in catalog.columns if group in (None, "", c.group)), key=lambda c: _place((c.group, c.name)))
    if not entries:
        return F.array().cast("array<string>")
    table = F.array(
        *(
            F.struct(F.lit(c.name).alias("name"), F.lit(f"{c.name} {c.label} {c.description}".lower()).alias("text"))
            for c in entries
        )
    )
    return F.filter(table, lambda e: e["text"].contains(F.lower(term))).getField("name")


def search(spark: SparkSession, catalog: Catalog, term: str = "", group: str | None = None) -> DataFrame:
    """Catalog rows that contain the term, optionally of one group, by group and name."""
    table = catalog_table(spark, catalog)
    searchable = F.lower(F.concat_ws(" ", "name", "display_label", "description"))
    if term:
        table = table.filter(searchable.contains(term.lower()))
    if group:
        table = table.filter(F.col("group") == group)
    return table.orderBy("group", F.translate("name", "_", " "))


def groups(spark: SparkSession, catalog: Catalog) -> DataFrame:
    """Columns by group."""
    table = catalog_table(spark, catalog)
    return table.groupBy("group").agg(F.sort_array(F.collect_list("name")).alias("columns")).orderBy("group")

"""Quality points for emails and phones, their bands, and match confidence."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

from contactlink.functions import text

# Lists and points of the quality criteria.
PERSONAL_DOMAINS = (
    "gmail.com", "yahoo.com", "hotmail.com", "outlook.com", "aol.com", "icloud.com", "mail.com",
    "protonmail.com", "zoho.com", "yandex.com", "live.com", "msn.com", "comcast.net", "att.net",
    "verizon.net",
)
GENERIC_MAILBOXES = (
    "info", "contact", "sales", "support", "admin", "help", "service", "webmaster", "postmaster", "noreply",
    "no-reply", "hello", "enquiries",
)
ADMIN_MAILBOXES = (
    "admin", "support", "help", "helpdesk", "service",
)
DEPARTMENT_MAILBOXES = (
    "hr", "finance", "marketing", "legal", "accounting", "billing", "operations", "engineering", "it", "tech",
    "development",
)
TOLL_FREE_CODES = (
    "800", "888", "877", "866", "855", "844", "833",
)
EMAIL_PATTERN = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"
EMAIL_POINTS = {
    "valid_format": 20,
    "non_personal": 20,
    "non_generic": 20,
    "non_admin": 20,
    "non_department": 20,
}
PHONE_POINTS = {
    "has_10_digits": 11,
    "not_all_same": 11,
    "valid_area_code": 11,
    "valid_exchange": 11,
    "valid_line_number": 11,
    "not_toll_free": 12,
    "not_main_line": 11,
    "has_extension": 11,
    "high_quality": 11,
}
NO_EXTENSION_POINTS = 5  # direct line without an extension

# Upper ends of the bands of the two totals.
EMAIL_BANDS = [(25, "Invalid"), (50, "Generic"), (75, "Personal"), (100, "Business")]
PHONE_BANDS = [(5, "Invalid"), (30, "Toll-free"), (50, "Low area"), (70, "Main line"), (100, "High quality")]

# Weights of the confidence sums.
ADDRESS_WEIGHTS = {"address1": 0.4, "address2": 0.1, "city": 0.2, "state": 0.15, "zip_code": 0.15}
OVERALL_WEIGHTS = {"company_name": 0.35, "address1": 0.25, "email": 0.20, "phone": 0.20}


def _points(flags: Mapping[str, Column], valid: Column, prefix: str) -> dict[str, Column]:
    """One integer column per criterion, 0 throughout if not valid, and their total."""
    scored = {name: F.when(valid, value).otherwise(0).cast("int") for name, value in flags.items()}
    return {
        f"{prefix}_total": reduce(add, scored.values()).cast("int"),
        **{f"{prefix}_{name}": value for name, value in scored.items()},
    }


def email_quality(email: Column, points: Mapping[str, int] | None = None) -> dict[str, Column]:
    """Columns ``email_quality_<criterion>`` and ``email_quality_total``."""
    points = {**EMAIL_POINTS, **(points or {})}
    clean = text.email_std(email)
    mailbox = F.substring_index(clean, "@", 1)
    domain = F.substring_index(clean, "@", -1)
    holds = {
        "valid_format": F.lit(True),
        "non_personal": ~domain.isin(*PERSONAL_DOMAINS),
        "non_generic": ~mailbox.isin(*GENERIC_MAILBOXES),
        "non_admin": ~mailbox.isin(*ADMIN_MAILBOXES),
        "non_department": ~mailbox.isin(*DEPARTMENT_MAILBOXES),
    }
    flags = {name: F.when(test, points[name]).otherwise(0) for name, test in holds.items()}
    return _points(flags, clean.rlike(EMAIL_PATTERN), "email_quality")


def list_flags(email: Column, phone: Column) -> dict[str, Column]:
    """Which of the reference lists an email and a phone are on.

    The lists are fixed and short, so they are literals of the expression and need no join.
    """
    clean = text.email_std(email)
    mailbox = F.substring_index(clean, "@", 1)
    return {
        "personal_domain": F.substring_index(clean, "@", -1).isin(*PERSONAL_DOMAINS),
        "generic_mailbox": mailbox.isin(*GENERIC_MAILBOXES),
        "admin_mailbox": mailbox.isin(*ADMIN_MAILBOXES),
        "department_mailbox": mailbox.isin(*DEPARTMENT_MAILBOXES),
        "toll_free": F.substring(text.phone_std(phone), 1, 3).isin(*TOLL_FREE_CODES),
    }


def phone_quality(phone: Column, extension: Column, points: Mapping[str, int] | None = None) -> dict[str, Column]:
    """Columns ``phone_quality_<criterion>`` and ``phone_quality_total``."""
    points = {**PHONE_POINTS, **(points or {})}
    digits = text.phone_std(phone)
    area, line = F.substring(digits, 1, 3), F.substring(digits, 7, 4)
    main_line = line.endswith("000")
    holds = {
        "has_10_digits": F.lit(True),
        "not_all_same": ~digits.rlike(r"^(.)\1*$"),
        "valid_area_code": ~F.substring(digits, 1, 1).isin("0", "1"),
        "valid_exchange": ~F.substring(digits, 4, 1).isin("0", "1"),
        "valid_line_number": line != "0000",
        "not_toll_free": ~area.isin(*TOLL_FREE_CODES),
        "not_main_line": ~main_line,
        "high_quality": ~(digits.isin("0123456789", "9876543210") | digits.rlike(r"(.)\1{3}")),
    }
    flags = {}
    for name in PHONE_POINTS:
        if name == "has_extension":
            flags[name] = (
                F.when(~text.is_blank(extension), points[name]).when(~main_line, NO_EXTENSION_POINTS).otherwise(0)
            )
        else:
            flags[name] = F.when(holds[name], points[name]).otherwise(0)
    return _points(flags, F.length(digits) == 10, "phone_quality")


def band(total: Column, bands: list[tuple[int, str]]) -> Column:
    """Name of the band that holds the total."""
    out = F.lit(None).cast("string")
    for top, name in reversed(bands):
        out = F.when(total <= top, name).otherwise(out)
    return out


def address_confidence(scores: Mapping[str, Column]) -> Column:
    """Weighted sum of ``address1, address2, city, state, zip_code`` scores, missing = 0."""
    return F.round(_weighted(scores, ADDRESS_WEIGHTS), 2)


def overall_confidence(scores: Mapping[str, Column]) -> Column:
    """Weighted sum of ``company_name, address1, email, phone`` scores, missing = 0."""
    return F.round(_weighted(scores, OVERALL_WEIGHTS), 2)


def _weighted(scores: Mapping[str, Column], weights: Mapping[str, float]) -> Column:
    parts = [F.coalesce(scores[k], F.lit(0.0)) * w for k, w in weights.items() if k in scores]
    return reduce(add, parts, F.lit(0.0))

"""Cleaning of names, addresses, phones and emails as native column expressions.

Every function takes a Column and returns a never-null string Column; blank input
gives ''. The expressions stay in the JVM and inside whole-stage codegen: no
higher-order functions, no Python.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The Unicode white space that counts as blank, as a regex class body.
SPACE = (
    r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)

# The same characters as text, for trimming.
SPACE_CHARACTERS = "".join(
    map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
              0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
)

# Words dropped from company names wherever they stand.
COMPANY_NOISE = (
    "inc", "incorporated", "corp", "corporation", "llc", "ltd", "limited", "co", "company", "plc", "lp",
    "llp", "pllc", "pc", "pa", "na", "the", "a", "an",
)

# Address words and their short forms.
ADDRESS_SHORT = {
    "street": "st",
    "avenue": "ave",
    "road": "rd",
    "boulevard": "blvd",
    "drive": "dr",
    "lane": "ln",
    "court": "ct",
    "place": "pl",
    "suite": "ste",
    "apartment": "apt",
    "building": "bldg",
    "floor": "fl",
    "north": "n",
    "south": "s",
    "east": "e",
    "west": "w",
}


def or_blank(value: Column) -> Column:
    """The value as text, '' for null."""
    return F.coalesce(value.cast("string"), F.lit(""))


def strip(value: Column) -> Column:
    """Remove Unicode white space at both ends (``trim`` removes spaces only)."""
    return F.btrim(or_blank(value), F.lit(SPACE_CHARACTERS))


def is_blank(value: Column) -> Column:
    """True for null, '' and white space only."""
    return ~or_blank(value).rlike(f"[^{SPACE}]")


def normalize_text(value: Column) -> Column:
    """Lower case; every run of characters that are not letters, digits or _ is one space."""
    return F.trim(F.regexp_replace(F.lower(or_blank(value)), r"[^\p{L}\p{N}_]+", " "))


def company_std(value: Column) -> Column:
    """Normalised text without legal forms and articles."""
    noise = "|".join(COMPANY_NOISE)
    return F.trim(
        F.regexp_replace(normalize_text(value), f"(?<![^ ])(?:{noise})(?: |\\z)", "")
    )


def _kept_letters(word: str, short: str) -> str:
    """The word as a pattern whose groups are the letters that its short form keeps, in order."""
    out, left = "", short
    for char in word:
        keep = left.startswith(char)
        out, left = out + (f"({char})" if keep else char), left[keep:]
    if left:
        raise ValueError(f"{short!r} is not {word!r} with letters left out")
    return out.replace(")(", "")


def address_std(value: Column) -> Column:
    """Normalised text with street and direction words shortened."""
    # One replacement for all words: generated code of one for each is longer than what the JVM compiles.
    words = "|".join(_kept_letters(word, short) for word, short in ADDRESS_SHORT.items())
    kept = "".join(f"${i}" for i in range(1, words.count("(") + 1))
    return F.regexp_replace(normalize_text(value), f"(?<![^ ])(?:{words})(?![^ ])", kept)


def phone_std(value: Column) -> Column:
    """Digits only (any script); an eleven-digit number loses its leading 1."""
    # One expression inside the other, so none is evaluated twice.
    return F.regexp_replace(F.regexp_replace(or_blank(value), r"[^\p{Nd}]+", ""), r"^1(?=.{10}\z)", "")


def email_std(value: Column) -> Column:
    """Lower case, no surrounding white space."""
    return strip(F.lower(or_blank(value)))


def token_sort(value: Column) -> Column:
    """Tokens in sorted order, one space between them."""
    return sorted_words(F.regexp_replace(strip(value), f"[{SPACE}]+", " "))


def sorted_words(value: Column) -> Column:
    """Words in sorted order, of text that has single spaces only."""
    return F.array_join(F.sort_array(F.split(value, " ")), " ")

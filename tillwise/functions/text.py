"""Text predicates, tolerant comparisons and parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Mail domain and accepted character patterns.
MAIL_DOMAIN = "@retail_stats.com"
WORD_PATTERN = r"^[a-zA-Z0-9_]+$"
PHONE_PATTERN = r"^[\d\s\-\(\)\+]+$"
DIGITS_PATTERN = r"^[0-9]+$"
DATE_PATTERN = r"^\d{4}-\d{1,2}-\d{1,2}$"


def contact_email(username: Column) -> Column:
    """Mail address of a user; NULL for a NULL name."""
    return F.concat(username, F.lit(MAIL_DOMAIN))


def is_word(text: Column) -> Column:
    return text.rlike(WORD_PATTERN)


def is_phone(text: Column) -> Column:
    return text.rlike(PHONE_PATTERN)


def is_digits(text: Column) -> Column:
    return text.rlike(DIGITS_PATTERN)


def same_text(left: Column, right: Column, collation: str | None = None) -> Column:
    """Text equality, optionally under a collation such as ``UTF8_LCASE`` or ``UNICODE_CI_AI``."""
    if collation is None:
        return left == right
    return F.collate(left, collation) == F.collate(right, collation)


def as_number(text: Column, leading_digits: bool = False) -> Column:
    """Text id as a number; NULL when it is not one.

    ``leading_digits`` reads a number at the start of the text and 0 when there is none.
    """
    if leading_digits:
        digits = F.regexp_extract(text, r"^\s*(\d+)", 1)
        return F.when(text.isNotNull(), F.coalesce(digits.try_cast("bigint"), F.lit(0)))
    return text.try_cast("bigint")


def same_number(text: Column, number: Column) -> Column:
    """Compare a text id with a number as numbers."""
    return as_number(text) == number


def strict_date(text: Column) -> Column:
    """``year-month-day`` with a four-digit year; NULL for any other text or an impossible day."""
    return F.when(text.rlike(DATE_PATTERN), F.try_to_date(text, "yyyy-M-d"))

"""Salted SHA-256 digests of a text column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Salt alphabet (printable ASCII) and lengths.
FIRST_CODE = 32
ALPHABET_SIZE = 95
SALT_LENGTH = 8
MAX_SALT_LENGTH = 20


def salt(identity: Column, salt_key: str, num_chars: int = SALT_LENGTH) -> Column:
    """Up to 20 printable characters derived from ``identity`` and a secret key.

    A random salt would differ between task retries and reruns, so characters come from
    a keyed SHA-256: each takes two hex digits of it.
    """
    keyed = F.sha2(F.concat(F.lit(salt_key), identity), 256)
    return F.concat(*[_salt_char(keyed, i) for i in range(min(num_chars, MAX_SALT_LENGTH))])


def _salt_char(keyed: Column, position: int) -> Column:
    code = F.conv(F.substring(keyed, 2 * position + 1, 2), 16, 10).cast("int")
    return F.char(code % ALPHABET_SIZE + FIRST_CODE)


def salted_digest(salt_value: Column, secret: Column) -> Column:
    """Hex SHA-256 of salt and secret; NULL when either is NULL."""
    return F.sha2(F.concat(salt_value, secret), 256)


def digest_bytes(hex_digest: Column) -> Column:
    """The digest as stored: 32 raw bytes."""
    return F.unhex(hex_digest)

"""Identifier rules and discriminators."""

from __future__ import annotations

import hashlib
import string

from pyspark.sql import Column
from pyspark.sql import functions as F

# Hash prefixes that the wire format prescribes.
INSTRUCTION_PREFIX = "global:"
ACCOUNT_PREFIX = "account:"
DISCRIMINATOR_BYTES = 8


def _ascii_lower(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def sanitize(c: Column) -> Column:
    """ASCII-lower the name; everything that is no letter, digit or ``_`` becomes ``_``."""
    return F.regexp_replace(_ascii_lower(c), r"[^\p{IsAlphabetic}\p{N}_]", "_")


def sanitize_name(name: str) -> str:
    """:func:`sanitize` for one name on the driver."""
    lowered = name.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))
    return "".join(c if c.isalnum() or c == "_" else "_" for c in lowered)


def snake_case(c: Column) -> Column:
    """``_`` before every capital but the first character, then ASCII lower case."""
    return _ascii_lower(F.regexp_replace(c, r"(?<!^)(\p{IsUppercase})", "_$1"))


def _hash_prefix(preimage: Column) -> Column:
    return F.unhex(F.substring(F.sha2(preimage, 256), 1, 2 * DISCRIMINATOR_BYTES))


def instruction_discriminator(name: Column) -> Column:
    return _hash_prefix(F.concat(F.lit(INSTRUCTION_PREFIX), snake_case(name)))


def account_discriminator(name: Column) -> Column:
    return _hash_prefix(F.concat(F.lit(ACCOUNT_PREFIX), name))


def _snake_name(name: str) -> str:
    spaced = "".join("_" + c if i and c.isupper() else c for i, c in enumerate(name))
    return spaced.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))


def discriminator_of(kind: str, name: str) -> bytes:
    """The computed discriminator of one definition, for plans built on the driver."""
    preimage = INSTRUCTION_PREFIX + _snake_name(name) if kind == "instruction" else ACCOUNT_PREFIX + name
    return hashlib.sha256(preimage.encode()).digest()[:DISCRIMINATOR_BYTES]

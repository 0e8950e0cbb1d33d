"""One portable hash for counting and routing, equal on every engine that has MD5."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F


def remainder_col(key: Column, modulus: int) -> Column:
    """The first 32 bits of the MD5 of key as text, modulo `modulus`. Null stays null."""
    return (F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, 8), 16, 10).cast("long") % modulus).cast("int")


def remainder(key: object, modulus: int) -> int | None:
    return None if key is None else int(hashlib.md5(str(key).encode()).hexdigest()[:8], 16) % modulus

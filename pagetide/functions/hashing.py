"""Content hashes, SimHash bits and Hamming distance."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN_BREAK = r"[^\p{L}\p{N}_]+"


def sha256_hex(text: Column) -> Column:
    return F.sha2(text, 256)


def portable_hash64(token: Column) -> Column:
    """First 64 bits of SHA-256 as a signed long: the same in every engine."""
    digest = F.sha2(token, 256)
    high = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")
    low = F.conv(F.substring(digest, 9, 8), 16, 10).cast("bigint")
    return F.shiftleft(high, 32).bitwiseOR(low)


def fast_hash64(token: Column) -> Column:
    """xxHash64: stable too, several times cheaper, but Spark-only."""
    return F.xxhash64(token)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def similar(a: Column, b: Column, threshold: int = 5) -> Column:
    return hamming(a, b) <= threshold


def to_unsigned(signature: Column) -> Column:
    """Signed long to the unsigned number 0 .. 2^64-1, for export."""
    wide = signature.cast("decimal(20,0)")
    return F.when(signature < 0, wide + F.lit("18446744073709551616").cast("decimal(20,0)")).otherwise(wide).cast("decimal(20,0)")


def from_unsigned(number: Column) -> Column:
    """Inverse of `to_unsigned`."""
    wide = number.cast("decimal(21,0)")
    over = wide >= F.lit("9223372036854775808").cast("decimal(20,0)")
    return F.when(over, wide - F.lit("18446744073709551616").cast("decimal(20,0)")).otherwise(wide).cast("bigint")

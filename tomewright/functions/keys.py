"""Composite keys and key tests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_key(name: Column, field: Column) -> Column:
    return F.concat(F.lit("H:"), name, F.lit(":"), field)


def document_key(doc_id: Column) -> Column:
    return F.concat(F.lit("doc:"), doc_id.cast("string"))


def chunk_key(term: Column, chunk: Column) -> Column:
    return F.concat(F.lit("term:"), term, F.lit(":chunk:"), chunk.cast("string"))


def term_meta_key(term: Column) -> Column:
    return F.concat(F.lit("term_meta:"), term)


def has_prefix(key: Column, prefix: str) -> Column:
    return key.startswith(prefix)


def in_range(key: Column, start: str, end: str) -> Column:
    """Both ends included, in byte order."""
    return key.between(start, end)


def big_endian(value: Column, digits: int = 16) -> Column:
    """Hexadecimal text of a value of 0 or more, most significant digit first."""
    return F.lpad(F.hex(value), digits, "0")


def little_endian(value: Column, size: int) -> Column:
    """The last `size` bytes of a value, least significant first."""
    digits = F.lpad(F.hex(value.cast("bigint")), 16, "0")
    return F.unhex(F.concat(*[F.substring(digits, 15 - 2 * i, 2) for i in range(size)]))


def from_big_endian(digits: Column) -> Column:
    """Value of 0 or more of hexadecimal digits, most significant first."""
    return F.conv(digits, 16, 10).cast("bigint")


def from_little_endian(raw: Column, size: int) -> Column:
    """Value of 0 or more of the first `size` bytes, least significant first."""
    digits = F.hex(F.substring(raw, 1, size))
    return from_big_endian(F.concat(*[F.substring(digits, 2 * i - 1, 2) for i in range(size, 0, -1)]))

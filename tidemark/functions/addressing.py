"""Deterministic draws from addresses: every random number is a function of what it is for."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def key_from_address(address: Column) -> Column:
    """The first 16 hexadecimal digits of the address's SHA-256."""
    return F.substring(F.sha2(address.cast("binary"), 256), 1, 16)


def draw_address(key: Column, role: Column, index: Column, draw: Column) -> Column:
    """The JSON text that names one draw. Its tag is a fixed value: other draws would follow from another."""
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    return F.concat(F.lit('["DT-P9-DRAW-v1",'), quoted(key), F.lit(","), quoted(role), F.lit(","), index.cast("string"), F.lit(","), draw.cast("string"), F.lit("]"))


def top_53_bits(address: Column) -> Column:
    """The leading 53 bits of the address's SHA-256 as a long."""
    return F.shiftrightunsigned(F.conv(key_from_address(address), 16, -10).cast("long"), 11)


def open_uniform(bits: Column) -> Column:
    """A number in (0, 1) from 53 bits."""
    return F.least((bits.cast("double") + 0.5) / F.lit(float(1 << 53)), F.lit(1 - 2.0**-53))


def uniform_at(key: Column, role: Column, index: Column, draw: Column) -> Column:
    return open_uniform(top_53_bits(draw_address(key, role, index, draw)))


def bounded_index(address: Column, n: Column) -> Column:
    """An index in 0..n-1: the address's 53 bits modulo n."""
    return F.pmod(top_53_bits(address), n.cast("long"))


def uniform_index(u: Column, n: Column) -> Column:
    """An index in 0..n-1 from a uniform number: floor(u n)."""
    return F.floor(u * n).cast("long")


def chosen(values: Column, u: Column) -> Column:
    """The element of an array that a uniform number picks; null for an empty array."""
    return F.try_element_at(values, (uniform_index(u, F.size(values)) + 1).cast("int"))


def seed_32(address: Column) -> Column:
    """An unsigned 32-bit seed: the first 8 hexadecimal digits of the address's SHA-256."""
    return F.conv(F.substring(F.sha2(address.cast("binary"), 256), 1, 8), 16, 10).cast("long")


def seed_64(address: Column) -> Column:
    """An unsigned 64-bit seed as decimal(20, 0)."""
    return F.conv(key_from_address(address), 16, 10).cast("decimal(20,0)")

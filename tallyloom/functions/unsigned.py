"""Unsigned 64-bit arithmetic modulo 2^64 on long or decimal(20,0) columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MODULUS = "18446744073709551616"
_M = f"CAST({MODULUS} AS DECIMAL(20,0))"


def wrap(c: Column) -> Column:
    """A non-negative whole decimal modulo 2^64, as decimal(20,0)."""
    return (c % F.expr(_M)).cast("decimal(20,0)")


def wide(c: Column) -> Column:
    return c.cast("decimal(20,0)")


def times(a: Column, b: Column) -> Column:
    """a * b modulo 2^64 without passing 38 digits: b goes in halves of 32 bits."""
    half = F.expr("CAST(4294967296 AS DECIMAL(10,0))")
    high = F.floor(wide(b) / half).cast("decimal(10,0)")
    low = (wide(b) % half).cast("decimal(10,0)")
    upper = wrap(wide(a) * high)
    return wrap(upper * half + wide(a) * low)


def total(c: Column, small: bool) -> Column:
    """Sum modulo 2^64; ``small``: it is known to stay below 2^63, so longs do.  Null on no rows."""
    return F.sum(c.cast("long")) if small else wrap(F.sum(c.cast("decimal(28,0)")))


def shown(c: Column) -> Column:
    """Digits, or NULL where there is no sum."""
    return F.coalesce(c.cast("string"), F.lit("NULL"))

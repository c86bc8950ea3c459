"""Reproducible draws that any SQL engine can repeat: uniform numbers from md5 of a seed, a stream and an id."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(seed: int, stream: int | str, i: Column) -> Column:
    """In [0, 1): the first eight hex digits of md5(seed:stream:id), over 2**32."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:{stream}:"), i.cast("string"))), 1, 8), 16, 10).cast("double") / float(1 << 32)


def gaussian(seed: int, stream: int | str, i: Column) -> Column:
    """Standard normal, by Box and Muller from two uniform draws."""
    u, v = uniform(seed, f"{stream}a", i), uniform(seed, f"{stream}b", i)
    return F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - u)) * F.cos(F.lit(2 * 3.141592653589793) * v)


def rounded(c: Column, digits: int = 6) -> Column:
    """Rounded for comparison, without a negative zero."""
    return F.round(c, digits) + F.lit(0.0)

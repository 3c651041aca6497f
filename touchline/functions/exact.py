"""Exact integer arithmetic for shares, and portable seeded hashing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up_percent(numerator: Column, denominator: Column) -> Column:
    """Whole percent of a fraction, halves up; zero when the denominator is zero."""
    n, d = numerator.cast("bigint"), denominator.cast("bigint")
    return F.when(d == 0, F.lit(0)).otherwise(
        F.floor((200 * n + d) / F.when(d == 0, F.lit(1)).otherwise(2 * d).cast("decimal(20,0)"))
    ).cast("bigint")


def text_hash(*parts) -> Column:
    """A 60-bit number from the md5 of ``a:b:c``; the same in every engine."""
    text = F.concat_ws(":", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")

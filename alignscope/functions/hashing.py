"""Reproducible hashes of strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hashed_unit(text: Column) -> Column:
    """A string's md5 as a number from 0 to 1: the first 16 hex digits over two to the 64th."""
    return F.conv(F.substring(F.md5(text), 1, 16), 16, 10).cast("decimal(20,0)").cast("double") / F.lit(2.0**64)

"""Stable hashes of ids: the same values wherever they are computed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bucket(key: Column, n: int, salt: str = "") -> Column:
    """crc32 of the salted key modulo n."""
    return (F.crc32(F.concat(F.lit(salt), key.cast("string")).cast("binary")) % n).cast("int")


def in_sample(key: Column, fraction: float, salt: str = "", grain: int = 100_000) -> Column:
    """True for a fraction of keys, the same ones each time; all rows of a key go together."""
    return bucket(key, grain, salt) < int(round(fraction * grain))

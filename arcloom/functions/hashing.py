"""Reproducible randomness derived from row keys.

Every random choice is a pure function of a seed and the row's key, so a task that is
retried on another executor, or a run with another partition count, draws the same values.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BUCKET_HEX_DIGITS = 4


def _col(key) -> Column:
    return F.col(key) if isinstance(key, str) else key


def hash_hex(seed, *keys) -> Column:
    """md5 of ``seed|key1|key2...`` as 32 hex digits."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[_col(k).cast("string") for k in keys]))


def uniform(seed, *keys) -> Column:
    """A double in [0, 1) built from the first 52 bits of the hash."""
    return hex_uniform(hash_hex(seed, *keys))


def hex_uniform(hex_col: Column) -> Column:
    return F.conv(F.substring(hex_col, 1, 13), 16, 10).cast("long").cast("double") / F.lit(float(2**52))


def hash_bucket(hex_col: Column, digits: int = BUCKET_HEX_DIGITS) -> Column:
    """Leading hex digits as an integer; ordered like the hash itself.

    Never null, so that joins on it add no null test that would hash every row once more.
    """
    return F.coalesce(F.conv(F.substring(hex_col, 1, digits), 16, 10).cast("int"), F.lit(0))


def gumbel(u: Column) -> Column:
    """Gumbel noise; adding it to logits and taking the maximum is a softmax draw."""
    return -F.log(-F.log(F.greatest(u, F.lit(1e-12))))

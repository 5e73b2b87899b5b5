"""Reproducible randomness: uniforms and normals derived from hashed keys.

A value depends only on its seed and keys, so neither the partitioning nor a retried task
changes it.
"""

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_key(seed: int, *keys) -> Column:
    cols = [F.col(k) if isinstance(k, str) else k for k in keys]
    return F.xxhash64(F.lit(seed), *cols)


def text_key(seed: int, *keys) -> Column:
    """The md5 of seed and keys joined by slashes, in hexadecimal: a hash that other engines have too."""
    return F.md5(F.concat_ws("/", F.lit(str(seed)), *[(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys]))


def text_pick(seed: int, n: Column, *keys) -> Column:
    """An integer in [0, n) from the first 32 bits of `text_key`."""
    return F.conv(F.substring(text_key(seed, *keys), 1, 8), 16, 10).cast("bigint") % n.cast("bigint")


def uniform(seed: int, *keys) -> Column:
    """A uniform in [0, 1) with 53 random bits."""
    return F.shiftrightunsigned(hash_key(seed, *keys), 11).cast("double") * F.lit(2.0**-53)


def normal(seed: int, *keys) -> Column:
    """A standard normal by the Box-Muller transform of the two halves of one hash."""
    h = hash_key(seed, *keys)
    step = F.lit(2.0**-32)
    first = (F.shiftrightunsigned(h, 32) + 1).cast("double") * step
    second = h.bitwiseAND(F.lit(0xFFFFFFFF)).cast("double") * step
    return F.sqrt(F.lit(-2.0) * F.log(first)) * F.cos(F.lit(2 * math.pi) * second)


def pick(seed: int, n, *keys) -> Column:
    """An integer in [0, n)."""
    size = F.lit(n) if isinstance(n, int) else n
    return F.pmod(hash_key(seed, *keys), size.cast("bigint"))

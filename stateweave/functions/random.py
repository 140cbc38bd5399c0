"""Counter-based random numbers: the same for any partitioning, and expressible in SQL."""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(*keys: Column) -> Column:
    """A uniform in (0, 1) from the md5 of the keys joined by ':'."""
    digits = F.substring(F.md5(F.concat_ws(":", *(k.cast("string") for k in keys))), 1, 13)
    return (F.conv(digits, 16, 10).cast("long") + 0.5) / float(1 << 52)


def normal(*keys: Column) -> Column:
    """A standard normal from two uniforms."""
    return F.sqrt(-2.0 * F.log(uniform(*keys, F.lit("a")))) * F.cos(2 * math.pi * uniform(*keys, F.lit("b")))


def generator(*keys) -> np.random.Generator:
    """A generator seeded by the keys, for use inside tasks."""
    return np.random.default_rng(int.from_bytes(hashlib.sha256(":".join(map(str, keys)).encode()).digest()[:8], "little"))

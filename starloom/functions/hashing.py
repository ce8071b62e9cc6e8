"""Integer hashing both Spark and any SQL engine can reproduce, for repeatable choices."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: linear congruential step (modulus 2^31)
MULTIPLIER = 1103515245
INCREMENT = 12345
MODULUS = 2147483648


def key_hash(key: Column | str, seed: int = 0) -> Column:
    """Pseudo-random long in [0, 2^31) from a key of any type.

    Integers (and text that holds one) below 2^31 give what SQL gives by the same step; the high part
    of larger ones is mixed in first, and any other key is hashed.
    """
    base = F.col(key) if isinstance(key, str) else key
    base = F.coalesce(base.try_cast("bigint"), F.xxhash64(base))
    high = F.pmod(F.xxhash64(F.shiftright(base, 31)), F.lit(MODULUS))
    base = F.pmod(base, F.lit(MODULUS)) + F.when(base.between(0, MODULUS - 1), F.lit(0)).otherwise(high)
    base = F.pmod(base + F.lit(seed), F.lit(MODULUS))
    return F.pmod(base * F.lit(MULTIPLIER) + F.lit(INCREMENT), F.lit(MODULUS))


def key_fraction(key: Column | str, seed: int = 0) -> Column:
    """Pseudo-random double in [0, 1) from an integer key (two rounds, high bits)."""
    return key_hash(key_hash(key, seed), seed) / F.lit(float(MODULUS))

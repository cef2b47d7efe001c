"""Random columns that depend only on (seed, stream, key): the same under any partitioning and after any retry."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_SEED = 42
SPAN = 2.0**52


def digest(stream: str, *keys: Column, seed: int = DEFAULT_SEED) -> Column:
    return F.md5(F.concat_ws("|", F.lit(f"{seed}|{stream}"), *[k.cast("string") for k in keys]))


def integer(stream: str, *keys: Column, seed: int = DEFAULT_SEED) -> Column:
    """52 random bits."""
    return F.conv(F.substring(digest(stream, *keys, seed=seed), 1, 13), 16, 10).cast("bigint")


def uniform(stream: str, *keys: Column, seed: int = DEFAULT_SEED) -> Column:
    """On (0, 1): the middle of one of 2^52 steps."""
    return (integer(stream, *keys, seed=seed) + F.lit(0.5)) / F.lit(SPAN)


def exponential(stream: str, *keys: Column, seed: int = DEFAULT_SEED) -> Column:
    return -F.log(uniform(stream, *keys, seed=seed))


def normal(stream: str, *keys: Column, seed: int = DEFAULT_SEED) -> Column:
    """Box-Muller on two uniforms."""
    return F.sqrt(-2.0 * F.log(uniform(f"{stream}.r", *keys, seed=seed))) * F.cos(F.lit(2 * math.pi) * uniform(f"{stream}.a", *keys, seed=seed))


def sum_normal(stream: str, *keys: Column, seed: int = DEFAULT_SEED) -> Column:
    """Near-normal sum of eight 16-bit slices of the digest: integer sums and one division, the same in any engine."""
    d = digest(stream, *keys, seed=seed)
    total = sum((F.conv(F.substring(d, 1 + 4 * i, 4), 16, 10).cast("bigint") for i in range(8)), F.lit(0))
    return (total - F.lit(262140)).cast("double") / F.lit(53509.47)

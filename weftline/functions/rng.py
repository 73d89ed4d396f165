"""Random draws that depend on (seed, epoch, sample, draw) alone, never on partitions or arrival."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: 13 hexadecimal digits are 52 bits: exact in a double.
SCALE = float(16**13)


def key(seed: int, epoch: int, sample: Column, draw: int | str = "") -> Column:
    """The md5 of "seed:epoch:sample[:draw]" in hexadecimal."""
    parts = [F.lit(f"{seed}:{epoch}:"), sample.cast("string")]
    return F.md5(F.concat(*parts, F.lit(f":{draw}")) if draw != "" else F.concat(*parts))


def bits(seed: int, epoch: int, sample: Column, draw: int | str = "", digits: int = 13) -> Column:
    return F.conv(F.substring(key(seed, epoch, sample, draw), 1, digits), 16, 10).cast("long")


def uniform(seed: int, epoch: int, sample: Column, draw: int | str = "") -> Column:
    """In [0, 1)."""
    return bits(seed, epoch, sample, draw) / F.lit(SCALE)


def below(n: Column | int, seed: int, epoch: int, sample: Column, draw: int | str = "") -> Column:
    """In 0 .. n - 1."""
    return F.pmod(bits(seed, epoch, sample, draw), n if isinstance(n, Column) else F.lit(n))


def bernoulli(p: float, seed: int, epoch: int, sample: Column, draw: int | str = "") -> Column:
    return uniform(seed, epoch, sample, draw) < p

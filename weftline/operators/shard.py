"""Which rank has which sample, as column expressions over an ordinal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions import bits

#: Fixed value: the seed of hash sharding.
HASH_SEED = 0x517CC1B727220A95

STRATEGIES = ("contiguous", "interleaved", "hash")


def contiguous(i: Column, n: int, world: int) -> Column:
    """The first n % world ranks get one more."""
    base, extra = divmod(n, world)
    head = extra * (base + 1)
    if not base:
        return i
    return F.when(i < head, F.floor(i / (base + 1))).otherwise(extra + F.floor((i - head) / base)).cast("long")


def interleaved(i: Column, world: int) -> Column:
    return F.pmod(i, F.lit(world))


def hashed(i: Column, world: int, seed: int = HASH_SEED) -> Column:
    return bits.unsigned_mod(bits.splitmix(i.cast("long").bitwiseXOR(F.lit(seed))), world)


def rank_of(strategy: str, i: Column, n: int, world: int) -> Column:
    """By name, in either case."""
    name = strategy.lower()
    if name == "contiguous":
        return contiguous(i, n, world)
    if name == "interleaved":
        return interleaved(i, world)
    if name in ("hash", "hash_based", "hashbased"):
        return hashed(i, world)
    raise ValueError(f"unknown sharding strategy: {strategy}")


def equal_blocks(df: DataFrame, n: int, world: int, pos: str = "pos") -> DataFrame:
    """floor(n / world) positions a rank; the tail goes."""
    size = n // world
    return df.filter(F.col(pos) < size * world).withColumn("rank", F.floor(F.col(pos) / max(1, size)).cast("long"))


def ceil_blocks(df: DataFrame, n: int, world: int, workers: int = 1, pos: str = "pos") -> DataFrame:
    """Blocks of ceil(n / (world * workers)) over rank * workers + worker; nothing goes."""
    size = max(1, -(-n // (world * workers)))
    part = F.floor(F.col(pos) / size).cast("long")
    return df.withColumn("part", part).withColumn("rank", F.floor(part / workers).cast("long"))


def sampler(df: DataFrame, n: int, world: int, drop_last: bool, pos: str = "pos") -> DataFrame:
    """(slot, rank) for the rows of an order: strided; the tail is dropped, or the head repeats to fill up.

    A row whose position comes up again is its own copy: an explode of one or more slots, no join.
    """
    total = n // world * world if drop_last else -(-n // world) * world
    if drop_last:
        slots = df.filter(F.col(pos) < total).withColumn("slot", F.col(pos))
    else:
        turns = F.when(F.col(pos) < total, F.sequence(F.lit(0).cast("long"), F.floor((F.lit(total - 1) - F.col(pos)) / max(1, n)).cast("long")))
        slots = df.withColumn("slot", F.explode(F.transform(turns, lambda k: F.col(pos) + k * n)))
    return slots.withColumn("rank", F.pmod("slot", F.lit(world)))


def report(df: DataFrame, n: int, world: int, i: str = "sample_id") -> DataFrame:
    """Per strategy: least and most samples of a rank, their ratio (null if a rank has none), and whether all are covered once."""
    long = df.select(F.col(i), F.explode(F.array(*(F.struct(F.lit(s).alias("strategy"), rank_of(s, F.col(i), n, world).alias("rank")) for s in STRATEGIES))).alias("s")).select(i, "s.strategy", "s.rank")
    sizes = long.groupBy("strategy", "rank").agg(F.count("*").alias("n"), F.sum(i).alias("ids"))
    least = F.when(F.count("*") < world, F.lit(0)).otherwise(F.min("n"))
    return sizes.groupBy("strategy").agg(
        least.cast("long").alias("least"), F.max("n").alias("most"), F.round(F.max("n") / F.nullif(least, F.lit(0)), 6).alias("imbalance"),
        ((F.sum("n") == n) & (F.sum("ids") == n * (n - 1) // 2) & (F.min("rank") >= 0) & (F.max("rank") < world)).alias("covered"),
    )

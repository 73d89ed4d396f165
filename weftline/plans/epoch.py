"""One epoch of one rank as a plan: order, shard, batch, drop and resume are decided on ids; payload joins last."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators import batch, order, shard


@dataclass(frozen=True)
class EpochPlan:
    """``shard`` is equal_blocks, ceil_blocks, sampler, contiguous, interleaved or hash."""

    batch_size: int
    seed: int = 0
    epoch: int = 0
    shuffle: bool = True
    rank: int = 0
    world: int = 1
    shard: str = "equal_blocks"
    drop_last: bool = False
    served: int = 0

    def __post_init__(self):
        if self.batch_size < 1 or not 0 <= self.rank < self.world or self.served < 0:
            raise ValueError("batch_size >= 1, 0 <= rank < world and served >= 0 are needed")

    def ids(self, samples: DataFrame, n: int) -> DataFrame:
        """sample_id, batch_id, row_in_batch of this rank's epoch; samples has sample_id and n rows."""
        slim = samples.select("sample_id")
        pos = order.shuffled(slim, self.seed, self.epoch) if self.shuffle else slim.withColumn("pos", F.col("sample_id"))
        if self.shard == "equal_blocks":
            size = n // self.world
            mine, count = pos.filter((F.col("pos") >= self.rank * size) & (F.col("pos") < (self.rank + 1) * size)).withColumn("at", F.col("pos") - self.rank * size), size
        elif self.shard == "ceil_blocks":
            size = -(-n // self.world)
            mine, count = pos.filter(F.floor(F.col("pos") / max(1, size)) == self.rank).withColumn("at", F.col("pos") - self.rank * size), max(0, min(n, (self.rank + 1) * size) - self.rank * size)
        elif self.shard == "sampler":
            slots = shard.sampler(pos, n, self.world, self.drop_last).filter(F.col("rank") == self.rank)
            mine, count = slots.withColumn("at", F.floor(F.col("slot") / self.world).cast("long")), (n // self.world if self.drop_last else -(-n // self.world))
        else:
            own = pos.filter(shard.rank_of(self.shard, F.col("sample_id"), n, self.world) == self.rank)
            mine, count = order.ranked(own.withColumn("__deal", F.shiftright("pos", 16)), [F.col("pos")], "at"), None
        if self.drop_last:
            count = mine.count() if count is None else count
            mine = batch.drop_last(mine, count, self.batch_size, "at")
        return batch.resumed(batch.fixed(mine, self.batch_size, "at"), self.served).select("sample_id", "batch_id", "row_in_batch")

    def apply(self, samples: DataFrame, n: int) -> DataFrame:
        return self.ids(samples, n).join(samples, "sample_id")

    def state(self, served: int) -> dict[str, int]:
        return {"version": 1, "epoch": self.epoch, "batches_served": served}

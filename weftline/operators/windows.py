"""Token windows and video clips: index arithmetic first, payload by join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.functions import rng
from weftline.operators import order


def starts(spark, n: int, length: int, batch: int, targets: bool = True, seed: int | None = None, epoch: int = 0) -> DataFrame:
    """(window, step, row, start). Sequential starts wrap; with a seed they are drawn. The last legal start is never used."""
    most = n - length - (1 if targets else 0)
    if most <= 0:
        raise ValueError("the stream is too short for one window")
    steps = max(1, most // (batch * length))
    start = F.pmod(F.col("id") * length, F.lit(most)) if seed is None else rng.below(most, seed, epoch, F.col("id"), "start")
    return spark.range(steps * batch).select(F.col("id").alias("window"), F.floor(F.col("id") / batch).cast("long").alias("step"), F.pmod("id", F.lit(batch)).alias("row"), start.alias("start"))


def windows(tokens: DataFrame, plan: DataFrame, length: int, chunk: int = 4096) -> DataFrame:
    """Adds x and y (the shift by one) to a plan of starts; tokens: (pos, token), pos 0, 1, 2 and so on.

    Tokens are gathered into arrays of ``chunk``, each with the first ``length`` tokens of the next one, so
    every window is a slice of one array: tokens are shuffled once, and no window is taken apart.
    """
    chunk = max(chunk, length + 1)
    rows = tokens.groupBy(F.floor(F.col("pos") / chunk).alias("chunk")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "token"))), lambda r: r["token"]).alias("all"))
    heads = tokens.filter((F.pmod("pos", F.lit(chunk)) < length) & (F.col("pos") >= chunk)).groupBy((F.floor(F.col("pos") / chunk) - 1).alias("chunk")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "token"))), lambda r: r["token"]).alias("head"))
    whole = rows.join(heads, "chunk", "left").select("chunk", F.concat("all", F.coalesce("head", F.slice("all", 1, 0))).alias("all"))
    asked = plan.select("window", "start", F.floor(F.col("start") / chunk).alias("chunk"), F.pmod("start", F.lit(chunk)).cast("int").alias("at"))
    return asked.join(whole, "chunk").select("window", "start", F.slice("all", F.col("at") + 1, F.lit(length)).alias("x"), F.slice("all", F.col("at") + 2, F.lit(length)).alias("y"))


def shifted(tokens: DataFrame, chunk: int = 1 << 16) -> DataFrame:
    """(pos, x, y): each token and its successor. Chunks are shifted by themselves; their seams by a join on position."""
    cut = tokens.withColumn("__chunk", F.floor(F.col("pos") / chunk))
    inner = cut.withColumn("y", F.lead("token").over(W.partitionBy("__chunk").orderBy("pos")))
    seam = tokens.filter(F.pmod("pos", F.lit(chunk)) == 0).select((F.col("pos") - 1).alias("pos"), F.col("token").alias("__next"))
    return inner.join(seam, "pos", "left").select("pos", F.col("token").alias("x"), F.coalesce("y", "__next").alias("y")).filter("y IS NOT NULL")


def video_plan(videos: DataFrame, span: int, stride: int = 1) -> DataFrame:
    """videos (video, n_frames): windows of each and the running bounds [low, high) of its windows in the whole set."""
    n = videos.withColumn("n_windows", F.greatest(F.lit(0), F.col("n_frames") - span + 1))
    deal = order.dealt(n, "video")
    sums = deal.groupBy("__deal").agg(F.sum("n_windows").alias("__s")).withColumn("__before", F.sum("__s").over(W.orderBy("__deal")) - F.col("__s")).drop("__s")
    inner = deal.withColumn("__run", F.sum("n_windows").over(W.partitionBy("__deal").orderBy("video")))
    return inner.join(sums, "__deal").withColumn("high", F.col("__run") + F.col("__before")).withColumn("low", F.col("high") - F.col("n_windows")).drop("__deal", "__run", "__before")


def located(plan: DataFrame, draws: DataFrame, cell: int = 256) -> DataFrame:
    """draws (draw, g): the video and start of global window g. A range join, by cells of g that equal on both sides."""
    spread = plan.filter("n_windows > 0").withColumn("__cell", F.explode(F.sequence(F.floor(F.col("low") / cell), F.floor((F.col("high") - 1) / cell))))
    asked = draws.withColumn("__cell", F.floor(F.col("g") / cell))
    return asked.join(spread, "__cell").filter("g >= low AND g < high").withColumn("start", F.col("g") - F.col("low")).drop("__cell")


def clip_frames(clips: DataFrame, length: int, step: int) -> DataFrame:
    """clips (.., start, n_frames): one row a frame of each clip; past the end the last frame repeats."""
    return clips.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(length - 1)))).withColumn("frame", F.least(F.col("start") + F.col("k") * step, F.col("n_frames") - 1))


def sequential_clips(videos: DataFrame, length: int, step: int = 1) -> DataFrame:
    """Clips one after another; a short tail goes."""
    n = F.floor(F.col("n_frames") / (length * step)).cast("int")
    return videos.filter(n > 0).withColumn("clip", F.explode(F.sequence(F.lit(0), n - 1))).withColumn("start", F.col("clip").cast("long") * length * step)

"""Image operations on pixel relations (img, y, x, c, v), v from 0 to 255, as plain columns and aggregates.

Truncation to a byte is ``floor`` after clamping. A hair (1e-9) is added where two ways to sum the same
products might fall on either side of a whole number.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.functions import rng

#: Fixed values.
IMAGENET_MEAN, IMAGENET_STD = (0.485, 0.456, 0.406), (0.229, 0.224, 0.225)
LUMA = (0.299, 0.587, 0.114)
_HAIR = 1e-9


def from_vectors(df: DataFrame, key: str, vector: str, n: int, channels: int = 3) -> DataFrame:
    """n x n images of a vector of n * n numbers; each channel starts 21 places on."""
    size = n * n
    long = df.select(F.col(key).alias("img"), vector, F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias("k")).select("*", F.explode(F.sequence(F.lit(0), F.lit(channels - 1))).alias("c"))
    v = F.element_at(vector, F.pmod(F.col("k") + 21 * F.col("c"), F.lit(size)) + 1).cast("double")
    return long.select("img", F.floor(F.col("k") / n).alias("y"), F.pmod("k", F.lit(n)).cast("long").alias("x"), F.col("c").cast("long").alias("c"), F.least(F.lit(255), F.greatest(F.lit(0), F.floor(128 + 64 * v))).alias("v"))


def byte(value: Column) -> Column:
    return F.floor(F.least(F.lit(255.0), F.greatest(F.lit(0.0), value)))


def _by_channel(values: tuple[float, ...]) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), F.col("c").cast("int") + 1)


def normalize(p: DataFrame, mean=IMAGENET_MEAN, std=IMAGENET_STD) -> DataFrame:
    if len(mean) != len(std) or min(std) <= 0:
        raise ValueError("mean and std go together, and std is positive")
    return p.withColumn("v", (F.col("v") / 255.0 - _by_channel(mean)) / _by_channel(std))


def layouts(p: DataFrame, w: int, h: int, channels: int) -> DataFrame:
    return p.select("img", (F.col("c") * (w * h) + F.col("y") * w + F.col("x")).alias("chw"), ((F.col("y") * w + F.col("x")) * channels + F.col("c")).alias("hwc"), "v")


def to_tensor(p: DataFrame, w: int, h: int, channels: int) -> DataFrame:
    return layouts(p, w, h, channels).select("img", F.col("chw").alias("at"), (F.col("v") / 255.0).alias("v"))


def from_tensor(p: DataFrame) -> DataFrame:
    return p.withColumn("v", byte(F.col("v") * 255 + _HAIR))


def _luma() -> Column:
    return sum((F.lit(w) * F.max(F.when(F.col("c") == k, F.col("v"))) for k, w in enumerate(LUMA)), F.lit(0.0))


def grayscale(p: DataFrame) -> DataFrame:
    return p.groupBy("img", "y", "x").agg(F.floor(_luma() + _HAIR).alias("v"))


def hflip(p: DataFrame, w: int, where: Column | None = None) -> DataFrame:
    x = F.lit(w - 1) - F.col("x")
    return p.withColumn("x", x if where is None else F.when(where, x).otherwise(F.col("x")))


def vflip(p: DataFrame, h: int) -> DataFrame:
    return p.withColumn("y", F.lit(h - 1) - F.col("y"))


def rot90(p: DataFrame, h: int) -> DataFrame:
    """Clockwise."""
    return p.select("img", F.col("x").alias("y"), (F.lit(h - 1) - F.col("y")).alias("x"), "c", "v")


def crop(p: DataFrame, left: Column, top: Column, w: int, h: int) -> DataFrame:
    moved = p.withColumns({"y": F.col("y") - top, "x": F.col("x") - left})
    return moved.filter((F.col("y") >= 0) & (F.col("y") < h) & (F.col("x") >= 0) & (F.col("x") < w))


def center_crop(p: DataFrame, w: int, h: int, out_w: int, out_h: int) -> DataFrame:
    return crop(p, F.lit(max(0, (w - out_w) // 2)), F.lit(max(0, (h - out_h) // 2)), min(w, out_w), min(h, out_h))


def random_crop(p: DataFrame, w: int, h: int, out_w: int, out_h: int, seed: int, epoch: int = 0) -> DataFrame:
    if out_w > w or out_h > h:
        raise ValueError("the crop is larger than the image")
    i = F.col("img")
    # Offsets are fixed per image before x and y move.
    drawn = p.withColumns({"__ox": rng.below(w - out_w + 1, seed, epoch, i, "x"), "__oy": rng.below(h - out_h + 1, seed, epoch, i, "y")})
    return crop(drawn, F.col("__ox"), F.col("__oy"), out_w, out_h).drop("__ox", "__oy")


def pad(p: DataFrame, w: int, h: int, by: int, mode: str = "constant", value: int = 0) -> DataFrame:
    """Each source pixel goes to all places that show it; constant borders are made apart."""

    def places(at: str, n: int) -> Column:
        inner = F.array(F.col(at) + by)
        if mode == "constant":
            return inner
        out = [inner]
        for k in range(by):
            low, high = (0, n - 1) if mode == "edge" else (min(by - k, n - 1), max(0, n - 2 - k))
            out += [F.when(F.col(at) == low, F.array(F.lit(k).cast("long"))).otherwise(F.array().cast("array<bigint>")), F.when(F.col(at) == high, F.array(F.lit(n + by + k).cast("long"))).otherwise(F.array().cast("array<bigint>"))]
        return F.concat(*out)

    if mode not in ("constant", "edge", "reflect"):
        raise ValueError(f"unknown padding: {mode}")
    body = p.select("img", F.explode(places("y", h)).alias("y"), "x", "c", "v").select("img", "y", F.explode(places("x", w)).alias("x"), "c", "v")
    if mode != "constant":
        return body
    spread = p.select("img", "c").distinct().select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(h + 2 * by - 1).cast("long"))).alias("y")).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(w + 2 * by - 1).cast("long"))).alias("x"))
    border = spread.filter((F.col("y") < by) | (F.col("y") >= h + by) | (F.col("x") < by) | (F.col("x") >= w + by))
    return body.unionByName(border.withColumn("v", F.lit(value).cast("long")))


def invert(p: DataFrame) -> DataFrame:
    return p.withColumn("v", 255 - F.col("v"))


def posterize(p: DataFrame, bits: int) -> DataFrame:
    if not 1 <= bits <= 8:
        raise ValueError("bits go from 1 to 8")
    return p.withColumn("v", F.col("v").bitwiseAND(F.lit(256 - (1 << (8 - bits))).cast("long")))


def solarize(p: DataFrame, threshold: int) -> DataFrame:
    return p.withColumn("v", F.when(F.col("v") > threshold, 255 - F.col("v")).otherwise(F.col("v")))


def brightness(p: DataFrame, factor: float) -> DataFrame:
    return p.withColumn("v", byte(F.col("v") * F.lit(factor)))


def _beside(p: DataFrame, keys: list[str], **aggregates: Column) -> DataFrame:
    """Aggregates of groups of pixels, on each of their pixels. Groups are at most an image."""
    return p.join(p.groupBy(*keys).agg(*(c.alias(k) for k, c in aggregates.items())), keys)


def contrast(p: DataFrame, factor: float, per_channel: bool = False) -> DataFrame:
    m = _beside(p, ["img", "c"] if per_channel else ["img"], __m=F.avg("v"))
    return m.withColumn("v", byte(F.col("__m") + factor * (F.col("v") - F.col("__m")) + _HAIR)).drop("__m")


def color(p: DataFrame, factor: float) -> DataFrame:
    m = _beside(p, ["img", "y", "x"], __m=_luma())
    return m.withColumn("v", byte(F.col("__m") + factor * (F.col("v") - F.col("__m")) + _HAIR)).drop("__m")


def autocontrast(p: DataFrame) -> DataFrame:
    """A flat channel becomes 0."""
    m = _beside(p, ["img", "c"], __a=F.min("v"), __b=F.max("v"))
    v = F.when(F.col("__a") == F.col("__b"), F.lit(0)).otherwise(F.floor((F.col("v") - F.col("__a")) * 255 / F.greatest(F.lit(1), F.col("__b") - F.col("__a"))))
    return m.withColumn("v", v).drop("__a", "__b")


def equalize(p: DataFrame, size: int) -> DataFrame:
    """By the running histogram of each channel; one that has a single value stays."""
    histogram = p.groupBy("img", "c", "v").agg(F.count("*").alias("n"))
    cdf = histogram.withColumn("__cdf", F.sum("n").over(W.partitionBy("img", "c").orderBy("v"))).withColumn("__low", F.min("__cdf").over(W.partitionBy("img", "c"))).drop("n")
    new = F.when(F.col("__low") == size, F.col("v")).otherwise(F.floor((F.col("__cdf") - F.col("__low")) * 255 / F.greatest(F.lit(1), F.lit(size) - F.col("__low"))))
    return p.join(cdf, ["img", "c", "v"]).withColumn("v", new).drop("__cdf", "__low")


def _targets(at: str, sources: list[int]) -> Column:
    """Targets that read each source place."""
    return F.explode(F.filter(F.array(*(F.when(F.col(at) == s, F.lit(t).cast("long")) for t, s in enumerate(sources))), lambda t: t.isNotNull()))


def resize_nearest(p: DataFrame, w: int, h: int, out_w: int, out_h: int) -> DataFrame:
    """Source place floor(target * ratio)."""
    ys, xs = ([min(t * n // m, n - 1) for t in range(m)] for n, m in ((h, out_h), (w, out_w)))
    return p.select("img", _targets("y", ys).alias("y"), "x", "c", "v").select("img", "y", _targets("x", xs).alias("x"), "c", "v")


def _taps(n: int, m: int) -> list[tuple[int, int, float]]:
    """(target, source, weight) of bilinear resizing: half-pixel centres, clamped."""
    out = []
    for t in range(m):
        s = max(0.0, (t + 0.5) * n / m - 0.5)
        a = min(int(s), n - 1)
        f = s - a
        out += [(t, a, 1 - f)] + ([(t, min(a + 1, n - 1), f)] if f else [])
    return out


def _weighted(p: DataFrame, at: str, taps: list[tuple[int, int, float]]) -> DataFrame:
    options = F.filter(F.array(*(F.when(F.col(at) == s, F.struct(F.lit(t).cast("long").alias("t"), F.lit(float(f)).alias("f"))) for t, s, f in taps)), lambda o: o.isNotNull())
    rest = [c for c in ("img", "y", "x", "c") if c != at]
    long = p.select(*rest, "v", F.explode(options).alias("o"))
    return long.groupBy(*rest, F.col("o.t").alias(at)).agg(F.sum(F.col("v") * F.col("o.f")).alias("v"))


def resize_bilinear(p: DataFrame, w: int, h: int, out_w: int, out_h: int) -> DataFrame:
    return _weighted(_weighted(p, "y", _taps(h, out_h)), "x", _taps(w, out_w)).withColumn("v", byte(F.col("v")))


def blur(p: DataFrame, w: int, h: int, kernel: list[float]) -> DataFrame:
    """Separable, edges clamped, cut to bytes after each pass."""
    if len(kernel) % 2 == 0:
        raise ValueError("the kernel has odd length")
    r = len(kernel) // 2
    for at, n in (("x", w), ("y", h)):
        p = _weighted(p, at, [(t, min(n - 1, max(0, t + k - r)), f) for t in range(n) for k, f in enumerate(kernel)]).withColumn("v", byte(F.col("v")))
    return p


def hsv(p: DataFrame) -> DataFrame:
    """Hue in degrees, saturation delta / max, value."""
    channel = lambda k: F.max(F.when(F.col("c") == k, F.col("v")))
    m = p.groupBy("img", "y", "x").agg(channel(0).alias("r"), channel(1).alias("g"), channel(2).alias("b"), F.max("v").alias("m"), (F.max("v") - F.min("v")).alias("d"))
    r, g, b, d = (F.col(k) for k in "rgbd")
    safe = F.greatest(F.lit(1), d)
    hue = F.when(d == 0, F.lit(0.0)).when(r == F.col("m"), F.when(g < b, 360.0).otherwise(0.0) + 60.0 * (g - b) / safe).when(g == F.col("m"), 120.0 + 60.0 * (b - r) / safe).otherwise(240.0 + 60.0 * (r - g) / safe)
    return m.select("img", "y", "x", hue.alias("h"), F.when(F.col("m") == 0, F.lit(0.0)).otherwise(d / F.greatest(F.lit(1), F.col("m"))).alias("s"), (F.col("m") / 255.0).alias("val"))


def gridmask(p: DataFrame, w: int, h: int, seed: int, epoch: int = 0, d_ratio: float = 0.5, ratio: float = 0.6, prob: float = 0.5) -> DataFrame:
    d = max(2, int(min(w, h) * d_ratio))
    keep = int(d * ratio)
    i = F.col("img")
    shift = lambda draw: F.floor(rng.uniform(seed, epoch, i, draw) * d)
    dark = rng.bernoulli(prob, seed, epoch, i, "p") & (F.pmod(F.col("x") + shift("dx"), F.lit(d)) < keep) & (F.pmod(F.col("y") + shift("dy"), F.lit(d)) < keep)
    return p.withColumn("v", F.when(dark, F.lit(0)).otherwise(F.col("v")))


def erase(p: DataFrame, w: int, h: int, seed: int, epoch: int = 0, prob: float = 0.5, scale=(0.02, 0.33), ratio=(0.3, 3.3), value: int = 0) -> DataFrame:
    i = F.col("img")
    u = lambda draw: rng.uniform(seed, epoch, i, draw)
    area, r = w * h * (scale[0] + u("area") * (scale[1] - scale[0])), ratio[0] + u("ratio") * (ratio[1] - ratio[0])
    bh, bw = F.floor(F.sqrt(area / r)), F.floor(F.sqrt(area * r))
    boxed = p.withColumns({"__h": bh, "__w": bw, "__t": F.floor(u("y") * (h - bh + 1)), "__l": F.floor(u("x") * (w - bw + 1))})
    inside = rng.bernoulli(prob, seed, epoch, i, "p") & (F.col("__w") < w) & (F.col("__h") < h) & (F.col("y") >= F.col("__t")) & (F.col("y") < F.col("__t") + F.col("__h")) & (F.col("x") >= F.col("__l")) & (F.col("x") < F.col("__l") + F.col("__w"))
    return boxed.withColumn("v", F.when(inside, F.lit(value)).otherwise(F.col("v"))).drop("__h", "__w", "__t", "__l")


def resized_crop(i: Column, w: int, h: int, seed: int, epoch: int = 0, scale=(0.08, 1.0), ratio=(3 / 4, 4 / 3)) -> Column:
    """struct(x, y, w, h): the first of ten tries that fits, else a centre crop of clamped aspect."""
    low, high = math.log(ratio[0]), math.log(ratio[1])

    def tries(k: int) -> Column:
        u = lambda d: rng.uniform(seed, epoch, i, f"{k}{d}")
        area, r = w * h * (scale[0] + u("a") * (scale[1] - scale[0])), F.exp(F.lit(low) + u("r") * (high - low))
        cw, ch = F.floor(F.sqrt(area * r) + 0.5), F.floor(F.sqrt(area / r) + 0.5)
        fits = (cw >= 1) & (cw <= w) & (ch >= 1) & (ch <= h)
        return F.when(fits, F.struct(F.floor(u("x") * (w - cw + 1)).alias("x"), F.floor(u("y") * (h - ch + 1)).alias("y"), cw.alias("w"), ch.alias("h")))

    bw, bh = w, h
    if w / h < ratio[0]:
        bh = min(h, round(w / ratio[0]))
    elif w / h > ratio[1]:
        bw = min(w, round(h * ratio[1]))
    rest = F.struct(*(F.lit(v).cast("long").alias(k) for k, v in (("x", (w - bw) // 2), ("y", (h - bh) // 2), ("w", bw), ("h", bh))))
    return F.coalesce(*map(tries, range(10)), rest)

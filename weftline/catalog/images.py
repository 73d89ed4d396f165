"""Images as pixel relations: img, y, x, c, v. Embeddings stand in for 8 x 8 images of three channels."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from weftline.catalog import query, table
from weftline.catalog.samples import udraw
from weftline.functions import rng
from weftline.operators import pixels

N = 8
_V = "CAST(least(255, greatest(0, floor(128 + 64 * CAST(embedding[{i}] AS DOUBLE)))) AS BIGINT)"
PIXELS = f"SELECT vec_id AS img, k // {N} AS y, k % {N} AS x, c, {_V.format(i='(k + 21 * c) % 64 + 1')} AS v FROM embeddings, (SELECT range AS k FROM range(64)), (SELECT range AS c FROM range(3))"


def _pixels(spark, sf_dir):
    return pixels.from_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", N)


def _op(name: str, sql: str, make) -> None:
    @query(name, f"WITH p AS ({PIXELS}) {sql}")
    def run(spark, sf_dir):
        return make(_pixels(spark, sf_dir))

    run.__name__ = name


MEAN, STD = pixels.IMAGENET_MEAN, pixels.IMAGENET_STD
_pick = lambda xs: f"CASE c WHEN 0 THEN {xs[0]} WHEN 1 THEN {xs[1]} ELSE {xs[2]} END"
_clamp = lambda e: f"CAST(floor(least(255.0, greatest(0.0, {e}))) AS BIGINT)"
_same = "SELECT img, y, x, c, {} AS v FROM p"
_GRAY = "SELECT img, y, x, CAST(floor(0.299::DOUBLE * max(v) FILTER (c = 0) + 0.587::DOUBLE * max(v) FILTER (c = 1) + 0.114::DOUBLE * max(v) FILTER (c = 2) + 1e-9) AS BIGINT) AS g FROM p GROUP BY 1, 2, 3"

_op("img_normalize", _same.format(f"round((v / 255.0::DOUBLE - {_pick(MEAN)}::DOUBLE) / {_pick(STD)}::DOUBLE, 6)"), lambda p: pixels.normalize(p).withColumn("v", F.round("v", 6)))
_op("img_totensor", f"SELECT img, c * {N * N} + y * {N} + x AS at, round(v / 255.0::DOUBLE, 6) AS v FROM p", lambda p: pixels.to_tensor(p, N, N, 3).withColumn("v", F.round("v", 6)))
_op("img_from_tensor", _same.format("CAST(floor(least(255.0, greatest(0.0, v / 255.0::DOUBLE * 1.5 * 255 + 1e-9))) AS BIGINT)"), lambda p: pixels.from_tensor(p.withColumn("v", F.col("v") / 255.0 * 1.5)))
_op("img_grayscale", _GRAY, lambda p: pixels.grayscale(p).withColumnRenamed("v", "g"))
_op("img_hflip", f"SELECT img, y, {N - 1} - x AS x, c, v FROM p", lambda p: pixels.hflip(p, N))
_op("img_vflip", f"SELECT img, {N - 1} - y AS y, x, c, v FROM p", lambda p: pixels.vflip(p, N))
_op("img_rot90", f"SELECT img, x AS y, {N - 1} - y AS x, c, v FROM p", lambda p: pixels.rot90(p, N))
_op("img_hwc_chw", f"SELECT img, c * {N * N} + y * {N} + x AS chw, (y * {N} + x) * 3 + c AS hwc, v FROM p", lambda p: pixels.layouts(p, N, N, 3))
_op("img_center_crop", "SELECT img, y - 1 AS y, x - 2 AS x, c, v FROM p WHERE y BETWEEN 1 AND 6 AND x BETWEEN 2 AND 5", lambda p: pixels.center_crop(p, N, N, 4, 6))
_pad = "SELECT img, yy AS y, xx AS x, c, {v} AS v FROM (SELECT DISTINCT img, c FROM p), (SELECT range AS yy FROM range(12)), (SELECT range AS xx FROM range(12)) {join} JOIN p USING (img, c) {on}"


def _pad_sql(source_y: str, source_x: str) -> str:
    return f"SELECT img, yy AS y, xx AS x, c, v FROM p, (SELECT range AS yy FROM range(12)), (SELECT range AS xx FROM range(12)) WHERE y = {source_y} AND x = {source_x}"


_EDGE = "greatest(0, least(7, {} - 2))"
_REFLECT = "CASE WHEN {0} < 2 THEN 2 - {0} WHEN {0} > 9 THEN 14 - ({0} - 2) ELSE {0} - 2 END"
_op("img_pad_edge", _pad_sql(_EDGE.format("yy"), _EDGE.format("xx")), lambda p: pixels.pad(p, N, N, 2, "edge"))
_op("img_pad_reflect", _pad_sql(_REFLECT.format("yy"), _REFLECT.format("xx")), lambda p: pixels.pad(p, N, N, 2, "reflect"))
_op("img_pad_const", "SELECT i.img, i.c, yy AS y, xx AS x, coalesce(v, 9) AS v FROM (SELECT DISTINCT img, c FROM p) i CROSS JOIN (SELECT range AS yy FROM range(12)) CROSS JOIN (SELECT range AS xx FROM range(12)) LEFT JOIN p ON p.img = i.img AND p.c = i.c AND y = yy - 2 AND x = xx - 2", lambda p: pixels.pad(p, N, N, 2, "constant", 9))
_op("img_invert", _same.format("255 - v"), pixels.invert)
_op("img_posterize", _same.format("v & 240"), lambda p: pixels.posterize(p, 4))
_op("img_solarize", _same.format("CASE WHEN v > 128 THEN 255 - v ELSE v END"), lambda p: pixels.solarize(p, 128))
_op("img_brightness", _same.format(_clamp("v * 1.5::DOUBLE")), lambda p: pixels.brightness(p, 1.5))
_op("img_contrast", f"SELECT img, y, x, c, {_clamp('m + 1.5 * (v - m) + 1e-9')} AS v FROM p JOIN (SELECT img, avg(v) AS m FROM p GROUP BY 1) USING (img)", lambda p: pixels.contrast(p, 1.5))
_op("img_channel_contrast", f"SELECT img, y, x, c, {_clamp('m + 0.5 * (v - m) + 1e-9')} AS v FROM p JOIN (SELECT img, c, avg(v) AS m FROM p GROUP BY 1, 2) USING (img, c)", lambda p: pixels.contrast(p, 0.5, per_channel=True))
_op("img_color", f"SELECT img, y, x, c, {_clamp('w + 1.5 * (v - w) + 1e-9')} AS v FROM p JOIN (SELECT img, y, x, 0.299::DOUBLE * max(v) FILTER (c = 0) + 0.587::DOUBLE * max(v) FILTER (c = 1) + 0.114::DOUBLE * max(v) FILTER (c = 2) AS w FROM p GROUP BY 1, 2, 3) USING (img, y, x)", lambda p: pixels.color(p, 1.5))
_op("img_autocontrast", "SELECT img, y, x, c, CASE WHEN high = low THEN 0 ELSE (v - low) * 255 // (high - low) END AS v FROM p JOIN (SELECT img, c, min(v) AS low, max(v) AS high FROM p GROUP BY 1, 2) USING (img, c)", pixels.autocontrast)
_op("img_equalize", f"""h AS (SELECT img, c, v, CAST(sum(count(*)) OVER (PARTITION BY img, c ORDER BY v) AS BIGINT) AS cdf FROM p GROUP BY 1, 2, 3), m AS (SELECT img, c, min(cdf) AS low FROM h GROUP BY 1, 2)
SELECT img, y, x, c, CASE WHEN low = {N * N} THEN p.v ELSE (cdf - low) * 255 // ({N * N} - low) END AS v FROM p JOIN h USING (img, c, v) JOIN m USING (img, c)""".replace("h AS", ", h AS", 1), lambda p: pixels.equalize(p, N * N))
_op("img_resize_nearest", "SELECT img, yy AS y, xx AS x, c, v FROM p, (SELECT range AS yy FROM range(5)), (SELECT range AS xx FROM range(12)) WHERE y = yy * 8 // 5 AND x = xx * 8 // 12", lambda p: pixels.resize_nearest(p, N, N, 12, 5))
_op("img_resize_bilinear", "SELECT img, y // 2 AS y, x // 2 AS x, c, CAST(floor(sum(v) / 4.0) AS BIGINT) AS v FROM p GROUP BY 1, 2, 3, 4", lambda p: pixels.resize_bilinear(p, N, N, 4, 4))
_op("img_hsv", """SELECT img, y, x, round(CASE WHEN d = 0 THEN 0.0 WHEN r = m THEN CASE WHEN g < b THEN 360.0 ELSE 0.0 END + 60.0::DOUBLE * (g - b) / d WHEN g = m THEN 120.0 + 60.0::DOUBLE * (b - r) / d ELSE 240.0 + 60.0::DOUBLE * (r - g) / d END, 4) AS h,
round(CASE WHEN m = 0 THEN 0.0 ELSE d / m::DOUBLE END, 6) AS s, round(m / 255.0::DOUBLE, 6) AS val FROM (SELECT img, y, x, max(v) FILTER (c = 0) AS r, max(v) FILTER (c = 1) AS g, max(v) FILTER (c = 2) AS b, max(v) AS m, max(v) - min(v) AS d FROM p GROUP BY 1, 2, 3)""", lambda p: pixels.hsv(p).select("img", "y", "x", F.round("h", 4).alias("h"), F.round("s", 6).alias("s"), F.round("val", 6).alias("val")))
_op("img_gaussian_blur", """, k AS (SELECT range - 1 AS o, CASE range WHEN 1 THEN 0.5::DOUBLE ELSE 0.25::DOUBLE END AS w FROM range(3)),
a AS (SELECT q.img, q.y, q.x, q.c, floor(sum(p.v * w)) AS v FROM p q, k JOIN p ON p.img = q.img AND p.c = q.c AND p.y = q.y AND p.x = greatest(0, least(7, q.x + o)) GROUP BY 1, 2, 3, 4)
SELECT q.img, q.y, q.x, q.c, CAST(floor(sum(a.v * w)) AS BIGINT) AS v FROM p q, k JOIN a ON a.img = q.img AND a.c = q.c AND a.x = q.x AND a.y = greatest(0, least(7, q.y + o)) GROUP BY 1, 2, 3, 4""", lambda p: pixels.blur(p, N, N, [0.25, 0.5, 0.25]))

_GM = {"d": udraw(8, 0, "img", "dx"), "e": udraw(8, 0, "img", "dy"), "p": udraw(8, 0, "img", "p")}
_op("img_gridmask", f"SELECT img, y, x, c, CASE WHEN {_GM['p']} < 0.5 AND (x + CAST(floor({_GM['d']} * 4) AS BIGINT)) % 4 < 2 AND (y + CAST(floor({_GM['e']} * 4) AS BIGINT)) % 4 < 2 THEN 0 ELSE v END AS v FROM p", lambda p: pixels.gridmask(p, N, N, seed=8))

_E = {d: udraw(9, 0, "img", d) for d in ("p", "area", "ratio", "y", "x")}
_op("img_erase", f""", r AS (SELECT DISTINCT img, {_E['p']} AS u, 64 * (0.02::DOUBLE + {_E['area']} * 0.31) AS a, 0.3::DOUBLE + {_E['ratio']} * 3.0 AS r, {_E['y']} AS uy, {_E['x']} AS ux FROM p),
b AS (SELECT img, u, CAST(floor(sqrt(a / r)) AS BIGINT) AS h, CAST(floor(sqrt(a * r)) AS BIGINT) AS w, uy, ux FROM r),
t AS (SELECT img, u, h, w, CAST(floor(uy * (8 - h + 1)) AS BIGINT) AS top, CAST(floor(ux * (8 - w + 1)) AS BIGINT) AS lft FROM b)
SELECT img, y, x, c, CASE WHEN u < 0.5 AND w < 8 AND h < 8 AND y >= top AND y < top + h AND x >= lft AND x < lft + w THEN 0 ELSE v END AS v FROM p JOIN t USING (img)""", lambda p: pixels.erase(p, N, N, seed=9))

_op("img_hflip_random", f"SELECT img, y, CASE WHEN {udraw(3, 2, 'img', 'flip')} < 0.5 THEN {N - 1} - x ELSE x END AS x, c, v FROM p", lambda p: pixels.hflip(p, N, where=rng.bernoulli(0.5, 3, 2, F.col("img"), "flip")))
_op("img_random_crop", f"SELECT img, y - oy AS y, x - ox AS x, c, v FROM (SELECT *, CAST('0x' || substr(md5('3:2:' || img || ':y'), 1, 13) AS BIGINT) % 4 AS oy, CAST('0x' || substr(md5('3:2:' || img || ':x'), 1, 13) AS BIGINT) % 4 AS ox FROM p) WHERE y - oy BETWEEN 0 AND 4 AND x - ox BETWEEN 0 AND 4", lambda p: pixels.random_crop(p, N, N, 5, 5, seed=3, epoch=2))


def _rrc_sql() -> str:
    u = lambda d: udraw(6, 0, "vec_id", f"' || k || '{d}")
    low, high = math.log(3 / 4), math.log(4 / 3)
    return f"""WITH t AS (SELECT vec_id, k, 48000 * (0.08::DOUBLE + {u('a')} * 0.92) AS area, exp({low}::DOUBLE + {u('r')} * {high - low}::DOUBLE) AS ratio, {u('x')} AS ux, {u('y')} AS uy FROM embeddings, (SELECT range AS k FROM range(10))),
c AS (SELECT vec_id, k, CAST(floor(sqrt(area * ratio) + 0.5) AS BIGINT) AS w, CAST(floor(sqrt(area / ratio) + 0.5) AS BIGINT) AS h, ux, uy FROM t), o AS (SELECT * FROM c WHERE w BETWEEN 1 AND 240 AND h BETWEEN 1 AND 200),
f AS (SELECT vec_id, arg_min(w, k) AS w, arg_min(h, k) AS h, arg_min(ux, k) AS ux, arg_min(uy, k) AS uy FROM o GROUP BY 1)
SELECT e.vec_id, CAST(coalesce(floor(ux * (240 - w + 1)), 0) AS BIGINT) AS x, CAST(coalesce(floor(uy * (200 - h + 1)), 0) AS BIGINT) AS y, coalesce(w, 240) AS w, coalesce(h, 200) AS h FROM embeddings e LEFT JOIN f USING (vec_id)"""


@query("rrc_params", _rrc_sql())
def rrc_params(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id")
    return rows.select("vec_id", pixels.resized_crop(F.col("vec_id"), 240, 200, seed=6).alias("r")).select("vec_id", "r.x", "r.y", "r.w", "r.h")


@query("mixup", f"""WITH s AS (SELECT *, row_number() OVER (ORDER BY vec_id) - 1 AS pos FROM embeddings), n AS (SELECT count(*) AS n FROM s),
pairs AS (SELECT a.vec_id, b.vec_id AS partner, a.label, b.label AS other, a.embedding AS ea, b.embedding AS eb, {udraw(2, 0, 'a.vec_id', 'lambda')} AS l FROM s a, n JOIN s b ON b.pos = CASE WHEN a.pos % 32 = 31 OR a.pos = n - 1 THEN a.pos // 32 * 32 ELSE a.pos + 1 END)
SELECT vec_id, partner, label, other, round(l, 6) AS lambda, round(l * CAST(ea[1] AS DOUBLE) + (1 - l) * CAST(eb[1] AS DOUBLE), 6) AS first FROM pairs""")
def mixup(spark, sf_dir):
    from weftline.operators import multi, order

    rows = order.with_sample_id(table(spark, sf_dir, "embeddings"), "vec_id", "pos")
    mixed = multi.mixup(multi.partners(rows, rows.count(), 32, ["vec_id", "label", "embedding"]), "vec_id", "embedding", seed=2)
    return mixed.select("vec_id", F.col("partner_vec_id").alias("partner"), "label", F.col("partner_label").alias("other"), F.round("lambda", 6).alias("lambda"), F.round(F.col("mixed")[0], 6).alias("first"))


@query("cutmix", f"""WITH b AS (SELECT vec_id, CAST(floor(8 * sqrt(1 - l)) AS BIGINT) AS cut, CAST(floor({udraw(2, 1, 'vec_id', 'x')} * 8) AS BIGINT) AS cx, CAST(floor({udraw(2, 1, 'vec_id', 'y')} * 8) AS BIGINT) AS cy FROM (SELECT vec_id, {udraw(2, 1, 'vec_id', 'lambda')} AS l FROM embeddings)),
k AS (SELECT vec_id, greatest(0, cx - cut // 2) AS x0, least(8, cx + cut // 2) AS x1, greatest(0, cy - cut // 2) AS y0, least(8, cy + cut // 2) AS y1 FROM b)
SELECT vec_id, x0, y0, x1, y1, round(1 - (x1 - x0) * (y1 - y0) / 64.0::DOUBLE, 6) AS lambda FROM k""")
def cutmix(spark, sf_dir):
    from weftline.operators import multi

    rows = table(spark, sf_dir, "embeddings").select("vec_id")
    boxed = rows.select("vec_id", multi.cut_box(F.col("vec_id"), 8, 8, seed=2, epoch=1).alias("b"))
    return boxed.select("vec_id", "b.x0", "b.y0", "b.x1", "b.y1", F.round("b.lambda", 6).alias("lambda"))

"""Queries of image tables, derived from the embeddings table: one 8x8 gray image a vector, 32x32 gray from 16, 32x32 colour from 48."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from ..operators.images import geometry, hog, hough, pixel, spectral, stencil, tables
from ..sources.images import tiled_images, vector_images
from .registry import query, table

PX = "CAST(least(255, greatest(0, floor((CAST(embedding[p + 1] AS DOUBLE) + 1) * 127.5))) AS INTEGER)"
GRAY = f"(SELECT vec_id AS image_id, CAST(p // 8 AS INTEGER) AS y, CAST(p % 8 AS INTEGER) AS x, {PX} AS v FROM embeddings, (SELECT unnest(range(64)) AS p))"
#: All places of a 32x32 image of ``per`` vectors; those of missing vectors are 0.
PLACES = "(SELECT image_id, CAST(a AS INTEGER) AS y, CAST(b AS INTEGER) AS x FROM (SELECT DISTINCT vec_id // {per} AS image_id FROM embeddings), (SELECT unnest(range(32)) AS a), (SELECT unnest(range(32)) AS b))"
BIG = f"(SELECT image_id, y, x, coalesce(f.v, 0) AS v FROM {PLACES.format(per=16)} LEFT JOIN (SELECT vec_id // 16 AS image_id, CAST(vec_id % 16 // 4 * 8 + p // 8 AS INTEGER) AS y, CAST(vec_id % 4 * 8 + p % 8 AS INTEGER) AS x, {PX} AS v FROM embeddings, (SELECT unnest(range(64)) AS p)) f USING (image_id, y, x))"
RGB = f"(SELECT image_id, y, x, coalesce(max(f.v) FILTER (c = 0), 0) AS b, coalesce(max(f.v) FILTER (c = 1), 0) AS g, coalesce(max(f.v) FILTER (c = 2), 0) AS r FROM {PLACES.format(per=48)} LEFT JOIN (SELECT vec_id // 48 AS image_id, vec_id % 48 // 16 AS c, CAST(vec_id % 48 % 16 // 4 * 8 + p // 8 AS INTEGER) AS y, CAST(vec_id % 48 % 4 * 8 + p % 8 AS INTEGER) AS x, {PX} AS v FROM embeddings, (SELECT unnest(range(64)) AS p)) f USING (image_id, y, x) GROUP BY 1, 2, 3)"


def gray(spark, d):
    return vector_images(table(spark, d, "embeddings"))


def gray_px(spark, d):
    return tables.explode_pixels(gray(spark, d)).drop("c")


def big(spark, d):
    return tiled_images(table(spark, d, "embeddings"))


def rgb(spark, d):
    return tables.wide_of_images(tiled_images(table(spark, d, "embeddings"), 3))


def px(images):
    return tables.explode_pixels(images).drop("c")


# --- pixel-wise --------------------------------------------------------------


@query("i1_explode_pack", f"SELECT * FROM {GRAY} g")
def i1(spark, d):
    return px(tables.pack_pixels(tables.explode_pixels(gray(spark, d))))


@query("i2_swap_channels", f"SELECT image_id, y, x, r AS b, g, b AS r FROM {RGB} p")
def i2(spark, d):
    return pixel.swap_channels(rgb(spark, d))


@query("i3_grayscale", f"SELECT image_id, y, x, round(CAST(0.2126 AS DOUBLE) * r + 0.7152 * g + 0.0722 * b, 6) AS v, CAST(trunc(round(0.299 * r + 0.587 * g + 0.114 * b, 9)) AS INTEGER) AS library FROM {RGB} p")
def i3(spark, d):
    p = rgb(spark, d)
    return p.select("image_id", "y", "x", F.round(pixel.gray_value(), 6).alias("v"), pixel.gray_value(truncate=True, library=True).alias("library"))


HSV = f"""(SELECT image_id, y, x, b, g, r, CASE WHEN hi = lo THEN 0.0 WHEN lo = b THEN 60 * (g - r) / (hi - lo) + 60 WHEN lo = r THEN 60 * (b - g) / (hi - lo) + 180 ELSE 60 * (r - b) / (hi - lo) + 300 END AS h, (hi - lo) AS s, hi AS v
 FROM (SELECT image_id, y, x, b / 255 AS b, g / 255 AS g, r / 255 AS r, greatest(b, g, r) / 255 AS hi, least(b, g, r) / 255 AS lo FROM {RGB} p))"""


@query("i4_bgr_to_hsv", f"SELECT image_id, y, x, round(h, 6) AS h, round(s, 6) AS s, round(v, 6) AS v FROM {HSV} p")
def i4(spark, d):
    return pixel.bgr_to_hsv(rgb(spark, d)).select("image_id", "y", "x", *[F.round(c, 6).alias(c) for c in "hsv"])


@query("i5_hue_shift", f"SELECT image_id, y, x, round((h + 180) - 360 * floor((h + 180) / 360), 6) AS h FROM {HSV} p")
def i5(spark, d):
    return pixel.hue_shift(pixel.bgr_to_hsv(rgb(spark, d))).select("image_id", "y", "x", F.round("h", 6).alias("h"))


def _rgb_of(h: str) -> str:
    t, c, m = f"({h} / 60)", "s", "(v - s)"
    xx = f"(s * (1 - abs(({t} - 2 * floor({t} / 2)) - 1)))"
    rows = [(c, xx, "0"), (xx, c, "0"), ("0", c, xx), ("0", xx, c), (xx, "0", c), (c, "0", xx)]
    part = lambda k: "CAST(trunc(round(255 * least(1, greatest(0, " + m + " + CASE " + " ".join(f"WHEN {t} >= {i} AND {t} < {i + 1} THEN {r[k]}" for i, r in enumerate(rows)) + " ELSE 0 END)), 6)) AS INTEGER)"
    return f"{part(0)} AS r, {part(1)} AS g, {part(2)} AS b"


@query("i6_hsv_to_rgb", f"SELECT image_id, y, x, {_rgb_of('((h + 180) - 360 * floor((h + 180) / 360))')} FROM {HSV} p")
def i6(spark, d):
    return pixel.hsv_to_rgb(pixel.hue_shift(pixel.bgr_to_hsv(rgb(spark, d)))).select("image_id", "y", "x", "r", "g", "b")


@query("i7_reduce_colors", f"SELECT image_id, y, x, b // 64 * 64 + 32 AS b, g // 64 * 64 + 32 AS g, r // 64 * 64 + 32 AS r FROM {RGB} p")
def i7(spark, d):
    return pixel.reduce_colors(rgb(spark, d))


@query("i8_color_histogram", f"WITH p AS {RGB}, u AS (SELECT image_id, 0 AS channel, b AS v FROM p UNION ALL SELECT image_id, 1, g FROM p UNION ALL SELECT image_id, 2, r FROM p), k AS (SELECT DISTINCT image_id, c AS channel, b AS bin FROM p, (SELECT unnest(range(3)) AS c), (SELECT unnest(range(4)) AS b)) SELECT k.image_id, CAST(k.channel AS INTEGER) AS channel, CAST(k.bin AS INTEGER) AS bin, count(v) AS n FROM k LEFT JOIN u ON u.image_id = k.image_id AND u.channel = k.channel AND v // 64 = bin GROUP BY 1, 2, 3".replace("range(4)) AS b)) SELECT", "range(4)) AS q)) SELECT").replace("c AS channel, b AS bin FROM p", "c AS channel, q AS bin FROM (SELECT DISTINCT image_id FROM p)"))
def i8(spark, d):
    return pixel.color_histogram(rgb(spark, d))


MEAN, STD = (0.5, 0.45, 0.4), (0.25, 0.2, 0.22)


@query("i9_normalize_channels", f"SELECT image_id, y, x, " + ", ".join(f"round(({c} / 255 - {m}) / {s}, 6) AS {c}, round({c} / 255, 6) AS back_{c}" for c, m, s in zip("rgb", MEAN, STD)) + f" FROM {RGB} p")
def i9(spark, d):
    n = pixel.normalize_channels(rgb(spark, d), MEAN, STD).withColumns({f"n_{c}": F.col(c) for c in "rgb"})
    back = pixel.denormalize(n, MEAN, STD)
    return back.select("image_id", "y", "x", *[F.round(f"n_{c}", 6).alias(c) for c in "rgb"], *[F.round(c, 6).alias(f"back_{c}") for c in "rgb"])


def normal(seed: int, a: str, b: str, keys: str) -> str:
    """A normal number by Box and Muller from the md5 draws tagged a and b."""
    u = lambda tag: f"((CAST(CAST('0x' || substr(md5('{seed}|{tag}|' || {keys}), 1, 15) AS BIGINT) AS DOUBLE) + 1) / CAST({16**15} AS DOUBLE))"
    return f"sqrt(-2 * ln({u(a)})) * cos(2 * pi() * {u(b)})"


@query("i10_add_noise", f"SELECT image_id, y, x, round(v + 0.1 * {normal(0, 'a', 'b', "image_id || '|' || y || '|' || x")}, 6) AS v FROM {GRAY} p")
def i10(spark, d):
    return pixel.add_noise(gray_px(spark, d), 0.1).withColumn("v", F.round("v", 6))


def _num(tag: str) -> str:
    return f"CAST('0x' || substr(md5('42|{tag}|' || image_id), 1, 15) AS BIGINT)"


@query("i11_random_flip_crop", f"""WITH f AS (SELECT image_id, y, CASE WHEN {_num('flip')} % 2 = 1 THEN 31 - x ELSE x END AS x, v FROM {BIG} p),
 t AS (SELECT image_id, CAST(a AS INTEGER) AS y, CAST(b AS INTEGER) AS x, {_num('dy')} % 9 - 4 AS dy, {_num('dx')} % 9 - 4 AS dx FROM (SELECT DISTINCT image_id FROM f), (SELECT unnest(range(32)) AS a), (SELECT unnest(range(32)) AS b))
 SELECT t.image_id, t.y, t.x, coalesce(v, 0) AS v FROM t LEFT JOIN f ON f.image_id = t.image_id AND f.y = t.y + dy AND f.x = t.x + dx""")
def i11(spark, d):
    return pixel.random_crop(pixel.random_flip(px(big(spark, d)), 32))


def _wheel() -> str:
    rows = [("v", "t", "0"), ("q", "v", "0"), ("0", "v", "t"), ("0", "q", "v"), ("t", "0", "v"), ("v", "0", "q")]
    part = lambda k: "round(CASE WHEN v > 1 THEN 1 " + " ".join(f"WHEN s = {i} THEN {r[k]}" for i, r in enumerate(rows)) + " END, 6)"
    return ", ".join(f"{part(k)} AS {c}" for k, c in enumerate("rgb"))


@query("i12_hsv_wheel", f"""WITH a AS (SELECT image_id, y, x, sqrt(CAST((x - 16) * (x - 16) + (y - 16) * (y - 16) AS DOUBLE)) / 16 AS v, round((atan2(y - 16, x - 16) + pi()) / (2 * pi()) * 6, 9) AS h FROM {BIG} p),
 w AS (SELECT image_id, y, x, v, CAST(floor(h) AS INTEGER) % 6 AS s, v * (1 - (h - floor(h))) AS q, v * (h - floor(h)) AS t FROM a) SELECT image_id, y, x, {_wheel()} FROM w""")
def i12(spark, d):
    return pixel.paint_wheel(px(big(spark, d)), 32).select("image_id", "y", "x", *[F.round(c, 6).alias(c) for c in "rgb"])


@query("i13_minmax_scale", f"SELECT image_id, y, x, round(coalesce((v - min(v) OVER w) / nullif(CAST(max(v) OVER w - min(v) OVER w AS DOUBLE), 0), 0) * 255, 6) AS v, round(v / max(v) OVER w, 6) AS m FROM {GRAY} p WINDOW w AS (PARTITION BY image_id)")
def i13(spark, d):
    p = gray_px(spark, d).withColumns({c: F.col("v").cast("double") for c in "vm"})
    both = pixel.minmax_scale(pixel.minmax_scale(p, top=255.0), "m", max_only=True)
    return both.withColumns({c: F.round(c, 6) for c in "vm"})


# --- neighbourhoods ----------------------------------------------------------


def _near(dy: int, dx: int, source: str = "p", miss: str = "0") -> str:
    return f"coalesce((SELECT q.v FROM {source} q WHERE q.image_id = p.image_id AND q.y = p.y + ({dy}) AND q.x = p.x + ({dx})), {miss})"


WINS = "lag(v) OVER r AS l, lead(v) OVER r AS rr, lag(v) OVER c AS u, lead(v) OVER c AS dd"
WINDOWS = "WINDOW r AS (PARTITION BY image_id, y ORDER BY x), c AS (PARTITION BY image_id, x ORDER BY y)"


@query("g1_laplacian", f"SELECT image_id, y, x, CAST(least(255, greatest(0, coalesce(l, 0) + coalesce(rr, 0) + coalesce(u, 0) + coalesce(dd, 0) - 4 * v)) AS BIGINT) AS v FROM (SELECT *, {WINS} FROM {GRAY} g {WINDOWS})")
def g1(spark, d):
    return px(stencil.laplacian(gray(spark, d))).withColumn("v", F.col("v").cast("long"))


@query("g2_abs_laplacian", f"SELECT image_id, y, x, CAST(least(255, abs(coalesce(l, rr) + coalesce(rr, l) + coalesce(u, dd) + coalesce(dd, u) - 4 * v)) AS BIGINT) AS v FROM (SELECT *, {WINS} FROM {GRAY} g {WINDOWS})")
def g2(spark, d):
    return px(stencil.abs_laplacian(gray(spark, d))).withColumn("v", F.col("v").cast("long"))


OFF = "(SELECT a - 1 AS dy, b - 1 AS dx FROM (SELECT unnest(range(3)) AS a), (SELECT unnest(range(3)) AS b))"
BLUR = f"WITH p AS {GRAY}, k AS (SELECT dy, dx, exp(-(dy * dy + dx * dx) / (2 * 1.3 * 1.3)) AS w FROM {OFF} o), z AS (SELECT p.image_id, p.y, p.x, sum(w * q.v) / (SELECT sum(w) FROM k) AS v FROM p, k JOIN p q ON q.image_id = p.image_id AND q.y = p.y + dy AND q.x = p.x + dx GROUP BY 1, 2, 3)"


@query("g3_gaussian_blur", f"WITH p AS {GRAY}, k AS (SELECT dy, dx, exp(-(dy * dy + dx * dx) / (2 * 1.3 * 1.3)) AS w FROM {OFF} o) SELECT p.image_id, p.y, p.x, CAST(floor(round(sum(w * q.v) / (SELECT sum(w) FROM k), 9)) AS BIGINT) AS v FROM p CROSS JOIN k JOIN p q ON q.image_id = p.image_id AND q.y = p.y + dy AND q.x = p.x + dx GROUP BY 1, 2, 3")
def g3(spark, d):
    return px(stencil.gaussian_blur(gray(spark, d))).withColumn("v", F.col("v").cast("long"))


def sobel_sql(source: str) -> str:
    """Sobel of the pixels ``source``: vertical fy and horizontal fx."""
    return f"""sob AS (SELECT p.image_id, p.y, p.x, least(255, greatest(0, sum(kv * q.v))) AS fy, least(255, greatest(0, sum(kh * q.v))) AS fx FROM {source} p
 CROSS JOIN (SELECT dy, dx, -dy * (2 - abs(dx)) AS kv, -dx * (2 - abs(dy)) AS kh FROM {OFF} o) k JOIN {source} q ON q.image_id = p.image_id AND q.y = p.y + dy AND q.x = p.x + dx GROUP BY 1, 2, 3)"""


def edge_sql(source: str) -> str:
    return f"""{sobel_sql(source)}, an AS (SELECT image_id, y, x, fy, fx, least(255.0, sqrt(CAST(fx * fx + fy * fy AS DOUBLE))) AS e, atan(fy / greatest(CAST(fx AS DOUBLE), 1e-10)) AS a FROM sob),
 ed AS (SELECT image_id, y, x, e, CASE WHEN q <= 22.5 THEN 0 WHEN q <= 67.5 THEN 45 WHEN q <= 112.5 THEN 90 WHEN q <= 157.5 THEN 135 ELSE 0 END AS band FROM (SELECT *, round(CASE WHEN degrees(a) < -22.5 THEN degrees(a) + 180 ELSE degrees(a) END, 9) AS q FROM an))"""


SOB, EDGE = sobel_sql(GRAY), edge_sql(GRAY)


@query("g4_sobel", f"WITH {SOB} SELECT image_id, y, x, CAST(fy AS BIGINT) AS fy, CAST(fx AS BIGINT) AS fx FROM sob")
def g4(spark, d):
    return sob(spark, d).select("image_id", "y", "x", F.col("fy").cast("long").alias("fy"), F.col("fx").cast("long").alias("fx"))


def sob(spark, d):
    p = stencil.sobel(gray(spark, d))
    at = F.transform(F.sequence(F.lit(0), F.expr("height * width - 1")), lambda k: F.struct(k.alias("k"), F.get("data", k * 2).cast("double").alias("fy"), F.get("data", k * 2 + 1).cast("double").alias("fx")))
    p = p.select("image_id", "width", F.inline(at))
    return p.select("image_id", F.expr("cast(k div width as int)").alias("y"), (F.col("k") % F.col("width")).alias("x"), "fy", "fx")


def edge_px(spark, d):
    s = sob(spark, d)
    return s.select("image_id", "y", "x", stencil.edge_strength(F.col("fx"), F.col("fy")).alias("e"), stencil.quantize_angle(stencil.edge_angle(F.col("fx"), F.col("fy"))).alias("band"))


@query("g5_edge_strength_angle", f"WITH {EDGE} SELECT image_id, y, x, round(e, 6) AS e, band FROM ed")
def g5(spark, d):
    return edge_px(spark, d).withColumn("e", F.round("e", 6))


def suppress_sql(source: str, last: int) -> str:
    return f"""{edge_sql(source)}, st AS (SELECT 0 AS band, 0 AS dy, -1 AS dx UNION ALL SELECT 0, 0, 1 UNION ALL SELECT 45, 1, -1 UNION ALL SELECT 45, -1, 1 UNION ALL SELECT 90, -1, 0 UNION ALL SELECT 90, 1, 0 UNION ALL SELECT 135, -1, -1 UNION ALL SELECT 135, 1, 1),
 nb AS (SELECT a.image_id, a.y, a.x, a.e, max(b.e) AS top FROM ed a JOIN st ON st.band = a.band JOIN ed b ON b.image_id = a.image_id AND b.y = greatest(0, least({last}, a.y + dy)) AND b.x = greatest(0, least({last}, a.x + dx)) GROUP BY 1, 2, 3, 4)"""


NMS = suppress_sql(GRAY, 7)


@query("g6_non_max_suppress", f"WITH {NMS} SELECT image_id, y, x, CASE WHEN top > e THEN 0.0 ELSE round(e, 6) END AS e FROM nb".replace("THEN 0.0 ELSE", "THEN CAST(0 AS DOUBLE) ELSE"))
def g6(spark, d):
    e = edge_px(spark, d)
    two = e.select("image_id", "y", "x", F.inline(F.array(F.struct(F.lit(0).alias("c"), F.col("e").alias("v")), F.struct(F.lit(1).alias("c"), F.col("band").cast("double").alias("v")))))
    out = stencil.non_max_suppress(tables.pack_pixels(two))
    return px(out).select("image_id", "y", "x", F.round("v", 6).alias("e"))


def hysteresis_sql(source: str, high: int, low: int, side: int = 32) -> str:
    """One raster pass over ``source`` (image_id, y, x, v), pixel by pixel: ``seen`` holds the last side + 1 results, ``e`` all first values."""
    first = f"CASE WHEN v >= {high} THEN 255 WHEN v <= {low} THEN 0 ELSE v END"
    x, k = f"((p + 1) % {side})", "(p + 2)"  # column and 1-based place of the next pixel
    left, right = f"{x} > 0", f"{x} < {side - 1}"
    near = f"""greatest(CASE WHEN {left} THEN seen[{side + 1}] ELSE 0 END, CASE WHEN {left} THEN seen[1] ELSE 0 END, seen[2], CASE WHEN {right} THEN seen[3] ELSE 0 END,
     CASE WHEN {right} THEN coalesce(e[{k} + 1], 0) ELSE 0 END, CASE WHEN {left} THEN coalesce(e[{k} + {side - 1}], 0) ELSE 0 END, coalesce(e[{k} + {side}], 0), CASE WHEN {right} THEN coalesce(e[{k} + {side + 1}], 0) ELSE 0 END)"""
    v = f"CASE WHEN e[{k}] > 0 AND e[{k}] < {high} THEN CASE WHEN {near} >= {high} THEN 255 ELSE 0 END ELSE e[{k}] END"
    return f"""im AS MATERIALIZED (SELECT image_id, list(CAST({first} AS DOUBLE) ORDER BY y, x) AS e FROM {source} z GROUP BY 1),
 walk AS (SELECT image_id, -1 AS p, CAST(0 AS DOUBLE) AS v, list_transform(range({side + 1}), lambda i: CAST(0 AS DOUBLE)) AS seen FROM im
 UNION ALL SELECT image_id, p + 1, v, list_append(seen[2:], v) FROM (SELECT image_id, p, seen, CAST({v} AS DOUBLE) AS v FROM walk JOIN im USING (image_id) WHERE p < {side * side - 1}))
 SELECT image_id, CAST(p // {side} AS INTEGER) AS y, CAST(p % {side} AS INTEGER) AS x, CAST(v AS INTEGER) AS v FROM walk WHERE p >= 0"""


@query("g7_hysteresis", f"WITH RECURSIVE {hysteresis_sql(BIG, 160, 100)}")
def g7(spark, d):
    return px(stencil.hysteresis(big(spark, d), 160, 100))


WIDE = "(SELECT a - 2 AS dy, b - 2 AS dx FROM (SELECT unnest(range(5)) AS a), (SELECT unnest(range(5)) AS b))"
CANNY = f"""big AS MATERIALIZED {BIG}, k AS (SELECT dy, dx, exp(-(dy * dy + dx * dx) / (2 * 1.4 * 1.4)) AS w FROM {WIDE} o),
 soft AS MATERIALIZED (SELECT p.image_id, p.y, p.x, floor(round(sum(w * q.v) / (SELECT sum(w) FROM k), 9)) AS v FROM big p CROSS JOIN k JOIN big q ON q.image_id = p.image_id AND q.y = p.y + dy AND q.x = p.x + dx GROUP BY 1, 2, 3),
 {suppress_sql("soft", 31)}, thin AS (SELECT image_id, y, x, CASE WHEN top > e THEN 0 ELSE e END AS v FROM nb)"""


@query("g8_canny", f"WITH RECURSIVE {CANNY}, {hysteresis_sql('thin', 100, 30)}")
def g8(spark, d):
    return px(stencil.canny(big(spark, d)))


@query("g9_resize_nearest", f"SELECT p.image_id, CAST(a AS INTEGER) AS y, CAST(b AS INTEGER) AS x, p.v FROM {GRAY} p, (SELECT unnest(range(12)) AS a), (SELECT unnest(range(12)) AS b) WHERE p.y = least(7, CAST(floor(round(a / 1.5, 9)) AS INTEGER)) AND p.x = least(7, CAST(floor(round(b / 1.5, 9)) AS INTEGER))")
def g9(spark, d):
    return geometry.resize_nearest(gray_px(spark, d), 8, 8, 1.5).select("image_id", "y", "x", "v")


def at(p: str) -> str:
    """Pixel number ``p`` of the 8x8 image of a vector."""
    return f"CAST(least(255, greatest(0, floor((CAST(embedding[({p}) + 1] AS DOUBLE) + 1) * 127.5))) AS INTEGER)"


BIL = f"""WITH t AS (SELECT a, b, a / 1.5 AS sy, b / 1.5 AS sx, least(7, CAST(floor(round(a / 1.5, 9)) AS INTEGER)) AS y1, least(7, CAST(floor(round(b / 1.5, 9)) AS INTEGER)) AS x1 FROM (SELECT unnest(range(12)) AS a), (SELECT unnest(range(12)) AS b)),
 q AS (SELECT vec_id AS image_id, a, b, sy - y1 AS fy, sx - x1 AS fx, {at('y1 * 8 + x1')} AS q11, {at('y1 * 8 + least(7, x1 + 1)')} AS q21, {at('least(7, y1 + 1) * 8 + x1')} AS q12, {at('least(7, y1 + 1) * 8 + least(7, x1 + 1)')} AS q22 FROM embeddings, t)
 SELECT image_id, CAST(a AS INTEGER) AS y, CAST(b AS INTEGER) AS x, CAST(floor(round(q11 * (1 - fx) * (1 - fy) + q21 * (1 - fx) * fy + q12 * fx * (1 - fy) + q22 * fx * fy, 9)) AS BIGINT) AS v FROM q"""


@query("g10_resize_bilinear", BIL)
def g10(spark, d):
    return px(geometry.resize_bilinear(gray(spark, d), 1.5)).withColumn("v", F.col("v").cast("long"))


COS, SIN = round(math.cos(math.radians(30)), 12), round(math.sin(math.radians(30)), 12)


@query("g11_affine", f"SELECT image_id, ny AS y, nx AS x, max_by(v, y * 8 + x) AS v FROM (SELECT image_id, y, x, v, CAST(trunc(round(x * {COS} - y * {SIN} + 2, 9)) AS INTEGER) AS nx, CAST(trunc(round(x * {SIN} + y * {COS} - 1, 9)) AS INTEGER) AS ny FROM {GRAY} p) WHERE nx BETWEEN 0 AND 7 AND ny BETWEEN 0 AND 7 GROUP BY 1, 2, 3")
def g11(spark, d):
    return geometry.affine(gray_px(spark, d), 8, 8, 2, -1, math.radians(30))


TPL = [[120, 130], [140, 110]]
SSD = f"""WITH s AS (SELECT vec_id AS image_id, dy, dx, {' + '.join(f"power({at(f'(dy + {ty}) * 8 + dx + {tx}')} - {v}, 2)" for ty, r in enumerate(TPL) for tx, v in enumerate(r))} AS ssd FROM embeddings, (SELECT unnest(range(6)) AS dy), (SELECT unnest(range(6)) AS dx)),
 m AS (SELECT image_id, min_by(dy, ssd * 100 + dy * 8 + dx) AS y, min_by(dx, ssd * 100 + dy * 8 + dx) AS x, CAST(min(ssd) AS DOUBLE) AS ssd FROM s GROUP BY 1)"""


@query("g12_template_match", SSD + " SELECT image_id, y, x, ssd FROM m")
def g12(spark, d):
    return geometry.template_match(gray(spark, d), np.array(TPL))


@query("g12_template_match_pixels", SSD + " SELECT image_id, y, x, ssd FROM m")
def g12p(spark, d):
    t = spark.createDataFrame([(y, x, v) for y, r in enumerate(TPL) for x, v in enumerate(r)], "y int, x int, v int")
    return geometry.template_match_pixels(gray_px(spark, d), t, 8, 8, 2, 2).withColumn("ssd", F.col("ssd").cast("double"))


@query("g13_draw_box", SSD + f", p AS (SELECT * FROM {GRAY} g)" + " SELECT p.image_id, p.y, p.x, CASE WHEN (p.x BETWEEN m.x AND m.x + 2 AND p.y IN (m.y, m.y + 2)) OR (p.y BETWEEN m.y AND m.y + 2 AND p.x IN (m.x, m.x + 2)) THEN 255 ELSE v END AS v FROM p JOIN m USING (image_id)")
def g13(spark, d):
    return geometry.draw_box(gray_px(spark, d), geometry.template_match(gray(spark, d), np.array(TPL)), 2, 2)


# --- frequency ---------------------------------------------------------------

DFT = f"""(SELECT image_id, CAST(u AS INTEGER) AS u, CAST(w AS INTEGER) AS v, sum(p.v * cos(-2 * pi() * (p.y * u + p.x * w) / 8)) AS re, sum(p.v * sin(-2 * pi() * (p.y * u + p.x * w) / 8)) AS im FROM {GRAY} p, (SELECT unnest(range(8)) AS u), (SELECT unnest(range(8)) AS w) GROUP BY 1, 2, 3)"""


def z4(c: str) -> str:
    return f"round({c}, 4) + 0.0 AS {c}"


@query("f1_dft2d", f"SELECT image_id, u, v, {z4('re')}, {z4('im')} FROM {DFT} f")
def f1(spark, d):
    return spectral.dft2d(gray(spark, d)).select("image_id", "u", "v", *[(F.round(c, 4) + 0.0).alias(c) for c in ("re", "im")])


@query("f1_idft2d", f"SELECT image_id, y, x, CAST(coalesce(floor(round((v - min(v) OVER w) / nullif(CAST(max(v) OVER w - min(v) OVER w AS DOUBLE), 0) * 255, 6)), 0) AS BIGINT) AS v FROM {GRAY} p WINDOW w AS (PARTITION BY image_id)")
def f1i(spark, d):
    f = spectral.dft2d(gray(spark, d))
    two = f.select("image_id", F.col("u").alias("y"), F.col("v").alias("x"), F.inline(F.array(F.struct(F.lit(0).alias("c"), F.col("re").alias("v")), F.struct(F.lit(1).alias("c"), F.col("im").alias("v")))))
    return px(spectral.idft2d(tables.pack_pixels(two))).withColumn("v", F.col("v").cast("long"))


@query("f2_quadrant_shift", f"SELECT image_id, (u + 4) % 8 AS u, (v + 4) % 8 AS v, {z4('re')} FROM {DFT} f")
def f2(spark, d):
    return spectral.quadrant_shift(spectral.dft2d(gray(spark, d)), 8, 8).select("image_id", "u", "v", (F.round("re", 4) + 0.0).alias("re"))


LOW = f"""WITH k AS (SELECT u, w FROM (SELECT unnest(range(32)) AS u), (SELECT unnest(range(32)) AS w) WHERE power((u + 16) % 32 - 16, 2) + power((w + 16) % 32 - 16, 2) <= 64),
 f AS (SELECT image_id, u, w, sum(p.v * cos(-2 * pi() * ((p.y * u + p.x * w) % 32) / 32)) AS re, sum(p.v * sin(-2 * pi() * ((p.y * u + p.x * w) % 32) / 32)) AS im FROM {BIG} p, k GROUP BY 1, 2, 3),
 b AS (SELECT image_id, y, x, round(sum(re * cos(2 * pi() * ((y * u + x * w) % 32) / 32) - im * sin(2 * pi() * ((y * u + x * w) % 32) / 32)) / 1024, 9) AS r FROM f, (SELECT unnest(range(32)) AS y), (SELECT unnest(range(32)) AS x) GROUP BY 1, 2, 3)
 SELECT image_id, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, CAST(floor(round((r - min(r) OVER q) / (max(r) OVER q - min(r) OVER q) * 255, 6)) AS BIGINT) AS v FROM b WINDOW q AS (PARTITION BY image_id)"""


@query("f3_low_pass", LOW)
def f3(spark, d):
    return px(spectral.low_pass(big(spark, d))).withColumn("v", F.col("v").cast("long"))


@query("f4_log_spectrum", f"SELECT image_id, u, v, round(ln(sqrt(re * re + im * im) + 1), 4) AS log_abs FROM {DFT} f")
def f4(spark, d):
    return spectral.log_spectrum(spectral.dft2d(gray(spark, d))).select("image_id", "u", "v", F.round("log_abs", 4).alias("log_abs"))


# --- oriented gradients ------------------------------------------------------

GRA = f"(SELECT image_id, y, x, gx, gy, sqrt(gx * gx + gy * gy) AS mag, round(CASE WHEN degrees(atan2(gy, gx)) < 0 THEN degrees(atan2(gy, gx)) + 180 ELSE degrees(atan2(gy, gx)) END, 9) AS ang FROM (SELECT image_id, y, x, CAST(CASE WHEN ok THEN rr - l ELSE 0 END AS DOUBLE) AS gx, CAST(CASE WHEN ok THEN dd - u ELSE 0 END AS DOUBLE) AS gy FROM (SELECT *, l IS NOT NULL AND rr IS NOT NULL AND u IS NOT NULL AND dd IS NOT NULL AS ok FROM (SELECT image_id, y, x, v, {WINS} FROM {BIG} g {WINDOWS}))))"
GRB = f"(SELECT image_id, y, x, gx, gy, sqrt(gx * gx + gy * gy) AS mag, round(CASE WHEN degrees(atan(gy / gx)) < 0 THEN degrees(atan(gy / gx)) + 180 ELSE degrees(atan(gy / gx)) END, 9) AS ang FROM (SELECT image_id, y, x, CASE WHEN coalesce(rr, v) = coalesce(l, v) THEN 1e-6 ELSE CAST(coalesce(rr, v) - coalesce(l, v) AS DOUBLE) END AS gx, CAST(coalesce(dd, v) - coalesce(u, v) AS DOUBLE) AS gy FROM (SELECT image_id, y, x, v, {WINS} FROM {BIG} g {WINDOWS})))"


@query("h1_gradients_a", f"SELECT image_id, y, x, gx, gy, round(mag, 6) AS mag, round(ang, 6) AS ang FROM {GRA} g")
def h1a(spark, d):
    return hog.gradients(big(spark, d)).withColumns({c: F.round(c, 6) for c in ("mag", "ang")})


@query("h1_gradients_b", f"SELECT image_id, y, x, round(gx, 6) AS gx, gy, round(mag, 6) AS mag, round(ang, 6) AS ang FROM {GRB} g")
def h1b(spark, d):
    return hog.gradients(big(spark, d), "B").withColumns({c: F.round(c, 6) for c in ("gx", "mag", "ang")})


BINA, BINB = "CASE WHEN floor(ang / 20) BETWEEN 0 AND 8 THEN CAST(floor(ang / 20) AS INTEGER) ELSE 0 END", "least(8, greatest(0, CAST(floor(ang / 20) AS INTEGER)))"


@query("h2_quantize_orientation", f"SELECT a.image_id, a.y, a.x, {BINA.replace('ang', 'a.ang')} AS bin_a, {BINB.replace('ang', 'b.ang')} AS bin_b FROM {GRA} a JOIN {GRB} b USING (image_id, y, x)")
def h2(spark, d):
    return hog.orientations(big(spark, d))


CELL = f"(SELECT image_id, cy, cx, CAST(b AS INTEGER) AS bin, sum(CASE WHEN bin = b THEN mag ELSE 0 END) AS m FROM (SELECT image_id, y // 8 AS cy, x // 8 AS cx, {BINA} AS bin, mag FROM {GRA} g), (SELECT unnest(range(9)) AS b) GROUP BY 1, 2, 3, 4)"


@query("h3_cell_histogram", f"SELECT image_id, cy, cx, bin, round(m, 6) AS m FROM {CELL} c")
def h3(spark, d):
    return hog.cell_histogram(big(spark, d)).withColumn("m", F.round("m", 6))


NORM = f"WITH c AS {CELL}, t AS (SELECT image_id, cy, cx, sum(m) AS t FROM c GROUP BY 1, 2, 3), n AS (SELECT a.image_id, a.cy, a.cx, sum(b.t) AS s FROM t a JOIN t b ON b.image_id = a.image_id AND abs(b.cy - a.cy) <= 1 AND abs(b.cx - a.cx) <= 1 GROUP BY 1, 2, 3) SELECT c.image_id, c.cy, c.cx, bin, round(m / sqrt(s + 1), 6) AS m FROM c JOIN n USING (image_id, cy, cx)"


@query("h4_normalize_blocks", NORM)
def h4(spark, d):
    return hog.hog(big(spark, d)).select("image_id", "cy", "cx", "bin", F.round("m", 6).alias("m"))


@query("h5_hog_a", NORM)
def h5a(spark, d):
    return hog.hog(big(spark, d)).select("image_id", "cy", "cx", "bin", F.round("m", 6).alias("m"))


#: Cells are divided one after the other, in raster order: near[i] are the cells around the i-th, as they stand at that moment.
HOGB = f"""WITH RECURSIVE c AS (SELECT image_id, cy * 4 + cx AS i, list(m ORDER BY b) AS m FROM (SELECT image_id, y // 8 AS cy, x // 8 AS cx, b, sum(CASE WHEN {BINB} = b THEN mag ELSE 0 END) AS m FROM {GRB} g, (SELECT unnest(range(9)) AS b) GROUP BY 1, 2, 3, 4) GROUP BY 1, 2),
 r AS (SELECT image_id, 0 AS n, list(m ORDER BY i) AS h FROM c GROUP BY 1
  UNION ALL SELECT image_id, n + 1, list_transform(range(1, 17), lambda i: CASE WHEN i = n + 1 THEN list_transform(h[i], lambda v: v / sqrt(1 + list_sum(list_transform(list_filter(range(1, 17), lambda j: abs((j - 1) // 4 - (i - 1) // 4) <= 1 AND abs((j - 1) % 4 - (i - 1) % 4) <= 1), lambda j: list_sum(list_transform(h[j], lambda w: w * w)))))) ELSE h[i] END) FROM r WHERE n < 16)
 SELECT image_id, CAST(i // 4 AS INTEGER) AS cy, CAST(i % 4 AS INTEGER) AS cx, CAST(b AS INTEGER) AS bin, round(h[i + 1][b + 1], 6) AS m FROM r, (SELECT unnest(range(16)) AS i), (SELECT unnest(range(9)) AS b) WHERE n = 16"""


@query("h5_hog_b", HOGB)
def h5b(spark, d):
    return hog.hog(big(spark, d), "B").withColumn("m", F.round("m", 6))


# --- lines -------------------------------------------------------------------

TH = "(SELECT CAST(t AS INTEGER) AS theta, round(cos(radians(t)), 12) AS c, round(sin(radians(t)), 12) AS s FROM (SELECT unnest(range(180)) AS t))"
VOTE = f"vt AS (SELECT image_id, CAST(trunc(round(x * c + y * s, 9)) AS INTEGER) + 45 AS rho, theta, count(*) AS votes FROM (SELECT * FROM {BIG} p WHERE v >= 165), {TH} t GROUP BY 1, 2, 3)"
PEAK = f"{VOTE}, pk AS (SELECT a.* FROM vt a LEFT JOIN vt u ON u.image_id = a.image_id AND u.rho = a.rho - 1 AND u.theta = a.theta LEFT JOIN vt l ON l.image_id = a.image_id AND l.rho = a.rho AND l.theta = a.theta - 1 LEFT JOIN vt d ON d.image_id = a.image_id AND d.rho = a.rho - 1 AND d.theta = a.theta - 1 WHERE a.rho >= 1 AND a.theta >= 1 AND a.votes >= greatest(coalesce(u.votes, 0), coalesce(l.votes, 0), coalesce(d.votes, 0)))"
LINE = f"{PEAK}, ln AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY image_id ORDER BY votes DESC, rho, theta) AS INTEGER) AS line FROM pk) WHERE line <= 20)"


def edges(spark, d):
    """Gray images, 255 where the value is 165 or more, else 0."""
    return big(spark, d).withColumn("data", F.transform("data", lambda v: F.when(v >= 165, 255).otherwise(0)))


@query("v1_hough_votes", f"WITH {VOTE} SELECT * FROM vt")
def v1(spark, d):
    return hough.hough_votes(edges(spark, d))


@query("v2_hough_peaks", f"WITH {PEAK} SELECT image_id, rho, theta, votes FROM pk")
def v2(spark, d):
    return hough.hough_peaks(edges(spark, d))


@query("v3_top_lines", f"WITH {LINE} SELECT image_id, rho, theta, votes, line FROM ln")
def v3(spark, d):
    return hough.top_lines(edges(spark, d))


@query("v4_draw_lines", f"""WITH {LINE}, z AS (SELECT ln.*, c, s, CAST(rho - 45 AS DOUBLE) AS r FROM ln JOIN {TH} t USING (theta)), k AS (SELECT CAST(unnest(range(32)) AS INTEGER) AS k)
 SELECT DISTINCT image_id, y, x FROM (SELECT image_id, CAST(trunc(round(-(c / s) * k + r / s, 9)) AS BIGINT) AS y, k AS x FROM z, k WHERE s <> 0 UNION ALL SELECT image_id, k, CAST(trunc(round(-(s / c) * k + r / c, 9)) AS BIGINT) FROM z, k WHERE c <> 0) WHERE y BETWEEN 0 AND 31 AND x BETWEEN 0 AND 31""")
def v4(spark, d):
    return hough.draw_lines(edges(spark, d)).select("image_id", F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"))

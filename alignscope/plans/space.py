"""Queries on grids, colours and rotations."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import color
from ..operators import geometry, quantiles, rotation
from . import fixtures as fx
from .fixtures import sql
from .registry import query

_W = "w as (select p, g, case when g = floor(f) then 1 - (f - floor(f)) else f - floor(f) end as wt from (select p, f, unnest(list_distinct([cast(floor(f) as int), least(cast(floor(f) as int) + 1, 3)])) as g from (select p, least(greatest((p - 2) / 4.0, 0.0), 3.0) as f from range(16) t(p))))"


def _with(names: str, extra: str, body: str) -> str:
    return sql(names, "").rstrip() + f", {extra} {body}"


@query("ten_upsample_linear", _with("act", _W, "select cast(image as bigint) as image, unit, cast(wy.p as int) as y, cast(wx.p as int) as x, round(sum(value * wy.wt * wx.wt), 6) + 0.0 as value from act join w wy on act.y = wy.g join w wx on act.x = wx.g group by all"))
def ten_upsample_linear(spark, d):
    return geometry.upsample(fx.activations(spark, d), 4, 16, 2, 4).select("image", "unit", "y", "x", (F.round("value", 6) + 0.0).alias("value"))


@query("jn_upsample", _with("act thr", _W, "select unit, count(*) as n from (select image, act.unit as unit, wy.p as y, wx.p as x, round(sum(value * wy.wt * wx.wt), 6) as v from act join w wy on act.y = wy.g join w wx on act.x = wx.g group by all) u join thr using (unit) where v > round(threshold, 3) group by unit"))
def jn_upsample(spark, d):
    """Masked pixels after upsampling; units of images whose largest value is too small aren't upsampled at all."""
    act = fx.activations(spark, d)
    limits = quantiles.thresholds(act).withColumn("threshold", F.round("threshold", 3))
    some = act.join(quantiles.candidate_units(quantiles.image_maxima(act), limits), ["image", "unit"], "left_semi")
    up = geometry.upsample(some, 4, 16, 2, 4).withColumn("value", F.round("value", 6))
    return quantiles.masks(up, limits).groupBy("unit").agg(F.count(F.lit(1)).alias("n"))


@query("ten_zoom_nearest", sql("pl", "select cast(image as bigint) as image, cast(b.p as int) as y, cast(c.p as int) as x, label from pl join (select p, cast(floor(p * 3 / 7.0 + 0.5) as int) as o from range(8) t(p)) b on y = b.o join (select p, cast(floor(p * 3 / 7.0 + 0.5) as int) as o from range(8) t(p)) c on x = c.o"))
def ten_zoom_nearest(spark, d):
    return geometry.zoom_nearest(fx.pixel_labels(spark, d), 4, 8).select("image", "y", "x", "label")


@query("ten_crop", sql("pl", "select cast(image as bigint) as image, y - 1 as y, x - 2 as x, label from pl where y >= 1 and y < 4 and x >= 2 and x < 5"))
def ten_crop(spark, d):
    return geometry.crop(fx.pixel_labels(spark, d), 1, 2, 3, 3)


#: A small convolutional network: kernel, stride and padding of each layer, and what it reads.
LAYERS = {"conv1": (11, 4, 0), "pool1": (3, 2, 0), "conv2": (5, 1, 2), "pool2": (3, 2, 0), "conv3": (3, 1, 1), "skip": (1, 1, 0), "sum": (1, 1, 0)}
EDGES = [("data", "conv1"), ("conv1", "pool1"), ("pool1", "conv2"), ("conv2", "pool2"), ("pool2", "conv3"), ("pool2", "skip"), ("conv3", "sum"), ("skip", "sum")]


def _fields():
    return geometry.composed_fields(EDGES, {n: geometry.convolution(k, s, p) for n, (k, s, p) in LAYERS.items()})


@query("ten_fieldmap", "select * from (values ('data', 0, 1, 1), ('conv1', 0, 11, 4), ('pool1', 0, 19, 8), ('conv2', -16, 51, 8), ('pool2', -16, 67, 16), ('conv3', -32, 99, 16), ('skip', -16, 67, 16), ('sum', -32, 99, 16)) t(layer, field_offset, field_size, field_step)")
def ten_fieldmap(spark, d):
    return spark.createDataFrame([(n, f.offset, f.size, f.step) for n, f in _fields().items()], "layer string, field_offset int, field_size int, field_step int")


@query("gr_composed", "select layer, field_size from (values ('conv3', 99), ('skip', 67), ('sum', 99)) t(layer, field_size)")
def gr_composed(spark, d):
    return spark.createDataFrame([(n, f.size) for n, f in _fields().items() if n in ("conv3", "skip", "sum")], "layer string, field_size int")


@query("gr_topo", "select * from (values (0, 'data'), (1, 'conv1'), (2, 'pool1'), (3, 'conv2'), (4, 'pool2'), (5, 'conv3'), (6, 'skip'), (7, 'sum')) t(place, layer)")
def gr_topo(spark, d):
    return spark.createDataFrame(list(enumerate(geometry.topological(EDGES))), "place int, layer string")


@query("gr_bfs", "select * from (values (0, 'conv1'), (1, 'pool1'), (2, 'conv2'), (3, 'pool2'), (4, 'conv3'), (5, 'sum')) t(place, layer)")
def gr_bfs(spark, d):
    return spark.createDataFrame(list(enumerate(geometry.shortest_path(EDGES, "conv1", "sum"))), "place int, layer string")


@query("ten_center", "select cast(k as int) as cell, cast(-32 + k * 16 + 49 as int) as center, cast(-32 + k * 16 as int) as first_pixel, cast(-32 + k * 16 + 99 as int) as after_pixel from range(13) t(k)")
def ten_center(spark, d):
    f = _fields()["sum"]
    return spark.createDataFrame([(k, f.center(k), *f.pixels(k)) for k in range(13)], "cell int, center int, first_pixel int, after_pixel int")


@query("ten_receptive", "select cast(k as int) as cell, cast(k * 4 as int) as first_pixel, cast(k * 4 + 11 as int) as after_pixel from range(55) t(k)")
def ten_receptive(spark, d):
    f = _fields()["conv1"]
    return spark.createDataFrame([(k, *f.pixels(k)) for k in range(55)], "cell int, first_pixel int, after_pixel int")


@query("ten_upsampled_shape", "select 13 as cells, (12 * 16 + 99 - 64) as pixels, (12 * 16 + 99 - 64) // 2 as reduced")
def ten_upsampled_shape(spark, d):
    f = _fields()["sum"]
    return spark.createDataFrame([(13, geometry.upsampled_length(13, f), geometry.upsampled_length(13, f, 2))], "cells int, pixels int, reduced int")


def _rgb(spark, d):
    c = lambda k: (F.col("l_partkey") * k % 256).cast("int")
    return fx.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("image"), F.col("l_linenumber").alias("pos"), c(7).alias("r"), c(31).alias("g"), c(101).alias("b"))


def _nearest_sql() -> str:
    mid = lambda n: f"(({n} // 8) * 8 + 3.5)"
    far = ", ".join(f"{{'d': ({mid('r')} - {r}) ** 2 + ({mid('g')} - {g}) ** 2 + ({mid('b')} - {b}) ** 2, 'i': {i}}}" for i, (_, r, g, b) in enumerate(color.COLORS))
    return f"(select image, pos, cast(list_min([{far}]).i as int) as color from (select l_orderkey as image, l_linenumber as pos, l_partkey * 7 % 256 as r, l_partkey * 31 % 256 as g, l_partkey * 101 % 256 as b from lineitem))"


@query("color_label", f"select image, pos, color from {_nearest_sql()}")
def color_label(spark, d):
    return color.label_colors(_rgb(spark, d), color.color_table(spark)).select("image", "pos", "color")


@query("jn_color_lut", f"select color, count(*) as n from {_nearest_sql()} group by color")
def jn_color_lut(spark, d):
    return color.label_colors(_rgb(spark, d), color.color_table(spark)).groupBy("color").agg(F.count(F.lit(1)).alias("n"))


@query("agg_major_color", f"select image, pos, case when n > 0.3 * total then color end as color from (select image, pos, color, count(*) over (partition by image, color) as n, count(*) over (partition by image) as total from {_nearest_sql()})")
def agg_major_color(spark, d):
    return color.major_colors(color.label_colors(_rgb(spark, d), color.color_table(spark)).select("image", "pos", "color"), 0.3).select("image", "pos", "color")


@query("color_posterize", f"select color, count(*) as n, cast(sum(r + g + b) as bigint) as s from (select c.color as color, t.r as r, t.g as g, t.b as b from {_nearest_sql()} c join (values " + ", ".join(f"({i}, {r}, {g}, {b})" for i, (_, r, g, b) in enumerate(color.COLORS)) + ") t(color, r, g, b) on c.color = t.color) group by color")
def color_posterize(spark, d):
    p = color.posterize(color.label_colors(_rgb(spark, d), color.color_table(spark)))
    return p.groupBy("color").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("r") + F.col("g") + F.col("b")).alias("s"))


_ANGLES = [(0, 0, "cos"), (0, 1, "-sin"), (1, 0, "sin"), (1, 1, "cos")]


def _matrix():
    """Turns units 0 and 1 by a tenth of a turn, and leaves the others."""
    t = 2 * math.pi / 10
    value = {"cos": math.cos(t), "sin": math.sin(t), "-sin": -math.sin(t)}
    return [(b, a, value[k]) for a, b, k in _ANGLES] + [(u, u, 1.0) for u in (2, 3)]


@query("la_rotate_units", sql("act", f"select cast(image as bigint) as image, o as unit, y, x, round(sum(w * value), 6) as value from act join (values {', '.join(f'({u}, {o}, cast({w!r} as double))' for u, o, w in _matrix())}) t(u, o, w) on unit = u group by all"))
def la_rotate_units(spark, d):
    matrix = spark.createDataFrame(_matrix(), "unit int, out int, w double")
    out = rotation.rotate_units(fx.activations(spark, d), matrix)
    return out.select("image", "unit", "y", "x", F.round("value", 6).alias("value"))


@query("la_rotation", "select cast(unnest([0, 0.25, 0.5, 1]) as double) as power, true as orthogonal, true as turns, true as unpermuted")
def la_rotation(spark, d):
    """Powers of a random rotation: whether they are rotations, turn by that part of its largest angle, and are found again
    from their rows in another order."""
    import numpy as np

    base = rotation.random_rotation(16, 5)
    most = np.abs(np.angle(np.linalg.eigvals(base))).max()
    made = [(p, rotation.power(base, p)) for p in (0.0, 0.25, 0.5, 1.0)]
    mixed = rotation.near_identity(16, 0.05, 5)
    found = bool(np.allclose(rotation.unpermuted(mixed[::-1]), mixed))
    return spark.createDataFrame([(p, bool(np.allclose(r @ r.T, np.eye(16))), bool(np.isclose(rotation.deviation(r), 2 * np.sin(p * most / 2))), found) for p, r in made], "power double, orthogonal boolean, turns boolean, unpermuted boolean")


@query("ten_overlay", sql("m2 act", "select cast(act.image as bigint) as image, act.unit as unit, act.y as y, act.x as x, round((case when m2.unit is null then 0.2 else 1.0 end) * value, 6) as value from act left join m2 on act.image = m2.image and act.unit = m2.unit and act.y = m2.y and act.x = m2.x"))
def ten_overlay(spark, d):
    """Pixels outside the mask dimmed to a fifth."""
    on = fx.wide_masks(spark, d).withColumn("lit", F.lit(1.0))
    met = fx.activations(spark, d).join(on, ["image", "unit", "y", "x"], "left")
    return met.select("image", "unit", "y", "x", F.round(F.coalesce("lit", F.lit(0.2)) * F.col("value"), 6).alias("value"))


@query("ten_normalize_image", sql("act", "select cast(image as bigint) as image, 2 - unit as channel, y, x, round(value - case unit when 0 then 0.1 when 1 then 0.2 else 0.3 end, 6) as value from act where unit < 3"))
def ten_normalize_image(spark, d):
    """Channels in reverse order, less their means."""
    mean = F.element_at(F.array(F.lit(0.1), F.lit(0.2), F.lit(0.3)), F.col("unit") + 1)
    return fx.activations(spark, d).where("unit < 3").select("image", (2 - F.col("unit")).alias("channel"), "y", "x", F.round(F.col("value") - mean, 6).alias("value"))

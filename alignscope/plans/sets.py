"""Queries on raw labelled sets, made of the driver tables, and on pictures and small matrices."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.codec import encode_png
from ..operators import geometry, rotation, tally
from ..sources import raw
from . import fixtures as fx
from .fixtures import put, scratch, sql
from .registry import query


def _pictures(spark, d, suffix: str = "") -> str:
    """One 2 x 2 picture a region: red counts regions in tens, green is 3, blue numbers columns."""
    folder = scratch(spark, "pictures")
    for r in fx.table(spark, d, "region").orderBy("r_regionkey").collect():
        k = r["r_regionkey"]
        put(spark, f"{folder}/p{k}{suffix}.png", encode_png(np.array([[[10 * k, 3, 5], [10 * k, 3, 9]]] * 2, np.uint8)))
    return folder


@query("src_image", "select 'p' || r_regionkey as image, cast(y as int) as y, cast(x as int) as x, cast(10 * r_regionkey as int) as r, cast(3 as int) as g, cast(5 + 4 * x as int) as b from region, range(2) s(y), range(2) t(x)")
def src_image(spark, d):
    return raw.image_pixels(spark, _pictures(spark, d)).select(F.regexp_extract("path", r"(p\d+)\.png", 1).alias("image"), "y", "x", "r", "g", "b")


@query("src_ade", "select 'p' || r_regionkey || '.jpg' as image, 'object' as category, cast(y as int) as y, cast(x as int) as x, cast(r_regionkey * 256 + 3 as int) as label from region, range(2) s(y), range(2) t(x) union all select 'p' || r_regionkey || '.jpg', 'scene', null, null, cast(dense_rank() over (order by lower(r_name)) as int) from region")
def src_ade(spark, d):
    """Annotation pictures, and the scenes that the set's own MATLAB index names."""
    folder, regions = _pictures(spark, d, "_seg"), fx.table(spark, d, "region").orderBy("r_regionkey").collect()
    index = {"filename": [f"p{r['r_regionkey']}.jpg" for r in regions], "folder": ["x"] * len(regions), "scene": [r["r_name"].lower() for r in regions]}
    put(spark, f"{folder}/index.mat", raw.write_mat({"index": [index]}))
    source = raw.Scenes(folder, raw.scene_index(spark, f"{folder}/index.mat"))
    whole = source.image_labels(spark).select("image", "category", F.lit(None).cast("int").alias("y"), F.lit(None).cast("int").alias("x"), "label")
    return source.pixel_labels(spark).select("image", "category", "y", "x", "label").unionByName(whole)


@query("src_ade_alt", "select 'p' || r_regionkey as image, cast(y as int) as y, cast(x as int) as x, cast(x + 1 as int) as instance from region, range(2) s(y), range(2) t(x)")
def src_ade_alt(spark, d):
    return raw.scene_instances(spark, _pictures(spark, d, "_seg")).select(F.regexp_extract("path", r"(p\d+)_seg\.png", 1).alias("image"), "y", "x", "instance")


@query("src_opensurfaces", "select 'p' || r_regionkey as image, category, cast(label as int) as label, count(*) as n from (select r_regionkey, 'material' as category, 10 * r_regionkey as label from region where r_regionkey > 0 union all select r_regionkey, 'object', 3 from region), range(4) t(k) group by all union all select 'p' || r_regionkey, 'scene', cast(row_number() over (order by lower(r_name)) as int), 1 from region")
def src_opensurfaces(spark, d):
    folder = scratch(spark, "surfaces")
    regions = fx.table(spark, d, "region").orderBy("r_regionkey").collect()
    put(spark, f"{folder}/photos.csv", ("photo_id,scene_category_name\n" + "".join(f"p{r['r_regionkey']},{r['r_name']}\n" for r in regions)).encode())
    put(spark, f"{folder}/label-name-colors.csv", b"name_name,green_color\nChair/Seat,3\n")
    put(spark, f"{folder}/label-substance-colors.csv", b"substance_name,red_color\nWood,10\nMetal,20\n")
    for r in regions:
        put(spark, f"{folder}/photos-labels/p{r['r_regionkey']}.png", encode_png(np.full((2, 2, 3), (10 * r["r_regionkey"], 3, 0), np.uint8)))
    source = raw.Surfaces(folder)
    return source.pixel_labels(spark).groupBy("image", "category", "label").agg(F.count(F.lit(1)).alias("n")).unionByName(source.image_labels(spark).withColumn("n", F.lit(1).cast("long")))


@query("src_pascal_partkey", "select * from (values (1, 'head', 1), (1, 'tail', 2), (2, 'wheel_1', 11), (2, 'wheel_2', 12), (2, 'wheel_3', 13)) t(class, part, number)")
def src_pascal_partkey(spark, d):
    text = "pimap{1}('head') = 1;\npimap{1}('tail') = 2;\nfor ii = 1:3\n  pimap{2}(sprintf('wheel_%d', ii)) = 10 + ii;\nend\n"
    return spark.createDataFrame([(c, p, n) for c, parts in raw.read_part_key(text).items() for p, n in parts.items()], "class int, part string, number int")


@query("src_pascal", "select 'p' || r_regionkey as image, category, label, cast(n as bigint) as n from region, (values ('object', 1, 8), ('object', 2, 8), ('part', 5, 3), ('part', 7, 2)) t(category, label, n)")
def src_pascal(spark, d):
    """A MATLAB file a region: two objects with parts, painted in order."""
    folder = scratch(spark, "parts")
    left, right, some, last = np.zeros((4, 4)), np.zeros((4, 4)), np.zeros((4, 4)), np.zeros((4, 4))
    left[:, :2], right[:, 2:], some[0, :3], last[3, 2:] = 1, 1, 1, 1
    objects = [{"class_ind": np.ones((1, 1)), "mask": left, "parts": [{"part_name": "head", "mask": some}]}, {"class_ind": np.full((1, 1), 2.0), "mask": right, "parts": [{"part_name": "wheel", "mask": last}]}]
    for r in fx.table(spark, d, "region").collect():
        put(spark, f"{folder}/p{r['r_regionkey']}.mat", raw.write_mat({"anno": [{"objects": objects}]}))
    source = raw.Parts(folder, {1: {"head": 5}, 2: {"wheel": 7}}, {1: "cat", 2: "car"})
    return source.pixel_labels(spark).groupBy("image", "category", "label").agg(F.count(F.lit(1)).alias("n"))


@query("ten_slideup", sql("m2", "select cast(image as bigint) as image, unit, x, y, row_number() over (partition by image, unit, x order by y) - 1 as place from m2"), ints="place")
def ten_slideup(spark, d):
    return tally.compact(fx.wide_masks(spark, d).withColumn("value", F.lit(1)), ["image", "unit", "x"], "y").select("image", "unit", "x", "y", "place")


@query("ten_scale_image", sql("act", "select cast(image as bigint) as image, unit, cast(y // 2 as int) as y, cast(x // 2 as int) as x, round(avg(value), 5) + 0.0 as value from act group by all"))
def ten_scale_image(spark, d):
    packed = fx.table(spark, d, "embeddings").select(F.col("vec_id").alias("image"), "embedding")

    def run(frames):
        import pandas as pd

        for f in frames:
            for image, v in zip(f["image"], f["embedding"], strict=True):
                small = geometry.scale_image(np.asarray(v, float).reshape(fx.UNITS, fx.WIDTH, fx.WIDTH).transpose(1, 2, 0), 2, 2)
                y, x, u = np.indices(small.shape).reshape(3, -1).astype(np.int32)
                yield pd.DataFrame({"image": image, "unit": u, "y": y, "x": x, "value": small.reshape(-1)})

    return packed.mapInPandas(run, "image long, unit int, y int, x int, value double").withColumn("value", F.round("value", 5) + 0.0)


@query("ten_tile", sql("act", "select unit, cast(y + (k // 3) * 7 as int) as y, cast(x + (k % 3) * 7 as int) as x, value from (select *, dense_rank() over (partition by unit order by image) - 1 as k from act)"))
def ten_tile(spark, d):
    placed = fx.activations(spark, d).withColumn("k", F.dense_rank().over(Window.partitionBy("unit").orderBy("image")) - 1)
    return geometry.tile(placed, "k", 3, fx.WIDTH, fx.WIDTH).select("unit", "y", "x", "value")


def _turn(angle: float) -> np.ndarray:
    return np.array([[np.cos(angle), -np.sin(angle)], [np.sin(angle), np.cos(angle)]])


@query("la_deviation", "select cast(k as int) as tenths, round(2 * sin(k * pi() / 20), 6) as deviation from range(1, 6) t(k)")
def la_deviation(spark, d):
    """A turn by an angle differs from the identity by twice the sine of its half."""
    return spark.createDataFrame([(k, round(rotation.deviation(_turn(k * np.pi / 10)), 6)) for k in range(1, 6)], "tenths int, deviation double")


@query("la_rotation_power", "select cast(k as int) as quarters, round(2 * sin(k * 0.3), 6) as deviation from range(1, 5) t(k)")
def la_rotation_power(spark, d):
    """Quarters of a turn by 2.4: their deviations follow from their angles."""
    return spark.createDataFrame([(k, round(rotation.deviation(rotation.power(_turn(2.4), k / 4)), 6)) for k in range(1, 5)], "quarters int, deviation double")


@query("la_near_identity", "select cast(unnest([0.001, 0.01, 0.1]) as double) as scale, true as near, true as orthogonal")
def la_near_identity(spark, d):
    """Whether the matrices differ from the identity by their scale times a norm of noise, and are orthogonal."""
    made = [(s, rotation.near_identity(12, s, 3)) for s in (0.001, 0.01, 0.1)]
    return spark.createDataFrame([(s, 0 < rotation.deviation(r) < 10 * s, bool(np.allclose(r @ r.T, np.eye(12)))) for s, r in made], "scale double, near boolean, orthogonal boolean")

"""Pixels as one of eleven colour names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The names in their order, each with a typical red, green and blue.
COLORS = (
    ("black", 0, 0, 0),
    ("blue", 0, 0, 255),
    ("brown", 127, 101, 63),
    ("grey", 127, 127, 127),
    ("green", 0, 255, 0),
    ("orange", 255, 191, 0),
    ("pink", 255, 127, 255),
    ("purple", 255, 0, 255),
    ("red", 255, 0, 0),
    ("white", 255, 255, 255),
    ("yellow", 255, 255, 0),
)


def color_table(spark: SparkSession, step: int = 8) -> DataFrame:
    """r, g, b (each divided by ``step``) -> color, the index of the nearest typical colour; ties to the first name.

    The learned lookup table that such labels come from is not public here; another table of this shape can be used in
    its place. It has (256 / step) cubed rows.
    """
    cells = 256 // step
    cube = spark.range(cells**3).select((F.col("id") / cells**2).cast("int").alias("r"), (F.col("id") / cells % cells).cast("int").alias("g"), (F.col("id") % cells).cast("int").alias("b"))
    mid = lambda c: F.col(c) * step + (step - 1) / 2
    far = F.array(*[F.struct(((mid("r") - r) ** 2 + (mid("g") - g) ** 2 + (mid("b") - b) ** 2).alias("d"), F.lit(i).alias("i")) for i, (_, r, g, b) in enumerate(COLORS)])
    return cube.select("r", "g", "b", F.array_min(far)["i"].alias("color"))


def label_colors(pixels: DataFrame, table: DataFrame, step: int = 8) -> DataFrame:
    """pixels with r, g, b -> with color. The table has a fixed size, so it is sent to every task."""
    cell = lambda c: F.floor(F.col(c) / step).cast("int")
    keyed = table.select(F.col("r").alias("kr"), F.col("g").alias("kg"), F.col("b").alias("kb"), "color")
    return pixels.join(F.broadcast(keyed), (cell("r") == F.col("kr")) & (cell("g") == F.col("kg")) & (cell("b") == F.col("kb"))).drop("kr", "kg", "kb")


def major_colors(pixels: DataFrame, share: float) -> DataFrame:
    """Colours whose share of their image is at or below ``share`` become null."""
    counts = pixels.groupBy("image", "color").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy("image").agg(F.sum("n").alias("total"))
    good = counts.join(totals, "image").where(F.col("n") > share * F.col("total")).select("image", "color", F.lit(True).alias("major"))
    return pixels.join(good, ["image", "color"], "left").withColumn("color", F.when(F.col("major"), F.col("color"))).drop("major")


def posterize(pixels: DataFrame) -> DataFrame:
    """Labelled pixels with the typical red, green and blue of their colour."""
    spark = pixels.sparkSession
    typical = spark.createDataFrame([(i, r, g, b) for i, (_, r, g, b) in enumerate(COLORS)], "color int, r int, g int, b int")
    return pixels.drop("r", "g", "b").join(F.broadcast(typical), "color")

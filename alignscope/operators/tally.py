"""Tallies: how many pixels units and labels share in each image."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import MARGINAL, TALLY_DEPTH


def _marginal(name: str):
    return F.lit(MARGINAL).alias(name)


def tally(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """image, unit, label, n from masked and labelled pixels: both marginals and all pairs.

    Labels are a bag: a pixel that has a label in two layers counts twice. Label 0 is background and left out. The
    pixel join and all three sums are keyed by image first, so tables kept partitioned by image shuffle once.
    """
    named = labels.where("label <> 0")
    pairs = masks.join(named, ["image", "y", "x"]).groupBy("image", "unit", "label").agg(F.count(F.lit(1)).alias("n"))
    units = masks.groupBy("image", "unit").agg(F.count(F.lit(1)).alias("n")).select("image", "unit", _marginal("label"), "n")
    own = named.groupBy("image", "label").agg(F.count(F.lit(1)).alias("n")).select("image", _marginal("unit"), "label", "n")
    return units.unionByName(own).unionByName(pairs)


def tally_image_labels(masks: DataFrame, labels: DataFrame, pixels: int) -> DataFrame:
    """The same for labels of whole images: pixels are counted per unit before the join, never spread over labels."""
    named = labels.where("label <> 0").select("image", "label").distinct()
    counts = masks.groupBy("image", "unit").agg(F.count(F.lit(1)).alias("n"))
    pairs = counts.join(named, "image").select("image", "unit", "label", "n")
    own = named.select("image", _marginal("unit"), "label", F.lit(pixels).cast("long").alias("n"))
    return counts.select("image", "unit", _marginal("label"), "n").unionByName(own).unionByName(pairs)


def truncate(rows: DataFrame, depth: int = TALLY_DEPTH, pixels: int | None = None, both: bool = False) -> DataFrame:
    """At most ``depth`` rows an image: marginals first, then pairs, the larger count first; ties by unit, then label.

    With ``pixels``, a pair with a unit (or, if ``both``, a label) that covers the whole image ranks with the marginals.
    """
    pair = (F.col("unit") != MARGINAL) & (F.col("label") != MARGINAL)
    late = pair
    if pixels is not None:
        whole_unit = rows.where(f"label = {MARGINAL} and n = {pixels}").select("image", "unit", F.lit(True).alias("u"))
        rows = rows.join(whole_unit, ["image", "unit"], "left")
        late = late & F.col("u").isNull()
        if both:
            whole_label = rows.where(f"unit = {MARGINAL} and n = {pixels}").select("image", "label", F.lit(True).alias("l"))
            rows = rows.join(whole_label, ["image", "label"], "left")
            late = late & F.col("l").isNull()
    order = Window.partitionBy("image").orderBy(late.cast("int"), F.desc("n"), "unit", "label")
    return rows.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= depth).select("image", "unit", "label", "n")


def self_tally(masks: DataFrame) -> DataFrame:
    """image, u1 <= u2, n: the pixels of each image that both units mask."""
    a = masks.select("image", "y", "x", F.col("unit").alias("u1"))
    b = masks.select("image", "y", "x", F.col("unit").alias("u2"))
    return a.join(b, ["image", "y", "x"]).where("u1 <= u2").groupBy("image", "u1", "u2").agg(F.count(F.lit(1)).alias("n"))


def pixel_row_wins(rows: DataFrame) -> DataFrame:
    """rows: tally rows with source_rank (0 whole image, 1 pixels). Of repeated (image, unit, label) the pixel row stays."""
    order = Window.partitionBy("image", "unit", "label").orderBy(F.desc("source_rank"))
    return rows.withColumn("rn", F.row_number().over(order)).where("rn = 1").drop("rn", "source_rank")


def compact(cells: DataFrame, by: list[str], at: str) -> DataFrame:
    """Non-zero cells moved up without gaps: each gets its place among the cells of its column."""
    order = Window.partitionBy(*by).orderBy(at)
    return cells.where("value <> 0").withColumn("place", F.row_number().over(order) - 1)

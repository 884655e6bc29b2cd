"""From tallies to scores: intersection over union, best labels, and the wide result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import MARGINAL, TINY
from ..shared import sent


def summarise(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Activated pixels of units, pixels of labels, and shared pixels, over all images."""
    total = F.sum("n")
    units = rows.where(f"label = {MARGINAL}").groupBy("unit").agg(total.alias("activation"))
    labels = rows.where(f"unit = {MARGINAL}").groupBy("label").agg(total.alias("truth"))
    pairs = rows.where(f"unit <> {MARGINAL} and label <> {MARGINAL}").groupBy("unit", "label").agg(total.alias("intersect"))
    return units, labels, pairs


def activation_in(rows: DataFrame, images: DataFrame, key: str) -> DataFrame:
    """Activated pixels of each unit in the images that have ``key`` (a category or a label): unit, key, activation."""
    counts = rows.where(f"label = {MARGINAL}").select("image", "unit", "n")
    return counts.join(images.select("image", key).distinct(), "image").groupBy("unit", key).agg(F.sum("n").alias("activation"))


def iou(intersect: Column, activation: Column, truth: Column) -> Column:
    return intersect / (activation + truth - intersect + F.lit(TINY))


def score(pairs: DataFrame, activations: DataFrame, labels: DataFrame) -> DataFrame:
    """pairs (unit, label, intersect), activations (unit, category, activation), labels (label, category, truth)."""
    met = pairs.join(sent(labels), "label").join(activations, ["unit", "category"])
    return met.withColumn("iou", F.round(iou(F.col("intersect"), F.col("activation"), F.col("truth")), 9))


def first_in(rows: DataFrame, by: list[str], *order: Column) -> DataFrame:
    return rows.withColumn("rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("rn = 1").drop("rn")


def best_label(scored: DataFrame) -> DataFrame:
    """One label per unit and category: the highest score, of equals the smallest label."""
    return first_in(scored, ["unit", "category"], F.desc("iou"), F.col("label"))


def every_category(best: DataFrame, units: DataFrame, categories: list[str]) -> DataFrame:
    """Best labels with a row for every unit and category; without overlap the label is null and the score 0."""
    grid = units.select("unit").distinct().withColumn("category", F.explode(F.array(*map(F.lit, categories))))
    return grid.join(best, ["unit", "category"], "left").withColumn("iou", F.coalesce("iou", F.lit(0.0)))


def best_category(best: DataFrame) -> DataFrame:
    """One category per unit: the highest score, of equals the last category."""
    return first_in(best, ["unit"], F.desc("iou"), F.desc("category"))


def primary_category(coverage: DataFrame, key: str = "label") -> DataFrame:
    """coverage: key, category, cat_idx, coverage. The category with the most coverage, of equals the last."""
    return coverage.groupBy(key).agg(F.max_by("category", F.struct("coverage", "cat_idx")).alias("category"))


def wide(best: DataFrame, categories: list[str]) -> DataFrame:
    """One row per unit with five columns for each of the listed categories."""
    fields = ("label", "truth", "activation", "intersect", "iou")
    return best.groupBy("unit").pivot("category", categories).agg(*[F.first(f).alias(f) for f in fields])


def top_per(rows: DataFrame, by: str, value: str, tie: str, k: int) -> DataFrame:
    """The ``k`` rows with the largest value of each group, with their rank from 1."""
    order = Window.partitionBy(by).orderBy(F.desc(value), F.col(tie))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

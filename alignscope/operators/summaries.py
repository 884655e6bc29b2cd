"""Summaries of results: label histograms, modes, fractions and detectors of networks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import DETECTOR_SCORE
from ..shared import numbered, sent


def mode(rows: DataFrame, key: str, item: str, at: str) -> DataFrame:
    """The most common item of each key; of equally common ones the one that came first."""
    counts = rows.groupBy(key, item).agg(F.count(F.lit(1)).alias("n"), F.min(at).alias("first_at"))
    return counts.groupBy(key).agg(F.min_by(item, F.struct(-F.col("n"), "first_at")).alias(item))


def label_histogram(results: DataFrame, threshold: float = DETECTOR_SCORE) -> DataFrame:
    """results: unit, category, label, score. label -> units, its most common category (ties: first unit), best score."""
    good = results.where(F.col("score") >= threshold)
    modal = mode(good, "label", "category", "unit")
    counts = good.groupBy("label").agg(F.count(F.lit(1)).alias("units"), F.max("score").alias("max_score"))
    return counts.join(modal, "label")


def fractions(results: DataFrame, threshold: float, by: str = "network") -> DataFrame:
    """Share of units with at least the score, per category and in total (category null)."""
    good = F.sum((F.col("score") >= threshold).cast("long"))
    units = results.groupBy(by).agg(F.count(F.lit(1)).alias("units"))
    found = results.rollup(by, "category").agg(good.alias("good"), F.grouping(by).alias("g")).where("g = 0").drop("g")
    return found.join(sent(units), by).select(by, "category", "good", F.round(F.col("good") / F.col("units"), 9).alias("fraction"))


def detectors(results: DataFrame, threshold: float, by: str = "network") -> DataFrame:
    """Detectors above the threshold and their distinct labels, per network and category, and per network (category null)."""
    good = results.where(F.col("score") > threshold)
    out = good.rollup(by, "category").agg(F.count(F.lit(1)).alias("detectors"), F.countDistinct("label").alias("unique_detectors"), F.grouping(by).alias("g"))
    return out.where("g = 0").drop("g")


def report_order(results: DataFrame, threshold: float = DETECTOR_SCORE) -> DataFrame:
    """Order of a report: categories by their units, labels by units then score, units by score; the rest by score."""
    histogram = label_histogram(results, threshold).select("label", F.col("category").alias("label_category"), "units", "max_score")
    sizes = results.where(F.col("score") >= threshold).groupBy("category").agg(F.count(F.lit(1)).alias("category_units"))
    met = results.join(histogram, "label", "left").join(sizes.withColumnRenamed("category", "label_category"), "label_category", "left")
    low = F.col("score") < threshold
    keys = [low.cast("int"), *[F.when(~low, k) for k in (-F.col("category_units"), F.col("label_category"), -F.col("units"), -F.col("max_score"), F.col("label"))], -F.col("score"), F.col("unit")]
    return numbered(met, "place", *keys).select("place", "unit", "label", "category", "score")

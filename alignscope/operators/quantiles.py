"""Quantile tables, thresholds and extremes of activations per unit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import QUANTILE_COUNT, TOP_SHARE, threshold_rank
from ..shared import sent

#: Values kept by a sketch: at 24576 the tail of 0.5 % is right to about 0.1 %.
SKETCH_K = 24576
#: Most values of a group whose distinct values are held at once for an exact percentile.
EXACT_UPTO = 10_000_000


def number(value: Column) -> Column:
    """The value as a double, or null where it is not a number, so that extremes ignore it."""
    wide = value.cast("double")
    return F.when(~F.isnan(wide), wide)


def quantile_grid(values: DataFrame, by: str = "unit", value: str = "value", count: int = QUANTILE_COUNT) -> DataFrame:
    """``count`` evenly spaced quantiles of each group, largest first: by, idx, value."""
    points = F.array(*[F.lit(1 - i / (count - 1)) for i in range(count)])
    grid = values.groupBy(by).agg(F.percentile(number(F.col(value)), points).alias("grid"))
    return grid.select(by, F.posexplode("grid").alias("idx", "value"))


def thresholds(values: DataFrame, by: str = "unit", value: str = "value", share: float = TOP_SHARE) -> DataFrame:
    """The value above which the top share of each group lies: by, threshold. Exact; a value-count map per group."""
    return values.groupBy(by).agg(F.round(F.percentile(number(F.col(value)), F.lit(threshold_rank(share))), 9).alias("threshold"))


def sketch_thresholds(values: DataFrame, by: str = "unit", value: str = "value", share: float = TOP_SHARE, k: int = SKETCH_K) -> DataFrame:
    """The same from a mergeable sketch of bounded size, for groups with too many distinct values for exact maps."""
    sketch = values.groupBy(by).agg(F.kll_sketch_agg_double(number(F.col(value)), F.lit(k)).alias("sketch"))
    return sketch.select(by, F.kll_sketch_get_quantile_double("sketch", F.lit(threshold_rank(share))).alias("threshold"))


def bounded_thresholds(values: DataFrame, by: str = "unit", value: str = "value", share: float = TOP_SHARE, exact_upto: int = EXACT_UPTO) -> DataFrame:
    """Exact thresholds as long as no group has more than ``exact_upto`` values, else sketched ones."""
    most = values.groupBy(by).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("n")).first()["n"] or 0
    if most <= exact_upto:
        return thresholds(values, by, value, share)
    return sketch_thresholds(values, by, value, share).withColumn("threshold", F.round("threshold", 9))


def extremes(values: DataFrame, by: str = "unit", value: str = "value") -> DataFrame:
    return values.groupBy(by).agg(F.min(number(F.col(value))).alias("min_value"), F.max(number(F.col(value))).alias("max_value"))


def image_maxima(activations: DataFrame) -> DataFrame:
    """image, unit, value: the largest activation over all pixels."""
    return activations.groupBy("image", "unit").agg(F.max(number(F.col("value"))).alias("value"))


def integrate(values: DataFrame, fun, by: str = "unit", value: str = "value") -> DataFrame:
    """Sum of a column function over the values of each group."""
    return values.groupBy(by).agg(F.sum(fun(number(F.col(value)))).alias("integral"))


def masks(activations: DataFrame, limits: DataFrame) -> DataFrame:
    """Pixels strictly above their unit's threshold. The thresholds are one row a unit and go to every task."""
    return activations.join(sent(limits), "unit").where(F.col("value") > F.col("threshold")).drop("threshold", "value")


def candidate_units(maxima: DataFrame, limits: DataFrame) -> DataFrame:
    """(image, unit) pairs that can have a masked pixel at all: interpolation never exceeds the largest value."""
    return maxima.join(sent(limits), "unit").where(F.col("value") > F.col("threshold")).select("image", "unit")

"""What every labelled source offers, and their union."""

from __future__ import annotations

from abc import ABC, abstractmethod
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Source(ABC):
    """A labelled set of pictures, as three DataFrames."""

    name: str

    @abstractmethod
    def images(self, spark: SparkSession) -> DataFrame:
        """image string, height int, width int."""

    @abstractmethod
    def image_labels(self, spark: SparkSession) -> DataFrame:
        """image string, category string, label int."""

    @abstractmethod
    def pixel_labels(self, spark: SparkSession) -> DataFrame:
        """image string, category string, layer int, y int, x int, label int."""

    @abstractmethod
    def names(self, spark: SparkSession) -> DataFrame:
        """category string, label int, names array<string>, most preferred first."""


def union(frames: dict[str, DataFrame]) -> DataFrame:
    """UNION ALL of the sources' frames, with the source's name in ``dataset``."""
    named = [df.withColumn("dataset", F.lit(n)) for n, df in frames.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), named)

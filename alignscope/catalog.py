"""An experiment's stored stages: Parquet folders under one base path, in any store that Spark writes to."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class Experiment:
    def __init__(self, spark: SparkSession, base: str) -> None:
        self.spark, self.base = spark, base.rstrip("/")

    def path(self, blob: str, part: str | None = None) -> str:
        """Names are made safe: slashes and spaces become dashes."""
        safe = "-".join(x for x in "".join(c if c.isalnum() or c in "._" else " " for c in blob).split())
        return f"{self.base}/{safe}" + (f"-{part}" if part else "")

    def exists(self, blob: str, part: str | None = None) -> bool:
        """Whether a stage was written to its end: the committer leaves its mark last."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path(blob, part)}/_SUCCESS")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def stage(self, blob: str, part: str, make: Callable[[], DataFrame], force: bool = False) -> DataFrame:
        """The stored stage, made first if it isn't there."""
        if force or not self.exists(blob, part):
            make().write.mode("overwrite").parquet(self.path(blob, part))
        return self.spark.read.parquet(self.path(blob, part))

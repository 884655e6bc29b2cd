"""Quantiles that grow with a stream: sketches of micro-batches, merged into one row per group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..model import threshold_rank
from ..operators.quantiles import SKETCH_K, number


class SketchStore:
    """Sketches by group in a Parquet folder, one sub-folder a batch; a batch that is repeated replaces its own."""

    def __init__(self, folder: str, by: str, k: int = SKETCH_K) -> None:
        self.folder, self.by, self.k = folder, by, k

    def add(self, values: DataFrame, batch: int) -> None:
        part = values.groupBy(self.by).agg(F.kll_sketch_agg_double(number(F.col("value")), F.lit(self.k)).alias("sketch"))
        part.write.mode("overwrite").parquet(f"{self.folder}/batch={batch}")

    def thresholds(self, spark, share: float) -> DataFrame:
        """by, threshold over all batches so far."""
        merged = spark.read.parquet(self.folder).groupBy(self.by).agg(F.kll_merge_agg_double("sketch", F.lit(self.k)).alias("sketch"))
        return merged.select(self.by, F.kll_sketch_get_quantile_double("sketch", F.lit(threshold_rank(share))).alias("threshold"))

    def follow(self, stream: DataFrame, checkpoint: str) -> StreamingQuery:
        """Add every micro-batch of a stream of (by, value)."""
        return stream.writeStream.foreachBatch(lambda df, n: self.add(df, n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

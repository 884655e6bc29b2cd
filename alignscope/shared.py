"""What all machines of a cluster share: a folder for written tables, and tables small enough to be sent to every task."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most bytes that any operator sends to every task.
BROADCAST_BYTES = 64 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``; one of our own only in local mode, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"{tempfile.gettempdir()}/checkpoints"


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint: later reads survive a lost executor and never repeat the work above."""
    if not df.sparkSession.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        df.sparkSession.sparkContext.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def sent(df: DataFrame, row_bytes: int = 128) -> DataFrame:
    """``df``, to be sent to every task if it is small: by the planner's estimate, or else by its rows, made once and counted.

    A larger one comes back as it is, and its join shuffles.
    """
    if int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= BROADCAST_BYTES:
        return F.broadcast(df)
    made = cut(df)
    return F.broadcast(made) if made.count() * row_bytes <= BROADCAST_BYTES else made


def numbered(df: DataFrame, name: str, *order: Column | str) -> DataFrame:
    """``df`` with running numbers from 1 in an order of all its rows, without one task that sorts them all.

    Rows are dealt out by ranges of the order and sorted there; each range starts where the counts of those before end.
    The driver gets one count a range. Equal rows share a range and are numbered in any order.
    """
    at = f"__{name}_at"
    held = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id()))
    place = F.call_function("shiftright", F.col(at), F.lit(33)).cast("int")
    start, starts = 0, []
    for r in held.groupBy(place.alias("place")).count().orderBy("place").collect():
        starts += [F.lit(r["place"]), F.lit(start).cast("long")]
        start += r["count"]
    first = F.element_at(F.create_map(*starts), place) if starts else F.lit(0)
    return held.withColumn(name, first + F.col(at).bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop(at)

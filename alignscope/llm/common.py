"""Helpers that several operators of this package share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as the contracts of this package define it.
WHITE = r"[\x20\x09-\x0D]+"

#: Most bytes that any operator of this package broadcasts.
BROADCAST_BYTES = 64 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def named(column: str) -> Column:
    """A top-level column by its whole name, whatever dots and quotes it holds."""
    return F.col("`" + column.replace("`", "``") + "`")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``; one of our own only in local mode, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"{tempfile.gettempdir()}/checkpoints"


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Let checkpoints go to the shared folder, unless the session has a folder for them."""
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))


class Tables:
    """Written tables in the shared folder, deleted one by one when they are spent, and all when the block ends.

    Later reads survive a lost executor and read only the columns they need. What the block returns must not depend on
    them any more.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.folder, self.made = spark, f"{shared_folder(spark)}/tables-{uuid.uuid4().hex}", 0
        self.paths: dict[int, str] = {}

    def __enter__(self) -> Tables:
        return self

    def __exit__(self, *_: object) -> None:
        self._delete(self.folder)

    def _delete(self, path: str) -> None:
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(hadoop, True)

    def cut(self, df: DataFrame) -> DataFrame:
        self.made += 1
        path = f"{self.folder}/{self.made}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        return out

    def drop(self, df: DataFrame) -> None:
        self._delete(self.paths.pop(id(df)))


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint: later reads survive a lost executor and never repeat the work above."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def fresh(df: DataFrame, *stems: str) -> list[str]:
    """Column names that ``df`` doesn't use, whatever its other columns are called."""
    used = {c.lower() for c in df.columns}
    out = []
    for stem in stems:
        name = f"__{stem}"
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def fits_broadcast(rows: int, row_bytes: int) -> bool:
    """Whether so many rows of so many bytes stay under the bound for broadcasts."""
    return rows * row_bytes <= BROADCAST_BYTES


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int, hot_share: int = 1000) -> DataFrame:
    """Left-join one row per group to the group's rows, without a task that gets a whole hot group.

    A group is hot when it holds over 1/``hot_share`` of the ``total`` rows, so at most ``hot_share`` groups are,
    and broadcasting them has a proven bound. The rest meets by a shuffle in which no key is hot; rows without a key
    have no group and stay where they are.
    """
    limit = max(total // hot_share, 100)
    others = [c for c in groups.columns if c != key]
    hot = groups.where(named(size) > limit)
    cold = groups.where(named(size) <= limit)
    flag = fresh(rows, "hot")[0]
    first = rows.join(F.broadcast(hot.withColumn(flag, F.lit(True))), key, "left")
    stays = F.col(flag).isNotNull() | named(key).isNull()
    rest = first.where(~stays).drop(flag, *others)
    return first.where(stays).drop(flag).unionByName(rest.join(cold, key, "left"))


def sha256_text(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)

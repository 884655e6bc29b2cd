"""Dense tensors: packed arrays and flat binary files."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import ACTIVATIONS
from ..shared import sent


def explode_packed(packed: DataFrame, image: str, values: str, units: int, width: int) -> DataFrame:
    """One array per image, unit by unit and row by row, as long rows. The arrays stay packed in storage."""
    at = packed.select(F.col(image).alias("image"), F.posexplode(values).alias("at", "v"))
    cells = width * width
    return at.select(
        F.col("image").cast("long").alias("image"),
        (F.col("at") / cells).cast("int").alias("unit"),
        (F.col("at") % cells / width).cast("int").alias("y"),
        (F.col("at") % width).cast("int").alias("x"),
        F.col("v").cast("double").alias("value"),
    ).where(F.col("unit") < units)


def read_flat(spark: SparkSession, path: str, shape: tuple[int | None, int, int, int], dtype: str = "<f4") -> DataFrame:
    """Flat files of (image, unit, y, x) without a header, as long rows; the first dimension follows from their sizes.

    Spark's own reader fetches the bytes, so any store it reads will do. A file is one row of it, at most 2 GB: larger
    tensors are kept in several files, whose images are then numbered file by file in the order of their names.
    """
    size = np.dtype(dtype).itemsize * int(np.prod(shape[1:]))
    files = spark.read.format("binaryFile").load(path)
    rows, at = [], 0
    for r in files.select("path", "length").orderBy("path").collect():  # a row a file
        if r["length"] % size:
            raise ValueError(f"{r['path']} doesn't hold whole images")
        rows.append((r["path"], at))
        at += r["length"] // size
    first = spark.createDataFrame(rows, "path string, first long")
    return unpack_flat(files.select("path", "content").join(sent(first, 512), "path"), shape, dtype)


def unpack_flat(files: DataFrame, shape: tuple[int | None, int, int, int], dtype: str = "<f4", block: int = 1 << 22) -> DataFrame:
    """files: first (the number of the first image), content (its bytes and those of the images that follow it)."""
    _, units, h, w = shape
    each = units * h * w

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for first, content in zip(batch["first"], batch["content"], strict=True):
                flat = np.frombuffer(content, dtype)
                for a in range(0, len(flat), block):
                    n = np.arange(a, min(a + block, len(flat)))
                    yield pd.DataFrame({"image": first + n // each, "unit": n // (h * w) % units, "y": n // w % h, "x": n % w, "value": flat[a : a + block].astype(float)})

    return files.select("first", "content").mapInPandas(run, ACTIVATIONS)


def pack_flat(packed: DataFrame, image: str, values: str, dtype: str = "<f4") -> DataFrame:
    """One array per image as the bytes that stand for it in a flat file: first, content."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"first": batch["first"], "content": [np.asarray(v, dtype).tobytes() for v in batch["v"]]})

    return packed.select(F.col(image).cast("long").alias("first"), F.col(values).alias("v")).mapInPandas(run, "first long, content binary")


def pack(activations: DataFrame) -> DataFrame:
    """image, values: the packed form again. An image's values are bounded by its layer's shape."""
    row = F.struct("unit", "y", "x", "value")
    return activations.groupBy("image").agg(F.transform(F.sort_array(F.collect_list(row)), lambda r: r["value"].cast("float")).alias("values"))


def latest(names: list[str], decimal: bool = False) -> str | None:
    """Of names with a number in them the one with the largest; with ``decimal`` the digits stand behind a point."""
    import re

    found = [(m[-1], n) for n in names if (m := re.findall(r"\d+", n))]
    if not found:
        return None
    return max(found, key=lambda x: (int(x[0]) / 10 ** len(x[0]) if decimal else int(x[0]), x[1]))[1]

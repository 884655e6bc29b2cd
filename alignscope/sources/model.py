"""A network, or any function on batches of arrays, as a source of activations."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import ACTIVATIONS

#: Makes, once in each Python worker, a function from [n, ...] inputs to [n, unit, y, x] activations.
Loader = Callable[[], Callable[[np.ndarray], np.ndarray]]


def activations(inputs: DataFrame, load: Loader, image: str = "image", values: str = "values", shape: tuple[int, ...] | None = None, batch: int = 64) -> DataFrame:
    """Long activations of a model over rows of (image, array). Rows stay where they are; the model is loaded per task."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        predict = load()
        for frame in frames:
            for a in range(0, len(frame), batch):
                part = frame.iloc[a : a + batch]
                x = np.stack([np.asarray(v, np.float64) for v in part["values"]])
                out = predict(x.reshape(len(part), *shape) if shape else x)
                n, u, h, w = out.shape
                k = np.arange(out.size)
                yield pd.DataFrame({"image": np.repeat(part["image"].to_numpy(np.int64), u * h * w), "unit": (k // (h * w) % u).astype(np.int32), "y": (k // w % h).astype(np.int32), "x": (k % w).astype(np.int32), "value": out.reshape(-1).astype(float)})

    return inputs.select(F.col(image).cast("long").alias("image"), F.col(values).alias("values")).mapInPandas(run, ACTIVATIONS)


def channel_means(pixels: DataFrame) -> DataFrame:
    """Mean of each channel over all pixels: channel, mean."""
    return pixels.groupBy("channel").agg(F.avg("value").alias("mean"))

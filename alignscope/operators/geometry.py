"""Receptive fields, upsampling and rescaling."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Field:
    """Where a layer's cells lie in the input along one axis: offset of the first, size of each, step between them."""

    offset: int = 0
    size: int = 1
    step: int = 1

    def then(self, inner: Field) -> Field:
        """The field of a layer that reads this one."""
        return Field(self.offset + inner.offset * self.step, self.size + (inner.size - 1) * self.step, self.step * inner.step)

    def center(self, at: int) -> int:
        return self.offset + at * self.step + (self.size - 1) // 2

    def pixels(self, at: int) -> tuple[int, int]:
        """First pixel and the one after the last that a cell sees."""
        first = self.offset + at * self.step
        return first, first + self.size


def convolution(kernel: int, stride: int = 1, pad: int = 0, dilation: int = 1) -> Field:
    return Field(-pad, (kernel - 1) * dilation + 1, stride)


def compose(fields: list[Field]) -> Field:
    out = Field()
    for f in fields:
        out = out.then(f)
    return out


def widest(fields: list[Field]) -> Field:
    """Of parallel branches the one that sees most."""
    return max(fields, key=lambda f: (f.size, -f.offset))


def upsampled_length(cells: int, field: Field, reduction: int = 1) -> int:
    return ((cells - 1) * field.step + field.size + 2 * field.offset) // reduction


def topological(edges: list[tuple[str, str]]) -> list[str]:
    """Layers in an order in which every layer follows its inputs; of free ones the first by name. Tens of rows."""
    nodes = sorted({n for e in edges for n in e})
    waiting = {n: {a for a, b in edges if b == n} for n in nodes}
    out: list[str] = []
    while waiting:
        free = sorted(n for n, before in waiting.items() if not before - set(out))
        if not free:
            raise ValueError("the layers have a cycle")
        out.append(free[0])
        del waiting[free[0]]
    return out


def shortest_path(edges: list[tuple[str, str]], start: str, end: str) -> list[str]:
    """Layers on a shortest way from start to end, breadth first; empty if there is none."""
    ways, at = [[start]], {start}
    for way in ways:
        if way[-1] == end:
            return way
        for a, b in sorted(edges):
            if a == way[-1] and b not in at:
                at.add(b)
                ways.append([*way, b])
    return []


def composed_fields(edges: list[tuple[str, str]], own: dict[str, Field]) -> dict[str, Field]:
    """The field of every layer in the input: its widest input's, followed by its own."""
    out: dict[str, Field] = {}
    for layer in topological(edges):
        before = [out[a] for a, b in edges if b == layer]
        out[layer] = (widest(before) if before else Field()).then(own.get(layer, Field()))
    return out


def linear_weights(cells: int, pixels: int, center: float, step: float) -> np.ndarray:
    """[pixel, cell]: linear interpolation between cells whose first lies at ``center``; outside them the edge value holds."""
    at = np.clip((np.arange(pixels) - center) / step, 0, cells - 1)
    return np.clip(1 - np.abs(at[:, None] - np.arange(cells)), 0, None)


def cubic_weights(cells: int, pixels: int, center: float, step: float) -> np.ndarray:
    """[pixel, cell]: the cubic spline through all cells that has no knot at the last inner cells; clamped to the ends.

    With second derivatives m, (1, 4, 1) m = 6 (1, -2, 1) v inside, and (1, -2, 1) m = 0 at both ends; three cells lie on
    a parabola, two on a line.
    """
    at = np.clip((np.arange(pixels) - center) / step, 0, cells - 1)
    if cells < 3:
        return linear_weights(cells, pixels, center, step)
    second = np.eye(cells)[:-2] - 2 * np.eye(cells)[1:-1] + np.eye(cells)[2:]
    if cells == 3:
        bend = np.repeat(second, 3, 0)
    else:
        inner = np.eye(cells)[:-2] + 4 * np.eye(cells)[1:-1] + np.eye(cells)[2:]
        bend = np.linalg.solve(np.vstack([second[:1], inner, second[-1:]]), np.vstack([np.zeros(cells), 6 * second, np.zeros(cells)]))
    k = np.minimum(at.astype(int), cells - 2)
    t = (at - k)[:, None]
    value = np.eye(cells)
    return value[k] * (1 - t) + value[k + 1] * t + ((1 - t) ** 3 - (1 - t)) * bend[k] / 6 + (t**3 - t) * bend[k + 1] / 6


def gauss_weights(cells: int, pixels: int, center: int, step: int, sigma: float, scale: float = 1.0) -> np.ndarray:
    """[pixel, cell]: cells set on the pixel grid, all else zero, blurred by a Gaussian that is cut at four sigma."""
    reach = int(4 * sigma + 0.5)
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2) if sigma > 0 else np.ones(1)
    kernel /= kernel.sum()
    places = center + step * np.arange(cells)
    far = np.arange(pixels)[:, None] - places
    inside = (np.abs(far) <= reach) & (places >= 0) & (places < pixels)
    return np.where(inside, scale * kernel[np.clip(far + reach, 0, 2 * reach)], 0.0)


def resample(activations: DataFrame, down: np.ndarray, across: np.ndarray) -> DataFrame:
    """image, unit, y, x, value on the pixel grid, from the weights [pixel, cell] of both axes.

    A linear map of each axis, so it is a join with each axis' weights (some rows a pixel, known here and sent to every
    task) and a sum. Pixels to which no cell contributes have no row.
    """
    spark = activations.sparkSession

    def rows(matrix: np.ndarray, pixel: str, cell: str) -> DataFrame:
        at = np.argwhere(matrix != 0)
        return spark.createDataFrame([(int(p), int(c), float(matrix[p, c])) for p, c in at], f"{pixel} int, {cell} int, w{pixel} double")

    met = activations.join(F.broadcast(rows(down, "py", "y")), "y").join(F.broadcast(rows(across, "px", "x")), "x")
    out = met.groupBy("image", "unit", "py", "px").agg(F.sum(F.col("value") * F.col("wpy") * F.col("wpx")).alias("value"))
    return out.withColumnsRenamed({"py": "y", "px": "x"})


def upsample(activations: DataFrame, cells: int, pixels: int, center: float, step: float) -> DataFrame:
    """Linear interpolation of square maps."""
    w = linear_weights(cells, pixels, center, step)
    return resample(activations, w, w)


def upsample_cubic(activations: DataFrame, cells: int, pixels: int, center: float, step: float) -> DataFrame:
    w = cubic_weights(cells, pixels, center, step)
    return resample(activations, w, w)


def upsample_gauss(activations: DataFrame, cells: int, pixels: int, field: Field) -> DataFrame:
    """Cells scattered to the centres of their fields and blurred by a step over the root of two, whole numbers of pixels.

    Values are scaled by the area of a step, so that sums over pixels stay what they were.
    """
    w = gauss_weights(cells, pixels, field.offset + field.size // 2, field.step, field.step // 1.414, field.step)
    return resample(activations, w, w)


def mask_set(activations: DataFrame, cells: int, pixels: int, field: Field, sigma: float = 0.1, threshold: float = 0.5) -> DataFrame:
    """image, unit, y, x of pixels above a share of the largest value of all maps, after a blur by a share of the field."""
    w = gauss_weights(cells, pixels, field.offset + field.size // 2, field.step, field.size * sigma)
    soft = resample(activations, w, w).withColumn("value", F.round("value", 9))
    top = max(soft.agg(F.max("value").alias("top")).first()["top"] or 0.0, 0.0)  # one number
    return soft.where(F.col("value") > top * threshold).select("image", "unit", "y", "x")


def nearest(at: Column, source: int, target: int) -> Column:
    """Which of ``source`` cells stands at a place of ``target`` cells, ends on ends."""
    return F.lit(0) if target == 1 else F.round(at * F.lit((source - 1) / (target - 1))).cast("int")


def zoom_nearest(labels: DataFrame, source: int, target: int) -> DataFrame:
    """Square label maps rescaled without mixing labels: each new pixel takes its nearest old one."""
    spark = labels.sparkSession
    axis = lambda new, old: spark.range(target).select(F.col("id").cast("int").alias(new), nearest(F.col("id"), source, target).alias(old))
    met = labels.join(F.broadcast(axis("ny", "y")), "y").join(F.broadcast(axis("nx", "x")), "x")
    return met.drop("y", "x").withColumnsRenamed({"ny": "y", "nx": "x"})


def crop(pixels: DataFrame, top: int, left: int, height: int, width: int) -> DataFrame:
    """The rows inside a window, with its corner as the new origin; what lies outside the picture has no rows."""
    inside = (F.col("y") >= top) & (F.col("y") < top + height) & (F.col("x") >= left) & (F.col("x") < left + width)
    return pixels.where(inside).withColumns({"y": F.col("y") - top, "x": F.col("x") - left})


def scale_image(picture: np.ndarray, height: int, width: int, crop: bool = False) -> np.ndarray:
    """An [y, x, channel] picture resized by area averages; with ``crop`` the largest centred window of the new shape is taken first."""
    h, w = picture.shape[:2]
    if crop:
        k = min(h / height, w / width)
        ch, cw = max(1, round(height * k)), max(1, round(width * k))
        picture = picture[(h - ch) // 2 :, (w - cw) // 2 :][:ch, :cw]

    def shares(old: int, new: int) -> np.ndarray:
        """How much of each old cell falls into each new one."""
        edges = np.arange(new + 1) * old / new
        cells = np.arange(old)
        return np.clip(np.minimum(edges[1:, None], cells + 1) - np.maximum(edges[:-1, None], cells), 0, None) * new / old

    return np.einsum("ay,yxc,bx->abc", shares(picture.shape[0], height), picture.astype(float), shares(picture.shape[1], width))


def tile(pixels: DataFrame, place: str, per_row: int, height: int, width: int, gap: int = 3) -> DataFrame:
    """Pictures set side by side: each pixel moves to the tile that its picture's place (from 0) stands for."""
    down = F.floor(F.col(place) / per_row).cast("int") * (height + gap)
    right = (F.col(place) % per_row).cast("int") * (width + gap)
    return pixels.withColumns({"y": F.col("y") + down, "x": F.col("x") + right})

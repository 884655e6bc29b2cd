"""Rotations of the unit axis: small matrices on the driver, applied by a join."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import sent


def random_rotation(n: int, seed: int | None = None) -> np.ndarray:
    """A rotation drawn uniformly (QR of a normal matrix, signs fixed, determinant one)."""
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(n, n)))
    q = q * np.sign(np.diag(r))
    if np.linalg.det(q) < 0:
        q[:, 0] = -q[:, 0]
    return q


def power(rotation: np.ndarray, exponent: float) -> np.ndarray:
    """A fractional power: a rotation is normal, so its eigenvectors are orthogonal and angles scale."""
    values, vectors = np.linalg.eig(rotation)
    angles = np.where(np.isclose(values, -1), np.pi, np.angle(values))
    return np.real(vectors @ np.diag(np.exp(1j * exponent * angles)) @ np.linalg.inv(vectors))


def unpermuted(rotation: np.ndarray) -> np.ndarray:
    """The rotation with its rows put where they are largest, the clearest row first; each place is taken once."""
    free, order = set(range(len(rotation))), np.zeros(len(rotation), int)
    for row in np.argsort(-rotation.max(1), kind="stable"):
        place = max(free, key=lambda c: (rotation[row, c], -c))
        free.remove(place)
        order[place] = row
    return rotation[order]


def near_identity(n: int, scale: float, seed: int | None = None) -> np.ndarray:
    """The orthogonal matrix next to the identity plus scaled noise."""
    u, _, v = np.linalg.svd(np.eye(n) + scale * np.random.default_rng(seed).normal(size=(n, n)))
    return u @ v


def deviation(rotation: np.ndarray) -> float:
    return float(np.linalg.norm(rotation - np.eye(len(rotation)), 2))


def rotate_units(activations: DataFrame, matrix: DataFrame) -> DataFrame:
    """matrix: unit (in), out, w. The matrix is units squared and sent to every task if it is small; units meet per pixel."""
    met = activations.join(sent(matrix), "unit")
    return met.groupBy("image", F.col("out").alias("unit"), "y", "x").agg(F.sum(F.col("w") * F.col("value")).alias("value"))

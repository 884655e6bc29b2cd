"""Schemas and the numbers that the whole library agrees on."""

from __future__ import annotations

#: Long form of everything that is stored (DDL).
ACTIVATIONS = "image long, unit int, y int, x int, value double"
QUANTILES = "unit int, idx int, value double"
MASKS = "image long, unit int, y int, x int"
PIXEL_LABELS = "image long, category string, layer int, y int, x int, label int"
IMAGE_LABELS = "image long, category string, label int"
TALLY = "image long, unit int, label int, n long"
CATEGORIES = "name string, first int, last int, count int, frequency long"
LABELS = "number int, name string, category string, frequency long, coverage double, syns string"
CODES = "code int, number int, name string, frequency long, coverage double"

#: Quantiles in a table, the share of pixels above the threshold, the score from which a unit is a detector, rows kept per image.
QUANTILE_COUNT, TOP_SHARE, DETECTOR_SCORE, TALLY_DEPTH = 1000, 0.005, 0.04, 2048
#: What a tally has in place of a unit or a label in a marginal row.
MARGINAL = -1
TINY = 1e-20


def threshold_index(share: float = TOP_SHARE, quantiles: int = QUANTILE_COUNT) -> int:
    """Row of the descending quantile table that holds the threshold (halves round up)."""
    return int(quantiles * share + 0.5)


def threshold_rank(share: float = TOP_SHARE, quantiles: int = QUANTILE_COUNT) -> float:
    """The same row as an ascending quantile."""
    return 1 - threshold_index(share, quantiles) / (quantiles - 1)


def quantile_code(share: float) -> str:
    """0.005 as '005': the digits behind the point, as they stand in names of stored tables."""
    return f"{share:.3f}".split(".")[1]


def decode_quantile(code: str) -> float:
    return int(code) / 10 ** len(code)

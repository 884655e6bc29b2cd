"""Texts in Arrow arrays, cut into slices of bounded size and into chunks that are looked up once per distinct chunk."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at once (a longer text is a slice of its own).
SLICE_BYTES = 3 << 20
#: Chunks that are expanded at once.
BLOCK = 1 << 19


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts have about ``most`` bytes together, or a single row."""
    n = len(texts)
    sizes = np.zeros(n + 1, np.int64)
    if n:
        sizes[1:] = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), np.int64))
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(sizes, sizes[a] + most, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def filled(texts: pa.Array | pa.ChunkedArray) -> pa.Array:
    """Large strings without nulls, in one array."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if isinstance(texts, pa.ChunkedArray):
        texts = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], texts.type)
    return pc.fill_null(texts.cast(pa.large_string()), "")


def give_back() -> None:
    """Free memory of this worker goes back to the system, as a worker lives on after its task."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


class Pieces:
    """Runs of values by number: ``expand`` gives the runs of many numbers, one after another."""

    def __init__(self, runs: list[bytes], dtype: str) -> None:
        self.values = np.frombuffer(b"".join(runs), dtype)
        self.lens = np.fromiter(map(len, runs), np.int64, len(runs)) // np.dtype(dtype).itemsize
        self.starts = np.cumsum(self.lens) - self.lens

    @classmethod
    def of(cls, values: np.ndarray, lens: np.ndarray) -> Pieces:
        """Runs of these lengths that stand one after another."""
        out = cls.__new__(cls)
        out.values, out.lens, out.starts = values, lens, np.cumsum(lens) - lens
        return out

    @classmethod
    def joined(cls, parts: list[Pieces]) -> Pieces:
        return cls.of(np.concatenate([p.values for p in parts]), np.concatenate([p.lens for p in parts]))

    def take(self, numbers: np.ndarray) -> Pieces:
        lens = self.lens[numbers]
        return Pieces.of(self.expand(numbers, lens), lens)

    def expand(self, numbers: np.ndarray, lens: np.ndarray) -> np.ndarray:
        """``lens`` is ``self.lens[numbers]``. Works in blocks, so that index arrays stay small."""
        out = np.empty(int(lens.sum()), self.values.dtype)
        at = 0
        for i in range(0, len(numbers), BLOCK):
            k, n = numbers[i : i + BLOCK], lens[i : i + BLOCK]
            total = int(n.sum())
            index = np.repeat(self.starts[k] - (np.cumsum(n) - n), n)
            index += np.arange(total)
            np.take(self.values, index, out=out[at : at + total])
            at += total
        return out


def bounds(lens: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where each list begins in the expanded runs; one more entry than lists."""
    ends = np.zeros(len(lens) + 1, np.int64)
    np.cumsum(lens, out=ends[1:])
    return ends[offsets]

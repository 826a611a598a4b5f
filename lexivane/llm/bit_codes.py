"""Randomly rotated one-bit codes of vectors, with inner-product estimates and error bounds.

A unit vector is turned by a random rotation and replaced by the signs of its coordinates. With ``align``, the inner
product of the turned vector and its sign vector (scaled to length one), the estimate ``<code, q> / align`` of
``<vector, q>`` is unbiased, and deviates by more than ``BOUND * sqrt((1/align^2 - 1) / (d - 1))`` times the length
of q with vanishing probability only.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BOUND = 4.0
SEED = 11


@lru_cache(maxsize=8)
def rotation(d: int) -> np.ndarray:
    """The same random orthogonal matrix wherever it is made."""
    q, r = np.linalg.qr(np.random.default_rng(SEED + d).normal(size=(d, d)))
    return q * np.sign(np.diag(r))


@dataclass
class Codes:
    """Packed signs, vector lengths and alignments of some vectors of ``d`` numbers."""

    d: int
    bits: np.ndarray
    length: np.ndarray
    align: np.ndarray

    def signs(self, rows=slice(None)) -> np.ndarray:
        """Sign vectors of length one."""
        plain = np.unpackbits(self.bits[rows], axis=1, count=self.d).astype(np.float32)
        return (plain * 2 - 1) / np.float32(self.d ** 0.5)

    def spread(self) -> np.ndarray:
        """How far an estimate against a unit vector may lie off, by row."""
        return BOUND * np.sqrt(np.maximum(0.0, self.align ** -2 - 1) / max(1, self.d - 1)) + 1e-5


def encode(vectors: np.ndarray) -> Codes:
    """Codes of the rows of a matrix; rows of length 0 are not allowed."""
    d = vectors.shape[1]
    length = np.linalg.norm(vectors, axis=1)
    turned = (vectors / length[:, None]) @ rotation(d).T
    return Codes(d, np.packbits(turned > 0, axis=1), length, np.abs(turned).sum(axis=1) / d ** 0.5)


def turned_units(vectors: np.ndarray) -> np.ndarray:
    return ((vectors / np.linalg.norm(vectors, axis=1)[:, None]) @ rotation(vectors.shape[1]).T).astype(np.float32)


def estimates(codes: Codes, turned: np.ndarray, rows=slice(None)) -> np.ndarray:
    """Estimated cosines: a row for each turned unit vector, a column for each code."""
    return (turned @ codes.signs(rows).T) / codes.align[rows].astype(np.float32)


def usable(df: DataFrame, vec: str = "embedding") -> DataFrame:
    """Rows whose vector is not null, not empty, not zero and all finite."""
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return df.where(F.col(vec).isNotNull() & (F.size(vec) > 0) & ~bad & F.exists(vec, lambda x: x != 0))


def matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one dimension, as doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)

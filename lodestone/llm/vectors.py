"""What the vector operators share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(vector: str) -> Column:
    """Neither null nor zero, and all components finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(F.col(vector).isNotNull() & (F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of equal length, without nulls, in double precision."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros((0, 1))
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), -1)


def quantised(v: np.ndarray, kind: type = np.int8) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Integer codes, scale, norm of the residue and norm of what the codes stand for."""
    scale = np.abs(v).max(1, keepdims=True) / np.iinfo(kind).max
    code = np.rint(v / scale).astype(kind)
    stands = code * scale
    return code, scale[:, 0], np.linalg.norm(v - stands, axis=1), np.linalg.norm(stands, axis=1)


def codes(column: pa.Array | pa.ChunkedArray, kind: type) -> np.ndarray:
    """Rows of codes that are held as binaries of equal length."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)

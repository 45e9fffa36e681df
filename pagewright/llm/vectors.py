"""What the vector operators share: fixed-point vectors and exact integer roots."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Components are floor(256 * x).
SCALE = 256
#: Greatest |floor(256 * x)|: squared distances of 64 components stay below 2**62.
LARGEST = 1 << 26


def is_finite(vector: str | Column) -> Column:
    """Neither the vector nor any of its components is null, NaN or infinite."""
    v = F.col(vector) if isinstance(vector, str) else vector
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(fine, F.lit(False))


def fixed_point(vector: str | Column) -> Column:
    """Each component as the integer floor(256 * x); one over ``LARGEST`` raises an error, as distances would not fit a long."""
    v = F.col(vector) if isinstance(vector, str) else vector

    def whole(x):
        y = F.floor(x.cast("double") * SCALE)
        return F.when(F.abs(x) * SCALE < LARGEST, y).otherwise(F.raise_error(F.lit(f"a component is not below {LARGEST // SCALE}"))).cast("int")

    return F.transform(v, whole)


def matrix(column, width: int) -> np.ndarray:
    """An Arrow column of lists of ``width`` integers as rows of a matrix of longs."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(np.int64)


def lists(rows: np.ndarray, kind=np.int32):
    """Rows of a matrix as an Arrow column of lists."""
    import pyarrow as pa

    flat = pa.array(np.ascontiguousarray(rows, kind).ravel())
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), flat)


def root_down(n: np.ndarray) -> np.ndarray:
    """floor(sqrt(n)) of longs, exactly."""
    r = np.sqrt(n.astype(np.float64)).astype(np.int64)
    r -= r * r > n
    r += (r + 1) * (r + 1) <= n
    return r


def root_up(n: np.ndarray) -> np.ndarray:
    """ceil(sqrt(n)) of longs, exactly."""
    r = root_down(n)
    return r + (r * r < n)


def moved(sums: np.ndarray, counts: np.ndarray, before: np.ndarray) -> np.ndarray:
    """floor(sum / count) by component; what has no members stays where it was."""
    return np.where(counts[..., None] > 0, sums // np.maximum(counts, 1)[..., None], before)


def embeddings(spark, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")

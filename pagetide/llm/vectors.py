"""What the operators on embeddings share."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(vec: Column) -> Column:
    """Whether a vector is there and none of its components is null, infinite or not a number."""
    return F.coalesce(vec.isNotNull() & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < math.inf)), F.lit(False))


def scaled(vec: Column, factor: int, most: int) -> Column:
    """Components as whole numbers floor(factor * x), held within +-`most`."""
    return F.transform(vec.cast("array<double>"), lambda x: F.greatest(F.lit(-most), F.least(F.lit(most), F.floor(x * factor))).cast("int"))


def matrix(column: pa.Array, dtype: type = np.float64) -> np.ndarray:
    """Rows of a list column, all of one length."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(dtype)
    return values.reshape(len(column), -1) if len(column) else values.reshape(0, 0)


def of_one_length(column: pa.Array) -> list[np.ndarray]:
    """Row numbers, by the length of their lists."""
    sizes = np.diff(column.offsets.to_numpy())
    return [np.flatnonzero(sizes == n) for n in np.unique(sizes)]


def rotation(dims: int, *seed: int) -> np.ndarray:
    """A fixed random orthogonal matrix."""
    square = np.random.default_rng([dims, *seed]).standard_normal((dims, dims))
    q, r = np.linalg.qr(square)
    return q * np.sign(np.diag(r))


def whole_vectors(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """id and vec (doubles) of the rows with an id and a finite vector of one component at least."""
    vec = F.col(vec_col).cast("array<double>")
    return rows.select(F.col(id_col).alias("id"), vec.alias("vec")).filter(F.col("id").isNotNull() & finite(F.col("vec")) & (F.size("vec") > 0))

"""Vectors out of Arrow lists, and which of them can take part."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F


def finite(embedding: Column) -> Column:
    """Not null, no null or non-finite component."""
    sound = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return embedding.isNotNull() & F.coalesce(sound, F.lit(False))


def usable(embedding: Column) -> Column:
    """Not null, no null or non-finite component, not zero."""
    return finite(embedding) & F.exists(embedding, lambda x: x != 0)


def matrices(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and their vectors in double precision, one matrix for each length of vector."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    begin = np.cumsum(sizes) - sizes
    out = []
    for n in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == n)
        out.append((rows, flat[(begin[rows][:, None] + np.arange(n)).reshape(-1)].reshape(len(rows), n)))
    return out

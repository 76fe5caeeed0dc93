"""Numeric arrays of an Arrow list column, in pieces of bounded size."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import common as C

#: Components held at a time, as doubles.
MAX_VALUES = 1 << 20


def whole(vec_col: str) -> Column:
    """The vector and all its components are there and finite."""
    return F.expr(f"`{vec_col}` IS NOT NULL AND size(`{vec_col}`) > 0 AND forall(`{vec_col}`, "
                  "x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity'))")


def dimension(df: DataFrame, id_col: str, vec_col: str) -> int:
    """Number of components of the whole vector of the smallest id (the first vector among equal ids); 0 without any."""
    first = df.where(whole(vec_col)).orderBy(F.col(id_col).asc_nulls_last(), F.col(vec_col)).select(F.size(vec_col)).first()
    return first[0] if first else 0


def matrices(batch: pa.RecordBatch, vec_col: str, dims: int):
    """(row numbers, matrix of doubles) of the whole vectors of ``dims`` components, a bounded number at a time."""
    at = batch.schema.get_field_index(vec_col)
    for begin in range(0, batch.num_rows, max(1, MAX_VALUES // max(dims, 1))):
        col = batch.column(at).slice(begin, max(1, MAX_VALUES // max(dims, 1)))
        lens = np.asarray(col.value_lengths().fill_null(0))
        flat = np.asarray(col.flatten().cast(pa.float64(), safe=False).fill_null(np.nan))
        fits = np.flatnonzero(lens == dims)
        if len(fits) < len(lens):
            flat = flat[C.ranges((np.cumsum(lens) - lens)[fits], lens[fits])]
        out = flat.reshape(len(fits), dims)
        finite = np.isfinite(out).all(axis=1)
        if not finite.all():
            fits, out = fits[finite], out[finite]
        if len(fits):
            yield begin + fits, out

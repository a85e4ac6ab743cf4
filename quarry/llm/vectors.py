"""Vectors as bytes: parsing, validity and bounded samples."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def matrix(col: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(ok, rows as doubles). Shorter rows are padded with zeros; null, zero and non-finite rows are not ok."""
    lens = pc.fill_null(pc.list_value_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = np.zeros((len(col), dim))
    row = np.repeat(np.arange(len(col)), lens)
    x[row, np.arange(len(flat)) - np.repeat(np.cumsum(lens) - lens, lens)] = flat
    ok = np.isfinite(x).all(1) & (x != 0).any(1) & col.is_valid().to_numpy(zero_copy_only=False)
    return ok, x + 0.0


def unpack(col: pa.Array, dtype: str) -> np.ndarray:
    if not len(col):
        return np.zeros((0, 0))
    return np.frombuffer(b"".join(col.to_pylist()), dtype).reshape(len(col), -1).astype(np.float64)


def parsed(vectors: DataFrame, key: str, column: str) -> tuple[DataFrame, str, int]:
    """((vec_id, vec), dtype, dim): vec holds the components' bytes, null where the vector takes no part."""
    dtype = "<f4" if dict(vectors.dtypes)[column] == "array<float>" else "<f8"
    dim = int(vectors.agg(F.coalesce(F.max(F.size(column)), F.lit(1))).first()[0])
    dim = max(dim, 1)

    def run(batches):
        for b in batches:
            ok, x = matrix(b.column(1), dim)
            raw = [r.tobytes() if o else None for r, o in zip(x.astype(dtype), ok)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(raw, pa.binary())], ["vec_id", "vec"])

    kind = "array<float>" if dtype == "<f4" else "array<double>"
    return vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(column).cast(kind).alias("v")).mapInArrow(run, "vec_id long, vec binary"), dtype, dim


def sample(vectors: DataFrame, dtype: str, most: int) -> np.ndarray:
    """At most so many rows, the same in every run: those whose bytes hash least."""
    rows = vectors.where("vec is not null").select("vec", F.xxhash64("vec").alias("h")).orderBy("h", "vec").limit(most).collect()
    return np.array([np.frombuffer(r["vec"], dtype) for r in rows], np.float64)

"""Usable vectors of the collection, and their Arrow form."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxmill.session import table


def usable(df: DataFrame, id_col: str, vec_col: str, dim: int) -> DataFrame:
    """(id, v): rows with an id whose vector has `dim` finite components that are not all zero, scaled to unit length.

    Null, all-zero, not finite and wrong-length vectors, null components and null ids are left out. Rows
    of one id are taken as they are; other columns are ignored.
    """
    v = F.col(vec_col).cast("array<double>")
    src = df.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & (F.size(vec_col) == dim)).select(F.col(id_col).alias("id"), v.alias("v"))
    kind = src.schema["id"].dataType.simpleString()

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(out)
        for b in batches:
            if not b.num_rows:
                continue
            x = matrix(b.column("v"), dim)
            norm = np.linalg.norm(x, axis=1)
            ok = np.isfinite(norm) & (norm > 0)
            unit = (x[ok] / norm[ok, None]).astype(np.float32)
            yield pa.RecordBatch.from_arrays([b.column("id").filter(pa.array(ok)), rows(unit)], schema=target)

    out = df.sparkSession.createDataFrame([], f"id {kind}, v array<float>").schema
    return src.mapInArrow(run, out)


def matrix(col: pa.Array, dim: int) -> np.ndarray:
    """A list column as a matrix; null components become nan."""
    return np.asarray(col.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dim)


def rows(x: np.ndarray) -> pa.Array:
    """A float matrix as a list column."""
    flat = pa.array(np.ascontiguousarray(x, np.float32).ravel())
    offsets = pa.array(np.arange(0, x.size + 1, x.shape[1] if x.shape[1] else 1, dtype=np.int32))
    return pa.ListArray.from_arrays(offsets, flat)


def declared_dim(spark: SparkSession, sf_dir: str) -> int:
    """The length of vectors that the collection's own metadata states."""
    return int(table(spark, sf_dir, "collection_meta").select("embedding_dim").first()[0])

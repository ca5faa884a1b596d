"""Vector algebra: checks, scalings, exact nearest neighbours in blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block at most, and blocks for each task that can run at once; two blocks and their product fit a Python worker.
BLOCK_ROWS, BLOCKS_PER_TASK = 2048, 2
#: Rows of one matrix product.
PRODUCT_ROWS = 512


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def checked(df: DataFrame, vec_col: str = "embedding") -> DataFrame:
    """`df` as it is, or an error at run time: vectors must be there and all of one length; no rows are fine."""
    if vec_col not in df.columns:
        raise ValueError(f"no column {vec_col}")
    lengths = df.agg(F.count_if(F.col(vec_col).isNull()).alias("nulls"), F.min(F.size(vec_col)).alias("lo"), F.max(F.size(vec_col)).alias("hi"))
    ok = F.assert_true((F.col("nulls") == 0) & (F.coalesce(F.col("lo"), F.lit(0)) == F.coalesce(F.col("hi"), F.lit(0))), F.lit("vectors are missing or of several lengths"))
    gate = lengths.where(ok.isNull()).select(F.lit(1).alias("_ok"))  # a condition is evaluated, an unused column would not be
    return df.crossJoin(F.broadcast(gate)).drop("_ok")


def shape(df: DataFrame, vec_col: str = "embedding") -> DataFrame:
    """(n_rows, n_null, shortest, longest, least): what the vectors look like."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col(vec_col).isNull()).alias("n_null"), F.min(F.size(vec_col)).alias("shortest"), F.max(F.size(vec_col)).alias("longest"), F.min(F.array_min(vec_col)).cast("double").alias("least"))


def l2(vec_col: str = "embedding") -> Column:
    """Unit length; a zero vector stays as it is, null stays null."""
    v = F.col(vec_col).cast("array<double>")
    norm = F.sqrt(dot(v, v))
    return F.when(norm > 0, F.transform(v, lambda x: x / norm)).otherwise(v)


def _by_feature(df: DataFrame, vec_col: str) -> DataFrame:
    """One row: arrays of mean, population deviation, minimum and maximum of each feature."""
    long = df.select(F.posexplode(F.col(vec_col).cast("array<double>")).alias("f", "x"))
    per = long.groupBy("f").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    return per.agg(F.sort_array(F.collect_list(F.struct("f", "mean", "std", "lo", "hi"))).alias("stats"))  # a row per feature


def scaled(df: DataFrame, method: str, vec_col: str = "embedding") -> DataFrame:
    """`df` with the vector scaled: 'l2' per row, 'standard' (population deviation) or 'minmax' per feature, 'none'.

    A feature that does not vary becomes 0. Null vectors stay null.
    """
    if method == "none":
        return df
    if method == "l2":
        return df.withColumn(vec_col, l2(vec_col))
    if method not in ("standard", "minmax"):
        raise ValueError(f"unknown scaling {method!r}")
    v = F.col(vec_col).cast("array<double>")
    with_stats = df.crossJoin(F.broadcast(_by_feature(df, vec_col)))  # one row of statistics
    if method == "standard":
        new = F.zip_with(v, "stats", lambda x, s: F.when(s["std"] > 0, (x - s["mean"]) / s["std"]).otherwise(0.0))
    else:
        new = F.zip_with(v, "stats", lambda x, s: F.when(s["hi"] > s["lo"], (x - s["lo"]) / (s["hi"] - s["lo"])).otherwise(0.0))
    return with_stats.withColumn(vec_col, new).drop("stats")


def _blocks(rows: DataFrame, parts: int, kind: str) -> DataFrame:
    """(ids, vectors): rows (id, v) dealt into blocks by the hash of their id, vectors of unit length as bytes."""
    out = rows.sparkSession.createDataFrame([], f"ids array<{kind}>, vectors binary").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(out)
        got = [b for b in batches if b.num_rows]
        if got:
            t = pa.Table.from_batches(got)
            for a in range(0, t.num_rows, BLOCK_ROWS):
                c = t.slice(a, BLOCK_ROWS).combine_chunks()
                x = np.asarray(c.column("v").combine_chunks().flatten(), np.float64).reshape(c.num_rows, -1)
                x = x / np.linalg.norm(x, axis=1)[:, None]
                yield pa.RecordBatch.from_arrays([pa.array([c.column("id").to_pylist()], target.field(0).type), pa.array([x.tobytes()], pa.binary())], schema=target)

    return rows.repartition(parts, F.xxhash64("id")).mapInArrow(run, out)


def knn(df: DataFrame, k: int, id_col: str, vec_col: str = "embedding", queries: DataFrame | None = None) -> DataFrame:
    """(id, neighbour, similarity, rank): the exact k rows of highest cosine of every query, ties by the neighbour's id.

    Blocks of rows meet blocks of queries, each pair once; a pair gives at most k rows a query. Null and zero vectors
    and those of another length than the commonest (of equally common ones the longest) take no part, nor does a row
    with itself. Without `queries` all rows ask; an exact answer for n queries over m rows takes n x m products, so
    for large collections ask for some or use an approximate index.
    """
    spark, kind = df.sparkSession, df.schema[id_col].dataType.simpleString()
    good = lambda d: d.where(F.col(vec_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v")).where(F.sqrt(dot("v", "v")) > 0)
    rows = good(df)
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    schema = f"id {kind}, neighbour {kind}, similarity double"
    if sizes is None:
        return spark.createDataFrame([], f"{schema}, rank int")
    dim, n = sizes["d"], sizes["n"]
    right = lambda d: d.where(F.size("v") == dim)
    parts = max(-(-n // BLOCK_ROWS), min(n, max(1, round((BLOCKS_PER_TASK * spark.sparkContext.defaultParallelism) ** 0.5))))
    held = _blocks(right(rows), parts, kind)
    asks = held if queries is None else _blocks(right(good(queries)), parts, kind)
    out = spark.createDataFrame([], schema).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(out)
        for b in batches:
            for r in range(b.num_rows):
                mine, theirs = b.column(0)[r].values, b.column(2)[r].values
                x, y = (np.frombuffer(b.column(c)[r].as_buffer(), np.float64).reshape(-1, dim) for c in (1, 3))
                by_id = np.argsort(np.array(theirs.to_pylist(), dtype=object), kind="stable")
                theirs, y = theirs.take(pa.array(by_id)), y[by_id]
                at = {v: i for i, v in enumerate(theirs.to_pylist())}
                for a in range(0, len(x), PRODUCT_ROWS):
                    s = x[a : a + PRODUCT_ROWS] @ y.T
                    own = np.array([at.get(v, -1) for v in mine[a : a + PRODUCT_ROWS].to_pylist()])
                    s[np.flatnonzero(own >= 0), own[own >= 0]] = -np.inf
                    low = np.round(s, 12)
                    least = np.partition(low, low.shape[1] - k, axis=1)[:, low.shape[1] - k] if low.shape[1] > k else np.full(len(low), -np.inf)
                    i, j = np.nonzero((low >= least[:, None]) & np.isfinite(low))
                    order = np.lexsort((j, -low[i, j], i))
                    i, j = i[order], j[order]
                    keep = np.arange(len(i)) - np.searchsorted(i, i) < k
                    i, j = i[keep], j[keep]
                    yield pa.RecordBatch.from_arrays([mine.take(pa.array(i + a)).cast(target.field(0).type), theirs.take(pa.array(j)).cast(target.field(1).type), pa.array(s[i, j])], schema=target)

    met = asks.toDF("a_ids", "a").crossJoin(held.toDF("b_ids", "b")).mapInArrow(run, out)  # blocks x blocks, a row for thousands of rows
    rank = Window.partitionBy("id").orderBy(F.desc(F.round("similarity", 12)), "neighbour")
    return met.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k)

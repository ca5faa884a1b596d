"""Pieces that several of the operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxmill.session import table

#: Multiplier of the polynomial hashes; odd, so it has an inverse modulo 2**64.
BASE = np.uint64(0x9E3779B97F4A7C15)


def filled(c: str) -> Column:
    """True where a string column holds more than white space."""
    return F.coalesce(F.col(c).rlike(r"(?U)\S"), F.lit(False))


def verbatims(spark: SparkSession, sf_dir: str, *extra: str) -> DataFrame:
    """(case_id, verbatim, ...) of the rows of feedback_raw with a case id and a text.

    A case may still have several rows; they hold the same text, so operators drop the repeats after
    scoring, when the text is gone and only a few bytes a row are shuffled.
    """
    raw = table(spark, sf_dir, "feedback_raw").select("case_id", "verbatim", *extra)
    return raw.where(filled("case_id") & filled("verbatim"))


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], dict | None], schema: str) -> DataFrame:
    """`df` through `fn`, a batch at a time; `fn` gives columns by name (a dict of arrays) or None."""
    out = df.sparkSession.createDataFrame([], schema).schema
    names = [f.name for f in out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(out)
        for b in batches:
            if b.num_rows and (got := fn(b)) is not None:
                yield pa.RecordBatch.from_arrays([pa.array(got[n], type=target.field(n).type) for n in names], schema=target)

    return df.mapInArrow(run, out)


def lengths_to_owner(lengths: np.ndarray) -> np.ndarray:
    """[2, 0, 3] -> [0, 0, 2, 2, 2]: the index of the owner of each element."""
    return np.repeat(np.arange(len(lengths)), lengths)


def window_hash(values: np.ndarray, n: int) -> np.ndarray:
    """Hash of values[i:i+n] for each i up to len-n; all 64 bits, equal windows have equal hashes."""
    if len(values) < n:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        h = np.zeros(len(values) - n + 1, np.uint64)
        for k in range(n):
            h = (h + values[k : len(values) - n + 1 + k].astype(np.uint64) + np.uint64(1)) * BASE
            h ^= h >> np.uint64(29)
        return h


#: Bits for each key of a filter that is sent to all executors in place of a set of keys, and bits at least and at most.
KEY_BITS, LEAST_BITS, MOST_BITS = 16, 1 << 20, 1 << 27


def bit_positions(keys: list, bits: int) -> np.ndarray:
    """Two bit positions a key; `bits` is a power of two."""
    import xxhash

    h = np.fromiter((xxhash.xxh64_intdigest(str(k)) for k in keys), np.uint64, len(keys))
    last = np.uint64(bits - 1)
    return np.stack([h & last, (h >> np.uint64(32)) & last], 1).astype(np.int64)


def bloom_bits(keys: DataFrame, key_col: str) -> np.ndarray:
    """The Bloom filter of a column as bytes, built by the executors and sized by the number of keys, up to MOST_BITS (16 MiB).

    Beyond MOST_BITS / KEY_BITS keys more of the others pass, so an exact join must follow.
    """
    keys = keys.select(F.col(key_col).alias("k"))
    size = int(min(MOST_BITS, max(LEAST_BITS, 1 << (KEY_BITS * keys.count()).bit_length())))

    def bits(b: pa.RecordBatch) -> dict:
        p = np.unique(bit_positions(b.column("k").to_pylist(), size))
        at, start = np.unique(p >> 6, return_index=True)
        return {"at": at, "mask": np.bitwise_or.reduceat(np.uint64(1) << (p & 63).astype(np.uint64), start).view(np.int64)}

    got = arrow_map(keys, bits, "at bigint, mask bigint").groupBy("at").agg(F.bit_or("mask").alias("mask")).toArrow()  # at most MOST_BITS / 64 rows
    filled = np.zeros(size >> 6, np.int64)
    filled[got.column("at").to_numpy()] = got.column("mask").to_numpy()
    return filled.view(np.uint8)


def may_be_in(filled: np.ndarray, keys: list) -> np.ndarray:
    """Whether each key may be in the filter."""
    p = bit_positions(keys, len(filled) << 3)
    return (filled[p >> 3] >> (p & 7) & 1).all(1) if len(keys) else np.zeros(0, bool)


def bloom_keep(df: DataFrame, key_col: str, keys: DataFrame) -> DataFrame:
    """The rows of `df` whose key may be among `keys`: all that are, and few others, without a shuffle."""
    shared = df.sparkSession.sparkContext.broadcast(bloom_bits(keys, key_col).tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filled = np.frombuffer(shared.value, np.uint8)
        for b in batches:
            if b.num_rows:
                yield b.filter(pa.array(may_be_in(filled, b.column(key_col).to_pylist())))

    return df.mapInArrow(run, df.schema)


def hash_sample(df: DataFrame, n: int, *by: str) -> DataFrame:
    """At most `n` rows, those of lowest hash of `by`: a bounded sample that no order of files changes.

    Rows are first cut at a hash below which a little more than `n` of them are expected, so the tasks
    send few rows to the driver whatever the size of `df`.
    """
    rows = df.count()
    if rows > 4 * n:
        df = df.where(F.xxhash64(*by) < F.lit(int(-(2**63) + 2**64 * min(1.0, 2.0 * n / rows))))
    return df.orderBy(F.xxhash64(*by), *by).limit(n)

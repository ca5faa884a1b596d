"""Vector collections as Parquet folders: resolve, read, reset, upsert, with a side table of text metadata.

Points lie in buckets by the hash of their id. A write makes new folders for the buckets it touches only; a manifest
names the folder of every bucket. A version is complete when its manifest is there, so a failed write leaves the old
one, and a repeated write gives the same points. Folders that neither of the last two versions names are deleted.
"""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxmill.operators.ingest import upsert
from voxmill.sources.sinks import text_file

#: Buckets of a new collection; a write costs about its touched share of them.
BUCKETS = 16
EMPTY = "id string, document string, embedding array<float>"


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def names(spark: SparkSession, root: str) -> list[str]:
    """The collections of a store, without regard to case in their order."""
    fs, p = _fs(spark, root)
    if not fs.exists(p):
        return []
    found = [s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory() and not s.getPath().getName().startswith(("_", "."))]
    return sorted(found, key=lambda n: (n.lower(), n))


def resolve(spark: SparkSession, root: str, name: str | None = None) -> str:
    """The name to read: the given one, or the only one there is."""
    have = names(spark, root)
    if not have:
        raise ValueError(f"no collection in {root}")
    if name is None:
        if len(have) > 1:
            raise ValueError(f"a name is needed: {', '.join(have)}")
        return have[0]
    if name not in have:
        raise ValueError(f"no collection {name!r}: {', '.join(have)}")
    return name


def _versions(spark: SparkSession, root: str, name: str) -> list[int]:
    """The complete versions of a collection, oldest first."""
    fs, p = _fs(spark, f"{root}/{name}/_manifest")
    return sorted(int(s.getPath().getName()[1:9]) for s in fs.listStatus(p) if s.getPath().getName().endswith(".json")) if fs.exists(p) else []


def _manifest(spark: SparkSession, root: str, name: str, version: int) -> dict:
    """{'buckets': how many, 'of': {bucket: version that wrote it}}."""
    fs, p = _fs(spark, f"{root}/{name}/_manifest/v{version:08d}.json")
    stream = fs.open(p)
    try:
        return json.loads(bytes(stream.readAllBytes()).decode("utf-8"))
    finally:
        stream.close()


def _folder(root: str, name: str, version: int, bucket: int | str) -> str:
    return f"{root}/{name}/v{version:08d}/_bucket={bucket}"


def _load(spark: SparkSession, root: str, name: str, of: dict) -> DataFrame | None:
    at = [_folder(root, name, v, b) for b, v in sorted(of.items())]
    return spark.read.option("mergeSchema", "true").parquet(*at) if at else None


def read(spark: SparkSession, root: str, name: str | None = None) -> DataFrame:
    """All points of a collection; an empty one gives an empty typed table."""
    name = resolve(spark, root, name)
    have = _versions(spark, root, name)
    got = _load(spark, root, name, _manifest(spark, root, name, have[-1])["of"]) if have else None
    return got if got is not None else spark.createDataFrame([], EMPTY)


def delete(spark: SparkSession, root: str, name: str) -> None:
    """Removes a collection with all its versions and its metadata; one that is not there is no error."""
    for at in (f"{root}/{name}", f"{root}/_meta/{name}"):
        fs, p = _fs(spark, at)
        fs.delete(p, True)


def write(spark: SparkSession, root: str, name: str, points: DataFrame, meta: dict[str, str] | None = None, reset: bool = False, buckets: int = BUCKETS) -> None:
    """Adds points, new ones winning by id; with `reset` the collection is deleted before.

    `buckets` counts for a new collection; one that is there keeps its own number.
    """
    if reset:
        delete(spark, root, name)
    have = _versions(spark, root, name)
    old = _manifest(spark, root, name, have[-1]) if have else {"buckets": buckets, "of": {}}
    version = have[-1] + 1 if have else 0
    bucket = F.pmod(F.xxhash64("id"), F.lit(old["buckets"])).cast("int")
    touched = [str(r.b) for r in points.select(bucket.alias("b")).distinct().collect()]  # at most as many as buckets
    before = _load(spark, root, name, {b: v for b, v in old["of"].items() if b in touched})
    out = points if before is None else upsert(before, points)
    out.withColumn("_bucket", bucket).hint("rebalance", "_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{root}/{name}/v{version:08d}")
    now = {"buckets": old["buckets"], "of": {**old["of"], **{b: version for b in touched}}}
    text_file(spark, json.dumps(now), f"{root}/{name}/_manifest/v{version:08d}.json")
    for v in have[:-1]:  # the last version but one stays for those who are reading it
        fs, p = _fs(spark, f"{root}/{name}/_manifest/v{v:08d}.json")
        fs.delete(p, False)
    kept = {*now["of"].items(), *old["of"].items()}
    for v in range(version):
        fs, p = _fs(spark, f"{root}/{name}/v{v:08d}")
        if fs.exists(p):
            for d in fs.listStatus(p):
                got = d.getPath().getName()
                if got.startswith("_bucket=") and (got[8:], v) not in kept:
                    fs.delete(d.getPath(), True)
    if meta is not None:
        dim = points.where("embedding IS NOT NULL").select(F.size("embedding").alias("d")).first()
        side = {**meta, "embedding_dim": str(dim.d if dim else 0)}
        spark.createDataFrame([(k, v) for k, v in sorted(side.items())], "key string, value string").coalesce(1).write.mode("overwrite").parquet(f"{root}/_meta/{name}")


def metadata(spark: SparkSession, root: str, name: str) -> dict[str, str]:
    """The text metadata of a collection."""
    return {r.key: r.value for r in spark.read.parquet(f"{root}/_meta/{name}").limit(1000).collect()}


def model_path(path: str, must_exist: bool = True) -> str:
    """An absolute model folder."""
    full = os.path.abspath(os.path.expanduser(path))
    if must_exist and not os.path.isdir(full):
        raise FileNotFoundError(full)
    return full

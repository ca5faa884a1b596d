"""Feedback folders as a stream: each micro-batch of files goes into the collection by the same keyed upsert."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from voxmill.operators.ingest import points
from voxmill.providers import Embedder, embed
from voxmill.session import cut_lineage
from voxmill.sources import collection, jsonl

FILES = "path string, modificationTime timestamp, length bigint, content binary"


def start(spark: SparkSession, folder: str, root: str, name: str, checkpoint: str, embedder: Embedder, mode: str = "case_id") -> StreamingQuery:
    """Reads what the folder holds and what comes, once (trigger available-now), and upserts it.

    Files come whole, so within a batch the last line of an id wins in the order of path and line, as without a
    stream; a later batch wins over an earlier one. A batch that is repeated after a failure writes the same points.
    """
    files = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", "*.jsonl").load(folder).select("path", "content")

    def put(batch: DataFrame, _: int) -> None:
        new = cut_lineage(embed(points(jsonl.parsed(jsonl.lines(batch)), mode), "document", embedder))
        collection.write(batch.sparkSession, root, name, new)

    return files.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

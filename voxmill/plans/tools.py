"""The steps of topic finding as tools for an agent: settings go in as a dict, results come out as plain values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxmill.config import PipelineConfig
from voxmill.operators import projection, vectors
from voxmill.plans import pipeline


class TopicTools:
    """evaluate, visualise and finalise over one table of points (id, document, embedding); layouts are kept between calls."""

    def __init__(self, points: DataFrame, folder: str, config: PipelineConfig | None = None) -> None:
        self.points, self.folder, self.config = points, folder, config or PipelineConfig()
        self.scaled = vectors.scaled(vectors.checked(points), "l2")
        self.explorer = projection.Explorer(self.scaled, "id", "embedding", self.config.seed)

    def evaluate(self, args: dict) -> dict:
        """{'low', 'high'} -> {'candidates': a row of metrics each, 'suggested'}."""
        low, high = int(args.get("low", self.config.n_neighbors_low)), int(args.get("high", self.config.n_neighbors_high))
        rows = projection.sweep(self.scaled, "id", "embedding", low, high, self.config.seed).toPandas().sort_values("n_neighbors")
        spark = self.points.sparkSession
        return {"candidates": rows.to_dict("records"), "suggested": projection.choose(spark.createDataFrame(rows))}

    def visualise(self, args: dict) -> dict:
        """{'n_neighbors'} -> its metrics and the folder with (id, x, y, cluster)."""
        n = int(args["n_neighbors"])
        frame, metrics = self.explorer.plane(n)
        at = f"{self.folder}/plane_n{n:02d}"
        frame.write.mode("overwrite").parquet(at)
        return {**metrics, "folder": at}

    def finalise(self, args: dict) -> dict:
        """{'n_neighbors'} -> counts and the folder with the report."""
        result = pipeline.topics(self.points, self.config, n_neighbors=int(args["n_neighbors"]))
        pipeline.write_topics(result, self.folder)
        sizes = result.summaries.select(F.col("cluster").cast("string").alias("c"), "cluster_count").orderBy("c").collect()  # a row per cluster
        return {"n_neighbors": result.n_neighbors, "n_documents": result.n_documents, "n_clusters": result.n_clusters, "clusters": {r.c: r.cluster_count for r in sizes}, "folder": self.folder}

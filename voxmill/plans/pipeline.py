"""The two flows end to end: feedback folder to collection, collection to topics and report."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxmill.config import PipelineConfig
from voxmill.operators import density, ingest, keywords, projection, report, vectors
from voxmill.providers import Embedder, HashingEmbedder, TextGenerator, embed
from voxmill.session import cut_lineage
from voxmill.sources import collection, jsonl, sinks


@dataclass(frozen=True)
class TopicResult:
    """What a run of the topic pipeline gives."""

    n_neighbors: int
    n_documents: int
    n_clusters: int
    labelled: DataFrame
    keywords: DataFrame
    summaries: DataFrame
    report: DataFrame
    evaluation: DataFrame
    narrative: str = ""


def ingest_feedback(spark: SparkSession, folder: str, root: str, name: str, embedder: Embedder | None = None, mode: str = "case_id", include_subject: bool = False, reset: bool = False) -> dict[str, int]:
    """Loads a folder into a collection and gives the counters. Embeddings are made once, before the write."""
    embedder = embedder or HashingEmbedder()
    pts = cut_lineage(embed(ingest.points(jsonl.records(spark, folder), mode, include_subject), "document", embedder))
    meta = {"embedding_provider": type(embedder).__name__, "document_mode": "subject+verbatim" if include_subject else "verbatim", "id_mode": mode, "l2_normalize": "true"}
    collection.write(spark, root, name, pts, meta, reset)
    return jsonl.counters(spark, folder).first().asDict()


def topics(points: DataFrame, config: PipelineConfig | None = None, n_neighbors: int | None = None, generator: TextGenerator | None = None, id_col: str = "id", text_col: str = "document", vec_col: str = "embedding") -> TopicResult:
    """Projects, clusters and describes points (id, document, embedding). `n_neighbors` stands for a person's choice."""
    c = config or PipelineConfig()
    pts = vectors.scaled(vectors.checked(points, vec_col), "l2", vec_col)
    evaluation = cut_lineage(projection.sweep(pts, id_col, vec_col, c.n_neighbors_low, c.n_neighbors_high, c.seed))
    n = points.count()
    k = projection.clamp_neighbors(projection.choose(evaluation, override=n_neighbors), n)
    flat = cut_lineage(projection.project(pts, id_col, vec_col, k, c.components, c.seed))
    lab = cut_lineage(density.hdbscan(flat, id_col, "point", min(c.min_cluster_size, max(2, n))).select(id_col, "cluster"))
    labelled = points.join(lab, id_col).withColumnRenamed(id_col, "id") if id_col != "id" else points.join(lab, "id")
    kw = cut_lineage(keywords.extract(labelled, c.top_n, c.keyword_chars, text_col=text_col))
    summ = cut_lineage(report.summarise(labelled, c.summary_chars, generator, text_col))
    named = report.asked_labels(summ, generator) if generator else None
    rows = cut_lineage(report.frame(summ, kw, named))
    text = report.narrative(rows, generator) if generator else ""
    return TopicResult(k, n, report.n_clusters(labelled).first()["n_clusters"], labelled, kw, summ, rows, evaluation, text)


def write_topics(result: TopicResult, folder: str) -> None:
    """Keyword CSV, summary CSV and Markdown report."""
    sinks.csv(result.keywords.orderBy(F.col("cluster").cast("string"), F.desc("cosine_similarities"), "keywords"), f"{folder}/keyword_summary")
    sinks.csv(result.summaries.orderBy(F.col("cluster").cast("string")), f"{folder}/summary")
    sinks.text_file(result.report.sparkSession, report.markdown(result.report, result.narrative), f"{folder}/report.md")

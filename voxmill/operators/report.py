"""The topic report: counts, summaries, labels, appendix, assembled from frames of a row per cluster or phrase."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxmill.functions.text import UNNAMED, blank_to_null, first_words, fixed, salvage, whole_number
from voxmill.operators.keywords import cluster_key, listing
from voxmill.providers import ExtractiveGenerator, TextGenerator, generated

NO_KEYWORDS = "_No keywords for this cluster._"
NO_NARRATIVE = "_No narrative was written._"
RULE = "\n\n---\n\n"
CUT_MARK = "\n\n[... truncated for context limit ...]"
#: Characters of a summary that a label is made from.
LABEL_CHARS = 12_000


def require(df: DataFrame, *columns: str) -> None:
    """Raises ValueError that lists the columns `df` lacks, sorted."""
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def counts(docs: DataFrame, text_col: str = "document") -> DataFrame:
    """(cluster, cluster_count): documents that are not null, per cluster; a null cluster is one too."""
    return docs.groupBy("cluster").agg(F.count(text_col).alias("cluster_count"))


def with_counts(summaries: DataFrame, n: DataFrame) -> DataFrame:
    """Summaries with the count of their cluster, 0 where there is none."""
    return summaries.join(n, "cluster", "left").withColumn("cluster_count", F.coalesce("cluster_count", F.lit(0)))


def n_clusters(docs: DataFrame) -> DataFrame:
    """(n_clusters, n_topics): distinct clusters with noise and the null one, and without."""
    return docs.agg(F.count_distinct(F.coalesce(F.col("cluster").cast("string"), F.lit("null"))).alias("n_clusters"), F.count_distinct(F.when(F.col("cluster") >= 0, F.col("cluster"))).alias("n_topics"))


def summarise(docs: DataFrame, most_chars: int = 600_000, generator: TextGenerator | None = None, text_col: str = "document") -> DataFrame:
    """(cluster, text_summary, cluster_count), noise included; a text that was cut for its summary ends in a mark."""
    from voxmill.operators.keywords import blobs

    b = blobs(docs, most_chars, RULE, text_col=text_col, cut_mark=CUT_MARK, strip=True)
    s = b.select("cluster", generated("blob", generator or ExtractiveGenerator()).alias("text_summary"))
    return with_counts(s, counts(docs, text_col))


def labels(keywords: DataFrame) -> DataFrame:
    """(cluster, label): at most three words of each cluster's best phrase."""
    return listing(keywords, 1).select("cluster", first_words("keywords").alias("label"))


def parsed_labels(answer: str) -> dict[str, str] | None:
    """Labels by cluster name from a model's answer, None where it cannot be read."""
    got = salvage(answer)
    return None if got is None else {str(k): str(v) for k, v in got.items()}


def asked_labels(summaries: DataFrame, generator: TextGenerator) -> DataFrame:
    """(cluster, label) from one request for all clusters; clusters without a readable answer are left out, so that they are called after their number.

    One row per cluster comes to the driver. Counts that are no numbers are sent as null.
    """
    rows = summaries.select(cluster_key().alias("key"), "cluster", whole_number("cluster_count").alias("n"), F.substring(F.coalesce("text_summary", F.lit("")), 1, LABEL_CHARS).alias("text")).orderBy("key").collect()
    sent = json.dumps([{"cluster_key": r.key, "cluster_count": r.n, "text_summary": r.text} for r in rows], ensure_ascii=False)
    got = parsed_labels(generator.generate("Name each group of customer feedback below in at most three words, in title case. Answer with one JSON object: every cluster_key with its name.\n" + sent)) or {}
    named = [(r.cluster, got[r.key]) for r in rows if got.get(r.key, "").strip()]
    kind = summaries.schema["cluster"].dataType.simpleString()
    return summaries.sparkSession.createDataFrame(named, f"cluster {kind}, label string").withColumn("label", first_words("label")).where(F.col("label") != UNNAMED)


def narrative(rows: DataFrame, generator: TextGenerator, phrases: int = 25) -> str:
    """The report's text from one request with names, summaries and the best phrases of all clusters; a stock line for a blank answer."""
    got = rows.orderBy("position").collect()  # a row per cluster
    blocks = [f"## {r.label}\nCluster {r.cluster}, {r.cluster_count} documents.\n{r.text_summary}\n" + "\n".join((r.keyword_lines or "").split("\n")[:phrases]) for r in got]
    ask = "Write a Markdown report on customer feedback for readers without technical knowledge, with the headings Overview, Groups and Common themes. Keep the names of the groups and list no phrases.\n\n"
    return (generator.generate(ask + "\n\n".join(blocks)) or "").strip() or NO_NARRATIVE


def strict_labels(summaries: DataFrame, named: DataFrame) -> DataFrame:
    """Summaries with their label; a cluster without one is an error at run time."""
    j = summaries.join(named.select("cluster", F.col("label").alias("_label")), "cluster", "left")
    return j.withColumn("label", F.coalesce("_label", F.raise_error(F.concat(F.lit("no label for cluster "), F.coalesce(cluster_key(), F.lit("null")))))).drop("_label")


def with_labels(summaries: DataFrame, named: DataFrame) -> DataFrame:
    """Summaries with a label; without one a cluster is called after its number."""
    own = F.concat(F.lit("Cluster "), F.coalesce(cluster_key(), F.lit("null")))
    return summaries.join(named, "cluster", "left").withColumn("label", first_words(F.coalesce(blank_to_null("label"), own)))


def with_keywords(summaries: DataFrame, keywords: DataFrame, n: int | None = None) -> DataFrame:
    """Summaries with the list of their phrases, or the stock line."""
    line = F.concat(F.lit("- `"), F.regexp_replace("keywords", "`", "'"), F.lit("`: relevance "), fixed("cosine_similarities", 3), F.lit(", weight "), fixed("weight", 3))
    rows = listing(keywords, n).groupBy("cluster").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", line.alias("line")))), lambda r: r["line"]), "\n").alias("keyword_lines"))
    return summaries.join(rows, "cluster", "left").withColumn("keyword_lines", F.coalesce("keyword_lines", F.lit(NO_KEYWORDS)))


def frame(summaries: DataFrame, keywords: DataFrame, named: DataFrame | None = None, numeric: bool = False) -> DataFrame:
    """(position, cluster, label, cluster_count, text_summary, keyword_lines): the report's rows by the cluster's name as text, or by its number."""
    require(summaries, "cluster", "text_summary", "cluster_count")
    require(keywords, "cluster", "keywords", "cosine_similarities", "weight")
    full = with_keywords(with_labels(summaries, named if named is not None else labels(keywords)), keywords)
    order = F.col("cluster") if numeric else cluster_key()
    return full.withColumn("position", F.row_number().over(Window.orderBy(order))).select("position", "cluster", "label", "cluster_count", "text_summary", "keyword_lines")  # a row per cluster


def markdown(rows: DataFrame, text: str = "") -> str:
    """The report as Markdown: table of names, narrative, appendix of phrases. One row per cluster comes to the driver."""
    got = rows.orderBy("position").collect()
    table = "\n".join(f"| {r.cluster} | {(r.label or '').replace('|', '/')} | {r.cluster_count} |" for r in got)
    body = text.strip() or "\n\n".join(f"### {r.label}\n\n{r.text_summary}" for r in got) or NO_NARRATIVE
    appendix = "\n\n".join(f"### {r.cluster}: {r.label} ({r.cluster_count} documents)\n\n{r.keyword_lines}" for r in got)
    return f"# Topics\n\n| cluster | name | documents |\n|---|---|---:|\n{table}\n\n{body}\n\n## Keywords\n\n{appendix}\n"

"""Key phrases of clusters: candidates of one to three words, scored by the cosine with the cluster's text, and their weights."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxmill.functions.text import filled, ustrip
from voxmill.providers import Embedder, HashingEmbedder

KEYWORDS = "cluster int, keywords string, cosine_similarities double"
SEPARATOR = "\n\n"
#: Parts of a cluster that are cut on their own first.
SALTS = 64


def cluster_key():
    """Clusters in the order of their names as text: -1, 0, 1, 10, 2."""
    return F.col("cluster").cast("string")


def blobs(docs: DataFrame, most: int, separator: str = SEPARATOR, id_col: str = "id", text_col: str = "document", cut_mark: str = "", strip: bool = False) -> DataFrame:
    """(cluster, blob, n_documents): the non-blank texts of each cluster, in order of id, cut at `most` characters; what was cut ends in `cut_mark`.

    Which ids are needed is found from the lengths alone, by running sums within SALTS parts of each cluster and then
    over the few rows that are left; only texts up to the last such id of their cluster are gathered. So a cluster of
    any size is no hot group, and its other texts are never shuffled.
    """
    t = ustrip(text_col) if strip else F.col(text_col)
    kept = docs.where(filled(text_col)).select("cluster", F.col(id_col).alias("id"), t.alias("t"))
    lengths = kept.select("cluster", "id", (F.length("t") + len(separator)).alias("n")).withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
    near = lengths
    for part in (("cluster", "salt"), ("cluster",)):
        w = Window.partitionBy(*part).orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
        near = near.withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0))).where(F.col("before") < most)
    last = near.groupBy("cluster").agg(F.max("id").alias("last"))
    sizes = lengths.groupBy(F.col("cluster").alias("c")).agg(F.count(F.lit(1)).alias("n_documents"), (F.sum("n") - len(separator)).alias("n_chars"))
    chosen = kept.join(last.withColumnRenamed("cluster", "c"), F.col("cluster").eqNullSafe(F.col("c")) & (F.col("id") <= F.col("last"))).drop("c", "last")
    rows = chosen.groupBy("cluster").agg(F.sort_array(F.collect_list(F.struct("id", F.substring("t", 1, most).alias("t")))).alias("r"))
    joined = F.substring(F.array_join(F.transform("r", lambda x: x["t"]), separator), 1, most)
    blob = F.when(F.col("n_chars") > most, F.concat(joined, F.lit(cut_mark))).otherwise(joined)
    return rows.join(sizes, F.col("cluster").eqNullSafe(F.col("c"))).select("cluster", blob.alias("blob"), "n_documents")


def phrases(text: str, stop: frozenset[str], longest: int = 3) -> list[str]:
    """Distinct phrases of one to `longest` words, stop words left out before words are joined."""
    ws = [w for w in re.findall(r"\b\w\w+\b", text.lower()) if w not in stop]
    return sorted({" ".join(ws[i : i + n]) for n in range(1, longest + 1) for i in range(len(ws) - n + 1)})


def extract(docs: DataFrame, top_n: int = 20, most_chars: int = 12_000, embedder: Embedder | None = None, text_col: str = "document") -> DataFrame:
    """(cluster, keywords, cosine_similarities, weight): the best phrases of each cluster, ties by the phrase."""
    embedder = embedder or HashingEmbedder(256)
    stop = frozenset(StopWordsRemover.loadDefaultStopWords("english"))

    def run(it):
        for pdf in it:
            for c, blob in zip(pdf["cluster"], pdf["blob"], strict=True):
                cand = phrases(blob or "", stop)
                if not cand:
                    continue
                v = np.array(embedder.embed_batch([blob, *cand]))
                sim = np.round(v[1:] @ v[0], 4)
                best = np.lexsort((cand, -sim))[:top_n]
                yield pd.DataFrame({"cluster": [c] * len(best), "keywords": [cand[i] for i in best], "cosine_similarities": sim[best]})

    rows = blobs(docs, most_chars, text_col=text_col).select("cluster", "blob").repartition("cluster").mapInPandas(run, KEYWORDS)
    return weighted(rows)


def weighted(keywords: DataFrame) -> DataFrame:
    """`keywords` with each phrase's share of the similarities of its cluster; 0 where they sum to nothing."""
    total = F.sum("cosine_similarities").over(Window.partitionBy("cluster"))
    return keywords.withColumn("weight", F.when(total > 0, F.col("cosine_similarities") / total).otherwise(0.0))


def listing(keywords: DataFrame, n: int | None = None) -> DataFrame:
    """`keywords` with their rank in the cluster by similarity, ties by the phrase; the first n or all."""
    r = keywords.withColumn("rank", F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("cosine_similarities"), "keywords")))
    return r if n is None else r.where(F.col("rank") <= n)


def mean_similarity(keywords: DataFrame) -> DataFrame:
    return keywords.groupBy("keywords", "cluster").agg(F.avg("cosine_similarities").alias("mean_similarity"))

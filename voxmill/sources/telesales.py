"""Telesales batches: one JSON document a batch, one text file a transcript."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxmill.schemas import BATCH

LINE = r"^Speaker (\d+): (.*)$"


def batches(spark: SparkSession, path: str) -> DataFrame:
    """Batch documents under the explicit schema, from a file, or from the metadata.json of a folder of batches."""
    return spark.read.schema(BATCH).option("multiLine", True).option("pathGlobFilter", "*.json").option("recursiveFileLookup", "true").json(path)


def conversations(batch: DataFrame) -> DataFrame:
    """One row per conversation of each batch, with the batch's id and bounds."""
    c = batch.select("batch_id", "spoken_duration_target_seconds", "spoken_word_count_bounds_global", "conversation_count", F.posexplode("conversations").alias("i", "c"))
    return c.select("batch_id", F.col("spoken_duration_target_seconds").alias("seconds"), F.col("spoken_word_count_bounds_global").alias("words"), "conversation_count", (F.col("i") + 1).alias("row_index"), "c.*")


def _files(spark: SparkSession, folder: str) -> DataFrame:
    """(transcript_path, ...): the text files below a folder, by their path from their batch's folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").option("recursiveFileLookup", "true").load(folder)
    return files.withColumn("transcript_path", F.coalesce(F.nullif(F.regexp_extract("path", r"([^/]+/[^/]+\.txt)$", 1), F.lit("")), F.col("path")))


def transcripts(spark: SparkSession, folder: str) -> DataFrame:
    """(transcript_path, turn_no, speaker, text) of the *.txt files of a folder and those below; other lines are left out.

    transcript_path is the file with its folder, as batches name it.
    """
    lines = _files(spark, folder).select("path", "transcript_path", F.posexplode(F.split(F.decode("content", "UTF-8"), r"\r?\n")).alias("i", "line"))
    turns = lines.where(F.col("line").rlike(LINE))
    n = F.row_number().over(Window.partitionBy("path").orderBy("i"))
    return turns.select("transcript_path", n.alias("turn_no"), F.regexp_extract("line", LINE, 1).cast("int").alias("speaker"), F.regexp_extract("line", LINE, 2).alias("text"))


def missing_transcripts(conversations: DataFrame, have: DataFrame) -> DataFrame:
    """(conversation_id, transcript_path) of the conversations whose path names no transcript with a turn that holds text.

    `have` has (transcript_path, text). Paths are compared with slashes and without "./" before them; a null path is missing.
    """
    norm = lambda c: F.regexp_replace(F.regexp_replace(c, r"\\", "/"), r"^(?:\./)+", "")
    found = have.where(F.coalesce(F.regexp_replace("text", r"(?U)^\s+|\s+$", "") != "", F.lit(False))).select(norm("transcript_path").alias("_path")).distinct()
    return conversations.withColumn("_path", norm("transcript_path")).join(found, "_path", "left_anti").select("conversation_id", "transcript_path")


def format_transcripts(turns: DataFrame, key: str = "conversation_id") -> DataFrame:
    """(key, transcript): the turns with text, in order, one line each and a line end after the last."""
    kept = turns.where(F.coalesce(F.regexp_replace("text", r"(?U)^\s+|\s+$", "") != "", F.lit(False)))
    line = F.concat(F.lit("Speaker "), F.col("speaker").cast("string"), F.lit(": "), F.regexp_replace("text", r"(?U)^\s+|\s+$", ""), F.lit("\n"))
    rows = F.sort_array(F.collect_list(F.struct("turn_no", "speaker", line.alias("line"))))
    return kept.groupBy(key).agg(F.array_join(F.transform(rows, lambda r: r["line"]), "").alias("transcript"))

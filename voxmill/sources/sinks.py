"""What leaves the engine: branch files, CSV, Markdown, telesales batches."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxmill.functions.text import markdown_cell, markdown_header, safe_filename
from voxmill.sources.telesales import format_transcripts


def _fs(spark: SparkSession, path: str):
    """The file system of a path and the path itself, so that a cluster's shared store works as a local folder does."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _promote(spark: SparkSession, folder: str, key: str, name_of) -> None:
    """Moves the part files of the folders key=value to `folder` under the names name_of(value, number of the part)."""
    fs, top = _fs(spark, folder)
    for d in fs.listStatus(top):
        got = d.getPath().getName()
        if d.isDirectory() and got.startswith(f"{key}="):
            parts = sorted(f.getPath().getName() for f in fs.listStatus(d.getPath()) if f.getPath().getName().startswith("part-"))
            for i, part in enumerate(parts):
                fs.rename(_fs(spark, f"{folder}/{got}/{part}")[1], _fs(spark, f"{folder}/{name_of(unquote(got.split('=', 1)[1]), i)}")[1])
            fs.delete(d.getPath(), True)


def branch_jsonl(df: DataFrame, folder: str) -> None:
    """JSON lines in one file per branch, <branch>.jsonl, in place of what the folder held; every column stays in the rows, nulls too.

    A branch with more rows than one task should write gets further files <branch>.1.jsonl and so on.
    """
    keyed = df.withColumn("branch_file", safe_filename("branch_code"))
    keyed.hint("rebalance", "branch_file").write.mode("overwrite").partitionBy("branch_file").option("ignoreNullFields", "false").json(folder)
    _promote(df.sparkSession, folder, "branch_file", lambda name, i: f"{name}.jsonl" if i == 0 else f"{name}.{i}.jsonl")


def csv(df: DataFrame, folder: str) -> None:
    """CSV with a header, quotes doubled, line breaks inside quotes; for report-sized tables, one file."""
    df.coalesce(1).write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').option("quoteAll", False).csv(folder)


def markdown_rows(df: DataFrame, most: int = 2000) -> DataFrame:
    """(line): the first rows of a small table as lines of a pipe table, by the order of its columns."""
    cells = [markdown_cell(c) for c in df.columns]
    return df.orderBy(*df.columns).limit(most).select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))


def markdown_table(df: DataFrame, most: int = 2000) -> str:
    """A pipe table of at most `most` rows, with a footer if there were more."""
    head = "| " + " | ".join(markdown_header(c) for c in df.columns) + " |\n|" + "---|" * len(df.columns)
    body = [r.line for r in markdown_rows(df, most).collect()]
    more = df.limit(most + 1).count() > most
    return "\n".join([head, *body, *([f"\n_First {most} rows._"] if more else [])])


def text_file(spark: SparkSession, text: str, path: str) -> None:
    """A small text as one file of any file system, in place of what was there."""
    fs, p = _fs(spark, path)
    fs.mkdirs(p.getParent())
    out = fs.create(p, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()


def telesales_batch(batch: DataFrame, turns: DataFrame, folder: str) -> None:
    """One batch (a row): metadata.json, indented, and a file conversations/conv-NNNNN.txt for each conversation, at the path its entry names.

    `turns` has (conversation_id, turn_no, speaker, text). A conversation without a turn with text gets an empty file.
    """
    spark = batch.sparkSession
    doc = batch.select(F.to_json(F.struct(*batch.columns), {"pretty": "true", "ignoreNullFields": "false"}).alias("value")).collect()  # one document
    if len(doc) != 1:
        raise ValueError(f"{len(doc)} batches, one is written at a time")
    paths = batch.select(F.explode("conversations").alias("c")).select("c.conversation_id", F.regexp_extract("c.transcript_path", r"([^/]+)\.txt$", 1).alias("file"))
    body = paths.join(format_transcripts(turns), "conversation_id", "left").select("file", F.coalesce(F.regexp_replace("transcript", r"\n$", ""), F.lit("")).alias("value"))
    at = f"{folder}/conversations"
    body.write.mode("overwrite").partitionBy("file").text(at)
    _promote(spark, at, "file", lambda name, i: f"{name}.txt")
    text_file(spark, doc[0].value, f"{folder}/metadata.json")

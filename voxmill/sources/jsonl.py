"""JSON-lines folders: strict lines, rejects that are counted, order by path and line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxmill.functions.text import json_line, ustrip
from voxmill.schemas import FEEDBACK
from voxmill.session import cut_lineage


def lines(files: DataFrame) -> DataFrame:
    """(source_file, path_key, line_no, value, kind, clean) of files (path, content): their non-blank lines, stripped, with what they hold.

    line_no numbers the lines of a file from 1, blank ones included; clean is an object written plainly.
    """
    each = files.select(F.element_at(F.split("path", "/"), -1).alias("source_file"), F.lower("path").alias("path_key"), F.posexplode(F.split(F.decode("content", "UTF-8"), r"\r\n|\n|\r")).alias("i", "line"))
    kept = each.select("source_file", "path_key", (F.col("i") + 1).cast("bigint").alias("line_no"), ustrip("line").alias("value")).where("value <> ''")
    return kept.withColumn("_read", json_line("value")).select("source_file", "path_key", "line_no", "value", "_read.kind", "_read.clean")


def scan(spark: SparkSession, folder: str) -> DataFrame:
    """(source_file, path_key, line_no, value, kind, clean): the non-blank lines of the *.jsonl files of a folder, not of its subfolders.

    kind is 'object', 'other' or 'bad'. Files are read whole so that line numbers are exact. A folder without
    such files raises FileNotFoundError.
    """
    try:
        files = spark.read.format("binaryFile").option("pathGlobFilter", "*.jsonl").option("recursiveFileLookup", "false").load(folder)
        if files.isEmpty():
            raise FileNotFoundError(f"no *.jsonl in {folder}")
    except FileNotFoundError:
        raise
    except Exception as e:  # the reader's own complaint about a missing path
        raise FileNotFoundError(f"no *.jsonl in {folder}") from e
    return lines(files)


def parsed(scanned: DataFrame) -> DataFrame:
    """The rows of the objects among lines under the explicit schema, with source_file, path_key and line_no."""
    ok = scanned.where("kind = 'object'").withColumn("r", F.from_json("clean", FEEDBACK))
    return ok.select("source_file", "path_key", "line_no", "r.*")


def records(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of the objects of a folder."""
    return parsed(scan(spark, folder))


def counters(spark: SparkSession, folder: str) -> DataFrame:
    """(seen, skipped_id, skipped_text, malformed): one row, from one pass; an object without id is skipped for that alone."""
    from voxmill.operators.ingest import reject_reason

    r = scan(spark, folder).withColumn("r", F.from_json("clean", FEEDBACK)).select("kind", reject_reason("r.case_id", "r.verbatim").alias("why"))
    of = lambda why: F.count_if((F.col("kind") == "object") & (F.col("why") == why))
    return r.agg(F.count_if(F.col("kind") == "object").alias("seen"), of("missing_case_id").alias("skipped_id"), of("empty_verbatim").alias("skipped_text"), F.count_if(F.col("kind") != "object").alias("malformed"))


def with_sequence(df: DataFrame, first: str, *order: str, name: str = "seq") -> DataFrame:
    """`df` with a gapless number over the order of `first` and the further columns, nulls first.

    Rows are dealt into ranges of the whole order, so one value of `first` may hold any share of them, and are numbered
    within their range from where the ranges before end. Rows that are equal in all of the columns come in any order.
    """
    by = [F.col(c).asc_nulls_first() for c in (first, *order)]
    ranged = cut_lineage(df.repartitionByRange(*by).sortWithinPartitions(*by))  # kept, as ranges are drawn anew each time
    numbered = ranged.withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    sizes, before = numbered.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).orderBy("_part").collect(), 0  # a row per range
    starts = []
    for r in sizes:
        starts.append((r["_part"], before))
        before += r["n"]
    table = df.sparkSession.createDataFrame(starts, "_part int, _before bigint")
    return numbered.join(F.broadcast(table), "_part").withColumn(name, F.col("_before") + F.col("_row") + 1).drop("_part", "_row", "_before")

"""From raw feedback to points of a collection: text, id, metadata, rejects, last write, upsert."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxmill.functions.text import blank_to_null, filled, ustrip
from voxmill.schemas import METADATA_COLUMNS


def document_text(include_subject: bool = False, verbatim: str = "verbatim", subject: str = "subject") -> Column:
    """The stripped text, null for none; on demand after the subject and a blank line."""
    head = blank_to_null(subject) if include_subject else F.lit(None).cast("string")
    return F.when(filled(verbatim), F.concat_ws("\n\n", head, ustrip(verbatim)))


def point_id(mode: str = "case_id", case_id: str = "case_id", source_file: str = "source_file") -> Column:
    """The stripped case id, null for none; in composite mode after the stem of its file and a colon."""
    if mode not in ("case_id", "composite"):
        raise ValueError(f"unknown id mode {mode!r}")
    own = blank_to_null(F.col(case_id).cast("string"))
    if mode == "case_id":
        return own
    return F.when(own.isNotNull(), F.concat_ws(":", F.regexp_replace(source_file, r"(?<=.)\.[^.]*$", ""), own))


def reject_reason(case_id: str = "case_id", verbatim: str = "verbatim") -> Column:
    """Why a record is left out; the id is looked at first. Null for records that go in."""
    return F.when(~filled(F.col(case_id).cast("string")), "missing_case_id").when(~filled(verbatim), "empty_verbatim")


def metadata() -> list[Column]:
    """source_file and every other column of the record under its meta_ name; null becomes empty text."""
    as_text = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"meta_{c}") for c in METADATA_COLUMNS if c not in ("has_attachments", "synthetic")]
    return [F.coalesce("source_file", F.lit("")).alias("meta_source_file"), *as_text, *(F.coalesce(c, F.lit(False)).alias(f"meta_{c}") for c in ("has_attachments", "synthetic"))]


def last_write(df: DataFrame, key: str, *order: Column) -> DataFrame:
    """The row of each key that comes last in the order. Null keys form one group.

    It is an aggregate that is combined before the shuffle, so a hot key sends one row per task. Nulls come
    first in the order; of rows equal in it any one may stay.
    """
    last = F.max_by(F.struct(*df.columns), F.struct(*order))
    return df.groupBy(F.col(key).alias("_key")).agg(last.alias("_last")).select("_last.*")


def points(raw: DataFrame, mode: str = "case_id", include_subject: bool = False) -> DataFrame:
    """(id, document, meta_...): the accepted records, of each id the last in order of path and line."""
    order = [F.lower(F.col("path_key" if "path_key" in raw.columns else "source_file")), F.col("line_no")]
    keyed = raw.where(reject_reason().isNull()).withColumn("id", point_id(mode))
    return last_write(keyed, "id", *order).select("id", document_text(include_subject).alias("document"), *metadata())


def upsert(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """The union by key in which new rows win; columns that one side lacks are null there."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def flatten_metadata(collection: DataFrame) -> DataFrame:
    """(id, document, embedding, meta_...) of a collection with a metadata struct."""
    inner = collection.schema["metadata"].dataType.names
    return collection.select("id", "document", "embedding", *(F.col(f"metadata.{c}").alias(f"meta_{c}") for c in inner))

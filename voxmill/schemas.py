"""Explicit schemas of the raw layer and of telesales batches."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _B = T.StringType(), T.BooleanType()

FEEDBACK_COLUMNS = (
    "record_type", "submission_type", "case_id", "ticket_number", "branch_code", "region", "channel", "created_at", "updated_at", "status",
    "product_bucket", "subject", "verbatim", "language", "has_attachments", "customer_ref", "assigned_queue", "synthetic", "generator_version", "model",
)
FEEDBACK = T.StructType([T.StructField(c, _B if c in ("has_attachments", "synthetic") else _S) for c in FEEDBACK_COLUMNS])
#: What the collection keeps of a record besides its id and text.
METADATA_COLUMNS = tuple(c for c in FEEDBACK_COLUMNS if c not in ("case_id", "verbatim"))

BATCH = (
    "batch_id string, record_type string, synthetic boolean, generator_version string, model string, created_at string, "
    "spoken_duration_target_seconds struct<min:double,max:double>, spoken_word_count_bounds_global struct<min:int,max:int>, duration_distribution string, conversation_count int, "
    "conversations array<struct<conversation_id:string,record_type:string,scenario:string,language:string,conversation_datetime:string,customer_ref:string,branch_code:string,"
    "primary_product:string,secondary_products:array<string>,outcome:string,transcript_path:string,speaker_map:map<string,struct<role:string,display_name:string>>,"
    "vibevoice_speaker_names:array<string>,transcript_word_count:int,target_spoken_seconds:double,duration_slot:string,duration_word_band_mode:string,"
    "spoken_word_count_bounds:struct<min:int,max:int>>>"
)

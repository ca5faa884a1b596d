"""The queries of the reference's operators over the data folder, each beside the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxmill.functions import dialogue, text
from voxmill.operators import density, generation, ingest, keywords, projection, report, synth, vectors
from voxmill.schemas import FEEDBACK_COLUMNS
from voxmill.session import cut_lineage, shared_folder, table
from voxmill.sources import collection, jsonl, sinks, telesales
from voxmill.sources.jsonl import with_sequence

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: Unicode white space for the SQL engine's patterns.
WS = r"[\s\x{000B}\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def strip_sql(c: str) -> str:
    return f"regexp_replace({c}, '^{WS}+|{WS}+$', '', 'g')"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its name, with its SQL if there is one."""

    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return put


def raw(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "feedback_raw")


def topics(spark: SparkSession, d: str) -> DataFrame:
    """(id, cluster, document): documents under the label of the vector of their number."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("cluster"))
    return e.join(table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("document")), "id")


TOPICS = "t AS (SELECT e.vec_id AS id, e.label AS cluster, d.text AS document FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id)"


def scored(spark: SparkSession, d: str) -> DataFrame:
    """(cluster, keywords, cosine_similarities): the words of at least five ASCII letters in at least a tenth of a topic's documents, with that share."""
    t = topics(spark, d)
    ws = t.select("cluster", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("document"), F.lit("([a-z]{5,})"), F.lit(1)))).alias("keywords"))
    n = t.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    g = ws.groupBy("cluster", "keywords").agg(F.count(F.lit(1)).alias("c")).join(n, "cluster")
    return g.where("c * 10 >= n").select("cluster", "keywords", F.round(F.col("c") / F.col("n"), 4).alias("cosine_similarities"))


SCORED = f"""{TOPICS}, w AS (SELECT DISTINCT id, cluster, unnest(regexp_extract_all(lower(document), '[a-z]{{5,}}')) AS keywords FROM t),
  n AS (SELECT cluster, count(*) AS n FROM t GROUP BY cluster),
  k AS (SELECT w.cluster, w.keywords, round(count(*) / any_value(n.n), 4) AS cosine_similarities FROM w JOIN n ON n.cluster = w.cluster GROUP BY w.cluster, w.keywords HAVING count(*) * 10 >= any_value(n.n))"""


# ---- flagship ---------------------------------------------------------------------------------------------


@query(f"""WITH {TOPICS}, v AS (SELECT t.*, CAST(e.embedding AS DOUBLE[]) AS x FROM t JOIN embeddings e ON e.vec_id = t.id),
  c AS (SELECT cluster, list(m ORDER BY f) AS centre FROM (SELECT cluster, f, avg(x[f]) AS m FROM v, range(1, 65) r(f) GROUP BY cluster, f) GROUP BY cluster),
  s AS (SELECT v.cluster, v.id, row_number() OVER (PARTITION BY v.cluster ORDER BY round(list_dot_product(v.x, c.centre) / sqrt(list_dot_product(v.x, v.x)), 9) DESC, v.id) AS r FROM v JOIN c ON c.cluster = v.cluster)
  SELECT t.cluster, count(*) AS n_documents, round(avg(length(t.document)), 6) AS mean_chars, any_value(s.id) AS nearest_id FROM t JOIN s ON s.cluster = t.cluster AND s.r = 1 GROUP BY t.cluster""")
def cluster_overview(spark: SparkSession, d: str) -> DataFrame:
    v = topics(spark, d).join(table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("x")), "id")
    mean = v.select("cluster", F.posexplode("x").alias("f", "y")).groupBy("cluster", "f").agg(F.avg("y").alias("m"))
    centre = mean.groupBy("cluster").agg(F.transform(F.sort_array(F.collect_list(F.struct("f", "m"))), lambda s: s["m"]).alias("centre"))
    near = v.join(centre, "cluster").withColumn("s", F.round(vectors.dot("x", "centre") / F.sqrt(vectors.dot("x", "x")), 9))
    first = near.withColumn("r", F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("s"), "id"))).where("r = 1").select("cluster", F.col("id").alias("nearest_id"))
    n = topics(spark, d).groupBy("cluster").agg(F.count(F.lit(1)).alias("n_documents"), F.round(F.avg(F.length("document")), 6).alias("mean_chars"))
    return n.join(first, "cluster").select("cluster", "n_documents", "mean_chars", "nearest_id")


# ---- ingest -----------------------------------------------------------------------------------------------


@query(f"""SELECT source_file, line_no, {strip_sql('verbatim')} AS document,
  CASE WHEN {strip_sql("coalesce(subject, '')")} <> '' THEN {strip_sql('subject')} || chr(10) || chr(10) ELSE '' END || {strip_sql('verbatim')} AS document_with_subject
  FROM feedback_raw WHERE {strip_sql("coalesce(verbatim, '')")} <> ''""")
def doc_text_projection(spark: SparkSession, d: str) -> DataFrame:
    r = raw(spark, d)
    return r.select("source_file", "line_no", ingest.document_text().alias("document"), ingest.document_text(True).alias("document_with_subject")).where("document IS NOT NULL")


@query(f"SELECT source_file, line_no, regexp_replace(source_file, '[.][^.]*$', '') || ':' || {strip_sql('case_id')} AS id FROM feedback_raw WHERE {strip_sql(chr(99) + 'oalesce(case_id, ' + chr(39) * 2 + ')')} <> ''")
def id_composite(spark: SparkSession, d: str) -> DataFrame:
    return raw(spark, d).select("source_file", "line_no", ingest.point_id("composite").alias("id")).where("id IS NOT NULL")


@query(f"""SELECT CASE WHEN {strip_sql("coalesce(case_id, '')")} = '' THEN 'missing_case_id' WHEN {strip_sql("coalesce(verbatim, '')")} = '' THEN 'empty_verbatim' ELSE 'accepted' END AS reason, count(*) AS n FROM feedback_raw GROUP BY 1""")
def reject_counts(spark: SparkSession, d: str) -> DataFrame:
    return raw(spark, d).groupBy(F.coalesce(ingest.reject_reason(), F.lit("accepted")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT id, metadata.source_file AS meta_source_file, metadata.branch_code AS meta_branch_code, metadata.region AS meta_region, metadata.channel AS meta_channel, metadata.status AS meta_status,
  metadata.language AS meta_language, metadata.has_attachments AS meta_has_attachments, metadata.subject AS meta_subject FROM voc_collection""")
def metadata_flatten(spark: SparkSession, d: str) -> DataFrame:
    f = ingest.flatten_metadata(table(spark, d, "voc_collection"))
    return f.select("id", "meta_source_file", "meta_branch_code", "meta_region", "meta_channel", "meta_status", "meta_language", "meta_has_attachments", "meta_subject")


ACCEPTED = f"""a AS (SELECT *, {strip_sql('case_id')} AS id, {strip_sql('verbatim')} AS document FROM feedback_raw WHERE {strip_sql("coalesce(case_id, '')")} <> '' AND {strip_sql("coalesce(verbatim, '')")} <> ''),
  p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY lower(source_file) DESC, line_no DESC) AS r FROM a) WHERE r = 1)"""


@query(f"WITH {ACCEPTED} SELECT id, source_file AS meta_source_file, coalesce(status, '') AS meta_status, coalesce(updated_at, '') AS meta_updated_at, document FROM p")
def dedupe_last_write(spark: SparkSession, d: str) -> DataFrame:
    return ingest.points(raw(spark, d)).select("id", "meta_source_file", "meta_status", "meta_updated_at", "document")


@query(f"""WITH {ACCEPTED} SELECT id, document, coalesce(status, '') AS status, 'new' AS origin FROM p
  UNION ALL SELECT v.id, v.document, v.metadata.status, 'old' FROM voc_collection v WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.id = v.id)""")
def upsert_merge(spark: SparkSession, d: str) -> DataFrame:
    old = table(spark, d, "voc_collection").select("id", "document", F.col("metadata.status").alias("status"), F.lit("old").alias("origin"))
    new = ingest.points(raw(spark, d)).select("id", "document", F.col("meta_status").alias("status"), F.lit("new").alias("origin"))
    return ingest.upsert(old, new).select("id", "document", "status", "origin")


@query("""SELECT source_file, line_no, nullif(regexp_replace(subject, '^\\s+|\\s+$', '', 'g'), '') AS subject, nullif(regexp_replace(product_bucket, '^\\s+|\\s+$', '', 'g'), '') AS product_bucket,
  channel IN ('branch_counter', 'email', 'mobile_app', 'phone', 'internet_banking', 'branch_tablet', 'ombudsman_escalation', 'social') AS known_channel, coalesce(has_attachments, false) AS has_attachments FROM feedback_raw""")
def record_repair(spark: SparkSession, d: str) -> DataFrame:
    known = F.col("channel").isin(*synth.CHANNELS)
    return synth.repair(raw(spark, d).withColumn("known_channel", known)).select("source_file", "line_no", "subject", "product_bucket", "known_channel", "has_attachments")


@query("""SELECT source_file, line_no, CASE WHEN x IN ('en', 'english') THEN 'en' WHEN x IN ('id', 'indonesian', 'bahasa', 'bahasa indonesia', 'in') THEN 'id' WHEN regexp_full_match(x, '\\p{L}{2}') THEN x END AS language
  FROM (SELECT source_file, line_no, lower(regexp_replace(coalesce(nullif(language, ''), 'en'), '^\\s+|\\s+$', '', 'g')) AS x FROM feedback_raw)""")
def language_codes(spark: SparkSession, d: str) -> DataFrame:
    return raw(spark, d).select("source_file", "line_no", text.language_code("language").alias("language"))


@query("""SELECT branch_code, coalesce(nullif(regexp_replace(regexp_replace(branch_code, '^\\s+|\\s+$', '', 'g'), '[<>:"/\\\\|?*]', '_', 'g'), ''), 'branch_unknown') AS file_name, count(*) AS n FROM feedback_raw GROUP BY 1, 2""")
def branch_files(spark: SparkSession, d: str) -> DataFrame:
    return raw(spark, d).groupBy("branch_code", text.safe_filename("branch_code").alias("file_name")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT f.source_file, f.line_no, f.branch_code, b.region AS branch_region, b.region IS NULL AS unknown_branch, coalesce(b.region <> f.region, false) AS contradicts FROM feedback_raw f LEFT JOIN branches b ON b.branch_code = f.branch_code""")
def branch_lookup(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "branches").select("branch_code", F.col("region").alias("branch_region"))
    j = raw(spark, d).join(b, "branch_code", "left")
    return j.select("source_file", "line_no", "branch_code", "branch_region", F.col("branch_region").isNull().alias("unknown_branch"), F.coalesce(F.col("branch_region") != F.col("region"), F.lit(False)).alias("contradicts"))


@query("""SELECT branch_code, count(DISTINCT nullif(customer_ref, '')) AS n_customers, count(*) FILTER (WHERE coalesce(customer_ref, '') = '') AS n_anonymous FROM feedback_raw GROUP BY branch_code""")
def customers_per_branch(spark: SparkSession, d: str) -> DataFrame:
    return raw(spark, d).groupBy("branch_code").agg(F.count_distinct(F.nullif("customer_ref", F.lit(""))).alias("n_customers"), F.count_if(F.coalesce("customer_ref", F.lit("")) == "").alias("n_anonymous"))


@query("""SELECT case_id, 'BK-2026-' || lpad(CAST(seq AS VARCHAR), 8, '0') AS sequence_id FROM (SELECT case_id, row_number() OVER (ORDER BY branch_code NULLS FIRST, case_id NULLS FIRST, source_file, line_no) AS seq FROM feedback_raw)""")
def case_sequence(spark: SparkSession, d: str) -> DataFrame:
    r = raw(spark, d).select("branch_code", "case_id", "source_file", "line_no")
    return with_sequence(r, "branch_code", "case_id", "source_file", "line_no", name="seq").select("case_id", F.format_string("BK-2026-%08d", "seq").alias("sequence_id"))


@query("""SELECT line_no, source_file, CASE WHEN u <= 0.15 THEN 'open' WHEN u <= 0.4 THEN 'in_progress' WHEN u <= 0.75 THEN 'resolved' WHEN u <= 0.9 THEN 'closed' WHEN u <= 0.95 THEN 'escalated' ELSE 'closed' END AS state
  FROM (SELECT source_file, line_no, (line_no % 1000) / 1000.0 AS u FROM feedback_raw)""")
def status_ladder(spark: SparkSession, d: str) -> DataFrame:
    return raw(spark, d).select("line_no", "source_file", dialogue.state((F.col("line_no") % 1000) / F.lit(1000.0)).alias("state"))


@query("""SELECT id, CAST(a AS VARCHAR) AS range_start, CAST(b AS VARCHAR) AS range_end FROM (SELECT branch_code AS id,
  CASE WHEN s IS NULL AND e IS NULL THEN DATE '2026-01-01' ELSE coalesce(s, e - 365) END AS a, CASE WHEN s IS NULL AND e IS NULL THEN DATE '2026-12-31' ELSE coalesce(e, s + 365) END AS b
  FROM (SELECT branch_code, CASE WHEN is_active THEN opened_on END AS s, CASE WHEN region = 'JAVA' THEN opened_on + 30 END AS e FROM branches))""")
def date_defaults(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "branches")
    lo, hi = dialogue.date_range(F.when(F.col("is_active"), F.col("opened_on")), F.when(F.col("region") == "JAVA", F.date_add("opened_on", 30)))
    return b.select(F.col("branch_code").alias("id"), lo.cast("string").alias("range_start"), hi.cast("string").alias("range_end"))


@query("""SELECT region, 'BR-' || upper(substr(replace(region, '_', ''), 1, 4)) || '-' || lpad(CAST(i AS VARCHAR), 3, '0') AS code FROM (SELECT region, row_number() OVER (ORDER BY region, branch_code) AS i FROM branches)""")
def branch_codes(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "branches").withColumn("i", F.row_number().over(Window.orderBy("region", "branch_code")))
    return b.select("region", text.branch_code("region", F.col("i")).alias("code"))


# ---- text -------------------------------------------------------------------------------------------------


@query(f"""SELECT doc_id, substr(text, 1, 12000) AS keyword_text, CASE WHEN length(s) > 600000 THEN substr(s, 1, 600000) || chr(10) || chr(10) || '[... truncated for context limit ...]' ELSE s END AS summary_text
  FROM (SELECT doc_id, text, {strip_sql('text')} AS s FROM documents) WHERE s <> ''""")
def truncate_text(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").select(F.col("doc_id").alias("cluster"), F.col("doc_id").alias("id"), F.col("text").alias("document"))
    k = keywords.blobs(t, 12_000).select(F.col("cluster").alias("doc_id"), F.col("blob").alias("keyword_text"))
    return k.join(keywords.blobs(t, 600_000, report.RULE, cut_mark=report.CUT_MARK, strip=True).select(F.col("cluster").alias("doc_id"), F.col("blob").alias("summary_text")), "doc_id")


@query(f"SELECT doc_id, CASE WHEN length(text) > 200 THEN regexp_replace(substr(text, 1, 199), '{WS}+$', '') || '…' ELSE text END AS clamped FROM documents")
def clamp_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.clamp("text", 200).alias("clamped"))


@query("""SELECT source_file, line_no, CASE WHEN len(w) > 0 THEN array_to_string(w[1:3], ' ') ELSE 'Unnamed cluster' END AS label
  FROM (SELECT source_file, line_no, list_filter(regexp_split_to_array(coalesce(subject, ''), '[^\\p{L}\\p{N}_\\-]+'), lambda x: x <> '') AS w FROM feedback_raw)""")
def label_three_words(spark: SparkSession, d: str) -> DataFrame:
    return raw(spark, d).select("source_file", "line_no", text.first_words("subject").alias("label"))


@query(f"SELECT conversation_id, CAST(sum(coalesce(len(regexp_extract_all(text, '[^{WS[1:-1]}]+')), 0)) AS BIGINT) AS n_words, count(*) AS n_turns FROM transcript_turns GROUP BY conversation_id")
def word_count(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "transcript_turns").groupBy("conversation_id").agg(F.sum(text.word_count("text")).cast("bigint").alias("n_words"), F.count(F.lit(1)).alias("n_turns"))


# ---- dialogues --------------------------------------------------------------------------------------------


@query(f"""SELECT conversation_id, string_agg('Speaker ' || CAST(speaker AS VARCHAR) || ': ' || s || chr(10), '' ORDER BY turn_no, speaker, s) AS transcript
  FROM (SELECT *, {strip_sql('text')} AS s FROM transcript_turns WHERE {strip_sql("coalesce(text, '')")} <> '') GROUP BY conversation_id""")
def transcript_format(spark: SparkSession, d: str) -> DataFrame:
    return telesales.format_transcripts(table(spark, d, "transcript_turns"))


def conversations(spark: SparkSession, d: str) -> DataFrame:
    return telesales.conversations(table(spark, d, "telesales_batches"))


CONVERSATIONS = "c AS (SELECT batch_id, spoken_duration_target_seconds AS seconds, spoken_word_count_bounds_global AS words, conversation_count, unnest(conversations) AS c, generate_subscripts(conversations, 1) AS row_index FROM telesales_batches)"


@query("SELECT batch_id, conversation_count, coalesce(len(conversations), 0) AS n_conversations, conversation_count IS DISTINCT FROM len(conversations) AS is_wrong FROM telesales_batches")
def conversation_counts(spark: SparkSession, d: str) -> DataFrame:
    n = F.coalesce(F.size("conversations"), F.lit(0)).cast("bigint")
    return table(spark, d, "telesales_batches").select("batch_id", "conversation_count", n.alias("n_conversations"), (~F.col("conversation_count").eqNullSafe(n)).alias("is_wrong"))


@query("""SELECT batch_id, lang AS language, lo AS words_min, greatest(lo, CAST(floor(seconds.max * slow) AS INT)) AS words_max FROM (SELECT *, greatest(8, CAST(ceil(seconds.min * fast) AS INT)) AS lo FROM
  (SELECT batch_id, spoken_duration_target_seconds AS seconds, lang, CASE lang WHEN 'id' THEN 3.0 ELSE 2.85 END::DOUBLE AS fast, CASE lang WHEN 'id' THEN 2.15 ELSE 2.1 END::DOUBLE AS slow FROM telesales_batches, (VALUES ('en'), ('id')) l(lang)))""")
def tts_bounds(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "telesales_batches").select("batch_id", F.col("spoken_duration_target_seconds").alias("s"), F.explode(F.array(F.lit("en"), F.lit("id"))).alias("language"))
    lo, hi = dialogue.tts_bounds(F.col("s.min"), F.col("s.max"), F.col("language"))
    return b.select("batch_id", "language", lo.alias("words_min"), hi.alias("words_max"))


@query("SELECT batch_id, least(64, greatest(28, hi // 17 + 14)) AS turn_cap, least(65536, greatest(8192, CAST(floor(hi * conversation_count * 2.3::DOUBLE + 4096) AS INT))) AS token_budget FROM (SELECT batch_id, conversation_count, spoken_word_count_bounds_global.max AS hi FROM telesales_batches)")
def turn_caps(spark: SparkSession, d: str) -> DataFrame:
    hi = F.col("spoken_word_count_bounds_global.max")
    return table(spark, d, "telesales_batches").select("batch_id", dialogue.turn_cap(hi).alias("turn_cap"), dialogue.token_budget(hi * F.col("conversation_count"), F.lit(8192)).alias("token_budget"))


@query(f"WITH {CONVERSATIONS} SELECT batch_id, c.conversation_id AS conversation_id, CASE WHEN row_index = n THEN 'maximum' WHEN row_index = 1 THEN 'minimum' ELSE 'random' END AS duration_slot FROM (SELECT *, count(*) OVER (PARTITION BY batch_id) AS n FROM c)")
def slot_assignment(spark: SparkSession, d: str) -> DataFrame:
    c = conversations(spark, d).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("batch_id")))
    return c.select("batch_id", "conversation_id", dialogue.slot(F.col("row_index"), F.col("n")).alias("duration_slot"))


_WIN = "greatest(lo, CAST(round_even({c} - half, 0) AS INT)) AS {n}_a0, least(hi, CAST(round_even({c} + half, 0) AS INT)) AS {n}_b0"


@query(f"""WITH {CONVERSATIONS}, x AS (SELECT batch_id, c.conversation_id AS conversation_id, row_index, count(*) OVER (PARTITION BY batch_id) AS n, c.target_spoken_seconds AS t, seconds.min AS lo_s, seconds.max AS hi_s, words.min AS lo, words.max AS hi, words.max - words.min AS span FROM c),
  y AS (SELECT *, CASE WHEN span > 0 THEN greatest(10, least(48, span // 4)) ELSE 0 END AS half, CASE WHEN hi_s > lo_s THEN greatest(0.0, least(1.0, (t - lo_s) / (hi_s - lo_s))) ELSE 0.5 END AS share FROM x),
  z AS (SELECT *, n >= 2 AND span >= least(70, greatest(48, half * 2 + 20)) AND span >= half * 2 + 20 AS roomy, CASE WHEN row_index = n THEN 'maximum' WHEN row_index = 1 THEN 'minimum' ELSE 'random' END AS slot,
    {_WIN.format(c="(lo + half * 0.2::DOUBLE)", n="s")}, {_WIN.format(c="(hi - half * 0.2::DOUBLE)", n="l")}, {_WIN.format(c="(lo + share * span)", n="f")} FROM y),
  q AS (SELECT *, {", ".join(f"least({k}_a0, {k}_b0) AS {k}_a, CASE WHEN abs({k}_b0 - {k}_a0) < 10 THEN least(hi, least({k}_a0, {k}_b0) + 12) ELSE greatest({k}_a0, {k}_b0) END AS {k}_b" for k in "slf")} FROM z)
  SELECT batch_id, conversation_id, CASE WHEN NOT roomy THEN 'global' WHEN s_b > l_a THEN 'global_overlap_fallback' ELSE 'per_slot' END AS band_mode,
    CASE WHEN roomy AND s_b <= l_a THEN CASE slot WHEN 'minimum' THEN s_a WHEN 'maximum' THEN l_a ELSE f_a END ELSE lo END AS words_min,
    CASE WHEN roomy AND s_b <= l_a THEN CASE slot WHEN 'minimum' THEN s_b WHEN 'maximum' THEN l_b ELSE f_b END ELSE hi END AS words_max FROM q""")
def word_band(spark: SparkSession, d: str) -> DataFrame:
    c = conversations(spark, d).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("batch_id")))
    lo, hi, mode = dialogue.word_band(F.col("row_index"), F.col("n"), F.col("target_spoken_seconds"), F.col("seconds.min"), F.col("seconds.max"), F.col("words.min"), F.col("words.max"))
    return c.select("batch_id", "conversation_id", mode.alias("band_mode"), lo.alias("words_min"), hi.alias("words_max"))


@query(f"""WITH {CONVERSATIONS}, w AS (SELECT conversation_id, sum(coalesce(len(regexp_extract_all(text, '[^{WS[1:-1]}]+')), 0)) AS n FROM transcript_turns GROUP BY conversation_id),
  j AS (SELECT c.c.conversation_id AS conversation_id, CAST(coalesce(w.n, 0) AS BIGINT) AS n_words, c.c.transcript_word_count AS recorded, c.c.spoken_word_count_bounds.min AS lo, c.c.spoken_word_count_bounds.max AS hi FROM c LEFT JOIN w ON w.conversation_id = c.c.conversation_id)
  SELECT conversation_id, n_words, recorded, n_words <> recorded AS miscounted, n_words < lo OR n_words > hi + greatest(35, CAST(round_even(0.28::DOUBLE * (hi - lo), 0) AS INT)) AS violates FROM j""")
def band_violations(spark: SparkSession, d: str) -> DataFrame:
    w = word_count(spark, d).select("conversation_id", "n_words")
    j = conversations(spark, d).join(w, "conversation_id", "left").withColumn("n_words", F.coalesce("n_words", F.lit(0)))
    b = F.col("spoken_word_count_bounds")
    return j.select("conversation_id", "n_words", F.col("transcript_word_count").alias("recorded"), (F.col("n_words") != F.col("transcript_word_count")).alias("miscounted"), dialogue.violates(F.col("n_words"), b["min"], b["max"]).alias("violates"))


@query(f"""WITH {CONVERSATIONS}, p AS (SELECT c.conversation_id AS conversation_id, c.transcript_path AS transcript_path FROM c),
  h AS (SELECT DISTINCT p.transcript_path AS path FROM p JOIN transcript_turns t ON t.conversation_id = p.conversation_id WHERE t.turn_no > 12 AND {strip_sql("coalesce(t.text, '')")} <> '')
  SELECT conversation_id, transcript_path FROM p WHERE transcript_path IS NULL OR transcript_path NOT IN (SELECT path FROM h)""")
def qa_missing_transcripts(spark: SparkSession, d: str) -> DataFrame:
    """Conversations whose file has no thirteenth turn or later one with text: of the tables' conversations every one has some turn."""
    c = conversations(spark, d).select("conversation_id", "transcript_path")
    have = table(spark, d, "transcript_turns").where("turn_no > 12").join(c, "conversation_id").select("transcript_path", "text")
    return telesales.missing_transcripts(c, have)


# ---- vectors ----------------------------------------------------------------------------------------------


@query("SELECT vec_id, round(x[1] / n, 6) AS first, round(x[64] / n, 6) AS last FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x, sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS n FROM embeddings)")
def l2_normalize(spark: SparkSession, d: str) -> DataFrame:
    v = vectors.scaled(vectors.checked(table(spark, d, "embeddings")), "l2")
    return v.select("vec_id", F.round(F.element_at("embedding", 1), 6).alias("first"), F.round(F.element_at("embedding", 64), 6).alias("last"))


_STATS = "x AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings), s AS (SELECT f, avg(x[f]) AS m, stddev_pop(x[f]) AS d, min(x[f]) AS lo, max(x[f]) AS hi FROM x, range(1, 65) r(f) GROUP BY f)"


@query(f"WITH {_STATS} SELECT x.vec_id, round(sum(abs((x.x[s.f] - s.m) / s.d)), 6) AS total FROM x, s GROUP BY x.vec_id")
def standard_scale(spark: SparkSession, d: str) -> DataFrame:
    v = vectors.scaled(table(spark, d, "embeddings"), "standard")
    return v.select("vec_id", F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + F.abs(x)), 6).alias("total"))


@query(f"WITH {_STATS} SELECT x.vec_id, round(sum((x.x[s.f] - s.lo) / (s.hi - s.lo)), 6) AS total FROM x, s GROUP BY x.vec_id")
def minmax_scale(spark: SparkSession, d: str) -> DataFrame:
    v = vectors.scaled(table(spark, d, "embeddings"), "minmax")
    return v.select("vec_id", F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


@query("""WITH v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS x, sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS n FROM embeddings),
  s AS (SELECT a.id, b.id AS neighbour, list_dot_product(a.x, b.x) / (a.n * b.n) AS c FROM v a JOIN v b ON a.id <> b.id),
  r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(c, 12) DESC, neighbour) AS rank FROM s) SELECT id, neighbour, CAST(rank AS INT) AS rank, round(c, 6) AS similarity FROM r WHERE rank <= 15""")
def knn_cosine(spark: SparkSession, d: str) -> DataFrame:
    return vectors.knn(table(spark, d, "embeddings"), 15, "vec_id").select("id", "neighbour", "rank", F.round("similarity", 6).alias("similarity"))


@query("SELECT count(*) AS n_rows, count(*) FILTER (WHERE embedding IS NULL) AS n_null, CAST(min(len(embedding)) AS INT) AS shortest, CAST(max(len(embedding)) AS INT) AS longest, round(CAST(min(list_min(embedding)) AS DOUBLE), 6) AS least FROM voc_collection")
def vector_shape(spark: SparkSession, d: str) -> DataFrame:
    return vectors.shape(table(spark, d, "voc_collection")).withColumn("least", F.round("least", 6))


# ---- topics -----------------------------------------------------------------------------------------------


@query(f"WITH {TOPICS} SELECT cluster, count(document) AS cluster_count FROM t GROUP BY cluster")
def cluster_counts(spark: SparkSession, d: str) -> DataFrame:
    return report.counts(topics(spark, d))


@query(f"WITH {TOPICS} SELECT count(DISTINCT cluster) AS n_clusters, count(DISTINCT CASE WHEN cluster >= 0 THEN cluster END) AS n_topics FROM t")
def cluster_nunique(spark: SparkSession, d: str) -> DataFrame:
    return report.n_clusters(topics(spark, d))


@query("""SELECT count(*) FILTER (WHERE label >= 0) AS n_clusters, CAST(coalesce(sum(n) FILTER (WHERE label < 0 OR label IS NULL), 0) AS BIGINT) AS n_noise_points, count(*) FILTER (WHERE label >= 0 AND n <= 5) AS n_tiny_islands,
  max(n) FILTER (WHERE label >= 0) AS largest_cluster, round(max(n) FILTER (WHERE label >= 0) / sum(n), 6) AS largest_cluster_share FROM (SELECT label, count(*) AS n FROM embeddings GROUP BY label)""")
def cluster_size_metrics(spark: SparkSession, d: str) -> DataFrame:
    m = projection.cluster_metrics(table(spark, d, "embeddings").select(F.col("label").alias("cluster")))
    return m.withColumn("largest_cluster_share", F.round("largest_cluster_share", 6))


@query("SELECT round(stddev_pop(x), 6) AS spread_x, round(stddev_pop(y), 6) AS spread_y, round((max(x) - min(x)) * (max(y) - min(y)), 6) AS bbox_area FROM (SELECT CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings)")
def spread_bbox(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "embeddings").select(F.element_at("embedding", 1).cast("double").alias("x"), F.element_at("embedding", 2).cast("double").alias("y"))
    return projection.spread(p).select(*[F.round(c, 6).alias(c) for c in ("spread_x", "spread_y", "bbox_area")])


@query(f"WITH {SCORED} SELECT keywords, cluster, round(avg(cosine_similarities), 6) AS mean_similarity FROM k GROUP BY keywords, cluster")
def keyword_mean(spark: SparkSession, d: str) -> DataFrame:
    return keywords.mean_similarity(scored(spark, d)).withColumn("mean_similarity", F.round("mean_similarity", 6))


@query("SELECT label, count(*) AS n, CAST(row_number() OVER (ORDER BY count(*) DESC, label) AS INT) AS position FROM embeddings GROUP BY label")
def value_counts(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "embeddings").groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("position", F.row_number().over(Window.orderBy(F.desc("n"), "label")))


@query(f"WITH {TOPICS} SELECT cluster, md5(substr(b, 1, 12000)) AS blob_md5, length(substr(b, 1, 12000)) AS blob_chars, n_documents FROM (SELECT cluster, string_agg(document, chr(10) || chr(10) ORDER BY id) AS b, count(*) AS n_documents FROM t WHERE trim(document) <> '' GROUP BY cluster)")
def cluster_blob(spark: SparkSession, d: str) -> DataFrame:
    b = keywords.blobs(topics(spark, d), 12_000)
    return b.select("cluster", F.md5("blob").alias("blob_md5"), F.length("blob").cast("bigint").alias("blob_chars"), "n_documents")


@query(f"WITH {SCORED} SELECT cluster, keywords, cosine_similarities, round(CASE WHEN sum(cosine_similarities) OVER (PARTITION BY cluster) > 0 THEN cosine_similarities / sum(cosine_similarities) OVER (PARTITION BY cluster) ELSE 0 END, 9) AS weight FROM k")
def keyword_weight(spark: SparkSession, d: str) -> DataFrame:
    return keywords.weighted(scored(spark, d)).withColumn("weight", F.round("weight", 9))


@query(f"WITH {SCORED} SELECT * FROM (SELECT cluster, keywords, cosine_similarities, CAST(row_number() OVER (PARTITION BY cluster ORDER BY cosine_similarities DESC, keywords) AS INT) AS rank FROM k) WHERE rank <= 25")
def topk_keywords(spark: SparkSession, d: str) -> DataFrame:
    return keywords.listing(scored(spark, d), 25)


@query(f"WITH {SCORED} SELECT cluster, keywords, cosine_similarities, CAST(row_number() OVER (PARTITION BY cluster ORDER BY cosine_similarities DESC, keywords) AS INT) AS rank FROM k")
def keyword_listing(spark: SparkSession, d: str) -> DataFrame:
    return keywords.listing(scored(spark, d))


@query("SELECT cluster, CAST(row_number() OVER (ORDER BY CAST(cluster AS VARCHAR)) AS INT) AS position FROM (SELECT DISTINCT label - 1 AS cluster FROM embeddings UNION SELECT DISTINCT label + 9 FROM embeddings)")
def cluster_lex_order(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    c = e.select((F.col("label") - 1).alias("cluster")).union(e.select(F.col("label") + 9)).distinct()
    return c.withColumn("position", F.row_number().over(Window.orderBy(keywords.cluster_key())))


@query("WITH s AS (SELECT DISTINCT label + 1 AS cluster FROM embeddings), n AS (SELECT label AS cluster, count(*) AS n FROM embeddings GROUP BY label) SELECT s.cluster, coalesce(n.n, 0) AS cluster_count FROM s LEFT JOIN n ON n.cluster = s.cluster")
def count_join(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select(F.col("label").alias("cluster"), F.col("vec_id").alias("document"))
    return report.with_counts(e.select((F.col("cluster") + 1).alias("cluster")).distinct(), report.counts(e))


@query("WITH s AS (SELECT DISTINCT label AS cluster FROM embeddings), l AS (SELECT cluster, CASE WHEN cluster % 3 = 0 THEN ' ' WHEN cluster % 3 = 1 THEN 'Fee refund delay -again' END AS label FROM s WHERE cluster < 8) SELECT s.cluster, CASE WHEN coalesce(trim(l.label), '') = '' THEN 'Cluster ' || CAST(s.cluster AS VARCHAR) ELSE 'Fee refund delay' END AS label FROM s LEFT JOIN l ON l.cluster = s.cluster")
def label_join(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "embeddings").select(F.col("label").alias("cluster")).distinct()
    m = F.col("cluster") % 3
    named = s.where("cluster < 8").select("cluster", F.when(m == 0, " ").when(m == 1, "Fee refund delay -again").alias("label"))
    return report.with_labels(s, named)


@query(f"""WITH {SCORED}, s AS (SELECT DISTINCT label AS cluster FROM embeddings UNION SELECT 99), x AS (SELECT *, cosine_similarities / sum(cosine_similarities) OVER (PARTITION BY cluster) AS weight FROM k),
  r AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY cosine_similarities DESC, keywords) AS rank FROM x)
  SELECT s.cluster, coalesce(string_agg('- `' || r.keywords || '`: relevance ' || printf('%.3f', r.cosine_similarities) || ', weight ' || printf('%.3f', r.weight), chr(10) ORDER BY r.rank), '_No keywords for this cluster._') AS keyword_lines
  FROM s LEFT JOIN r ON r.cluster = s.cluster AND r.rank <= 10 GROUP BY s.cluster""")
def keywords_left_join(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "embeddings").select(F.col("label").alias("cluster")).union(spark.sql("SELECT 99")).distinct()
    return report.with_keywords(s, keywords.weighted(scored(spark, d)), 10)


@query(f"""WITH {SCORED}, s AS (SELECT cluster, count(document) AS n FROM t GROUP BY cluster), r AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY cosine_similarities DESC, keywords) AS rank FROM k)
  SELECT CAST(row_number() OVER (ORDER BY CAST(s.cluster AS VARCHAR)) AS INT) AS by_name, CAST(row_number() OVER (ORDER BY s.cluster) AS INT) AS by_number, s.cluster, coalesce(r.keywords, 'Cluster ' || s.cluster) AS label, s.n AS cluster_count
  FROM s LEFT JOIN r ON r.cluster = s.cluster AND r.rank = 1""")
def report_order(spark: SparkSession, d: str) -> DataFrame:
    """The report's rows in both of its orders."""
    n = report.counts(topics(spark, d)).withColumn("text_summary", F.lit(""))
    kw = keywords.weighted(scored(spark, d))
    by_name, by_number = report.frame(n, kw), report.frame(n, kw, numeric=True)
    return by_name.select(F.col("position").alias("by_name"), "cluster", "label", "cluster_count").join(by_number.select(F.col("position").alias("by_number"), "cluster"), "cluster")


@query("SELECT cluster, 'Topic ' || cluster AS label FROM (SELECT DISTINCT label AS cluster FROM embeddings WHERE label >= 0)")
def strict_labels(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "embeddings").where("label >= 0").select(F.col("label").alias("cluster")).distinct()
    return report.strict_labels(s, s.select("cluster", F.concat(F.lit("Topic "), F.col("cluster").cast("string")).alias("label")))


@query("SELECT '| ' || doc_id || ' | ' || replace(replace(replace(coalesce(text, ''), chr(13) || chr(10), '<br>'), chr(10), '<br>'), '|', '\\|') || ' | ' || coalesce(source, '') || ' |' AS line FROM (SELECT * FROM documents ORDER BY doc_id LIMIT 2000)")
def markdown_rows(spark: SparkSession, d: str) -> DataFrame:
    return sinks.markdown_rows(table(spark, d, "documents").select("doc_id", "text", "source"))


@query("SELECT doc_id, lang AS label, n_chars AS size FROM documents WHERE lang IS NOT NULL")
def json_answers(spark: SparkSession, d: str) -> DataFrame:
    """Values read back from answers with a fence, with words around the object, or with a second object behind it."""
    t = table(spark, d, "documents").where("lang IS NOT NULL").select("doc_id", "lang", "n_chars")
    j = F.to_json(F.struct("lang", F.col("n_chars").cast("string").alias("size")))
    said = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("Here:\n```JSON\n"), j, F.lit("\n```\nDone."))).otherwise(F.concat(F.lit("The answer is "), j, F.lit(" as asked.")))
    m = t.select("doc_id", text.json_salvage(said).alias("m"), F.from_json(text.json_prefix(F.concat(j, F.lit(' {"x": 1}'))), "size string").alias("p"))
    return m.select("doc_id", F.col("m")["lang"].alias("label"), F.col("p.size").cast("bigint").alias("size"))


@query("""SELECT source_file, line_no, CAST(TRY_CAST(substr(created_at, 1, 10) AS DATE) AS VARCHAR) AS created_on, CASE WHEN line_no % 3 = 0 THEN -1 ELSE CAST(trunc(line_no / 4.0) AS BIGINT) END AS n,
  source_file AS path, 'elsewhere/' || source_file AS other_path FROM feedback_raw""")
def coerced_fields(spark: SparkSession, d: str) -> DataFrame:
    """Dates from ISO text, counts from text, paths below a folder."""
    r = raw(spark, d)
    n = F.when(F.col("line_no") % 3 == 0, F.lit("many")).otherwise((F.col("line_no") / 4).cast("string"))
    return r.select("source_file", "line_no", text.iso_date("created_at", strict=False).cast("string").alias("created_on"), F.coalesce(text.whole_number(n), F.lit(-1)).alias("n"), text.relative_path(F.concat(F.lit("/in/feedback/"), "source_file"), F.lit("/in/feedback/")).alias("path"), text.relative_path(F.concat(F.lit("elsewhere/"), "source_file"), F.lit("/in")).alias("other_path"))


# ---- sinks and sources, there and back ----------------------------------------------------------------------


@query("""SELECT source_file, count(*) AS n, CAST(coalesce(sum(length(verbatim)), 0) AS BIGINT) AS n_chars, count(DISTINCT case_id) AS n_cases, count(*) FILTER (WHERE has_attachments) AS n_attachments
  FROM (SELECT *, coalesce(nullif(regexp_replace(regexp_replace(branch_code, '^\\s+|\\s+$', '', 'g'), '[<>:"/\\\\|?*]', '_', 'g'), ''), 'branch_unknown') || '.jsonl' AS source_file FROM (SELECT * EXCLUDE (source_file) FROM feedback_raw)) GROUP BY source_file""")
def feedback_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """All records through a file per branch and the strict reader; a branch's further files count as its first."""
    at = f"{shared_folder(spark)}/feedback"
    sinks.branch_jsonl(raw(spark, d).select(*FEEDBACK_COLUMNS), at)
    back = jsonl.records(spark, at).withColumn("source_file", F.regexp_replace("source_file", r"\.\d+\.jsonl$", ".jsonl"))
    return back.groupBy("source_file").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length("verbatim")), F.lit(0)).alias("n_chars"), F.count_distinct("case_id").alias("n_cases"), F.count_if("has_attachments").alias("n_attachments"))


@query(f"""WITH r AS (SELECT {strip_sql("coalesce(case_id, '')")} = '' AS no_id, {strip_sql("coalesce(verbatim, '')")} = '' AS no_text FROM feedback_raw) SELECT 'seen' AS counter, count(*) AS n FROM r UNION ALL SELECT 'malformed', 2
  UNION ALL SELECT 'skipped_id', count(*) FILTER (WHERE no_id) FROM r UNION ALL SELECT 'skipped_text', count(*) FILTER (WHERE no_text AND NOT no_id) FROM r""")
def ingest_counters(spark: SparkSession, d: str) -> DataFrame:
    """What a folder with all records and two lines that are no objects counts."""
    at = f"{shared_folder(spark)}/counted"
    sinks.branch_jsonl(raw(spark, d).select(*FEEDBACK_COLUMNS), at)
    sinks.text_file(spark, '{"case_id": "a"} x\n\n[1]\n', f"{at}/broken.jsonl")
    c = jsonl.counters(spark, at)
    return c.unpivot([], ["seen", "malformed", "skipped_id", "skipped_text"], "counter", "n")


@query(ORACLES["upsert_merge"].replace(", 'new' AS origin", "").replace(", 'old' FROM", " FROM"))
def collection_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """The old points written, the new ones upserted into their buckets, all read back."""
    at = f"{shared_folder(spark)}/store"
    old = table(spark, d, "voc_collection").select("id", "document", F.col("metadata.status").alias("status"), "embedding")
    collection.write(spark, at, "points", old, {"id_mode": "case_id"}, reset=True)
    collection.write(spark, at, "points", ingest.points(raw(spark, d)).select("id", "document", F.col("meta_status").alias("status")))
    return collection.read(spark, at).select("id", "document", "status")


@query("""WITH v AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings), s AS (SELECT a.id, b.label, row_number() OVER (PARTITION BY a.id ORDER BY round(list_dot_product(a.x, b.x) / sqrt(list_dot_product(a.x, a.x) * list_dot_product(b.x, b.x)), 12) DESC, b.id) AS r
  FROM v a JOIN v b ON a.id <> b.id WHERE a.id % 50 = 0) SELECT id, label AS cluster FROM s WHERE r = 1""")
def predicted_clusters(spark: SparkSession, d: str) -> DataFrame:
    """The cluster of the nearest other vector of every vector whose number is divisible by 50."""
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", F.col("label").alias("cluster"))
    return density.predict(v.where("id % 50 = 0").drop("cluster"), v, "id", "embedding").select("id", "cluster")


# ---- without SQL: iterative or seeded -----------------------------------------------------------------------


@query()
def umap_sweep(spark: SparkSession, d: str) -> DataFrame:
    """Metrics of every candidate number of neighbours."""
    return projection.sweep(_points(spark, d), "id", "embedding")


@query()
def hdbscan_labels(spark: SparkSession, d: str) -> DataFrame:
    """Cluster of every usable point after projection to five dimensions."""
    flat = cut_lineage(projection.project(_points(spark, d), "id", "embedding", 15, 5))
    return density.hdbscan(flat, "id", "point", 10).select("id", "cluster")


@query()
def keywords_extracted(spark: SparkSession, d: str) -> DataFrame:
    """Key phrases of every topic."""
    return keywords.extract(topics(spark, d))


@query()
def report_frame(spark: SparkSession, d: str) -> DataFrame:
    """The report's rows for the labelled topics."""
    t = topics(spark, d)
    return report.frame(report.summarise(t), keywords.extract(t))


@query()
def synthetic_feedback(spark: SparkSession, d: str) -> DataFrame:
    """Made-up feedback records, texts asked for chunk by chunk."""
    return synth.feedback(spark)


@query()
def synthetic_dialogues(spark: SparkSession, d: str) -> DataFrame:
    """Made-up dialogues of the right length, written as a batch with its files, read back and joined by path."""
    at = f"{shared_folder(spark)}/telesales"
    specs = synth.dialogue_specs(spark, 20)
    items = cut_lineage(generation.dialogue_items(specs, generation.TemplateItems(), "en", seed=7))
    sinks.telesales_batch(generation.batch(specs, items, "tel-batch-1", (45, 300), "2026-01-01T00:00:00+07:00", "en"), generation.turns_of(items), at)
    c = telesales.conversations(telesales.batches(spark, at))
    n = telesales.transcripts(spark, at).groupBy("transcript_path").agg(F.sum(text.word_count("text")).alias("n_words"))
    return c.join(n, "transcript_path").select("conversation_id", "transcript_path", "duration_slot", "transcript_word_count", "n_words")


@query()
def plane_layout(spark: SparkSession, d: str) -> DataFrame:
    """Coordinates of every usable point in the plane, with its cluster there."""
    return projection.Explorer(_points(spark, d), "id", "embedding").plane(15)[0]


def _points(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "voc_collection").where("embedding IS NOT NULL AND size(embedding) = 64").select("id", "document", "embedding")

"""Made-up feedback and dialogues. Every choice is a hash of the seed and the row, so any partitioning gives the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxmill.config import GeneratorConfig, check_range
from voxmill.functions.dialogue import slot, state, timestamps, tts_bounds, uniform, word_band
from voxmill.functions.text import blank_to_null, branch_code, finalize
from voxmill.operators.generation import CHANNELS, OUTCOMES, PRODUCTS, TYPES, ItemsGenerator, TemplateItems, feedback_items

# The domains of the record's fields.
REGIONS = ("JAVA", "SUMATERA", "KALIMANTAN", "SULAWESI", "BALI_NUSA", "MALUKU", "PAPUA")
QUEUES = ("BRANCH_INTAKE", "BACK_OFFICE", "RETAIL_CARE", None)
FILLER = {"en": ["Please look into this soon.", "I have been a customer for years."], "id": ["Mohon segera ditindaklanjuti.", "Saya sudah lama menjadi nasabah."]}


def pick(values: tuple, *parts: Column) -> Column:
    """One of the values, by the hash of the parts."""
    at = (F.pmod(F.xxhash64(*parts), F.lit(len(values))) + 1).cast("int")
    return F.element_at(F.array(*[F.lit(v).cast("string") for v in values]), at)


def branches(spark: SparkSession, n: int, seed: int) -> DataFrame:
    """(branch_index, region, branch_code), regions dealt out in a seeded order."""
    base = spark.range(1, n + 1).select(F.col("id").cast("int").alias("branch_index"))
    start = F.pmod(F.xxhash64(F.lit(seed)), F.lit(len(REGIONS)))
    region = F.element_at(F.array(*map(F.lit, REGIONS)), (F.pmod(F.col("branch_index") + start, F.lit(len(REGIONS))) + 1).cast("int"))
    return base.withColumn("region", region).withColumn("branch_code", branch_code("region", F.col("branch_index")))


def _token(seed: int, length: int, *parts: Column) -> Column:
    """Upper-case hexadecimal letters that depend on the seed and the parts alone."""
    return F.upper(F.substring(F.sha2(F.concat_ws("/", F.lit(str(seed)), *[p.cast("string") for p in parts]), 256), 1, length))


def customer(seed: int, *parts: Column) -> Column:
    return F.concat(F.lit("SYN-CUST-"), _token(seed, 10, *parts))


def branch_customer(seed: int, n: Column, least: int) -> Column:
    """The customer of a branch's row: any of between `least` and n customers, as many as the seed says."""
    rows = F.greatest(n, F.lit(1))
    low = F.least(F.lit(max(1, least)), rows)
    many = low + F.floor(uniform(F.lit(seed), F.lit("customers"), F.col("branch_index")) * (rows - low + 1)).cast("int")
    own = F.floor(uniform(F.lit(seed), F.lit("who"), F.col("branch_index"), F.col("row_index")) * many).cast("int")
    return F.concat(F.format_string("SYN-CUST-B%02d-U%03d-", F.col("branch_index"), own), _token(seed, 8, F.col("branch_index"), own))


def target_lengths(lo: int, hi: int, seed: int) -> Column:
    """Of each branch and type the first row gets the shortest length, the second the longest, the others any; a single row one of the three."""
    w = Window.partitionBy("branch_index", "submission_type").orderBy("row_index")
    n, size = F.row_number().over(w), F.count(F.lit(1)).over(Window.partitionBy("branch_index", "submission_type"))
    key = (F.col("branch_index"), F.col("row_index"))
    any_ = (F.lit(lo) + F.floor(uniform(F.lit(seed), F.lit("len"), *key) * (hi - lo + 1))).cast("int")
    three = F.floor(uniform(F.lit(seed), F.lit("single"), *key) * 3)
    alone = F.when(three == 0, lo).when(three == 1, hi).otherwise(any_)
    return F.when(size == 1, alone).when(n == 1, lo).when(n == 2, hi).otherwise(any_)


def feedback(spark: SparkSession, n_branches: int = 5, rows_min: int = 5, rows_max: int = 20, min_chars: int = 120, max_chars: int = 600, language: str = "en", year: int = 2026, seed: int = 7, day: str | None = None, least_customers: int = 1, generator: ItemsGenerator | None = None, config: GeneratorConfig = GeneratorConfig()) -> DataFrame:
    """Raw feedback records: per branch a seeded number of rows, half of each submission type, in a seeded order.

    Texts come from the generator, a request a chunk of rows, and are repaired, padded and cut to their bounds. With
    a `day` all records lie on it.
    """
    check_range("rows", rows_min, rows_max, 1)
    check_range("chars", min_chars, max_chars, 1)
    check_range("branches", 1, n_branches)
    check_range("customers", 1, least_customers)
    s = F.lit(seed)
    b = branches(spark, n_branches, seed).withColumn("n", (F.lit(rows_min) + F.floor(uniform(s, F.lit("n"), F.col("branch_index")) * (rows_max - rows_min + 1))).cast("int"))
    r = b.withColumn("made", F.explode(F.expr("sequence(1, n)"))).withColumn("submission_type", F.when(F.col("made") * 2 <= F.col("n") + 1, TYPES[0]).otherwise(TYPES[1]))
    shuffled = Window.partitionBy("branch_index").orderBy(F.xxhash64(s, F.col("branch_index"), F.col("made")), "made")
    r = r.withColumn("row_index", F.row_number().over(shuffled)).withColumn("target_chars", target_lengths(min_chars, max_chars, seed)).drop("made")
    r = r.withColumn("min_chars", F.lit(min_chars)).withColumn("max_chars", F.lit(max_chars))
    before = F.coalesce(F.sum("n").over(Window.orderBy("branch_index").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    firsts = b.withColumn("first", before).select("branch_index", "first")  # a row per branch
    items = feedback_items(r, generator or TemplateItems(), language, config, seed, day)
    key = (F.col("branch_index"), F.col("row_index"))
    u = lambda what: uniform(s, F.lit(what), *key)
    full = repair(items, seed).join(r.select("branch_index", "row_index", "branch_code", "region", "n", F.col("submission_type").alias("asked_type")), ["branch_index", "row_index"]).join(firsts, "branch_index")
    created, updated = timestamps(F.struct(s, *key), config.timezone, F.lit(day).cast("date") if day else None, year)
    case = F.format_string(f"BK-{year}-%08d", F.col("first") + F.col("row_index"))
    return full.select(
        F.lit("bank_complaint_raw").alias("record_type"), F.col("asked_type").alias("submission_type"), case.alias("case_id"), case.alias("ticket_number"), "branch_code", "region", "channel",
        created.alias("created_at"), updated.alias("updated_at"), state(u("st")).alias("status"), "product_bucket", "subject",
        finalize("verbatim", min_chars, max_chars, FILLER.get(language, FILLER["en"]), case).alias("verbatim"), F.lit(language).alias("language"), "has_attachments",
        F.when(u("an") < config.anonymous_fraction, "").otherwise(branch_customer(seed, F.col("n"), least_customers)).alias("customer_ref"),
        F.when(u("q") >= 0.2, pick(QUEUES, s, F.lit("q2"), *key)).alias("assigned_queue"), F.lit(True).alias("synthetic"), F.lit("0.1.0").alias("generator_version"), F.lit("offline").alias("model"),
    )


def repair(df: DataFrame, seed: int = 7, language: str | None = None, submission_type: str | None = None) -> DataFrame:
    """Records with fields forced into their domains: blank subject and product null, an unknown channel replaced, attachments boolean.

    With a language or a submission type (a column's name) every record gets it, whatever it says.
    """
    ok = F.col("channel").isin(*CHANNELS)
    out = (
        df.withColumn("subject", blank_to_null("subject"))
        .withColumn("product_bucket", blank_to_null("product_bucket"))
        .withColumn("channel", F.when(ok, F.col("channel")).otherwise(pick(CHANNELS, F.lit(seed), F.xxhash64(*[F.col(c) for c in df.columns if c != "channel"]))))
        .withColumn("has_attachments", F.coalesce(F.col("has_attachments").cast("boolean"), F.lit(False)))
    )
    out = out if language is None else out.withColumn("language", F.lit(language))
    return out if submission_type is None else out.withColumn("submission_type", F.col(submission_type))


def dialogue_specs(spark: SparkSession, n: int, min_seconds: float = 45, max_seconds: float = 300, language: str = "en", year: int = 2026, seed: int = 7) -> DataFrame:
    """One row per dialogue to write: slot, target seconds, band of words."""
    check_range("dialogues", 1, n)
    check_range("seconds", min_seconds, max_seconds, 1)
    i, total = F.col("row_index"), F.lit(n)
    base = spark.range(1, n + 1).select(F.col("id").cast("int").alias("row_index")).withColumn("duration_slot", slot(i, total))
    target = F.when(F.col("duration_slot") == "minimum", float(min_seconds)).when(F.col("duration_slot") == "maximum", float(max_seconds)).otherwise(F.round(F.lit(float(min_seconds)) + uniform(F.lit(seed), i) * (max_seconds - min_seconds), 2))
    lo, hi = tts_bounds(F.lit(float(min_seconds)), F.lit(float(max_seconds)), F.lit(language))
    b = base.withColumn("target_spoken_seconds", target).withColumn("global_min", lo).withColumn("global_max", hi)
    a, z, mode = word_band(i, total, F.col("target_spoken_seconds"), F.lit(float(min_seconds)), F.lit(float(max_seconds)), F.col("global_min"), F.col("global_max"))
    s = F.lit(seed)
    return b.withColumn("word_count_min", a).withColumn("word_count_max", z).withColumn("duration_word_band_mode", mode).select(
        F.format_string(f"tel-{year}-%08d", i).alias("conversation_id"), "row_index", pick(PRODUCTS, s, F.lit("p"), i).alias("primary_product"), pick(OUTCOMES, s, F.lit("o"), i).alias("outcome"),
        F.when(uniform(s, F.lit("blank"), i) < 0.15, "").otherwise(customer(seed, i)).alias("customer_ref"), "global_min", "global_max", "duration_slot", "target_spoken_seconds", "word_count_min", "word_count_max", "duration_word_band_mode",
    )


def dialogues(specs: DataFrame, words_per_turn: int = 12) -> DataFrame:
    """(conversation_id, turn_no, speaker, text): turns whose words hit the middle of each band."""
    n = F.floor((F.col("word_count_min") + F.col("word_count_max")) / 2).cast("int")
    turns = specs.withColumn("words", n).withColumn("turn_no", F.explode(F.expr(f"sequence(1, CAST(ceil(words / {words_per_turn}) AS INT))")))
    size = F.least(F.lit(words_per_turn), F.col("words") - (F.col("turn_no") - 1) * words_per_turn)
    text = F.array_join(F.transform(F.sequence(F.lit(1), size), lambda k: F.when(k == 1, F.initcap(F.regexp_replace("primary_product", "_", "-"))).otherwise(F.element_at(F.array(*map(F.lit, ("terms", "and", "rates", "please"))), (F.pmod(k, F.lit(4)) + 1).cast("int")))), " ")
    return turns.select("conversation_id", "turn_no", ((F.col("turn_no") + 1) % 2).cast("int").alias("speaker"), text.alias("text"))

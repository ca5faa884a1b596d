"""Records and dialogues written by a service that answers with JSON of a given form: requests, retries, checks.

The service is anything with `request`; TemplateItems stands for one where there is no network. Requests run in the
tasks, one a chunk of rows, so a lost executor repeats only its own.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxmill.config import GeneratorConfig
from voxmill.functions.dialogue import token_budget, turn_cap
from voxmill.functions.text import prefix_object

# The domains of what a service may answer.
TYPES = ("standard_feedback_form", "detailed_complaint_ticket")
CHANNELS = ("branch_counter", "email", "mobile_app", "phone", "internet_banking", "branch_tablet", "ombudsman_escalation", "social")
PRODUCTS = ("account", "card", "digital_channel", "fees", "lending", "mortgage", "other")
OUTCOMES = ("interested", "declined", "callback", "dnc", "transferred")
LANGUAGE_NAMES = {"en": "English", "id": "Bahasa Indonesia"}
#: Attempts to get dialogues of the right length, and what the seed grows by with each.
COMPLIANCE_ATTEMPTS, SEED_STEP = 6, 101
ROWS_MARK = "ROWS: "
FEEDBACK_ITEM = "branch_index int, row_index int, submission_type string, subject string, verbatim string, product_bucket string, channel string, language string, has_attachments boolean"
DIALOGUE_ITEM = "conversation_id string, scenario string, primary_product string, secondary_products array<string>, outcome string, turns array<struct<speaker:int,text:string>>"


class ItemsGenerator(Protocol):
    """A service that answers a prompt with JSON of a schema."""

    def request(self, prompt: str, schema: dict, seed: int | None, max_tokens: int) -> str: ...


class RejectedArgument(ValueError):
    """The service does not take an argument of the request; with a seed it may be the seed."""


def feedback_schema(n: int, language: str) -> dict:
    """The form of n feedback records."""
    text, maybe = {"type": "string"}, {"type": ["string", "null"]}
    item = {"submission_type": {"enum": list(TYPES)}, "subject": maybe, "verbatim": text, "product_bucket": maybe, "channel": {"enum": list(CHANNELS)}, "language": {"enum": [language]}, "has_attachments": {"type": "boolean"}}
    return _items(item, ["submission_type", "verbatim", "channel", "language", "has_attachments"], n)


def dialogue_schema(n: int, most_turns: int) -> dict:
    """The form of n dialogues."""
    turn = {"type": "object", "properties": {"speaker": {"enum": [0, 1]}, "text": {"type": "string"}}, "required": ["speaker", "text"]}
    item = {"row_index": {"type": "integer"}, "scenario": {"type": "string"}, "primary_product": {"type": "string"}, "secondary_products": {"type": "array", "items": {"type": "string"}}, "outcome": {"enum": list(OUTCOMES)}, "turns": {"type": "array", "items": turn, "minItems": 1, "maxItems": most_turns}}
    return _items(item, ["row_index", "outcome", "turns"], n)


def _items(properties: dict, required: list[str], n: int) -> dict:
    item = {"type": "object", "properties": properties, "required": required}
    return {"type": "object", "properties": {"items": {"type": "array", "items": item, "minItems": n, "maxItems": n}}, "required": ["items"]}


def ask(generator: ItemsGenerator, prompt: str, schema: dict, seed: int | None = None, max_tokens: int = 8192, retries: int = 3, backoff: float = 1.5, sleep: Callable[[float], None] = time.sleep) -> dict:
    """The object a service answers with.

    A failed, blank or unreadable answer is asked for again, `retries` times in all, after a pause that grows by
    `backoff` seconds each time; the last error is raised. A request with a seed that is rejected is sent once more
    without one, which costs no attempt.
    """
    attempt, error = 0, None
    while attempt < max(1, retries):
        try:
            raw = generator.request(prompt, schema, seed, max_tokens)
            if not (raw or "").strip():
                raise ValueError("the answer is empty")
            got = prefix_object(raw)
            if got is None:
                raise ValueError("the answer holds no JSON object")
            return got
        except RejectedArgument as e:
            error = e
            if seed is not None:
                seed = None
                continue
        except Exception as e:  # whatever a service's client raises
            error = e
        attempt += 1
        if attempt < retries:
            sleep(backoff * attempt)
    raise error


def items_of(answer: dict, n: int) -> list[dict]:
    """The n items of an answer, in order; another number is an error."""
    got = answer.get("items")
    if not isinstance(got, list) or len(got) != n or not all(isinstance(x, dict) for x in got):
        raise ValueError(f"{n} items were asked for, {len(got) if isinstance(got, list) else 'none'} came")
    return got


def feedback_prompt(rows: list[dict], branch_code: str, region: str, language: str, day: str | None = None) -> str:
    """What to write for the rows of one branch; with a day no text may claim another date."""
    said = LANGUAGE_NAMES.get(language, f"the language of ISO code {language}")
    parts = [
        f"Write {len(rows)} invented records of feedback for a retail bank, as one JSON object with the array items, one item a row and in their order.",
        f"Write subject and verbatim in {said}, on one line each, without names, numbers or addresses of real persons.",
        "A verbatim has at least min_chars and at most max_chars characters, best about target_chars. subject and product_bucket may be null.",
        f"channel is one of {', '.join(CHANNELS)}; product_bucket one of {', '.join(PRODUCTS)}; language is {language}; has_attachments true or false.",
        f"For the tone only: branch {branch_code}, region {region}.",
    ]
    if day:
        parts.append(f"Every record was filed on {day}: no text may name another date of filing, and times are told without dates.")
    return "\n".join([*parts, ROWS_MARK + json.dumps(rows, ensure_ascii=False)])


def dialogue_prompt(rows: list[dict], language: str, most_turns: int) -> str:
    """What to write for telesales dialogues."""
    said = LANGUAGE_NAMES.get(language, f"the language of ISO code {language}")
    parts = [
        f"Write {len(rows)} invented telesales dialogues of a bank in {said}, as one JSON object with the array items, one item a row and in their order, with its row_index.",
        f"Speaker 0 is the agent, speaker 1 the customer; at most {most_turns} turns. All turns together have words_min to words_max spoken words.",
        f"outcome is one of {', '.join(OUTCOMES)}.",
    ]
    return "\n".join([*parts, ROWS_MARK + json.dumps(rows, ensure_ascii=False)])


def spoken_words(item: dict) -> int:
    """Words of the turns of a dialogue; what is no turn counts nothing."""
    turns = item.get("turns")
    return sum(len(str(t.get("text") or "").split()) for t in (turns if isinstance(turns, list) else []) if isinstance(t, dict))


def out_of_band(items: list[dict], rows: list[dict]) -> list[tuple[int, int, int, int]]:
    """(row_index, words, fewest, most) of the dialogues that are too short or exceed their band by more than the slack."""
    out = []
    for item, r in zip(items, rows, strict=True):
        n, lo, hi = spoken_words(item), r["words_min"], r["words_max"]
        if n < lo or n > hi + max(35, round(0.28 * (hi - lo))):
            out.append((r["row_index"], n, lo, hi))
    return out


def complying(generator: ItemsGenerator, rows: list[dict], language: str, most_turns: int, max_tokens: int, seed: int | None = None, attempts: int = COMPLIANCE_ATTEMPTS, **retry) -> list[dict]:
    """Dialogues whose words keep to their bands: asked for again with what was wrong, up to `attempts` times, then an error."""
    base, told, wrong = dialogue_prompt(rows, language, most_turns), "", []
    for k in range(attempts):
        got = items_of(ask(generator, base + told, dialogue_schema(len(rows), most_turns), None if seed is None else seed + SEED_STEP * k, max_tokens, **retry), len(rows))
        wrong = out_of_band(got, rows)
        if not wrong:
            return got
        told = "\nThe last answer had the wrong length: " + "; ".join(f"row {i} had {n} words and needs {lo} to {hi}" for i, n, lo, hi in wrong) + ". Write all rows anew."
    raise ValueError(f"no dialogues of the right length after {attempts} attempts: {wrong}")


class TemplateItems:
    """Answers without a network: reads the rows of the prompt and fills them with stock sentences of the right length."""

    WORDS = {"en": "the branch has not answered my question about this so far and I would like a reply soon please".split(), "id": "cabang belum menjawab pertanyaan saya tentang hal ini dan saya mohon segera dibalas dengan jelas".split()}

    def request(self, prompt: str, schema: dict, seed: int | None, max_tokens: int) -> str:
        rows = json.loads(prompt.split(ROWS_MARK, 1)[1].split("\n", 1)[0])
        return json.dumps({"items": [self._dialogue(r) if "words_min" in r else self._feedback(r, schema, seed or 0) for r in rows]}, ensure_ascii=False)

    def _feedback(self, r: dict, schema: dict, seed: int) -> dict:
        language = schema["properties"]["items"]["items"]["properties"]["language"]["enum"][0]
        ws, k, text = self.WORDS.get(language, self.WORDS["en"]), seed + r["row_index"], ""
        product = PRODUCTS[k % len(PRODUCTS)]
        while len(text) < r["target_chars"]:
            text += (" " if text else "") + (product if k % 19 == 0 else ws[k % len(ws)])
            k += 1
        return {"submission_type": r["submission_type"], "subject": f"{product} {r['row_index']}", "verbatim": text[: r["target_chars"]].strip(), "product_bucket": product, "channel": CHANNELS[k % len(CHANNELS)], "language": language, "has_attachments": k % 7 == 0}

    def _dialogue(self, r: dict) -> dict:
        left, turns, ws = (r["words_min"] + r["words_max"]) // 2, [], self.WORDS["en"]
        size = -(-left // min(28, max(1, left)))
        while left > 0:
            n = min(size, left)
            turns.append({"speaker": len(turns) % 2, "text": " ".join(ws[(len(turns) + i) % len(ws)] for i in range(n))})
            left -= n
        return {"row_index": r["row_index"], "scenario": "cross_sell", "primary_product": r.get("primary_product", PRODUCTS[0]), "secondary_products": [], "outcome": OUTCOMES[r["row_index"] % len(OUTCOMES)], "turns": turns}


def feedback_items(specs: DataFrame, generator: ItemsGenerator, language: str, config: GeneratorConfig = GeneratorConfig(), seed: int | None = None, day: str | None = None) -> DataFrame:
    """The answers for `specs` (branch_index, branch_code, region, row_index, submission_type, min_chars, max_chars, target_chars).

    One request a chunk of a branch's rows. Answers go to rows by their place; another number of answers than rows is
    an error. The submission type is the specification's, whatever the answer says.
    """
    names = ["submission_type", "min_chars", "max_chars", "target_chars"]

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("row_index")
        rows = [{"row_index": int(r.row_index), **{n: (x if isinstance(x := getattr(r, n), str) else int(x)) for n in names}} for r in g.itertuples()]
        first = g.iloc[0]
        prompt = feedback_prompt(rows, first["branch_code"], first["region"], language, day)
        got = items_of(ask(generator, prompt, feedback_schema(len(rows), language), None if seed is None else seed + int(first["branch_index"]) * 1000 + int(first["chunk"]), retries=config.max_retries, backoff=config.retry_backoff_seconds), len(rows))
        text = lambda x: None if x is None else str(x)
        return pd.DataFrame([(int(first["branch_index"]), r["row_index"], r["submission_type"], text(x.get("subject")), str(x.get("verbatim") or ""), text(x.get("product_bucket")), text(x.get("channel")), language, bool(x.get("has_attachments"))) for r, x in zip(rows, got, strict=True)], columns=[f.split()[0] for f in FEEDBACK_ITEM.split(", ")])

    chunk = F.floor((F.col("row_index") - 1) / config.chunk_size).cast("int")
    return specs.withColumn("chunk", chunk).groupBy("branch_index", "chunk").applyInPandas(run, FEEDBACK_ITEM)


def dialogue_items(specs: DataFrame, generator: ItemsGenerator, language: str, config: GeneratorConfig = GeneratorConfig(), seed: int | None = None) -> DataFrame:
    """The dialogues for `specs` (conversation_id, row_index, word_count_min, word_count_max, primary_product), one request each, of the right length."""
    caps = specs.withColumn("most_turns", turn_cap(F.col("word_count_max"))).withColumn("max_tokens", token_budget(F.col("word_count_max"), F.lit(8192)))

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            out = []
            for r in pdf.itertuples():
                row = {"row_index": int(r.row_index), "words_min": int(r.word_count_min), "words_max": int(r.word_count_max), "primary_product": r.primary_product}
                x = complying(generator, [row], language, int(r.most_turns), int(r.max_tokens), None if seed is None else seed + int(r.row_index), retries=config.max_retries, backoff=config.retry_backoff_seconds)[0]
                turns = [{"speaker": int(str(t.get("speaker", "0"))), "text": str(t.get("text") or "")} for t in x["turns"] if isinstance(t, dict)]
                more = x.get("secondary_products")
                out.append((r.conversation_id, str(x.get("scenario") or "cross_sell"), str(x.get("primary_product") or r.primary_product), [str(p) for p in more] if isinstance(more, list) else [], str(x.get("outcome") or "declined"), turns))
            yield pd.DataFrame(out, columns=["conversation_id", "scenario", "primary_product", "secondary_products", "outcome", "turns"])

    return caps.select("conversation_id", "row_index", "word_count_min", "word_count_max", "primary_product", "most_turns", "max_tokens").mapInPandas(run, DIALOGUE_ITEM)


def turns_of(items: DataFrame) -> DataFrame:
    """(conversation_id, turn_no, speaker, text): the turns of dialogues."""
    return items.select("conversation_id", F.posexplode("turns").alias("i", "t")).select("conversation_id", (F.col("i") + 1).alias("turn_no"), "t.speaker", "t.text")


def batch(specs: DataFrame, items: DataFrame, batch_id: str, seconds: tuple[float, float], created_at: str, language: str, model: str = "offline", version: str = "0.1.0", when: Column | None = None) -> DataFrame:
    """One row: the batch document of dialogues and their specifications, joined by conversation_id, in order of row_index.

    A batch is one document, so its dialogues are gathered in one row.
    """
    from voxmill.functions.text import word_count

    j = specs.drop("primary_product", "outcome").join(items, "conversation_id")
    words = F.aggregate("turns", F.lit(0), lambda n, t: n + word_count(t["text"]))
    person = lambda role, name: F.struct(F.lit(role).alias("role"), F.lit(name).alias("display_name"))
    entry = F.struct(
        "row_index", "conversation_id", F.lit("bank_telesales_conversation").alias("record_type"), "scenario", F.lit(language).alias("language"), (when if when is not None else F.lit(created_at)).alias("conversation_datetime"),
        "customer_ref", F.col("branch_code") if "branch_code" in j.columns else F.lit("").alias("branch_code"), "primary_product", "secondary_products", "outcome", F.format_string("conversations/conv-%05d.txt", "row_index").alias("transcript_path"),
        F.create_map(F.lit("0"), person("tele_sales_agent", "Agent"), F.lit("1"), person("customer", "Customer")).alias("speaker_map"), F.array(F.lit("Agent"), F.lit("Customer")).alias("vibevoice_speaker_names"),
        words.alias("transcript_word_count"), "target_spoken_seconds", "duration_slot", "duration_word_band_mode", F.struct(F.col("word_count_min").alias("min"), F.col("word_count_max").alias("max")).alias("spoken_word_count_bounds"),
    )
    got = j.agg(F.transform(F.array_sort(F.collect_list(entry), lambda a, b: a["row_index"] - b["row_index"]), lambda c: c.dropFields("row_index")).alias("conversations"), F.min("global_min").alias("lo"), F.max("global_max").alias("hi"))
    return got.select(
        F.lit(batch_id).alias("batch_id"), F.lit("bank_telesales_batch").alias("record_type"), F.lit(True).alias("synthetic"), F.lit(version).alias("generator_version"), F.lit(model).alias("model"), F.lit(created_at).alias("created_at"),
        F.struct(F.lit(float(seconds[0])).alias("min"), F.lit(float(seconds[1])).alias("max")).alias("spoken_duration_target_seconds"), F.struct(F.col("lo").alias("min"), F.col("hi").alias("max")).alias("spoken_word_count_bounds_global"),
        F.lit("first shortest, last longest, others between").alias("duration_distribution"), F.size("conversations").alias("conversation_count"), "conversations",
    )

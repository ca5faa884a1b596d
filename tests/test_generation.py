"""Requests, retries, checks of length, batches and their files, with a scripted service."""

import json

import numpy as np
import pytest

from voxmill.config import GeneratorConfig
from voxmill.operators import generation as g
from voxmill.operators import report, synth
from voxmill.providers import LocalModelEmbedder, ServiceEmbedder
from voxmill.sources import sinks, telesales


class Script:
    """Answers in order; an exception is raised. Keeps what it was asked."""

    def __init__(self, *answers):
        self.answers, self.asked = list(answers), []

    def request(self, prompt, schema, seed, max_tokens):
        self.asked.append((prompt, seed))
        a = self.answers.pop(0)
        if isinstance(a, Exception):
            raise a
        return a

    def generate(self, prompt):
        return self.request(prompt, None, None, 0)


def test_retries_with_growing_pauses():
    pauses = []
    s = Script(RuntimeError("down"), "  ", '```json\n{"items": []} and more')
    assert g.ask(s, "p", {}, 5, retries=3, backoff=2.0, sleep=pauses.append) == {"items": []}
    assert pauses == [2.0, 4.0] and [x for _, x in s.asked] == [5, 5, 5]
    with pytest.raises(ValueError, match="no JSON"):
        g.ask(Script("a", "b"), "p", {}, retries=2, sleep=pauses.append)


def test_rejected_seed_costs_no_attempt():
    s = Script(g.RejectedArgument("seed"), '{"items": [1]}')
    assert g.ask(s, "p", {}, 5, retries=1, sleep=lambda _: None) == {"items": [1]} and [x for _, x in s.asked] == [5, None]
    with pytest.raises(g.RejectedArgument):
        g.ask(Script(g.RejectedArgument("a"), g.RejectedArgument("b")), "p", {}, 5, retries=1, sleep=lambda _: None)


def dialogue(n, row=1):
    return json.dumps({"items": [{"row_index": row, "outcome": "dnc", "turns": [{"speaker": 0, "text": "w " * n}]}]})


def test_compliance_asks_again_with_what_was_wrong():
    row = {"row_index": 1, "words_min": 100, "words_max": 120, "primary_product": "card"}
    s = Script(dialogue(99), dialogue(156), dialogue(155))
    assert g.spoken_words(g.complying(s, [row], "en", 28, 100, seed=7)[0]) == 155  # the slack is 35
    assert [x for _, x in s.asked] == [7, 108, 209] and "row 1 had 99 words and needs 100 to 120" in s.asked[1][0]
    with pytest.raises(ValueError, match="after 6 attempts"):
        g.complying(Script(*[dialogue(5)] * 6), [row], "en", 28, 100)
    with pytest.raises(ValueError, match="1 items were asked for"):
        g.complying(Script('{"items": []}'), [row], "en", 28, 100)


def test_prompts_state_the_day_and_the_rows():
    p = g.feedback_prompt([{"row_index": 1}], "BR-1", "JAVA", "id", "2026-05-06")
    assert "2026-05-06" in p and "Bahasa Indonesia" in p and json.loads(p.split(g.ROWS_MARK)[1]) == [{"row_index": 1}]
    assert g.feedback_schema(4, "en")["properties"]["items"]["maxItems"] == 4


class Odd:
    """Says other types and channels than asked for."""

    def request(self, prompt, schema, seed, max_tokens):
        rows = json.loads(prompt.split(g.ROWS_MARK)[1])
        return json.dumps({"items": [{"submission_type": "x", "channel": "pigeon", "verbatim": "short", "subject": " ", "language": "xx", "has_attachments": 1} for _ in rows]})


class Short(Odd):
    def request(self, prompt, schema, seed, max_tokens):
        return '{"items": []}'


def test_feedback_is_repaired_and_padded(spark):
    rows = synth.feedback(spark, 2, 3, 5, 50, 90, day="2026-05-06", generator=Odd(), config=GeneratorConfig(chunk_size=2)).collect()
    assert {r.submission_type for r in rows} == set(g.TYPES) and all(r.channel in g.CHANNELS and r.subject is None and r.language == "en" and r.has_attachments for r in rows)
    assert all(50 <= len(r.verbatim) <= 90 and r.created_at.startswith("2026-05-06") for r in rows)
    with pytest.raises(Exception, match="items were asked for"):
        synth.feedback(spark, 1, 3, 3, generator=Short(), config=GeneratorConfig(max_retries=1)).collect()


def test_batch_round_trip(spark, tmp_path):
    at = str(tmp_path / "b1")
    specs = synth.dialogue_specs(spark, 5)
    items = g.dialogue_items(specs, g.TemplateItems(), "en", seed=1)
    sinks.telesales_batch(g.batch(specs, items, "b1", (45, 300), "2026-01-01T00:00:00+07:00", "en"), g.turns_of(items).where("conversation_id <> 'tel-2026-00000003'"), at)
    assert (tmp_path / "b1" / "metadata.json").read_text().startswith('{\n  "batch_id"')
    assert sorted(p.name for p in (tmp_path / "b1" / "conversations").glob("*.txt")) == [f"conv-{i:05d}.txt" for i in range(1, 6)]
    c = telesales.conversations(telesales.batches(spark, at))
    t = telesales.transcripts(spark, at)
    assert [r.conversation_id for r in telesales.missing_transcripts(c, t).collect()] == ["tel-2026-00000003"]
    words = {r.transcript_path: len(" ".join(x.text for x in t.where(t.transcript_path == r.transcript_path).collect()).split()) for r in c.collect()}
    assert all(words[r.transcript_path] == r.transcript_word_count for r in c.collect() if r.row_index != 3)
    assert all(r.spoken_word_count_bounds["min"] <= r.transcript_word_count <= r.spoken_word_count_bounds["max"] for r in c.collect())


def test_labels_and_narrative(spark):
    s = spark.createDataFrame([(0, "a", 3), (1, "b", 2), (-1, None, 1)], "cluster int, text_summary string, cluster_count int")
    svc = Script('{"0": "Slow card refund queue", "1": " "}')
    assert [tuple(r) for r in report.asked_labels(s, svc).collect()] == [(0, "Slow card refund")]
    assert json.loads(svc.asked[0][0].split("\n", 1)[1])[0] == {"cluster_key": "-1", "cluster_count": 1, "text_summary": ""}
    assert report.asked_labels(s, Script("no idea")).count() == 0
    kw = spark.createDataFrame([(0, "fee", 0.5, 1.0)], "cluster int, keywords string, cosine_similarities double, weight double")
    rows = report.frame(s, kw, report.asked_labels(s, Script("{}")), numeric=True)
    assert [(r.cluster, r.label) for r in rows.orderBy("position").collect()] == [(-1, "Cluster -1"), (0, "Cluster 0"), (1, "Cluster 1")]
    svc = Script("## Overview")
    assert report.narrative(rows, svc) == "## Overview" and "## Cluster 0" in svc.asked[0][0]
    assert report.narrative(rows, Script("  ")) == report.NO_NARRATIVE
    named = spark.createDataFrame([(0, "x"), (1, "y")], "cluster int, label string")
    assert report.strict_labels(s.where("cluster >= 0"), named).count() == 2
    with pytest.raises(Exception, match="no label for cluster -1"):
        report.strict_labels(s, named).collect()


def test_local_model_pools_the_last_token():
    run = lambda ids, mask: np.stack([ids, np.ones_like(ids)], -1).astype(float)
    e = LocalModelEmbedder("", max_tokens=3, run=run, encode=lambda t: [ord(c) for c in t])
    a, b, c = e.embed_batch(["ab", "abcdef", ""])
    assert np.allclose(a, np.array([98, 1]) / np.hypot(98, 1)) and np.allclose(b, np.array([99, 1]) / np.hypot(99, 1)) and np.allclose(c, [0, 1])
    assert e.embed_batch([]) == []


def test_service_must_answer_for_every_text():
    assert ServiceEmbedder(lambda t: {"embedding": {"values": [1, 2]}}).embed_batch(["a"]) == [[1, 2]]
    assert ServiceEmbedder(lambda t: {}).embed_batch([]) == []
    with pytest.raises(ValueError, match="1 vectors came for 2"):
        ServiceEmbedder(lambda t: {"embeddings": [{"values": [1]}]}).embed_batch(["a", "b"])

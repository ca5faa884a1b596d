import json

import pytest
from pyspark.sql import functions as F

from voxmill.operators import ingest
from voxmill.plans import pipeline
from voxmill.providers import HashingEmbedder
from voxmill.schemas import FEEDBACK_COLUMNS
from voxmill.sources import collection, jsonl, sinks, telesales
from voxmill.streaming import upsert


def rec(**k):
    return json.dumps({**{c: None for c in FEEDBACK_COLUMNS}, "has_attachments": False, "synthetic": True, **k})


@pytest.fixture()
def folder(tmp_path):
    d = tmp_path / "in"
    (d / "sub").mkdir(parents=True)
    (d / "B.jsonl").write_text("\n".join([
        rec(case_id="c1", verbatim="one", subject="S"), "", "   ", "{broken", '{"case_id":"x","verbatim":"y"} tail', "{'case_id':'x'}", "[1,2]", '"str"', '[{"case_id":"x","verbatim":"y"}]',
        "  " + rec(case_id="c2", verbatim=" two "), '{"case_id":"d","case_id":"c3","verbatim":"dup"}', rec(case_id=None, verbatim="q"), rec(case_id=" ", verbatim=None), rec(case_id="c4", verbatim=" "), '{"case_id":7,"verbatim":"num","status":{"a":[1]}}',
    ]) + "\n", encoding="utf-8")
    (d / "c.jsonl").write_text(rec(case_id="c1", verbatim="later") + "\n", encoding="utf-8")
    (d / "sub" / "no.jsonl").write_text(rec(case_id="zz", verbatim="no") + "\n")
    (d / "no.txt").write_text(rec(case_id="zz", verbatim="no") + "\n")
    return str(d)


def test_counters(spark, folder):
    assert jsonl.counters(spark, folder).first().asDict() == {"seen": 8, "skipped_id": 2, "skipped_text": 1, "malformed": 6}


def test_points(spark, folder):
    raw = jsonl.records(spark, folder)
    got = {r.id: (r.document, r.meta_source_file, r.meta_status) for r in ingest.points(raw).collect()}
    assert got == {"c1": ("later", "c.jsonl", ""), "c2": ("two", "B.jsonl", ""), "c3": ("dup", "B.jsonl", ""), "7": ("num", "B.jsonl", '{"a": [1]}')}
    both = {r.id: r.document for r in ingest.points(raw, "composite", include_subject=True).collect()}
    assert both["B:c1"] == "S\n\none" and both["c:c1"] == "later"


def test_missing_folder(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        jsonl.scan(spark, str(tmp_path))


def test_collection_rules(spark, tmp_path, folder):
    root = str(tmp_path / "store")
    with pytest.raises(ValueError):
        collection.resolve(spark, root)
    assert pipeline.ingest_feedback(spark, folder, root, "one")["seen"] == 8
    assert collection.read(spark, root).count() == 4
    assert collection.metadata(spark, root, "one")["embedding_dim"] == "64"
    pipeline.ingest_feedback(spark, folder, root, "one")
    assert collection.read(spark, root).count() == 4
    new = spark.createDataFrame([("c1", "new", [1.0]), ("n", "n", [2.0])], "id string, document string, embedding array<float>")
    collection.write(spark, root, "one", new)
    assert {r.id: r.document for r in collection.read(spark, root).collect()}["c1"] == "new"
    collection.write(spark, root, "one", new, reset=True)
    assert collection.read(spark, root).count() == 2
    collection.write(spark, root, "Two", new)
    with pytest.raises(ValueError, match="one, Two"):
        collection.resolve(spark, root)
    with pytest.raises(ValueError):
        collection.resolve(spark, root, "three")


def test_stream_is_idempotent(spark, tmp_path, folder):
    root = str(tmp_path / "s")
    for k in range(2):
        upsert.start(spark, folder, root, "c", str(tmp_path / f"ck{k}"), HashingEmbedder()).awaitTermination()
    assert collection.read(spark, root).count() == 4


def test_upsert_with_other_columns(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "id string, x int")
    new = spark.createDataFrame([("b", "y"), ("b", "y"), ("c", None)], "id string, z string")
    assert sorted((r.id, r.x, r.z or "") for r in ingest.upsert(old, new).collect()) == [("a", 1, ""), ("b", None, "y"), ("b", None, "y"), ("c", None, "")]


def test_sequence_is_gapless(spark):
    df = spark.createDataFrame([("b", 2), ("a", 9), (None, 1), ("a", 3)], "g string, x int")
    got = [(r.g, r.x) for r in jsonl.with_sequence(df, "g", "x").orderBy("seq").collect()]
    assert got == [(None, 1), ("a", 3), ("a", 9), ("b", 2)]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "q"\nline'), (2, None)], "cluster int, text_summary string")
    sinks.csv(df, str(tmp_path / "csv"))
    back = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(str(tmp_path / "csv"))
    assert sorted((r.cluster, r.text_summary) for r in back.collect()) == [("1", 'a "q"\nline'), ("2", None)]
    assert sinks.markdown_table(df, 1).endswith("_First 1 rows._")
    b = spark.createDataFrame([("BR/1", "x"), (" ", "y")], "branch_code string, verbatim string")
    sinks.branch_jsonl(b, str(tmp_path / "b"))
    assert sorted(p.name for p in (tmp_path / "b").iterdir() if p.suffix == ".jsonl") == ["BR_1.jsonl", "branch_unknown.jsonl"]
    assert sorted((r.source_file, r.branch_code, r.verbatim) for r in jsonl.records(spark, str(tmp_path / "b")).collect()) == [("BR_1.jsonl", "BR/1", "x"), ("branch_unknown.jsonl", " ", "y")]


def test_transcript_round_trip(spark, tmp_path):
    turns = spark.createDataFrame([("c", 1, 0, " hi: there "), ("c", 2, 1, " "), ("c", 3, 1, "bye")], "conversation_id string, turn_no int, speaker int, text string")
    t = telesales.format_transcripts(turns).first()["transcript"]
    assert t == "Speaker 0: hi: there\nSpeaker 1: bye\n"
    (tmp_path / "c.txt").write_text(t)
    assert [(r.turn_no, r.speaker, r.text) for r in telesales.transcripts(spark, str(tmp_path)).orderBy("turn_no").collect()] == [(1, 0, "hi: there"), (2, 1, "bye")]


def test_buckets_and_versions(spark, tmp_path):
    root = str(tmp_path / "s")
    pts = spark.createDataFrame([(f"p{i}", f"t{i}", [float(i)]) for i in range(200)], "id string, document string, embedding array<float>")
    collection.write(spark, root, "c", pts, buckets=8)
    for k in range(3):
        collection.write(spark, root, "c", spark.createDataFrame([("p7", f"new{k}", [1.0])], pts.schema))
    got = {r.id: r.document for r in collection.read(spark, root, "c").collect()}
    assert len(got) == 200 and got["p7"] == "new2"
    folders = [p for p in (tmp_path / "s" / "c").glob("v*/_bucket=*")]
    assert len(folders) == 9  # eight buckets and the version before of the one that was touched
    collection.delete(spark, root, "c")
    collection.delete(spark, root, "c")
    assert collection.names(spark, root) == []


def test_sequence_of_a_hot_value(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 3 < 2, "a").otherwise("b").alias("g"), F.pmod(F.xxhash64("id"), F.lit(100000)).alias("x"), "id")
    got = jsonl.with_sequence(df, "g", "x", "id").orderBy("seq").collect()
    assert [r.seq for r in got] == list(range(1, 5001)) and [(r.g, r.x, r.id) for r in got] == sorted((r.g, r.x, r.id) for r in got)


def test_stream_keeps_the_order_of_lines(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for f, texts in (("b.jsonl", ["x", "y"]), ("a.jsonl", ["p", "q"])):
        (tmp_path / "in" / f).write_text("".join(json.dumps({"case_id": "c", "verbatim": f"{f} {t}"}) + "\n" for t in texts))
    upsert.start(spark, str(tmp_path / "in"), str(tmp_path / "s"), "c", str(tmp_path / "ck"), HashingEmbedder()).awaitTermination()
    assert [r.document for r in collection.read(spark, str(tmp_path / "s")).collect()] == ["b.jsonl y"]


def test_bad_id_mode():
    with pytest.raises(ValueError):
        ingest.point_id("other")

import pytest
from pyspark.sql import functions as F

from voxmill.functions import dialogue, text


def one(spark, expr, value="x", kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expr.alias("o")).first()["o"]


@pytest.mark.parametrize(("given", "want"), [("   a b\n", "a b"), ("", ""), (None, None), (" ", "")])
def test_ustrip(spark, given, want):
    assert one(spark, text.ustrip("v"), given) == want


@pytest.mark.parametrize(("given", "want"), [("naïve café-x 😀", 3), ("", 0), (None, 0), ("a b", 2)])
def test_word_count(spark, given, want):
    assert one(spark, text.word_count("v"), given) == want


@pytest.mark.parametrize(("given", "want"), [("  Fee  Transparency -issues, naïve", "Fee Transparency -issues"), ("?!…", text.UNNAMED), (None, text.UNNAMED)])
def test_first_words(spark, given, want):
    assert one(spark, text.first_words("v"), given) == want


def test_clamp_and_pad(spark):
    assert one(spark, text.clamp("v", 5), "abc defg") == "abc…"
    assert one(spark, text.clamp("v", 8), "abc defg") == "abc defg"
    assert one(spark, text.clamp("v", 5), None) is None
    padded = one(spark, text.finalize("v", 30, 40, ["one two.", "three."], F.lit(1)), "  short ")
    assert padded.startswith("short ") and len(padded) == 30


def test_filename(spark):
    assert one(spark, text.safe_filename("v"), 'a<b>c:"d"/e\\f|g?h*') == "a_b_c__d__e_f_g_h_"
    assert one(spark, text.safe_filename("v"), "  ") == "branch_unknown"
    assert one(spark, text.safe_filename("v"), None) == "branch_unknown"


@pytest.mark.parametrize(("given", "want"), [("English", "en"), (" ID ", "id"), ("fr", "fr"), ("f1", None), (None, "en"), ("", "en"), ("  ", None), ("in", "id"), ("ind", None), ("eng", None), ("klingon", None)])
def test_language(spark, given, want):
    assert one(spark, text.language_code("v"), given) == want


@pytest.mark.parametrize(("given", "want"), [(0.6625, "0.662"), (0.6405, "0.640"), (0.6765, "0.676"), (1234.5, "1234.500")])
def test_fixed(spark, given, want):
    assert one(spark, text.fixed("v", 3), given, "double") == want


def test_json_readers():
    assert text.salvage("```JSON\n{\"a\": 1}\n```") == {"a": 1}
    assert text.salvage('well {"a": "b"} so') == {"a": "b"}
    assert text.salvage("") == {} and text.salvage(None) == {}
    assert text.salvage("none") is None and text.salvage('{"a": 1} so') is None
    assert text.prefix_object('﻿```json\n{"a": 1} {"b": 2}') == {"a": 1}
    assert text.prefix_object("[1]") is None


def test_markdown_cell(spark):
    assert one(spark, text.markdown_cell("v"), "a|b\nc") == "a\\|b<br>c"
    assert one(spark, text.markdown_cell("v"), None) == ""


def test_golden_bands(spark):
    golden = [(1, 45.0, 129, 187), (2, 227.59, 440, 536), (3, 223.84, 432, 528), (4, 151.98, 291, 387), (5, 159.55, 306, 402), (6, 115.94, 220, 316), (7, 266.67, 517, 613), (8, 238.5, 461, 557), (9, 85.71, 161, 257), (10, 300.0, 572, 630)]
    df = spark.createDataFrame(golden, "i int, t double, lo int, hi int")
    a, b = dialogue.tts_bounds(F.lit(45.0), F.lit(300.0), F.lit("en"))
    x, y, mode = dialogue.word_band(F.col("i"), F.lit(10), F.col("t"), F.lit(45.0), F.lit(300.0), a, b)
    for r in df.select("*", x.alias("x"), y.alias("y"), mode.alias("m"), a.alias("a"), b.alias("b")).collect():
        assert (r.x, r.y, r.m, r.a, r.b) == (r.lo, r.hi, "per_slot", 129, 630)


def test_band_fallbacks_and_slots(spark):
    df = spark.createDataFrame([(1, 1), (1, 2), (2, 2), (2, 3)], "i int, n int")
    assert [r.s for r in df.select(dialogue.slot(F.col("i"), F.col("n")).alias("s")).collect()] == ["maximum", "minimum", "maximum", "random"]
    band = dialogue.word_band(F.lit(1), F.lit(3), F.lit(10.0), F.lit(10.0), F.lit(10.0), F.lit(100), F.lit(120))
    r = df.limit(1).select(*[c.alias(n) for c, n in zip(band, "abm", strict=True)]).first()
    assert (r.a, r.b, r.m) == (100, 120, "global")


def test_violations(spark):
    got = [one(spark, dialogue.violates(F.col("v"), F.lit(440), F.lit(536)), w, "int") for w in (439, 440, 536, 571, 572)]
    assert got == [True, False, False, False, True]


def test_states_and_nps(spark):
    us = [0.0, 0.15, 0.151, 0.4, 0.75, 0.9, 0.95, 0.96]
    assert [one(spark, dialogue.state(F.col("v")), u, "double") for u in us] == ["open", "open", "in_progress", "in_progress", "resolved", "closed", "escalated", "closed"]
    assert [one(spark, dialogue.nps_segment(F.col("v")), n, "int") for n in (10, 8, 6, None)] == ["promoter", "passive", "detractor", None]


def test_dates_counts_and_paths(spark):
    assert [one(spark, text.iso_date("v").cast("string"), v) for v in ("2026-02-03", " 2026-02-03T04:05:06+07:00 ", "20260203", "", None)] == ["2026-02-03"] * 3 + [None, None]
    assert one(spark, text.iso_date("v", strict=False), "3 May") is None
    with pytest.raises(Exception, match="no ISO date"):
        one(spark, text.iso_date("v"), "2026-13-40")
    assert [one(spark, text.whole_number("v"), v) for v in ("7", "7.9", "many", None)] == [7, 7, None, None]
    assert one(spark, text.relative_path("v", F.lit("/a/b/")), "/a/b/c/d.txt") == "c/d.txt" and one(spark, text.relative_path("v", F.lit("/a/x")), "/a/b/c") == "/a/b/c"
    with pytest.raises(Exception, match="start lies after"):
        spark.range(1).select(dialogue.date_range(F.lit("2026-02-01").cast("date"), F.lit("2026-01-01").cast("date"))[0]).collect()


def test_timestamps(spark):
    df = spark.range(400).select(*[c.alias(f"c{i}") for i, c in enumerate((*dialogue.timestamps(F.col("id")), *dialogue.timestamps(F.col("id"), "Z", F.lit("2026-05-06").cast("date"))))])
    rows = df.collect()
    assert all(r.c1 is None or r.c1 >= r.c0 for r in rows) and all(8 <= int(r.c0[11:13]) <= 18 and r.c0.endswith("+07:00") and r.c0 < "2026-12-29" for r in rows)
    assert all(r.c2[:10] == "2026-05-06" and (r.c3 is None or r.c2 <= r.c3 < "2026-05-07") for r in rows)
    assert 0.25 < sum(r.c1 is None for r in rows) / 400 < 0.45


def test_padding_varies(spark):
    got = one(spark, text.pad("v", 200, ["one two.", "three.", "four five six."], F.lit(3)), "x")
    assert len(got) == 200 and all(p in got for p in ("one two.", "three.", "four five six."))

"""Every operator of the subpackage on small made-up rows: results, nulls, empty tables, ties, clashing columns."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxmill.llm import p1_repetition as p1
from voxmill.llm import p2_truncation as p2
from voxmill.llm import p3_personal as p3
from voxmill.llm import p4_near_duplicates as p4
from voxmill.llm import p5_neighbours as p5
from voxmill.llm import p6_language as p6
from voxmill.llm import p7_clusters as p7
from voxmill.llm import p8_packing as p8
from voxmill.llm import p9_mixing as p9
from voxmill.llm import p10_abuse as p10
from voxmill.llm import queries, tokens
from voxmill.llm.vectors import usable

PLAIN = [
    "The branch opened late on Monday and nobody told us why the queue was so long.",
    "My card was swallowed by the machine and the clerk could not return it to me.",
    "Please send the corrected statement to our office before the end of the month.",
    "The application closed twice while we were paying the supplier for new tiles.",
    "We waited at counter nine and then the manager left without any explanation.",
]


def texts(spark, rows, schema="id string, text string, source string, lang string, score double, n int, label string"):
    """Rows with columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "s", "x", 1.0, 2, None) for i, t in rows], schema)


def test_p1_share_against_brute_force(spark):
    def brute(t):
        ws = p1.WORD.findall(t.lower())
        covered = set()
        for i in range(len(ws) - p1.STRETCH + 1):
            if any(ws[j : j + p1.STRETCH] == ws[i : i + p1.STRETCH] for j in range(i)):
                covered |= set(range(i, i + p1.STRETCH))
        return len(covered) / max(len(ws), 1)

    rows = [*PLAIN, PLAIN[0] + " " + PLAIN[0].upper().replace("QUEUE", "QUEUE!"), "no " * 40, " ".join(f"Attempt {k}: the line broke." for k in range(9)), "", "123 456", "x"]
    _, share, n = p1.profile([*rows, None])
    assert np.allclose(share[:-1], [brute(t) for t in rows]) and share[-1] == 0 and n[-1] == 0


def test_p1_cases_and_edges(spark):
    rows = [(f"k{i}", t + " " + PLAIN[(i + 1) % 5]) for i, t in enumerate(PLAIN)] + [("rep", (PLAIN[0] + " ") * 2), ("loop", "why " * 60), ("rep", (PLAIN[0] + " ") * 2), (None, None), ("e", ""), ("long", " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}" for i in range(15000)))]
    got = {r.id: r.is_repetitive for r in p1.score(texts(spark, rows), "id", "text").collect()}
    assert {k for k, v in got.items() if v} == {"rep", "loop"} and None in got and len(got) == 10
    assert p1.score(texts(spark, []), "id", "text").count() == 0


def corpus(n=60):
    return [(f"c{i}", " ".join(PLAIN[(i + k) % 5] for k in range(4))) for i in range(n)]


def test_p2_cuts(spark):
    full = [(i, t, "web") for i, t in corpus()]
    cut = [("word", PLAIN[0] + " " + PLAIN[1][:38], "web"), ("sentence", PLAIN[2] + " Please send the corrected", "web"), ("bytes", PLAIN[3] + " The bra�", "web"), ("entity", PLAIN[3] + " He &am", "web"), ("bracket", PLAIN[3] + " He said (no", None)]
    whole = [("bare", PLAIN[0] + " " + PLAIN[1][:-1], "web"), ("smile", PLAIN[0][:-1] + " :(", "web"), ("dots", PLAIN[0][:-1] + "...", None)]
    df = spark.createDataFrame([*full, *cut, *cut, *whole, ("n", None, "web"), ("b", "  ", "web")], "id string, text string, source string").withColumn("verdict", F.lit(1)).withColumn("n", F.lit(2))
    got = {r.id: r for r in p2.truncation(df, "id", "text", "source").collect()}
    assert {i for i, r in got.items() if r.is_cut} == {c[0] for c in cut} and len(got) == 68
    assert got["word"].verdict == "in_word" and got["bytes"].verdict == "broken"
    assert p2.truncation(df.limit(0), "id", "text", "source").count() == 0


def test_p2_field_limit(spark):
    sized = [(f"l{k}", (PLAIN[k % 5] + " " + PLAIN[(k + 1) % 5] + " " + PLAIN[(k + 2) % 5])[:150]) for k in range(12)]
    df = spark.createDataFrame([(i, t, "tablet") for i, t in sized] + [(i, t, "web") for i, t in corpus()], "id string, text string, source string")
    got = {r.id: r.is_cut for r in p2.truncation(df, "id", "text", "source").collect()}
    assert sum(got[i] for i, _ in sized) >= 10 and not any(v for k, v in got.items() if k[0] == "c")


PII = {
    "email": ["mail me at ann.lee+x@post.example please", "write ann_lee [at] post [dot] example now", "ANN @ INBOX.TEST"],
    "phone": ["call +62 855 5550 6864 now", "call 0 8 5 5 5 5 5 9 4 4 6.", "(021) 5550639", "62.855.5550.2486", "555-0164"],
    "id_number": ["national id 0045 7636 5557 3947", "NIK 004280-192971-0041", "tax 00.818.282.9-925.000", "I showed X 0701559 as my passport", "My identity card is 0038 6599 8406 9811"],
    "address": ["I live at 12 Larkholm Road.", "di Jl. Mawar No. 6", "Gang Melati Blok C7", "Er wohnt Brunhelmstraße 17", "au 87, avenue Valdorna", "Vivo en calle Sauvance 1"],
}
CLEAN = ["reference TRX-67657465 and ticket 1766/184", "the trace number printed below was 2026442349430727", "interest @ 9.89 percent on 2026-07-08", "Rp 9,970,000 and IDR 3325000", "batch 76148566 of 12/03/2026", "on the road from Lonvale to Marl"]


def test_p3_forms(spark):
    rows = [(f"{k}{i}", t) for k, ts in PII.items() for i, t in enumerate(ts)] + [(f"clean{i}", t) for i, t in enumerate(CLEAN)] + [("n", None), ("e", "")]
    got = {(r.id.rstrip("0123456789"), r.id, r.kind) for r in p3.findings(texts(spark, rows), "id", "text").collect()}
    assert {(k, f"{k}{i}", k) for k, ts in PII.items() for i in range(len(ts))} == got


def test_p3_names_and_placeholders(spark):
    people = [f"{a}{b}" for a in ("Velor", "Nimar", "Tarel", "Rosun") for b in ("in", "obel", "vin")]
    rows = [(f"r{i}", f"{PLAIN[i % 5]} My name is {a} Quillorsk. {PLAIN[(i + 1) % 5]}") for i, a in enumerate(people)]
    rows += [("signed", f"{PLAIN[0]} {people[0]} Quillorsk asked again."), ("none", " ".join(PLAIN)), ("none", " ".join(PLAIN)), (None, "x"), ("null", None)]
    df = texts(spark, rows)
    named = {r.id for r in p3.findings(df, "id", "text").collect() if r.kind == "name"}
    assert named == {f"r{i}" for i in range(len(people))} | {"signed"}
    red = {r.id: r.redacted for r in p3.redact(df, "id", "text").collect()}
    assert red["r0"] == f"{PLAIN[0]} My name is [NAME]. {PLAIN[1]}" and red["none"] == " ".join(PLAIN) and red["null"] is None
    assert p3.redact(texts(spark, []), "id", "text").count() == 0


def test_p3_hot_names_and_phrases(spark):
    rows = [(f"copy{i}", f"{PLAIN[0]} My name is Velorin Quillorsk. {PLAIN[1]}") for i in range(60)]
    rows += [(f"staff{i}", f"{PLAIN[i % 5]} I asked for Nimarbel Tarelvin at counter {i}.") for i in range(60)]
    rows += [(f"phrase{i}", f"The contact desk {i} was closed. {PLAIN[2]} The desk stayed empty, no desk was open.") for i in range(60)]
    named = {r.id for r in p3.findings(texts(spark, rows), "id", "text").collect() if r.kind == "name"}
    assert named == {f"{k}{i}" for k in ("copy", "staff") for i in range(60)}


def test_p3_ordinary_words_in_the_form_of_an_address(spark):
    rows = [(f"way{i}", f"Mohon kirim ongkos jalan paling lambat 1{i % 9} maret.") for i in range(30)] + [(f"late{i}", f"Balasan paling lambat besok, di jalan dari Marl, bagian {i}.") for i in range(120)]
    rows += [(f"road{i}", f"On the road from Marl, part {i}.") for i in range(60)] + [("home", "Saya tinggal di jalan Wirantaka 12."), ("lane", "I live at 7 Fennshaw Road.")]
    assert {(r.id, r.kind) for r in p3.findings(texts(spark, rows), "id", "text").collect()} == {("home", "address"), ("lane", "address")}


def test_p3_rare_words_around_a_number(spark):
    spell = lambda i: "".join(chr(97 + i // 26**e % 26) for e in range(3))
    rows = [(f"code{n}-{i}", f"q{spell(i)} r{spell(i)} s{spell(i)} t{spell(i)} 8{i:015d} u{spell(i)} v{spell(i)} w{spell(i)}. Part {n}.") for i in range(300) for n in range(4)]
    rows += [(f"shape{n}", f"zzrare zzseldom 3171-2345-6789-0123 zzscarce. Part {n}.") for n in range(2)] + [("number", "zzrare zzseldom 31712345678901234 zzscarce")]
    got = {(r.id, r.kind) for r in p3.findings(texts(spark, rows), "id", "text").collect()}
    assert got == {(k, "id_number") for k in ("shape0", "shape1", "number")}


def brute_groups(rows, least=p4.SIMILARITY):
    sets = {i: frozenset(p4.WORD.findall(t.lower())) for i, t in rows if i and t and p4.WORD.findall(t.lower())}
    up = {i: i for i in sets}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in itertools.combinations(sets, 2):
        if len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]):
            up[top(a)] = top(b)
    return {frozenset(k for k in sets if top(k) == r) for r in map(top, sets)}


def test_p4_hot_keys_and_large_groups(spark, monkeypatch):
    """Blocks of hot keys and of large groups give what one task gives."""
    rows = [(f"k{i:02d}", f"{PLAIN[0]} {PLAIN[1]} number w{i}") for i in range(30)] + [(f"o{i}", t) for i, t in enumerate(PLAIN[2:])]
    plain = sorted(map(tuple, p4.pairs_within(p4.groups(texts(spark, rows), "id", "text"), "id", "group_id").collect()))
    for name, v in (("BIN_KEYS", 1), ("HOT_ROWS", 2), ("GROUP_ROWS", 4), ("PARTITION_KEYS", 100)):
        monkeypatch.setattr(p4, name, v)
    cut = p4.groups(texts(spark, rows), "id", "text")
    assert sorted(map(tuple, p4.pairs_within(cut, "id", "group_id").collect())) == plain == [(f"k{i:02d}", f"k{j:02d}") for i in range(30) for j in range(i + 1, 30)]
    assert {r.n_links for r in cut.where("id LIKE 'k%'").collect()} == {29}


def test_p4_against_brute_force(spark):
    rng = np.random.default_rng(5)
    words = [f"w{k}" for k in range(3000)]
    rows = []
    for g in range(40):
        base = list(rng.choice(words, 60, replace=False))
        for v in range(3):
            t = list(base)
            for _ in range(int(rng.integers(0, 7))):
                t[int(rng.integers(60))] = str(rng.choice(words))
            rng.shuffle(t)
            rows.append((f"g{g:02d}v{v}", " ".join(t)))
    rows += [("copy1", rows[0][1]), ("copy2", rows[0][1].upper()), ("n", None), ("e", ""), ("p", "?!"), ("g00v0", rows[0][1])]
    got = {}
    for r in p4.groups(texts(spark, rows), "id", "text").collect():
        got.setdefault(r.group_id, set()).add(r.id)
    assert {frozenset(v) for v in got.values()} == brute_groups(rows)
    assert p4.groups(texts(spark, []), "id", "text").count() == 0


def test_p4_hot_class(spark):
    df = spark.range(3000).select(F.concat(F.lit("k"), "id").alias("id"), F.when(F.col("id") % 3 == 0, PLAIN[0]).otherwise(F.concat(F.lit("only "), F.sha2(F.col("id").cast("string"), 256))).alias("text"))
    g = p4.groups(df, "id", "text").groupBy("group_id").count().agg(F.max("count")).first()[0]
    assert g == 1000


def test_p5_recall_and_edges(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(900, 16))
    x[7] = x[8]
    rows = [(f"i{k}", v.tolist()) for k, v in enumerate(x)] + [("z", [0.0] * 16), ("n", None), ("s", [1.0]), (None, [1.0] * 16), ("nan", [float("nan")] * 16)]
    pts = usable(spark.createDataFrame(rows, "id string, e array<double>"), "id", "e", 16)
    assert pts.count() == 900
    asked = pts.where("id IN ('i7', 'i1', 'i2', 'i3', 'i4', 'i5')").select(F.col("id").alias("query"), "id", "v", F.lit(10).alias("k"))
    u = x / np.linalg.norm(x, axis=1)[:, None]
    got = {}
    for r in p5.search(p5.build_index(pts, 16), asked, 16).collect():
        got.setdefault(r["query"], set()).add(r["id"])
    hits = 0
    for q, found in got.items():
        i = int(q[1:])
        s = u @ u[i]
        s[i] = -9
        hits += len(found & {f"i{j}" for j in np.argsort(-s)[:10]})
        assert q not in found and len(found) == 10
    assert hits >= 0.95 * 60
    assert p5.search(p5.build_index(pts.limit(0), 16), asked, 16).count() == 0


SAMPLES = {
    "en": ["The branch was closed when we came back from lunch.", "Nobody could explain why the money was missing.", "Please send the letter to our office."],
    "id": ["Kantor cabang tutup ketika kami kembali dari makan siang.", "Tidak ada yang bisa menjelaskan mengapa uangnya hilang.", "Mohon kirim surat itu ke kantor kami."],
    "de": ["Die Filiale war geschlossen, als wir vom Essen kamen.", "Niemand konnte erklären, warum das Geld fehlte.", "Bitte schicken Sie den Brief an unser Büro."],
}


def test_p6_labels_and_mixes(spark):
    rows = [(f"{k}{i}", " ".join(v[(i + j) % 3] for j in range(3)), k if i else "unknown") for k, v in SAMPLES.items() for i in range(12)]
    rows += [("mix", " ".join(SAMPLES["en"] + SAMPLES["de"]), "English"), ("wrong", " ".join(SAMPLES["id"]), "de"), ("n", None, "en"), ("e", "", None)]
    d = p6.documents(spark.createDataFrame(rows, "id string, text string, lang string").withColumn("label", F.lit(1)), "id", "text", "lang")
    got = {r.id: r for r in d.collect()}
    assert got["mix"].langs == ["de", "en"] and got["mix"].unlabelled == ["de"]
    assert got["wrong"].lang == "id" and got["wrong"].unlabelled == ["id"]
    assert got["id0"].unlabelled == ["id"] and got["en3"].unlabelled == [] and got["n"].lang is None and got["e"].langs == []
    assert p6.label_languages("id-ID") == ["id"] and p6.label_languages("en/id") == ["en", "id"] and p6.label_languages(" - ") == [] and p6.label_languages("en-ID") == ["en"]
    s = p6.segments(spark.createDataFrame(rows, "id string, text string, lang string"), "id", "text", "lang").where("id = 'mix'").orderBy("segment_no").collect()
    assert [r.lang for r in s] == ["en"] * 3 + ["de"] * 3 and s[0].start == 0 and s[3].start == sum(map(len, SAMPLES["en"])) + 3
    empty = spark.createDataFrame([], "id string, text string, lang string")
    assert p6.documents(empty, "id", "text", "lang").count() == 0


def test_p6_short_foreign_sentence(spark):
    short = {k: next(" ".join(w[:e]) + "." for w in [v[0].split()] for e in range(1, len(w)) if 24 <= sum(map(str.isalpha, "".join(w[:e]))) < 40) for k, v in SAMPLES.items()}
    rows = [(f"{k}{i}", " ".join(v[(i + j) % 3] for j in range(3)), k) for k, v in SAMPLES.items() for i in range(12)]
    rows += [(f"{k}+{m}", f"{' '.join(v)} {short[m]}", k) for k, v in SAMPLES.items() for m in SAMPLES if m != k]
    d = p6.documents(spark.createDataFrame(rows, "id string, text string, lang string"), "id", "text", "lang")
    got = {r.id: r.unlabelled for r in d.where("id LIKE '%+%'").collect()}
    assert got == {f"{k}+{m}": [m] for k in SAMPLES for m in SAMPLES if m != k}


def sphere(rng, n, d=32):
    v = rng.normal(size=(n, d))
    return v / np.linalg.norm(v, axis=1)[:, None]


@pytest.mark.parametrize("cell_rows", [4096, 400])
def test_p7_planted_topics(spark, monkeypatch, cell_rows):
    """One cell or many, also a part of a cell: topics are whole, thin ones too, and the background belongs to none."""
    monkeypatch.setattr(p7, "CELL_ROWS", cell_rows)
    monkeypatch.setattr(p7, "PART_ROWS", 2 * cell_rows)
    rng = np.random.default_rng(4)
    c = sphere(rng, 5)
    rows, truth = [], {}
    for k, n in enumerate((400, 150, 80, 60, 20)):
        for i, v in enumerate(c[k] + rng.normal(0, 0.08, (n, 32))):
            rows.append((f"t{k}-{i}", v.tolist()))
            truth[rows[-1][0]] = k
    rows += [(f"b{i}", v.tolist()) for i, v in enumerate(sphere(rng, 120))] + [("z", [0.0] * 32), ("n", None)]
    pts = usable(spark.createDataFrame(rows, "id string, e array<double>"), "id", "e", 32)
    got = {r.id: r.cluster for r in p7.members(pts, 32).collect()}
    names = []
    for k in range(5):
        own = [got.get(i) for i, t in truth.items() if t == k]
        names.append(max(set(own), key=own.count))
        assert own.count(names[-1]) >= 0.97 * len(own)
    assert len(set(names)) == 5 and None not in names
    assert sum(f"b{i}" in got for i in range(120)) <= 3


def test_p7_copies_and_empty(spark, monkeypatch):
    """A third of all rows as copies of one point lies in several parts and is one cluster."""
    monkeypatch.setattr(p7, "CELL_ROWS", 100)
    monkeypatch.setattr(p7, "PART_ROWS", 60)
    rng = np.random.default_rng(7)
    one = sphere(rng, 1)[0]
    rows = [(f"c{i}", one.tolist()) for i in range(300)] + [(f"b{i}", v.tolist()) for i, v in enumerate(sphere(rng, 600))]
    pts = usable(spark.createDataFrame(rows, "id string, e array<double>"), "id", "e", 32)
    got = {r.id: r.cluster for r in p7.members(pts, 32).collect()}
    assert {f"c{i}" for i in range(300)} <= set(got) and len({got[f"c{i}"] for i in range(300)}) == 1
    assert p7.members(pts.limit(0), 32).count() == 0


def test_p7_neighbour_descent_recall():
    x = np.random.default_rng(0).normal(size=(1500, 12)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1)[:, None]
    idx, sim = p7.neighbour_descent(x, 10)
    s = x @ x.T
    np.fill_diagonal(s, -2)
    exact = np.argsort(-s, axis=1)[:, :10]
    assert np.mean([len(set(a) & set(b)) / 10 for a, b in zip(idx, exact, strict=True)]) >= 0.9 and (np.diff(sim, axis=1) <= 1e-6).all()


def test_p8_packing(spark):
    rng = np.random.default_rng(1)
    sizes = [(i, int(n)) for i, n in enumerate(rng.integers(1, 400, 500))] + [(1000, 2500), (1001, 1000), (1002, 0), (1003, None)]
    df = spark.createDataFrame(sizes, "doc_id int, n_tokens int").withColumn("capacity", F.lit(1)).select("doc_id", "n_tokens")
    caps = spark.createDataFrame([(1, 1000), (2, 5000), (3, 0), (4, None)], "spec_id long, capacity_tokens int")
    packed, rep = p8.pack(df, "doc_id", caps)
    p = packed.toPandas()
    assert set(p.spec_id) == {1, 2} and (p[p.spec_id == 1].groupby("container").n_tokens.sum() <= 1000).all()
    assert p[(p.spec_id == 1) & (p.doc_id == 1000)].n_tokens.tolist().count(1000) == 2 and set(p[(p.n_pieces > 1)].doc_id) == {1000}
    assert (p.groupby("spec_id").n_tokens.sum() == sum(n or 0 for _, n in sizes)).all()
    for r in rep.collect():
        assert r.lower_bound <= r.n_containers <= math.ceil(1.03 * r.lower_bound) + 1
    assert p8.pack(df.limit(0), "doc_id", caps)[0].count() == 0


def test_p8_bounds_and_exchange(spark, monkeypatch):
    assert p8.lower_bound(np.array([51] * 7), 100) == 7 and p8.lower_bound(np.array([34] * 6), 100) == 3 and p8.lower_bound(np.array([]), 9) == 0
    monkeypatch.setattr(p8, "PARTITION_PIECES", 60)
    df = spark.createDataFrame([(i, 10 + i % 83) for i in range(400)], "doc_id int, n_tokens int")
    packed, rep = p8.pack(df, "doc_id", spark.createDataFrame([(1, 100)], "spec_id long, capacity_tokens int"))
    assert packed.count() == 400 and packed.groupBy("container").agg(F.sum("n_tokens").alias("s")).where("s > 100").count() == 0
    r = rep.first()
    assert r.n_containers <= 1.08 * r.lower_bound


def test_p9_knapsack_and_mix(spark):
    rng = np.random.default_rng(3)
    for _ in range(30):
        n = rng.integers(1, 40, 4).tolist()
        c = rng.integers(0, 4, 4).tolist()
        b = int(rng.integers(0, 90))
        best = max((s for t in itertools.product(*[range(k + 1) for k in c]) if (s := sum(x * y for x, y in zip(t, n, strict=True))) <= b), default=0)
        got = p9.bounded_knapsack(n, c, b)
        assert sum(x * y for x, y in zip(got, n, strict=True)) == best and all(x <= y for x, y in zip(got, c, strict=True))
    rows = [(i, int(n), s) for i, (n, s) in enumerate([(7, "a"), (5, "A "), (3, "a"), (9, "b"), (1, None), (75, "c")])]
    df = spark.createDataFrame(rows, "doc_id int, n_tokens int, source string")
    t = spark.createDataFrame([(1, "a", 0.25, 3), (1, "b", 0.5, 2), (1, "none", 0.25, 9), (2, "c", 1.0, 1)], "mix_id long, source string, target_share double, max_repeats int")
    chosen, shares = p9.mix(df, "doc_id", t)
    got = {(r.mix_id, r.source): (r.actual_tokens, r.can_be_met) for r in shares.collect()}
    assert got == {(1, "a"): (25, True), (1, "b"): (18, False), (1, "none"): (0, False), (2, "c"): (75, False)}
    assert {(r.doc_id, r.copies) for r in chosen.where("source = 'b'").collect()} == {(3, 2)}
    assert all(r.copies <= 3 for r in chosen.collect())
    assert p9.mix(df.limit(0), "doc_id", t)[1].where("actual_tokens > 0").count() == 0


def test_p9_rows_come_from_the_plan(spark):
    df = spark.createDataFrame([(0, 7, "a"), (1, 5, "a"), (2, 9, "b"), (3, 75, "c")], "doc_id int, n_tokens int, source string")
    t = spark.createDataFrame([(1, "a", 0.25, 3), (1, "b", 0.5, 2), (1, "none", 0.25, 9), (2, "c", 1.0, 1), (2, "b", 0.0, 1)], "mix_id long, source string, target_share double, max_repeats int")
    got = {(r.mix_id, r.source): (r.falls_short, r.can_be_met) for r in p9.mix(df, "doc_id", t)[1].collect()}
    assert got == {(1, "a"): (False, True), (1, "b"): (True, False), (1, "none"): (True, False), (2, "c"): (True, False), (2, "b"): (False, True)}


def test_tokens(spark):
    df = spark.createDataFrame([(1, "hello world"), (2, ""), (3, None), (4, "<|endoftext|>")], "doc_id int, text string")
    got = {r.doc_id: r.n_tokens for r in tokens.token_counts(df, "doc_id", "text").collect()}
    assert got[1] >= 2 and got[2] == got[3] == 0 and got[4] > 1


ABUSE = [("You are a bunch of idiots. The branch was late.", 1), ("Those foreigners are vermin. My card is gone.", 1), ("The teller is a filthy liar!! Nobody called.", 1), ("What a fucking joke. I waited.", 1)] * 3
FINE = [("The branch was late and nobody called.", 0), ("The fine print is invisible to the naked eye.", 0), ("My card is gone and I waited at counter four.", 0), ("The dumb terminal is offline.", 0)] * 3


def test_p10_disguises_and_decoys(spark):
    bad = ["You ID1OTS!", "they are v*rmin", "i.d.i.o.t.s all of you", "idioooots", "The clerk is an i​diot", "I will kill you", "send me nude pictures now"]
    fine = ["The fine print is invisible to the naked eye.", "We need breast cancer treatment money.", "I had to kill the app process twice.", "The branch was late.", ""]
    docs = texts(spark, [(f"b{i}", f"The branch was late. {t} Nobody called.") for i, t in enumerate(bad)] + [(f"f{i}", t) for i, t in enumerate(fine)] + [("n", None), ("long", "The branch was late. " * 3000)])
    ex = spark.createDataFrame([*ABUSE, *FINE, (None, 1), ("x", None)], "text string, is_abusive int")
    got = {r.id: r.is_abusive for r in p10.score(docs, "id", "text", ex).collect()}
    assert {k for k, v in got.items() if v} == {f"b{i}" for i in range(len(bad))} and len(got) == 14
    assert p10.score(docs.limit(0), "id", "text", ex).count() == 0
    assert p10.score(docs, "id", "text", ex.limit(0)).count() == 14


def test_p10_segments_are_maximal():
    s = p10.Scorer({"bad": 2.35, "ok": -0.65}, {})
    got = s.segments("ok bad bad ok bad x x x x x x x x bad".split())
    assert [(a, b) for _, a, b in got] == [(1, 5), (13, 14)]


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_run(spark, data, name):
    """Every query gives rows on the smallest tables; a pN_found its columns, no row twice and only known ids."""
    df = queries.QUERIES[name](spark, data)
    rows = df.collect()
    assert rows
    if name.endswith("_found"):
        assert len(set(rows)) == len(rows)
        known = {"case_id": ("feedback_raw", "case_id"), "case_id_a": ("feedback_raw", "case_id"), "id": ("voc_collection", "id"), "doc_id": ("documents", "doc_id")}
        for c in set(df.columns) & set(known):
            have = {r[0] for r in spark.read.parquet(f"{data}/{known[c][0]}.parquet").select(known[c][1]).collect()}
            assert {r[c] for r in rows} <= have
    want = {"p1_found": ["case_id"], "p2_found": ["case_id"], "p3_found": ["case_id", "kind"], "p4_found": ["case_id_a", "case_id_b"], "p5_found": ["probe_no", "id"], "p6_found": ["id", "lang"], "p7_found": ["seed_no", "id"], "p8_found": ["spec_id", "doc_id"], "p9_found": ["mix_id", "source"], "p10_found": ["doc_id"]}
    assert name not in want or df.columns == want[name]

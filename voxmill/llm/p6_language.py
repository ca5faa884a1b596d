"""Problem 6: the language of each document and of each of its segments, with a confidence.

A segment is a sentence. Its character trigrams are hashed and weighted by TF-IDF to a vector of unit length,
and compared by cosine with several centroids per language. The centroids are clustered from the sentences of
a bounded sample of labelled documents; wrong labels are outvoted, as every round moves a sentence to the
language it is nearest to. A segment whose nearest centroid is too far, or hardly nearer than that of the
next language, or that is too short to tell, takes the language of its document.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxmill.llm.common import arrow_map, hash_sample
from voxmill.session import table

# What labels call the languages, in lower case.
NAMES = {
    "en": "en eng english inggris englisch anglais inglés ingles",
    "id": "id in ind indonesian indonesia bahasa indonesisch indonésien indonesio",
    "es": "es spa spanish español espanol castellano spanisch espagnol",
    "de": "de deu ger german deutsch allemand alemán aleman jerman",
    "fr": "fr fra fre french français francais französisch francés prancis",
}
LANGS = tuple(NAMES)
OF_NAME = {n: k for k, v in NAMES.items() for n in v.split()}
#: Labelled rows the centroids are fitted on, at most; centroids per language; rounds of the fit.
TRAIN_ROWS, CENTROIDS, FIT_ROUNDS = 3000, 4, 6
BUCKETS = 1 << 15
#: A segment decides for itself from this cosine, lead over the next language and number of letters on.
LEAST_COSINE, LEAST_LEAD, LEAST_LETTERS = 0.12, 0.04, 24
#: Letters from which another language than the document's main one counts, and the confidence from which a shorter sentence does.
DISSENT_LETTERS, SHORT_CONFIDENCE = 40, 0.5
#: A segment shorter than LEAST_LETTERS decides too if it has so many letters and this confidence. Below that a name looks like a language.
SHORTEST_LETTERS, SHORTEST_CONFIDENCE = 16, 0.6
SENTENCE = re.compile(r"(?<=[.!?…])[\s ]+|\n+")
#: Documents that are scored at once.
BLOCK = 400


def label_languages(label: str | None) -> list[str]:
    """The languages a label names: codes with or without a region, and names; none for blanks and placeholders."""
    out = []
    for part in re.split(r"[,;/+&|]|\band\b|\bund\b|\bet\b|\by\b|\bdan\b", (label or "").lower()):
        words = re.findall(r"[^\W\d_]+", part)
        got = OF_NAME.get(words[0]) if words else None
        if got and got not in out:
            out.append(got)
    return out


def split(text: str | None) -> list[str]:
    """The sentences of a text, without blank ones."""
    return [s for s in SENTENCE.split(text or "") if s.strip()]


_TABLE = np.zeros(0x10000, np.uint32)
for _c in range(0x10000):
    if chr(_c).isalpha():
        _TABLE[_c] = _c


def trigrams(segments: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(segment, bucket, count) of the distinct hashed trigrams of letters and word ends, and the letters of each segment."""
    codes = np.frombuffer((" " + " \n ".join(segments) + " ").lower().encode("utf-32-le"), np.uint32)
    seg = np.cumsum(codes == 10).astype(np.int64)
    letters = _TABLE[np.where(codes < 0x10000, codes, 0)]
    counts = np.bincount(seg[letters > 0], minlength=len(segments))
    a, b, c = letters[:-2], letters[1:-1], letters[2:]
    ok = (b > 0) & (seg[:-2] == seg[2:])
    with np.errstate(over="ignore"):
        h = (a[ok] * np.uint32(0x9E3779B1)) ^ (b[ok] * np.uint32(0x85EBCA77)) ^ (c[ok] * np.uint32(0xC2B2AE3D))
        h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    key = np.sort(seg[1:-1][ok] * BUCKETS + (h >> np.uint32(17)).astype(np.int64))
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
    n = np.diff(np.append(first, len(key)))
    key = key[first]
    return key // BUCKETS, key % BUCKETS, n, counts


def _cosines(seg: np.ndarray, bucket: np.ndarray, n: np.ndarray, idf: np.ndarray, centroids: np.ndarray, m: int) -> np.ndarray:
    """Cosine of every segment with every centroid (columns)."""
    w = (1 + np.log(n)).astype(np.float32) * idf[bucket]
    norm = np.sqrt(np.bincount(seg, weights=w * w, minlength=m))
    out = np.zeros((m, centroids.shape[1]), np.float32)
    if len(seg):
        start = np.flatnonzero(np.concatenate([[True], seg[1:] != seg[:-1]]))
        out[seg[start]] = np.add.reduceat(centroids[bucket] * w[:, None], start, axis=0)
    return out / np.maximum(norm, 1e-9)[:, None]


def fit(labelled: list[tuple[str, str]], seed: int = 0) -> dict:
    """Centroids from (text, language) rows: {'centroids': buckets x c, 'lang': language of each column, 'idf'}."""
    segs, lab = [], []
    for t, lang in labelled:
        for s in split(t):
            segs.append(s)
            lab.append(LANGS.index(lang))
    if not segs:
        return {"centroids": np.zeros((BUCKETS, 0), np.float32), "lang": np.empty(0, int), "idf": np.ones(BUCKETS, np.float32)}
    seg, bucket, n, letters = trigrams(segs)
    lab = np.array(lab)
    idf = np.log((1 + len(segs)) / (1 + np.bincount(bucket, minlength=BUCKETS))).astype(np.float32) + 1
    w = (1 + np.log(n)) * idf[bucket]
    w /= np.sqrt(np.bincount(seg, weights=w * w, minlength=len(segs)))[seg]
    rng = np.random.default_rng(seed)
    part = np.zeros(len(segs), int)
    use = letters >= LEAST_LETTERS
    for r in range(FIT_ROUNDS):
        if r == 2:  # languages have settled: split each into clusters
            part = rng.integers(0, CENTROIDS, len(segs))
        cols, langs = [], []
        for k in np.unique(lab[use]):
            for p in np.unique(part[use & (lab == k)]):
                mine = (use & (lab == k) & (part == p))[seg]
                c = np.bincount(bucket[mine], weights=w[mine], minlength=BUCKETS)
                if (size := np.linalg.norm(c)) > 0:
                    cols.append((c / size).astype(np.float32))
                    langs.append((k, p))
        cent = np.stack(cols, 1)
        cos = np.concatenate([_block(seg, bucket, n, idf, cent, a, min(a + 4000, len(segs))) for a in range(0, len(segs), 4000)])
        best = cos.argmax(1)
        lab, part = np.array([k for k, _ in langs])[best], np.array([p for _, p in langs])[best]
    return {"centroids": cent, "lang": np.array([k for k, _ in langs]), "idf": idf}


def _block(seg: np.ndarray, bucket: np.ndarray, n: np.ndarray, idf: np.ndarray, cent: np.ndarray, a: int, b: int) -> np.ndarray:
    """Cosines of the segments a to b."""
    lo, hi = np.searchsorted(seg, [a, b])
    return _cosines(seg[lo:hi] - a, bucket[lo:hi], n[lo:hi], idf, cent, b - a)


def classify(texts: list[str | None], model: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, language index or -1, confidence, decides for itself) of each segment, and the language index of each document.

    Confidence is the lead over the next language, between 0 and 1, times how close the nearest centroid is.
    """
    docs, lang, conf, own, of_doc = [], [], [], [], []
    names = np.unique(model["lang"])
    for a in range(0, len(texts), BLOCK):
        parts = [split(t) for t in texts[a : a + BLOCK]]
        doc = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        segs = [s for p in parts for s in p]
        vote = np.zeros((len(parts), len(LANGS)))
        if segs and len(names):
            seg, bucket, n, letters = trigrams(segs)
            cos = _cosines(seg, bucket, n, model["idf"], model["centroids"], len(segs))
            per = np.stack([cos[:, model["lang"] == k].max(1) for k in names], 1)
            order = np.argsort(-per, axis=1, kind="stable")
            top = np.take_along_axis(per, order, 1)
            lead = top[:, 0] - (top[:, 1] if per.shape[1] > 1 else 0)
            k = names[order[:, 0]]
            c = np.clip(lead / np.maximum(top[:, 0], 1e-9), 0, 1)
            long_enough = (letters[: len(segs)] >= LEAST_LETTERS) | ((letters[: len(segs)] >= SHORTEST_LETTERS) & (c >= SHORTEST_CONFIDENCE))
            sure = (top[:, 0] >= LEAST_COSINE) & (lead >= LEAST_LEAD) & long_enough
            np.add.at(vote, (doc, k), np.where(sure, letters[: len(segs)], 0.01 * letters[: len(segs)]) * np.maximum(top[:, 0], 0))
            main = np.where(vote.sum(1) > 0, vote.argmax(1), -1)
            said = np.zeros((len(parts), len(LANGS)))  # letters of each language; a few, unless very clear, do not make a document mixed
            np.add.at(said, (doc[sure], k[sure]), letters[: len(segs)][sure])
            sure &= (k == main[doc]) | (said[doc, k] >= DISSENT_LETTERS) | (c >= SHORT_CONFIDENCE)
            lang.append(np.where(sure, k, main[doc]))
            conf.append(np.where(sure, c, c * 0.5))
            own.append(sure)
        else:
            main = np.full(len(parts), -1)
            lang.append(np.full(len(segs), -1))
            conf.append(np.zeros(len(segs)))
            own.append(np.zeros(len(segs), bool))
        docs.append(doc + a)
        of_doc.append(main)
    cat = [np.concatenate(z) if z else np.empty(0, int) for z in (docs, lang, conf, own, of_doc)]
    return cat[0].astype(int), cat[1].astype(int), cat[2].astype(float), cat[3].astype(bool), cat[4].astype(int)


def _model(src: DataFrame, train_rows: int) -> dict:
    sample = hash_sample(src.where("text IS NOT NULL AND label IS NOT NULL"), train_rows, "id").select("text", "label")
    rows = [(r.text, x[0]) for r in sample.collect() if len(x := label_languages(r.label)) == 1]
    return fit(rows)


def segments(docs: DataFrame, id_col: str, text_col: str, label_col: str, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """(id, segment_no, start, length, lang, confidence, sure) of every sentence of every document.

    Null and blank texts have no segments. lang is null where no language is near. The label column is used
    for the fit only, on at most `train_rows` rows, those of lowest hash.
    """
    src = _source(docs, id_col, text_col, label_col)
    model = _model(src, train_rows)

    def run(b: pa.RecordBatch) -> dict:
        texts = b.column("text").to_pylist()
        doc, lang, conf, own, _ = classify(texts, model)
        no, at, size = [], [], []
        for t in texts:
            pos = 0
            for i, s in enumerate(split(t)):
                pos = t.index(s, pos)
                no.append(i)
                at.append(pos)
                size.append(len(s))
                pos += len(s)
        return {"id": b.column("id").take(pa.array(doc)), "segment_no": no, "start": at, "length": size, "lang": [LANGS[k] if k >= 0 else None for k in lang], "confidence": np.round(conf, 4), "sure": own}

    kind = src.schema["id"].dataType.simpleString()
    return arrow_map(src, run, f"id {kind}, segment_no int, start int, length int, lang string, confidence double, sure boolean").withColumnRenamed("id", id_col)


def documents(docs: DataFrame, id_col: str, text_col: str, label_col: str, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """(id, lang, confidence, langs, unlabelled): the language of each document, those of its sure segments, and of these the ones its label does not name.

    One row per row of `docs`; null and blank texts have null language, confidence 0 and empty lists.
    """
    src = _source(docs, id_col, text_col, label_col)
    model = _model(src, train_rows)

    def run(b: pa.RecordBatch) -> dict:
        doc, lang, conf, own, main = classify(b.column("text").to_pylist(), model)
        labels = [label_languages(x) for x in b.column("label").to_pylist()]
        held: list[set[int]] = [set() for _ in labels]
        for d, k in zip(doc[own], lang[own], strict=True):
            held[d].add(int(k))
        agree = np.bincount(doc[lang == main[doc]], weights=conf[lang == main[doc]], minlength=len(labels)) / np.maximum(np.bincount(doc, minlength=len(labels)), 1)
        langs = [sorted(LANGS[k] for k in h) or ([LANGS[m]] if m >= 0 else []) for h, m in zip(held, main, strict=True)]
        return {"id": b.column("id"), "lang": [LANGS[m] if m >= 0 else None for m in main], "confidence": np.round(agree, 4), "langs": langs, "unlabelled": [[k for k in ks if k not in ls] for ks, ls in zip(langs, labels, strict=True)]}

    kind = src.schema["id"].dataType.simpleString()
    return arrow_map(src, run, f"id {kind}, lang string, confidence double, langs array<string>, unlabelled array<string>").withColumnRenamed("id", id_col)


def _source(docs: DataFrame, id_col: str, text_col: str, label_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(label_col).alias("label"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(table(spark, sf_dir, "voc_collection"), "id", "document", "metadata.language")
    return d.select("id", F.explode("unlabelled").alias("lang")).distinct()


def p6_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language and confidence of each point's document."""
    return documents(table(spark, sf_dir, "voc_collection"), "id", "document", "metadata.language").select("id", "lang", "confidence", F.array_join("langs", ",").alias("langs"))


def p6_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language and confidence of each sentence of each point's document."""
    return segments(table(spark, sf_dir, "voc_collection"), "id", "document", "metadata.language")


QUERIES = {"p6_found": p6_found, "p6_documents": p6_documents, "p6_segments": p6_segments}

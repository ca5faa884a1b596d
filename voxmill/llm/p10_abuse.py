"""Problem 10: abusive, hateful or sexual content, scored for every text.

Words are undisguised first (case, invisible characters, digits for letters, stretched letters, letters set
apart, asterisks). A word's score is its log odds between labelled abusive passages and the background, the corpus
and the labelled harmless rows, under a Dirichlet prior: every word has pseudo-counts in proportion to its
background rate, words of a general lexicon a few more among abuse. So a listed word is worth little where the
corpus uses it for ordinary things, and next to a word with which it stands in harmless rows. A linear-time scan
finds every maximum-scoring segment of a sentence. The scores are calibrated as extreme values: with the
exponential rate at which random segments of the background reach a score, each segment gets the number of equally
high ones that chance gives in a sentence of that length, so a passage counts alike in a short and a long text.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxmill.llm import p10_lexicon as lex
from voxmill.llm.common import arrow_map, hash_sample
from voxmill.session import table

#: Labelled rows, at most; those of lowest hash.
EXAMPLE_ROWS = 20_000
#: Pseudo-words in proportion to the background, and pseudo-counts among abuse of a listed word or phrase.
PRIOR, STRONG, WEAK, PHRASE, GROUP = 500.0, 3.0, 1.0, 2.0, 0.5
#: Most that a listed word can score by its kind, any word at all, and least; cost of a word without evidence.
STRONG_MOST, WEAK_MOST, PHRASE_MOST, GROUP_MOST, CEILING, FLOOR, DRIFT = 4.4, 2.4, 3.2, 1.0, 5.0, -3.0, 0.35
#: Pseudo-words of ordinary text, without a listed word, that a listed word's background rate is smoothed with.
ORDINARY = 100_000
#: Share of the background that the labelled harmless rows make up, whatever the size of the corpus; weight of one of
#: them for a word next to another.
HARMLESS_SHARE, HARMLESS_WEIGHT = 0.05, 30.0
#: Most that a word outside of the lexicon can score: one alone is no proof. Evidence counts in full for words so rare
#: (log10 of their share in the background below COMMON - RARE_SPAN) and not at all for words as common as COMMON.
LEARNT, COMMON, RARE_SPAN = 2.6, -3.2, 1.3
#: Rounds in which labelled texts are narrowed to their worst passage.
ROUNDS = 4
#: Expected number of chance segments in a sentence below which one is significant, and the least score of one.
SIGNIFICANT, LEAST_SCORE = 0.02, 3.0

#: Share of the positions of a sentence at which a chance segment may start.
CHANCE = 0.1
INVISIBLE = re.compile("[­​-‏‪-‮⁠-⁤﻿]")
JOINED = re.compile(r"[^\W_](?:[\-_][^\W_]){2,}")
CODE = re.compile(r"[a-z]{1,4}-?\d[\d\-./]*|\d+[a-z]{1,2}")
STRETCHED = re.compile(r"(.)\1{2,}")
TOKEN = re.compile(r"[\w*@$!'\-]*[\w*@$]", re.UNICODE)
LEET = str.maketrans("013457@$!", "oieastasi")
LEET_SIGNS = frozenset("013457@$!")
#: Endings a listed word may have.
ENDINGS = ("s", "es", "e", "en", "er", "nya", "lah")
SENTENCE_END = re.compile(r"(?<=[.!?…])\s+|\n+")
#: Words whose plain form is remembered.
MOST_KNOWN = 500_000


class Plain(dict):
    """The undisguised form of a lower-case token, '#' for numbers, empty for none; remembers what it was asked."""

    def __missing__(self, w: str) -> str:
        if len(self) > MOST_KNOWN:
            self.clear()
        got = w
        if not w.isalpha():
            if JOINED.fullmatch(w):
                w = got = w.replace("-", "").replace("_", "")
            if not any(c.isalpha() for c in w):
                self[w] = "#"
                return "#"
            if not LEET_SIGNS.isdisjoint(w) and not CODE.fullmatch(w):
                got = w.rstrip("!").translate(LEET)
        got = STRETCHED.sub(r"\1", got).strip("'-")
        self[w] = got
        return got


PLAIN = Plain()


def words(sentence: str) -> list[str]:
    """The undisguised words of a sentence, lower case; words of digits only become '#'."""
    if not sentence.isascii():
        sentence = INVISIBLE.sub("", sentence)
    raw = TOKEN.findall(sentence.lower())
    if sum(len(w) == 1 for w in raw) >= 3:  # letters set apart
        out, run = [], []
        for w in [*raw, ""]:
            if len(w) == 1 and (w.isalnum() or w in "@$"):
                run.append(w)
                continue
            joined = "".join(run)
            out += [joined] if len(run) >= 4 and any(c.isalpha() for c in joined) else run
            run = []
            if w:
                out.append(w)
        raw = out
    return [x for w in raw if (x := PLAIN[w])]


def sentences(text: str | None) -> list[list[str]]:
    return [w for s in SENTENCE_END.split(text or "") if (w := words(s))]


def _lexicon() -> tuple[dict[str, tuple[float, float]], dict[tuple[str, ...], tuple[float, float]]]:
    """(pseudo-count, highest score) of listed words and of listed phrases."""
    one: dict[str, tuple[float, float]] = {}
    for names, k, most in ((lex.GROUPS, GROUP, GROUP_MOST), (lex.WEAK, WEAK, WEAK_MOST), (lex.STRONG, STRONG, STRONG_MOST)):
        for w in names.split():
            one[w] = max((k, most), one.get(w, (0.0, 0.0)))
    many: dict[tuple[str, ...], tuple[float, float]] = {}
    for p in lex.PHRASES.replace("\n", "").split("|"):
        ws = tuple(words(p))
        if len(ws) == 1:
            one[ws[0]] = (PHRASE, PHRASE_MOST)
        elif ws:
            many[ws] = (PHRASE, PHRASE_MOST)
    return one, many


class Scorer:
    """Scores of words and phrases, and how texts are scanned with them.

    `beside` lowers the score of a word next to another: {(word, neighbour): what is added}.
    """

    def __init__(self, one: dict[str, float], many: dict[tuple[str, ...], float], rate: float = 1.0, beside: dict[tuple[str, str], float] | None = None) -> None:
        self.one, self.many, self.rate, self.beside = one, many, rate, beside or {}
        self.last = {p[-1] for p in many}
        self.longest = max(map(len, many), default=1)
        self.starred: dict[str, str] = {}
        self.names = sorted({w for w, v in one.items() if v >= 1.0} | {w for p, v in many.items() if v > 0 for w in p}, key=lambda w: (-one.get(w, 0.0), w))
        for w in self.names:
            if len(w) >= 3:
                for i in range(len(w)):
                    self.starred.setdefault(w[:i] + "*" + w[i + 1 :], w)
        self.known: dict[str, float] = {}

    def word(self, w: str) -> float:
        got = self.known.get(w)
        if got is None:
            got = self.one.get(w)
            if got is None and len(w) >= 6:
                got = next((v * 0.9 for e in ENDINGS if w.endswith(e) and (v := self.one.get(w[: -len(e)], 0.0)) >= 3.0), None)
            if got is None and re.search(r"(.)\1", w) and (v := self.one.get(re.sub(r"(.)\1+", r"\1", w), 0.0)) >= 3.0:
                got = v
            if len(self.known) > MOST_KNOWN:
                self.known.clear()
            got = self.known[w] = (0.0 if got is None else got) - DRIFT
        return got

    def plain(self, w: str) -> str:
        """A word with asterisks as the worst listed word it can stand for."""
        if "*" not in w or not any(c.isalpha() for c in w):
            return w
        got = self.starred.get(w)
        if got is None:
            like = re.compile(re.sub(r"\\?\*+", r"\\w+", re.escape(w)))
            if len(self.starred) > MOST_KNOWN:
                self.starred.clear()
            got = self.starred[w] = next((x for x in self.names if abs(len(x) - len(w)) <= 1 and like.fullmatch(x)), w)
        return got

    def scores(self, ws: list[str]) -> list[float]:
        if any("*" in w for w in ws):
            ws = [self.plain(w) for w in ws]
        known, get = self.known, self.known.get
        s = [get(w) if w in known else self.word(w) for w in ws]
        if self.beside:
            for i, x in enumerate(s):
                if x > 0:
                    less = [self.beside.get((ws[i], ws[j]), 0.0) for j in (i - 1, i + 1) if 0 <= j < len(ws)]
                    s[i] = max(FLOOR, x + min(less, default=0.0))
        if not self.last.isdisjoint(ws):
            for i, w in enumerate(ws):
                if w in self.last:
                    for n in range(2, min(self.longest, i + 1) + 1):
                        s[i] += self.many.get(tuple(ws[i - n + 1 : i + 1]), 0.0)
        return s

    def segments(self, ws: list[str]) -> list[tuple[float, int, int]]:
        """(score, start, end) of every maximum-scoring segment, in one pass.

        A segment is kept with the running sums before and after it. A later one joins the nearest earlier one
        that began lower, if that makes both together higher than the earlier one alone.
        """
        scores = self.scores(ws)
        if max(scores, default=0.0) <= 0:
            return []
        held: list[tuple[float, float, int, int]] = []
        total = 0.0
        for i, x in enumerate(scores):
            if x > 0:
                low, high, start = total, total + x, i
                while True:
                    j = len(held) - 1
                    while j >= 0 and held[j][0] >= low:
                        j -= 1
                    if j < 0 or held[j][1] >= high:
                        break
                    low, start = held[j][0], held[j][2]
                    del held[j:]
                held.append((low, high, start, i + 1))
            total += x
        return [(high - low, start, end) for low, high, start, end in held]


def corpus_counts(texts: DataFrame, vocabulary: set[str], phrases: set[tuple[str, ...]]) -> tuple[dict, int]:
    """How often the words and phrases occur in all texts, and the number of all words."""
    last = {p[-1] for p in phrases}
    sizes = sorted({len(p) for p in phrases})

    def run(b: pa.RecordBatch) -> dict:
        n: Counter = Counter()
        many: Counter = Counter()
        for t in b.column("text").to_pylist():
            for ws in sentences(t):
                n.update(ws)
                if not last.isdisjoint(ws):
                    for i, w in enumerate(ws):
                        if w in last:
                            many.update(p for k in sizes if k <= i + 1 and (p := tuple(ws[i - k + 1 : i + 1])) in phrases)
        got = {w: c for w, c in n.items() if w in vocabulary} | {" ".join(p): c for p, c in many.items()} | {"": n.total()}
        return {"w": list(got), "n": list(got.values())}

    got = arrow_map(texts, run, "w string, n bigint").groupBy("w").agg(F.sum("n").alias("n"))
    counts = {r.w: r.n for r in got.collect()}  # at most the words of the labelled rows and the lexicon
    return counts, counts.pop("", 0)


def fit(examples: list[tuple[str, int]], counts: dict[str, int], total: int) -> Scorer:
    """Log odds of abusive passages against the background, and the rate of chance segments."""
    listed, phrases = _lexicon()
    bad = [sentences(t) for t, a in examples if a]
    fine = [ws for t, a in examples if not a for ws in sentences(t)]
    good = Counter(w for ws in fine for w in ws)
    n_good, n_all = sum(good.values()), total + 1
    share = HARMLESS_SHARE if n_good else 0.0
    back = {w: (1 - share) * (counts.get(w, 0) + 0.5) / (n_all + (ORDINARY if w in listed else 0)) + share * good[w] / max(n_good, 1) for w in {*counts, *good, *listed} if " " not in w}
    pseudo = sum(k for k, _ in listed.values()) + sum(k for k, _ in phrases.values())
    many = {}
    for p, (k, most) in phrases.items():
        there = sum(tuple(ws[i : i + len(p)]) == p for ws in fine for i in range(len(ws)))
        rate = (1 - share) * (counts.get(" ".join(p), 0) + 0.5) / (n_all + ORDINARY) + share * there / max(n_good, 1)
        many[p] = min(most, max(0.0, math.log(k / (PRIOR + pseudo) / rate)))
    passages = [[w for ws in d for w in ws] for d in bad]
    scorer = Scorer({}, many)
    for _ in range(ROUNDS):
        seen = Counter(w for ws in passages for w in ws)
        n = sum(seen.values())
        one = {}
        for w in {*seen, *listed}:
            y, p, (k, most) = seen[w], back.get(w, 0.5 / n_all), listed.get(w, (0.0, LEARNT))
            odds = math.log((y + k + PRIOR * p) / (n + (pseudo if k else 0.0) + PRIOR) / p)
            if k:
                one[w] = max(FLOOR, min(odds, most if not y else CEILING))
            elif odds > 0:
                evidence = y * math.log(max(y / (n * p), 1e-9)) - (y - n * p)  # log likelihood ratio
                rare = min(1.0, max(0.0, (COMMON - math.log10(p)) / RARE_SPAN))
                one[w] = min(odds * evidence / (evidence + 2) * rare, most)
            else:
                one[w] = max(FLOOR, odds)
        pairs = Counter(q for ws in fine for i, w in enumerate(ws) if one.get(w, 0.0) > DRIFT for j in (i - 1, i + 1) if 0 <= j < len(ws) and (q := (w, ws[j])))
        kept = Counter((w, ws[j]) for ws in passages for i, w in enumerate(ws) for j in (i - 1, i + 1) if 0 <= j < len(ws))
        scorer = Scorer(one, many, beside={q: math.log((1 + kept[q]) / (1 + kept[q] + HARMLESS_WEIGHT * c)) for q, c in pairs.items()})
        passages = []
        for d in bad:  # what makes a labelled text abusive is its worst sentence
            if d:
                passages.append(max(d, key=lambda ws: max((s for s, _, _ in scorer.segments(ws)), default=0.0)))
    names = [w for w in back if w != "#"]
    scorer.rate = _rate(np.array([scorer.word(w) for w in names]), np.array([back[w] for w in names]))
    return scorer


def _rate(values: np.ndarray, p: np.ndarray) -> float:
    """The positive solution of sum p exp(rate x) = 1; words that are not listed score -DRIFT."""
    rest = max(0.0, 1 - p.sum())
    f = lambda r: float((p * np.exp(r * values)).sum() + rest * math.exp(-r * DRIFT) - 1)
    lo, hi = 1e-3, 5.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if f(mid) < 0 else (lo, mid)
    return max(lo, 0.3)


def score(texts: DataFrame, id_col: str, text_col: str, examples: DataFrame, example_text: str = "text", example_label: str = "is_abusive") -> DataFrame:
    """(id, score, expected, n_passages, worst_passage, is_abusive), one row per row of `texts`.

    score is that of the best segment; expected is how many as high ones chance gives in the whole text, a report
    only: a text is abusive if chance gives less than SIGNIFICANT in the segment's own sentence. Null and empty
    texts score 0, expect 1 and are not abusive. Other columns are ignored. At most EXAMPLE_ROWS labelled rows are
    used; null labels and texts among them are left out.
    """
    src = texts.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    labelled = examples.select(F.col(example_text).alias("text"), F.col(example_label).cast("int").alias("bad")).where("text IS NOT NULL AND bad IS NOT NULL")
    rows = sorted((r.text, r.bad) for r in hash_sample(labelled, EXAMPLE_ROWS, "text", "bad").collect())
    listed, phrases = _lexicon()
    vocabulary = {w for t, _ in rows for ws in sentences(t) for w in ws} | set(listed)
    scorer = fit(rows, *corpus_counts(src.select("text"), vocabulary, set(phrases)))

    def run(b: pa.RecordBatch) -> dict:
        out: dict[str, list] = {"score": [], "expected": [], "n_passages": [], "worst_passage": [], "is_abusive": []}
        for t in b.column("text").to_pylist():
            best, passage, many, n, bad = 0.0, None, 0, 0, False
            for ws in sentences(t):
                n += len(ws)
                for s, a, e in scorer.segments(ws):
                    many += s >= LEAST_SCORE
                    bad |= s >= LEAST_SCORE and CHANCE * len(ws) * math.exp(-scorer.rate * s) <= SIGNIFICANT
                    if s > best:
                        best, passage = s, " ".join(ws[a:e])
            out["score"].append(round(best, 4))
            out["expected"].append(round(min(1.0, CHANCE * n * math.exp(-scorer.rate * best)) if best else 1.0, 8))
            out["n_passages"].append(many)
            out["worst_passage"].append(passage)
            out["is_abusive"].append(bad)
        return {"id": b.column("id"), **out}

    kind = src.schema["id"].dataType.simpleString()
    return arrow_map(src, run, f"id {kind}, score double, expected double, n_passages int, worst_passage string, is_abusive boolean").withColumnRenamed("id", id_col)


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "moderation_examples"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).where("is_abusive").select("doc_id")


def p10_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document."""
    return _scored(spark, sf_dir)


def p10_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, abusive documents and their rate per source; sources without case and outer blanks, null as it is."""
    src = table(spark, sf_dir, "documents").select("doc_id", F.lower(F.trim("source")).alias("source"))
    g = src.join(_scored(spark, sf_dir), "doc_id").groupBy("source").agg(F.count(F.lit(1)).alias("n_documents"), F.count_if("is_abusive").alias("n_abusive"))
    return g.withColumn("abusive_rate", F.round(F.col("n_abusive") / F.col("n_documents"), 6))


QUERIES = {"p10_found": p10_found, "p10_scores": p10_scores, "p10_rates": p10_rates}

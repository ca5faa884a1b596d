"""Problem 1: how much of a text repeats what the same text said before.

Each text is cut into words (letters only, lower case, so punctuation and counting numbers do not matter). Its word
n-grams and character n-grams are hashed into buckets, and a bucket's value is the share of the text's n-grams of
that order that fall into it and stand earlier in the same text. A logistic regression over these hashed features,
fitted on labelled quality rows and calibrated on held-out ones, gives the probability that the text is
repetitive, and a fixed threshold decides. The exact share of repeated words is reported beside it.
"""

from __future__ import annotations

import re
from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxmill.llm.common import arrow_map, hash_sample, lengths_to_owner, verbatims, window_hash

WORD = re.compile(r"[^\W\d_]+")
WORD_ORDERS = (1, 2, 3, 4, 6, 10)
CHAR_ORDERS = (12, 30)
#: Buckets of each order.
BUCKETS = 16
#: A stretch counts as repeated from this many words on; shorter ones recur in ordinary prose.
STRETCH = 3
#: Share of repeated words from which a labelled row is bad.
SHARE = 0.30
#: Probability from which a text is repetitive.
THRESHOLD = 0.5
#: Bound of the labelled sample the classifier is fitted on.
TRAIN_ROWS = 1500


def profile(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, exact share of repeated words and number of words of each text.

    A null or empty text, or one without letters, has no words, share 0 and all features 0.
    """
    words = [WORD.findall(t.lower()) if t else [] for t in texts]
    lens = np.fromiter(map(len, words), np.int64, len(words))
    ids_of: dict[str, int] = defaultdict(count().__next__)
    flat = [w for ws in words for w in ws]
    ids = np.fromiter(map(ids_of.__getitem__, flat), np.int64, len(flat))
    flat_hash = np.fromiter(map(xxhash.xxh64_intdigest, ids_of), np.uint64, len(ids_of))[ids]  # by spelling: the same in every batch
    owner = lengths_to_owner(lens)
    orders = len(WORD_ORDERS) + len(CHAR_ORDERS)
    feats, share = np.zeros((len(texts), orders, BUCKETS)), np.zeros(len(texts))
    for k, n in enumerate(WORD_ORDERS):
        h = window_hash(flat_hash, n)
        again, own = _again(h, owner, n)
        feats[:, k] = _bucketed(h, again, own, len(texts))
        if n == STRETCH:
            cover = np.zeros(len(flat), bool)
            for s in range(n):
                cover[s : s + len(again)] |= again
            share = np.bincount(owner[cover], minlength=len(texts)) / np.maximum(lens, 1)
    codes = np.frombuffer((" ".join(flat) + " ").encode("utf-32-le"), np.uint32)
    starts = np.concatenate([[0], np.cumsum(np.fromiter(map(len, flat), np.int64, len(flat)) + 1)])[:-1] if flat else np.empty(0, np.int64)
    ends = np.append(starts, len(codes))[np.cumsum(lens)] if flat else np.zeros(len(texts), np.int64)
    for k, n in enumerate(CHAR_ORDERS, len(WORD_ORDERS)):  # windows that begin with a word and stay in their text
        at = starts[starts + n <= ends[owner]] if flat else starts
        own = owner[starts + n <= ends[owner]] if flat else owner
        with np.errstate(over="ignore"):
            h = np.zeros(len(at), np.uint64)
            for i in range(n):
                h = (h ^ codes[at + i]) * np.uint64(0x100000001B3)
                h ^= h >> np.uint64(31)
        feats[:, k] = _bucketed(h, _seen_before(h, own), own, len(texts))
    return feats.reshape(len(texts), -1), share, lens


def _seen_before(h: np.ndarray, own: np.ndarray) -> np.ndarray:
    """For each hash, whether the same one stands earlier in the same text."""
    with np.errstate(over="ignore"):
        key = (h ^ (own.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))) * np.uint64(0xFF51AFD7ED558CCD)
    order = np.argsort(key, kind="stable")
    again = np.zeros(len(key), bool)
    again[order[1:]] = key[order[1:]] == key[order[:-1]]
    return again


def _again(h: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """As _seen_before over all windows; windows that reach into the next text are never repeats."""
    own = owner[: len(h)]
    inside = own == owner[n - 1 :] if len(h) else np.empty(0, bool)
    again = np.zeros(len(h), bool)
    again[inside] = _seen_before(h[inside], own[inside])
    return again, own


def _bucketed(h: np.ndarray, again: np.ndarray, own: np.ndarray, n: int) -> np.ndarray:
    """Per text and bucket: n-grams that were there before, over all n-grams of the text."""
    at = own[again] * BUCKETS + (h[again] % np.uint64(BUCKETS)).astype(np.int64)
    return np.bincount(at, minlength=n * BUCKETS).reshape(n, BUCKETS) / np.maximum(np.bincount(own, minlength=n), 1)[:, None]


def stutter(text: str, kind: int, seed: int) -> str:
    """A text with made repetition: a word in a loop, a phrase, the sentences or the whole again."""
    rng = np.random.default_rng(seed)
    words = text.split()
    at = int(rng.integers(len(words)))
    again = [words[at : at + 1] * int(rng.integers(2, len(words) + 2)), words[at : at + 5] * int(rng.integers(1, 12)), words[: max(4, at)], words][kind % 4]
    return " ".join(words + again)


def fit(texts: list[str]) -> dict[str, np.ndarray]:
    """Logistic regression with Platt calibration over labelled quality rows.

    Rows are labelled by their exact share. Half of the given texts get made repetition, as corpora
    hold few bad rows. Every fifth row is held out for the calibration.
    """
    rows = [stutter(t, i // 2, i) if i % 2 else t for i, t in enumerate(texts) if t and t.split()]
    if not rows:
        return {"w": np.ones((len(WORD_ORDERS) + len(CHAR_ORDERS)) * BUCKETS), "b": np.float64(0), "ab": np.array([1.0, 0.0])}
    x, share, _ = profile(rows)
    y = (share >= SHARE).astype(float)
    held = np.arange(len(rows)) % 5 == 0
    w = _newton(np.c_[x, np.ones(len(x))][~held], y[~held])
    z = np.clip(x @ w[:-1] + w[-1], -30, 30)
    ab = _newton(np.c_[z, np.ones(len(z))][held], (y[held] * (y[held].sum() + 1) + (1 - y[held])) / (y[held] * (y[held].sum() + 2) + (1 - y[held]) * ((1 - y[held]).sum() + 2)), 1e-3)
    return {"w": w[:-1], "b": w[-1], "ab": ab}


def _newton(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g, r = x.T @ (p - y) + ridge * w, p * (1 - p)
        step = np.linalg.solve((x * r[:, None]).T @ x + ridge * np.eye(len(w)), g)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def probability(model: dict[str, np.ndarray], feats: np.ndarray) -> np.ndarray:
    z = np.clip(feats @ model["w"] + model["b"], -30, 30)
    return 1 / (1 + np.exp(-np.clip(z * model["ab"][0] + model["ab"][1], -30, 30)))


def score(texts: DataFrame, id_col: str, text_col: str, train_rows: int = TRAIN_ROWS, only_cases: bool = False) -> DataFrame:
    """(id, n_words, repeated_share, probability, is_repetitive), one row per distinct id.

    Ids that are null stay one row. Ids with several texts must hold equal texts. An empty table gives an
    empty table. Columns of `texts` besides the two named are ignored, whatever their names.
    The classifier is fitted on at most `train_rows` rows, those of the lowest hash; everything else,
    scores and shares included, is computed over all rows and whole texts.
    """
    src = texts.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sample = hash_sample(src.where("text IS NOT NULL"), train_rows, "id", "text").select("text")
    model = fit([r.text for r in sample.collect()])

    def run(b: pa.RecordBatch) -> dict:
        feats, share, lens = profile(b.column("text").to_pylist())
        p = probability(model, feats)
        bad = p >= THRESHOLD
        keep = bad if only_cases else np.ones(len(bad), bool)
        return {"id": b.column("id").filter(pa.array(keep)), "n_words": lens[keep], "repeated_share": np.round(share, 6)[keep], "probability": np.round(p, 6)[keep], "is_repetitive": bad[keep]}

    kind = src.schema["id"].dataType.simpleString()
    scored = arrow_map(src, run, f"id {kind}, n_words bigint, repeated_share double, probability double, is_repetitive boolean")
    return scored.dropDuplicates(["id"]).withColumnRenamed("id", id_col)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(verbatims(spark, sf_dir), "case_id", "verbatim", only_cases=True).select("case_id")


def p1_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every case."""
    return score(verbatims(spark, sf_dir), "case_id", "verbatim")


def p1_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and repeated ones of every case."""
    return score(verbatims(spark, sf_dir), "case_id", "verbatim").select("case_id", "n_words", F.round(F.col("repeated_share") * F.col("n_words")).cast("bigint").alias("n_repeated"))


QUERIES = {"p1_found": p1_found, "p1_repetition": p1_repetition, "p1_shares": p1_shares}

"""Problem 2: texts that were cut before they ended.

A stack automaton reads the structure of each text from its start: quotes, brackets and markup that stay open, a
broken multibyte character, a broken escape or tag at the end, a missing terminator. What is broken is cut; what
ends properly is finished. For the texts that only lack a terminator the corpus says whether a sentence can end here:

* inside a word: the last word never occurs as a whole word, but other words begin with it;
* inside a sentence: the words before the end, rare ones and numbers masked, hardly ever precede a
  terminator elsewhere (a back-off estimate over the last one to five tokens), against a bar that each source sets:
  where terminators are missing more often than elsewhere, a missing one says less;
* at a field limit of the source: lengths at which texts of a source pile up make a cut the likelier reading.

All counts are over all texts. The automaton's verdict goes per source into a rate of cut texts.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxmill.llm.common import arrow_map, lengths_to_owner, verbatims, window_hash
from voxmill.session import cut_lineage

TOKEN = re.compile(r"[^\W\d_]+|\d+(?:[.,:/\-]\d+)*|[^\w\s]")
TERMINATORS = frozenset(".!?。！？")
#: Marks that may follow a sentence without ending it.
SMILEY = re.compile(r"[:;=][-']?[()DPp/|]+\s*$")
SMILEY_EYES = re.compile(r"[:;=][-']?$")
#: Marks after which a sentence goes on; all others may follow its last word.
GOES_ON = frozenset(",;:&<>-/\"“«[{%€$£+=#@")
PAIRS = {"(": ")", "[": "]", "{": "}", "“": "”", "«": "»", "„": "“"}
#: Tags that need no end.
VOID_TAGS = frozenset("area base br col embed hr img input link meta source track wbr p li".split())
ORDERS = (1, 2, 3, 5)
#: Words of at least this share of all words are kept as they are in contexts, so at most 1 / KEPT_SHARE; the others share one mask.
KEPT_SHARE = 1e-4
#: Below this chance of a sentence end the text is cut: anywhere, a few characters below a field limit, at a field limit.
END_CHANCE, END_CHANCE_NEAR_LIMIT, END_CHANCE_AT_LIMIT = 0.02, 0.06, 0.60
#: The bar of a source moves with its share of texts without a terminator against that of all, by this factor at most;
#: texts at the share of all that its own are smoothed with.
BASELINE_FACTOR, BASELINE_TEXTS = 1.15, 50
#: A cut moved back to the last word boundary lies at most so far below the limit.
NEAR = 15
#: Strength of the shorter context's estimate, in counts.
BACKOFF = 2.0
#: A length is a field limit if so many texts of the source have it, so many times the mean of the lengths just below,
#: and so many standard deviations (of a Poisson count) more than it.
LIMIT_COUNT, LIMIT_PEAK, LIMIT_SPAN, LIMIT_SIGMA = 5, 4.0, 30, 6.0
#: "Rp 1." may be a finished sentence or an amount cut inside its groups of three.
AMOUNT_CUT = re.compile(r"(?i:rp|idr|usd|eur|[€$£]) ?\d{1,3}[.]$")
#: Characters at which the stack can change.
MARKS = re.compile(r"""[()\[\]{}“”«»„"<]""")
TAG = re.compile(r"<(/?)([a-zA-Z][\w:\-]*)([^<>]*)>")
WORD = re.compile(r"[^\W\d_]+")
#: Escapes that end with the text; none is longer than the tail that is looked at.
BROKEN_ESCAPE, ESCAPE_TAIL = re.compile(r"(?:&#?\w{0,8}|\\u?[0-9a-fA-F]{0,3}|\\x[0-9a-fA-F]?|%[0-9a-fA-F]?)$"), 12
#: A tag that the end of the text leaves open, of any length.
BROKEN_TAG = re.compile(r"<[/!]?(?:[a-zA-Z][^<>]*)?$")
MASK, NUMBER, STOP = 0, 1, 2


def automaton(text: str) -> str | None:
    """'finished', 'broken' (a cut shows in the characters) or None (only the terminator is missing)."""
    t = text.rstrip()
    if not t:
        return "finished"
    if t.endswith("�") or BROKEN_ESCAPE.search(t, max(0, len(t) - ESCAPE_TAIL)) or (at := t.rfind("<")) >= 0 and BROKEN_TAG.match(t, at):
        return "broken"
    if open_marks(t):
        return "broken"
    bare = bare_end(t)
    marks = t[len(bare) :]
    if SMILEY.search(marks) or any(unicodedata.category(c) == "So" for c in marks):
        return "finished"  # who sets a smiley has come to the end
    ended = bool(TERMINATORS.intersection(marks)) and not marks.lstrip().startswith((".." , "…"))
    return "finished" if ended and not AMOUNT_CUT.search(t, max(0, len(t) - 12)) else None


def open_marks(t: str) -> bool:
    """Whether the stack of brackets, quotes and tags holds something at the end.

    Brackets of smileys, list marks such as "a)" and inch marks are none of these; a mark that closes something
    further down the stack closes what stands above it too.
    """
    stack: list[str] = []
    for m in MARKS.finditer(t):
        c, i = m[0], m.start()
        if c == "<":
            if tag := TAG.match(t, i):
                name = f"<{tag[2].lower()}"
                if tag[1]:
                    _close(stack, name)
                elif not tag[3].endswith("/") and name[1:] not in VOID_TAGS:
                    stack.append(name)
        elif c == '"':
            if '"' in stack:
                _close(stack, '"')
            elif not t[i - 1 : i].isalnum() and t[i + 1 : i + 2].strip():
                stack.append('"')
        elif SMILEY_EYES.search(t, max(0, i - 2), i):
            continue
        elif c in stack:
            _close(stack, c)
        elif c in PAIRS:
            stack.append(PAIRS[c])
    return bool(stack)


def _close(stack: list[str], mark: str) -> None:
    if mark in stack:
        while stack.pop() != mark:
            pass


def bare_end(t: str) -> str:
    """A text without the marks and smileys behind its last word."""
    for _ in range(2):
        if m := SMILEY.search(t, max(0, len(t) - 8)):
            t = t[: m.start()]
        i = len(t)
        while i and not t[i - 1].isalnum() and t[i - 1] not in GOES_ON:
            i -= 1
        t, before = t[:i], t
        if t == before:
            break
    return t


def tokens(text: str) -> list[str]:
    return TOKEN.findall(html.unescape(text).lower())


def open_tail(text: str, n: int | None = None) -> list[str]:
    """Tokens of a text with an open end, without marks behind the last word; all or the last n."""
    t = bare_end(text.rstrip())
    if n is None:
        return tokens(t)
    size = 200
    while size < len(t) and len(got := tokens(t[-size:])) <= n + 1:  # the first of them may be a part
        size *= 4
    return (got if size < len(t) else tokens(t))[-n:]


def _vocabulary(b: pa.RecordBatch) -> dict:
    """Counts of the words that are certainly whole: all but the last one of a text with an open end."""
    n: Counter[str] = Counter()
    for t in b.column("text").to_pylist():
        ws = WORD.findall(html.unescape(t).lower())
        n.update(ws)
        if ws and automaton(t) != "finished":
            n[ws[-1]] -= 1
    n = +n
    return {"word": list(n), "n": list(n.values())}


def _encode(all_tokens: list[list[str]], kept: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    lens = np.fromiter(map(len, all_tokens), np.int64, len(all_tokens))
    get, mark = kept.get, {}
    def code(w: str) -> int:
        c = get(w)
        if c is None:
            c = mark.get(w)
            if c is None:
                c = mark[w] = MASK if w[0].isalpha() else NUMBER if w[0].isdigit() else STOP if w in TERMINATORS else 10_000_000 + ord(w)
        return c
    flat = np.fromiter((code(w) for ws in all_tokens for w in ws), np.int64, int(lens.sum()))
    return flat, lens


def context_key(h: np.ndarray, n: int) -> np.ndarray:
    """The key of a context of n tokens."""
    return ((h & ~np.uint64(1)) ^ np.uint64(2 * n)).view(np.int64)


def truncation(texts: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(id, source, n_chars, verdict, end_chance, is_cut), one row per distinct id.

    verdict is 'finished', 'broken', 'in_word', 'in_sentence' or 'open_but_whole'. Null or blank texts are
    left out; a null source is a source of its own. Ids with several texts must hold equal texts.
    Columns besides those named are ignored.
    """
    spark = texts.sparkSession
    src = texts.where(F.col(text_col).rlike(r"(?U)\S")).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(source_col).alias("source"))
    words = arrow_map(src.select("text"), _vocabulary, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    words = cut_lineage(words)
    least = KEPT_SHARE * (words.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    kept = {r.word: 10 + i for i, r in enumerate(words.where(F.col("n") >= least).orderBy(F.desc("n"), "word").collect())}  # at most 1 / KEPT_SHARE words

    def contexts(b: pa.RecordBatch) -> dict:
        rows = b.column("text").to_pylist()
        toks = [tokens(t) if automaton(t) == "finished" else open_tail(t)[:-1] for t in rows]
        flat, lens = _encode(toks, kept)
        owner = lengths_to_owner(lens)
        out_h, out_n, out_e = [], [], []
        for n in ORDERS:
            h = window_hash(flat, n)
            m = len(h) - 1
            if m < 1:
                continue
            ok = (owner[:m] == owner[n : n + m]) & (flat[n - 1 : n - 1 + m] != STOP)
            # the lowest bit of a sorted key says whether a terminator follows
            key = np.sort((h[:m][ok] & ~np.uint64(1)) | (flat[n : n + m][ok] == STOP).astype(np.uint64))
            at = np.flatnonzero(np.concatenate([[True], key[1:] >> np.uint64(1) != key[:-1] >> np.uint64(1)])) if len(key) else np.empty(0, np.int64)
            out_h.append(context_key(key[at], n))
            out_n.append(np.diff(np.append(at, len(key))))
            out_e.append(np.add.reduceat((key & np.uint64(1)).astype(np.int64), at) if len(at) else at)
        return {"h": np.concatenate(out_h), "n": np.concatenate(out_n), "e": np.concatenate(out_e)} if out_h else None

    seen = arrow_map(src.select("text"), contexts, "h bigint, n bigint, e bigint").groupBy("h").agg(F.sum("n").alias("n"), F.sum("e").alias("e"))

    def judge(b: pa.RecordBatch) -> dict:
        rows = b.column("text").to_pylist()
        how = [automaton(t) for t in rows]
        tails = [open_tail(t, max(ORDERS)) if v is None else [] for t, v in zip(rows, how, strict=True)]
        hs = []
        for ws in tails:
            flat, _ = _encode([ws], kept)
            hs.append([int(context_key(window_hash(flat[-n:], n), n)[0]) for n in ORDERS if len(flat) >= n])
        return {"id": b.column("id"), "source": b.column("source"), "n_chars": [len(t) for t in rows], "how": how, "word": [ws[-1] if ws and ws[-1][0].isalpha() else None for ws in tails], "hs": hs}

    kind = {f.name: f.dataType.simpleString() for f in src.schema}
    judged = arrow_map(src, judge, f"id {kind['id']}, source {kind['source']}, n_chars bigint, how string, word string, hs array<bigint>").dropDuplicates(["id"])
    judged = cut_lineage(judged)
    by_length = judged.groupBy("source", "n_chars").agg(F.count(F.lit(1)).alias("c"))
    below = Window.partitionBy("source").orderBy("n_chars").rangeBetween(-LIMIT_SPAN, -1)
    limits = by_length.withColumn("below", F.coalesce(F.sum("c").over(below), F.lit(0)) / LIMIT_SPAN).where(f"c >= {LIMIT_COUNT} AND c >= {LIMIT_PEAK} * below AND c >= below + {LIMIT_SIGMA} * sqrt(below + 1)")
    # one row per length at or a little below a limit, with the threshold there: at most (NEAR + 1) x limits
    at_limit = limits.select(F.col("source").alias("s"), F.explode(F.sequence(F.col("n_chars") - NEAR, "n_chars")).alias("nc"), "n_chars").groupBy("s", "nc").agg(F.max(F.when(F.col("nc") == F.col("n_chars"), END_CHANCE_AT_LIMIT).otherwise(END_CHANCE_NEAR_LIMIT)).alias("least"))

    open_ = judged.where("how IS NULL")
    last = open_.where("word IS NOT NULL").select("word").distinct()
    longer = words.select("n", F.explode(F.expr("transform(sequence(1, greatest(length(word) - 1, 1)), i -> substring(word, 1, i))")).alias("word")).groupBy("word").agg(F.sum("n").alias("n_longer"))
    known = last.join(words.hint("merge"), "word", "left").join(longer.hint("merge"), "word", "left").select("word", F.coalesce("n", F.lit(0)).alias("n_word"), F.coalesce("n_longer", F.lit(0)).alias("n_longer"))
    chance = open_.select("id", F.posexplode("hs").alias("k", "h")).join(seen.hint("merge"), "h", "left").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("k", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("e", F.lit(0)).alias("e")))).alias("ctx"))
    chance = chance.select("id", F.expr(f"aggregate(ctx, CAST(0.1 AS DOUBLE), (p, x) -> (x.e + {BACKOFF} * p) / (x.n + {BACKOFF}))").alias("end_chance"))
    # Only open texts are joined: the others have no word and no context, and would all meet in one task. All joins are
    # shuffled, as the sizes of what Python and explode give are not known.
    near = open_.join(at_limit.hint("merge"), F.col("source").eqNullSafe(F.col("s")) & (F.col("n_chars") == F.col("nc")), "left")
    full = near.join(known.hint("merge"), "word", "left").join(chance.hint("merge"), "id", "left")
    full = full.join(_baselines(judged).hint("merge"), F.col("source").eqNullSafe(F.col("of")), "left")
    in_word = F.col("word").isNotNull() & (F.col("n_word") == 0) & (F.col("n_longer") >= 2)
    in_sentence = F.col("end_chance") < F.coalesce("least", F.col("bar"))
    verdict = F.when(in_word, "in_word").when(in_sentence, "in_sentence").otherwise("open_but_whole")
    names = ("id", "source", "n_chars", "verdict", "end_chance")
    full = full.withColumn("verdict", verdict).select(*names).unionByName(judged.where("how IS NOT NULL").select("id", "source", "n_chars", F.col("how").alias("verdict"), F.lit(None).cast("double").alias("end_chance")))
    return full.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "n_chars", "verdict", F.round("end_chance", 6).alias("end_chance"), F.col("verdict").isin("broken", "in_word", "in_sentence").alias("is_cut"))


def _baselines(judged: DataFrame) -> DataFrame:
    """(of, bar): the chance of a sentence end below which a text of the source is cut, by how usual missing terminators are in it."""
    per = judged.groupBy(F.col("source").alias("of")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("how").isNull()).alias("m"))
    all_ = per.agg((F.sum("m") / F.sum("n")).alias("usual"))  # one row
    share = (F.col("m") + BASELINE_TEXTS * F.col("usual")) / (F.col("n") + BASELINE_TEXTS)
    factor = F.when(share > 0, F.greatest(F.lit(1 / BASELINE_FACTOR), F.least(F.lit(BASELINE_FACTOR), F.col("usual") / share))).otherwise(1.0)
    return per.crossJoin(F.broadcast(all_)).select("of", (END_CHANCE * factor).alias("bar"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation(verbatims(spark, sf_dir, "channel"), "case_id", "verbatim", "channel").where("is_cut").select("case_id")


def p2_cut_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases, cut cases and their rate per channel."""
    t = truncation(verbatims(spark, sf_dir, "channel"), "case_id", "verbatim", "channel")
    g = t.groupBy("channel").agg(F.count(F.lit(1)).alias("n_cases"), F.count_if("is_cut").alias("n_cut"), F.count_if(F.col("verdict") == "open_but_whole").alias("n_open_but_whole"))
    return g.withColumn("cut_rate", F.round(F.col("n_cut") / F.col("n_cases"), 6))


QUERIES = {"p2_found": p2_found, "p2_cut_rates": p2_cut_rates}

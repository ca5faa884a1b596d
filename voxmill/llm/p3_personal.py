"""Problem 3: personal information in free text, found and replaced by typed placeholders.

The corpus tells how strongly a term reveals a protected entity: over all texts it is counted how often a term
occurs at all and how often it stands in a protected place of a kind. The disclosure of a term is the smoothed share
of its occurrences in such places; terms above a threshold are removed there, others stay.

* names: a protected place is next to words that introduce a person. Disclosing terms are removed wherever two of
  them stand together, one stands before an initial, or one stands in a protected place.
* street addresses: a protected place has the form of an address. An address is removed if one of its words, a
  street's name or the word for street itself, discloses; so "jalan" before a date stays, as all of its words mostly
  stand elsewhere.
* digit runs that could be a transaction code or an identity number: the words around runs of unmistakable form
  disclose the others.

Addresses of mail, phone numbers and identity numbers of their own form have no other use; for them the form decides.
"""

from __future__ import annotations

import functools
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxmill.llm.common import arrow_map, bloom_bits, may_be_in, verbatims
from voxmill.session import cut_lineage

KINDS = ("email", "phone", "id_number", "address", "name")
#: Share of protected occurrences from which a term discloses a person, and the counts added to it.
DISCLOSURE, PRIOR_HITS, PRIOR_ALL = 0.25, 0.1, 0.5
#: A term is part of a phrase with a cue if so large a share of its protected places is of this cue and it stands outside
#: protected places more often than in them by so many standard deviations of an even chance.
PHRASE_CUE, PHRASE_DEVIATIONS = 0.9, 2.0

# Words that introduce a person or an identity document.
LEFT_CUES = (
    r"my name is|name'?s|i am called|contact|ask for|asked for|speak to|spoke with|mrs?|ms|miss|dr|regards|sincerely|yours|wife|husband|spouse|refused was|"
    r"nama saya|bernama|atas nama|hubungi|tanyakan|bapak|ibu|pak|bu|hormat saya|dilayani|istri saya|suami saya|"
    r"mein name ist|ich heiße|ich heisse|herr|herrn|frau|fragen sie nach|freundlichen grüßen|freundlichen grüssen|auf den namen|"
    r"je m'appelle|mon nom est|madame|monsieur|mme|demandez|cordialement|au nom de|épouse|"
    r"me llamo|mi nombre es|señora?|sra?|pregunten por|atentamente|a nombre de|esposa"
)
RIGHT_CUES = r"id|nik|ktp|had promised|signed|anrufen|m'a reçu|menandatangani|sudah berjanji|hatte|promised to|avait promis|había prometido"
ID_CUES = r"national id|identity|identity card|id number|id card|id|nik|ktp|npwp|paspor|passport|tax number|tax id|ausweis\w*|reisepass|pass|steuer\w*|passeport|carte d'identité|identité|numéro fiscal|documento de identidad|identidad|pasaporte|dni|nif"

S = r"[\s ]"
# The patterns below read lower-case text.
EMAIL = re.compile(rf"[\w+\-]+(?:\.[\w+\-]+)*{S}?(?:@|[\[(]{S}?at{S}?[\])]){S}?[a-z][\w\-]*(?:(?:\.|{S}?[\[(]{S}?dot{S}?[\])]{S}?)[a-z][\w\-]*)+")
BRACKET_AT = re.compile(r"[\[(]\s?at")
ID_SHAPE = re.compile(r"(?<![\w./\-])(?:\d{6}-\d{6}-\d{4}|\d{4}([ \-.])\d{4}\1\d{4}\1\d{4}|\d\d\.\d{3}\.\d{3}\.\d-\d{3}\.\d{3}|\d{3}-\d\d-\d{4})(?![\w\-]|\.\d)")
SEVEN = re.compile(r"\d{7}(?![\w\-]|\.\d)")
PASSPORT_LEFT = re.compile(r"(?<![\w./\-])[a-z] ?$")
DATE = re.compile(r"\d{4}-\d\d-\d\d|\d\d?[./]\d\d?[./]\d{4}")
LONG_RUN = re.compile(r"(?<![\w./\-])\d(?:[ ]?\d){13,19}(?!\w)")
RUN = re.compile(r"\d[\d.\- ]{4,22}\d")
#: What any of the patterns of digits lies in, with the least number of digits of one, and how far around it they look.
DIGITS, LEAST_DIGITS, BEFORE_DIGITS, AFTER_DIGITS = re.compile(r"\d[\d.\-()/\s]{4,}\d"), 6, 8, 4
DAY = re.compile(r"[12]\d{3}-\d\d-\d\d")
ID_LEFT = re.compile(rf"\b(?:{ID_CUES})\b[\s:.#]*(?:(?:is|ist|adalah|saya|est|es|no|nr|nummer|number|nomor|número|numéro)\b[\s:.#]*){{0,3}}[a-z]{{0,2}}[ \-]?$")
PHONE = re.compile(r"(?:\+\d{1,3}|\(\+?\d{1,4}\)|(?<![\w./:\-])(?:0|62[\s.\-]))(?:[\s.\-]?\d){6,13}(?![\w]|[\-/.]\d)|(?<![\w./:\-])\d{3}-\d{4}(?![\w]|[\-/.]\d)")
NUMBERED = r"(?:street|st|road|rd|lane|ave|avenue|drive|court|close)"
#: (word that must be there, pattern) of street addresses.
ADDRESSES = [
    (("jl", "jalan"), re.compile(rf"\b(?:jl\.?|jalan){S}+(?!dari\b|ke\b)[^\W\d]+(?:{S}[^\W\d]+)?{S}*,?{S}*(?:no\.?{S}*)?\d+")),
    (("gang",), re.compile(rf"\bgang{S}+[^\W\d]+{S}+(?:blok|no\.?){S}*[a-z]?\d+")),
    (("street", " st", "road", " rd", "lane", " ave", "drive", "court", "close"), re.compile(rf"(?<!\w)\d{{1,4}}[a-z]?{S}+(?!the\b|a\b|this\b|that\b|my\b|on\b|by\b|of\b)[^\W\d]{{3,}}{S}+{NUMBERED}\b")),
    (("straße", "strasse", "str.", "str ", "gasse", "allee", "platz", "weg "), re.compile(rf"\b[^\W\d]{{3,}}(?:straße|strasse|str\.|str|gasse|allee|platz|weg){S}*\d+")),
    ((" rue", "avenue", "boulevard", "chemin", "allée", " place", "impasse", "quai"), re.compile(rf"(?<!\w)\d{{1,4}},?{S}+(?:rue|avenue|boulevard|chemin|allée|place|impasse|quai){S}+[^\W\d]+")),
    (("calle", "avenida", "paseo", "plaza"), re.compile(rf"\b(?:calle|avenida|paseo|plaza){S}+[^\W\d]+(?:{S}[^\W\d]+)?,?{S}*(?:n[º°.]{S}*)?\d+")),
]
CUE_WORDS = frozenset(re.findall(r"[^\W\d_]{2,}", f"{LEFT_CUES}|{RIGHT_CUES}|{ID_CUES}"))
LEFT_HEADS = frozenset(re.findall(r"[^\W\d_]+", c)[0] for c in re.sub(r"[?()]|\\w\*", "", LEFT_CUES).split("|")) | {"señor", "señora", "sr", "sra", "mr", "mrs", "name"}
RIGHT_HEADS = frozenset(w for c in RIGHT_CUES.split("|") for w in re.findall(r"[^\W\d_]{2,}", c))
WORD = re.compile(r"[^\W\d_]+")
LEFT = re.compile(rf"(?<!\w)(?P<cue>{LEFT_CUES})(?!\w)[.,:]?\s+(?:(?:mrs?|ms|dr|bapak|ibu|pak|bu|herr|frau|madame|monsieur|señora?|sra?)\.?\s+)?([^\W\d_]{{2,}})(?:\s+[^\W\d_]\.)?(?:\s+([^\W\d_]{{2,}}))?")
RIGHT = re.compile(rf"(?<!\w)(?P<cue>{RIGHT_CUES})\b")
BEFORE = re.compile(r"(?<![\w.@\-])([^\W\d_]{2,})\s+(?:[^\W\d_]\.\s*)?([^\W\d_]{2,}),?\s+$")
PAIR = re.compile(r"(?<![\w.@\-'])([^\W\d_]{2,})\s+(?:[^\W\d_]\.\s*)?(?=([^\W\d_]{2,})(?![@\w]|[._]\w))")
INITIAL = re.compile(r"(?<![\w.@\-'])([^\W\d_]{3,})\s+[^\W\d_]\.(?!\w)")


def lowered(text: str) -> str:
    """Lower case with every code point at its place."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


def windows(low: str) -> list[tuple[int, int]]:
    """Disjoint stretches of a text outside of which no pattern of digits can match."""
    out: list[tuple[int, int]] = []
    for m in DIGITS.finditer(low):
        if DAY.fullmatch(m[0]) or sum(map(str.isdigit, m[0])) < LEAST_DIGITS:
            continue
        a, b = max(0, m.start() - BEFORE_DIGITS), m.end() + AFTER_DIGITS
        if out and a < out[-1][1]:
            a = out.pop()[0]
        out.append((a, b))
    return out


def structural(low: str) -> Iterator[tuple[str, int, int, list[str] | None, int | None]]:
    """(kind, start, end, words, over) of what has a form of its own; spans do not overlap.

    A digit run that only the words around it can decide is of kind 'run' and brings them along, an address brings its
    own words. What overlaps a run stands only if the run does not; `over` is the start of that run.
    """
    taken: list[tuple[int, int]] = []
    runs: list[tuple[int, int]] = []

    def free(a: int, b: int) -> bool:
        if any(a < y and x < b for x, y in taken):
            return False
        taken.append((a, b))
        return True

    def over(a: int, b: int) -> int | None:
        return next((x for x, y in runs if a < y and x < b), None)

    if "@" in low or BRACKET_AT.search(low):
        for m in EMAIL.finditer(low):
            if free(*m.span()):
                yield "email", *m.span(), None, None
    for w in windows(low):
        for m in ID_SHAPE.finditer(low, *w):
            if free(*m.span()):
                yield "id_number", *m.span(), None, None
        for m in SEVEN.finditer(low, *w):
            if (left := PASSPORT_LEFT.search(low, max(0, m.start() - 3), m.start())) and free(left.start(), m.end()):
                yield "id_number", left.start(), m.end(), None, None
        for m in RUN.finditer(low, *w):
            if sum(c.isdigit() for c in m[0]) < LEAST_DIGITS or DATE.fullmatch(m[0]):
                continue
            if (left := ID_LEFT.search(low, max(0, m.start() - 50), m.start())) and free(*m.span()):
                yield "id_number", *m.span(), None, None
        for m in LONG_RUN.finditer(low, *w):
            if not any(m.start() < y and x < m.end() for x, y in taken):
                runs.append(m.span())
                yield "run", *m.span(), sorted(set(near(low, *m.span()))), None
        for m in PHONE.finditer(low, *w):
            if free(*m.span()):
                yield "phone", *m.span(), None, over(*m.span())
    for words, pattern in ADDRESSES:
        if any(w in low for w in words):
            for m in pattern.finditer(low):
                if free(*m.span()):
                    yield "address", *m.span(), sorted(address_words(m[0])), over(*m.span())


def address_words(found: str) -> set[str]:
    """The words of an address that may disclose it."""
    return {w for w in WORD.findall(found) if len(w) > 1}


def near(text: str, a: int, b: int) -> list[str]:
    """The words around a span: the four before it and the three after it, in the same sentence."""
    left = re.split(r"[.!?\n]\s", text[max(0, a - 60) : a])[-1]
    right = re.split(r"[.!?\n]", text[b : b + 40])[0]
    return WORD.findall(left)[-4:] + WORD.findall(right)[:3]


def _counts(b: pa.RecordBatch) -> dict:
    """Per term: occurrences, occurrences in protected places, in addresses, near long digit runs and near identity numbers."""
    n: Counter[str] = Counter()
    a: Counter[tuple[str, str]] = Counter()
    runs: Counter[str] = Counter()
    ids: Counter[str] = Counter()
    streets: Counter[str] = Counter()
    for t in b.column("text").to_pylist():
        low = lowered(t)
        words = WORD.findall(low)
        for marks, pattern in ADDRESSES:
            if any(w in low for w in marks):
                for m in pattern.finditer(low):
                    streets.update(address_words(m[0]))
        n.update(words)
        if not LEFT_HEADS.isdisjoint(words):
            for m in LEFT.finditer(low):
                a.update((m["cue"], w) for w in m.groups()[1:] if w and w not in CUE_WORDS)
        if not RIGHT_HEADS.isdisjoint(words):
            for m in RIGHT.finditer(low):
                if left := BEFORE.search(low, max(0, m.start() - 60), m.start()):
                    a.update((m["cue"], w) for w in left.groups() if w not in CUE_WORDS)
        for win in windows(low):
            for m in ID_SHAPE.finditer(low, *win):
                ws = set(near(low, *m.span()))
                ids.update(ws)
                runs.update(ws)
            for m in LONG_RUN.finditer(low, *win):
                runs.update(set(near(low, *m.span())))
    ws, hits = list(n), list(a)
    none = [0] * len(hits)
    return {
        "term": ws + [w for _, w in hits],
        "cue": [None] * len(ws) + [c for c, _ in hits],
        "n": [n[w] for w in ws] + none,
        "a": [0] * len(ws) + [a[x] for x in hits],
        "r": [runs[w] for w in ws] + none,
        "i": [ids[w] for w in ws] + none,
        "s": [streets[w] for w in ws] + none,
    }


class TermFilter:
    """A Bloom filter of the disclosing terms; remembers what it was asked."""

    def __init__(self, bits: np.ndarray) -> None:
        self.bits = bits
        self.asked: set[str] = set()
        self.yes: set[str] = set()

    def of(self, words: list[str]) -> set[str]:
        """Those of the words that may disclose."""
        here = set(words)
        if new := here - self.asked:
            if len(self.asked) > 2_000_000:
                self.asked.clear()
                self.yes.clear()
                new = here
            ask = list(new)
            self.yes.update(w for w, ok in zip(ask, may_be_in(self.bits, ask), strict=True) if ok and len(w) > 1)
            self.asked |= new
        return here & self.yes


def name_spans(low: str, terms: TermFilter) -> list[tuple[int, int, str, str | None]]:
    """(start, end, term, second term or None) of possible names; all terms must disclose."""
    out: list[tuple[int, int, str, str | None]] = []
    flagged = terms.of(WORD.findall(low))
    if not flagged:
        return out
    for m in PAIR.finditer(low):
        if m[1] in flagged and m[2] in flagged:
            out.append((m.start(1), m.end(2), m[1], m[2]))
    for m in INITIAL.finditer(low):
        if m[1] in flagged:
            out.append((m.start(), m.end(), m[1], None))
    for m in LEFT.finditer(low):
        after = low[m.end(2) : m.end(2) + 2]
        if m[2] in flagged and after[:1] not in ("@", "_") and not (after[:1] == "." and after[1:].isalnum()):
            out.append((m.start(2), m.end(2), m[2], None))
    return out


def _model(src: DataFrame) -> tuple[DataFrame, np.ndarray, DataFrame, DataFrame]:
    """(terms that disclose names, their filter, terms that disclose addresses, log odds of the words near long digit runs for an identity number)."""
    texts = src.select("text").distinct()  # copies of a text say nothing new about its words
    counts = arrow_map(texts, _counts, "term string, cue string, n bigint, a bigint, r bigint, i bigint, s bigint")
    by_cue = counts.groupBy("term", "cue").agg(*[F.sum(c).alias(c) for c in "naris"])
    sums = by_cue.groupBy("term").agg(*[F.sum(c).alias(c) for c in "naris"], F.max("a").alias("of_one_cue"))
    sums = cut_lineage(sums.where("a > 0 OR r > 0 OR s > 0"))  # the other terms disclose nothing
    # A word of one cue that mostly stands outside protected places is part of a phrase, however often the cue brings it along.
    phrase = (F.col("of_one_cue") >= PHRASE_CUE * F.col("a")) & (F.col("n") - 2 * F.col("a") > PHRASE_DEVIATIONS * F.sqrt("n"))
    discloses = lambda c: f"{c} > 0 AND ({c} + {PRIOR_HITS}) / (n + {PRIOR_ALL}) >= {DISCLOSURE}"
    strong = sums.withColumn("a", F.when(phrase, 0).otherwise(F.col("a"))).where(discloses("a")).select("term")
    odds = sums.where("r > 0").select("term", F.expr("ln((i + 0.5) / (r - i + 0.5))").alias("odds"))
    return strong, bloom_bits(strong, "term"), sums.where(discloses("s")).select("term"), odds


def findings(texts: DataFrame, id_col: str, text_col: str, with_text: bool = False) -> DataFrame:
    """(id, kind, start, end[, text]): every piece of personal information, positions in code points.

    Ids with several texts must hold equal texts; they give their pieces once. Null and empty texts hold
    none. Columns besides those named are ignored.
    """
    src = texts.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    strong, filled, streets, odds = _model(src)
    shared = src.sparkSession.sparkContext.broadcast(filled.tobytes())  # at most MOST_BITS bits, whatever the corpus
    held: dict[str, TermFilter] = {}

    def run(b: pa.RecordBatch) -> dict:
        if "f" not in held:
            held["f"] = TermFilter(np.frombuffer(shared.value, np.uint8))
        ids, out = b.column("id").to_pylist(), []
        for i, t in zip(ids, b.column("text").to_pylist(), strict=True):
            low = lowered(t)
            out += [(i, k, s, e, None, None, ws, o) for k, s, e, ws, o in structural(low)]
            out += [(i, "name", s, e, w, v, None, None) for s, e, w, v in name_spans(low, held["f"])]
        return dict(zip(("id", "kind", "start", "end", "w1", "w2", "words", "over"), map(list, zip(*out)), strict=True)) if out else None

    kind = src.schema["id"].dataType.simpleString()
    found = cut_lineage(arrow_map(src, run, f"id {kind}, kind string, start int, end int, w1 string, w2 string, words array<string>, over int"))
    found = found.dropDuplicates(["id", "kind", "start", "end"])
    # The filter lets a few other terms through; the exact terms decide. All joins are shuffled, as the sizes of what
    # Python gives are not known.
    exact = lambda df, col, terms: df.join(terms.withColumnRenamed("term", col).hint("merge"), col, "left_semi")
    named = exact(found.where("kind = 'name'"), "w1", strong)
    named = named.where("w2 IS NULL").unionByName(exact(named.where("w2 IS NOT NULL"), "w2", strong))
    lived = exact(found.where("kind = 'address'").withColumn("w1", F.explode("words")), "w1", streets).dropDuplicates(["id", "start", "end"])
    # Every word around a run has its odds, however rare it is.
    asked = found.where("kind = 'run'").select("id", "start", "end", F.explode("words").alias("term")).join(odds.hint("merge"), "term")
    numbers = asked.groupBy("id", "start", "end").agg(F.sum("odds").alias("odds")).where("odds > 0").select("id", F.lit("id_number").alias("kind"), "start", "end")
    own = found.where("kind NOT IN ('name', 'run', 'address')").unionByName(lived.select(found.columns))
    under = own.where("over IS NOT NULL").alias("u").join(numbers.hint("merge").alias("n"), F.expr("u.id <=> n.id AND u.over = n.start"), "left_anti")
    parts = [own.where("over IS NULL"), under, named, numbers]
    return functools.reduce(DataFrame.unionByName, [p.select("id", "kind", "start", "end") for p in parts]).withColumnRenamed("id", id_col)


def redact(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text, redacted, n_found): each text with [EMAIL], [PHONE], [ID_NUMBER], [ADDRESS] and [NAME] in place of what was found.

    One row per distinct id; nothing else of the text changes. A null text stays null.
    """
    hits = findings(texts, id_col, text_col).groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct("start", (-F.col("end")).alias("back"), "kind"))).alias("hits"))
    rows = texts.select(id_col, F.col(text_col).alias("text")).dropDuplicates([id_col]).join(hits.hint("merge"), id_col, "left")
    step = """aggregate(coalesce(hits, array()), struct('' AS o, 0 AS at, 0 AS n),
      (s, h) -> CASE WHEN h.start < s.at THEN s ELSE struct(concat(s.o, substring(text, s.at + 1, h.start - s.at), '[', upper(h.kind), ']') AS o, -h.back AS at, s.n + 1 AS n) END)"""
    done = rows.withColumn("s", F.expr(step))
    return done.select(id_col, F.col("text").alias(text_col), F.expr("concat(s.o, substring(text, s.at + 1))").alias("redacted"), F.col("s.n").alias("n_found"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings(verbatims(spark, sf_dir), "case_id", "verbatim").select("case_id", "kind").distinct()


def p3_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verbatim of each case with placeholders."""
    return redact(verbatims(spark, sf_dir), "case_id", "verbatim").select("case_id", "redacted", "n_found")


QUERIES = {"p3_found": p3_found, "p3_redacted": p3_redacted}

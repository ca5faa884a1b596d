"""Arithmetic of spoken dialogues, and of made-up dates and states, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spoken words a second, fast and slow, by language; weights of the states; the spread of a band.
WORDS_PER_SECOND = {"en": (2.85, 2.1), "id": (3.0, 2.15)}
STATES = (("open", 0.15), ("in_progress", 0.25), ("resolved", 0.35), ("closed", 0.15), ("escalated", 0.05))
LEAST_WORDS = 8


def tts_bounds(lo: Column, hi: Column, language: Column) -> tuple[Column, Column]:
    """Fewest and most words of a dialogue of lo to hi seconds.

    Few words at the fast rate must still fill the shortest time; many at the slow rate must not exceed the longest.
    """
    fast = F.when(language == "id", WORDS_PER_SECOND["id"][0]).otherwise(WORDS_PER_SECOND["en"][0])
    slow = F.when(language == "id", WORDS_PER_SECOND["id"][1]).otherwise(WORDS_PER_SECOND["en"][1])
    least = F.greatest(F.lit(LEAST_WORDS), F.ceil(lo * fast)).cast("int")
    return least, F.greatest(least, F.floor(hi * slow).cast("int"))


def turn_cap(most_words: Column) -> Column:
    """Turns that a dialogue of so many words may have."""
    return F.least(F.lit(64), F.greatest(F.lit(28), F.floor(most_words / 17).cast("int") + 14))


def token_budget(sum_words: Column, configured: Column) -> Column:
    """Output tokens to ask for."""
    return F.least(F.lit(65536), F.greatest(configured, F.floor(sum_words * 2.3 + 4096).cast("int")))


def slack(lo: Column, hi: Column) -> Column:
    """Words by which a dialogue may exceed its band."""
    return F.greatest(F.lit(35), F.bround(F.lit(0.28) * (hi - lo), 0).cast("int"))


def violates(words: Column, lo: Column, hi: Column) -> Column:
    """Too few words, or more than band and slack allow."""
    return (words < lo) | (words > hi + slack(lo, hi))


def slot(index: Column, n: Column) -> Column:
    """The first of several dialogues is the shortest, the last the longest; a single one is the longest."""
    return F.when(index == n, "maximum").when(index == 1, "minimum").otherwise("random")


def state(u: Column) -> Column:
    """A state for a uniform number; what the weights leave over goes to closed."""
    out, run = None, 0.0
    for name, w in STATES:
        run = round(run + w, 6)
        out = F.when(u <= run, name) if out is None else out.when(u <= run, name)
    return out.otherwise("closed")


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) that depends on its arguments alone."""
    return F.pmod(F.xxhash64(*parts), F.lit(1_000_003)) / F.lit(1_000_003.0)


def date_range(start: Column, end: Column) -> tuple[Column, Column]:
    """Both given as they are, one missing 365 days away, none the year 2026; a start after its end is an error at run time."""
    a = F.when(start.isNull() & end.isNull(), F.lit("2026-01-01").cast("date")).otherwise(F.coalesce(start, F.date_sub(end, 365)))
    b = F.when(start.isNull() & end.isNull(), F.lit("2026-12-31").cast("date")).otherwise(F.coalesce(end, F.date_add(start, 365)))
    return F.when(a > b, F.raise_error("the start lies after the end").cast("date")).otherwise(a), b


def timestamps(seed: Column, timezone: str = "+07:00", day: Column | None = None, year: int = 2026) -> tuple[Column, Column]:
    """(created, updated) as ISO text, drawn by the seed; updated is null for 35 of 100 and never earlier.

    With a `day` both lie on it, at any time. Without, created lies on one of the first 28 days of a month of the
    year in office hours, 8 to 18, and updated up to 72 hours later.
    """
    u = lambda what: uniform(seed, F.lit(what))
    n = lambda what, lo, hi: (F.lit(lo) + F.floor(u(what) * (F.lit(hi) - F.lit(lo) + 1))).cast("int")
    text = lambda t: F.concat(F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss"), F.lit(timezone))
    plus = lambda t, s: F.timestamp_seconds(F.unix_timestamp(t) + s)
    if day is None:
        created = F.make_timestamp(F.lit(year), n("month", 1, 12), n("day", 1, 28), n("hour", 8, 18), n("minute", 0, 59), n("second", 0, 59))
        updated = plus(created, n("later", 1, 72) * 3600)
    else:
        at = n("second", 0, 86_399)
        created = plus(day.cast("timestamp"), at)
        updated = plus(created, F.floor(u("later") * (F.lit(86_400) - at)).cast("int"))
    return text(created), F.when(u("open") >= 0.35, text(updated))


def nps_segment(score: Column) -> Column:
    return F.when(score >= 9, "promoter").when(score >= 7, "passive").when(score >= 0, "detractor")


def word_band(index: Column, n: Column, target_s: Column, lo_s: Column, hi_s: Column, lo_w: Column, hi_w: Column) -> tuple[Column, Column, Column]:
    """(fewest words, most words, mode) of one dialogue of a batch.

    Each slot gets a window about its own centre. A global range too narrow for separate windows, or windows
    of the first and last dialogue that would overlap, give every dialogue the global range.
    """
    span = hi_w - lo_w
    half = F.when(span > 0, F.greatest(F.lit(10), F.least(F.lit(48), F.floor(span / 4).cast("int")))).otherwise(0)
    apart = half * 2 + 20
    roomy = (n >= 2) & (span >= F.least(F.lit(70), F.greatest(F.lit(48), apart))) & (span >= apart)

    def window(centre: Column) -> tuple[Column, Column]:
        a = F.greatest(lo_w, F.bround(centre - half, 0).cast("int"))
        b = F.least(hi_w, F.bround(centre + half, 0).cast("int"))
        a, b = F.least(a, b), F.greatest(a, b)
        return a, F.when(b - a < 10, F.least(hi_w, a + 12)).otherwise(b)

    share = F.when(hi_s > lo_s, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (target_s - lo_s) / (hi_s - lo_s)))).otherwise(0.5)
    short, long_ = window(lo_w + half * 0.2), window(hi_w - half * 0.2)
    free = window(lo_w + share * span)
    overlap = short[1] > long_[0]
    mode = F.when(~roomy, "global").when(overlap, "global_overlap_fallback").otherwise("per_slot")
    name = slot(index, n)
    pick = lambda k: F.when(name == "minimum", short[k]).when(name == "maximum", long_[k]).otherwise(free[k])
    own = roomy & ~overlap
    return F.when(own, pick(0)).otherwise(lo_w).cast("int"), F.when(own, pick(1)).otherwise(hi_w).cast("int"), mode

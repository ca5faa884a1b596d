"""Text functions as Column expressions; everything stays in the JVM but the two JSON readers."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

UNNAMED = "Unnamed cluster"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ustrip(c: Column | str) -> Column:
    """Without leading and trailing Unicode white space; null stays null."""
    return F.regexp_replace(col(c), r"(?U)^\s+|\s+$", "")


def rstrip(c: Column | str) -> Column:
    return F.regexp_replace(col(c), r"(?U)\s+$", "")


def filled(c: Column | str) -> Column:
    """True for text that holds more than white space, false for null."""
    return F.coalesce(ustrip(c) != "", F.lit(False))


def blank_to_null(c: Column | str) -> Column:
    return F.nullif(ustrip(c), F.lit(""))


def word_count(c: Column | str) -> Column:
    """Tokens between Unicode white space; 0 for null."""
    return F.coalesce(F.size(F.regexp_extract_all(col(c), F.lit(r"(?U)(\S+)"), F.lit(1))), F.lit(0))


def first_words(c: Column | str, n: int = 3) -> Column:
    """The first `n` words of a label (letters, digits, underscores, hyphens), or a stock name where there is none."""
    words = F.filter(F.split(F.coalesce(col(c), F.lit("")), r"(?U)[^\w\-]+"), lambda w: w != "")
    return F.when(F.size(words) > 0, F.array_join(F.slice(words, 1, n), " ")).otherwise(F.lit(UNNAMED))


def clamp(c: Column | str, most: int) -> Column:
    """Text longer than `most` is cut to most-1 characters, stripped at the right and ends in an ellipsis."""
    return F.when(F.length(col(c)) > most, F.concat(rstrip(F.substring(col(c), 1, max(most - 1, 0))), F.lit("…"))).otherwise(col(c))


def pad(c: Column | str, least: int, phrases: list[str], seed: Column) -> Column:
    """Text shorter than `least` gets stock phrases, each picked anew by the seed, until it is long enough; then the filler is cut to fit."""
    if not phrases:
        return col(c)
    turns = least // min(len(p) + 1 for p in phrases) + 1
    pick = lambda k: F.element_at(F.array(*map(F.lit, phrases)), (F.pmod(F.xxhash64(seed, k), F.lit(len(phrases))) + 1).cast("int"))
    filler = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(turns)), lambda k: F.concat(F.lit(" "), pick(k))), "")
    return F.when(F.length(col(c)) < least, F.concat(col(c), F.substring(filler, F.lit(1), F.lit(least) - F.length(col(c))))).otherwise(col(c))


def finalize(c: Column | str, least: int, most: int, phrases: list[str], seed: Column) -> Column:
    """Stripped, padded, clamped."""
    return clamp(pad(ustrip(c), least, phrases, seed), most)


def safe_filename(c: Column | str, empty: str = "branch_unknown") -> Column:
    """A name without characters that paths forbid; blank and null get the stock name."""
    return F.coalesce(F.nullif(F.regexp_replace(ustrip(c), r'[<>:"/\\|?*]', "_"), F.lit("")), F.lit(empty))


def language_code(c: Column | str) -> Column:
    """en and id from their usual names, any two letters as they are, en for null and empty text, null for what names no language."""
    x = F.lower(ustrip(F.coalesce(F.nullif(col(c), F.lit("")), F.lit("en"))))
    return F.when(x.isin("en", "english"), "en").when(x.isin("id", "indonesian", "bahasa", "bahasa indonesia", "in"), "id").when(x.rlike(r"^\p{L}{2}$"), x)


def iso_date(c: Column | str, strict: bool = True) -> Column:
    """A date, timestamp or ISO text as a date; null and blank text null. Other text is an error at run time, or null if not strict."""
    t = blank_to_null(col(c).cast("string"))
    day = F.regexp_extract(t, r"^(\d{4}-\d{2}-\d{2})(?:[ T].*)?$", 1)
    plain = F.regexp_replace(F.regexp_extract(t, r"^(\d{8})$", 1), r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3")
    got = F.coalesce(F.try_to_date(F.nullif(day, F.lit(""))), F.try_to_date(F.nullif(plain, F.lit(""))))
    return F.when(t.isNotNull() & got.isNull(), F.raise_error(F.concat(F.lit("no ISO date: "), t)).cast("date")).otherwise(got) if strict else got


def whole_number(c: Column | str) -> Column:
    """A count as a whole number, towards zero; null for what is no number."""
    return col(c).try_cast("double").try_cast("bigint")


def relative_path(path: Column | str, folder: Column | str) -> Column:
    """A path below a folder, with slashes; a path elsewhere as it is."""
    p, f = (F.regexp_replace(col(x), r"\\\\", "/") for x in (path, folder))
    f = F.concat(F.regexp_replace(f, "/+$", ""), F.lit("/"))
    return F.when(F.startswith(p, f), F.substr(p, F.length(f) + 1)).otherwise(p)


def branch_code(region: Column | str, index: Column | str) -> Column:
    """BR-, four letters of the region, three digits."""
    return F.format_string("BR-%s-%03d", F.upper(F.substring(F.regexp_replace(col(region), "_", ""), 1, 4)), col(index))


def fixed(c: Column | str, digits: int) -> Column:
    """A number with so many decimals, halves to even."""
    return F.regexp_replace(F.format_number(col(c), digits), ",", "")


def markdown_cell(c: Column | str) -> Column:
    """Text for a cell of a pipe table: line breaks as <br>, pipes escaped, null empty."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(col(c).cast("string"), F.lit("")), r"\r?\n", "<br>"), r"\|", r"\\|")


def markdown_header(name: str) -> str:
    return name.replace("|", "/")


def salvage(text: str | None) -> dict | None:
    """The JSON object in a model's answer: from a code fence, else all of it, else from the first to the last brace; {} for nothing, None for a broken one."""
    t = (text or "").strip()
    if not t:
        return {}
    fence = re.search(r"```(?:json)?\s*(.*?)```", t, re.S | re.I)
    t = fence[1].strip() if fence else t
    if not t.startswith("{"):
        a, b = t.find("{"), t.rfind("}")
        if a < 0 or b <= a:
            return None
        t = t[a : b + 1]
    try:
        got = json.loads(t)
    except ValueError:
        return None
    return got if isinstance(got, dict) else None


def prefix_object(text: str | None) -> dict | None:
    """The first JSON object of an answer; a byte order mark, a fence before it and text after it are ignored."""
    t = (text or "").lstrip("﻿").strip()
    t = re.sub(r"^```(?:json)?\s*", "", t, flags=re.I)
    a = t.find("{")
    if a < 0:
        return None
    try:
        got, _ = json.JSONDecoder().raw_decode(t[a:])
    except ValueError:
        return None
    return got if isinstance(got, dict) else None


@pandas_udf(T.MapType(T.StringType(), T.StringType()))
def json_salvage(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if (d := salvage(t)) is None else {k: v if isinstance(v, str) else json.dumps(v) for k, v in d.items()})


@pandas_udf(T.StringType())
def json_prefix(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if (d := prefix_object(t)) is None else json.dumps(d, ensure_ascii=False))


def read_line(t: str | None) -> tuple[str, str | None]:
    """('object', 'other' or 'bad') for a stripped line, and its object written plainly: the last of equal keys, no NaN, nested values as JSON text."""
    try:
        d = json.loads(t)
    except (ValueError, TypeError):
        return "bad", None
    if not isinstance(d, dict):
        return "other", None
    plain = {k: json.dumps(v, ensure_ascii=False) if isinstance(v, (dict, list)) else None if v != v else v for k, v in d.items()}
    return "object", json.dumps(plain, ensure_ascii=False)


@pandas_udf(T.StructType([T.StructField("kind", T.StringType()), T.StructField("clean", T.StringType())]))
def json_line(s: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([read_line(t) for t in s], columns=["kind", "clean"])

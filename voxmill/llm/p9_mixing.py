"""Problem 9: sources mixed to target shares of the tokens, with a cap on repeats.

The mix is as large as all documents together, each counted once; a source's budget is its share of that.
Documents of a source are counted by their exact token length, and everything is decided on that histogram:
whole repeats first, then of every length the same fraction, rounded so that the largest remainders get a document
more, then a bounded knapsack by dynamic programming over the lengths hits the rest, a few documents, as exactly as it
can be hit. The documents themselves are chosen by a seeded rank within their length. A source that
cannot fill its budget gives all it may.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxmill.llm.tokens import TOKENIZER, token_counts
from voxmill.session import cut_lineage, table

SEED = 17
#: So many of the longest documents fit into the rest that the dynamic programme fills: enough to hit it.
KNAPSACK_DOCUMENTS = 4


def bounded_knapsack(lengths: list[int], counts: list[int], budget: int) -> list[int]:
    """How many documents of each length to take, so that their sum is the largest not above `budget`.

    A bit set of the sums that can be reached grows step by step; of every sum the step that reached it first is
    kept, so memory is a few bytes a token of the budget, however many lengths there are. It ends when the budget is hit.
    """
    out = [0] * len(lengths)
    if budget <= 0:
        return out
    mask, reach = (1 << (budget + 1)) - 1, 1
    steps: list[tuple[int, int]] = []
    by = np.full(budget + 1, -1, np.int32)
    for i, (n, c) in enumerate(zip(lengths, counts, strict=True)):
        left, size = min(c, budget // n if n else 0), 1
        while left > 0 and not reach >> budget:  # c copies as 1, 2, 4, ... and a rest
            take = min(size, left)
            new = (reach << (n * take)) & mask & ~reach
            if new:
                bits = np.unpackbits(np.frombuffer(new.to_bytes((budget >> 3) + 1, "little"), np.uint8), bitorder="little")
                by[np.flatnonzero(bits)] = len(steps)
                reach |= new
            steps.append((i, take))
            left -= take
            size *= 2
    at = reach.bit_length() - 1
    while at > 0:
        i, take = steps[by[at]]
        out[i] += take
        at -= lengths[i] * take
    return out


def plan(lengths: np.ndarray, counts: np.ndarray, budget: int, max_repeats: int) -> np.ndarray:
    """Copies to take of each length, sum not above the budget; each document at most `max_repeats` times."""
    lengths, counts = np.asarray(lengths, np.int64), np.asarray(counts, np.int64)
    ok = lengths > 0
    total = int((lengths * counts).sum())
    out = np.zeros(len(lengths), np.int64)
    if total == 0 or max_repeats <= 0 or budget <= 0:
        return out
    if total * max_repeats <= budget:
        return np.where(ok, counts * max_repeats, 0)
    whole = budget // total
    out += np.where(ok, counts * whole, 0)
    rest = budget - whole * total
    part = np.where(ok, (counts * rest) // total, 0)
    out += part
    remainder = np.where(ok, (counts * rest) % total, 0)
    rest -= int((lengths * part).sum())
    room = np.where(ok, counts - part, 0)
    order = np.lexsort((lengths, -remainder))
    order = order[(room[order] > 0) & (remainder[order] > 0)]
    more = order[: np.searchsorted(np.cumsum(lengths[order]), rest - KNAPSACK_DOCUMENTS * int(lengths.max()), side="right")]
    out[more] += 1
    room[more] -= 1
    rest -= int(lengths[more].sum())
    by_remainder = np.lexsort((lengths, -remainder))
    # A rest too small to be hit: documents of the least remainders are given back until it is large enough.
    back = by_remainder[::-1][out[by_remainder[::-1]] > 0]
    short = KNAPSACK_DOCUMENTS * int(lengths.max()) - rest
    if short > 0:
        back = back[: np.searchsorted(np.cumsum(lengths[back]), short) + 1]
        out[back] -= 1
        room[back] += 1
        rest += int(lengths[back].sum())
    fits = by_remainder[(room[by_remainder] > 0) & (lengths[by_remainder] <= rest) & ok[by_remainder]]
    more = bounded_knapsack(lengths[fits].tolist(), room[fits].tolist(), rest)
    out[fits] += np.array(more, np.int64)
    return out


def source_key(c: str) -> Column:
    """A source as it is compared: without case and outer white space."""
    return F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))


def budgets(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """(mix_id, source, target_share, max_repeats, target_tokens, available_tokens, can_be_met) for each row of `targets`.

    `sized` has (id, n_tokens, source). Tokens of rows without a source count in the size of the mix only.
    Null shares and repeats count as 0.
    """
    have = sized.where("source IS NOT NULL").groupBy(source_key("source").alias("key")).agg(F.sum("n_tokens").alias("source_tokens"))
    total = sized.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("all_tokens"))
    t = targets.select("mix_id", "source", F.coalesce("target_share", F.lit(0.0)).alias("target_share"), F.coalesce("max_repeats", F.lit(0)).alias("max_repeats"), source_key("source").alias("key"))
    t = t.join(have, "key", "left").crossJoin(F.broadcast(total))  # one row
    t = t.withColumn("target_tokens", F.col("target_share") * F.col("all_tokens")).withColumn("available_tokens", F.coalesce("source_tokens", F.lit(0)) * F.col("max_repeats"))
    return t.withColumn("can_be_met", F.col("available_tokens") >= F.col("target_tokens"))


def mix(sized: DataFrame, id_col: str, targets: DataFrame, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """Chosen documents (mix_id, source, id, n_tokens, copies) and shares (mix_id, source, target_share, target_tokens, actual_tokens, actual_share, can_be_met, falls_short).

    A row falls short if its plan takes every copy there is and still stays below the target.
    """
    b = cut_lineage(budgets(sized, targets))
    keyed = sized.where("source IS NOT NULL").select(F.col(id_col).alias("id"), "n_tokens", source_key("source").alias("key"))
    histogram = keyed.groupBy("key", "n_tokens").agg(F.count(F.lit(1)).alias("c"))

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("n_tokens")
        g["copies"] = plan(g["n_tokens"].to_numpy(), g["c"].to_numpy(), int(g["target_tokens"].iloc[0]), int(g["max_repeats"].iloc[0]))
        return g[["mix_id", "source", "key", "n_tokens", "c", "copies"]]

    # A group is a histogram: at most as many rows as there are token lengths.
    wanted = b.select("mix_id", "source", "key", "target_tokens", "max_repeats").join(histogram, "key").groupBy("mix_id", "source").applyInPandas(run, "mix_id bigint, source string, key string, n_tokens bigint, c bigint, copies bigint").where("copies > 0")
    wanted = cut_lineage(wanted)
    # The seeded rank of a document within its length: by the high bits of its hash first, whose counts are
    # summed up, then within equal high bits, so that one length may hold any share of the documents.
    group = ["mix_id", "source", "n_tokens"]
    hashed = keyed.join(wanted, ["key", "n_tokens"]).withColumn("h", F.xxhash64(F.lit(seed), "mix_id", "id")).withColumn("high", F.shiftrightunsigned("h", 54))
    sizes = hashed.groupBy(*group, "high").agg(F.count(F.lit(1)).alias("size"))
    before = F.coalesce(F.sum("size").over(Window.partitionBy(*group).orderBy("high").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.row_number().over(Window.partitionBy(*group, "high").orderBy("h", "id"))
    ranked = hashed.join(sizes.select(*group, "high", before.alias("before")), [*group, "high"]).withColumn("r", F.col("before") + inside)
    copies = F.floor(F.col("copies") / F.col("c")) + F.when(F.col("r") <= F.col("copies") % F.col("c"), 1).otherwise(0)
    chosen = ranked.withColumn("copies", copies.cast("int")).where("copies > 0").select("mix_id", "source", F.col("id").alias(id_col), "n_tokens", "copies")
    got = wanted.groupBy("mix_id", "source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("actual_tokens"))
    shares = b.join(got, ["mix_id", "source"], "left").withColumn("actual_tokens", F.coalesce("actual_tokens", F.lit(0)))
    shares = shares.withColumn("falls_short", (F.col("actual_tokens") >= F.col("available_tokens")) & (F.col("actual_tokens") < F.col("target_tokens")))
    whole = shares.groupBy("mix_id").agg(F.sum("actual_tokens").alias("mix_tokens"))
    shares = shares.join(whole, "mix_id").select("mix_id", "source", "target_share", F.floor("target_tokens").alias("target_tokens"), "actual_tokens", F.round(F.col("actual_tokens") / F.greatest("mix_tokens", F.lit(1)), 6).alias("actual_share"), "can_be_met", "falls_short")
    return chosen, shares


def _sized(spark: SparkSession, sf_dir: str, tokenizer: str = TOKENIZER) -> DataFrame:
    return cut_lineage(token_counts(table(spark, sf_dir, "documents"), "doc_id", "text", "source", tokenizer=tokenizer))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_sized(spark, sf_dir), "doc_id", table(spark, sf_dir, "mix_targets"))[1].where("falls_short AND NOT can_be_met").select("mix_id", "source")


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual share of each source of each mix."""
    return mix(_sized(spark, sf_dir), "doc_id", table(spark, sf_dir, "mix_targets"))[1].drop("falls_short")


def p9_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of each mix and how often each is taken."""
    return mix(_sized(spark, sf_dir), "doc_id", table(spark, sf_dir, "mix_targets"))[0].select("mix_id", "source", "doc_id", "copies")


def p9_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per target: whether its tokens keep to the budget, whether a budget that can be met is met but for less than a thousandth, copies beyond the cap."""
    sized, targets = _sized(spark, sf_dir), table(spark, sf_dir, "mix_targets")
    chosen, shares = mix(sized, "doc_id", targets)
    most = chosen.groupBy("mix_id", "source").agg(F.max("copies").alias("most")).join(targets, ["mix_id", "source"], "right")
    hit = (~F.col("can_be_met")) | (F.col("actual_tokens") >= 0.999 * F.col("target_tokens"))
    return shares.select("mix_id", "source", (F.col("actual_tokens") <= F.col("target_tokens")).alias("within"), hit.alias("hit")).join(most.select("mix_id", "source", (F.coalesce("most", F.lit(0)) > F.col("max_repeats")).alias("repeated_too_often")), ["mix_id", "source"])


QUERIES = {"p9_checks": p9_checks, "p9_found": p9_found, "p9_shares": p9_shares, "p9_selection": p9_selection}

"""Problem 4: groups of texts that differ by small edits, without comparing all pairs.

A text is its set of distinct words. Texts with equal sets form one class, of which only one row goes on.
The fingerprint of a class is a row of min-hash symbols in SEGMENTS segments. Multi-index hashing looks each
segment up with its whole Hamming ball of radius one: for every symbol of the segment one key leaves that
symbol out, so two fingerprints meet in a segment exactly if they differ there in at most one symbol. Pairs
that meet are verified by the complete distance of their 128-bit sketches and then by the exact share of
common words. Groups are the connected components of the verified pairs; classes of equal sets come back in.

Chance that a pair of similarity s meets, with q = s**6 + 6 s**5 (1 - s): 1 - (1 - q)**6, which is 0.990 at
0.75, 0.998 at 0.8 and 0.99999 at 0.9. For corpora far larger than a billion texts raise SEGMENT_SYMBOLS and
SEGMENTS together, as chance meetings grow with the square of the number of classes.

No join here is left to size estimates, as these do not count what an explode or a Python stage multiplies: all
are shuffled. A key that very many classes share is cut into blocks, and every block meets every block in a task
of its own; so is a group whose pairs are asked for. All pairs are compared either way.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxmill.llm.common import arrow_map, bloom_keep, verbatims
from voxmill.operators.components import connected_components
from voxmill.session import cut_lineage

WORD = re.compile(r"[^\W_]+")
SEGMENTS, SEGMENT_SYMBOLS = 6, 6
HASHES = 128
#: Similarity of a pair: common words over words of both together.
SIMILARITY = 0.75
#: Largest distance of the sketches of a pair; 3.8 standard deviations above the mean at 0.75.
WHOLE_DISTANCE = 30
#: Keys of a shuffle partition of the self-join, about.
PARTITION_KEYS = 500_000
#: Keys are counted in so many bins at most, of BIN_KEYS keys on average where there are fewer.
MOST_BINS, BIN_KEYS = 1 << 20, 4096
#: Rows of a block: of a bin that holds more than its share by far, and of a group.
HOT_ROWS, GROUP_ROWS = 16_384, 2048

_rng = np.random.default_rng(20240611)
_MUL = (_rng.integers(1, 2**63, HASHES, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_ADD = _rng.integers(0, 2**63, HASHES, dtype=np.uint64)


def bags(texts: list[str]) -> list[np.ndarray]:
    """The sorted hashes of the distinct words of each text."""
    known: dict[str, int] = {}

    def h(w: str) -> int:
        got = known.get(w)
        if got is None:
            got = known[w] = xxhash.xxh64_intdigest(w) - (1 << 63)
        return got

    return [np.sort(np.fromiter(map(h, set(WORD.findall(t.lower()))), np.int64)) for t in texts]


def fingerprints(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Min-hash symbols (a byte each) and the 128-bit sketch (two words) of each non-empty set."""
    flat = np.concatenate(sets)
    at = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]]).astype(np.int64)
    words, ids = np.unique(flat, return_inverse=True)
    words = words.astype(np.uint64)
    symbols = np.empty((len(sets), SEGMENTS * SEGMENT_SYMBOLS), np.uint8)
    sketch = np.zeros((len(sets), 2), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(HASHES):
            h = words * _MUL[k] + _ADD[k]
            h ^= h >> np.uint64(32)
            h = (h * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(32)
            low = np.minimum.reduceat(h.astype(np.uint32)[ids], at)
            low = (low ^ (low >> np.uint32(15))) * np.uint32(0x2C1B3C6D)  # spread what the minimum left of the low bits
            if k < symbols.shape[1]:
                symbols[:, k] = low >> np.uint32(24)
            sketch[:, k // 64] |= ((low >> np.uint32(13)) & np.uint32(1)).astype(np.uint64) << np.uint64(k % 64)
    return symbols, sketch


def _signatures(b: pa.RecordBatch) -> dict | None:
    sets = bags(b.column("text").to_pylist())
    keep = [i for i, s in enumerate(sets) if len(s)]
    if not keep:
        return None
    sets = [sets[i] for i in keep]
    symbols, sketch = fingerprints(sets)
    return {
        "id": b.column("id").take(pa.array(keep)),
        "set_id": [hashlib.md5(s.tobytes()).digest() for s in sets],
        "symbols": [r.tobytes() for r in symbols],
        "s0": sketch[:, 0].view(np.int64),
        "s1": sketch[:, 1].view(np.int64),
    }


def _ball_keys() -> Column:
    """Keys of the Hamming ball of radius one of every segment."""
    out = []
    for s in range(SEGMENTS):
        for j in range(SEGMENT_SYMBOLS):
            a = 1 + s * SEGMENT_SYMBOLS
            out.append(f"xxhash64({s * SEGMENT_SYMBOLS + j}, substring(symbols, {a}, {j}), substring(symbols, {a + j + 1}, {SEGMENT_SYMBOLS - 1 - j}))")
    return F.expr(f"array({', '.join(out)})")


def _joined(a: DataFrame, b: DataFrame, on, how: str = "inner") -> DataFrame:
    """A join that shuffles both sides, whatever their sizes are thought to be."""
    return a.join(b.hint("merge"), on, how)


def _cells(rows: DataFrame, row: Column, first: bool) -> DataFrame:
    """`rows` (with m, the blocks of their key) once for each block they meet: cell (i, j) holds block i of the one side and j of the other."""
    own = F.pmod(row, F.col("m"))
    met = rows.withColumn("_met", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    return met.withColumn("cell", own * F.col("m") + F.col("_met") if first else F.col("_met") * F.col("m") + own).drop("_met")


def _meetings(classes: DataFrame) -> DataFrame:
    """(c, d): numbers of classes that share a key and whose sketches are close, c < d; a pair comes once for each key."""
    # A class goes through the join by a short number; the set id decides later, so equal numbers do no harm.
    keyed = classes.select(F.xxhash64("set_id").alias("c"), "s0", "s1", F.explode(_ball_keys()).alias("key"))
    n_keys = classes.count() * SEGMENTS * SEGMENT_SYMBOLS
    parts, bins = max(1, -(-n_keys // PARTITION_KEYS)), max(1, min(MOST_BINS, n_keys // BIN_KEYS))
    close = F.expr(f"a.c < b.c AND bit_count(a.s0 ^ b.s0) + bit_count(a.s1 ^ b.s1) <= {WHOLE_DISTANCE}")
    # Bins with a hot key: fewer than `bins` / 4, as each holds four times the mean or more.
    hot_from = max(HOT_ROWS, 4 * n_keys // bins)
    binned = F.pmod(F.col("key"), F.lit(bins))
    hot = keyed.groupBy(binned.alias("bin")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot_from).collect()
    pairs = lambda a, b, on: _joined(a.alias("a"), b.alias("b"), [F.col(f"a.{k}") == F.col(f"b.{k}") for k in on]).where(close).select(F.col("a.c").alias("c"), F.col("b.c").alias("d"))
    if not hot:
        one = keyed.repartition(parts, "key")  # both sides are one plan, so their keys are shuffled once
        return pairs(one, one, ["key"])
    table = classes.sparkSession.createDataFrame([(r["bin"], -(-r["n"] // HOT_ROWS)) for r in hot], "bin bigint, m bigint")
    marked = keyed.withColumn("bin", binned).join(F.broadcast(table), "bin", "left").drop("bin")
    one, split = marked.where("m IS NULL").drop("m").repartition(parts, "key"), marked.where("m IS NOT NULL")
    return pairs(one, one, ["key"]).unionByName(pairs(_cells(split, F.col("c"), True), _cells(split, F.col("c"), False), ["key", "cell"]))


def similar_pairs(signatures: DataFrame, src: DataFrame) -> DataFrame:
    """(u, v, similarity): set ids of verified pairs of classes, u < v."""
    # Symbols and sketch follow from the set. Written out, so that both sides of the self-join have one plan to the end.
    classes = cut_lineage(signatures.select("set_id", "symbols", "s0", "s1").distinct())
    met = cut_lineage(_meetings(classes).distinct())
    number = signatures.select(F.xxhash64("set_id").alias("c"), "set_id")
    ends = met.select("c").union(met.select("d")).distinct()
    named = _joined(number, ends, "c", "left_semi").distinct()
    near = _joined(_joined(met, named.select("c", F.col("set_id").alias("u")), "c"), named.select(F.col("c").alias("d"), F.col("set_id").alias("v")), "d")
    near = cut_lineage(near.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")))
    # The words of the classes that are left, one text for each.
    wanted = near.select(F.col("u").alias("set_id")).union(near.select("v")).distinct()
    one = cut_lineage(_joined(signatures, wanted, "set_id", "left_semi").groupBy("set_id").agg(F.min("id").alias("id")))
    chosen = _joined(bloom_keep(src, "id", one), one, "id").dropDuplicates(["set_id"])
    words = cut_lineage(arrow_map(chosen.select("set_id", "text"), lambda b: {"set_id": b.column("set_id"), "bag": bags(b.column("text").to_pylist())}, "set_id binary, bag array<bigint>"))
    both = _joined(_joined(near, words.select(F.col("set_id").alias("u"), F.col("bag").alias("a")), "u"), words.select(F.col("set_id").alias("v"), F.col("bag").alias("b")), "v")
    common = both.withColumn("k", F.size(F.array_intersect("a", "b")))
    return common.select("u", "v", (F.col("k") / (F.size("a") + F.size("b") - F.col("k"))).alias("similarity")).where(f"similarity >= {SIMILARITY}")


def groups(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, class_id, group_id, n_links): one row per distinct id with at least one word.

    class_id names the set of words, group_id the connected component of similar classes, n_links counts
    the other classes that are similar to the row's own. Null ids, null texts and texts without a word
    belong to no group and have no row. Ids with several texts must hold equal texts. Copies are never
    expanded into pairs.
    """
    src = texts.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id IS NOT NULL AND text IS NOT NULL")
    kind = src.schema["id"].dataType.simpleString()
    signatures = cut_lineage(arrow_map(src, _signatures, f"id {kind}, set_id binary, symbols binary, s0 bigint, s1 bigint"))
    edges = cut_lineage(similar_pairs(signatures, src).select("u", "v"))
    comp = connected_components(edges)
    links = edges.select("u").union(edges.select("v")).groupBy("u").agg(F.count(F.lit(1)).alias("n_links"))
    member = signatures.select("id", "set_id").dropDuplicates(["id"])
    out = _joined(_joined(member, comp.withColumnRenamed("node", "set_id"), "set_id", "left"), links.withColumnRenamed("u", "set_id"), "set_id", "left")
    return out.select(F.col("id").alias(id_col), F.lower(F.hex("set_id")).alias("class_id"), F.lower(F.hex(F.coalesce("component", "set_id"))).alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def pairs_within(g: DataFrame, id_col: str, group_col: str) -> DataFrame:
    """(id_a, id_b), id_a < id_b: every pair of distinct ids of one group. A large group is cut into blocks that meet in tasks of their own."""
    g = g.select(F.col(id_col).alias("id"), F.col(group_col).alias("g"))
    several = g.groupBy("g").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("g", F.ceil(F.col("n") / GROUP_ROWS).alias("m"))
    g = cut_lineage(_joined(g, several, "g"))
    a, b = (_cells(g, F.xxhash64("id"), first).drop("m") for first in (True, False))
    met = _joined(a.withColumnRenamed("id", f"{id_col}_a"), b.withColumnRenamed("id", f"{id_col}_b"), ["g", "cell"])
    return met.where(f"{id_col}_a < {id_col}_b").select(f"{id_col}_a", f"{id_col}_b")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs_within(groups(verbatims(spark, sf_dir), "case_id", "verbatim"), "case_id", "group_id")


def p4_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class, group and number of links of each case."""
    return groups(verbatims(spark, sf_dir), "case_id", "verbatim")


QUERIES = {"p4_found": p4_found, "p4_groups": p4_groups}

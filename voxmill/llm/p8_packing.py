"""Problem 8: texts into containers of fixed capacity, with little unused space.

Texts are measured in tokens; one that exceeds the capacity is split into full pieces and a rest, no other is.
The pieces are dealt into partitions and packed there by best-fit decreasing. Dual-feasible functions give a
lower bound of the number of containers of each partition: a partition that meets its bound is certified and
done. From the others the containers with gaps are opened, and their pieces exchanged: dealt anew into fewer
partitions and packed again, until all are certified, one partition is left or a round brings nothing.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxmill.llm.tokens import TOKENIZER, token_counts
from voxmill.session import cut_lineage, table

#: Pieces of one partition, about.
PARTITION_PIECES = 20_000
#: A container filled at least so far is not opened again.
FULL = 0.995
#: Exchange ends when a round leaves more than this share of the partitions to be packed again.
STALLED = 0.9


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    """Containers that any packing needs: the best of the plain bound and two families of dual-feasible functions."""
    if not len(sizes):
        return 0
    s = np.asarray(sizes, np.int64)
    best = -(-int(s.sum()) // capacity)
    half = np.unique(np.append(s[s * 2 <= capacity], capacity // 2))
    for t in half[np.linspace(0, len(half) - 1, min(64, len(half))).astype(int)]:
        # more than capacity - t counts as a whole container, less than t as nothing
        big, mid = s > capacity - t, (s >= t) & (s <= capacity - t)
        best = max(best, int(big.sum()) + -(-int(s[mid].sum()) // capacity))
    for k in range(2, 9):  # rounds the share of the container down to k-ths, except where it is one exactly
        whole = ((k + 1) * s) % capacity == 0
        value = np.where(whole, s * k, ((k + 1) * s // capacity) * capacity)
        best = max(best, -(-int(value.sum()) // (capacity * k)))
    return best


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The container of each piece; pieces of size 0 go with the first container."""
    order = np.argsort(-sizes, kind="stable")
    out = np.zeros(len(sizes), np.int64)
    rooms: list[int] = []  # free space of open containers, sorted
    at: dict[int, list[int]] = {}
    n = 0
    for i in order.tolist():
        s = int(sizes[i])
        j = bisect_left(rooms, s)
        if j < len(rooms):
            room = rooms.pop(j)
            c = at[room].pop()
        else:
            room, c = capacity, n
            n += 1
        out[i] = c
        insort(rooms, room - s)
        at.setdefault(room - s, []).append(c)
    return out


def pieces(sizes: DataFrame, id_col: str, capacities: DataFrame) -> DataFrame:
    """(spec_id, capacity, id, piece_no, n_pieces, n_tokens): every text, cut where it exceeds the capacity."""
    caps = capacities.where("capacity_tokens > 0").select("spec_id", F.col("capacity_tokens").cast("bigint").alias("capacity"))
    both = sizes.select(F.col(id_col).alias("id"), F.coalesce("n_tokens", F.lit(0)).alias("size")).crossJoin(caps)  # each text meets each specification: the result has that size
    n = F.greatest(F.ceil(F.col("size") / F.col("capacity")), F.lit(1))
    cut = both.withColumn("n_pieces", n.cast("int")).withColumn("piece_no", F.explode(F.expr("sequence(1, n_pieces)")))
    return cut.select("spec_id", "capacity", "id", "piece_no", "n_pieces", F.least("capacity", F.expr("size - capacity * (piece_no - 1)")).alias("n_tokens"))


def _packer(r: int, last: bool, names: list[str]):
    """Packs one partition; pieces of containers to be opened again come back without one."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["n_tokens", "id", "piece_no"], ascending=[False, True, True])
        cap, s = int(g["capacity"].iloc[0]), g["n_tokens"].to_numpy()
        c = best_fit_decreasing(s, cap)
        fill = np.bincount(c, weights=s)
        certified = len(fill) == lower_bound(s, cap)
        keep = np.ones(len(c), bool) if last or certified else (fill >= FULL * cap)[c]
        g["container"] = [f"{r}-{p}-{k}" if ok else None for p, k, ok in zip(g["part"], c, keep, strict=True)]
        return g[[*names, "container"]]

    return run


def pack(sizes: DataFrame, id_col: str, capacities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Where every piece goes, and what is known about the containers.

    Gives (spec_id, id, piece_no, n_pieces, n_tokens, container) and (spec_id, capacity, n_containers,
    lower_bound, fill). Texts of 0 or unknown size are pieces of size 0. Containers without a positive
    capacity are left out. `sizes` has (id, n_tokens), `capacities` (spec_id, capacity_tokens).
    """
    todo = pieces(sizes, id_col, capacities)
    n = sizes.count()
    parts = max(1, -(-n // PARTITION_PIECES))
    kind = todo.schema["id"].dataType.simpleString()
    names = ["spec_id", "capacity", "id", "piece_no", "n_pieces", "n_tokens"]
    fields = f"spec_id bigint, capacity bigint, id {kind}, piece_no int, n_pieces int, n_tokens bigint"
    # Full pieces fill a container of their own: nothing to pack.
    done = [todo.where("n_tokens = capacity").select(*todo.columns, F.concat_ws("-", F.lit("whole"), F.col("id").cast("string"), "piece_no").alias("container"))]
    todo = todo.where("n_tokens < capacity")
    r, last = 0, parts == 1
    while True:
        dealt = todo.withColumn("part", F.pmod(F.xxhash64("id", "piece_no", F.lit(r)), F.lit(parts)))
        packed = cut_lineage(dealt.groupBy("spec_id", "part").applyInPandas(_packer(r, last, names), f"{fields}, container string"))
        done.append(packed.where("container IS NOT NULL"))
        todo = packed.where("container IS NULL").drop("container")
        left = 0 if last else todo.count()
        if not left:
            break
        fewer = max(1, -(-left // PARTITION_PIECES))
        last, parts, r = fewer == 1 or fewer > STALLED * parts, min(fewer, parts), r + 1
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.withColumnRenamed("id", id_col), _report(out)


def _report(packed: DataFrame) -> DataFrame:
    """Containers, lower bound over all pieces by their size histogram, and fill of each specification."""
    sizes = packed.groupBy("spec_id", "capacity", "n_tokens").agg(F.count(F.lit(1)).alias("c"))  # at most capacity rows each

    def bound(g: pd.DataFrame) -> pd.DataFrame:
        cap = int(g["capacity"].iloc[0])
        s, c = g["n_tokens"].to_numpy(), g["c"].to_numpy()
        best = -(-int((s * c).sum()) // cap)
        for t in [*np.unique(s[s * 2 <= cap])[:: max(1, len(s) // 64)], cap // 2]:
            big, mid = s > cap - t, (s >= t) & (s <= cap - t)
            best = max(best, int(c[big].sum()) + -(-int((s * c)[mid].sum()) // cap))
        return pd.DataFrame({"spec_id": [g["spec_id"].iloc[0]], "lower_bound": [best]})

    low = sizes.groupBy("spec_id").applyInPandas(bound, "spec_id bigint, lower_bound bigint")
    used = packed.groupBy("spec_id", "capacity", "container").agg(F.sum("n_tokens").alias("t")).groupBy("spec_id", "capacity").agg(F.count(F.lit(1)).alias("n_containers"), F.sum("t").alias("n_tokens"))
    return used.join(low, "spec_id").select("spec_id", "capacity", "n_containers", "lower_bound", F.round(F.col("n_tokens") / (F.col("n_containers") * F.col("capacity")), 6).alias("fill"))


def _pack(spark: SparkSession, sf_dir: str, tokenizer: str = TOKENIZER) -> tuple[DataFrame, DataFrame]:
    sizes = cut_lineage(token_counts(table(spark, sf_dir, "documents"), "doc_id", "text", tokenizer=tokenizer))
    return pack(sizes, "doc_id", table(spark, sf_dir, "container_specs"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pack(spark, sf_dir)[0].where("n_pieces > 1").select("spec_id", "doc_id").distinct()


def p8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The container of every piece of every document."""
    return _pack(spark, sf_dir)[0].select("spec_id", "doc_id", "piece_no", "n_tokens", "container")


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers, lower bound and fill of each specification."""
    return _pack(spark, sf_dir)[1]


def p8_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per specification: documents packed, containers above capacity, documents split without need, whether the containers are within a hundredth of the bound."""
    packed, made = _pack(spark, sf_dir)
    caps = table(spark, sf_dir, "container_specs")
    over = packed.groupBy("spec_id", "container").agg(F.sum("n_tokens").alias("t")).join(caps, "spec_id").groupBy("spec_id").agg(F.count_if(F.col("t") > F.col("capacity_tokens")).alias("n_overfull"))
    whole = packed.groupBy("spec_id", "doc_id").agg(F.sum("n_tokens").alias("t"), F.max("n_pieces").alias("n")).join(caps, "spec_id")
    docs = whole.groupBy("spec_id").agg(F.count(F.lit(1)).alias("n_documents"), F.count_if((F.col("n") > 1) & (F.col("t") <= F.col("capacity_tokens"))).alias("n_split_without_need"))
    near = made.select("spec_id", (F.col("n_containers") <= F.ceil(F.col("lower_bound") * 1.01)).alias("near_bound"))
    return docs.join(over, "spec_id").join(near, "spec_id")


QUERIES = {"p8_checks": p8_checks, "p8_found": p8_found, "p8_packing": p8_packing, "p8_containers": p8_containers}

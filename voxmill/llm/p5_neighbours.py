"""Problem 5: the k most similar vectors, from a robust-pruned directed graph in each shard.

The collection is read in shards of at most SHARD_ROWS rows; every row is indexed. In a shard the points are
inserted in batches: a greedy beam search over the graph so far proposes neighbours, relaxed distance pruning
keeps a diverse few of them, reverse edges follow and are pruned alike. A query runs a beam search in every
shard, entered at the best of a sample of entry points, and the shards' answers are merged. Graphs are kept
in the shared folder, so queries in any number of blocks use one index.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxmill.llm.vectors import declared_dim, matrix, usable
from voxmill.session import cut_lineage, table

SHARD_ROWS = 16_384
#: Out-degree, beam of the insertion, relaxation of the pruning, points inserted at once.
DEGREE, BEAM, ALPHA, BATCH = 32, 64, 1.1, 1024
#: Beam of a query: this, and at least so many times k.
QUERY_BEAM, QUERY_BEAM_K = 384, 8
#: Points among which a search picks where to enter.
ENTRIES, ENTER_AT = 64, 8
#: Queries that travel together.
QUERY_BLOCK = 2048


def beam_search(x: np.ndarray, graph: np.ndarray, q: np.ndarray, beam: int, entries: np.ndarray, expand: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """The `beam` best rows of x that a greedy search finds for each row of q: (indices or -1, similarities), best first."""
    n, m = len(x), len(q)
    beam = max(beam, ENTER_AT)
    s = q @ x[entries].T
    at = np.argsort(-s, axis=1, kind="stable")[:, :ENTER_AT]
    ids = np.full((m, beam), -1, np.int32)
    sim = np.full((m, beam), -np.inf, np.float32)
    ids[:, : at.shape[1]], sim[:, : at.shape[1]] = entries[at], np.take_along_axis(s, at, 1)
    done = ids < 0
    seen = np.zeros((m, n), bool)
    rows = np.arange(m)
    seen[rows[:, None], ids[:, : at.shape[1]]] = True
    live = rows
    while len(live):
        waiting = ~done[live]
        order = np.cumsum(waiting, axis=1)
        pick = waiting & (order <= expand)
        has = pick.any(1)
        live, pick = live[has], pick[has]
        if not len(live):
            break
        r, c = np.nonzero(pick)
        done[live[r], c] = True
        nb = graph[ids[live[r], c]]
        slot = (np.cumsum(pick, axis=1) - 1)[r, c]
        cand = np.full((len(live), expand, graph.shape[1]), -1, np.int32)
        cand[r, slot] = nb
        cand = cand.reshape(len(live), -1)
        known = (cand < 0) | seen[live[:, None], np.maximum(cand, 0)]
        srt = np.sort(np.where(known, -1, cand), axis=1)  # a point may come from two expanded ones
        srt[:, 1:][srt[:, 1:] == srt[:, :-1]] = -1
        cand = srt
        ok = cand >= 0
        rr, cc = np.nonzero(ok)
        seen[live[rr], cand[rr, cc]] = True
        cs = np.full(cand.shape, -np.inf, np.float32)
        cs[rr, cc] = np.einsum("ij,ij->i", x[cand[rr, cc]], q[live[rr]])
        all_i, all_s = np.concatenate([ids[live], cand], 1), np.concatenate([sim[live], cs], 1)
        all_d = np.concatenate([done[live], ~ok], 1)
        best = np.argsort(-all_s, axis=1, kind="stable")[:, :beam]
        ids[live], sim[live], done[live] = np.take_along_axis(all_i, best, 1), np.take_along_axis(all_s, best, 1), np.take_along_axis(all_d, best, 1)
    return np.where(np.isfinite(sim), ids, -1), sim


def robust_prune(x: np.ndarray, cand: np.ndarray, sim: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA) -> np.ndarray:
    """A diverse few of each point's candidates (-1 pads): a kept one rules out those much nearer to it than to the point."""
    order = np.argsort(-sim, axis=1, kind="stable")
    cand, sim = np.take_along_axis(cand, order, 1), np.take_along_axis(sim, order, 1)
    alive = cand >= 0
    v = x[np.maximum(cand, 0)]
    far = 2 - 2 * sim  # squared distances of unit vectors
    out = np.full((len(cand), degree), -1, np.int32)
    rows = np.arange(len(cand))
    for k in range(degree):
        p = alive.argmax(1)
        has = alive[rows, p]
        if not has.any():
            break
        out[has, k] = cand[rows[has], p[has]]
        between = 2 - 2 * np.einsum("rcd,rd->rc", v, v[rows, p], optimize=True)
        alive &= ~(has[:, None] & (alpha * between <= far))
        alive[rows, p] = False
    return out


def build_graph(x: np.ndarray, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(graph, entry points) over the rows of x."""
    n = len(x)
    rng = np.random.default_rng(seed)
    order = rng.permutation(n).astype(np.int32)
    graph = np.full((n, DEGREE), -1, np.int32)
    first = order[: min(n, 256)]
    s = x[first] @ x[first].T
    np.fill_diagonal(s, -np.inf)
    graph[first] = robust_prune(x, np.where(np.isfinite(s), first[None, :], -1), s) if len(first) > 1 else -1
    entries = order[: min(n, ENTRIES)]
    a = len(first)
    while a < n:
        new = order[a : a + min(BATCH, a)]
        a += len(new)
        ids, sim = beam_search(x, graph, x[new], BEAM, entries)
        graph[new] = robust_prune(x, ids, sim)
        _link_back(x, graph, new)
    return _reachable(graph, entries), entries


def _reachable(graph: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """The graph with more columns, so that a walk from the entries can reach every point: what pruning cut off is tied to its own neighbours again."""
    n = len(graph)
    extra: list[tuple[np.ndarray, np.ndarray]] = []
    seen = np.zeros(n, bool)
    seen[entries] = True
    front = entries
    while True:
        while len(front):
            near = graph[front].ravel()
            near = np.unique(near[near >= 0])
            front = near[~seen[near]]
            seen[front] = True
        lost = np.flatnonzero(~seen)
        if not len(lost):
            break
        to = graph[lost]
        known = (to >= 0) & seen[np.maximum(to, 0)]
        at = known.any(1)
        if not at.any():  # a part without any edge to the rest hangs on an entry
            lost, src = lost[:1], entries[:1]
        else:
            lost = lost[at]
            src = to[at][np.arange(len(lost)), known[at].argmax(1)]
        extra.append((src, lost))
        seen[lost] = True
        front = lost
    if not extra:
        return graph
    src, dst = (np.concatenate(z) for z in zip(*extra, strict=True))
    order = np.argsort(src, kind="stable")
    src, dst = src[order], dst[order]
    rank = np.arange(len(src)) - np.searchsorted(src, src)
    more = np.full((n, int(rank.max()) + 1), -1, graph.dtype)
    more[src, rank] = dst
    return np.concatenate([graph, more], axis=1)


def _link_back(x: np.ndarray, graph: np.ndarray, new: np.ndarray) -> None:
    """Adds the edges back to points just inserted; full lists are pruned."""
    to, src = graph[new].ravel(), np.repeat(new, DEGREE)
    src, to = src[to >= 0], to[to >= 0]
    order = np.argsort(to, kind="stable")
    src, to = src[order], to[order]
    hit, start, count = np.unique(to, return_index=True, return_counts=True)
    rank = np.arange(len(to)) - np.repeat(start, count)
    cand = np.full((len(hit), DEGREE + int(count.max())), -1, np.int32)
    cand[:, :DEGREE] = graph[hit]
    cand[np.repeat(np.arange(len(hit)), count), DEGREE + rank] = src
    room = (cand >= 0).sum(1)
    fits = room <= DEGREE
    packed = np.sort(cand[fits], axis=1)[:, ::-1][:, :DEGREE]
    graph[hit[fits]] = packed
    hit, cand = hit[~fits], cand[~fits]
    for b in range(0, len(hit), 1024):
        h, c = hit[b : b + 1024], cand[b : b + 1024]
        s = np.where(c >= 0, np.einsum("rcd,rd->rc", x[np.maximum(c, 0)], x[h], optimize=True), -np.inf).astype(np.float32)
        keep = np.argsort(-s, axis=1, kind="stable")[:, :80]  # pruning looks at the nearest candidates only
        graph[h] = robust_prune(x, np.take_along_axis(c, keep, 1), np.take_along_axis(s, keep, 1))


def build_index(points: DataFrame, dim: int) -> DataFrame:
    """(ids, vectors, graph, entries): one row per shard of unit vectors (id, v), kept in the shared folder."""
    kind = points.schema["id"].dataType.simpleString()
    out = points.sparkSession.createDataFrame([], f"ids array<{kind}>, vectors binary, graph binary, entries binary").schema

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(out)

        def shard(parts):
            t = pa.Table.from_batches(parts)
            x = matrix(t.column("v").combine_chunks(), dim).astype(np.float32)
            graph, entries = build_graph(x)
            return pa.RecordBatch.from_arrays([pa.array([t.column("id").to_pylist()], target.field(0).type), *(pa.array([z.tobytes()], pa.binary()) for z in (x, graph, entries))], schema=target)

        held, n = [], 0
        for b in batches:
            while b.num_rows:
                part = b.slice(0, SHARD_ROWS - n)
                b = b.slice(part.num_rows)
                held.append(part)
                n += part.num_rows
                if n == SHARD_ROWS:
                    yield shard(held)
                    held, n = [], 0
        if n:
            yield shard(held)

    return cut_lineage(points.mapInArrow(run, out))


def search(index: DataFrame, queries: DataFrame, dim: int) -> DataFrame:
    """(query, id, similarity): for queries (query, id, v, k) the k points of highest cosine with another id, ties by id.

    Queries travel in blocks of QUERY_BLOCK, each block to each shard once; a shard answers with its k best.
    """
    qk, ik = queries.schema["query"].dataType.simpleString(), index.schema["ids"].dataType.elementType.simpleString()
    qid = queries.schema["id"].dataType.simpleString()
    block_schema = queries.sparkSession.createDataFrame([], f"qs array<{qk}>, own array<{qid}>, ks array<int>, qv binary").schema

    def pack(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(block_schema)
        for b in batches:
            for a in range(0, b.num_rows, QUERY_BLOCK):
                c = b.slice(a, QUERY_BLOCK)
                x = matrix(c.column("v"), dim).astype(np.float32)
                cols = [pa.array([c.column(n).to_pylist()], target.field(i).type) for i, n in enumerate(("query", "id", "k"))]
                yield pa.RecordBatch.from_arrays([*cols, pa.array([x.tobytes()], pa.binary())], schema=target)

    # Kept, as the product below reads them again for every partition of the index.
    blocks = cut_lineage(queries.select("query", "id", F.col("k").cast("int").alias("k"), "v").mapInArrow(pack, block_schema))
    out = queries.sparkSession.createDataFrame([], f"query {qk}, id {ik}, k int, similarity double").schema

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(out)
        for b in batches:
            for r in b.to_pylist():
                x = np.frombuffer(r["vectors"], np.float32).reshape(-1, dim)
                graph = np.frombuffer(r["graph"], np.int32).reshape(len(x), -1)
                entries, q = np.frombuffer(r["entries"], np.int32), np.frombuffer(r["qv"], np.float32).reshape(-1, dim)
                most = max(r["ks"], default=0) + 1  # the query's own point may be among them
                found, sim = [], []
                for a in range(0, len(q), 512):
                    i, s = beam_search(x, graph, q[a : a + 512], max(QUERY_BEAM, QUERY_BEAM_K * most), entries)
                    found += list(i)
                    sim += list(s)
                res = [(r["qs"][j], r["ids"][i], r["ks"][j], float(s)) for j in range(len(q)) for i, s in zip(found[j][: r["ks"][j] + 1], sim[j], strict=False) if i >= 0 and r["ids"][i] != r["own"][j]]
                if res:
                    yield pa.RecordBatch.from_arrays([pa.array(z, target.field(n).type) for n, z in enumerate(zip(*res, strict=True))], schema=target)

    met = index.crossJoin(blocks).mapInArrow(run, out)  # blocks x shards, a row for thousands of points
    rank = Window.partitionBy("query").orderBy(F.desc("similarity"), "id")
    return met.withColumn("r", F.row_number().over(rank)).where("r <= k").select("query", "id", F.col("r").alias("rank"), "similarity")


def _points(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    dim = declared_dim(spark, sf_dir)
    return usable(table(spark, sf_dir, "voc_collection"), "id", "embedding", dim), dim


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    points, dim = _points(spark, sf_dir)
    probes = table(spark, sf_dir, "probe_points").join(points, "id").select(F.col("probe_no").alias("query"), "id", "v", "k")
    return search(build_index(points, dim), probes, dim).select(F.col("query").alias("probe_no"), "id")


def p5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten most similar points of every case whose number is divisible by 50, against all."""
    points, dim = _points(spark, sf_dir)
    asked = points.where(F.regexp_extract("id", r"(\d+)$", 1).cast("bigint") % 50 == 0).select(F.col("id").alias("query"), "id", "v", F.lit(10).alias("k"))
    return search(build_index(points, dim), asked, dim).select("query", "id", "rank", F.round("similarity", 5).alias("similarity"))


QUERIES = {"p5_found": p5_found, "p5_neighbours": p5_neighbours}

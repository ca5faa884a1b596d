"""Problem 7: topics of a vector collection, with their size and most typical members.

Points meet near points: pivots, the points of lowest hash, divide the space into cells, and every point goes to the
cells of its two nearest pivots, so each pair of neighbouring cells holds points in common. In a cell, neighbour
descent builds an approximate nearest-neighbour graph. Points whose k-th neighbour is no nearer than in a
structureless cloud of as many points as the collection has are background. Modularity-based community detection
runs over the edges among the others. Communities of different cells are tied by the points they share; ties whose
union raises the modularity of this contracted graph, and that hold more than stray points, join communities into
clusters. What belongs to none goes through the same once more. A point belongs to the cluster of its community; a cluster is described by its size and by the members of
highest weighted degree inside of their community.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voxmill.llm.common import arrow_map, hash_sample
from voxmill.llm.vectors import declared_dim, matrix, usable
from voxmill.operators.components import connected_components
from voxmill.session import cut_lineage, table

#: Points for each pivot; a cell holds twice as many on average, as every point goes to two. Pivots are sent to all
#: tasks: at 64 components the most are 1 MiB.
CELL_ROWS, MOST_PIVOTS = 4096, 4096
#: A cell beyond this is dealt into parts by the hash of the id; parts of one cell share points through other cells.
PART_ROWS = 8192
#: Neighbours of a point in the graph.
NEIGHBOURS = 12
#: Random trees that neighbour descent begins with, and rows of their leaves at most.
TREES, LEAF_ROWS = 5, 384
#: Rounds of neighbour descent at most; it ends when fewer than this share of the lists change.
ROUNDS, SETTLED = 12, 0.05
#: Resolution of the modularity; local moving ends when three times in a row no more than this share of the nodes move.
RESOLUTION, FEW_MOVES = 0.5, 0.002
#: How far above the structureless cloud the valley between background and topics is sought, and half its width.
VALLEY, WIDTH = 0.20, 0.02
#: Bins of the similarities between -1 and 1, and the chance with which a point of the cloud may lie above its bound.
BINS, CLOUD_CHANCE = 800, 1 / 512
#: Smallest community: a point and its neighbours.
LEAST_MEMBERS = NEIGHBOURS + 1
#: Communities are joined if they share so many points at least. A point is shared if its k-th neighbour in the one cell
#: is at most so many times farther (in 1 - similarity, plus the slack) than in the other: else its own topic lies elsewhere.
LEAST_SHARED, FARTHER, SLACK = 3, 1.6, 0.02
#: Share of a community's members that lie outside of its radius.
TAIL = 0.005
TYPICAL = 5


def _leaves(x: np.ndarray, rng: np.random.Generator) -> list[np.ndarray]:
    """The rows dealt into leaves of a random tree: halves along the difference of two random rows, down to LEAF_ROWS."""
    out, todo = [], [np.arange(len(x))]
    while todo:
        m = todo.pop()
        if len(m) <= LEAF_ROWS:
            out.append(m)
            continue
        a, b = x[m[rng.integers(len(m), size=2)]]
        order = np.argpartition(x[m] @ (a - b), len(m) // 2)
        todo += [m[order[: len(m) // 2]], m[order[len(m) // 2 :]]]
    return out


def neighbour_descent(x: np.ndarray, k: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Approximate k nearest neighbours of every row by dot product: (indices, similarities), best first.

    The lists begin with the neighbours within the leaves of a few random trees. Then each round samples new and old
    neighbours of a point, forward and backward, and offers them to each other.
    """
    n = len(x)
    k = min(k, n - 1)
    rng = np.random.default_rng(seed)
    if n <= 4 * k + 8:  # too few points to sample from
        s = x @ x.T
        np.fill_diagonal(s, -np.inf)
        idx = np.argsort(-s, axis=1, kind="stable")[:, :k]
        return idx, np.take_along_axis(s, idx, 1)
    idx, sim, fresh = np.full((n, k), -1, np.int32), np.full((n, k), -np.inf, np.float32), np.zeros((n, k), bool)
    for _ in range(TREES):
        got = []
        for m in _leaves(x, rng):
            s = x[m] @ x[m].T
            np.fill_diagonal(s, -np.inf)
            j = np.argpartition(-s, k - 1, axis=1)[:, :k]
            got.append((np.repeat(m, k), m[j].ravel(), np.take_along_axis(s, j, 1).ravel()))
        i, j, s = (np.concatenate([g[c] for g in got]) for c in range(3))
        ok = np.isfinite(s)
        _offer(idx, sim, fresh, i[ok], j[ok], s[ok].astype(np.float32))
    fresh[:] = idx >= 0
    take = max(4, (k + 1) // 2)
    for _ in range(ROUNDS):
        new = _sample(idx, fresh, take, rng)
        used = (new[:, :, None] == idx[:, None, :]).any(1)
        old = _sample(idx, ~fresh & (idx >= 0), take, rng)
        fresh &= ~used
        cand = np.concatenate([new, _reverse(new, n, take, rng), old, _reverse(old, n, take, rng)], 1)
        news = 2 * take
        ups: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        worst = sim[:, -1]
        for a in range(0, n, 2048):
            c = cand[a : a + 2048]
            v = x[np.maximum(c, 0)]
            s = np.matmul(v[:, :news], v.transpose(0, 2, 1))
            p = np.broadcast_to(c[:, :news, None], s.shape)
            q = np.broadcast_to(c[:, None, :], s.shape)
            good = (p >= 0) & (q >= 0) & (p != q)
            for i, j in ((p, q), (q, p)):
                g = good & (s > worst[np.maximum(i, 0)])
                ups.append((i[g], j[g], s[g]))
        i, j, s = (np.concatenate([u[m] for u in ups]) for m in range(3))
        if _offer(idx, sim, fresh, i, j, s) < SETTLED * n * k:
            break
    return idx, sim


def _sample(idx: np.ndarray, allowed: np.ndarray, take: int, rng: np.random.Generator) -> np.ndarray:
    """Up to `take` allowed entries of each row, -1 elsewhere."""
    key = np.where(allowed, rng.random(idx.shape, dtype=np.float32), 2)
    at = np.argpartition(key, take - 1, axis=1)[:, :take]
    return np.where(np.take_along_axis(key, at, 1) < 2, np.take_along_axis(idx, at, 1), -1)


def _reverse(lists: np.ndarray, n: int, take: int, rng: np.random.Generator) -> np.ndarray:
    """Up to `take` random points of each point's reverse lists."""
    own = np.repeat(np.arange(n), lists.shape[1])
    to = lists.ravel()
    own, to = own[to >= 0], to[to >= 0]
    order = np.argsort(to + rng.random(len(to)), kind="stable")
    own, to = own[order], to[order]
    first = np.searchsorted(to, np.arange(n))
    rank = np.arange(len(to)) - first[to]
    out = np.full((n, take), -1, lists.dtype)
    ok = rank < take
    out[to[ok], rank[ok]] = own[ok]
    return out


def _offer(idx: np.ndarray, sim: np.ndarray, fresh: np.ndarray, i: np.ndarray, j: np.ndarray, s: np.ndarray) -> int:
    """Puts offered neighbours into the lists; gives the number of entries that changed."""
    n, k = idx.shape
    if not len(i):
        return 0
    key = i.astype(np.int64) * n + j
    _, first = np.unique(key, return_index=True)
    i, j, s = i[first], j[first], s[first]
    known = (idx[i] == j[:, None]).any(1)
    i, j, s = i[~known], j[~known], s[~known]
    order = np.lexsort((-s, i))
    i, j, s = i[order], j[order], s[order]
    rank = np.arange(len(i)) - np.searchsorted(i, i)
    ok = rank < k
    i, j, s, rank = i[ok], j[ok], s[ok], rank[ok]
    hit = np.unique(i)
    at = np.searchsorted(hit, i)
    more = np.full((len(hit), k), -1, idx.dtype)
    more_s = np.full((len(hit), k), -np.inf, np.float32)
    more[at, rank], more_s[at, rank] = j, s
    all_i, all_s = np.concatenate([idx[hit], more], 1), np.concatenate([sim[hit], more_s], 1)
    all_f = np.concatenate([fresh[hit], np.ones_like(more, bool)], 1)
    best = np.argsort(-all_s, axis=1, kind="stable")[:, :k]
    idx[hit], sim[hit], fresh[hit] = (np.take_along_axis(z, best, 1) for z in (all_i, all_s, all_f))
    return int((best >= k).sum())


def communities(n: int, u: np.ndarray, v: np.ndarray, w: np.ndarray, resolution: float = RESOLUTION, seed: int = 0) -> np.ndarray:
    """Community of each node by modularity: local moving in random halves, then the same over the contracted graph."""
    rng = np.random.default_rng(seed)
    label = np.arange(n)
    nodes = n
    while True:
        moved = _local_moving(nodes, u, v, w, resolution, rng)
        names, moved = np.unique(moved, return_inverse=True)
        label = moved[label]
        if len(names) == nodes:
            return label
        nodes = len(names)
        key, inv = np.unique(moved[u] * nodes + moved[v], return_inverse=True)
        w = np.bincount(inv, weights=w)
        u, v = key // nodes, key % nodes


def _local_moving(n: int, u: np.ndarray, v: np.ndarray, w: np.ndarray, resolution: float, rng: np.random.Generator) -> np.ndarray:
    """u, v, w hold every edge in both directions, loops once."""
    deg = np.bincount(u, weights=w, minlength=n)
    total = deg.sum()
    lab = np.arange(n)
    off = u != v
    u, v, w = u[off], v[off], w[off]
    still = 0
    for turn in range(60):
        mass = np.bincount(lab, weights=deg, minlength=n)
        key, inv = np.unique(u * n + lab[v], return_inverse=True)
        to_w = np.bincount(inv, weights=w)
        node, com = key // n, key % n
        gain = to_w - resolution * deg[node] * (mass[com] - np.where(com == lab[node], deg[node], 0)) / total
        order = np.lexsort((com, -gain, node))
        node, com, gain = node[order], com[order], gain[order]
        first = np.concatenate([[True], node[1:] != node[:-1]]) if len(node) else np.empty(0, bool)
        best_n, best_c, best_g = node[first], com[first], gain[first]
        stay = np.zeros(n)
        stay -= resolution * deg * (mass[lab] - deg) / total
        own = com == lab[node]
        stay[node[own]] = gain[own]
        go = (best_g > stay[best_n] + 1e-12) & (best_c != lab[best_n])
        go &= rng.random(len(go)) < (0.5 if turn < 50 else 0.2)
        lab[best_n[go]] = best_c[go]
        still = still + 1 if go.sum() <= n * FEW_MOVES else 0
        if still >= 3:
            break
    return lab


def cloud_bound(n: int, dim: int, k: int) -> float:
    """The k-th similarity that CLOUD_CHANCE of the points of a structureless cloud of n points reach."""
    lo, hi = 0.0, float(k)
    for _ in range(60):  # the mean number of points within the bound, for which k or more are so rare
        mid = (lo + hi) / 2
        few = sum(math.exp(-mid + i * math.log(mid) - math.lgamma(i + 1)) for i in range(k)) if mid > 0 else 1.0
        lo, hi = (mid, hi) if 1 - few < CLOUD_CHANCE else (lo, mid)
    t = np.linspace(-1, 1, 20_001)
    tail = np.cumsum((np.maximum(1 - t * t, 0) ** ((dim - 3) / 2))[::-1])[::-1]
    return float(t[np.searchsorted(-tail / tail[0], -min(1.0, lo / max(n, 1)))])


def density_floor(counts: np.ndarray, n: int, dim: int, k: int = NEIGHBOURS) -> float:
    """The k-th similarity that divides background from dense points, from the histogram of all of them.

    It lies in the emptiest stretch between the bound of the structureless cloud and VALLEY above it.
    """
    low = cloud_bound(n, dim, k)
    at = np.linspace(low, low + VALLEY, 41)
    edges = np.linspace(-1, 1, len(counts) + 1)
    below = np.concatenate([[0], np.cumsum(counts)])
    within = np.interp(at + WIDTH, edges, below) - np.interp(at - WIDTH, edges, below)
    return float(at[within <= within.min() + 1e-9].mean())


def cell_communities(x: np.ndarray, idx: np.ndarray, sim: np.ndarray, floor: float) -> tuple[np.ndarray, np.ndarray]:
    """(community or -1, weighted degree inside of it) of each point of a cell, from its neighbours and their similarities."""
    n = len(x)
    none = np.full(n, -1), np.zeros(n)
    if n < LEAST_MEMBERS:
        return none
    k = idx.shape[1]
    dense = sim[:, -1] > floor
    u, v, w = np.repeat(np.arange(n), k), idx.ravel().astype(np.int64), sim.ravel().astype(np.float64)
    ok = dense[u] & dense[v] & (w > floor)
    u, v, w = u[ok], v[ok], w[ok]
    if not len(u):
        return none
    key, at = np.unique(np.minimum(u, v) * n + np.maximum(u, v), return_index=True)
    a, b, w = key // n, key % n, w[at] - floor  # what is hardly nearer than background ties hardly
    u, v, w = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([w, w])
    lab = communities(n, u, v, w)
    inner = np.bincount(u[lab[u] == lab[v]], weights=w[lab[u] == lab[v]], minlength=n)
    size = np.bincount(lab[dense], minlength=lab.max() + 1)
    lab = np.where(dense & (size[lab] >= LEAST_MEMBERS), lab, -1)
    return _inside(x, lab), inner


def _inside(x: np.ndarray, lab: np.ndarray) -> np.ndarray:
    """Labels in which a community whose centre lies inside the radius of a larger one has become a part of it.

    A group of copies fills the neighbour lists of its points with one another, so no edge leads out of it; its place
    tells what it belongs to.
    """
    names, own = np.unique(lab, return_inverse=True)
    if len(names) - (names[0] < 0) < 2:
        return lab
    sums = np.zeros((len(names), x.shape[1]))
    np.add.at(sums, own, x)
    centre = sums / np.maximum(np.linalg.norm(sums, axis=1), 1e-12)[:, None]
    near = np.einsum("ij,ij->i", x, centre[own])
    size = np.bincount(own)
    order = np.lexsort((near, own))
    start = np.searchsorted(own[order], np.arange(len(names)))
    radius = near[order][start + (TAIL * size).astype(int)]
    s = centre @ centre.T
    larger = (size[None, :] > size[:, None]) | ((size[None, :] == size[:, None]) & (np.arange(len(names))[None, :] < np.arange(len(names))[:, None]))
    s[~(larger & (s >= radius[None, :]))] = -np.inf
    if names[0] < 0:
        s[0, :] = s[:, 0] = -np.inf
    to = np.where(np.isfinite(s.max(1)), s.argmax(1), np.arange(len(names)))
    while (to[to] != to).any():  # larger ones may lie inside of still larger ones
        to = to[to]
    return names[to][own]


def _cells(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The two nearest pivots of each row (one, if there is but one), nearest first."""
    if len(pivots) < 2:
        return np.zeros((len(x), 1), np.int64)
    s = x @ pivots.T
    best = np.argpartition(-s, 1, axis=1)[:, :2]
    order = np.argsort(-np.take_along_axis(s, best, 1), axis=1, kind="stable")
    return np.take_along_axis(best, order, 1)


def cell_graphs(points: DataFrame, dim: int) -> tuple[DataFrame, int]:
    """(cell, ids, own, vectors, near, sims), one row a cell or part of one, kept in the shared folder; and the number of points.

    `points` has (id, v) with text ids and unit vectors. own says where a point is in its nearest pivot's cell.
    """
    n = points.count()
    sample = hash_sample(points, max(1, min(MOST_PIVOTS, -(-n // CELL_ROWS))), "id").collect()
    pivots = np.array([r["v"] for r in sample], np.float32).reshape(-1, dim)

    def count(b: pa.RecordBatch) -> dict:
        c = np.bincount(_cells(matrix(b.column("v"), dim).astype(np.float32), pivots).ravel(), minlength=len(pivots))
        return {"cell": np.flatnonzero(c), "n": c[c > 0]}

    sizes = {r.cell: r.n for r in arrow_map(points.select("v"), count, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).collect()}  # at most MOST_PIVOTS rows
    parts = np.array([-(-sizes.get(c, 0) // PART_ROWS) or 1 for c in range(max(1, len(pivots)))], np.int64)
    first = np.concatenate([[0], np.cumsum(parts)])

    def route(b: pa.RecordBatch) -> dict:
        import xxhash

        x = matrix(b.column("v"), dim).astype(np.float32)
        c = _cells(x, pivots)
        h = np.fromiter((xxhash.xxh64_intdigest(i) >> 1 for i in b.column("id").to_pylist()), np.int64, len(x))
        cell = np.concatenate([first[c[:, j]] + (h // (1 if j == 0 else 1_000_003)) % parts[c[:, j]] for j in range(c.shape[1])])
        twice = np.tile(np.arange(len(x)), c.shape[1])
        return {"cell": cell, "id": b.column("id").take(pa.array(twice)), "own": np.arange(len(cell)) < len(x), "v": b.column("v").take(pa.array(twice))}

    out = "cell bigint, ids array<string>, own binary, vectors binary, near binary, sims binary"
    target = points.sparkSession.createDataFrame([], out).schema

    def build(t: pa.Table) -> pa.Table:
        from pyspark.sql.pandas.types import to_arrow_schema

        x = matrix(t.column("v").combine_chunks(), dim).astype(np.float32)
        near, sims = neighbour_descent(x, NEIGHBOURS) if len(x) > NEIGHBOURS else (np.empty((0, NEIGHBOURS), np.int32), np.empty((0, NEIGHBOURS), np.float32))
        own = np.asarray(t.column("own").combine_chunks().to_numpy(zero_copy_only=False), bool)
        row = {"cell": [t.column("cell")[0].as_py()], "ids": [t.column("id").to_pylist()], "own": [own.tobytes()], "vectors": [x.tobytes()], "near": [near.astype(np.int32).tobytes()], "sims": [sims.astype(np.float32).tobytes()]}
        return pa.table(row, schema=to_arrow_schema(target))

    routed = arrow_map(points, route, "cell bigint, id string, own boolean, v array<float>").repartition(3 * int(first[-1]), "cell")
    return cut_lineage(routed.groupBy("cell").applyInArrow(build, target)), n


def _graph(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.frombuffer(row["own"], bool), np.frombuffer(row["near"], np.int32).reshape(-1, NEIGHBOURS), np.frombuffer(row["sims"], np.float32).reshape(-1, NEIGHBOURS)


def members(points: DataFrame, dim: int) -> DataFrame:
    """(id, cluster, degree): the points (id, v) that belong to a cluster, which is named by one of its communities.

    A thin topic may be spread over the cells of pivots of other topics. So the points that belong to none are dealt
    into cells anew, by pivots of their own, where thin topics stay together.
    """
    first = _members(points, dim)
    rest = cut_lineage(points.join(first.select("id").hint("merge"), "id", "left_anti"))
    second = _members(rest, dim)
    return first.unionByName(second.withColumn("cluster", -1 - F.col("cluster")))


def _members(points: DataFrame, dim: int) -> DataFrame:
    """One pass of `members`."""
    graphs, n = cell_graphs(points, dim)

    def kth(b: pa.RecordBatch) -> dict | None:
        got = [s[o[: len(s)], -1] for o, _, s in map(_graph, b.to_pylist())]  # where a point is at home
        c, _ = np.histogram(np.clip(np.concatenate(got), -1, 1), BINS, (-1, 1))
        return {"bin": np.flatnonzero(c), "n": c[c > 0]}

    counts = np.zeros(BINS)
    for r in arrow_map(graphs.select("own", "near", "sims"), kth, "bin int, n bigint").groupBy("bin").agg(F.sum("n").alias("n")).collect():  # at most BINS rows
        counts[r["bin"]] = r["n"]
    floor = density_floor(counts, n, dim)

    def label(b: pa.RecordBatch) -> dict | None:
        out: dict[str, list] = {"id": [], "kth": [], "community": [], "degree": []}
        for r in b.to_pylist():
            _, near, sims = _graph(r)
            lab, degree = cell_communities(np.frombuffer(r["vectors"], np.float32).reshape(-1, dim), near, sims, floor)
            at = np.flatnonzero(lab >= 0)
            out["id"] += [r["ids"][i] for i in at]
            out["kth"] += sims[at, -1].tolist()
            out["community"] += ((r["cell"] << 20) + lab[at]).tolist()
            out["degree"] += degree[at].tolist()
        return out

    seen = arrow_map(graphs, label, "id string, kth double, community bigint, degree double")
    # At most two rows of a point meet here: those of its two cells. Its community is that of the cell that knows it best.
    row = F.struct("kth", "community", "degree")
    home = seen.groupBy("id").agg(F.max(row).alias("best"), F.min(row).alias("other"))
    home = cut_lineage(home.select("id", "best.community", "best.degree", "other.community", 1 - F.col("best.kth"), 1 - F.col("other.kth")).toDF("id", "community", "degree", "other", "far", "other_far"))
    joined = connected_components(_ties(home))
    out = home.join(joined.withColumnRenamed("node", "community").hint("merge"), "community", "left")
    return cut_lineage(out.select("id", F.coalesce("component", "community").alias("cluster"), "degree"))


def _ties(home: DataFrame) -> DataFrame:
    """(a, b): communities to be joined, by the points they share."""
    shared = home.where(f"community <> other AND other_far <= {FARTHER} * far + {SLACK}")
    ties = cut_lineage(shared.groupBy(F.least("community", "other").alias("a"), F.greatest("community", "other").alias("b")).agg(F.count(F.lit(1)).alias("w")))
    total = ties.agg(F.coalesce(2 * F.sum("w"), F.lit(0)).cast("double").alias("m")).first()["m"]
    degree = ties.select(F.col("a").alias("c"), "w").union(ties.select("b", "w")).groupBy("c").agg(F.sum("w").alias("d"))
    of = lambda c: degree.select(F.col("c").alias(c), F.col("d").alias(f"d_{c}")).hint("merge")
    full = ties.join(of("a"), "a").join(of("b"), "b")
    gains = F.col("w") > RESOLUTION * F.col("d_a") * F.col("d_b") / F.lit(max(total, 1.0))
    return full.where(gains & (F.col("w") >= LEAST_SHARED)).select("a", "b")


def _points(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    dim = declared_dim(spark, sf_dir)
    return usable(table(spark, sf_dir, "voc_collection"), "id", "embedding", dim), dim


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The seeds are points of the graph like all others, so a seed lies in a cluster as a point does."""
    points, dim = _points(spark, sf_dir)
    seeds = usable(table(spark, sf_dir, "cluster_seeds"), "seed_no", "embedding", dim)
    named = lambda df, kind: df.select(F.concat(F.lit(kind), F.col("id").cast("string")).alias("id"), "v")
    found = members(cut_lineage(named(points, "p").unionByName(named(seeds, "s"))), dim)
    of = lambda kind: found.where(F.startswith("id", F.lit(kind))).select(F.substr("id", F.lit(2)).alias("id"), "cluster")
    number = seeds.schema["id"].dataType
    return of("p").join(of("s").select(F.col("id").cast(number).alias("seed_no"), "cluster"), "cluster").select("seed_no", "id").distinct()


def p7_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every cluster with the number of its points and its most typical members, the largest first; -1 are the points of none."""
    points, dim = _points(spark, sf_dir)
    points = points.select(F.col("id").cast("string").alias("id"), "v")
    found = members(points, dim)
    sizes = found.groupBy("cluster").agg(F.count(F.lit(1)).alias("n_points"))
    best = Window.partitionBy("cluster").orderBy(F.desc("degree"), "id")
    typical = found.withColumn("r", F.row_number().over(best)).where(f"r <= {TYPICAL}").groupBy("cluster").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", "id"))), lambda x: x["id"]), ",").alias("typical_ids"))
    ranked = sizes.join(typical, "cluster").withColumn("rank", (F.row_number().over(Window.orderBy(F.desc("n_points"), "typical_ids")) - 1).cast("int"))  # a row per cluster
    inside = found.count()
    rest = points.agg((F.count(F.lit(1)) - inside).alias("n_points")).select(F.lit(-1).alias("cluster"), "n_points", F.lit(None).cast("string").alias("typical_ids"))
    return ranked.select(F.col("rank").alias("cluster"), "n_points", "typical_ids").unionByName(rest)


QUERIES = {"p7_found": p7_found, "p7_clusters": p7_clusters}

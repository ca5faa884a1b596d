"""Low-dimensional layouts after McInnes, Healy, Melville 2018, their metrics, the sweep and the choice.

The nearest neighbours of every row are found exactly, group by group over the tasks; a layout of all rows then
runs in one task per candidate, the candidates side by side. The vectors travel to the tasks as one broadcast
table of 4 or 8 bytes a number as they came, which with the neighbours bounds the rows by the memory of a task.
"""

from __future__ import annotations

import re
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxmill.operators.density import cluster
from voxmill.session import cut_lineage

#: Rows of a task's group of the neighbour search, rows that meet others at once, rows they meet at once, near rows held unmeasured.
GROUP_ROWS, BLOCK_ROWS, MEET_ROWS, HELD_ROWS = 2_048, 512, 1_024, 50_000
#: Cells of the neighbour search, rows from which there are cells, rows that place their centres; they bear on its time only.
CELLS, CELL_FROM, CENTRE_ROWS = 64, 8_192, 20_000
#: Edges of a layout moved at once in memory.
EDGE_ROWS, MOVED_ROWS = 250_000, 16_384
#: Slices of the edges, each with random numbers of its own, so that a layout is the same on any number of threads.
SLICES = 8
#: Edges for each further thread; on fewer, threads wait for one another.
THREAD_EDGES = 500_000
METRICS = "n_neighbors int, n_clusters int, n_noise_points int, n_tiny_islands int, largest_cluster_share double, spread_x double, spread_y double, bbox_area double"


def clamp_neighbors(n: int, rows: int) -> int:
    return max(2, min(n, max(2, rows - 1)))


def unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1)
    return x / np.where(norm > 0, norm, 1)[:, None]


class Cells:
    """Rows dealt to the most similar of some centres, in the cells' order.

    The cells pass over pairs of rows only by a bound that no similarity exceeds, so that what is found is exact.
    """

    def __init__(self, x: np.ndarray, dealt: tuple | None = None) -> None:
        """`dealt` is that of the same rows, where it is known."""
        n = len(x)
        norm, low = np.empty(n), np.empty(x.shape, "float32")
        for e in range(0, n, EDGE_ROWS):
            length = np.linalg.norm(x[e : e + EDGE_ROWS].astype(float), axis=1)
            norm[e : e + EDGE_ROWS] = length = np.where(length > 0, length, 1)
            low[e : e + EDGE_ROWS] = x[e : e + EDGE_ROWS] / length[:, None]
        if dealt is None:
            c = self._centres(low)
            cell, own = np.empty(n, "int32"), np.empty(n, "float32")
            for e in range(0, n, EDGE_ROWS):
                to = low[e : e + EDGE_ROWS] @ c.T
                cell[e : e + EDGE_ROWS] = to.argmax(1)
                own[e : e + EDGE_ROWS] = np.take_along_axis(to, cell[e : e + EDGE_ROWS, None], 1)[:, 0]
            order = np.lexsort((-own, cell)).astype("int32")
            dealt = c, order, cell[order], own[order]
        self.dealt = self.centres, self.order, self.cell, self.own = dealt
        self.x, self.norm, self.low = x[self.order], norm[self.order], low[self.order]
        self.starts = np.searchsorted(self.cell, np.arange(len(self.centres) + 1))

    @staticmethod
    def _centres(low: np.ndarray) -> np.ndarray:
        if len(low) < CELL_FROM:
            return low[:1]
        some = low[np.random.default_rng(0).choice(len(low), min(len(low), CENTRE_ROWS), False)]
        c = some[:1]
        for _ in range(CELLS - 1):  # far from the earlier ones, but not the farthest
            c = np.r_[c, some[[np.argsort((some @ c.T).max(1), kind="stable")[len(some) // 50]]]]
        for _ in range(10):
            at, mean = (some @ c.T).argmax(1), np.zeros_like(c)
            np.add.at(mean, at, some)
            norm = np.linalg.norm(mean, axis=1)[:, None]
            c = np.where(norm > 0, mean / np.where(norm > 0, norm, 1), c)
        return c

    def groups(self) -> list[tuple[int, int]]:
        """(first, end) of rows of one cell, at most GROUP_ROWS."""
        return [(a, min(a + GROUP_ROWS, int(e))) for s, e in zip(self.starts[:-1], self.starts[1:], strict=True) for a in range(int(s), int(e), GROUP_ROWS)]

    def nearest(self, a: int, b: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(rows, their neighbours, cosine distances) of the rows at a to b in the cells' order, as `nearest` gives them."""
        k, cell = min(k, len(self.x) - 1), int(self.cell[a])
        found = [Found(self.x, self.norm, self.low, self.order, np.arange(e, min(e + BLOCK_ROWS, b)), k) for e in range(a, b, BLOCK_ROWS)]
        for f in found:
            f.meet(np.arange(self.starts[cell], self.starts[cell + 1]))
        if len(self.centres) > 1:
            all_ = found[0].join(found[1:])
            # A similarity is at most the product along the own centre and along the other's, and that of what is left of both rows.
            left = lambda *parts: np.sqrt(np.maximum(1 - sum(p * p for p in parts), 0) + 1e-5)
            c = self.centres
            g = c @ c[cell]
            side = np.sqrt(np.maximum(1 - g * g, 1e-6))
            y1 = self.low @ c[cell]
            y2 = (self.own - g[self.cell] * y1) / side[self.cell]
            rest, rest2 = left(y1), left(y1, y2)
            apart = (np.abs(g) < 0.99)[self.cell]
            reach = np.arccos(np.clip(self.own[all_.who], -1, 1)) + np.arccos(np.clip(all_.least, -1, 1))
            rank = np.argsort(reach, kind="stable")
            found = [all_.part(rank[e : e + BLOCK_ROWS]) for e in range(0, len(rank), BLOCK_ROWS)]
            for f in found:
                u1, least = self.own[f.who], f.least.min() - 1e-5
                u2 = (self.low[f.who] @ c.T - g * u1[:, None]) / side
                along = np.maximum(u1.min() * y1, u1.max() * y1)
                use = np.flatnonzero((self.cell != cell) & (along + left(u1).max() * rest >= least))
                at = self.cell[use]
                both = along[use] + np.maximum(u2.min(0)[at] * y2[use], u2.max(0)[at] * y2[use]) + left(u1[:, None], u2).max(0)[at] * rest2[use]
                f.meet(use[(both >= least) | ~apart[use]])
        return tuple(np.concatenate(v) for v in zip(*((self.order[f.who], f.near, f.dist) for f in found), strict=True))


class Found:
    """The nearest rows so far of the rows `who` of x; `order` has the rows' numbers, to which ties go by."""

    def __init__(self, x: np.ndarray, norm: np.ndarray, low: np.ndarray, order: np.ndarray, who: np.ndarray, k: int) -> None:
        self.x, self.norm, self.low, self.order, self.who, self.k = x, norm, low, order, who, k
        self.near, self.dist = np.full((len(who), k), -1), np.full((len(who), k), np.inf)
        self.least = np.full(len(who), -np.inf, "float32")  # by which rows are passed over in single precision
        self.none = ~low[who].any(1)  # as far from all rows: nearest are the first
        if self.none.any():
            first = np.arange(k + 1)
            for r in np.flatnonzero(self.none):
                self.near[r], self.dist[r], self.least[r] = first[first != order[who[r]]][:k], 1.0, np.inf

    def join(self, others: list[Found]) -> Found:
        got = Found(self.x, self.norm, self.low, self.order, np.concatenate([f.who for f in (self, *others)]), self.k)
        got.near, got.dist, got.least, got.none = (np.concatenate([getattr(f, v) for f in (self, *others)]) for v in ("near", "dist", "least", "none"))
        return got

    def part(self, rows: np.ndarray) -> Found:
        got = Found(self.x, self.norm, self.low, self.order, self.who[rows], self.k)
        got.near, got.dist, got.least, got.none = self.near[rows], self.dist[rows], self.least[rows], self.none[rows]
        return got

    def meet(self, rows: np.ndarray) -> None:
        """The rows, none met before and in rising order, take part."""
        if not len(rows) or self.none.all():
            return
        mine, held, n = self.low[self.who], [], 0
        products = np.empty((len(mine), MEET_ROWS), "float32")
        for at in range(0, len(rows), MEET_ROWS):
            t = rows[at : at + MEET_ROWS]
            s = np.matmul(mine, self.low[t].T, out=products if len(t) == MEET_ROWS else None)
            own = np.searchsorted(t, self.who)
            is_own = np.flatnonzero(t[np.minimum(own, len(t) - 1)] == self.who)
            s[is_own, own[is_own]] = -np.inf
            if at == 0 and s.shape[1] > self.k:  # the least that can still be among the nearest
                self.least = np.maximum(self.least, np.partition(s, s.shape[1] - self.k, axis=1)[:, s.shape[1] - self.k] - np.float32(1e-5))
            least = np.maximum(self.least, np.float32(-9))
            hit = np.flatnonzero(s.max(1) >= least)
            s = s[hit]
            i, j = np.nonzero(s >= least[hit, None])
            held.append((hit[i], t[j], s[i, j]))
            n += len(i)
            if n >= HELD_ROWS:
                self._measure(held)
                held, n = [], 0
        self._measure(held)

    def _measure(self, held: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> None:
        i, j, s = (np.concatenate(v) for v in zip(*held, strict=True)) if held else (np.empty(0, int),) * 3
        if not len(i):
            return
        rank = np.lexsort((-s, i))
        last = np.flatnonzero(np.arange(len(i)) - np.searchsorted(i[rank], i[rank]) == self.k - 1)
        self.least[i[rank[last]]] = np.maximum(self.least[i[rank[last]]], s[rank[last]] - np.float32(1e-5))
        keep = s >= self.least[i]  # near ties stay until they are measured
        i, j = i[keep], j[keep]
        d, mine = np.empty(len(i)), self.x[self.who] / self.norm[self.who, None]
        for e in range(0, len(i), MEET_ROWS):
            q = j[e : e + MEET_ROWS]
            d[e : e + MEET_ROWS] = np.maximum(1 - np.einsum("ij,ij->i", mine[i[e : e + MEET_ROWS]], self.x[q] / self.norm[q, None]), 0)
        rows = np.unique(i)
        have = np.isfinite(self.dist[rows])
        i, j, d = np.r_[np.repeat(rows, have.sum(1)), i], np.r_[self.near[rows][have], self.order[j]], np.r_[self.dist[rows][have], d]
        rank = np.lexsort((j, d, i))
        i, j, d = i[rank], j[rank], d[rank]
        place = np.arange(len(i)) - np.searchsorted(i, i)
        keep = place < self.k
        i, j, d, place = i[keep], j[keep], d[keep], place[keep]
        self.near[i, place], self.dist[i, place] = j, d
        full = place == self.k - 1
        self.least[i[full]] = np.maximum(self.least[i[full]], (1 - d[full]).astype("float32") - np.float32(1e-5))


def nearest(u: np.ndarray, low: np.ndarray, a: int, b: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, cosine distances) of the k nearest other rows of rows a to b of unit vectors u, nearest first, ties to the earlier row.

    `low` holds u in single precision, by which rows are passed over; what is kept is measured in u.
    """
    f = Found(u, np.ones(len(u)), low, np.arange(len(u)), np.arange(a, b), min(k, len(u) - 1))
    f.meet(np.arange(len(u)))
    return f.near, f.dist


def all_nearest(x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, cosine distances) of the k nearest other rows of every row of x, as `nearest` gives them."""
    k, cells = min(k, len(x) - 1), Cells(x)
    near, dist = np.empty((len(x), k), "int32"), np.empty((len(x), k))
    for a, b in cells.groups():
        who, near_, dist_ = cells.nearest(a, b, k)
        near[who], dist[who] = near_, dist_
    return near, dist


def fuzzy_graph(x: np.ndarray, k: int, near: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edges (i, j, weight), i < j, of the fuzzy union of the cosine neighbourhoods; weights in (0, 1].

    `near` has the neighbours of all rows and their distances, k of each or more; without it they are searched here.
    """
    n = len(x)
    k = min(k, n - 1)
    if near is None:
        near = all_nearest(x, k)
    idx, dist = near[0][:, :k].astype(int), near[1][:, :k]
    rho = np.where(dist > 0, dist, np.inf).min(1)
    rho = np.where(np.isfinite(rho), rho, 0)
    lo, hi, target = np.zeros(n), np.full(n, 1e3), np.log2(max(k, 2))
    for _ in range(64):  # the width at which the memberships sum to the target
        mid = (lo + hi) / 2
        total = np.exp(-np.maximum(dist - rho[:, None], 0) / np.maximum(mid, 1e-12)[:, None]).sum(1)
        lo, hi = np.where(total < target, mid, lo), np.where(total < target, hi, mid)
    w = np.exp(-np.maximum(dist - rho[:, None], 0) / np.maximum((lo + hi) / 2, 1e-12)[:, None])
    i, j, v = np.repeat(np.arange(n), k), idx.ravel(), w.ravel()
    key = np.minimum(i, j) * n + np.maximum(i, j)
    u_key, inv = np.unique(key, return_inverse=True)
    none = np.ones(len(u_key))
    np.multiply.at(none, inv, 1 - v)  # a + b - ab
    return u_key // n, u_key % n, np.clip(1 - none, 1e-12, 1.0)


def layout(x: np.ndarray, n_neighbors: int, dims: int, seed: int = 42, epochs: int = 200, near: tuple[np.ndarray, np.ndarray] | None = None, threads: int = 1) -> np.ndarray:
    """Coordinates of each row: spectral-like start, then attraction along edges and sampled repulsion. Threads change nothing but the time."""
    n = len(x)
    if n <= dims + 1:
        return np.zeros((n, dims)) + np.arange(n)[:, None]
    rng = np.random.default_rng(seed)
    i, j, w = fuzzy_graph(x, clamp_neighbors(n_neighbors, n), near)
    mean = x.mean(0, dtype=float)
    _, axes = np.linalg.eigh(sum((x[e : e + EDGE_ROWS] - mean).T @ (x[e : e + EDGE_ROWS] - mean) for e in range(0, n, EDGE_ROWS)))
    axes = axes[:, ::-1][:, :dims]
    axes = axes * np.where(axes[np.abs(axes).argmax(0), np.arange(axes.shape[1])] < 0, -1, 1)  # one sign, whatever the library
    y = np.concatenate([(x[e : e + EDGE_ROWS] - mean) @ axes for e in range(0, n, EDGE_ROWS)])
    if y.shape[1] < dims:
        y = np.c_[y, np.zeros((n, dims - y.shape[1]))]
    y = np.ascontiguousarray((10 * y / max(np.abs(y).max(), 1e-12) + rng.normal(0, 1e-4, (n, dims))).T, "float32")  # a row per dimension
    a, b, least = np.float32(1.577), np.float32(0.895), np.float32(1e-12)  # the curve for a least distance of 0.1
    share = (w / w.max()).astype("float32")
    ends = np.linspace(0, len(w), SLICES + 1).astype(int)
    draws = [np.random.Generator(np.random.SFC64(s)) for s in np.random.SeedSequence(seed).spawn(SLICES)]

    def attract(s: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first ends, second ends, moves of the first) of the slice's edges that are used this time."""
        used = ends[s] + np.flatnonzero(draws[s].random(ends[s + 1] - ends[s], "float32") < share[ends[s] : ends[s + 1]])
        p_all, q_all, moves = i[used], j[used], np.empty((dims, len(used)), "float32")
        for at in range(0, len(used), MOVED_ROWS):
            p, q, to = p_all[at : at + MOVED_ROWS], q_all[at : at + MOVED_ROWS], moves[:, at : at + MOVED_ROWS]
            for t, f in zip(y, to, strict=True):
                np.subtract(t[p], t[q], out=f)
            d2 = np.maximum(np.einsum("ij,ij->j", to, to), least)  # equal points have no direction to move in
            power = np.exp(b * np.log(d2))
            to *= -2 * a * b * power / (d2 * (1 + a * power))
            np.clip(to, -4, 4, out=to)
            to *= step
        return p_all, q_all, moves

    def repel(s: int) -> list[tuple[int, np.ndarray]]:
        """(first row, moves of the rows from there on) away from five rows by chance for each used edge of the slice."""
        out = []
        for at in range(0, len(firsts[s]), MOVED_ROWS):
            p = firsts[s][at : at + MOVED_ROWS]
            far = draws[s].integers(0, n, (5, len(p)), "uint32").astype("intp")
            diff = [t[p] - t[far] for t in y]
            d2 = diff[0] * diff[0]
            for f in diff[1:]:
                d2 += f * f
            push = np.log(np.maximum(d2, least))
            push *= b
            np.exp(push, out=push)
            push *= a
            push += 1
            d2 += np.float32(0.001)
            push *= d2
            np.divide(2 * b, push, out=push)
            own = p - p[0]
            for f in diff:
                f *= push
                np.clip(f, -4, 4, out=f)
            out.append((p[0], np.stack([np.bincount(own, f.sum(0)) for f in diff]) * step))
        return out

    with ThreadPoolExecutor(min(threads, 1 + len(w) // THREAD_EDGES)) as pool:
        for e in range(epochs):
            step = np.float32(1 - e / epochs)
            firsts, seconds, moves = zip(*pool.map(attract, range(SLICES)), strict=True)
            p, q = np.concatenate(firsts), np.concatenate(seconds)
            along = lambda t, p=p, q=q, moves=moves: np.bincount(p, f := np.concatenate([m[t] for m in moves]), n) - np.bincount(q, f, n)
            for t, f in enumerate(pool.map(along, range(dims))):
                y[t] += f
            for got in list(pool.map(repel, range(SLICES))):
                for first, f in got:
                    y[:, first : first + f.shape[1]] += f
    return np.ascontiguousarray(y.T, float)


def metrics(xy: np.ndarray, n_neighbors: int) -> dict:
    """What one candidate's 2-D layout looks like; zeros for no rows."""
    if not len(xy):
        return {"n_neighbors": n_neighbors, "n_clusters": 0, "n_noise_points": 0, "n_tiny_islands": 0, "largest_cluster_share": 0.0, "spread_x": 0.0, "spread_y": 0.0, "bbox_area": 0.0}
    lab = cluster(xy, max(2, min(5, len(xy))))
    sizes = np.bincount(lab[lab >= 0]) if (lab >= 0).any() else np.empty(0, int)
    span = np.ptp(xy, axis=0)
    return {
        "n_neighbors": n_neighbors, "n_clusters": len(sizes), "n_noise_points": int((lab < 0).sum()), "n_tiny_islands": int((sizes <= 5).sum()),
        "largest_cluster_share": float(sizes.max(initial=0) / len(xy)), "spread_x": float(xy[:, 0].std()), "spread_y": float(xy[:, 1].std()), "bbox_area": float(span[0] * span[1]),
    }


def _rows(df: DataFrame, id_col: str, vec_col: str) -> tuple[np.ndarray, np.ndarray]:
    """(ids, vectors) of all rows with a vector, by id; vectors of single precision stay so."""
    kind = "array<float>" if df.schema[vec_col].dataType.simpleString() == "array<float>" else "array<double>"
    got = df.where(F.col(vec_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vec_col).cast(kind).alias("v")).toArrow()
    lists = got.column("v").combine_chunks()
    x = np.asarray(lists.flatten()).reshape(got.num_rows, -1) if got.num_rows else np.empty((0, 0))
    ids = got.column("id").to_pandas().to_numpy()
    order = np.argsort(ids, kind="stable")
    return ids[order], x[order]


def _neighbours(spark: SparkSession, shared, n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, distances) of the k nearest of all rows; the groups of the cells are searched in the tasks."""
    k = min(k, n - 1)
    held: dict = {}

    def run(it):
        for pdf in it:
            for g in pdf["id"]:
                if not held:
                    held["cells"] = Cells(shared.value, dealt.value)
                    held["groups"] = held["cells"].groups()
                who, near, dist = held["cells"].nearest(*held["groups"][g], k)
                yield pd.DataFrame({"who": [who.astype("<i4").tobytes()], "near": [near.astype("<i4").tobytes()], "dist": [dist.astype("<f8").tobytes()]})

    cells = Cells(shared.value)
    groups, dealt = cells.groups(), spark.sparkContext.broadcast(cells.dealt)
    del cells
    tasks = min(len(groups), max(4 * spark.sparkContext.defaultParallelism, len(groups) // 64))
    got = spark.range(0, len(groups), 1, tasks).mapInPandas(run, "who binary, near binary, dist binary").toArrow()
    near, dist = np.empty((n, k), "<i4"), np.empty((n, k))
    for who, near_, dist_ in zip(*(got.column(c) for c in ("who", "near", "dist")), strict=True):
        rows = np.frombuffer(who.as_buffer(), "<i4")
        near[rows], dist[rows] = np.frombuffer(near_.as_buffer(), "<i4").reshape(-1, k), np.frombuffer(dist_.as_buffer(), "<f8").reshape(-1, k)
    return near, dist


def _cores(spark: SparkSession) -> int:
    """Cores of one executor, which a task that runs alone may use."""
    sc = spark.sparkContext
    if m := re.match(r"local-cluster\[\s*\d+\s*,\s*(\d+)", sc.master):
        return int(m[1])
    return sc.defaultParallelism if sc.master.startswith("local") else int(sc.getConf().get("spark.executor.cores", "1"))


def candidates(spark: SparkSession, low: int, high: int) -> DataFrame:
    """(n_neighbors) for every number of the range, a partition each; bounds may be reversed, 2 is the least."""
    low, high = max(2, min(low, high)), max(2, low, high)
    return spark.range(low, high + 1, 1, high + 1 - low).select(F.col("id").cast("int").alias("n_neighbors"))


def project(df: DataFrame, id_col: str, vec_col: str, n_neighbors: int, dims: int, seed: int = 42) -> DataFrame:
    """(id, point): every row with a vector in `dims` dimensions, all in one layout."""
    spark, kind = df.sparkSession, df.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, point array<double>"
    ids, x = _rows(df, id_col, vec_col)
    if not len(ids):
        return spark.createDataFrame([], schema).withColumnRenamed("id", id_col)
    shared = spark.sparkContext.broadcast(x)
    near = spark.sparkContext.broadcast(_neighbours(spark, shared, len(x), clamp_neighbors(n_neighbors, len(x))) if len(x) > dims + 1 else None)
    names, threads = spark.sparkContext.broadcast(ids), _cores(spark)

    def run(it):
        for _ in it:
            y = layout(shared.value, n_neighbors, dims, seed, near=near.value, threads=threads)
            for e in range(0, len(y), 10_000):
                yield pd.DataFrame({"id": names.value[e : e + 10_000], "point": list(y[e : e + 10_000])})

    return spark.range(0, 1, 1, 1).mapInPandas(run, schema).withColumnRenamed("id", id_col)


def sweep(df: DataFrame, id_col: str, vec_col: str, low: int = 15, high: int = 25, seed: int = 42) -> DataFrame:
    """The metrics of every candidate over all rows, one row each; candidates run side by side."""
    spark = df.sparkSession
    _, x = _rows(df, id_col, vec_col)
    most = clamp_neighbors(max(2, low, high), len(x))
    shared = spark.sparkContext.broadcast(x)
    near = spark.sparkContext.broadcast(_neighbours(spark, shared, len(x), most) if len(x) > 3 else None)

    def run(it):
        for pdf in it:
            for k in pdf["n_neighbors"]:
                yield pd.DataFrame([metrics(layout(shared.value, int(k), 2, seed, near=near.value) if len(shared.value) else np.empty((0, 2)), int(k))])

    return candidates(spark, low, high).mapInPandas(run, METRICS)


def cluster_metrics(labelled: DataFrame, tiny: int = 5) -> DataFrame:
    """(n_clusters, n_noise_points, n_tiny_islands, largest_cluster, largest_cluster_share) of a table (cluster): one row; noise is -1 or null.

    The share is that of all rows. No rows give zeros.
    """
    g = labelled.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    own = F.col("cluster") >= 0
    size = F.when(own, F.col("n"))
    return g.agg(
        F.count(size).alias("n_clusters"), F.coalesce(F.sum(F.when(own, 0).otherwise(F.col("n"))), F.lit(0)).alias("n_noise_points"), F.count_if(own & (F.col("n") <= tiny)).alias("n_tiny_islands"),
        F.coalesce(F.max(size), F.lit(0)).alias("largest_cluster"), F.coalesce(F.max(size) / F.sum("n"), F.lit(0.0)).alias("largest_cluster_share"),
    )


def spread(points: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """(spread_x, spread_y, bbox_area) of a plane layout: population deviations and the area of the bounding box; nulls are passed over, no rows give zeros."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return points.agg(zero(F.stddev_pop(x)).alias("spread_x"), zero(F.stddev_pop(y)).alias("spread_y"), zero((F.max(x) - F.min(x)) * (F.max(y) - F.min(y))).alias("bbox_area"))


class Explorer:
    """Plane layouts of one table of vectors by the number of neighbours that was asked for; each is made once."""

    def __init__(self, points: DataFrame, id_col: str, vec_col: str, seed: int = 42) -> None:
        self.points, self.id_col, self.vec_col, self.seed = points, id_col, vec_col, seed
        self.made: dict[int, tuple[DataFrame, dict]] = {}

    def plane(self, n_neighbors: int) -> tuple[DataFrame, dict]:
        """((id, x, y, cluster), metrics): the layout as coordinates to be drawn, and what it looks like."""
        if n_neighbors not in self.made:
            flat = project(self.points, self.id_col, self.vec_col, n_neighbors, 2, self.seed)
            kind = flat.schema[self.id_col].dataType.simpleString()

            def run(pdf: pd.DataFrame) -> pd.DataFrame:
                pdf = pdf.sort_values("id").reset_index(drop=True)
                xy = np.stack(pdf["point"].to_numpy())
                return pd.DataFrame({"id": pdf["id"], "x": xy[:, 0], "y": xy[:, 1], "cluster": cluster(xy, max(2, min(5, len(xy))))})

            one = flat.select(F.lit(0).alias("g"), F.col(self.id_col).alias("id"), "point").groupBy("g").applyInPandas(run, f"id {kind}, x double, y double, cluster int")
            frame = cut_lineage(one)
            m = {**cluster_metrics(frame).first().asDict(), **spread(frame).first().asDict()}
            self.made[n_neighbors] = frame.withColumnRenamed("id", self.id_col), {"n_neighbors": n_neighbors, **m}
        return self.made[n_neighbors]


def choose(evaluation: DataFrame, largest_share: float = 0.6, override: int | None = None) -> int:
    """The candidate to go on with: the override, else of those without a giant cluster the one with fewest tiny islands and least noise, ties to the smaller."""
    if override is not None:
        return override
    ranked = evaluation.orderBy(F.when(F.col("largest_cluster_share") > largest_share, 1).otherwise(0), F.col("n_tiny_islands") / F.greatest("n_clusters", F.lit(1)), "n_noise_points", "n_neighbors")
    got = ranked.select("n_neighbors").first()
    if got is None:
        raise ValueError("no candidate to choose from")
    return got[0]

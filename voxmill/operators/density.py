"""Hierarchical density clustering (Campello, Moulavi, Sander 2013) over a minimum spanning tree.

With one sample per core distance the mutual reachability is the plain distance, so the hierarchy is that of
the Euclidean minimum spanning tree. Every row of a group takes part, in one task a group: up to FIT_ROWS rows
the tree grows row by row, beyond it is built by Boruvka rounds that search boxes of near rows; both give a
minimum spanning tree of all rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows up to which the tree grows row by row, in quadratic time.
FIT_ROWS = 5_000
#: Rows of a box, and near rows of each row found ahead of the rounds.
BOX_ROWS, NEAR = 64, 8


def spanning_tree(x: np.ndarray) -> np.ndarray:
    """Edges (a, b, distance) of the Euclidean minimum spanning tree, sorted; ties by the ends."""
    n = len(x)
    if n < 2:
        return np.empty((0, 3))
    best, link, left = np.full(n, np.inf), np.zeros(n, int), np.ones(n, bool)
    at, out = 0, []
    for _ in range(n - 1):
        left[at] = False
        d = np.sqrt(np.maximum(((x - x[at]) ** 2).sum(1), 0))
        closer = left & (d < best)
        best[closer], link[closer] = d[closer], at
        at = int(np.where(left, best, np.inf).argmin())
        out.append((min(at, link[at]), max(at, link[at]), best[at]))
    e = np.array(out)
    return e[np.lexsort((e[:, 1], e[:, 0], e[:, 2]))]


def boxed_tree(x: np.ndarray) -> np.ndarray:
    """The edges of spanning_tree, by Boruvka rounds over boxes; of equal trees any."""
    n = len(x)
    if n < 2:
        return np.empty((0, 3))
    order, starts = _boxes(x)
    x = x[order]
    ends = np.r_[starts[1:], n]
    lo, hi = np.minimum.reduceat(x, starts), np.maximum.reduceat(x, starts)
    box = np.repeat(np.arange(len(starts)), ends - starts)
    size = ends - starts
    rows_of = lambda boxes: np.arange(size[boxes].sum()) + np.repeat(starts[boxes] - np.r_[0, np.cumsum(size[boxes])[:-1]], size[boxes])

    def gaps(rows: np.ndarray) -> np.ndarray:
        """Least distance of the rows' own box to every box."""
        a, b = x[rows].min(0), x[rows].max(0)
        return np.sqrt((np.maximum(np.maximum(lo - b, a - hi), 0) ** 2).sum(1))

    def within(rows: np.ndarray, boxes: np.ndarray, most: np.ndarray) -> np.ndarray:
        """The boxes that come as near as its `most` to some row."""
        d = np.zeros((len(rows), len(boxes)))
        for t in range(x.shape[1]):
            at = x[rows, t][:, None]
            d += np.maximum(np.maximum(lo[boxes, t] - at, at - hi[boxes, t]), 0) ** 2
        return boxes[(np.sqrt(d) * (1 - 1e-12) <= most[:, None]).any(0)]

    def apart(rows: np.ndarray, others: np.ndarray) -> np.ndarray:
        d = np.zeros((len(rows), len(others)))
        for t in range(x.shape[1]):
            d += (x[rows, t][:, None] - x[others, t][None, :]) ** 2
        return np.sqrt(d)

    k = min(NEAR, n - 1)
    near, dist = np.zeros((n, k), int), np.full((n, k), np.inf)
    for b in range(len(starts)):
        every = np.arange(starts[b], ends[b])
        gap = gaps(every)
        todo, step = np.argsort(gap, kind="stable"), 8
        while len(todo := todo[: np.searchsorted(gap[todo], dist[every, -1].max(), "right")]):
            rows = every[dist[every, -1] >= gap[todo[0]]]
            if len(met := within(rows, todo[:step], dist[rows, -1])):
                others = rows_of(met)
                d = apart(rows, others)
                d[rows[:, None] == others[None, :]] = np.inf
                first = np.argpartition(d, min(k, d.shape[1]) - 1, axis=1)[:, :k]
                d, o = np.c_[dist[rows], np.take_along_axis(d, first, 1)], np.c_[near[rows], others[first]]
                up = np.argsort(d, axis=1, kind="stable")[:, :k]
                dist[rows], near[rows] = np.take_along_axis(d, up, 1), np.take_along_axis(o, up, 1)
            todo, step = todo[step:], 32

    part, m, out = np.arange(n), n, []
    while m > 1:
        other = part[near] != part[:, None]
        at, known = other.argmax(1), other.any(1)
        gives, to = np.where(known, dist[np.arange(n), at], np.inf), near[np.arange(n), at]
        best = np.full(m, np.inf)
        np.minimum.at(best, part, gives)
        # A row whose near rows are all in its part can still give the part's shortest edge.
        asks = np.flatnonzero(~known & (dist[:, -1] < best[part]))
        one = np.where(np.minimum.reduceat(part, starts) == np.maximum.reduceat(part, starts), part[starts], -1)
        for rows in np.split(asks, np.flatnonzero(np.diff(box[asks])) + 1) if len(asks) else ():
            gap = gaps(rows)
            own = part[rows]
            use = gap < best[own].max()
            if (own == own[0]).all():
                use &= one != own[0]
            todo = np.flatnonzero(use)
            todo, step = todo[np.argsort(gap[todo], kind="stable")], 4
            while len(todo) and len(rows := rows[best[part[rows]] > gap[todo[0]]]):
                met = within(rows, todo[:step], best[part[rows]])
                todo, step = todo[step:], 32
                if not len(met):
                    continue
                others = rows_of(met)
                d = apart(rows, others)
                d[part[rows][:, None] == part[others][None, :]] = np.inf
                first = d.argmin(1)
                d = d[np.arange(len(rows)), first]
                less = d < gives[rows]
                gives[rows[less]], to[rows[less]] = d[less], others[first[less]]
                np.minimum.at(best, part[rows], d)
        a, b = order, order[to]
        rank = np.lexsort((np.maximum(a, b), np.minimum(a, b), gives, part))
        rank = rank[np.r_[True, np.diff(part[rank]) > 0]]  # the shortest edge of each part
        rank = rank[np.argsort(gives[rank], kind="stable")]
        up = list(range(m))
        for r, c1, c2 in zip(rank.tolist(), part[rank].tolist(), part[to[rank]].tolist(), strict=True):
            while up[c1] != c1:
                up[c1] = up[up[c1]]
                c1 = up[c1]
            while up[c2] != c2:
                up[c2] = up[up[c2]]
                c2 = up[c2]
            if c1 != c2:
                up[c1] = c2
                out.append((min(a[r], b[r]), max(a[r], b[r]), gives[r]))
        root = np.array(up)
        while (root[root] != root).any():
            root = root[root]
        part = np.unique(root[part], return_inverse=True)[1]
        m = int(part.max()) + 1
    e = np.array(out, float)
    return e[np.lexsort((e[:, 1], e[:, 0], e[:, 2]))]


def _boxes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order of the rows, first row of each box): halves along the widest side down to BOX_ROWS rows."""
    todo, parts = [np.arange(len(x))], []
    while todo:
        rows = todo.pop()
        if len(rows) <= BOX_ROWS:
            parts.append(rows)
            continue
        side, half = int(np.ptp(x[rows], axis=0).argmax()), len(rows) // 2
        cut = np.argpartition(x[rows, side], half)
        todo += [rows[cut[half:]], rows[cut[:half]]]
    return np.concatenate(parts), np.cumsum([0, *(len(r) for r in parts[:-1])])


def cluster(x: np.ndarray, min_size: int, allow_single: bool = False, dense_rows: int = FIT_ROWS) -> np.ndarray:
    """Label of each row, -1 for noise; clusters are numbered by size, then by their first row."""
    n = len(x)
    if n == 0:
        return np.empty(0, int)
    min_size = max(2, min(min_size, n))
    up, size, kids, height = list(range(2 * n - 1)), [1] * n + [0] * (n - 1), {}, {}

    def top(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    node = n
    for a, b, d in (spanning_tree(x) if n <= dense_rows else boxed_tree(x)):
        a, b = top(int(a)), top(int(b))
        up[a] = up[b] = node
        size[node], kids[node], height[node] = size[a] + size[b], (a, b), d
        node += 1
    root = node - 1
    if n == 1:
        return np.array([-1])

    def leaves(i: int) -> list[int]:
        out, todo = [], [i]
        while todo:
            j = todo.pop()
            todo.extend(kids[j]) if j >= n else out.append(j)
        return out

    # Condense: a cluster lives on while only one side of a split is large enough.
    inverse = lambda d: 1.0 / max(d, 1e-12)
    members: dict[int, list[tuple[int, float]]] = {0: []}
    birth, parent, children = {0: 0.0}, {0: None}, {0: []}
    todo, fresh = [(root, 0)], 1
    while todo:
        i, c = todo.pop()
        if i < n:
            members[c].append((i, inverse(0.0)))
            continue
        lam = inverse(height[i])
        big = [k for k in kids[i] if size[k] >= min_size]
        if len(big) == 2:
            for k in kids[i]:
                birth[fresh], parent[fresh], children[fresh], members[fresh] = lam, c, [], []
                children[c].append(fresh)
                todo.append((k, fresh))
                fresh += 1
        else:
            for k in kids[i]:
                if k in big:
                    todo.append((k, c))
                else:
                    members[c].extend((j, lam) for j in leaves(k))
    # Excess of mass: a cluster wins over its descendants if it is the more stable.
    whole = {}
    for c in sorted(members, reverse=True):
        whole[c] = len(members[c]) + sum(whole[k] for k in children[c])
    stable = {c: sum(lam - birth[c] for _, lam in members[c]) + sum((birth[k] - birth[c]) * whole[k] for k in children[c]) for c in members}
    won: dict[int, bool] = {}
    for c in sorted(members, reverse=True):
        inner = sum(stable[k] for k in children[c])
        won[c] = (c != 0 or allow_single) and (not children[c] or stable[c] >= inner)
        if not won[c]:
            stable[c] = inner
    label, chosen, todo2 = np.full(n, -1), [], [0]
    while todo2:
        c = todo2.pop()
        if won[c]:
            got, inner = [], [c]
            while inner:
                k = inner.pop()
                got += [j for j, _ in members[k]]
                inner += children[k]
            chosen.append(sorted(got))
        else:
            todo2 += children[c]
    for k, rows in enumerate(sorted(chosen, key=lambda r: (-len(r), r[0]))):
        label[rows] = k
    return label


def hdbscan(df: DataFrame, id_col: str, vec_col: str, min_cluster_size: int = 10, group: str | None = None, fit_rows: int = FIT_ROWS) -> DataFrame:
    """(group, id, cluster) of every row with a vector, within each group or over all rows (group 0).

    `fit_rows` only says from where on boxes are searched; all rows are clustered at any size.
    """
    g = F.col(group) if group else F.lit(0)
    src = df.where(F.col(vec_col).isNotNull()).select(g.alias("g"), F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    kinds = {f.name: f.dataType.simpleString() for f in src.schema}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id").reset_index(drop=True)
        pdf["cluster"] = cluster(np.stack(pdf["v"].to_numpy()).astype(float), min_cluster_size, dense_rows=fit_rows)
        return pdf[["g", "id", "cluster"]]

    done = src.groupBy("g").applyInPandas(run, f"g {kinds['g']}, id {kinds['id']}, cluster int")
    return done.select(F.col("g").alias(group or "group"), F.col("id").alias(id_col), "cluster")


def predict(new: DataFrame, clustered: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, cluster, similarity): for each new vector the cluster of the most similar row of `clustered` (id, vector, cluster).

    Null and zero vectors have no row; an id may stand on both sides only with the same vector.
    """
    from voxmill.operators.vectors import knn

    best = knn(clustered, 1, id_col, vec_col, queries=new)
    return best.join(clustered.select(F.col(id_col).alias("neighbour"), "cluster"), "neighbour").select(F.col("id").alias(id_col), "cluster", "similarity")

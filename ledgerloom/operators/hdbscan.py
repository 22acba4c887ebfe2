"""Hierarchical density clustering of groups of vectors of any size, exactly: numpy per block, trees merged by Spark."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import Scratch
from .order import numbered_rows

#: Vectors of one block; a task holds two blocks, and the same result comes out whatever the number.
BLOCK = 5_000
#: Vectors of a group whose tree one task finds among their nearest ones; and of a block, neighbours and blocks at least for that.
TASK_VECTORS, NEAR_BLOCK, NEAR, NEAR_BLOCKS, LEAST_BLOCK = 500_000, 25_000, 8, 6, 2_000
#: Distances that near_tree looks at together.
AT_ONCE = 4_000_000


def nearest_distances(x: np.ndarray, y: np.ndarray, k: int) -> np.ndarray:
    """The k smallest distances from each row of x to rows of y, all of them if there are fewer, in ascending order.

    Products of matrices find a short list; where their rounding might hide one of the k, all distances are taken.
    """
    k, short, sq = min(k, len(y)), min(k + 16, len(y)), (y**2).sum(1)
    doubt = 64 * np.finfo(float).eps * (float((x**2).sum(1).max(initial=0)) + float(sq.max(initial=0)))
    exact = lambda a, b: np.sort(np.sqrt(((a[:, None, :] - b) ** 2).sum(2)), axis=1)[:, :k]
    out = np.empty((len(x), k))
    for i in range(0, len(x), 512):
        some = x[i : i + 512]
        product = (some**2).sum(1)[:, None] + sq[None, :] - 2 * some @ y.T
        at = np.argpartition(product, short - 1, axis=1)[:, :short]
        near = np.sort(np.take_along_axis(product, at, 1), axis=1)
        out[i : i + 512] = exact(some, y[at])
        for r in np.flatnonzero(~(near[:, -1] > near[:, k - 1] + doubt) & ~(out[i : i + 512, -1] == 0)) if short < len(y) else ():
            out[i + r] = exact(some[r : r + 1], y[None])[0]
    return out


def core_distances(x: np.ndarray, k: int) -> np.ndarray:
    return nearest_distances(x, x, k).max(1)


class _Fringe:
    """Points outside the tree in the first m places, each with its best edge into it."""

    def __init__(self, x: np.ndarray, core: np.ndarray, ids: np.ndarray):
        self.x, self.core, self.ids, self.m = x.T.copy(), core.copy(), ids.copy(), len(ids)
        self.best, self.near = np.full(self.m, np.inf), np.full(self.m, np.iinfo(np.int64).max)

    def take(self, k: int) -> tuple[np.ndarray, float, int]:
        point, core, name, last = self.x[:, k].copy(), self.core[k], int(self.ids[k]), self.m - 1
        self.x[:, k] = self.x[:, last]
        for column in (self.core, self.ids, self.best, self.near):
            column[k] = column[last]
        self.m = last
        return point, core, name

    def reach(self, point: np.ndarray, core: float, name: int) -> None:
        m = self.m
        d = self.x[:, : max(m, 2)] - point[:, None]  # one column alone would be added in another order
        d *= d
        d = np.maximum(np.maximum(np.sqrt(d.sum(0)[:m]), self.core[:m]), core)
        d[np.isnan(d)] = np.inf
        closer = (d < self.best[:m]) | ((d == self.best[:m]) & (name < self.near[:m]))
        self.best[:m][closer], self.near[:m][closer] = d[closer], name

    def first(self) -> tuple[float, int, int, int]:
        """(distance, smaller id, larger id, place) of the least edge."""
        low = self.best[: self.m].min()
        at = np.flatnonzero(self.best[: self.m] == low)
        a, b = np.minimum(self.near[at], self.ids[at]), np.maximum(self.near[at], self.ids[at])
        k = np.lexsort((b, a))[0] if len(at) > 1 else 0
        return float(low), int(a[k]), int(b[k]), int(at[k])


def spanning_tree(x: np.ndarray, core: np.ndarray, ids: np.ndarray | None = None, left: int = 0) -> np.ndarray:
    """(a, b, distance) rows of the minimum spanning tree of mutual reachability, by Prim's way; a < b are ids.

    With left, only edges between the first `left` rows and the others count. Equal distances go by (a, b), so that the
    tree is the only one of its points and trees of parts can be merged.
    """
    ids = np.arange(len(x)) if ids is None else ids
    sides = [_Fringe(x[s], core[s], ids[s]) for s in ((slice(0, left), slice(left, None)) if left else (slice(None),))]
    now, side, rows = sides[0].take(0), 0, []
    for _ in range(len(x) - 1):
        other = sides[len(sides) - 1 - side]
        if other.m:
            other.reach(*now)
        (d, a, b, k), side = min((s.first(), i) for i, s in enumerate(sides) if s.m)
        rows.append((a, b, d))
        now = sides[side].take(k)
    return np.array(rows, float).reshape(-1, 3)


def forest(edges: np.ndarray) -> np.ndarray:
    """The rows (a, b, distance) that are in the minimum spanning forest, in the order of (distance, a, b)."""
    edges = edges[np.lexsort((edges[:, 1], edges[:, 0], edges[:, 2]))]
    names, ends = np.unique(edges[:, :2].astype(np.int64), return_inverse=True)
    parent, keep = list(range(len(names))), []
    for k, (a, b) in enumerate(ends.reshape(-1, 2).tolist()):
        while parent[a] != a:
            parent[a] = a = parent[parent[a]]
        while parent[b] != b:
            parent[b] = b = parent[parent[b]]
        if a != b:
            parent[a] = b
            keep.append(k)
    return edges[keep]


def leaf_clusters(tree: np.ndarray, n: int, least: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(label, probability) of each point from the leaves of the condensed tree; -1 and 0 for noise.

    A branch of fewer than `least` points falls out of its parent. Leaves are the branches that never split again; one
    with more than `most` points is noise. A point's probability is its density over the densest of its leaf.
    """
    order = np.lexsort((tree[:, 1], tree[:, 0], tree[:, 2]))
    parent, left, right, height, size = list(range(2 * n - 1)), {}, {}, {}, [1] * n + [0] * (n - 1)

    def find(v: int) -> int:
        while parent[v] != v:
            parent[v] = parent[parent[v]]
            v = parent[v]
        return v

    for k, e in enumerate(order):
        a, b = find(int(tree[e, 0])), find(int(tree[e, 1]))
        node = n + k
        left[node], right[node], height[node], size[node] = a, b, float(tree[e, 2]), size[a] + size[b]
        parent[a] = parent[b] = node
    label, prob = np.full(n, -1), np.zeros(n)
    if n < least:
        return label, prob

    def points(node: int) -> list[int]:
        out, todo = [], [node]
        while todo:
            v = todo.pop()
            if v < n:
                out.append(v)
            else:
                todo += [left[v], right[v]]
        return out

    density = lambda node: 1 / height[node] if height[node] > 0 else np.inf
    leaves = []
    todo = [(2 * n - 2, [], False)]
    while todo:
        node, fell, split = todo.pop()
        while True:
            if node < n:
                fell.append((node, fell[-1][1] if fell else np.inf))
                leaves.append((fell, split))
                break
            a, b = left[node], right[node]
            big = [c for c in (a, b) if size[c] >= least]
            if len(big) == 2:
                todo += [(a, [], True), (b, [], True)]
                break
            small = [c for c in (a, b) if size[c] < least]
            fell += [(p, density(node)) for c in small for p in points(c)]
            if not big:
                leaves.append((fell, split))
                break
            node = big[0]
    k = 0
    for members, _ in sorted((m for m in leaves if m[1]), key=lambda m: min(p for p, _ in m[0])):
        if len(members) > most:
            continue
        finite = [d for _, d in members if np.isfinite(d)]
        peak = max(finite) if finite else np.inf
        for p, d in members:
            label[p] = k
            prob[p] = 1.0 if not np.isfinite(d) or not np.isfinite(peak) or peak == 0 else min(1.0, d / peak)
        k += 1
    return label, prob


def cluster(x: np.ndarray, least: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    if len(x) < least:
        return np.full(len(x), -1), np.zeros(len(x))
    return leaf_clusters(spanning_tree(x, core_distances(x, least)), len(x), least, most)


class _Squares:
    """Squared distances between rows by products of matrices, right within `doubt`."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        middle = y.mean(0)
        x, y = x - middle, y - middle
        a, b = (x**2).sum(1), (y**2).sum(1)
        self.left = np.column_stack([x, a, np.ones(len(x))])
        self.right = np.column_stack([-2 * y, np.ones(len(y)), b]).T.copy()
        self.doubt = 64 * np.finfo(float).eps * (float(a.max(initial=0)) + float(b.max(initial=0)))

    def of(self, rows, columns=slice(None)) -> np.ndarray:
        return self.left[rows] @ self.right[:, columns]


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(((a - b) ** 2).sum(-1))


def _lengths(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """_exact with its terms added one after the other, as a tree's distances are, so that ties are the same ones."""
    d = (a - b) ** 2
    total = d[:, 0].copy()
    for k in range(1, d.shape[1]):
        total += d[:, k]
    return np.sqrt(total)


def nearest_rows(x: np.ndarray, y: np.ndarray, k: int, same: bool = False, rows: int = 64, columns: int = 4_096) -> tuple[np.ndarray, ...]:
    """(row of x, row of y, distance) of the k nearest rows of y to each row of x, in that order; with same, y is x, and a row is
    not near itself. Some rows of y give a bound on the k-th distance, under which the others are taken."""
    squares, out = _Squares(x, y), []
    some = np.linspace(0, len(y) - 1, min(max(columns // 2, k + 1), len(y))).astype(int)
    kth, near = min(k + same, len(some)) - 1, np.ascontiguousarray(squares.right[:, some])
    for i in range(0, len(x), rows):
        here = slice(i, min(i + rows, len(x)))
        bound = np.partition(squares.left[here] @ near, kth, axis=1)[:, kth, None] + 2 * squares.doubt
        found = []
        for j in range(0, len(y), columns):
            below = squares.of(here, slice(j, j + columns)) <= bound
            r, c = np.divmod(np.flatnonzero(below), below.shape[1])
            r, c = r + i, c + j
            if same:
                r, c = r[r != c], c[r != c]
            found.append((r, c, _exact(x[r], y[c])))
        r, c, d = (np.concatenate(column) for column in zip(*found))
        order = np.lexsort((c, d, r))
        r, c, d = r[order], c[order], d[order]
        first = np.arange(len(r)) - np.searchsorted(r, r) < k
        out.append((r[first], c[first], d[first]))
    return tuple(np.concatenate(column) for column in zip(*out))


class _Merges:
    """The merges of a forest's rows: leaves in the order in which no branch is torn apart, and the height between neighbours."""

    def __init__(self, edges: np.ndarray, n: int):
        parent, first, last, size = list(range(n)), list(range(n)), list(range(n)), [1] * n
        after, height, self.root = [-1] * n, [np.inf] * n, 0

        def find(v: int) -> int:
            while parent[v] != v:
                parent[v] = parent[parent[v]]
                v = parent[v]
            return v

        for k, (a, b, d) in enumerate(edges.tolist()):
            a, b = find(int(a)), find(int(b))
            if size[a] < size[b]:
                a, b = b, a
            after[last[a]], height[last[a]] = first[b], d
            last[a], parent[b], size[a] = last[b], a, size[a] + size[b]
            if k == len(edges) // 2:
                self.root = max(range(n), key=lambda v: size[v] if parent[v] == v else 0)
        self.part = np.array([find(v) for v in range(n)])
        self.order, gaps = [], []
        for v in range(n):
            if parent[v] == v:
                v = first[v]
                while v >= 0:
                    self.order.append(v)
                    gaps.append(height[v])
                    v = after[v]
        self.order, self.gaps = np.array(self.order), np.array(gaps)[:-1]
        self.place = np.empty(n, int)
        self.place[self.order] = np.arange(n)

    def heights(self, v: int) -> np.ndarray:
        """The height at which v and each leaf, in their order, are joined; 0 for v itself."""
        at = self.place[v]
        return np.concatenate(
            [np.maximum.accumulate(self.gaps[:at][::-1])[::-1], [0.0], np.maximum.accumulate(self.gaps[at:])]
        )


def near_tree(x: np.ndarray, near: np.ndarray, distance: np.ndarray, least: int) -> np.ndarray:
    """spanning_tree of x with its core distances, from each row's nearest rows and their distances (padded with -1 and inf).

    A row's list has all that is nearer than its last one. An edge in no list is no nearer than both last ones, and is of
    no use if its ends are joined below that, so only rows whose way to the root rises to their last distance or above may
    lack edges. These are compared with all rows, and edges that are not longer than the way between their ends go on.
    Before that, parts that the lists leave apart are joined by the least edges that leave them, round by round.
    """
    n, k = near.shape
    none = near < 0
    core = np.column_stack([np.zeros(n), np.where(none, 0.0, distance)])[:, : min(least, n)].max(1)
    reach = np.where(none[:, -1], np.inf, distance[:, -1])

    def rows(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.column_stack([np.minimum(a, b), np.maximum(a, b), np.maximum(np.maximum(core[a], core[b]), _lengths(x[a], x[b]))])

    a = np.repeat(np.arange(n), k)[~none.ravel()]
    edges = forest(rows(a, near[~none]))
    merges, squares, step = _Merges(edges, n), _Squares(x, x), max(1, AT_ONCE // n)
    while len(edges) < n - 1:
        largest, more = np.bincount(merges.part).argmax(), {}
        away = np.flatnonzero(merges.part != largest)
        for i in range(0, len(away), step):
            some = away[i : i + step]
            w = np.maximum(np.maximum(squares.of(some), (core**2)[None]), (core[some] ** 2)[:, None])
            w[merges.part[some][:, None] == merges.part[None]] = np.inf
            r, b = np.nonzero(w <= w.min(1, keepdims=True) + 2 * squares.doubt)
            r, b = r[np.isfinite(w[r, b])], b[np.isfinite(w[r, b])]
            for lo, hi, d in rows(some[r], b).tolist():
                for part in {merges.part[int(lo)], merges.part[int(hi)]} - {largest}:
                    more[part] = min(more.get(part, (np.inf, n, n)), (d, lo, hi))
        edges = forest(np.concatenate([edges, [(lo, hi, d) for d, lo, hi in more.values()]]))
        merges = _Merges(edges, n)
    ways = np.empty(n)
    ways[merges.order] = merges.heights(merges.root)
    doubtful, by_order, found = np.flatnonzero(ways >= reach * (1 - 1e-12)), core[merges.order], [edges]
    for i in range(0, len(doubtful), step):
        some = doubtful[i : i + step]
        for v, square in zip(some.tolist(), squares.of(some)):
            way = merges.heights(v)
            b = merges.order[(square[merges.order] - 2 * squares.doubt <= way**2) & (by_order <= way) & (core[v] <= way)]
            b = b[b != v]
            lacking = rows(np.full(len(b), v), b)
            found.append(lacking[lacking[:, 2] <= way[merges.place[b]]])
    return forest(np.concatenate(found))


def _edges(table: pa.Table) -> np.ndarray:
    return np.column_stack([table[c].to_numpy(zero_copy_only=False).astype(float) for c in ("a", "b", "d")])


def hdbscan(
    vectors: DataFrame, group: str, item: str, vector: str, least: int = 3, most: int = 500, block: int = BLOCK, task_vectors: int = TASK_VECTORS
) -> DataFrame:
    """(group, item, label, prob) of every vector that is not null, label -1 for noise; groups are clustered apart.

    A group is divided into blocks, and every two blocks meet in one task, where each vector finds its nearest ones. With
    groups of at most task_vectors, one task per group then reads the spanning tree off these (near_tree). In larger
    groups core distances come first, and every two blocks of at most `block` vectors give the least tree of the edges
    between both; the trees hold the group's spanning tree and are merged four at a time. The condensed tree is read by
    one task per group. Both ways find the same tree. Work is quadratic in a group, by products of matrices in the first
    way, and the copies of a vector are as many as its blocks; memory is two blocks, and linear in the group for the first
    way, the last merge and the condensed tree.
    """
    scratch = Scratch(vectors.sparkSession, "hdbscan")
    some = vectors.where(F.col(vector).isNotNull()).select(
        group, item, F.col(vector).cast("array<double>").alias("_x"), F.to_json(F.struct(F.col(group).alias("g"))).alias("_g")
    )
    equal = Window.partitionBy("_g", "_x")
    rows = numbered_rows(some, [F.col("_g"), F.col(item)], scratch, "_n").withColumns(
        {"_copy": F.row_number().over(equal.orderBy("_n")), "_same": F.min("_n").over(equal)}
    )
    rows = scratch.write(rows, "rows")
    sizes = scratch.write(rows.groupBy("_g").agg(F.min("_n").alias("_from"), F.count("*").alias("_count")), "sizes")
    in_task = (sizes.agg(F.max("_count")).first()[0] or 0) <= task_vectors
    if in_task:
        blocks = F.greatest(
            F.ceil(F.col("_count") / F.lit(max(block, NEAR_BLOCK) if block == BLOCK else block)),
            F.least(F.lit(NEAR_BLOCKS), F.ceil(F.col("_count") / F.lit(LEAST_BLOCK)))
        )
        sizes = sizes.withColumn("_blocks", blocks.cast("int")).withColumn("_long", F.ceil(F.col("_count") / F.col("_blocks")))
    else:
        sizes = sizes.withColumn("_blocks", F.ceil(F.col("_count") / F.lit(block)).cast("int")).withColumn("_long", F.lit(block))
    rounds = (sizes.agg(F.max("_blocks")).first()[0] or 1) - 1
    placed = rows.where(F.col("_copy") <= least if in_task else F.lit(True)).select("_g", "_n", "_x").join(sizes, "_g").withColumn(
        "_i", F.floor((F.col("_n") - F.col("_from")) / F.col("_long")).cast("int")
    ).drop("_count", "_long")

    def pairs(df: DataFrame):
        each = df.withColumn("_j", F.explode(F.expr("sequence(0, _blocks - 1)"))).withColumn("_right", F.col("_i") > F.col("_j"))
        return each.withColumns({"_i": F.least("_i", "_j"), "_j": F.greatest("_i", "_j")}).select(
            "_g", "_i", "_j", "_n", "_right", *(c for c in df.columns if c in ("_x", "_core"))
        ).groupBy("_g", "_i", "_j")

    def halves(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        table = table.sort_by([("_right", "ascending"), ("_n", "ascending")])
        x = table["_x"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(table), -1)
        left = 0 if table["_i"][0].as_py() == table["_j"][0].as_py() else len(table) - int(
            table["_right"].to_numpy(zero_copy_only=False).sum()
        )
        core = table["_core"].to_numpy(zero_copy_only=False) if "_core" in table.column_names else np.zeros(0)
        return x, core, table["_n"].to_numpy(zero_copy_only=False), left

    def nearest(table: pa.Table) -> pa.Table:
        x, _, n, left = halves(table)
        parts = [(x[:left], x[left:], n[:left]), (x[left:], x[:left], n[left:])] if left else [(x, x, n)]
        near = [(names, nearest_distances(a, b, least)) for a, b, names in parts]
        return pa.table(
            {"_n": np.concatenate([np.repeat(m, d.shape[1]) for m, d in near]), "d": np.concatenate([d.ravel() for _, d in near])}
        )

    def tree(table: pa.Table) -> pa.Table:
        x, core, n, left = halves(table)
        e = spanning_tree(x, core, n, left)
        return _table(table, e)

    def _table(table: pa.Table, e: np.ndarray) -> pa.Table:
        first = {c: pa.array([table[c][0].as_py()] * len(e), table.schema.field(c).type) for c in ("_g", "_i", "_j")}
        return pa.table(first | {"a": e[:, 0].astype(np.int64), "b": e[:, 1].astype(np.int64), "d": e[:, 2]})

    def merged(table: pa.Table) -> pa.Table:
        return _table(table, forest(_edges(table)))

    def labels(table: pa.Table) -> pa.Table:
        e = _edges(table)
        names, ends = np.unique(e[:, :2].astype(np.int64), return_inverse=True)
        label, prob = leaf_clusters(np.column_stack([ends.reshape(-1, 2), e[:, 2]]), len(names), least, most)
        return pa.table({"_n": names, "label": pa.array(label, pa.int32()), "prob": prob})

    def lists(table: pa.Table) -> pa.Table:
        x, _, n, left = halves(table)
        finite = np.isfinite(x).all(1)
        one, x, n, left = not left, x[finite], n[finite], int(finite[:left].sum())
        parts = [(x[:left], x[left:], n[:left], n[left:]), (x[left:], x[:left], n[left:], n[:left])]
        parts = [(x, x, n, n)] if one else parts
        found = [
            (a_n[r], b_n[c], d)
            for a, b, a_n, b_n in parts
            if len(a) and len(b)
            for r, c, d in [nearest_rows(a, b, max(NEAR, least), one)]
        ] or [(n[:0], n[:0], np.zeros(0))]
        owner, m, d = (np.concatenate(column) for column in zip(*found))
        names, start = np.unique(owner, return_index=True)
        entries = pa.StructArray.from_arrays([pa.array(d), pa.array(m)], names=["d", "m"])
        ends = pa.array(np.append(start, len(owner)).astype(np.int32))
        return pa.table({"_n": names, "near": pa.ListArray.from_arrays(ends, entries)})

    def read(table: pa.Table) -> pa.Table:
        table = table.sort_by("_n")
        x, n = table["_x"].combine_chunks().flatten().to_numpy().reshape(len(table), -1), table["_n"].to_numpy()
        same, k = np.searchsorted(n, table["_same"].to_numpy()), max(NEAR, least)
        finite, copy = np.isfinite(x).all(1), table["_copy"].to_numpy() > least
        kept, further, odd = np.flatnonzero(finite & ~copy), np.flatnonzero(finite & copy), np.flatnonzero(~finite)
        near = table["near"].combine_chunks().take(pa.array(kept))
        filled = np.arange(k) < np.diff(near.offsets.to_numpy())[:, None]
        at, d, entries = np.full(filled.shape, -1), np.full(filled.shape, np.inf), near.flatten()
        at[filled], d[filled] = np.searchsorted(n[kept], entries.field("m").to_numpy()), entries.field("d").to_numpy()
        if len(n) < least:
            return pa.table({"_n": n, "label": pa.array(np.full(len(n), -1), pa.int32()), "prob": np.zeros(len(n))})
        tree = near_tree(x[kept], at, d, least) if len(kept) else np.zeros((0, 3))
        # equal vectors beyond those that a core distance can need hang on the first one; vectors without distances on the first row
        rest = odd[odd > 0] if finite[0] else np.concatenate([odd[1:], kept[:1]])
        stars = [np.column_stack([same[further], further, np.zeros(len(further))]), np.column_stack([0 * rest, rest, rest + np.inf])]
        edges = np.concatenate([np.column_stack([kept[tree[:, :2].astype(int)], tree[:, 2]]), *stars])
        label, prob = leaf_clusters(edges, len(n), least, most)
        return pa.table({"_n": n, "label": pa.array(label, pa.int32()), "prob": prob})

    def together(found: DataFrame) -> DataFrame:
        return rows.join(found, "_n", "left").select(
            group, item, F.coalesce("label", F.lit(-1)).alias("label"), F.coalesce("prob", F.lit(0.0)).alias("prob")
        )

    if in_task:
        each = pairs(placed).applyInArrow(lists, "_n bigint, near array<struct<d:double,m:bigint>>")
        near = scratch.write(
            each.groupBy("_n").agg(F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, max(NEAR, least)).alias("near")), "near"
        )
        whole = rows.select("_g", "_n", "_x", "_copy", "_same").join(near, "_n", "left").withColumn(
            "near", F.coalesce("near", F.array().cast("array<struct<d:double,m:bigint>>"))
        )
        return together(whole.groupBy("_g").applyInArrow(read, "_n bigint, label int, prob double"))
    near = pairs(placed).applyInArrow(nearest, "_n bigint, d double")
    core = near.groupBy("_n").agg(
        F.slice(F.array_sort(F.collect_list("d")), 1, least).alias("d")
    ).select("_n", F.element_at("d", -1).alias("_core"))
    ddl = "_g string, _i int, _j int, a bigint, b bigint, d double"
    trees = scratch.write(pairs(scratch.write(placed.join(core, "_n"), "core")).applyInArrow(tree, ddl), "trees")
    for _ in range(rounds.bit_length()):
        trees = trees.withColumns({c: F.shiftright(c, 1) for c in ("_i", "_j")}).groupBy("_g", "_i", "_j").applyInArrow(merged, ddl)
    return together(trees.groupBy("_g").applyInArrow(labels, "_n bigint, label int, prob double"))

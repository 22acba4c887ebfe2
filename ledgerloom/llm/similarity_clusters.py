"""Clusters of mutually similar vectors: density clustering over spatial cells with overlapping margins."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Scratch
from .components import components

#: Vectors of one kind that the balls and the grid are fitted on, at most.
SAMPLE = 8_000
#: Rows of each side of one block of comparisons.
BLOCK = 4_000
#: What it costs to copy a row into one more cell, in comparisons; copies that are worked out at a time.
COPY_COST, COPIES_AT_ONCE = 500, 500_000
_SLACK = 1e-9


@dataclass
class Space:
    """How one kind's vectors are divided: dense balls around pivots, and a grid over reduced vectors for the rest."""

    similarity: float
    pivots: np.ndarray
    mean: np.ndarray
    axes: np.ndarray
    dimensions: int = 0

    @property
    def angle(self) -> float:
        return math.acos(min(1.0, self.similarity))

    @property
    def reach(self) -> float:
        """The chord of the angle: what two similar unit vectors are apart at most, before and after the reduction."""
        return math.sqrt(max(0.0, 2 - 2 * self.similarity)) + _SLACK

    @property
    def radix(self) -> int:
        """Different cell numbers of one dimension: coordinates lie within 2 of the mean, and margins one cell further."""
        return 2 * math.ceil(1 / self.reach) + 5

    @property
    def deepest(self) -> int:
        """Dimensions whose cell numbers fit into one number."""
        return min(len(self.axes), int(62 / math.log2(self.radix)))

    def balls(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(home ball or -1 of each unit vector, offsets and numbers of the balls in whose margin it lies).

        A home ball's vectors are within half the angle of its pivot, so that any two of them are similar. Whatever is
        similar to one of them is within one and a half angles of the pivot.
        """
        if not len(self.pivots):
            return np.full(len(x), -1), np.zeros(len(x) + 1, np.int64), np.zeros(0, np.int64)
        cos = x @ self.pivots.T
        home = cos.argmax(1)
        home[cos[np.arange(len(x)), home] < math.cos(self.angle / 2) + _SLACK] = -1
        near = cos >= math.cos(min(math.pi, 1.5 * self.angle)) - _SLACK
        near[np.flatnonzero(home >= 0), home[home >= 0]] = False
        return home, np.r_[0, near.sum(1).cumsum()], near.nonzero()[1]

    def coordinates(self, x: np.ndarray) -> np.ndarray:
        """Reduced coordinates in units of a cell, which is twice the reach wide."""
        return (x - self.mean) @ self.axes.T / (2 * self.reach)

    def cells(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(home cell of each vector, offsets and numbers of the cells in whose margin it lies), by reduced coordinates.

        Half a cell is the reach, so that in each dimension only the nearer neighbour can be within it. A vector is copied to
        a cell if the distances in all dimensions together are within reach: dimension by dimension, each copy goes on
        as it is and, where that is still within reach, with one more step.
        """
        k = self.dimensions
        z = self.coordinates(x)[:, :k]
        cell = np.floor(z)
        inside = z - cell
        step = np.where(inside < 0.5, -1, 1)
        gap = (np.where(inside < 0.5, inside, 1 - inside) * 2 * self.reach) ** 2
        power = self.radix ** np.arange(k, dtype=np.int64)
        home = ((cell.astype(np.int64) + self.radix // 2) * power).sum(1)
        rows, at, far = np.arange(len(x)), home.copy(), np.zeros(len(x))
        for d in range(k):
            more = np.flatnonzero(far + gap[rows, d] <= self.reach**2)
            own = rows[more]
            rows, at, far = np.r_[rows, own], np.r_[at, at[more] + step[own, d] * power[d]], np.r_[far, far[more] + gap[own, d]]
        rows, at = rows[len(x) :], at[len(x) :]
        order = np.argsort(rows, kind="stable")
        return home, np.r_[0, np.bincount(rows, minlength=len(x)).cumsum()], at[order]

    def choose_dimensions(self, rest: np.ndarray, n: int) -> None:
        """The depth of the grid at which n rows like the sample `rest` cost least: each dimension makes copies and saves
        comparisons. The same rule at every size; a larger table gets a deeper grid."""
        few = rest[:400]
        if not len(few) or not self.deepest:
            return
        z, lo = self.coordinates(rest[:2000]), np.floor(self.coordinates(few))
        width = 2 * self.reach
        apart, inside = np.zeros((len(few), len(z))), self.coordinates(few) - lo
        copies, best = np.ones((len(few), 1)), (math.inf, 0)
        for d in range(self.deepest):
            gap = np.maximum(0, np.maximum(lo[:, d, None] - z[None, :, d], z[None, :, d] - lo[:, d, None] - 1)) * width
            apart += gap**2
            members = n * (apart <= self.reach**2).mean()
            # how many of the copies so far are still within reach with one more step, by the distances they have used up
            own = (np.minimum(inside[:, d], 1 - inside[:, d]) * width)[:, None] ** 2
            used = copies if d else np.zeros((len(few), 1))
            used = np.concatenate([used, np.where(used + own <= self.reach**2, used + own, math.inf)], 1)
            used.sort(1)
            copies = used[:, : max(1, int(np.isfinite(used).sum(1).max()))]
            cost = COPY_COST * np.isfinite(copies).sum(1).mean() + members
            if cost < best[0]:
                best = (cost, d + 1)
            elif cost > 4 * best[0]:
                break
        self.dimensions = best[1]


def fit_space(x: np.ndarray, similarity: float, least: int) -> Space:
    """Pivots where the sample is dense, densest first, each moved to the mean of its neighbourhood; principal axes."""
    dim = x.shape[1]
    space = Space(
        similarity, np.zeros((0, dim)), x.mean(0), np.linalg.svd(x - x.mean(0), full_matrices=False)[2] if len(x) else np.zeros((0, dim))
    )
    pivots: list[np.ndarray] = []
    left = x
    half = math.cos(space.angle / 2) + _SLACK
    while len(left) >= least:
        density = np.concatenate([(left[i : i + 1000] @ left.T >= half).sum(1) for i in range(0, len(left), 1000)])
        new: list[np.ndarray] = []
        for i in np.argsort(-density, kind="stable"):
            if density[i] < least:
                break
            if new and max(np.stack(new) @ left[i]) >= math.cos(space.angle):
                continue
            centre = left[left @ left[i] >= similarity].mean(0)
            if (norm := np.linalg.norm(centre)) > 0:
                new.append(centre / norm)
        if not new:
            break
        pivots += new
        before, left = len(left), left[(left @ np.stack(new).T).max(1) < half]
        if len(left) == before:
            break
    space.pivots = np.stack(pivots) if pivots else np.zeros((0, dim))
    return space


def unit_vectors(rows: DataFrame, kind: str, item: str, vector: str) -> DataFrame:
    """(kind, item, vec) with vectors of length 1, one row per kind and item.

    Left out: a null kind, item or vector, a vector that holds a null, NaN or infinity, is empty or all zeros. Of an
    item that comes with several vectors the smallest one is kept.
    """
    broken = F.exists("vec", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == F.lit(float("inf"))))
    named = rows.where(F.col(kind).isNotNull() & F.col(item).isNotNull() & F.col(vector).isNotNull())
    once = named.select(
        F.col(kind).cast("string").alias("kind"), F.col(item).cast("string").alias("item"), F.col(vector).cast("array<double>").alias("vec")
    ).where((F.size("vec") > 0) & ~F.coalesce(broken, F.lit(True)))
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, e: a + e * e))
    return once.groupBy("kind", "item").agg(F.min("vec").alias("vec")).withColumn("norm", norm).where("norm > 0").select(
        "kind", "item", F.transform("vec", lambda e: e / F.col("norm")).alias("vec")
    )


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def _lists(offsets: np.ndarray, values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values.astype(np.int64)))


def _by_kind(spaces: dict[str, Space], place):
    """Each kind's rows of a batch with what `place` says of them: a home and the margins they lie in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = np.array(batch.column(0).to_pylist(), object)
            for kind in set(kinds.tolist()):
                own = pa.Table.from_batches([batch.filter(pa.array(kinds == kind))]).combine_chunks()
                for k in range(0, len(own), 1_000):
                    part = own.slice(k, 1_000).combine_chunks()
                    home, offsets, values = place(spaces[kind], _matrix(part["vec"]))
                    for made in part.append_column(
                        "home", pa.array(home.astype(np.int64))
                    ).append_column("margin", _lists(offsets, values)).to_batches():
                        yield made

    return run


def _compare(similarity: float, emit: str):
    """One block: home rows against members of the same cell; margin members of a ball count for themselves as well."""

    def counts(h: pa.Table, m: pa.Table, near: np.ndarray) -> pd.DataFrame:
        cell = h["cell"][0].as_py()
        out = [pd.DataFrame({"item": h["item"].to_pandas(), "n": near.sum(1), "ball": pd.array([pd.NA] * len(h), "Int64")})]
        if cell < 0:
            out.append(pd.DataFrame({"item": m["item"].to_pandas(), "n": near.sum(0), "ball": pd.array([cell] * len(m), "Int64")}))
        return pd.concat(out).query("n > 0")

    def links(h: pa.Table, m: pa.Table, near: np.ndarray) -> pd.DataFrame:
        """Stars instead of pairs: each local group of cores is tied to its smallest core, a border to one core."""
        hi, mi = h["item"].to_numpy(zero_copy_only=False), m["item"].to_numpy(zero_copy_only=False)
        hc, mc = h["core"].to_numpy(zero_copy_only=False).astype(bool), m["core"].to_numpy(zero_copy_only=False).astype(bool)
        items, at = np.unique(np.concatenate([hi, mi]).astype(str), return_inverse=True)
        a, b = at[: len(hi)], at[len(hi) :]
        core = near & hc[:, None] & mc[None, :]
        label = np.arange(len(items))
        while True:  # the least label among a core's neighbours, until nothing changes
            old = label.copy()
            low = np.where(core, label[b][None, :], len(items)).min(1, initial=len(items))
            np.minimum.at(label, a, low)
            low = np.where(core, label[a][:, None], len(items)).min(0, initial=len(items))
            np.minimum.at(label, b, low)
            if (label == old).all():
                break
        used = np.unique(np.concatenate([a[core.any(1)], b[core.any(0)]]))
        out = [pd.DataFrame({"a": items[label[used]], "b": items[used], "border": False})]
        i, j = np.nonzero(near & hc[:, None] & ~mc[None, :])
        if len(i):
            out.append(pd.DataFrame({"a": items[label[a[i]]], "b": items[b[j]], "border": True}).drop_duplicates())
        return pd.concat(out)

    def run(table: pa.Table) -> pa.Table:
        role = table["role"].to_numpy(zero_copy_only=False)
        h = table.filter(pa.array(role == "h"))
        m = table.filter(pa.array(role == "m"))
        if not len(h) or not len(m):
            return pa.table(
                {"item": pa.array([], pa.string()), "n": pa.array([], pa.int64()), "ball": pa.array([], pa.int64())}
            ) if emit == "counts" else pa.table(
                {"a": pa.array([], pa.string()), "b": pa.array([], pa.string()), "border": pa.array([], pa.bool_())}
            )
        near = _matrix(h["vec"]) @ _matrix(m["vec"]).T >= similarity
        itself = pc.index_in(h["item"], value_set=m["item"])
        at = np.flatnonzero(np.asarray(itself.is_valid()))
        near[at, itself.drop_null().to_numpy()] = False
        frame = (counts if emit == "counts" else links)(h, m, near)
        schema = pa.schema(
            [("item", pa.string()), ("n", pa.int64()), ("ball", pa.int64())]
        ) if emit == "counts" else pa.schema([("a", pa.string()), ("b", pa.string()), ("border", pa.bool_())])
        return pa.Table.from_pandas(frame, schema=schema, preserve_index=False)

    return run


def _blocks(placed: DataFrame, similarity: float, emit: str, block: int) -> DataFrame:
    """Compare the rows of each cell with the members of the cell, in blocks of bounded size.

    A ball's home rows need no comparison with each other. A ball without margin members, and a cell with one member,
    need none at all. Cells with many rows are cut into blocks of `block` rows of either side by a hash.
    """
    extra = ["core"] if emit == "links" else []
    home = placed.select("kind", "item", "vec", *extra, F.col("home").alias("cell"))
    of_balls = placed.select(
        "kind", "item", "vec", *extra, "home", F.explode("margin").alias("cell")
    ).where("cell >= 0 or home >= 0 or cell < home")
    member = of_balls.drop("home").unionByName(home.where("cell >= 0"))
    sizes = member.groupBy("kind", "cell").agg(F.count("*").alias("m")).join(
        placed.groupBy("kind", F.col("home").alias("cell")).agg(F.count("*").alias("h")), ["kind", "cell"]
    ).where("not (cell >= 0 and m = 1)")
    sizes = sizes.select("kind", "cell", *(F.ceil(F.col(c) / F.lit(block)).cast("int").alias(f"{c}b") for c in ("h", "m")))
    own = home.join(sizes, ["kind", "cell"]).select(
        "kind",
        "cell",
        "item",
        "vec",
        *extra,
        F.lit("h").alias("role"),
        F.pmod(F.xxhash64("item"), "hb").cast("int").alias("i"),
        F.explode(F.expr("sequence(0, mb - 1)")).alias("j")
    )
    others = member.join(sizes, ["kind", "cell"]).select(
        "kind",
        "cell",
        "item",
        "vec",
        *extra,
        F.lit("m").alias("role"),
        F.explode(F.expr("sequence(0, hb - 1)")).alias("i"),
        F.pmod(F.xxhash64("item"), "mb").cast("int").alias("j")
    )
    ddl = "item string, n bigint, ball bigint" if emit == "counts" else "a string, b string, border boolean"
    # kind and item together name a node from here on
    key = lambda df: df.withColumn("item", F.concat_ws("\x1f", "kind", "item"))
    return key(own.unionByName(others)).groupBy("kind", "cell", "i", "j").applyInArrow(_compare(similarity, emit), ddl)


def similarity_clusters(
    rows: DataFrame, kind: str, item: str, vector: str, similarity: float = 0.95, least: int = 5, block: int = BLOCK
) -> DataFrame:
    """(kind, item, cluster_id, degree, core, vec): density clusters of unit vectors within each kind.

    Two items are neighbours if the cosine of their vectors is at least `similarity`. An item with at least `least`
    items in its neighbourhood, itself included, is a core; cores that are neighbours share a cluster, and a cluster also
    holds the neighbours of its cores (one that borders on several clusters comes in each of them). Items like no
    others are left out. `degree` is the size of the neighbourhood, itself included; cluster_id is the smallest item.

    Method. A bounded sample of each kind gives pivots in dense places and principal axes. Vectors within half the
    angle of a pivot form a ball, in which all are neighbours of each other and nothing needs to be compared. All other
    vectors are reduced to a few principal coordinates, which never moves two of them apart, and a grid with cells of
    twice the reach divides them; a cell also receives what lies in its margin, within reach of it. Every vector is
    placed, whatever the sample was, and the result does not depend on it: it is exact. Comparisons are blocks of
    bounded size; local groups are passed on as stars, not as pairs, and merged through the cores they share.

    Nulls, repeated rows and unusable vectors: see unit_vectors. Vectors of one kind must have one length. An empty
    table gives an empty result; ties and copies are ordinary neighbours; other columns are ignored.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark, "clusters")
    unit = scratch.write(unit_vectors(rows, kind, item, vector), "unit")
    sizes = {r["kind"]: r["n"] for r in unit.groupBy("kind").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return spark.createDataFrame([], f"{kind} string, {item} string, cluster_id string, degree bigint, core boolean, vec array<double>")
    spaces = {}
    for name, n in sizes.items():
        share = min(1.0, SAMPLE / n)
        sample = unit.where(
            (F.col("kind") == name) & (F.pmod(F.xxhash64("item"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
        ).select("vec").toArrow()
        spaces[name] = fit_space(_matrix(sample["vec"])[: 2 * SAMPLE], similarity, least)
    layout = "kind string, item string, vec array<double>, home bigint, margin array<bigint>"
    near = scratch.write(unit.mapInArrow(_by_kind(spaces, Space.balls), layout), "near")
    scratch.drop("unit")
    # balls are numbered from -1 down; those that are too small to make cores of their members by themselves are given up
    held = near.where("home >= 0").groupBy("kind", F.col("home").alias("ball")).agg(F.count("*").alias("n"))
    kept = {name: [] for name in spaces}
    for r in held.where(F.col("n") >= least).collect():
        kept[r["kind"]].append((r["ball"], r["n"]))
    balls = F.create_map(
        *(x for name, own in kept.items() for x in (F.lit(name), F.array(*(F.lit(b).cast("bigint") for b, _ in own)).cast("array<bigint>")))
    )[F.col("kind")]
    known = near.select(
        "kind",
        "item",
        "vec",
        F.when(F.array_contains(balls, F.col("home")), -1 - F.col("home")).alias("home"),
        F.transform(F.array_intersect("margin", balls), lambda b: -1 - b).alias("around")
    )
    for name, space in spaces.items():
        rest = known.where((F.col("kind") == name) & F.col("home").isNull())
        n = sizes[name] - sum(m for _, m in kept[name])
        sample = rest.where(
            F.pmod(F.xxhash64("item"), F.lit(1 << 20)) < int(min(1.0, 2_000 / max(1, n)) * (1 << 20)) + 1
        ).select("vec").limit(4_000).toArrow()
        space.choose_dimensions(_matrix(sample["vec"]) if len(sample) else np.zeros((0, len(space.mean))), n)
    loose = known.where("home is null").select("kind", "item", "vec", "around").mapInArrow(
        _by_kind(spaces, Space.cells), layout.replace("home", "around array<bigint>, home")
    )
    loose = loose.select("kind", "item", "vec", "home", F.concat("around", "margin").alias("margin"))
    placed = scratch.write(known.where("home is not null").withColumnRenamed("around", "margin").unionByName(loose), "placed")
    scratch.drop("near")
    key = F.concat_ws("\x1f", "kind", "item")
    counts = scratch.write(_blocks(placed, similarity, "counts", block), "counts")
    in_ball = F.when(F.col("home") < 0, F.col("size")).otherwise(F.lit(1))
    balls = placed.where("home < 0").groupBy("kind", "home").agg(F.count("*").alias("size"))
    found = counts.groupBy("item").agg(F.sum("n").alias("n")).withColumnRenamed("item", "key")
    nodes = placed.withColumn("key", key).join(F.broadcast(balls), ["kind", "home"], "left").join(found, "key", "left").withColumn(
        "degree", in_ball + F.coalesce("n", F.lit(0))
    )
    # only what has neighbours can be in a cluster
    nodes = scratch.write(
        nodes.where("degree > 1").select(
            "kind", "item", "vec", "home", "margin", "key", "degree", (F.col("degree") >= least).alias("core")
        ),
        "nodes"
    )
    loose = nodes.where("home >= 0").withColumn("margin", F.filter("margin", lambda c: c >= 0))
    links = scratch.write(_blocks(loose.select("kind", "item", "vec", "home", "margin", "core"), similarity, "links", block), "links")
    # a ball is one group of cores already: a star around its smallest item
    head = nodes.where("home < 0").groupBy("kind", "home").agg(F.min("key").alias("head"))
    stars = nodes.join(F.broadcast(head), ["kind", "home"]).select(
        F.col("head").alias("a"), F.col("key").alias("b"), F.lit(False).alias("border")
    )
    touched = counts.where("ball is not null").select("item", "ball").distinct()
    state = nodes.select(F.col("key").alias("item"), "core", F.col("kind").alias("k"))
    to_ball = touched.join(state, "item").join(
        head.select(F.col("kind").alias("k"), F.col("home").alias("ball"), "head"), ["k", "ball"]
    ).select(F.col("head").alias("a"), F.col("item").alias("b"), (~F.col("core")).alias("border"))
    ties = scratch.write(links.unionByName(stars).unionByName(to_ball), "ties")
    groups = scratch.write(components(ties.where("not border"), "a", "b"), "groups")
    core = nodes.where("core").select("key").join(
        groups.withColumnRenamed("value", "key"), "key", "left"
    ).select("key", F.coalesce("group", "key").alias("group"))
    border = ties.where("border").select(
        F.col("a").alias("core_key"), F.col("b").alias("key")
    ).join(core.withColumnRenamed("key", "core_key"), "core_key").select("key", "group").distinct()
    member = scratch.write(core.unionByName(border), "members")
    named = member.groupBy("group").agg(F.min("key").alias("least_key"))
    cluster = member.join(named, "group").select("key", F.element_at(F.split("least_key", "\x1f"), -1).alias("cluster_id"))
    return cluster.join(nodes, "key").select(F.col("kind").alias(kind), F.col("item").alias(item), "cluster_id", "degree", "core", "vec")


def mutual_clusters(clusters: DataFrame, kind: str, item: str, least: int = 5) -> DataFrame:
    """The clusters in which any two items are neighbours and none has a neighbour outside: (item, cluster_id).

    A cluster holds all neighbours of its cores. If the neighbourhood of every member is as large as the cluster, then
    every member is a core, its neighbourhood lies in the cluster, and so it is the cluster.
    """
    whole = clusters.groupBy(kind, "cluster_id").agg(
        F.count("*").alias("n"), F.min("degree").alias("lo"), F.max("degree").alias("hi")
    ).where(f"n >= {least} and lo = n and hi = n")
    return clusters.join(whole.select(kind, "cluster_id"), [kind, "cluster_id"]).select(item, "cluster_id")


def describe_clusters(clusters: DataFrame, kind: str, item: str, typical: int = 3) -> DataFrame:
    """(kind, cluster_id, size, medoid, similarity of each of the most typical items) of each cluster.

    Among unit vectors the item with the largest sum of cosines to all others is the one nearest to the direction of
    the vectors' sum, so that the medoids need one aggregate and no pairs. Equal ones: the smallest item first. Every
    task keeps only its best few.
    """
    sums = clusters.select(
        kind, "cluster_id", F.posexplode("vec").alias("pos", "v")
    ).groupBy(kind, "cluster_id", "pos").agg(F.sum("v").alias("v"))
    sums = sums.groupBy(kind, "cluster_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda s: s["v"]).alias("total")
    )
    size = clusters.groupBy(kind, "cluster_id").agg(F.count("*").alias("size"))
    near = clusters.join(sums, [kind, "cluster_id"]).withColumn(
        "sum_cos", F.aggregate(F.zip_with("vec", "total", lambda a, b: a * b), F.lit(0.0), lambda a, e: a + e)
    )
    from .topn import top_n

    best = top_n(
        near.select(F.concat_ws("\x1f", kind, "cluster_id").alias("g"), F.col("sum_cos"), F.col(item).alias("i")),
        "g",
        "sum_cos",
        "i",
        typical
    )
    best = best.groupBy("g").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank_no", "i"))), lambda s: s["i"]).alias("typical"))
    parts = F.split("g", "\x1f")
    return best.select(parts[0].alias(kind), parts[1].alias("cluster_id"), "typical").join(size, [kind, "cluster_id"]).select(
        kind, "cluster_id", "size", F.col("typical")[0].alias("medoid"), "typical"
    )

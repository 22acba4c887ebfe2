"""Scaled features, message passing over typed edges, learned embeddings, anomaly scores and attention.

Parameters are small numpy arrays, fitted on bounded samples on the driver; whatever runs over all nodes or edges is a
DataFrame plan. Where the described model needs a deep-learning library, a simpler trained one stands in, and says so.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.ledger import average_rank
from ..session import Scratch, free_shuffles
from .order import group_medians

#: Rows and edges that a fit takes at most, size of an embedding, epochs and step of the optimiser.
FIT_ROWS, FIT_EDGES, DIMENSIONS, EPOCHS, STEP = 20_000, 20_000, 16, 30, 0.01
FOREST_SEEDS, TREES, TREE_ROWS, LEAST_NODES, TOP_FEATURES = (0, 1, 2), 200, 256, 50, 3


def bounded_sample(df: DataFrame, key: list[str], rows: int, seed: int = 0) -> DataFrame:
    """About `rows` rows chosen by a hash of the key, which should tell rows apart: the same ones each time, all of them if there are no more."""
    n = df.count()
    share = 1.0 if n <= rows else rows / n
    return df if share >= 1 else df.where(F.pmod(F.xxhash64(*key, F.lit(seed)), F.lit(1 << 20)) < int(share * (1 << 20)))


def standardized(features: DataFrame, columns: list[str], by: str = "node_type") -> DataFrame:
    """features with every column as its z-score within a type (population deviation, 1 where there is none)."""
    stats = features.groupBy(by).agg(*(F.avg(c).alias(f"m_{c}") for c in columns), *(F.stddev_pop(c).alias(f"s_{c}") for c in columns))
    joined = features.join(F.broadcast(stats), by)
    return joined.withColumns(
        {c: (F.col(c) - F.col(f"m_{c}")) / F.when(F.col(f"s_{c}") <= 1e-8, 1.0).otherwise(F.col(f"s_{c}")) for c in columns}
    ).drop(*(f"{p}_{c}" for p in "ms" for c in columns))


def both_directions(edges: DataFrame) -> DataFrame:
    """(relation, src, dst): every edge and its reverse; an edge between wallets has one symmetric relation."""
    same = F.col("edge_type").isin("CO_SPEND", "SAME_ENTITY")
    back = edges.select(
        F.when(same, F.col("edge_type")).otherwise(F.concat(F.lit("rev_"), "edge_type")).alias("relation"),
        F.col("target").alias("src"),
        F.col("source").alias("dst")
    )
    return edges.select(F.col("edge_type").alias("relation"), F.col("source").alias("src"), F.col("target").alias("dst")).unionByName(back)


def propagate(nodes: DataFrame, relations: DataFrame, width: int) -> DataFrame:
    """(node_id, x): the mean of the neighbours' vectors per relation, summed over the relations.

    nodes is (node_id, x array<double>). Sums are plain columns, so that each message is combined before the shuffle and
    a hub costs one row per task and relation.
    """
    sent = relations.join(nodes.withColumnRenamed("node_id", "src"), "src")
    per = sent.groupBy("dst", "relation").agg(*(F.avg(F.get("x", i)).alias(f"v{i}") for i in range(width)))
    whole = per.groupBy("dst").agg(*(F.sum(f"v{i}").alias(f"v{i}") for i in range(width)))
    return whole.select(F.col("dst").alias("node_id"), F.array(*(f"v{i}" for i in range(width))).alias("x"))


#: The relations of both directions, in the order of a node's messages. Fixed values.
RELATIONS = [
    "FUNDS", "rev_FUNDS", "PAYS", "rev_PAYS", "BROADCAST_VIA", "rev_BROADCAST_VIA", "RESOLVES_TO", "rev_RESOLVES_TO", "CO_SPEND", "SAME_ENTITY",
]


def relation_messages(nodes: DataFrame, relations: DataFrame, width: int) -> DataFrame:
    """(node_id, x): each node's own vector, then the mean of its neighbours' vectors by each of RELATIONS, zeros without any.

    A projection of this has a weight matrix of its own for every relation and for the node itself: a graph layer over
    typed edges. Means are plain columns, combined before the shuffle; a node has at most one row per relation after it.
    """
    sent = relations.join(nodes.withColumnRenamed("node_id", "src"), "src")
    per = sent.groupBy("dst", "relation").agg(*(F.avg(F.get("x", i)).alias(f"v{i}") for i in range(width)))
    packed = per.select("dst", "relation", F.array(*(f"v{i}" for i in range(width))).alias("v"))
    own = packed.groupBy(F.col("dst").alias("node_id")).agg(F.map_from_entries(F.collect_list(F.struct("relation", "v"))).alias("m"))
    zero = F.array_repeat(F.lit(0.0), width)
    means = [F.coalesce(F.try_element_at("m", F.lit(r)), zero) for r in RELATIONS]
    return nodes.join(own, "node_id", "left").select("node_id", F.concat("x", *means).alias("x"))


def replaced_messages(messages: DataFrame, nodes: DataFrame, relations: DataFrame, width: int, relation: str) -> DataFrame:
    """relation_messages with the means over these edges, all of one relation, in that relation's place; the rest as it is."""
    sent = relations.join(nodes.withColumnRenamed("node_id", "src"), "src")
    per = sent.groupBy(F.col("dst").alias("node_id")).agg(*(F.avg(F.get("x", i)).alias(f"v{i}") for i in range(width)))
    means = per.select("node_id", F.array(*(f"v{i}" for i in range(width))).alias("_v"))
    at, zero = (1 + RELATIONS.index(relation)) * width, F.array_repeat(F.lit(0.0), width)
    x = F.concat(
        F.slice("x", 1, at), F.coalesce("_v", zero), F.slice("x", at + width + 1, (len(RELATIONS) + 1) * width - at - width)
    )
    return messages.join(means, "node_id", "left").select("node_id", x.alias("x"))


def trained_embeddings(
    nodes: DataFrame, relations: DataFrame, width: int, scratch: Scratch, layers: int = 2, messages: DataFrame | None = None
) -> tuple[DataFrame, list[Projection]]:
    """(node_id, embedding) of a graph encoder with learned weights per relation, and its layers.

    Each layer is fitted for link prediction on what the layer before gives, and then applied to all nodes. messages, if
    given, are the first layer's, stored.
    """
    fitted: list[Projection] = []
    now = nodes.select("node_id", "x")
    for k in range(layers):
        given = messages is not None and k == 0
        sent = messages if given else scratch.write(relation_messages(now, relations, width), f"messages{k}")
        free_shuffles(nodes.sparkSession)
        fitted.append(fit_link_projection(sent, relations))
        now = scratch.write(fitted[-1].apply(sent).withColumnRenamed("embedding", "x"), f"layer{k}")
        if not given:
            scratch.drop(f"messages{k}")
        width = DIMENSIONS
    return now.withColumnRenamed("x", "embedding"), fitted


@dataclass
class Projection:
    """A linear map to DIMENSIONS coordinates."""

    weights: np.ndarray

    def apply(self, df: DataFrame) -> DataFrame:
        w = self.weights

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                    y = np.tanh(x @ w)
                    offsets = pa.array(np.arange(len(y) + 1, dtype=np.int32) * y.shape[1])
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0), pa.ListArray.from_arrays(offsets, pa.array(y.ravel()))], names=["node_id", "embedding"]
                    )

        return df.select("node_id", "x").mapInArrow(run, "node_id string, embedding array<double>")

    def save(self, spark: SparkSession, path: str) -> None:
        """The parameters as a Parquet table of one row per entry."""
        rows = [(int(i), int(j), float(v)) for (i, j), v in np.ndenumerate(self.weights)]
        spark.createDataFrame(rows, "i int, j int, value double").coalesce(1).write.parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> Projection:
        rows = spark.read.schema("i int, j int, value double").parquet(path).toPandas()
        w = np.zeros((int(rows["i"].max()) + 1, int(rows["j"].max()) + 1))
        w[rows["i"], rows["j"]] = rows["value"]
        return Projection(w)


def save_parameters(spark: SparkSession, parameters: dict[str, np.ndarray], path: str) -> None:
    """Named matrices, such as those of the attention layers, as a Parquet table of one row per entry."""
    rows = [(name, int(i), int(j), float(v)) for name, w in parameters.items() for (i, j), v in np.ndenumerate(w)]
    spark.createDataFrame(rows, "name string, i int, j int, value double").coalesce(1).write.parquet(path)


def load_parameters(spark: SparkSession, path: str) -> dict[str, np.ndarray]:
    rows = spark.read.schema("name string, i int, j int, value double").parquet(path).toPandas()
    out = {}
    for name, own in rows.groupby("name"):
        out[name] = np.zeros((int(own["i"].max()) + 1, int(own["j"].max()) + 1))
        out[name][own["i"], own["j"]] = own["value"]
    return out


def embedding_columns(embeddings: DataFrame, dimensions: int = DIMENSIONS) -> DataFrame:
    """node_id and emb_0, emb_1 and so on instead of the array."""
    return embeddings.select("node_id", *(F.get("embedding", i).alias(f"emb_{i}") for i in range(dimensions)))


def false_ends(src: np.ndarray, names: np.ndarray, true: set, rng: np.random.Generator) -> np.ndarray:
    """For each src the place in names of a uniformly drawn other end; a true pair moves on to the next name."""
    at = rng.integers(len(names), size=len(src))
    for k in [k for k, pair in enumerate(zip(src, names[at])) if pair in true]:
        for _ in range(len(names)):
            if (src[k], names[at[k]]) not in true:
                break
            at[k] = (at[k] + 1) % len(names)
    return at


def fit_link_projection(features: DataFrame, edges: DataFrame, seed: int = 7, most_edges: int = FIT_EDGES) -> Projection:
    """A projection of propagated features under which linked nodes have larger products than random ones.

    Binary cross entropy over a bounded hash sample of the edges against as many false ones, whose ends are drawn uniformly
    from a bounded sample of all nodes; one that hits a true edge of the sample takes the next node. By Adam; plain numpy
    with the gradient written out. Over relation_messages it learns one weight matrix per relation. Both samples are taken
    in the order of their names, so that the fit is the same each time; the vectors come from one pass over the nodes, to
    which the names of the edges' ends are sent.
    """
    key = [c for c in ("relation", "src", "dst") if c in edges.columns]
    some = bounded_sample(edges.select(*key), key, most_edges, seed).toArrow().sort_by([(c, "ascending") for c in key])
    spark, total = features.sparkSession, features.count()
    share = min(1.0, most_edges / total) if total else 1.0
    pooled = F.lit(True) if share >= 1 else F.pmod(F.xxhash64("node_id", F.lit(seed)), F.lit(1 << 20)) < int(share * (1 << 20))
    named = pa.table({"node_id": pc.unique(pa.concat_arrays([*some["src"].chunks, *some["dst"].chunks]))})
    ends = F.broadcast(spark.createDataFrame(named, "node_id string").withColumn("end", F.lit(True)))
    taken = features.select("node_id", "x", pooled.alias("pool")).join(ends, "node_id", "left").where("pool or end").toArrow()
    order = pc.sort_indices(taken["node_id"].combine_chunks())
    known, pool = taken["node_id"].combine_chunks().take(order), taken["pool"].combine_chunks().take(order)
    parts = [c.flatten().to_numpy(zero_copy_only=False).reshape(len(c), -1) for c in taken["x"].chunks if len(c)]
    width = parts[0].shape[1] if parts else len(features.first()["x"])
    # the weights of a column of zeros have no gradient, and the columns are many: only the others are copied
    live = np.any([c.any(0) for c in parts], axis=0) if parts else np.ones(width, bool)
    x = np.concatenate([c[:, live] for c in parts] or [np.zeros((0, width))])
    del taken, parts
    x, rng = x[order.to_numpy()], np.random.default_rng(seed)
    at = [pc.index_in(some[c].combine_chunks(), value_set=known) for c in ("src", "dst")]
    both = pc.and_(*(i.is_valid() for i in at))
    src_at, dst_at = (i.filter(both).to_numpy() for i in at)
    if not len(src_at):
        return Projection(rng.normal(0, 1 / math.sqrt(width), (width, DIMENSIONS)))
    some, pool = some.filter(both), np.flatnonzero(pool.to_numpy(zero_copy_only=False))
    names = np.array(known.to_pylist(), object)[pool]
    src, true = np.array(some["src"].to_pylist(), object), set(zip(some["src"].to_pylist(), some["dst"].to_pylist()))
    every = rng.normal(0, 1 / math.sqrt(width), (width, DIMENSIONS))
    w = every[live]
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, EPOCHS + 1):
        drawn_at = pool[false_ends(src, names, true, rng)]
        z = np.tanh(x @ w)
        za, zb, zc = z[src_at], z[dst_at], z[drawn_at]
        gp = 1 / (1 + np.exp(-np.clip((za * zb).sum(1), -30, 30))) - 1
        gn = 1 / (1 + np.exp(-np.clip((za * zc).sum(1), -30, 30)))
        d = np.zeros_like(z)
        for at, part in ((src_at, gp[:, None] * zb + gn[:, None] * zc), (dst_at, gp[:, None] * za), (drawn_at, gn[:, None] * za)):
            np.add.at(d, at, part)
        g = x.T @ (d * (1 - z**2)) / len(src)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - STEP * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    every[live] = w
    return Projection(every)


def reconstruction_errors(features: DataFrame, columns: list[str], rank: int = DIMENSIONS) -> DataFrame:
    """(node_id, node_type, raw_error): the squared error of each node's z-scores behind a bottleneck of `rank` directions.

    The best linear autoencoder of a type stands in for a trained one. Its basis is that of the second moments of all
    nodes of the type: one small matrix per task and type goes on, and their sum is solved on the driver.
    """
    z = standardized(features, columns).select("node_id", "node_type", F.array(*columns).alias("x"))
    width = len(columns)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            if b.num_rows:
                x, kinds = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1), np.array(b.column(0).to_pylist())
                for kind in set(kinds.tolist()):
                    sums[kind] = sums.get(kind, 0) + x[kinds == kind].T @ x[kinds == kind]
        if sums:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(sums)), pa.array([m.ravel().tolist() for m in sums.values()], pa.list_(pa.float64()))],
                names=["node_type", "m"]
            )

    parts = z.select("node_type", "x").mapInArrow(moments, "node_type string, m array<double>").select(
        "node_type", F.posexplode("m").alias("i", "v")
    )
    bases, found = {}, {}
    for r in parts.groupBy("node_type", "i").agg(F.sum("v").alias("v")).collect():
        found.setdefault(r["node_type"], np.zeros(width * width))[r["i"]] = r["v"]
    for kind, m in found.items():
        bases[kind] = np.linalg.eigh(m.reshape(width, width))[1].T[::-1][: max(1, min(rank, width // 2))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = b.column(2).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                kinds, error = np.array(b.column(1).to_pylist()), np.zeros(b.num_rows)
                for kind in set(kinds.tolist()):
                    at = kinds == kind
                    error[at] = ((x[at] - x[at] @ bases[kind].T @ bases[kind]) ** 2).mean(1)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(error)], names=["node_id", "node_type", "raw_error"])

    return z.mapInArrow(run, "node_id string, node_type string, raw_error double")


def anomaly_scores(errors: DataFrame) -> DataFrame:
    """errors with z_score within its type (0 where all are equal) and score, its sigmoid."""
    s = errors.groupBy("node_type").agg(
        F.avg("raw_error").alias("population_mean_error"), F.stddev_pop("raw_error").alias("population_std_error")
    )
    df = errors.join(F.broadcast(s), "node_type").withColumn(
        "z_score",
        F.when(F.col("population_std_error") <= 1e-8, 0.0).otherwise(
            (F.col("raw_error") - F.col("population_mean_error")) / F.col("population_std_error")
        )
    )
    return df.withColumn("score", F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("z_score"))))


def anomaly_rows(scores: DataFrame) -> DataFrame:
    return scores.select(
        "node_id",
        "score",
        F.concat(F.lit("ANOMALY_ZSCORE="), F.format_string("%.2f", "z_score")).alias("reason_code"),
        F.to_json(F.struct("node_type", "raw_error", "z_score")).alias("evidence_json")
    )


# --- isolation forest -----------------------------------------------------------------------------------------------


def squashed(columns: list[str]) -> list[Column]:
    return [(F.signum(F.col(c)) * F.log1p(F.abs(F.col(c)))).alias(c) for c in columns]


def robust_z(df: DataFrame, columns: list[str], by: str = "node_type") -> DataFrame:
    """df with z_<column>: the distance from the type's median in units of 1.4826 times the median distance; 0 where that is
    0. Medians are the lower ones, exact at every size."""
    med = group_medians(df, by, columns).select(by, *(F.col(c).alias(f"m_{c}") for c in columns))
    off = df.join(F.broadcast(med), by)
    mad = group_medians(
        off.select(by, *(F.abs(F.col(c) - F.col(f"m_{c}")).alias(c) for c in columns)), by, columns
    ).select(by, *(F.col(c).alias(f"d_{c}") for c in columns))
    z = off.join(F.broadcast(mad), by)
    return z.withColumns(
        {f"z_{c}": F.when(F.col(f"d_{c}") > 0, (F.col(c) - F.col(f"m_{c}")) / (1.4826 * F.col(f"d_{c}"))).otherwise(0.0) for c in columns}
    ).drop(*(f"{p}_{c}" for p in "md" for c in columns))


def _tree(x: np.ndarray, rng: np.random.Generator, limit: int) -> list[tuple[int, float, int, int, float]]:
    """Nodes (feature, cut, left, right, path length at a leaf) of one isolation tree, without recursion."""
    out: list = []
    todo = [(np.arange(len(x)), 0, -1, 0)]
    while todo:
        rows, depth, parent, side = todo.pop()
        at = len(out)
        if parent >= 0:
            out[parent][2 + side] = at
        spread = x[rows].max(0) - x[rows].min(0) if len(rows) > 1 else np.zeros(x.shape[1])
        options = np.flatnonzero(spread > 0)
        if depth >= limit or not len(options):
            out.append([-1, 0.0, at, at, depth + _expected(len(rows))])
            continue
        f = int(rng.choice(options))
        cut = float(rng.uniform(x[rows, f].min(), x[rows, f].max()))
        out.append([f, cut, 0, 0, 0.0])
        left = x[rows, f] <= cut
        todo += [(rows[~left], depth + 1, at, 1), (rows[left], depth + 1, at, 0)]
    return out


def _expected(n: int) -> float:
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


def _grown(x: np.ndarray, seed: int, number: int) -> np.ndarray:
    """One tree of a forest, by its number."""
    rng = np.random.default_rng([seed, number])
    rows = rng.choice(len(x), min(TREE_ROWS, len(x)), replace=False)
    return np.array(_tree(x[rows], rng, max(1, math.ceil(math.log2(max(2, len(rows)))))))


def _forest(x: np.ndarray, seed: int, trees: int) -> list[np.ndarray]:
    return [_grown(x, seed, k) for k in range(trees)]


def _forests(spark: SparkSession, x: np.ndarray, trees: int) -> list[list[np.ndarray]]:
    """_forest for each of FOREST_SEEDS, every tree by whichever task comes to it; a tree has at most 2 * TREE_ROWS nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in b.column(0).to_pylist():
                tree = _grown(x, FOREST_SEEDS[i // trees], i % trees)
                yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([tree.ravel()], pa.list_(pa.float64()))], names=["id", "tree"])

    n = len(FOREST_SEEDS) * trees
    rows = spark.range(0, n, 1, min(n, 4 * spark.sparkContext.defaultParallelism)).mapInArrow(run, "id bigint, tree array<double>").toArrow()
    found = dict(zip(rows["id"].to_pylist(), (t.values.to_numpy().reshape(-1, 5) for t in rows["tree"])))
    return [[found[s * trees + k] for k in range(trees)] for s in range(len(FOREST_SEEDS))]


def _depths(x: np.ndarray, forest: list[np.ndarray]) -> np.ndarray:
    total = np.zeros(len(x))
    rows = np.arange(len(x))
    for t in forest:
        f, cut, left, right, path = t[:, 0].astype(int), t[:, 1], t[:, 2].astype(int), t[:, 3].astype(int), t[:, 4]
        at = np.zeros(len(x), int)
        while (f[at] >= 0).any():
            inner = f[at] >= 0
            go = x[rows, np.maximum(f[at], 0)] <= cut[at]
            at = np.where(inner, np.where(go, left[at], right[at]), at)
        total += path[at]
    return total / len(forest)


def isolation_scores(
    features: DataFrame, columns: list[str], kinds: tuple[str, ...] = ("Wallet", "Transaction"), trees: int = TREES
) -> DataFrame:
    """(node_id, node_type, score, evidence_json, reason_code): how isolated a node is among its type, as a percentile.

    Trees are grown on samples of TREE_ROWS rows out of a bounded pool; each of three forests ranks all nodes, and the
    score is the mean of the percentile ranks. Types with fewer than LEAST_NODES nodes have no scores. The evidence
    names the features that are farthest from the type's median.
    """
    df = features.where(F.col("node_type").isin(*kinds)).fillna(0.0, columns).select("node_id", "node_type", *squashed(columns))
    df = Scratch(features.sparkSession, "isolation").write(df, "squashed")
    forests, total = {}, 0
    for row in df.groupBy("node_type").agg(F.count("*").alias("n"), *(F.stddev_pop(c).alias(c) for c in columns)).collect():
        usable = [i for i, c in enumerate(columns) if row[c] and row[c] > 0]
        total += row["n"]
        if row["n"] >= LEAST_NODES and usable:
            pool = bounded_sample(
                df.where(F.col("node_type") == row["node_type"]), ["node_id"], FIT_ROWS
            ).select(*columns).toPandas().to_numpy(float)
            forests[row["node_type"]] = (usable, _forests(features.sparkSession, pool[:, usable], trees))
    ddl = "node_id string, node_type string, " + ", ".join(f"d{i} double" for i in range(len(FOREST_SEEDS)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kinds_ = np.array(b.column(1).to_pylist())
            x = np.column_stack(
                [b.column(2 + i).to_numpy(zero_copy_only=False) for i in range(len(columns))]
            ) if b.num_rows else np.zeros((0, len(columns)))
            keep = np.isin(kinds_, list(forests))
            depth = np.zeros((len(FOREST_SEEDS), b.num_rows))
            for kind in set(kinds_[keep].tolist()):
                at = np.flatnonzero(kinds_ == kind)
                usable, some = forests[kind]
                for i, forest in enumerate(some):
                    depth[i, at] = -_depths(x[at][:, usable], forest)
            mask = pa.array(keep)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).filter(mask), b.column(1).filter(mask), *(pa.array(d[keep]) for d in depth)],
                names=["node_id", "node_type", *(f"d{i}" for i in range(len(FOREST_SEEDS)))]
            )

    # all forests are ranked together, each within itself
    # a table of few bytes is many trees' work all the same: it is spread by rows
    tasks = min(math.ceil(total / 1000), 4 * features.sparkSession.sparkContext.defaultParallelism)
    spread = df.repartition(tasks) if df.rdd.getNumPartitions() < tasks else df
    depths = spread.mapInArrow(run, ddl).select(
        "node_id", "node_type", F.posexplode(F.array(*(F.col(f"d{i}") for i in range(len(FOREST_SEEDS))))).alias("forest", "depth")
    )
    scored = average_rank(depths, "depth", "place", ["node_type", "forest"]).groupBy("node_id", "node_type").agg(
        (F.sum("place") / len(FOREST_SEEDS)).alias("score")
    )
    z = robust_z(df, columns).select(
        "node_id",
        "node_type",
        F.slice(
            F.sort_array(
                F.array(
                    *(
                        F.struct(F.abs(F.col(f"z_{c}")).alias("a"), F.lit(c).alias("feature"), F.round(f"z_{c}", 2).alias("z"))
                        for c in columns
                    )
                ),
                False
            ),
            1,
            TOP_FEATURES
        ).alias("top")
    )
    out = scored.join(z, ["node_id", "node_type"])
    evidence = F.to_json(
        F.struct(
            "node_type",
            F.round("score", 4).alias("percentile"),
            F.map_from_entries(F.transform("top", lambda t: F.struct(t["feature"], t["z"]))).alias("top_deviating_features")
        )
    )
    return out.select(
        "node_id",
        "node_type",
        "score",
        F.concat(F.lit("IFOREST_PCTL="), F.format_string("%.2f", "score")).alias("reason_code"),
        evidence.alias("evidence_json")
    )


# --- time and attention ---------------------------------------------------------------------------------------------


def normalized_times(edges: DataFrame) -> DataFrame:
    """(src, dst, t) of BROADCAST_VIA edges, t between 0 and 1 over the covered span, which counts as a second at least."""
    e = edges.where("edge_type = 'BROADCAST_VIA' and at_us is not null")
    span = e.agg(F.min("at_us").alias("lo"), F.max("at_us").alias("hi"))
    return e.crossJoin(F.broadcast(span)).select(
        F.col("source").alias("src"),
        F.col("target").alias("dst"),
        ((F.col("at_us") - F.col("lo")) / F.greatest(F.col("hi") - F.col("lo"), F.lit(1_000_000))).alias("t")
    )


def time_vector(t: Column, weights: list[float], offsets: list[float]) -> Column:
    """A linear and several periodic coordinates of a time."""
    return F.array(F.lit(weights[0]) * t + F.lit(offsets[0]), *(F.sin(F.lit(w) * t + F.lit(b)) for w, b in zip(weights[1:], offsets[1:])))


def attention_sums(
    nodes: DataFrame, relations: DataFrame, left: np.ndarray, right: np.ndarray, score: np.ndarray, heads: int = 2
) -> tuple[DataFrame, DataFrame]:
    """The messages of an attention layer: (node_id, v0, v1, ...) of their sums, (relation, src, dst, weight) of the edges.

    An edge's raw weight is score . leaky(left x_src + right x_dst) per head; weights are a softmax over the edges that
    enter a node with one relation; messages are left x_src, averaged over the heads and summed over the relations. left
    and right are (width, heads * out), score is (heads, out). Edges are shuffled twice, by src and by dst, with the
    narrower of x and left x; the second shuffle serves the softmax and the sums, as windows that spill at a hub.
    """
    out, narrow = score.shape[1], left.shape[0] <= left.shape[1]

    def ends(w: np.ndarray, name: str) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    y = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1) @ w
                    yield pa.RecordBatch.from_arrays(
                        [
                            b.column(0),
                            pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1, dtype=np.int32) * y.shape[1]), pa.array(y.ravel()))
                        ],
                        names=["node_id", "x"]
                    )

        df = nodes.select("node_id", "x")
        df = df if narrow else df.mapInArrow(run, "node_id string, x array<double>")
        return df.select(F.col("node_id").alias(name), *(F.get("x", i).alias(f"{name}{i}") for i in range(w.shape[not narrow])))

    def projected(w: np.ndarray, name: str, k: int) -> Column:
        if not narrow:
            return F.col(f"{name}{k}")
        return reduce(lambda a, b: a + b, (F.col(f"{name}{i}") * float(w[i, k]) for i in range(len(w))))

    e = relations.select("relation", "src", "dst").join(ends(left, "src"), "src").join(ends(right, "dst"), "dst")
    both = [projected(left, "src", k) + projected(right, "dst", k) for k in range(left.shape[1])]
    leaky = [F.greatest(q, 0.2 * q) for q in both]
    for h in range(heads):
        e = e.withColumn(f"a{h}", reduce(lambda a, b: a + b, (leaky[h * out + i] * float(score[h, i]) for i in range(out))))
    into = Window.partitionBy("relation", "dst")
    e = e.drop(*(f"dst{i}" for i in range(right.shape[not narrow])))
    e = e.withColumns({f"e{h}": F.exp(F.col(f"a{h}") - F.max(f"a{h}").over(into)) for h in range(heads)})
    e = e.withColumns({f"w{h}": F.col(f"e{h}") / F.sum(f"e{h}").over(into) for h in range(heads)})
    weight = reduce(lambda a, b: a + b, (F.col(f"w{h}") for h in range(heads))) / heads
    attention = e.select("relation", "src", "dst", weight.alias("weight"))
    value = [
        reduce(lambda a, b: a + b, (F.col(f"w{h}") * projected(left, "src", h * out + i) for h in range(heads))) / heads for i in range(out)
    ]
    new = e.groupBy(F.col("dst").alias("node_id")).agg(*(F.sum(v).alias(f"v{i}") for i, v in enumerate(value)))
    return new, attention


def activated(sums: DataFrame, out: int) -> DataFrame:
    """(node_id, x) of the sums of messages."""
    elu = lambda c: F.when(F.col(c) > 0, F.col(c)).otherwise(F.exp(c) - 1)
    return sums.select("node_id", F.array(*(elu(f"v{i}") for i in range(out))).alias("x"))


def attention_layer(
    nodes: DataFrame, relations: DataFrame, left: np.ndarray, right: np.ndarray, score: np.ndarray, heads: int = 2
) -> tuple[DataFrame, DataFrame]:
    """One attention layer over typed edges: (node_id, x) of the new vectors, (relation, src, dst, weight) of the edges."""
    sums, attention = attention_sums(nodes, relations, left, right, score, heads)
    return activated(sums, score.shape[1]), attention


def attention_evidence(targets: DataFrame, outer: DataFrame, inner: DataFrame, top_n: int = 5) -> DataFrame:
    """(node_id, neighbors array<struct<weight, node_id>>): the top_n edges of the last layer into each target, then the top_n of
    the layer before into each of those; a neighbour counts with its highest weight. Equal weights: the smaller name.

    targets is a queue of any length; repeated nodes count once.
    """

    def best(edges: DataFrame) -> DataFrame:
        one = edges.groupBy("dst", "src").agg(F.max("weight").alias("weight"))
        place = Window.partitionBy("dst").orderBy(F.desc("weight"), "src")
        return one.withColumn("k", F.row_number().over(place)).where(F.col("k") <= top_n).drop("k")

    first = best(outer.join(targets.select(F.col("node_id").alias("dst")).distinct(), "dst", "left_semi"))
    second = best(inner.join(first.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi"))
    near = first.select(F.col("dst").alias("node_id"), F.col("src").alias("near"), "weight")
    far = first.select(
        F.col("dst").alias("node_id"), F.col("src").alias("dst")
    ).join(second, "dst").select("node_id", F.col("src").alias("near"), "weight")
    one = near.unionByName(far).where("near != node_id").groupBy("node_id", "near").agg(F.max("weight").alias("weight"))
    return one.groupBy("node_id").agg(F.array_sort(F.collect_list(F.struct("weight", F.col("near").alias("node_id")))).alias("neighbors"))

"""One identifier per group of records linked directly or indirectly, by low-diameter decomposition and contraction."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import Scratch

#: Rounds that the clusters of one level grow, which is also the span of their start times; the rate of the exponential
#: shifts; edges that end the recursion in one task of fixed size.
ROUNDS, RATE, LAST_EDGES = 3, 0.4, 2_000
_ID_BITS, _TICKS = 44, 1 << 14
_HOP = _TICKS << _ID_BITS


def _start(vertex: str, level: int) -> Column:
    """The vertex's start time ROUNDS - min(ROUNDS, Exp(RATE)) in ticks, above its id: the smaller, the sooner."""
    uniform = (F.pmod(F.xxhash64(F.col(vertex), F.lit(level)), F.lit(1 << 40)) + 1) / F.lit(float((1 << 40) + 1))
    shift = F.least(F.lit(float(ROUNDS)), -F.log(uniform) / F.lit(RATE))
    ticks = F.floor((F.lit(float(ROUNDS)) - shift) * _TICKS).cast("bigint")
    return F.shiftleft(ticks, _ID_BITS) + F.col(vertex)


def _grow(edges: DataFrame, level: int) -> DataFrame:
    """(v, c): the cluster that reaches each vertex first, within ROUNDS hops.

    The first hop needs no join, because a start time follows from the id. Each message is combined to one number per
    vertex before it is shuffled, so that a hub receives one row per task.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    reach = both.groupBy(F.col("b").alias("v")).agg(
        F.min(_start("a", level) + F.lit(_HOP)).alias("k")
    ).select("v", F.least(_start("v", level), "k").alias("k"))
    for _ in range(ROUNDS - 1):
        sent = both.join(reach.withColumnRenamed("v", "a"), "a").select(F.col("b").alias("v"), (F.col("k") + F.lit(_HOP)).alias("k"))
        reach = reach.unionByName(sent).groupBy("v").agg(F.min("k").alias("k"))
    return reach.select("v", F.col("k").bitwiseAND(F.lit((1 << _ID_BITS) - 1)).alias("c"))


def _contract(edges: DataFrame, assigned: DataFrame) -> DataFrame:
    """The edges between clusters, each once."""
    ends = edges.join(
        assigned.select(F.col("v").alias("a"), F.col("c").alias("ca")), "a"
    ).join(assigned.select(F.col("v").alias("b"), F.col("c").alias("cb")), "b")
    return ends.where("ca != cb").select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).distinct()


def _finish(table: pa.Table) -> pa.Table:
    """The last level: at most LAST_EDGES edges, in one task; the smallest id of each component."""
    a, b = table["a"].to_numpy(), table["b"].to_numpy()
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    root = np.arange(len(ids))
    while True:
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        root = root[root]
        while (root[root] != root).any():
            root = root[root]
        if (root == before).all():
            return pa.table({"v": ids, "c": ids[root]})


def numbered(values: DataFrame, scratch: Scratch, name: str = "vertices") -> DataFrame:
    """(id, value) of distinct values of one column, numbered from 0 in their order."""
    column = values.columns[0]
    rows = scratch.write(
        values.repartitionByRange(column)
        .sortWithinPartitions(column)
        .select(F.col(column).alias("value"), F.monotonically_increasing_id().alias("_m")),
        name
    )
    part = F.shiftright("_m", 33)
    offsets = rows.groupBy(part.alias("_p")).agg(F.count("*").alias("_n")).selectExpr(
        "_p", "coalesce(sum(_n) over (order by _p rows between unbounded preceding and 1 preceding), 0) as _before"
    )
    return rows.withColumn("_p", part).join(F.broadcast(offsets), "_p").select(
        (F.col("_m").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("_before")).cast("bigint").alias("id"), "value"
    )


def components(pairs: DataFrame, a: str, b: str, last_edges: int = LAST_EDGES) -> DataFrame:
    """(value, group): every value that a pair ties to another one, with the smallest value of its group.

    Values get numbers in their own order. On each level every vertex draws a start time that an exponential shift
    makes earlier, clusters grow from the vertices that start first, one hop per round, and a vertex belongs to the
    cluster that reaches it first. Clusters then become the vertices of the next level, on which only the edges between
    clusters are left; each level keeps a fraction of the edges (about RATE of them). The assignments are composed in
    the end. Clusters only join what is connected, whatever the shifts are, so that the result is exact.

    Work per round is one join and one aggregate over the level's edges. A hub or a giant group is one row per task in
    the aggregates, and its share of a join is split by adaptive execution. Each level is a table in the shared folder;
    the level that has at most last_edges edges is solved in one task of that bounded size.

    Order and repetition of pairs do not matter; a null end and a pair of equal ends tie nothing; an empty table gives
    an empty result. Other columns are ignored.
    """
    scratch = Scratch(pairs.sparkSession, "components")
    spark = pairs.sparkSession
    ends = pairs.select(F.least(a, b).alias("x"), F.greatest(a, b).alias("y")).where(
        F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))
    ).distinct()
    ends = scratch.write(ends, "pairs")
    values = numbered(ends.select("x").union(ends.select("y")).distinct(), scratch)
    edges = scratch.write(
        ends.join(values.select(F.col("value").alias("x"), F.col("id").alias("a")), "x")
        .join(values.select(F.col("value").alias("y"), F.col("id").alias("b")), "y")
        .select("a", "b"),
        "edges0"
    )
    scratch.drop("pairs")
    levels: list[DataFrame] = []
    while (left := edges.count()) > last_edges:
        k = len(levels)
        levels.append(scratch.write(_grow(edges, k), f"level{k}"))
        edges = scratch.write(_contract(edges, levels[-1]), f"edges{k + 1}")
        scratch.drop(f"edges{k}")
    last = edges.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(
        _finish, "v bigint, c bigint"
    ) if left else spark.createDataFrame([], "v bigint, c bigint")
    root = scratch.write(last, "last")
    for k in reversed(range(len(levels))):
        root = levels[k].join(
            root.select(F.col("v").alias("c"), F.col("c").alias("r")), "c", "left"
        ).select("v", F.coalesce("r", "c").alias("c"))
    root = scratch.write(root, "roots") if levels else root
    least = root.groupBy("c").agg(F.min("v").alias("id"))
    names = least.join(values, "id").select("c", F.col("value").alias("group"))
    return root.join(values.withColumnRenamed("id", "v"), "v").select("value", "c").join(names, "c").select("value", "group")


def wallet_ties(links: DataFrame, transactions: DataFrame) -> DataFrame:
    """(a, b) strings: the pairs of linked wallets, and for each transaction its smallest sender tied to the others.

    A star ties a list of wallets as well as all its pairs do, with one row per wallet.
    """
    wallets = F.array_sort(F.array_distinct(F.filter("input_addresses", lambda x: x.isNotNull())))
    senders = transactions.select(wallets.alias("w")).where("size(w) > 1")
    stars = senders.select(F.col("w")[0].alias("a"), F.explode(F.expr("slice(w, 2, size(w))")).alias("b"))
    return links.select(F.col("wallet_a").alias("a"), F.col("wallet_b").alias("b")).unionByName(stars)


def wallet_groups(links: DataFrame, transactions: DataFrame) -> DataFrame:
    """(wallet_id, group_id) of the wallets that links or common inputs tie, directly or through others."""
    return components(wallet_ties(links, transactions), "a", "b").select(
        F.col("value").alias("wallet_id"), F.col("group").alias("group_id")
    )
